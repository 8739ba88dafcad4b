import datetime as dt
import io

import pytest

from talkmill.operators import transcripts as tr
from talkmill.operators.model import hashing_embedder
from talkmill.operators.store import read_vectors
from talkmill.sources import log_source
from talkmill.sources import readers as rd
from talkmill.streaming.ingest import logged_transcripts, stream_ingest

TEXTS = ["one\x1e\ntwo", "\x1e", "\x1e.\x1e\n", "x\x1e", "", "a\n\x1e\n\x1eLog File: y\n", "é漢😀 " * 50, "[00:01] a"]
COLUMNS = (
    "video_url string, title string, duration string, language string, word_count int, method string, "
    "summary string, transcription string, file_name string"
)
UTC = dt.timezone.utc


def many(spark, folder, texts=TEXTS, tasks=2):
    rows = [(f"u{i}", "T", "1", "en", 1, "m", t, t, f"v{i}_2025010{i % 9 + 1}_000000.txt") for i, t in enumerate(texts)]
    tr.write_transcript_logs(spark.createDataFrame(rows, COLUMNS).coalesce(tasks), folder)


def single(folder, *days):
    for day in days:
        (folder / f"transcript_{day}_101112.txt").write_text(
            f"YouTube Video URL: s{day}\n\n{rd.TRANSCRIPT_MARK}\nsaid on {day}", "utf-8"
        )


def plain(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("range_bytes", [7, 64, 1000, 1 << 20])
def test_the_source_equals_the_scan(spark, tmp_path, range_bytes):
    many(spark, str(tmp_path / "logs" / "day=1"))
    single(tmp_path / "logs", "20250301", "20250302")
    (tmp_path / "logs" / "undated.txt").write_text("no header at all")
    (tmp_path / "logs" / "_hidden_20250301_000000").write_text("x")
    got = log_source.read_logs(spark, str(tmp_path / "logs"), range_bytes)
    assert got.columns == rd.scan_transcript_logs(spark, str(tmp_path / "logs")).columns
    key = lambda r: r.file_name
    scan = spark.read.option("recursiveFileLookup", "true").text(str(tmp_path / "logs"), lineSep=rd.LOG_SEPARATOR)
    expected = sorted(rd._records(scan).collect(), key=key)
    assert sorted(got.collect(), key=key) == expected and len(expected) == len(TEXTS) + 3


def test_every_split_gives_each_record_once():
    data = b"a\x1e\nbb\x1e\x1e\n\x1e\nccc\n\x1e\nd"
    for size in range(1, len(data) + 2):
        got = []
        for begin in range(0, len(data), size):
            got += log_source.records(io.BytesIO(data), begin, min(len(data), begin + size))
        assert got == [b"a", b"bb\x1e", b"ccc\n", b"d"], size


def test_filters_reach_the_source_and_unneeded_files_stay_closed(spark, tmp_path):
    logs = tmp_path / "logs"
    many(spark, str(logs))
    single(logs, "20250301", "20250302", "20250303")
    (logs / "transcript_20240101_000000.txt").write_text("no header")
    table = log_source.read_logs(spark, str(logs))
    for where in (
        "run_ts >= timestamp'2025-03-02'", "run_ts = timestamp'2025-03-01 10:11:12'", "run_ts < timestamp'2024-06-01'",
        "run_ts > timestamp'2025-01-02' and run_ts <= timestamp'2025-03-01 10:11:12'",
        "run_ts in (timestamp'2025-01-03', timestamp'2025-03-03 10:11:12')", "run_ts is null",
    ):
        assert plain(table.where(where)) == plain(rd.scan_transcript_logs(spark, str(logs)).where(where)), where
    reader = log_source.LogReader({"path": str(logs)})
    since = log_source.ds.GreaterThanOrEqual(("run_ts",), dt.datetime(2025, 3, 2, tzinfo=UTC))
    assert list(reader.pushFilters([since])) == [since]
    names = [p.rsplit("/", 1)[-1] for part in reader.partitions() for p, _, _ in part.parts]
    assert [n for n in names if "transcript_" in n] == ["transcript_20250302_101112.txt", "transcript_20250303_101112.txt"]
    assert [r.column("file_name").to_pylist() for p in reader.partitions() for r in reader.read(p)] == [
        ["transcript_20250302_101112.txt", "transcript_20250303_101112.txt"]
    ]


def test_sql_and_missing_folders(spark, tmp_path):
    log_source.register_logs(spark)
    single(tmp_path, "20250301")
    spark.sql(f"create or replace temporary view made_logs using transcript_logs options (path '{tmp_path}')")
    assert spark.sql("select file_name from made_logs where run_ts > timestamp'2025-01-01'").count() == 1
    (tmp_path / "empty").mkdir()
    assert log_source.read_logs(spark, str(tmp_path / "empty")).collect() == []
    with pytest.raises(Exception, match="nowhere"):
        log_source.read_logs(spark, str(tmp_path / "nowhere")).collect()


def test_ingest_reads_a_stream_of_logs(spark, tmp_path):
    logs, work = tmp_path / "logs", str(tmp_path / "work")
    logs.mkdir()
    companies = spark.createDataFrame(
        [("s20250301", "Acme"), ("s20250301", "Acme"), ("s20250302", "Acme"), ("s20250302", "B")], "video_url string, company_name string"
    )

    def run():
        stream = logged_transcripts(rd.stream_transcript_logs(spark, str(logs)), companies)
        stream_ingest(stream, f"{work}/store", f"{work}/ck", hashing_embedder(8), 8, watermark="90 days", available_now=True).awaitTermination()
        return sorted((r.id, r.metadata.text) for r in read_vectors(spark, f"{work}/store").collect())

    single(logs, "20250301", "20250309")
    first = run()
    assert first == [("Acme_s20250301_0", "said on 20250301")]
    single(logs, "20250302")
    assert run() == [*first, ("Acme_s20250302_0", "said on 20250302"), ("B_s20250302_0", "said on 20250302")]


def test_a_join_by_address_parses_each_log_once(spark, tmp_path):
    many(spark, str(tmp_path / "logs"))
    companies = spark.createDataFrame([(f"u{i}", "Acme") for i in range(len(TEXTS))], "video_url string, company_name string")
    logs = logged_transcripts(rd.scan_transcript_logs(spark, str(tmp_path / "logs")), companies)
    plan = logs.where("video_url <> 'u1'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("YouTube Video URL: ") == 1
    assert plan.count(rd.TRANSCRIPT_MARK) <= 6
    got = {r.video_url: r.transcription for r in logs.where("video_url <> 'u1'").collect()}
    assert got == {f"u{i}": t for i, t in enumerate(TEXTS) if i != 1}
