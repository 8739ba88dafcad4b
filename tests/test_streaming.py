import datetime as dt
import random
from types import SimpleNamespace

from talkmill.functions.timing import SEGMENTS_TYPE
from talkmill.operators.model import hashing_embedder
from talkmill.operators.store import read_vectors, store_registry
from talkmill.streaming import chunk_live_segments, rocksdb_state, read_transcript_stream, stream_ingest

LIVE = (
    "video_url string, seg_idx bigint, text string, start double, end double, "
    "is_last boolean, event_ts timestamp"
)
ARRIVING = (
    "video_url string, company_name string, title string, transcription string, duration string, "
    f"language string, word_count int, segments {SEGMENTS_TYPE}, run_ts timestamp"
)


def write(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_live_chunks_over_batches_late_rows_and_idle_videos(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    ts = lambda s: dt.datetime(2025, 1, 1) + dt.timedelta(seconds=s)

    def run():
        segments = spark.readStream.schema(LIVE).parquet(src)
        with rocksdb_state(spark):
            (
            chunk_live_segments(segments, 12, 1000, watermark="10 seconds", idle_ms=30_000)
            .writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
            .trigger(availableNow=True).start().awaitTermination()
            )
        rows = spark.read.parquet(out).collect()
        return sorted((r.video_url, r.kind, r.chunk_index, r.text) for r in rows if r.kind == "chunk"), [
            r.text for r in rows if r.kind == "late"
        ]

    write(spark, [("v", 0, " hello ", 1.0, 2.0, False, ts(0)), ("v", 1, " ", 2.0, 3.0, False, ts(1))], LIVE, src)
    assert run() == ([], [])
    write(
        spark,
        [("v", 3, "tail", 5.0, 6.0, False, ts(4)), ("v", 2, "world!", 3.0, 4.0, False, ts(3)),
         ("v", 1, "again", 2.0, 3.0, False, ts(4)), ("w", 0, "one", 0.0, 1.0, True, ts(4))],
        LIVE, src,
    )
    chunks, late = run()
    assert chunks == [("v", "chunk", 0, "hello world!"), ("w", "chunk", 0, "one")] and late == ["again"]
    # Time passes in another video; the open chunk of the idle one is given out.
    write(spark, [("x", 0, "later", 0.0, 1.0, True, ts(500))], LIVE, src)
    chunks, _ = run()
    assert ("v", "chunk", 1, "tail") in chunks


def test_ingest_stream_merges_runs_and_restarts(spark, tmp_path):
    src, store, ck = (str(tmp_path / n) for n in ("in", "store", "ck"))
    ts = lambda h: dt.datetime(2025, 1, 1) + dt.timedelta(minutes=h)

    def run():
        stream = read_transcript_stream(spark, src, ARRIVING)
        stream_ingest(stream, store, ck, hashing_embedder(16), 16, available_now=True).awaitTermination()
        return sorted((r.namespace, r.id, r.metadata.text) for r in read_vectors(spark, store).collect())

    def row(url, text, minute, segments=None):
        return (url, "Acme Co", "T", text, "Unknown", "en", 1, segments, ts(minute))

    write(spark, [row("u1", "[00:01] a\n[00:02] b", 0), row("u2", "plain", 0), row("u2", "plain", 0)], ARRIVING, src)
    first = run()
    assert first == [
        ("acme-co", "Acme Co_u1_0", "a"), ("acme-co", "Acme Co_u1_1", "b"), ("acme-co", "Acme Co_u2_0", "plain"),
    ]
    assert run() == first
    write(spark, [row("u2", "newest", 9), row("u2", "newer", 5), row("u3", "x", 9, [("seg", 0.0, 1.0)])], ARRIVING, src)
    second = run()
    assert second == first[:2] + [("acme-co", "Acme Co_u2_0", "newest"), ("acme-co", "Acme Co_u3_0", "seg")]




def test_one_file_and_a_folder_of_files_are_read_whole(spark, tmp_path):
    rows = spark.range(200).selectExpr("id")
    rows.repartition(4).write.parquet(str(tmp_path / "folder.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    single = next((tmp_path / "one").glob("*.parquet"))
    for name, path in (("folder", tmp_path / "folder.parquet"), ("single", single)):
        for bound in ({}, {"maxFilesPerTrigger": "1"}):
            table = f"read_{name}_{len(bound)}"
            job = read_transcript_stream(spark, str(path), "id bigint", **bound).writeStream.format("memory")
            job.queryName(table).trigger(availableNow=True).start().awaitTermination()
            assert spark.table(table).count() == 200


def test_stream_leaves_no_staging_and_can_replace_videos(spark, tmp_path):
    src, store, ck = (str(tmp_path / n) for n in ("in", "store", "ck"))
    row = lambda text, minute: (
        "u1", "A", "T", text, "Unknown", "en", 1, None, dt.datetime(2025, 1, 1) + dt.timedelta(minutes=minute)
    )
    for text, minute in (("[00:01] a\n[00:02] b", 0), ("[00:01] c", 5)):
        write(spark, [row(text, minute)], ARRIVING, src)
        stream = read_transcript_stream(spark, src, ARRIVING)
        stream_ingest(
            stream, store, ck, hashing_embedder(16), 16, available_now=True, replace_video=True, buckets=2
        ).awaitTermination()
    assert [r.metadata.text for r in read_vectors(spark, store).collect()] == ["c"]
    assert not list((tmp_path / "ck" / "staging").iterdir())


def test_paths_with_pattern_letters(spark, tmp_path):
    for name in ("plain", "a[1]", "b*c", "q?", "{x,y}", "end]", "dash-"):
        spark.range(5).coalesce(1).write.parquet(str(tmp_path / name / "in"))
        (tmp_path / name / "in").rename(tmp_path / name / name)
        table = f"paths_{abs(hash(name))}"
        stream = read_transcript_stream(spark, f"{tmp_path}/{name}/{name}/", "id bigint")
        stream.writeStream.format("memory").queryName(table).trigger(availableNow=True).start().awaitTermination()
        assert spark.table(table).count() == 5, name


def test_ingest_stream_resolves_names_added_between_batches(spark, tmp_path):
    src, store, ck, reg = (str(tmp_path / n) for n in ("in", "store", "ck", "reg"))
    entry = lambda n, v: spark.createDataFrame([(f"{n}.mp4", f"https://cdn/{n}", v)], "video_name string, video_url string, version int")

    def run(minute, *names):
        rows = [(f"/tmp/in/{n}.mp4", "A", "T", "text", "Unknown", "en", 1, None, dt.datetime(2025, 1, 1, 0, minute)) for n in names]
        write(spark, rows, ARRIVING, src)
        stream = read_transcript_stream(spark, src, ARRIVING)
        stream_ingest(
            stream, store, ck, hashing_embedder(16), 16, available_now=True, buckets=1, registry=reg
        ).awaitTermination()
        return sorted(r.metadata.video_url for r in read_vectors(spark, store).collect())

    store_registry(spark, reg, entry("one", 1))
    assert run(0, "one", "two") == ["/tmp/in/two.mp4", "https://cdn/one"]
    store_registry(spark, reg, entry("two", 2))
    assert run(5, "two") == ["/tmp/in/two.mp4", "https://cdn/one", "https://cdn/two"]


def live(spark, tmp_path, batches, **options):
    """Rows that the live chunker gives for the batches, one trigger each."""
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    for rows in batches:
        write(spark, rows, LIVE, src)
        with rocksdb_state(spark):
            (
                chunk_live_segments(spark.readStream.schema(LIVE).parquet(src), **options)
                .writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
                .trigger(availableNow=True).start().awaitTermination()
            )
    return spark.read.parquet(out).collect()


def plain_fold(texts, size):
    chunks, open_ = [], ""
    for i, text in enumerate(texts):
        open_ = f"{open_} {text}" if open_ else text
        if len(open_) >= size or i == len(texts) - 1:
            chunks.append(open_)
            open_ = ""
    return chunks


def test_shuffled_segments_within_the_watermark_give_the_batch_fold(spark, tmp_path, monkeypatch):
    r, rows, expected = random.Random(8), [], {}
    for video in "abc":
        texts = [f"{video}{i}" for i in range(700)]
        expected[video] = plain_fold(texts, 40)
        rows += [(video, i, t, i * 1.0, i + 1.0, i == 699, dt.datetime(2025, 1, 1) + dt.timedelta(seconds=i)) for i, t in enumerate(texts)]
    r.shuffle(rows)
    batches = [rows[i::4] for i in range(4)]
    got = live(spark, tmp_path, batches, chunk_size=40, max_duration=1e9, watermark="1 hour")
    assert {x.kind for x in got} == {"chunk"}
    for video, chunks in expected.items():
        own = sorted((x.chunk_index, x.text) for x in got if x.video_url == video)
        assert own == list(enumerate(chunks))


def test_gaps_wait_for_the_watermark_and_repeats_are_late(spark, tmp_path):
    at = lambda s: dt.datetime(2025, 1, 1) + dt.timedelta(seconds=s)
    row = lambda i, text, s, last=False, video="v": (video, i, text, s * 1.0, s + 1.0, last, at(s))
    batches = [
        [row(0, "a", 0), row(2, "c", 2), row(2, "twice", 2), row(5, "f", 5)],
        [row(1, "b", 1)],  # fills the first gap
        [row(0, "pace", 100, True, "w")],  # the watermark passes 5: segments 3 and 4 will not come
        [row(1, "pace", 101, True, "w")],
        [row(3, "too late", 103), row(6, "g", 104, True)],
    ]
    got = live(spark, tmp_path, batches, chunk_size=1000, max_duration=1e9, watermark="10 seconds", idle_ms=10**9)
    mine = [x for x in got if x.video_url == "v"]
    assert [x.text for x in mine if x.kind == "chunk"] == ["a b c f g"]
    assert sorted(x.text for x in mine if x.kind == "late") == ["too late", "twice"]


def test_live_segments_reach_python_as_rows_and_a_timer_that_holds_is_kept(spark, tmp_path):
    """A frame for each short video, and a new timer each time it has segments, took most of the time."""
    from talkmill.streaming import live_chunks as lc

    arriving = spark.readStream.schema(LIVE).parquet(str(tmp_path))
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "event_ms" in plan(chunk_live_segments(arriving))
    assert "event_ms" not in plan(chunk_live_segments(arriving, frames=True))

    states, calls = [None], []
    processor = lc.LiveRowChunker(500, 1e12, True, 1_000)
    processor.open = SimpleNamespace(get=lambda: states[-1], update=states.append)
    processor.handle = SimpleNamespace(registerTimer=lambda t: calls.append(t), deleteTimer=lambda t: calls.append(-t))
    for i in range(3):
        rows = [(i, f"t{i}", 1.0, 2.0, False, 10_000 + i)]
        assert list(processor.folded(("v",), iter([rows]), 5_000)) == []
    assert calls == [11_000]
    # The timer that comes too early gives nothing out and sets the one that is due.
    assert list(processor.released(("v",), 11_000)) == [] and calls == [11_000, 11_002]
    assert list(processor.released(("v",), 11_002)) == [[("v", lc.CHUNK, 0, "t0 t1 t2", 1.0, 2.0)]]


def test_a_long_backlog_of_one_video_is_held_frame_by_frame():
    """100,000 segments in one call, backwards by frames: what is at hand stays bounded."""
    import pandas as pd

    from talkmill.streaming import live_chunks as lc

    class Value:
        value = None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    class Held(dict):
        getValue, updateValue, removeKey = dict.__getitem__, dict.__setitem__, dict.__delitem__

    n, size = 100_000, 1_000
    processor = lc.LiveChunker(500, 1e12, True, 1_000)
    processor.open, processor.held = Value(), Held()
    processor.handle = SimpleNamespace(registerTimer=lambda t: None, deleteTimer=lambda t: None)
    most, real = [0], lc.Fold.drain

    def watched(self):
        real(self)
        most[0] = max(most[0], len(self.waiting))

    lc.Fold.drain = watched
    try:
        def frames():
            for begin in range(n - size, -1, -size):
                idx = range(begin, begin + size)
                yield pd.DataFrame(
                    {"seg_idx": idx, "text": [f"t{i}" for i in idx], "start": [float(i) for i in idx],
                     "end": [i + 1.0 for i in idx], "is_last": [i == n - 1 for i in idx],
                     "event_ts": pd.to_datetime([10**9 + i for i in idx], unit="s")}
                )

        out = pd.concat(processor.handleInputRows(("v",), frames(), SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)))
    finally:
        lc.Fold.drain = real
    assert out["text"].tolist() == plain_fold([f"t{i}" for i in range(n)], 500)
    assert most[0] <= lc.AT_HAND + size and not processor.held
