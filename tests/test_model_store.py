import json
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkmill.operators import model as mo
from talkmill.operators import snapshots
from talkmill.operators import store as st
from talkmill.operators import transcripts as tr
from talkmill.sources import readers as rd


def test_only_what_fails_alone_gets_the_default(spark):
    def picky():
        def run(texts):
            if "bad" in texts:
                raise RuntimeError("no")
            if "short" in texts:
                return []
            return [t.upper() for t in texts]

        return run

    values = ["a", "b", "bad", "c", "short", "d", None, "e"]
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string").coalesce(1)
    for size in (2, 3, 100):
        out = mo.batch_model(df, "t", "r", picky, "string", batch_size=size, default="?", error_col="e").collect()
        assert [r.r for r in out] == ["A", "B", "?", "C", "?", "D", None, "E"]
        assert [r.t for r in out] == values
        assert {r.t: r.e for r in out if r.e} == {"bad": "RuntimeError: no", "short": "0 results for 1 texts"}


def test_null_texts_never_reach_the_model(spark):
    def touchy():
        return lambda texts: [len(t) * "x" for t in texts]

    df = spark.createDataFrame([(None,), ("ab",), (None,)], "t string").coalesce(1)
    assert [r.r for r in mo.batch_model(df, "t", "r", touchy, "string").collect()] == [None, "xx", None]
    rows = mo.embed(df, "t", mo.hashing_embedder(4), 4).collect()
    assert [(r.embedding is None, r.is_zero) for r in rows] == [(True, True), (False, False), (True, True)]


class TaskOf:
    """Stands for a data frame: gives what would run in its tasks."""

    schema = T.StructType([T.StructField("t", T.StringType())])

    def mapInArrow(self, run, schema):
        return run


def peak_mb(work):
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_task_holds_a_piece_of_an_arrow_batch_as_strings():
    batch = pa.RecordBatch.from_pydict({"t": [None if i % 7 == 0 else f"{i:06d}" * 10_000 for i in range(600)]})
    calls = []

    def factory():
        return lambda texts: calls.append(len(texts)) or [t[:6] for t in texts]

    run = mo.batch_model(TaskOf(), "t", "r", factory, "string", batch_size=10)
    out, mb = peak_mb(lambda: [r for b in run(iter([batch, batch])) for r in b.column("r").to_pylist()])
    assert out == [None if i % 7 == 0 else f"{i:06d}" for i in range(600)] * 2
    assert set(calls[:-1]) == {10}
    assert mb < 8


def test_the_stand_in_embedder_remembers_few_tokens():
    texts = [" ".join(f"w{i}x{j}" for j in range(400)) for i in range(1000)]
    embedder = mo.hashing_embedder(8)()
    made, mb = peak_mb(lambda: [v for lo in range(0, 1000, 100) for v in embedder(texts[lo : lo + 100])])
    assert mb < 30
    assert all((a == mo.hashing_embedder(8)()([t])[0]).all() for a, t in zip(made[::97], texts[::97]))
    long = ["a b " * (1 << 18), "c", "a " * (1 << 19), "b"]
    assert [list(v) for v in embedder(long)] == [list(embedder([t])[0]) for t in long]


def test_embed_flags_failed_rows(spark):
    def factory():
        inner = mo.hashing_embedder(16)()

        def run(texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("no")
            return inner(texts)

        return run

    df = spark.createDataFrame([("a b a",), ("bad",), ("c",)], "t string").coalesce(1)
    rows = mo.embed(df, "t", factory, 16, batch_size=1).collect()
    assert [r.is_zero for r in rows] == [False, True, False]
    assert all(len(r.embedding) == 16 for r in rows)
    assert abs(sum(x * x for x in rows[0].embedding) - 1) < 1e-6


def vectors(spark, rows):
    """rows: (company, url, index, text, version)"""
    df = spark.createDataFrame(
        rows, "company_name string, video_url string, chunk_index int, text string, version long"
    )
    df = df.selectExpr(
        "*", "0.0D as start", "0.0D as end", "'t' as title", "'9' as duration", "'en' as language",
        "3 as word_count", "array(1f) as embedding",
    )
    return st.vector_rows(df, F.col("version"), F.lit("youtube"))


def state(df):
    return sorted((r.namespace, r.id, r.metadata.text, r.version) for r in df.collect())


def test_upsert_keeps_stale_tail_unless_replaced(spark):
    old = vectors(spark, [("Acme Co", "u", i, f"old{i}", 1) for i in range(3)] + [("acme-co", "u", 0, "other", 1)])
    new = vectors(spark, [("Acme Co", "u", 0, "new0", 2)])
    assert state(st.upsert_vectors(old, new)) == [
        ("acme-co", "Acme Co_u_0", "new0", 2),
        ("acme-co", "Acme Co_u_1", "old1", 1),
        ("acme-co", "Acme Co_u_2", "old2", 1),
        ("acme-co", "acme-co_u_0", "other", 1),
    ]
    assert [s[2] for s in state(st.upsert_vectors(old, new, replace_video=True))] == ["new0"]


def test_upsert_orders_of_one_batch_and_of_equal_versions(spark):
    old = vectors(spark, [("a", "u", 0, "old0", 3), ("a", "u", 1, "old1", 3), ("a", "u", 2, "old2", 3)])
    new = vectors(spark, [("a", "u", 0, "same", 3), ("a", "u", 1, "late", 2), ("a", "u", 3, "first", 1)])
    texts = {r.id: r.metadata.text for r in st.upsert_vectors(old, new).collect()}
    assert texts == {"a_u_0": "same", "a_u_1": "old1", "a_u_2": "old2", "a_u_3": "first"}
    # The same id twice with one version: the larger content hash, whatever the order of rows.
    twice = [("a", "u", 0, "x", 4), ("a", "u", 0, "y", 4), ("a", "u", 0, "z", 4)]
    found = {
        tuple(r.metadata.text for r in st.upsert_vectors(old.limit(0), vectors(spark, rows)).collect())
        for rows in (twice, twice[::-1])
    }
    assert len(found) == 1 and len(found.pop()) == 1


def test_late_older_run_leaves_newer_rows(spark):
    old = vectors(spark, [("a", "u", 0, "new0", 5), ("a", "v", 0, "v0", 1), ("a", "v", 1, "v1", 1)])
    late = vectors(spark, [("a", "u", 0, "x", 2), ("a", "u", 1, "y", 2), ("a", "v", 0, "w0", 2)])
    got = {r.id: r.metadata.text for r in st.upsert_vectors(old, late, replace_video=True).collect()}
    assert got == {"a_u_0": "new0", "a_v_0": "w0"}


def stored_texts(spark, path):
    return {r.id: r.metadata.text for r in st.read_vectors(spark, path).collect()}


def test_merge_on_disk_touches_only_its_partitions_and_repeats(spark, tmp_path):
    path = str(tmp_path / "store")
    first = vectors(spark, [(c, f"u{i}", j, f"v1-{c}{i}{j}", 1) for c in "abc" for i in range(4) for j in range(2)])
    st.merge_vectors(spark, path, first, str(tmp_path / "staging"), 4)
    files = {f for f in (tmp_path / "store").rglob("*.parquet")}
    new = vectors(spark, [("a", "u1", 0, "v2", 2), ("a", "u9", 0, "fresh", 2), ("a", "u1", 0, "older", 1)])
    for _ in range(2):
        st.merge_vectors(spark, path, new, str(tmp_path / "staging"))
        texts = stored_texts(spark, path)
        assert len(texts) == 25 and texts["a_u1_0"] == "v2" and texts["a_u9_0"] == "fresh"
        assert texts["a_u1_1"] == "v1-a11" and texts["b_u1_0"] == "v1-b10"
    kept = {f for f in (tmp_path / "store").rglob("*.parquet")}
    untouched = {f for f in files if "namespace=a" not in str(f)}
    assert untouched and untouched <= kept
    assert not list((tmp_path / "staging").iterdir()), "each run removes what it staged"


def test_staging_folder_used_before_reverts_nothing(spark, tmp_path):
    path, staging = str(tmp_path / "store"), str(tmp_path / "staging")
    for version in (1, 2, 3):
        name = staging if version < 3 else f"{staging}-other"
        st.merge_vectors(spark, path, vectors(spark, [("a", "u", 0, f"v{version}", version)]), name, 2)
    st.merge_vectors(spark, path, vectors(spark, [("b", "w", 0, "b", 1)]), staging, 2)
    assert stored_texts(spark, path) == {"a_u_0": "v3", "b_w_0": "b"}


def test_equal_version_on_disk_is_the_later_write(spark, tmp_path):
    path = str(tmp_path / "store")
    for text in ("one", "two"):
        st.merge_vectors(spark, path, vectors(spark, [("a", "u", i, f"{text}{i}", 1) for i in range(3)]), str(tmp_path / "s"), 2)
    assert set(stored_texts(spark, path).values()) == {"two0", "two1", "two2"}


def test_bucket_count_is_the_tables_own(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = vectors(spark, [("a", f"u{i}", 0, "x", 1) for i in range(30)])
    st.merge_vectors(spark, path, rows, str(tmp_path / "s"), 3)
    st.merge_vectors(spark, path, rows, str(tmp_path / "s"), 16)
    assert st.read_vectors(spark, path).select("bucket").distinct().count() == 3
    assert st.read_vectors(spark, path).count() == 30


@pytest.mark.parametrize("hashes", [0, 100])
def test_a_merge_rewrites_only_partitions_in_which_a_new_row_counts(spark, tmp_path, monkeypatch, hashes):
    monkeypatch.setattr(st, "MAX_HASHES", hashes)
    path, staging = str(tmp_path / "v"), str(tmp_path / "s")
    merge = lambda rows: st.merge_vectors(spark, path, vectors(spark, rows), staging, 1)
    runs = lambda: {r.namespace: r.run for r in st.vector_table(spark, path).manifest().collect()}
    merge([("a", "u", i, f"old {i}", 2) for i in range(4)] + [("b", "u", 0, "b", 1), ("c", "u", 0, "c", 3)])
    first = runs()
    # Late rows alone change nothing; beside one that counts they go, too.
    merge([("a", "u", i, "late", 1) for i in range(4)])
    assert runs() == first
    merge([("a", "u", 1, "new 1", 2), ("a", "u", 1, "older", 1), ("a", "u", 2, "late", 1), ("a", "u", 9, "new 9", 1), ("c", "u", 0, "late", 2)])
    last = runs()
    assert last["a"] != first["a"] and (last["b"], last["c"]) == (first["b"], first["c"])
    texts = sorted(r.text for r in st.read_vectors(spark, path).select("metadata.text").collect())
    assert texts == ["b", "c", "new 1", "new 9", "old 0", "old 2", "old 3"]
    # Rows that are not replaced stay where they are read: no shuffle but that of the few that may be.
    gone = vectors(spark, [("a", "u", 0, "x", 1)]).select("namespace", "id")
    plan = st._without(st.read_vectors(spark, path), gone)._jdf.queryExecution().optimizedPlan().toString()
    assert ("Union" in plan) == (hashes > 0)


def test_odd_namespaces_on_disk(spark, tmp_path):
    path = str(tmp_path / "store")
    names = ["a/b", "50%", "x=y", "{q}", "a b", "é", "", "c:d*?"]
    rows = [(n, "u", i, n, 1) for i, n in enumerate(names)]
    for _ in range(2):
        st.merge_vectors(spark, path, vectors(spark, rows), str(tmp_path / "s"), 1)
    assert sorted(stored_texts(spark, path).values()) == sorted(names)


def files_read(df):
    """Files that the one scan of a plan without exchanges opened; ``df`` was collected before."""
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return scan.metrics().apply("numFiles").value()


def touched(spark, pairs):
    return spark.createDataFrame(pairs, "namespace string, bucket int")


def test_merge_into_a_store_of_many_partitions_reads_few_folders(spark, tmp_path):
    path = str(tmp_path / "store")
    many = vectors(spark, [(f"c{i}", f"u{j}", 0, "x", 1) for i in range(125) for j in range(12)])
    st.merge_vectors(spark, path, many, str(tmp_path / "s"), 8)
    assert sum(1 for _ in (tmp_path / "store" / "data").glob("*/*/*")) > 700
    pairs = touched(spark, [(n, b) for n in ("c7", "nobody") for b in range(3)])
    found = st.vector_table(spark, path).rows(pairs)
    assert {r.namespace for r in found.collect()} == {"c7"}
    assert files_read(found) <= 3


def test_touching_very_many_partitions_reads_the_same(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    for text, n in (("x", 6), ("y", 2)):
        st.merge_vectors(spark, path, vectors(spark, [(f"c{i}", "u", 0, text, 1) for i in range(n)]), str(tmp_path / "s"), 2)
    pairs = touched(spark, [(f"c{i}", b) for i in range(3) for b in range(2)])
    rows = lambda: sorted((r.id, r.metadata.text) for r in st.vector_table(spark, path).rows(pairs).collect())
    pruned = rows()
    monkeypatch.setattr(snapshots, "MAX_PRUNED", 1)
    assert rows() == pruned == [("c0_u_0", "y"), ("c1_u_0", "y"), ("c2_u_0", "x")]


class Killed(Exception):
    pass


@pytest.mark.parametrize("at", ["rows", "manifest", "pointer"])
def test_a_merge_killed_on_the_way_leaves_the_old_state(spark, tmp_path, monkeypatch, at):
    path, staging = str(tmp_path / "store"), str(tmp_path / "s")
    st.merge_vectors(spark, path, vectors(spark, [(c, "u", 0, "old", 1) for c in "abcd"]), staging, 2)
    before = stored_texts(spark, path)
    new = vectors(spark, [(c, "u", 0, "new", 2) for c in "abcd"])
    with monkeypatch.context() as m:
        if at == "rows":  # some partitions are written, then one fails
            real = st.upsert_vectors

            def failing(*args):
                bad = F.when(F.col("namespace") == "c", F.raise_error(F.lit("lost"))).otherwise(F.col("id"))
                return real(*args).withColumn("id", bad.cast("string"))

            m.setattr(st, "upsert_vectors", failing)
        else:
            def kill(*args):
                raise Killed

            m.setattr(snapshots.StoredTable, "_wrote_rows" if at == "manifest" else "_publish", kill)
        with pytest.raises(Exception):
            st.merge_vectors(spark, path, new, staging, 2)
    assert stored_texts(spark, path) == before
    assert not list((tmp_path / "s").iterdir())
    st.merge_vectors(spark, path, new, staging, 2)
    assert set(stored_texts(spark, path).values()) == {"new"}
    table = st.vector_table(spark, path)
    table.remove_unused(keep=1)
    assert set(stored_texts(spark, path).values()) == {"new"}
    assert len(list((tmp_path / "store" / "data").iterdir())) == 1


def test_a_reader_keeps_its_snapshot(spark, tmp_path):
    path, staging = str(tmp_path / "store"), str(tmp_path / "s")
    st.merge_vectors(spark, path, vectors(spark, [("a", "u", 0, "one", 1), ("b", "u", 0, "one", 1)]), staging, 1)
    began = st.read_vectors(spark, path)
    st.merge_vectors(spark, path, vectors(spark, [("a", "u", 0, "two", 2)]), staging, 1)
    assert sorted(r.metadata.text for r in began.collect()) == ["one", "one"]
    st.vector_table(spark, path).remove_unused(keep=2)
    assert sorted(r.metadata.text for r in began.collect()) == ["one", "one"]
    assert stored_texts(spark, path) == {"a_u_0": "two", "b_u_0": "one"}


def test_a_batch_is_merged_once(spark, tmp_path):
    path, staging = str(tmp_path / "store"), str(tmp_path / "s")
    for batch, text in ((0, "a"), (1, "b"), (1, "again"), (0, "late"), (2, "c")):
        rows = vectors(spark, [("n", "u", batch, text, 1)])
        st.merge_vectors(spark, path, rows, staging, 1, batch=("stream", batch))
    st.merge_vectors(spark, path, vectors(spark, [("n", "u", 9, "other", 1)]), staging, 1, batch=("other", 0))
    assert sorted(stored_texts(spark, path).values()) == ["a", "b", "c", "other"]


def test_of_two_writers_one_wins(spark, tmp_path):
    path, staging = str(tmp_path / "store"), str(tmp_path / "s")
    st.merge_vectors(spark, path, vectors(spark, [("a", "u", 0, "one", 1)]), staging, 1)
    table = st.vector_table(spark, path)
    head, rows = table.head(), table.rows()
    pairs = touched(spark, [("a", 0)])
    table.commit(head, rows, pairs)
    with pytest.raises(snapshots.SnapshotConflict):
        table.commit(head, rows, pairs)
    assert table.head()["version"] == 2 and stored_texts(spark, path) == {"a_u_0": "one"}


def test_counts_and_figures_come_from_the_manifest(spark, tmp_path):
    path, staging = str(tmp_path / "store"), str(tmp_path / "s")
    assert st.stored_figures(spark, path).collect() == []
    for version, text in ((1, "four"), (2, "sixsix"), (3, "x")):
        rows = vectors(spark, [(c, f"u{i}", j, text, version) for c in "ab" for i in range(5 - version) for j in range(2)])
        st.merge_vectors(spark, path, rows, staging, 3)
    got = st.stored_figures(spark, path)
    assert "embedding" not in got._jdf.queryExecution().toString()
    assert "/data/" not in got._jdf.queryExecution().toString() and "/manifests/" in str(got.inputFiles())
    rows = st.read_vectors(spark, path).groupBy("namespace").agg(
        F.count("*").alias("vector_count"),
        F.count_if((F.col("metadata.start") > 0) | (F.col("metadata.end") > 0)).alias("with_ts"),
        F.avg(F.col("metadata.end") - F.col("metadata.start")).alias("avg_duration"),
        F.avg(F.length("metadata.text")).alias("avg_chars"),
    )
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))


def test_empty_merges(spark, tmp_path):
    path, staging = str(tmp_path / "store"), str(tmp_path / "s")
    none = vectors(spark, [("a", "u", 0, "x", 1)]).limit(0)
    st.merge_vectors(spark, path, none, staging, 2)
    assert stored_texts(spark, path) == {}
    st.merge_vectors(spark, path, vectors(spark, [("a", "u", 0, "x", 1)]), staging, 5)
    st.merge_vectors(spark, path, none, staging, 2)
    assert stored_texts(spark, path) == {"a_u_0": "x"} and st.vector_table(spark, path).head()["buckets"] == 2


def test_stored_registry(spark, tmp_path):
    path = str(tmp_path / "registry")
    columns = "video_name string, video_url string, version int"
    assert st.read_registry(spark, path).collect() == []
    first = [("a", "1", 1), ("b", "1", 1), (None, "lost", 1), ("a", "0", 1)]
    for rows in (first, [("b", "2", 2), ("c", "2", 2)], [("b", "late", 1), ("c", "same version", 2)], first):
        st.store_registry(spark, path, spark.createDataFrame(rows, columns), 3)
    got = sorted((r.video_name, r.video_url) for r in st.read_registry(spark, path).collect())
    assert got == [("a", "1"), ("b", "2"), ("c", "same version")]


def test_keys_hold_the_company(spark):
    chunks = spark.createDataFrame(
        [("a", "u", 0, "ta"), ("b", "u", 0, "tb"), ("b", "u", 1, "tb1")], "company_name string, video_url string, chunk_index int, text string"
    )
    found = spark.createDataFrame(
        [("a", "u", 0, [1.0]), ("b", "u", 0, [2.0])], "company_name string, video_url string, chunk_index int, embedding array<float>"
    )
    assert sorted((r.text, r.embedding) for r in mo.zip_embeddings(chunks, found).collect()) == [("ta", [1.0]), ("tb", [2.0])]
    assert [r.text for r in mo.missing_vectors(chunks, found).collect()] == ["tb1"]
    got = {r.company_name: (r.n_chunks, r.n_vectors, r.complete) for r in mo.count_check(chunks, found).collect()}
    assert got == {"a": (1, 1, True), "b": (2, 1, False)}


def test_registry(spark):
    left = spark.createDataFrame([("a.mp4", "1"), ("b.mp4", "2")], "video_name string, video_url string")
    right = spark.createDataFrame([("b.mp4", "3"), ("c.mp4", "4")], "video_name string, video_url string")
    assert sorted(map(tuple, st.merge_registry(left, right).collect())) == [
        ("a.mp4", "1"), ("b.mp4", "3"), ("c.mp4", "4"),
    ]
    files = spark.createDataFrame([("/x/y/b.mp4", "new")], "local_filename string, original_url string")
    rows = st.registry_rows(files, F.lit(2))
    merged = st.upsert_registry(left.withColumn("version", F.lit(1)), rows)
    assert sorted((r.video_name, r.video_url) for r in merged.collect()) == [("a.mp4", "1"), ("b.mp4", "new")]
    same = st.upsert_registry(left.withColumn("version", F.lit(2)), st.registry_rows(files, F.lit(2)).withColumn("video_url", F.lit("0")))
    assert ("b.mp4", "0") in {(r.video_name, r.video_url) for r in same.collect()}, "equal versions: the later write"


LOG = """YouTube Video URL: https://youtu.be/abc?si=1

Title: YouTube Video
Duration: Unknown
Language: en
Word Count: 4
Method: made_up

{}--- TRANSCRIPTION ---
[00:01] hello there
[00:03] Title: not a header
"""


def test_log_files(spark, tmp_path):
    plain, summed = LOG.format(""), LOG.format("--- VIDEO SUMMARY ---\nTwo\nlines\n\n")
    (tmp_path / "transcript_20250812_130152.txt").write_bytes(plain.replace("\n", "\r\n").encode())
    (tmp_path / "transcript_20250813_000000.txt").write_text(summed)
    rows = rd.scan_transcript_logs(spark, str(tmp_path)).orderBy("run_ts").collect()
    assert [str(r.run_ts) for r in rows] == ["2025-08-12 13:01:52", "2025-08-13 00:00:00"]
    for r, text in zip(rows, (plain.replace("\n", "\r\n"), summed)):
        assert (r.video_url, r.title, r.word_count, r.method) == (
            "https://youtu.be/abc?si=1", "YouTube Video", 4, "made_up",
        )
        assert r.transcription == text.split("--- TRANSCRIPTION ---")[1].lstrip("\r\n")
    assert [r.summary for r in rows] == ["", "Two\nlines"]


def test_logs_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [("u1", "T", "a\nb", "", "Unknown", "en", 2, "m"), ("u2", None, "c", "S", "9", "de", None, "m")],
        "video_url string, title string, transcription string, summary string, duration string, "
        "language string, word_count int, method string",
    )
    tr.write_transcript_logs(df, str(tmp_path / "logs"))
    got = {
        r.video_url: (r.title, r.transcription, r.summary, r.word_count)
        for r in rd.scan_transcript_logs(spark, str(tmp_path / "logs")).collect()
    }
    assert got == {"u1": ("T", "a\nb", "", 2), "u2": ("Unknown", "c", "S", None)}
    run = F.to_timestamp(F.lit("2025-08-12 13:01:52"))
    named = df.withColumn("file_name", tr.log_name(run, F.col("video_url")))
    tr.write_transcript_logs(named, str(tmp_path / "named"))
    back = {r.file_name: (str(r.run_ts), r.transcription) for r in rd.scan_transcript_logs(spark, str(tmp_path / "named")).collect()}
    assert back == {
        "u1_20250812_130152.txt": ("2025-08-12 13:01:52", "a\nb"),
        "u2_20250812_130152.txt": ("2025-08-12 13:01:52", "c"),
    }


def test_json_sources(spark, tmp_path):
    items = [{"text": " a ", "start": 1.0, "duration": 2.0}, {"text": " ", "start": 3.0}, {"text": "b"}]
    (tmp_path / "c.json").write_text(json.dumps({"video_url": "u", "items": items}))
    rows = rd.scan_caption_items(str(tmp_path / "c.json"), spark).orderBy("seg_idx").collect()
    assert [tuple(r) for r in rows] == [("u", 0, "a", 1.0, 3.0), ("u", 1, "b", 0.0, 0.0)]
    asr = {"video_url": "u", "text": "x", "segments": [{"text": "x", "start": 0, "end": 1.5}]}
    (tmp_path / "a.json").write_text(json.dumps(asr))
    assert tuple(rd.scan_asr_segments(str(tmp_path / "a.json"), spark).first()) == ("u", "en", 0, "x", 0.0, 1.5)


def test_transcript_choice(spark):
    requests = spark.createDataFrame([(f"https://youtu.be/{c}",) for c in "abc"] + [("https://x/d",)], "video_url string")
    model = spark.createDataFrame(
        [("https://youtu.be/a", "m", "T", "from model", "", "Unknown", "en", 2), ("https://youtu.be/b", "m", "T", " ", "", "", "en", 0)],
        "video_url string, method string, title string, transcription string, summary string, "
        "duration string, language string, word_count int",
    )
    texts = spark.createDataFrame(
        [("https://youtu.be/a", "cap a"), ("https://youtu.be/b", "cap b")], "video_url string, transcription string"
    )
    got = {r.video_url[-1]: (r.method, r.transcription) for r in tr.select_transcript(requests, model, texts).collect()}
    assert got["a"] == ("m", "from model") and got["b"] == (tr.CAPTIONS_METHOD, "cap b")
    assert got["c"][0] == tr.PLACEHOLDER_METHOD and got["c"][1].startswith("Video ID: c\n\nThis video")
    assert "d" not in got


def test_any_text_comes_back_from_log_files(spark, tmp_path):
    texts = ["one\x1e\ntwo", "\x1e", "\x1e.\x1e\n", "x\x1e", "", "a\n\x1e\n\x1eLog File: y\n", "\\x1e."]
    rows = [(f"u{i}", "T", "1", "en", 1, "m", t, t, f"v{i}_20250101_000000.txt") for i, t in enumerate(texts)]
    columns = "video_url string, title string, duration string, language string, word_count int, method string, summary string, transcription string, file_name string"
    tr.write_transcript_logs(spark.createDataFrame(rows, columns).coalesce(1), str(tmp_path / "logs"))
    got = {r.video_url: (r.transcription, r.file_name) for r in rd.scan_transcript_logs(spark, str(tmp_path / "logs")).collect()}
    assert got == {f"u{i}": (t, f"v{i}_20250101_000000.txt") for i, t in enumerate(texts)}
