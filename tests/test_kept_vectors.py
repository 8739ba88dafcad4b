"""Vectors kept by text: what reaches the model, counted through a folder of call files."""

import uuid

import pytest
from pyspark.sql import functions as F
from test_plans import EXPECTED, outcome, run

from talkmill.operators import kept_vectors as kv
from talkmill.operators import model as mo


def counting(folder, dim=4, refuses=()):
    """A hashing embedder that leaves a file with its texts for every call."""
    folder.mkdir(exist_ok=True)
    where = str(folder)

    def factory():
        inner = mo.hashing_embedder(dim)()

        def reply(texts):
            with open(f"{where}/{uuid.uuid4().hex}", "w") as out:
                out.write("\n".join(texts))
            if any(t in refuses for t in texts):
                raise ValueError("no")
            return inner(texts)

        return reply

    return factory


def calls(folder):
    return sorted(sorted(f.read_text().split("\n")) for f in folder.iterdir())


def rows(df):
    return sorted((r.i, r.t, r.embedding and list(r.embedding), r.is_zero, r.embed_error) for r in df.collect())


def test_only_new_texts_reach_the_model_and_equal_ones_once(spark, tmp_path):
    path, log = str(tmp_path / "kept"), tmp_path / "log"
    first = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None), (4, "c"), (5, "")], "i int, t string").repartition(3)
    more = first.union(spark.createDataFrame([(6, "new"), (7, "c")], "i int, t string"))
    got = kv.embed_kept(first, "t", counting(log), path, 4)
    assert sorted(t for c in calls(log) for t in c) == ["", "a b", "c"]
    assert rows(got) == rows(mo.embed(first, "t", mo.hashing_embedder(4), 4))
    again, later = tmp_path / "again", tmp_path / "later"
    assert rows(kv.embed_kept(first, "t", counting(again), path, 4)) == rows(got)
    assert calls(again) == []
    got = kv.embed_kept(more, "t", counting(later), path, 4)
    assert calls(later) == [["new"]]
    assert rows(got) == rows(mo.embed(more, "t", mo.hashing_embedder(4), 4))
    kv.compact_kept(spark, path)
    table = kv.kept_table(spark, path)
    assert table.rows().count() == 4 and table.manifest().count() == 1
    assert rows(kv.embed_kept(more, "t", counting(again), path, 4)) == rows(got) and calls(again) == []


def test_a_failed_text_is_asked_again(spark, tmp_path):
    path = str(tmp_path / "kept")
    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "bad")], "i int, t string").coalesce(1)
    got = rows(kv.embed_kept(df, "t", counting(tmp_path / "x", refuses=("bad",)), path, 4))
    assert [(g[0], g[3], g[4]) for g in got] == [(1, False, None), (2, True, "ValueError: no"), (3, True, "ValueError: no")]
    assert got[1][2] == [0.0] * 4
    got = rows(kv.embed_kept(df, "t", counting(tmp_path / "y"), path, 4))
    assert calls(tmp_path / "y") == [["bad"]] and not any(g[3] for g in got)


def test_two_writers_keep_a_text_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "kept")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "i int, t string")
    commit, raced = kv.StoredTable.commit, []

    def late(self, head, *rest, **notes):
        if not raced:
            raced.append(1)
            kv.embed_kept(df.where("i = 1"), "t", mo.hashing_embedder(4), path, 4)
        return commit(self, head, *rest, **notes)

    monkeypatch.setattr(kv.StoredTable, "commit", late)
    assert len(rows(kv.embed_kept(df, "t", mo.hashing_embedder(4), path, 4))) == 2
    assert kv.kept_table(spark, path).rows().count() == 2


def test_a_folder_holds_vectors_of_one_model(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "i int, t string")
    kv.embed_kept(df, "t", mo.hashing_embedder(4), str(tmp_path / "k"), 4)
    for dim, name in ((8, ""), (4, "other")):
        with pytest.raises(ValueError, match="keeps vectors"):
            kv.embed_kept(df, "t", mo.hashing_embedder(dim), str(tmp_path / "k"), dim, model=name)
    nothing = kv.embed_kept(df.limit(0), "t", mo.hashing_embedder(4), str(tmp_path / "empty"), 4)
    assert nothing.count() == 0


def test_calls_are_filled_across_arrow_batches(spark, tmp_path):
    df = spark.range(25).select("id", F.when(F.col("id") % 5 != 1, F.col("id").cast("string")).alias("t")).coalesce(1)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    try:
        out = mo.batch_model(df, "t", "r", counting(tmp_path / "log"), "array<float>", 8).collect()
    finally:
        spark.conf.set(key, before)
    assert sorted(len(c) for c in calls(tmp_path / "log")) == [4, 8, 8]
    assert [r.id for r in out] == list(range(25)) and [r.id for r in out if r.r is None] == [1, 6, 11, 16, 21]


def test_a_second_ingest_calls_no_model(spark, tmp_path, monkeypatch):
    kept = str(tmp_path / "kept")
    monkeypatch.setattr("test_plans.hashing_embedder", lambda dim: counting(tmp_path / "first", dim))
    assert outcome(run(spark, kept=kept).report) == EXPECTED
    # Two companies hold the same video: its texts are asked about once.
    asked = [t for c in calls(tmp_path / "first") for t in c]
    assert len(asked) == len(set(asked)) == 3
    monkeypatch.setattr("test_plans.hashing_embedder", lambda dim: counting(tmp_path / "second", dim))
    out = run(spark, kept=kept, version=2)
    assert outcome(out.report) == EXPECTED and out.vectors.count() == 5
    assert calls(tmp_path / "second") == []
