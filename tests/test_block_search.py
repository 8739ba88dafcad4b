"""Search over blocks against all pairs, and what it leaves unread."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_retrieval import DIM, brute, tables

from talkmill.operators import block_search as bs
from talkmill.operators import retrieval as rt


def blocks_of(spark, stored, tmp_path, dim=DIM, rows=16, **options):
    stored.write.parquet(str(tmp_path / "stored"))
    stored = spark.read.parquet(str(tmp_path / "stored"))
    bs.write_blocks(stored, str(tmp_path / "blocks"), dim, rows, **options)
    return bs.read_blocks(spark, str(tmp_path / "blocks"), stored.schema["id"].dataType.simpleString())


@pytest.mark.parametrize("options", [{}, {"pivot_bytes": 3 * DIM * 8}, {"pivot_bytes": 0}])
@pytest.mark.parametrize("scope", ["namespace", "global"])
def test_equals_all_pairs_on_random_vectors(spark, tmp_path, scope, options):
    stored, questions, rows, asked = tables(spark)
    blocks = blocks_of(spark, stored, tmp_path, **options)
    for size in (rt.SLICE_BYTES, DIM * 8 * 7):
        got = bs.search_blocks(questions, blocks, 6, scope, DIM, 6, size).collect()
        assert sorted((r.question_id, r["rank"], r.id, r.score + 0.0) for r in got) == brute(
            rows, asked, 6, scope == "namespace"
        )


def test_blocks_hold_every_vector_and_their_bounds(spark, tmp_path):
    stored, *_ = tables(spark)
    blocks = blocks_of(spark, stored, tmp_path).toPandas()
    usable = stored.where(F.exists("embedding", lambda x: x != 0)).toPandas()
    assert sorted(blocks["id"]) == sorted(usable["id"])
    for _, rows in blocks.groupby("block"):
        heads = rows[rows["radius"].notna()]
        assert len(heads) == 1 and len(rows) <= 16
        assert rows["namespace"].nunique() == 1 and rows["part"].nunique() == 1
        unit = np.stack(rows["embedding"]).astype(float)
        unit /= np.linalg.norm(unit, axis=1)[:, None]
        angles = np.arccos(np.clip(unit @ heads["centre"].iloc[0], -1, 1))
        assert angles.max() <= heads["radius"].iloc[0] + 1e-9


def clustered(spark, n=20_000, dim=16, groups=20):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(groups, dim))
    vectors = centres[np.arange(n) % groups] + rng.normal(size=(n, dim)) * 0.05
    rows = [("a", i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    stored = spark.createDataFrame(rows, "namespace string, id long, embedding array<float>")
    asked = [(j, "a", [float(x) for x in vectors[j]]) for j in range(30) if j % groups < 3]
    questions = spark.createDataFrame(asked, "question_id long, namespace string, embedding array<float>")
    return stored.repartition(8), questions


def test_parts_that_cannot_hold_a_match_stay_unread(spark, tmp_path, monkeypatch):
    stored, questions = clustered(spark)
    blocks = blocks_of(spark, stored, tmp_path, 16, 256)
    read = []
    scorer = bs._scorer
    monkeypatch.setattr(bs, "_scorer", lambda *a, **k: read.append(a[0].value) or scorer(*a, **k))
    got = bs.search_blocks(questions, blocks, 5, dim=16, digits=6)
    expected = rt.similarity_topk(questions, stored, 5, dim=16, digits=6)
    key = ["question_id", "rank", "id", "score"]
    assert sorted(got.select(*key).collect()) == sorted(expected.select(*key).collect())
    # The floors decide which parts are opened: a scan of these names the folders it opens.
    asked = read[-1]
    shipped = spark.sparkContext.broadcast(asked)
    heads = blocks.where("radius is not null").select("namespace", "part", "block", "centre", "radius")
    still = {r["part"] for r in heads.mapInArrow(bs._open_parts(shipped, 16, 6), "part int").collect()}
    parts = {r["part"] for r in heads.select("part").distinct().collect()}
    assert len(parts) > 40 and len(still) < len(parts) / 3
    plan = blocks.where(F.col("part").isin(sorted(still)))._jdf.queryExecution().toString()
    assert "PartitionFilters: [part" in plan


def test_floors_keep_rows_in_the_tasks(spark, tmp_path, monkeypatch):
    """Rows that leave the tasks, against a scan in which each task sends its own best k."""
    stored, questions = clustered(spark)
    blocks = blocks_of(spark, stored, tmp_path, 16, 256).repartition(64, "part", "block").sortWithinPartitions(
        "block", F.col("radius").isNull()
    )
    sent = []
    limit = rt.topk_per_question
    for module in (rt, bs):
        monkeypatch.setattr(module, "topk_per_question", lambda df, k: sent.append(df.count()) or limit(df, k))
    bs.search_blocks(questions, blocks, 5, "global", 16, 6).count()
    with_floor, sent[:] = sum(sent), []
    rt.similarity_topk(questions, blocks.select("namespace", "id", "embedding"), 5, (), "global", 16, 6).count()
    assert with_floor * 3 < sum(sent)


def test_empty_sides_and_rows_that_match_nothing(spark, tmp_path):
    odd = spark.createDataFrame(
        [("a", 1, [1.0, 0.0]), ("a", 2, [0.0, 0.0]), ("a", 3, None), ("a", 4, [1.0]), (None, 5, [1.0, 0.0]), ("", 6, [0.0, 1.0])],
        "namespace string, id long, embedding array<float>",
    )
    asked = spark.createDataFrame(
        [(1, "a", [1.0, 0.0]), (2, "a", [0.0, 0.0]), (3, "a", None), (4, None, [1.0, 0.0]), (5, "", [0.0, 2.0])],
        "question_id long, namespace string, embedding array<float>",
    )
    blocks = blocks_of(spark, odd, tmp_path, 2)
    found = bs.search_blocks(asked, blocks, 3, dim=2).collect()
    assert sorted((r.question_id, r["rank"], r.namespace, r.id, r.score) for r in found) == [
        (1, 1, "a", 1, 1.0), (5, 1, "", 6, 1.0),
    ]
    assert bs.search_blocks(asked.limit(0), blocks, 3, dim=2).count() == 0
    none = blocks_of(spark, odd.limit(0), tmp_path / "none", 2)
    assert bs.search_blocks(asked, none, 3, dim=2).count() == 0


@pytest.mark.parametrize("scope", ["namespace", "global"])
def test_questions_find_the_same_with_blocks(spark, tmp_path, scope):
    from talkmill.operators.model import embed, hashing_embedder
    from talkmill.plans.questions import retrieve

    texts = [(f"Co{i % 3}", i, " ".join(f"w{(i * j) % 7}" for j in range(1, 5))) for i in range(60)]
    chunks = spark.createDataFrame(texts, "company string, id long, text string")
    stored = embed(chunks, "text", hashing_embedder(8), 8).select(
        F.lower("company").alias("namespace"), "id", "embedding", F.struct("company", "text").alias("metadata")
    )
    blocks = blocks_of(spark, stored, tmp_path, 8, 4)
    vectors = spark.read.parquet(str(tmp_path / "stored"))
    asked = spark.createDataFrame(
        [(i, f"Co{i % 4}", f"w{i} w{i + 1}") for i in range(8)], "question_id long, company_name string, question string"
    )
    ways = [retrieve(asked, vectors, hashing_embedder(8), 8, 3, scope, 6, b) for b in (None, blocks)]
    columns = ["question_id", "rank", "id", "score", "metadata"]
    plain, by_blocks = (sorted(map(str, df.select(*columns).collect())) for df in ways)
    assert plain == by_blocks and plain
