import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from talkmill.operators import retrieval as rt

DIM = 8


def tables(spark, seed=1, n=300, m=40):
    rng = np.random.default_rng(seed)
    vecs = rng.integers(-2, 3, size=(n, DIM)).astype(float)
    vecs[::17] = 0.0  # no length: never a match
    vecs[5:25] = vecs[4]  # ties
    ns = ["big" if i % 3 else f"ns{i % 4}" for i in range(n)]
    rows = [(ns[i], f"id{i:03d}", [float(x) for x in vecs[i]], {"n": str(i)}) for i in range(n)]
    stored = spark.createDataFrame(
        rows, "namespace string, id string, embedding array<float>, metadata map<string,string>"
    ).select("namespace", "id", "embedding", F.struct(F.col("metadata")["n"].alias("n")).alias("metadata"))
    q = rng.integers(-2, 3, size=(m, DIM)).astype(float)
    q[3] = 0.0
    asked = [(j, ["big", "ns0", "ns1", "nowhere"][j % 4], [float(x) for x in q[j]]) for j in range(m)]
    questions = spark.createDataFrame(asked, "question_id long, namespace string, embedding array<float>")
    return stored.repartition(6), questions.repartition(3), rows, asked


def brute(rows, asked, k, scoped=True):
    out = []
    for j, ns, q in asked:
        scored = []
        for vns, vid, v, _ in rows:
            if scoped and vns != ns:
                continue
            d = np.linalg.norm(q) * np.linalg.norm(v)
            if d:
                scored.append((-round(float(np.dot(q, v) / d), 6) + 0.0, vid))
        out += [(j, i + 1, vid, -s + 0.0) for i, (s, vid) in enumerate(sorted(scored)[:k])]
    return sorted(out)


WAYS = {"one slice": {}, "slices": {"slice_bytes": DIM * 8 * 7}}


@pytest.mark.parametrize("way", WAYS)
@pytest.mark.parametrize("scope", ["namespace", "global"])
def test_best_matches_equal_brute_force(spark, way, scope):
    stored, questions, rows, asked = tables(spark)
    got = rt.similarity_topk(questions, stored, 6, ("metadata",), scope, DIM, 6, **WAYS[way]).collect()
    assert sorted((r.question_id, r["rank"], r.id, r.score + 0.0) for r in got) == brute(
        rows, asked, 6, scope == "namespace"
    )
    assert all(r.metadata.n == str(int(r.id[2:])) for r in got)


def test_a_task_holds_few_matches_beyond_those_it_keeps():
    """Vectors that come in rising order are all matches for a time: what waits stays in bounds."""
    from talkmill.operators.topk_kernel import BestMatches

    n, k = 2_000, 6
    best = BestMatches(pa.array(range(n)), np.tile([1.0, 0.0], (n, 1)), k)
    most = 0
    for block in range(60):
        angle = 1.5 - 0.02 * block - np.arange(k) * 0.001
        ids = pa.array(range(block * k, block * k + k))
        best.offer(np.stack([np.cos(angle), np.sin(angle)], axis=1), pa.table({"id": ids}))
        most = max(most, best.pending_rows)
    assert most <= n * k and best.result().num_rows == n * k
    assert set(best.result().column("id").to_pylist()) == set(range(59 * k, 60 * k))
    # A slice of the questions is held several times by every task of an executor.
    assert rt.SLICE_BYTES <= 16 << 20


@pytest.mark.parametrize("way", WAYS)
def test_both_sides_from_one_table(spark, way):
    stored, *_ = tables(spark)
    stored = stored.where("namespace = 'ns1'").cache()
    asked = stored.withColumnRenamed("id", "question_id")
    got = rt.similarity_topk(asked, stored, 1, dim=DIM, **WAYS[way]).collect()
    usable = stored.where(F.exists("embedding", lambda x: x != 0)).count()
    assert len(got) == usable and all(r.score == 1.0 for r in got)


def test_no_questions_and_no_vectors(spark):
    stored, questions, *_ = tables(spark)
    assert rt.similarity_topk(questions.limit(0), stored, 3, dim=DIM).count() == 0
    assert rt.similarity_topk(questions, stored.limit(0), 3, dim=DIM).count() == 0


def test_unscoped_filter_comes_after_the_rank(spark):
    stored = spark.createDataFrame(
        [("a", 1, [1.0, 0.0], "A"), ("a", 2, [1.0, 0.1], "A"), ("b", 3, [0.0, 1.0], "B"), ("c", 4, [1.0, 0.2], None)],
        "namespace string, id int, embedding array<float>, company string",
    )
    asked = spark.createDataFrame(
        [(1, "b", [1.0, 0.0], "B"), (2, "a", [1.0, 0.0], "a")],
        "question_id int, namespace string, embedding array<float>, company_name string",
    )
    got = rt.similarity_topk_unscoped(asked, stored, 2, dim=2).collect()
    # Question 1 finds nothing: its company's vector is not among the best two.
    assert sorted((r.question_id, r["rank"], r.id) for r in got) == [(2, 1, 1), (2, 2, 2)]


def test_plan_has_no_cross_join_and_scans_once(spark, tmp_path):
    stored, questions, *_ = tables(spark)
    path = str(tmp_path / "store")
    stored.write.partitionBy("namespace").parquet(path)
    found = rt.similarity_topk(questions, spark.read.parquet(path), 6, ("metadata",), dim=DIM)
    plan = found._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    physical = plan.split("== Physical Plan ==")[1]
    scans = [line for line in physical.splitlines() if "FileScan parquet" in line]
    read = [line.split("ReadSchema")[1] for line in scans]
    # The search reads no payload; it is joined to the winners (whose namespaces prune its scan).
    assert all(("embedding" in r) != ("metadata" in r) for r in read) and sum("metadata" in r for r in read) == 1
    assert "PartitionFilters: [namespace" in plan and "WindowGroupLimit" in plan


def test_winners_travel_to_the_stored_texts(spark, tmp_path):
    stored, questions, *_ = tables(spark)
    path = str(tmp_path / "store")
    stored.write.parquet(path)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        # As for texts of any size: no side of a join is sent unless it is asked for.
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = rt.similarity_topk(questions, spark.read.parquet(path), 6, ("metadata",), dim=DIM)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert found.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_other_lengths_are_told_and_do_no_harm(spark):
    stored = spark.createDataFrame(
        [("a", 1, [1.0, 0.0]), ("a", 2, [1.0, 0.0, 0.0]), ("a", 3, None), ("a", 4, [0.0, 1.0])],
        "namespace string, id int, embedding array<float>",
    )
    asked = spark.createDataFrame(
        [(1, "a", [1.0, 0.0]), (2, "a", [1.0, 0.0, 0.0]), (3, "a", None)],
        "question_id int, namespace string, embedding array<float>",
    )
    got = rt.similarity_topk(asked, stored, 2, dim=2).collect()
    assert sorted((r.question_id, r["rank"], r.id) for r in got) == [(1, 1, 1), (1, 2, 4)]
    told = {r.id: r.reason for r in rt.wrong_length(stored, 2).collect()}
    assert told == {2: "embedding has 3 components, not 2", 3: "no embedding"}
    assert {r.question_id for r in rt.wrong_length(asked, 2).collect()} == {2, 3}


def test_scores_closer_than_a_millionth_rank_exactly(spark):
    """The better vectors have the larger ids."""
    rows = [("a", i, [1.0, 1e-3 - i * 1e-6]) for i in range(50)]
    stored = spark.createDataFrame(rows, "namespace string, id int, embedding array<double>")
    asked = spark.createDataFrame([(1, "a", [1.0, 0.0])], "question_id int, namespace string, embedding array<double>")
    got = rt.similarity_topk(asked, stored, 3, dim=2).orderBy("rank").collect()
    assert [r.id for r in got] == [49, 48, 47] and got[0].score - got[2].score < 1e-6


def test_very_many_equal_vectors(spark):
    stored = spark.range(100_000).selectExpr(
        "'a' as namespace", "id", "array(1f, 2f, 3f) as embedding", "concat('text ', id) as text"
    )
    asked = spark.range(300).selectExpr("id as question_id", "'a' as namespace", "array(3f, 2f, 1f) as embedding")
    got = rt.similarity_topk(asked, stored, 4, ("text",), dim=3)
    assert got.count() == 1_200
    assert {(r["rank"], r.id, r.text) for r in got.select("rank", "id", "text").distinct().collect()} == {
        (i + 1, i, f"text {i}") for i in range(4)
    }


def test_kernel_keeps_k_rows_of_a_block_of_ties():
    from talkmill.operators.topk_kernel import BestMatches

    best = BestMatches(pa.array([1, 2]), np.ones((2, 4)), 3)
    best.offer(np.ones((4_096, 4)), pa.table({"id": np.arange(4_096)[::-1]}))
    assert best.pending_rows == 6
    assert best.result().column("id").to_pylist() == [0, 1, 2] * 2
