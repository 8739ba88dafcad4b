"""Mixing against a numeric solution, and the pipeline against its stages' plain versions."""

import math
import random

import pytest

import corpus_pipeline
import words
from pyspark.sql import functions as F
from talkmill.llm import mixing
from test_counts_and_files import expected_file
from test_duplicates_and_leaks import plain_fingerprint, plain_groups, plain_overlaps


def plain_targets(sizes, cap=3):
    """``source -> target``; sources in code-point order, null last."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        full = {s for s in free if left * weight[s] / total > cap * sizes[s]}
        if not full:
            return target | {s: left * weight[s] / total for s in free}
        for s in full:
            target[s] = float(cap * sizes[s])
            left -= target[s]
        free -= full
    return target


def plain_rates(docs, target, cap=3):
    """Rate of each size, by bisection on the multiplier."""
    scale = sum(docs) / len(docs)
    words_at = lambda m: sum(s * min(cap, math.exp(min(5, m * s / scale))) for s in docs)
    low, high = -1e7, 1e7
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if words_at(mid) < target else (low, mid)
    return lambda s: min(cap, math.exp(min(5, low * s / scale)))


def size(text):
    return len((text or "").split())  # the test texts hold ASCII white space only


def sourced(seed=1, n=900):
    r = random.Random(seed)
    vocabulary = words.vocabulary(2)
    source = lambda: r.choices(["a", "b", "B", "é", "tiny", None], [10, 3, 3, 2, 0.1, 2])[0]
    rows = [(i, words.text(r, vocabulary, int(r.lognormvariate(3, 1))), "en", source()) for i in range(n)]
    return [*rows, (n, "one", "en", "tiny"), (n + 1, "", "en", "none at all"), (n + 2, None, "en", None)]


def test_mix_meets_the_contract(spark):
    rows = sourced()
    docs = words.clashing(words.frame(spark, rows))
    got = {r["doc_id"]: r for r in mixing.taken(docs).collect()}
    by_source = {}
    for key, text, _, source in rows:
        by_source.setdefault(source, []).append((key, size(text)))
    targets = plain_targets({s: sum(n for _, n in own) for s, own in by_source.items()})
    assert math.isclose(sum(targets.values()), sum(size(t) for _, t, *_ in rows))
    for source, own in by_source.items():
        total = sum(n for _, n in own)
        for key, n in own:
            r = got[key]
            assert r["size"] == n and r["source_size"] == total
            assert r["target"] == pytest.approx(targets[source])
            assert r["taken"] % max(n, 1) == 0 and 0 <= r["taken"] <= 3 * n
        near = max((n for _, n in own), default=0)
        assert abs(sum(got[key]["taken"] for key, _ in own) - targets[source]) <= near + 1e-6
    again = {r["doc_id"]: r for r in mixing.taken(docs.repartition(7)).collect()}
    assert again == got


def test_rates_solve_the_dual(spark):
    rows = sourced(2)
    got = {r["doc_id"]: r for r in mixing.taken(words.frame(spark, rows)).collect()}
    for source in ("a", "b", "B", "é", None):
        own = [(k, size(t)) for k, t, _, s in rows if s == source]
        sizes = [n for _, n in own if n]
        target = got[own[0][0]]["target"]
        if target >= 3 * sum(sizes):
            assert all(got[k]["rate"] == 3 for k, n in own if n)
            continue
        # the multiplier is per mean size of all the source's documents; rates don't depend on it
        rate = plain_rates(sizes, target)
        for k, n in own:
            if n:
                assert got[k]["rate"] == pytest.approx(rate(n), abs=2e-5)


def test_mixed_rows_are_the_copies(spark):
    rows = sourced(3, 300)
    docs = words.clashing(words.frame(spark, rows))
    taken = {r["doc_id"]: r["taken"] for r in mixing.taken(docs).collect()}
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    counts = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert counts == {k: taken[k] // size(t) for k, t, *_ in rows if size(t) and taken[k]}


def test_mix_of_hostile_rows(spark):
    docs = words.clashing(words.frame(spark, words.hostile_rows()))
    got = mixing.taken(docs).collect()
    assert len(got) == len(words.hostile_rows())
    assert mixing.taken(words.frame(spark, [])).collect() == []
    blank = words.frame(spark, [(1, "", "en", "a"), (2, None, "en", None)])
    assert {(r["target"], r["taken"]) for r in mixing.taken(blank).collect()} == {(0.0, 0)}
    assert mixing.mixed(blank).collect() == []


def test_sizes_are_ascii_words(spark):
    texts = ["a b", "a\u00a0b", "\x0b\x0c a\r\n\tb ", "\x1c", "", None, "\x85 x"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in frame.select(mixing.size_of(F.col("text"))).collect()] == [2, 1, 2, 1, 0, 0, 2]


def test_share_out_of_many_sources(spark):
    r = random.Random(5)
    sizes = {f"s{i:03}": r.choice([0, 1, 5, 50, 5_000]) for i in range(100)}
    rows = [(f"0{s}", n) for s, n in sizes.items()]
    frame = mixing.ranked(spark.createDataFrame(rows, "key string, source_size long").repartition(6))
    got = mixing.share_out(frame.withColumn("weight", F.col("place") % 3 + 1))
    assert {r["key"][1:]: r["target"] for r in got.collect()} == pytest.approx(plain_targets(sizes))


def test_stages_are_as_stated():
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == [
        "drop_toxic", "drop_near_duplicates", "drop_benchmark_leaks", "mix_sources", "write_token_files"
    ]


def test_pipeline_stage_by_stage(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    read = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    docs, items = read("documents"), [tuple(r) for r in read("benchmark").select("item_id", "text").collect()]
    columns = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    rows = lambda df: [tuple(r) for r in df.select("doc_id", "text").collect()]
    one = stage["toxicity"](spark, docs, sf)
    assert one.columns == columns and 0 < one.count() <= docs.count()
    two = stage["simhash_dedup"](spark, docs, sf)
    groups = plain_groups(rows(docs))
    assert two.columns == columns
    assert sorted(k for k, _ in rows(two)) == sorted({g for *_, g in groups})
    assert all(f"{plain_fingerprint(t):016x}" for _, t in rows(two))
    three = stage["decontamination"](spark, docs, sf)
    bad = {d for d, _ in plain_overlaps(rows(docs), items)}
    assert three.columns == columns and {k for k, _ in rows(three)} == {k for k, _ in rows(docs)} - bad
    four = stage["mixing"](spark, docs, sf)
    assert four.columns == columns
    taken = sum(r["taken"] for r in mixing.taken(docs).collect())
    assert sum(size(t) for _, t in rows(four)) == taken
    five = stage["token_files"](spark, three, sf)
    assert sorted(tuple(r) for r in five.collect()) == expected_file(sorted(rows(three)))


def test_pipeline_runs_whole(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    rows = got.orderBy("start").collect()
    assert rows[0]["start"] == 0
    for a, b in zip(rows, rows[1:]):
        assert b["start"] == a["start"] + a["n_tokens"] and b["doc_id"] >= a["doc_id"]
