"""Importance resampling against a plain statement of the same rules."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import words
from talkmill.llm import resampling
from talkmill.llm.common import numbered

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_features(text):
    own = WORD.findall((text or "").translate(LOWER))
    runs = [" ".join(own[i : i + n]) for n in (1, 2, 3) for i in range(len(own) - n + 1)]
    return len(own), [zlib.crc32(r.encode()) % 10_000 for r in runs]


def plain(rows, target, percent=5, least=20):
    """``doc_id, n_features, weight, score, rank`` of each row, by loops over Python objects."""
    own = [(i, *plain_features(t)) for i, t, *_ in rows]
    s, t = Counter(), Counter()
    for _, _, found in own:
        s.update(found)
    for text in target:
        t.update(plain_features(text)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    out = []
    for key, n, found in own:
        gain = sum(
            math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b in found
        )
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = gain + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([key, len(found), gain, score, None, n])
    pool = sorted(
        (r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2])
    )
    for rank, row in enumerate(pool[: percent * len(pool) // 100], 1):
        row[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=repr)


def got(docs, target, **options):
    rows = resampling.resample(docs, target, **options)
    return sorted((tuple(r) for r in rows.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def many_rows(n=600):
    r = random.Random(3)
    vocabulary = words.vocabulary(5) + ["Über", "x9", "漢字", "é"]
    rows = [(i, words.text(r, vocabulary, r.randint(0, 60)) + r.choice(["", ", A-b!", "\n_1"]), "en", "a") for i in range(n)]
    return rows + [(7_000, "one text that many rows share " * 5, "en", "b")] * (n // 3) + words.hostile_rows()


def test_draw_is_the_plain_rules(spark):
    rows = many_rows()
    target = [words.text(random.Random(k), words.vocabulary(5)[:40], 30) for k in range(20)] + [None, ""]
    docs = words.clashing(words.frame(spark, rows)).repartition(7)
    wanted = spark.createDataFrame([(t, 1) for t in target], "text string, score int")
    assert got(docs, wanted) == plain(rows, target)


@pytest.mark.parametrize("percent", [0, 50, 100])
def test_shares_and_ties(spark, percent):
    rows = many_rows(90)
    docs = words.frame(spark, rows)
    assert got(docs, docs.select("text").limit(0), percent=percent) == plain(rows, [], percent)


def test_empty_tables(spark):
    docs = words.frame(spark, [])
    assert got(docs, docs.select("text")) == []
    rows = [(1, "word " * 30, "en", "a"), (2, None, "en", "a")]
    assert got(words.frame(spark, rows), docs.select("text")) == plain(rows, [])


def test_joined_crc_of_any_lengths():
    r = random.Random(1)
    heads = [r.randbytes(r.randint(0, 9)) for _ in range(200)]
    tails = [r.randbytes(r.choice([0, 1, 5, 64, 65, 128, 700])) for _ in range(200)]
    found = resampling.joined_crc(
        np.array([zlib.crc32(h) for h in heads], np.uint32),
        np.array([zlib.crc32(t) for t in tails], np.uint32),
        np.array([len(t) for t in tails], np.int64),
    )
    assert found.tolist() == [zlib.crc32(h + t) for h, t in zip(heads, tails)]


@pytest.mark.parametrize("accuracy", [10, 200])
def test_cutoff_narrows_and_widens(spark, accuracy):
    r = random.Random(accuracy)
    values = [int(r.gauss(0, 1) * 1000) for _ in range(4_000)] + [77] * 2_000
    scores = spark.createDataFrame([(v,) for v in values], "score long")
    order = sorted(values, reverse=True)
    for k in (1, 30, 2_400, 4_000, 6_000):
        assert resampling.cutoff(scores, k, len(values), accuracy, rows=50) == order[k - 1]


def test_cutoff_when_the_sketch_is_wrong(spark, monkeypatch):
    from pyspark.sql import functions as F

    scores = spark.range(1_000).select(F.col("id").alias("score"))
    misled = lambda column, shares, accuracy: F.array(F.lit(3), F.lit(4)).cast("array<long>")
    real = F.percentile_approx
    calls = []

    def first_wrong(*args):
        calls.append(args)
        return F.max(misled(*args)) if len(calls) < 3 else real(*args)

    monkeypatch.setattr(resampling.F, "percentile_approx", first_wrong)
    assert resampling.cutoff(scores, 100, 1_000, 100, rows=50) == 900
    assert len(calls) >= 3


def test_full_caches_change_nothing(spark, monkeypatch):
    texts = [t.encode() for t in ("a b c d", "b c d e f", "", "g")]
    before = [x.tolist() for x in resampling.word_runs(texts)[2]]
    monkeypatch.setattr(resampling, "KEPT_WORDS", 2)
    assert [x.tolist() for x in resampling.word_runs(texts)[2]] == before


def test_numbers_span_ranges(spark):
    from pyspark.sql import functions as F

    rows = spark.range(5_000).select((F.col("id") * 7919 % 5_000).alias("v"), F.lit("x").alias("w"))
    found = numbered(rows, F.desc("v")).collect()
    assert sorted((r["number"], r["v"]) for r in found) == [(i + 1, 4_999 - i) for i in range(5_000)]
