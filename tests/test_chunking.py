import random

import pytest
from pyspark.sql import functions as F

import models
from talkmill.functions.timing import SEGMENTS_TYPE
from talkmill.operators import chunking as ch
from talkmill.operators.segment_rows import chunk_rows, chunk_rows_fixed, lead_start

ALPHABET = "ab é\n.!? 　x"


def texts():
    rng = random.Random(7)
    base = "x" * 2500
    fixed = ["", " " * 50, "a", "a" * 800, "a" * 801, "a" * 1000, "a" * 1001, "a" * 1800, base]
    # A sentence end on, just inside and just outside the lookback range.
    fixed += [base[:i] + "." + base[i + 1 :] for i in (899, 900, 901, 902, 999, 1000, 1001)]
    fixed += ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(1, 6000))) for _ in range(60)]
    return fixed


@pytest.mark.parametrize("size,overlap", [(1000, 200), (500, 50), (600, 200), (2000, 200)])
def test_windows_equal_brute_force(spark, size, overlap):
    values = texts()
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string").repartition(4)
    got = {r.i: [c.text for c in r.c] for r in df.select("i", ch.chunk_text("t", size, overlap).alias("c")).collect()}
    for i, t in enumerate(values):
        assert got[i] == models.windows(t, size, overlap), (i, len(t))


def test_window_limits_are_checked():
    with pytest.raises(ValueError):
        ch.chunk_text("t", 300, 202)


def random_videos(seed, n_videos, most):
    rng = random.Random(seed)
    videos = {}
    for v in range(n_videos):
        clock, segs = rng.choice([0.0, 0.0, -3.0, 5.0]), []
        for _ in range(rng.randrange(0, most)):
            text = rng.choice(["", " ", "a", "word", "two words", "x" * rng.randrange(1, 60)])
            start = rng.choice([clock, clock, clock, None, clock - 20, 0.0])
            end = rng.choice([clock + rng.random() * 9, None, clock - 1, clock + 40])
            segs.append((text, start, end))
            clock += rng.choice([0.0, 1.5, 4.0, 10.0, 30.0])
        videos[v] = segs
    return videos


def rows_of(spark, videos):
    rows = [(v, i, *s) for v, segs in videos.items() for i, s in enumerate(segs)]
    return spark.createDataFrame(
        rows, "video int, seg_idx int, text string, start double, end double"
    ).repartition(5)


def by_video(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.video, []).append((r.chunk_index, r.text, r.start, r.end))
    for v, chunks in out.items():
        chunks.sort()
        assert [c[0] for c in chunks] == list(range(len(chunks))), v
    return {v: [c[1:] for c in chunks] for v, chunks in out.items()}


def expected(videos, model):
    out = {v: model(segs) for v, segs in videos.items()}
    return {v: c for v, c in out.items() if c}


@pytest.mark.parametrize("size,cap,compat", [(20, 30, True), (40, 12, False), (120, 60, True)])
def test_blocks_equal_plain_fold(spark, size, cap, compat):
    """Videos far longer than a block, chained over two levels, equal the plain fold."""
    videos = random_videos(size, 25, 400)
    got = chunk_rows(
        rows_of(spark, videos), ["video"], size, cap, compat, block_rows=16, super_blocks=3
    )
    assert by_video(got) == expected(videos, lambda s: models.fold(s, size, cap, compat))


@pytest.mark.parametrize("duration,block", [(30.0, 8), (12.0, 16), (30.0, 4096)])
def test_fixed_blocks_equal_plain_fold(spark, duration, block):
    videos = random_videos(int(duration) + block, 25, 400)
    got = chunk_rows_fixed(
        rows_of(spark, videos), ["video"], duration, block_rows=block, super_blocks=3
    )
    assert by_video(got) == expected(videos, lambda s: models.fold_fixed(s, duration))


def test_array_form_equals_plain_fold(spark):
    videos = random_videos(3, 40, 80)
    df = spark.createDataFrame(list(videos.items()), f"video int, s {SEGMENTS_TYPE}")
    for chunks, model in [
        (ch.fold_segments("s", 60, 30), lambda s: models.fold(s, 60, 30)),
        (ch.fold_segments("s", 60, 30, False), lambda s: models.fold(s, 60, 30, False)),
        (ch.fold_segments_fixed("s"), lambda s: models.fold_fixed(s, 30)),
    ]:
        assert by_video(ch.explode_chunks(df, chunks, "video")) == expected(videos, model)


def test_one_segment_longer_than_a_chunk_and_zero_start(spark):
    segs = [("x" * 2000, 0.0, 5.0), ("a", 0.0, 500.0), ("b", 500.0, 501.0), ("c", 501.0, 502.0)]
    df = spark.createDataFrame([(1, segs)], f"video int, s {SEGMENTS_TYPE}")
    compat = by_video(ch.explode_chunks(df, ch.fold_segments("s"), "video"))[1]
    assert compat == [("x" * 2000, 0.0, 5.0), ("a b c", 0.0, 502.0)]
    strict = by_video(ch.explode_chunks(df, ch.fold_segments("s", zero_start_compat=False), "video"))[1]
    assert strict == [("x" * 2000, 0.0, 5.0), ("a", 0.0, 500.0), ("b c", 500.0, 502.0)]


def test_choice_of_chunker(spark):
    df = spark.createDataFrame(
        [(1, "[00:01] a", [("s", 0.0, 1.0)]), (2, "[00:01] a", []), (3, "plain", None)],
        f"video int, t string, s {SEGMENTS_TYPE}",
    )
    got = by_video(ch.explode_chunks(df, ch.choose_chunks("t", "s"), "video"))
    assert got == {1: [("s", 0.0, 1.0)], 2: [("a", 1.0, 4.0)], 3: [("plain", 0.0, 0.0)]}
    loom = by_video(ch.explode_chunks(df, ch.choose_chunks("t", "s", inline_timestamps=False), "video"))
    assert loom[2] == [("[00:01] a", 0.0, 0.0)]


def test_lead_over_block_borders(spark):
    df = spark.range(1000).select(
        (F.col("id") % 3).alias("video"), F.floor(F.col("id") / 3).alias("seg_idx"), (F.col("id") * 1.0).alias("start")
    )
    rows = lead_start(df, ["video"], block_rows=7).collect()
    assert len(rows) == 1000
    for r in rows:
        assert r.next_start == (r.start + 3 if r.start + 3 < 1000 else None)


def test_chunks_are_cut_once(spark):
    """No filter below the rows of chunks: it would cut every text for its test as well."""
    df = spark.createDataFrame([(1, "one two. three"), (2, ""), (3, None)], "i int, t string")
    chunked = df.withColumn("chunks", F.when(F.col("t") != "", ch.chunk_text("t")))
    out = ch.explode_chunks(chunked, F.col("chunks"), "i")
    assert [(r.i, r.chunk_index, r.text) for r in out.collect()] == [(1, 0, "one two. three")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
