"""Importance resampling towards a target distribution, over hashed word runs.

Every document is a bag of runs of 1 to 3 words, hashed into buckets. A bucket's gain says how
much more frequent it is in the target than in the corpus; a document's weight is the sum of
its runs' gains, read off the gain array. Weights plus Gumbel noise (a hash of the id, so that
reruns agree) are the scores, and the highest scores are the draw: sampling without
replacement with probabilities in proportion to the exponentiated weights.

The lowest drawn score is found without sorting the corpus: a quantile sketch proposes a bracket
of scores, exact counts above and inside say whether it holds the cutoff (if not, the bracket is
widened), and only the bracket's scores are sorted. Drawn rows alone are then ranked, in ranges.

A run's CRC comes from its words' CRCs: appending text of n bytes is a linear map of the CRC,
so runs are hashed as arrays, and only words that a worker has not met are hashed as bytes.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.llm.common import numbered, saved, slices, small, worker_value

BUCKETS = 10_000
RUN = 3
#: Different words whose CRCs a worker keeps, in about 80 MB.
KEPT_WORDS = 500_000
#: Relative rank error of the quantile sketch is 1 / ACCURACY.
ACCURACY = 10_000
#: A bracket of more rows is narrowed by a sketch of its own before it is sorted.
BRACKET_ROWS = 200_000

#: Lower-cases A-Z; all other ASCII but letters and digits is a blank. Other bytes are letters.
LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)


def _shift_tables(most: int = 64) -> np.ndarray:
    """``[n * 1024 + 256 * k + v]``: the CRC map of n more bytes, for value v of the k-th byte."""
    base = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    values = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).reshape(-1)
    rows = [values]
    for _ in range(most):
        values = values >> np.uint32(8) ^ base[values & np.uint32(255)]
        rows.append(values)
    return np.concatenate(rows)


SHIFTS, LONGEST = _shift_tables(), 64


def joined_crc(head: np.ndarray, tail: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of texts put together, from their CRCs and the second ones' lengths in bytes."""
    step = np.minimum(size, LONGEST)
    at = step << 10
    out = SHIFTS[at + (head & 255)]
    for k in (1, 2, 3):
        out = out ^ SHIFTS[at + ((head >> np.uint32(8 * k)) & 255) + 256 * k]
    rest = np.flatnonzero(size > LONGEST)
    if len(rest):
        out[rest] = joined_crc(out[rest], np.zeros(len(rest), np.uint32), size[rest] - LONGEST)
    return out ^ tail


class Words(dict):
    """Place of each word; the CRC of the word, and of a blank and the word, stand in arrays."""

    def __init__(self) -> None:
        self.plain, self.spaced, self.size = array("I"), array("I"), array("q")

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self.size)
        self.plain.append(zlib.crc32(word))
        self.spaced.append(zlib.crc32(b" " + word))
        self.size.append(len(word) + 1)
        return place


def word_runs(texts: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Words of each text, where each text's words end, and for runs of 1, 2 and 3 words the
    bucket of the run that begins at each word (-1 where the text has no such run)."""
    words = worker_value("resampling words", Words, large=True)
    if len(words) > KEPT_WORDS:
        words.clear()
        words.__init__()
    own = [t.translate(LETTERS).split() for t in texts]
    n = np.array([len(w) for w in own], np.int64)
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    place = np.fromiter((words[w] for text in own for w in text), np.int64, total)
    plain, spaced, size = np.array(words.plain), np.array(words.spaced), np.array(words.size)
    left = np.repeat(ends, n) - np.arange(total)
    found = []
    crc = plain[place] if total else np.zeros(0, np.uint32)
    for more in range(RUN):
        if more:
            at = np.flatnonzero(left > more)
            nxt = place[at + more]
            run = np.zeros(total, np.uint32)
            run[at] = joined_crc(crc[at], spaced[nxt], size[nxt])
            crc = run
        bucket = (crc % buckets).astype(np.int64)
        bucket[left <= more] = -1
        found.append(bucket)
    return n, ends, found


def _batches(batches, column: int):
    """``batch, texts`` for few texts at a time; null is an empty text."""
    for batch in small(batches):
        texts = [t or b"" for t in batch.column(column).cast(pa.large_binary()).to_pylist()]
        for a, b in slices([len(t) for t in texts]):
            yield batch.slice(a, b - a), texts[a:b]


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many runs of all whole texts fall in each bucket. A task sends ``buckets`` sums."""

    def run(batches):
        sums = np.zeros(buckets, np.int64)
        for _, part in _batches(batches, 0):
            for found in word_runs(part, buckets)[2]:
                sums += np.bincount(found[found >= 0], minlength=buckets)
        held = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(sums[held])], names=["bucket", "n"])

    rows = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in rows.collect():  # ``buckets`` rows at most
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(...)) of the smoothed frequency ratio of each bucket."""
    k, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log(float(t + 1) * float(s_all + k) / (float(s + 1) * float(t_all + k))))
            for s, t in zip(corpus.tolist(), target.tolist())
        ],
        np.int64,
    )


def noise(doc_id, seed: int) -> int:
    """floor of 1000 times a Gumbel variate, from the id's hash (a null id: the empty text)."""
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int = 42) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, part, place`` of every row of ``docs``; the
    last two number the rows. ``gain`` is an array of one number a bucket."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch, texts in _batches(batches, 1):
            n, ends, found = word_runs(texts, len(gain))
            each = sum((np.where(b >= 0, gain[b], 0) for b in found), np.zeros(len(found[0]), np.int64))
            run_sum = np.concatenate([[0], np.cumsum(each)])
            weight = run_sum[ends] - run_sum[ends - n]
            features = sum(np.maximum(n - k, 0) for k in range(RUN))
            extra = np.array([noise(i, seed) for i in batch.column(0).to_pylist()], np.int64)
            m = len(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(n), pa.array(features), pa.array(weight), pa.array(weight + extra),
                    pa.array(np.full(m, part, np.int32)), pa.array(np.arange(at, at + m)),
                ],
                names=["doc_id", "n_words", "n_features", "weight", "score", "part", "place"],
            )
            at += m

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_words long, n_features long, weight long, score long, part int, place long"
    )


def cutoff(scores: DataFrame, k: int, n: int, accuracy: int = ACCURACY, rows: int = BRACKET_ROWS) -> int:
    """The k-th highest ``score`` (long, no nulls) of ``n`` rows, 1 <= k <= n."""
    low = high = None
    above, inside, wanted = 0, n, k
    while True:
        held = scores if low is None else scores.where(F.col("score").between(low, high))
        if inside <= rows or (low is not None and low == high):
            break
        slack = 2.0 / accuracy
        while True:
            at = 1 - wanted / inside
            if slack < 1:
                shares = [max(at - slack, 0.0), min(at + slack, 1.0)]
                sketch = F.percentile_approx("score", shares, accuracy)
                new_low, new_high = held.agg(sketch.alias("b")).first()["b"]
            else:
                new_low, new_high = held.agg(F.min("score"), F.max("score")).first()
            over, within = held.agg(
                F.count_if(F.col("score") > new_high), F.count_if(F.col("score").between(new_low, new_high))
            ).first()
            if over < wanted <= over + within:
                break
            slack *= 4  # the exact counts disagree with the sketch
        narrower = (new_low, new_high) != (low, high)
        low, high, above, inside = new_low, new_high, above + over, within
        wanted = k - above
        if not narrower:
            held = scores.where(F.col("score").between(low, high))
            break
    # At most ``rows`` scores, or those that no sketch tells apart, counted once each.
    for row in held.groupBy("score").count().orderBy(F.desc("score")).toLocalIterator():
        wanted -= row["count"]
        if wanted <= 0:
            return row["score"]
    raise ValueError("fewer rows than were counted before")


def resample(
    docs: DataFrame,
    target: DataFrame,
    *,
    percent: int = 5,
    least_words: int = 20,
    buckets: int = BUCKETS,
    seed: int = 42,
    eligible: Column | None = None,
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every row of ``docs`` (with
    ``doc_id, text``): of the rows with ``least_words`` words or more, the ``percent`` of a
    hundred (rounded down) with the highest scores get ranks from 1, all others a null rank. Ties
    go to the smaller doc_id (null last), then to the one with fewer features; rows equal in all
    of that are drawn in an arbitrary but fixed order. Repeated rows take part each. Null texts
    have no features and weight 0; an empty target leaves the weights to the corpus alone; an
    empty ``docs`` gives an empty result."""
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    every = saved(scored(docs, gain, seed), "resampling-scores")
    may = F.col("n_words") >= least_words
    if eligible is not None:
        may = may & eligible
    pool = every.where(may)
    n = pool.count()
    k = percent * n // 100
    names = ["doc_id", "n_words", "n_features", "weight", "score"]
    nothing = F.lit(None).cast("long").alias("rank")
    if not k:
        return every.select(*names, nothing)
    top = may & (F.col("score") >= cutoff(pool.select("score"), k, n))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight"), F.asc("part"), F.asc("place")]
    ranked = numbered(every.where(top), *order)
    rank = F.when(F.col("number") <= k, F.col("number")).alias("rank")
    return every.where(~top).select(*names, nothing).unionByName(ranked.select(*names, rank))


def drawn(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The documents that ``resample`` draws, all columns, one for each drawn row's doc_id."""
    chosen = resample(docs, target, **options).where(F.col("rank").isNotNull()).select("doc_id").distinct()
    return docs.join(chosen, "doc_id", "left_semi")
