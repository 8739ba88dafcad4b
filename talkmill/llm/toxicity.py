"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic text. A text is cut
into overlapping windows; each window is compressed with both, and the bytes that the toxic
dictionary saves over the ordinary one are the window's gain. A text's score is a calibrated
function of its gains.

Training reads a bounded sample of labelled rows (``max_toxic`` and ``max_ordinary`` texts,
those with the smallest id hashes). The ordinary dictionary is what zstandard's trainer makes
of ordinary windows. The toxic one holds that same base, so that chance matches cost equally
in both, plus the segments that toxic texts repeat and ordinary texts hardly contain. Gram
counts, segments and gains are computed by Spark tasks; the driver sees only the chosen
segments, a bounded set of windows and one line of figures per sampled text.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.llm.common import remainder, saved, ship, small

WINDOW, STEP = 40, 28
GRAM = 5
BASE_BYTES, EXTRA_BYTES = 4_000, 12_000
BASE_WINDOWS = 20_000
#: A gram is toxic if it is this many times as frequent in toxic texts as in ordinary ones.
RATIO = 40
SUPPORT = 0.01
GAINS = 3


@dataclass
class Model:
    """Two dictionaries of at most 16 kB each, and the calibration; it travels with the tasks."""

    ordinary: bytes
    toxic: bytes
    weights: np.ndarray
    shift: float


def normal(text: bytes) -> bytes:
    """ASCII letters lower-cased, white space as single blanks, one blank at each end."""
    return b" " + b" ".join(text.lower().split()) + b" "


def windows(text: bytes, size: int = WINDOW, step: int = STEP) -> list[bytes]:
    """Windows over the whole normalised text; the last one may be shorter."""
    return [text[i : i + size] for i in range(0, max(1, len(text) - size + step), step)]


def compressor(content: bytes):
    """Length of a window compressed with ``content`` as dictionary."""
    params = zstandard.ZstdCompressionParameters(
        window_log=17, hash_log=16, chain_log=16, search_log=7, min_match=5,
        strategy=zstandard.STRATEGY_LAZY2,
        write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=params)
    run = zstandard.ZstdCompressor(dict_data=held, compression_params=params).compress
    return lambda window: len(run(window))


def features(gains: np.ndarray) -> list[float]:
    """What the score sees of a text: best gain, best three, and how common gains are."""
    top = np.sort(gains)[-3:]
    hits = int((gains >= GAINS).sum())
    return [float(top[-1]), float(top.sum()), hits / len(gains), math.log1p(hits), math.log(len(gains))]


def gains_of(text: bytes, ordinary, toxic) -> np.ndarray:
    return np.array([ordinary(w) - toxic(w) for w in windows(normal(text))])


def score_of(model: Model, rows: np.ndarray) -> np.ndarray:
    z = np.column_stack([rows, np.ones(len(rows))]) @ model.weights + model.shift
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    column = batch.column(batch.schema.get_field_index("text"))
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


def _sample(docs: DataFrame, labels: DataFrame, use, max_toxic: int, max_ordinary: int) -> DataFrame:
    known = (
        labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & use)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    # Labels without a document of this input would use up the sample.
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    parts = [
        known.where(F.col("toxic") == side).orderBy(*order).limit(most)
        for side, most in ((1, max_toxic), (0, max_ordinary))
    ]
    chosen = saved(parts[0].unionByName(parts[1]), "toxicity-chosen")  # at most the two limits
    # One row for each id, however many share it, so that the limits hold for rows too.
    return (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "toxic")
        .agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
        .select("doc_id", "text", "toxic")
    )


def _gram_counts(batches):
    """Per task: in how many toxic and in how many ordinary texts each gram occurs."""
    counts = (Counter(), Counter())

    def rows():
        grams = list(counts[0].keys() | counts[1].keys())
        out = pa.RecordBatch.from_arrays(
            [
                pa.array(grams, pa.binary()),
                pa.array([counts[1][g] for g in grams], pa.int64()),
                pa.array([counts[0][g] for g in grams], pa.int64()),
            ],
            names=["gram", "toxic", "ordinary"],
        )
        counts[0].clear()
        counts[1].clear()
        return out

    for batch in batches:
        for text, side in zip(_texts(batch), batch.column(batch.schema.get_field_index("toxic")).to_pylist()):
            text = normal(text)
            counts[side].update({text[i : i + GRAM] for i in range(len(text) - GRAM + 1)})
            if len(counts[0]) + len(counts[1]) > 400_000:
                yield rows()
    yield rows()


def train(
    docs: DataFrame,
    labels: DataFrame,
    use: Column,
    *,
    threshold: float = 0.7,
    max_toxic: int = 3_000,
    max_ordinary: int = 6_000,
) -> Model | None:
    """Fit on the labelled rows that ``use`` (a condition on doc_id) admits. The score equals
    ``threshold`` where toxic and ordinary training texts are best told apart. None when one
    of the two classes has no text. Several labels of one id count as toxic if any is."""
    spark = docs.sparkSession
    sample = saved(_sample(docs, labels, use, max_toxic, max_ordinary), "toxicity-sample")
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    support = max(3, math.ceil(SUPPORT * sizes[1]))
    grams = (
        sample.select("text", "toxic")
        .mapInArrow(_gram_counts, "gram binary, toxic long, ordinary long")
        .groupBy("gram")
        .agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
        .where(
            (F.col("toxic") >= support)
            & (F.col("toxic") / sizes[1] > RATIO * (F.col("ordinary") + 0.5) / max(sizes[0], RATIO * 2))
        )
        .orderBy(F.desc("toxic"), "gram")
        .limit(20_000)
        .collect()
    )
    chosen = ship(spark, frozenset(bytes(r["gram"]) for r in grams))

    def segments(batches):
        found: Counter = Counter()
        for batch in batches:
            for text in _texts(batch):
                text = normal(text)
                ends, i, last, own = chosen.value, 0, len(text) - GRAM + 1, set()
                while i < last:
                    if text[i : i + GRAM] in ends:
                        begin = i
                        while i + 1 < last and text[i + 1 : i + 1 + GRAM] in ends:
                            i += 1
                        own.add(text[begin : i + GRAM])
                    i += 1
                found.update(own)
        keys = list(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary()), pa.array([found[k] for k in keys], pa.int64())], names=["segment", "n"]
        )

    def ordinary_windows(batches):
        for batch in batches:
            cut = [w for t in _texts(batch) for w in windows(normal(t), WINDOW, WINDOW)]
            yield pa.RecordBatch.from_arrays([pa.array(cut, pa.binary())], names=["w"])

    found = (
        sample.where("toxic = 1")
        .select("text")
        .mapInArrow(segments, "segment binary, n long")
        .groupBy("segment")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), F.desc(F.length("segment")), "segment")
        .limit(EXTRA_BYTES // GRAM)
        .collect()
    )
    base_windows = (
        sample.where("toxic = 0")
        .select("text")
        .mapInArrow(ordinary_windows, "w binary")
        .orderBy(F.xxhash64("w"), "w")
        .limit(BASE_WINDOWS)
        .collect()
    )
    extra = b""
    for r in found:  # most frequent first; later dictionary bytes are the cheaper to reach
        segment = bytes(r["segment"])
        if segment not in extra and len(extra) + len(segment) < EXTRA_BYTES:
            extra = b"\0" + segment + extra
    base = _base_dictionary([bytes(r["w"]) for r in base_windows])
    model = Model(bytes(len(extra)) + base, extra + base, np.zeros(6), 0.0)
    measured = sample.select("text", "toxic").mapInArrow(_measure(model), "toxic int, f array<double>")
    rows = measured.collect()  # one short line for each text of the bounded sample
    x = np.array([r["f"] for r in rows])
    y = np.array([r["toxic"] for r in rows], float)
    model.weights = _logistic(x, y)
    model.shift = math.log(threshold / (1 - threshold)) - _cut(
        np.column_stack([x, np.ones(len(x))]) @ model.weights, y
    )
    return model


def _base_dictionary(samples: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(2 * BASE_BYTES, samples).as_bytes()[-BASE_BYTES:]
    except zstandard.ZstdError:  # the trainer refuses very small inputs
        return b"".join(samples)[:BASE_BYTES]


def _measure(model: Model):
    def run(batches):
        ordinary, toxic = compressor(model.ordinary), compressor(model.toxic)
        for batch in batches:
            found = [features(gains_of(t, ordinary, toxic)) for t in _texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index("toxic")),
                    pa.array(found, pa.list_(pa.float64())),
                ],
                names=["toxic", "f"],
            )

    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps on scaled columns, classes weighted alike."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    share = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    w = np.zeros(z.shape[1])
    penalty = ridge * np.eye(z.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(
            (z * (share * p * (1 - p))[:, None]).T @ z + penalty, z.T @ (share * (p - y)) + penalty @ w
        )
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    out = w.copy()
    out[:-1] = w[:-1] / scale
    out[-1] = w[-1] - (w[:-1] * mean / scale).sum()
    return out


def _cut(z: np.ndarray, y: np.ndarray) -> float:
    """The value between two neighbouring scores that puts the fewest training texts on the
    wrong side; in the middle of the best stretch."""
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    wrong = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])
    edges = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    real = np.concatenate([[True], z[1:] > z[:-1], [True]])
    best = np.flatnonzero(real & (wrong == wrong[real].min()))
    return float(edges[best[len(best) // 2]])


def score(docs: DataFrame, model: Model | None, threshold: float = 0.7) -> DataFrame:
    """``doc_id, score, predicted`` for every row of ``docs``.

    Whole texts are scored. A null or empty text has one blank window and thus a low score;
    without a model (no labels of one class) every score is 0. Repeated rows are scored each.
    """
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))

    def run(batches):
        ordinary, toxic = compressor(model.ordinary), compressor(model.toxic)
        for batch in small(batches):
            if batch.num_rows == 0:
                continue
            rows = np.array([features(gains_of(t, ordinary, toxic)) for t in _texts(batch)])
            scores = score_of(model, rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index("doc_id")),
                    pa.array(scores, pa.float64()),
                    pa.array((scores >= threshold).astype(np.int32), pa.int32()),
                ],
                names=["doc_id", "score", "predicted"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def held_out(column: str = "doc_id"):
    return F.coalesce(remainder(column, 3) == 1, F.lit(False))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, columns unchanged."""
    model = train(docs, labels, ~held_out(), threshold=threshold)
    if model is None:
        return docs
    names = docs.columns

    def keep(batches):
        ordinary, toxic = compressor(model.ordinary), compressor(model.toxic)
        for batch in small(batches):
            if batch.num_rows == 0:
                continue
            rows = np.array([features(gains_of(t, ordinary, toxic)) for t in _texts(batch)])
            yield batch.filter(pa.array(score_of(model, rows) < threshold)).select(names)

    return docs.mapInArrow(keep, docs.schema)
