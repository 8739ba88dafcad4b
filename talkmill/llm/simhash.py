"""SimHash near-duplicates by anchor-point covering.

Fingerprints that differ in at most 3 of 64 bits differ in at most one bit in one of their
halves. In each half (31 of its 32 bits) the words of the (31, 26) Hamming code are the anchors:
every point has one within distance 1, the covering radius. A fingerprint is replicated to every
anchor within covering radius plus the half's threshold, 2 bits: 16 anchors at most. If y is
within one bit of x there, x's own nearest anchor is among y's. So fingerprints are compared per
anchor, those at home there with those replicated to it, and no link is lost. 2^26 anchors a
half keep the groups small; equal fingerprints are one point throughout.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkmill.llm.common import saved, slices, small
from talkmill.llm.components import components

SHINGLE = 3
SEED = 42
THRESHOLD = 3
POINT_BITS = 31


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles of one text; 0 without words. A bit is set if it is set in
    over half of the shingle hashes, repeats counted."""
    words = text.lower().split()  # splits at the six ASCII white-space characters only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]).tolist()
        begins = [0, *ends]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[b : e - 1], SEED) for b, e in zip(begins, ends[shingle - 1 :])]
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[i : i + (1 << 16)], ">u8")
        total += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) of every row; a null text has no words."""

    def run(batches):
        for batch in small(batches):
            texts = batch.column(1).cast(pa.large_binary()).to_pylist()
            found = np.array([fingerprint(t or b"", shingle) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def flips() -> np.ndarray:
    """For each syndrome, the flips that lead to code words within 2 bits: its own position
    first (the nearest), then every pair of positions whose exclusive-or it is."""
    table = np.zeros((POINT_BITS + 1, (POINT_BITS + 1) // 2), np.int64)
    for s in range(1, POINT_BITS + 1):
        pairs = [(1 << i - 1) | (1 << (i ^ s) - 1) for i in range(1, POINT_BITS + 1) if i < i ^ s]
        table[s] = [1 << s - 1, *pairs]
    return table


def syndromes(points: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), np.int64)
    for i in range(POINT_BITS):
        out ^= np.where(points >> i & 1, i + 1, 0)
    return out


def anchors_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``index, half, anchor, home`` of every replica of the fingerprints."""
    table, parts = flips(), []
    bits = fps.view(np.uint64)
    for half in (0, 1):
        points = (bits >> np.uint64(32 * half) & np.uint64((1 << POINT_BITS) - 1)).astype(np.int64)
        s = syndromes(points)
        anchors = points[:, None] ^ table[s]
        real = np.ones_like(anchors, bool)
        real[s == 0, 1:] = False  # a code word has no other within 2 bits
        rows, column = np.nonzero(real)
        parts.append((rows, np.full(len(rows), half), anchors[real], column == 0))
    return tuple(np.concatenate(x) for x in zip(*parts))


def links(points: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs ``a < b`` of different fingerprints (column ``fp``, distinct, not null) that differ
    in at most ``threshold`` bits, 3 at most. A pair may come up to twice."""
    if not 0 <= threshold <= THRESHOLD:
        raise ValueError(f"anchors cover differences of up to {THRESHOLD} bits")

    def run(batches):
        for batch in batches:
            for a, b in slices([1] * batch.num_rows, 1 << 14):
                fps = batch.column(0)[a:b].to_numpy(zero_copy_only=False)
                index, half, anchor, home = anchors_of(fps)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fps[index]), pa.array(anchor * 2 + half), pa.array(home)],
                    names=["fp", "anchor", "home"],
                )

    replicas = points.select("fp").mapInArrow(run, "fp long, anchor long, home boolean")
    at_home = replicas.where("home").select("anchor", F.col("fp").alias("a"))
    near = replicas.select("anchor", F.col("fp").alias("b"))
    return (
        at_home.join(near, "anchor")
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold))
        .select("a", "b")
    )


def groups(found: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``fp, root, component_id`` for every fingerprint of ``found (doc_id, fp)``: the fingerprint
    that stands for its group, and the smallest doc_id reachable over links, which is null where
    every document reached has a null id."""
    classes = saved(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    pairs = saved(links(classes, threshold), "simhash-links")
    roots = components(pairs)
    members = roots.join(classes, roots["node"] == classes["fp"]).select("node", "root", "least")
    smallest = members.groupBy("root").agg(F.min("least").alias("smallest"))
    joined = members.join(smallest, "root").select(F.col("node").alias("fp"), "root", "smallest")
    return classes.join(joined, "fp", "left").select(
        "fp",
        F.coalesce("root", "fp").alias("root"),
        F.when(F.col("root").isNotNull(), F.col("smallest")).otherwise(F.col("least")).alias("component_id"),
    )


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs``.

    Exact copies share a fingerprint; texts without words have fingerprint zero and are linked
    like any other. Rows that repeat come out as often.
    """
    found = saved(fingerprints(docs, shingle), "simhash-fingerprints")
    return found.join(groups(found, threshold), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates, one with the smallest doc_id;
    columns unchanged. Of several rows of a group with that id the one with the smallest text
    hash stays. Rows without an id cannot be named and all stay."""
    found = saved(fingerprints(docs, shingle), "simhash-fingerprints")
    grouped = saved(found.join(groups(found, threshold), "fp"), "simhash-grouped")
    named = grouped.where(F.col("doc_id").isNotNull())
    repeated = saved(
        named.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "simhash-repeated"
    )
    dropped = saved(named.where("doc_id <> component_id").select("doc_id"), "simhash-dropped")
    if repeated.isEmpty():
        return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)
    # An id that several rows share says too little; those rows are told apart by their texts.
    single = docs.join(dropped.unionByName(repeated), "doc_id", "left_anti").select(docs.columns)
    shared = docs.join(repeated, "doc_id", "left_semi").select(docs.columns)
    return single.unionByName(_one_of_repeated(shared, grouped.join(repeated, "doc_id", "left_semi"), shingle))


def _one_of_repeated(rows: DataFrame, grouped: DataFrame, shingle: int) -> DataFrame:
    """Of rows whose ids occur more than once, those that stand for their groups."""
    own = T.StructType([*rows.schema, T.StructField("__fp", T.LongType())])

    def mark(batches):
        for batch in small(batches):
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.large_binary()).to_pylist()
            fps = np.array([fingerprint(t or b"", shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps)], names=[*batch.schema.names, "__fp"])

    best = grouped.where("doc_id = component_id").select(
        F.col("doc_id").alias("__id"), F.col("fp").alias("__key"), F.col("root").alias("__root")
    )
    marked = rows.mapInArrow(mark, own)
    first = Window.partitionBy("__root").orderBy(F.xxhash64("text"), "text")
    return (
        marked.join(best.distinct(), (marked["doc_id"] == best["__id"]) & (marked["__fp"] == best["__key"]))
        .withColumn("__rank", F.row_number().over(first))
        .where("__rank = 1")
        .select(rows.columns)
    )
