"""Exact similarity search over stored blocks that know where their vectors lie.

A block is a run of vectors near each other. It states its centre, a unit vector, and its radius, the
largest angle between the centre and one of its vectors; so no vector of it can be closer to a
question than the angle to the centre less the radius. A question looks into its most promising
blocks first. The k-th score found there is its floor, and only blocks that can still reach
the floor are read after that.

Blocks lie in folders by ``part``; parts in which no block is open are not read. A row is a vector, and the
first row of a block carries its centre and radius, so that bounds are computed from a scan of
those few rows. Every row is indexed and the result is that of a full comparison; the sample
from which the parts are made decides how tight blocks are and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkmill.operators.model import EMBEDDING_DIM
from talkmill.operators.retrieval import (
    MAX_PRUNE_VALUES,
    SLICE_BYTES,
    TOP_K,
    in_slices,
    of_length,
    pieces,
    prune_namespaces,
    topk_per_question,
)
from talkmill.operators.topk_kernel import EXACT_DIGITS, BestMatches, to_matrix, unit_rows
from talkmill.session import remove_dir, scratch_dir

BLOCK_ROWS = 1_024
#: Bytes of the pivots that travel with the tasks when blocks are made.
PIVOT_BYTES = 32 << 20
#: Parts that the vectors of small namespaces share.
SHARED_PARTS = 64
#: Blocks that a question looks into for its floor.
FIRST_BLOCKS = 2
#: Allowance for rounding in angles.
ANGLE_SLACK = 1e-6
ROW_GROUP_BYTES = 16 << 20
PIVOT_PRODUCT = 1 << 22


def write_blocks(
    vectors: DataFrame, path: str, dim: int = EMBEDDING_DIM, block_rows: int = BLOCK_ROWS, pivot_bytes: int = PIVOT_BYTES
) -> None:
    """Lay the ``vectors(namespace, id, embedding)``, a stored table, out in blocks under ``path``.

    A namespace of more than one block gets pivots, a hashed sample of its vectors, and a part
    for each, which takes the vectors nearest to it; smaller namespaces share parts. At most
    ``pivot_bytes`` of pivots are expected; beyond that parts hold several blocks. Vectors without
    length or of another length, and rows of a null namespace, match nothing and are left out.
    """
    spark = vectors.sparkSession
    usable = of_length(vectors, dim).where("namespace is not null").select("namespace", "id", "embedding")
    large = usable.groupBy("namespace").agg(F.count("*").alias("n")).where(F.col("n") > block_rows)
    total = large.agg(F.sum("n")).first()[0] or 0
    share = min(1 / block_rows, pivot_bytes / (dim * 8) / max(total, 1))
    chance = F.pmod(F.xxhash64("id", "namespace"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    sample = usable.where(chance).join(large, "namespace", "left_semi").select("namespace", "id", "embedding")
    pivots: dict[str, tuple[int, np.ndarray]] = {}
    chosen = sample.orderBy("namespace", "id").toArrow()
    names = np.array(chosen.column("namespace").to_pylist(), dtype=object)
    matrix = unit_rows(to_matrix(chosen.column("embedding"), dim))[0] if len(chosen) else np.zeros((0, dim))
    for name in dict.fromkeys(names):
        at = np.nonzero(names == name)[0]
        pivots[name] = (SHARED_PARTS + int(at[0]), matrix[at])
    del chosen, matrix
    shipped = spark.sparkContext.broadcast(pivots)
    work = scratch_dir(spark, "block-parts")
    try:
        shared = F.pmod(F.xxhash64("namespace"), F.lit(SHARED_PARTS)).cast("int")
        own = T.StructType([*usable.schema.fields, T.StructField("part", T.IntegerType())])
        near = usable.withColumn("part", shared).mapInArrow(_assigner(shipped, dim), own)
        near.write.parquet(work)
        near = spark.read.schema(own).parquet(work)
        order = ["part", "namespace", "id"]
        laid = near.repartitionByRange(*order).sortWithinPartitions(*order)
        schema = T.StructType(
            [
                *own.fields,
                T.StructField("block", T.LongType()),
                T.StructField("centre", T.ArrayType(T.DoubleType())),
                T.StructField("radius", T.DoubleType()),
            ]
        )
        blocks = laid.mapInArrow(_cutter(dim, block_rows), schema)
        # The writer needs rows by part; within it a block's first row must stay the first.
        blocks = blocks.sortWithinPartitions("part", "block", F.col("radius").isNull(), "id")
        blocks.write.option("parquet.block.size", ROW_GROUP_BYTES).partitionBy("part").parquet(path)
    finally:
        remove_dir(spark, work)
        shipped.destroy()


def read_blocks(spark: SparkSession, path: str, id_type: str = "string", component: str = "float") -> DataFrame:
    """Blocks for :func:`search_blocks`; the types are those of the vectors they were made from."""
    schema = f"""namespace string, id {id_type}, embedding array<{component}>, block bigint,
        centre array<double>, radius double, part int"""
    return spark.read.schema(schema).parquet(path)


def _assigner(pivots, dim: int) -> Callable:
    """Parts by the nearest pivot; rows without a length go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pivots.value
        for batch in pieces(batches):
            unit, usable = unit_rows(to_matrix(batch.column("embedding"), dim))
            usable &= np.isfinite(unit).all(axis=1)
            parts = batch.column("part").to_numpy(zero_copy_only=False).copy()
            codes = batch.column("namespace").dictionary_encode()
            which = codes.indices.to_numpy(zero_copy_only=False)
            for code, name in enumerate(codes.dictionary.to_pylist()):
                if name not in known:
                    continue
                first, matrix = known[name]
                rows = np.nonzero((which == code) & usable)[0]
                step = max(1, PIVOT_PRODUCT // len(matrix))
                for lo in range(0, len(rows), step):
                    some = rows[lo : lo + step]
                    parts[some] = first + np.argmax(unit[some] @ matrix.T, axis=1)
            table = pa.Table.from_batches([batch]).set_column(3, "part", pa.array(parts, pa.int32()))
            yield from table.filter(pa.array(usable)).combine_chunks().to_batches()

    return run


def _cutter(dim: int, block_rows: int) -> Callable:
    """Runs of one part and namespace in blocks; the first row of each gets centre and radius."""

    def block(rows: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        unit, _ = unit_rows(to_matrix(table.column("embedding"), dim))
        centre = unit_rows(unit.mean(axis=0)[None, :])[0][0]
        if not centre.any():
            centre = unit[0]
        radius = float(np.arccos(np.clip(unit @ centre, -1.0, 1.0)).max())
        rest = [None] * (len(unit) - 1)
        table = table.append_column("block", pa.array([number] * len(unit), pa.int64()))
        table = table.append_column("centre", pa.array([centre, *rest], pa.list_(pa.float64())))
        table = table.append_column("radius", pa.array([radius, *rest], pa.float64()))
        return table.to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        key, n = None, 0
        for batch in batches:
            parts = batch.column("part").to_numpy(zero_copy_only=False)
            names = batch.column("namespace").dictionary_encode()
            codes = names.indices.to_numpy(zero_copy_only=False)
            cuts = np.nonzero((parts[1:] != parts[:-1]) | (codes[1:] != codes[:-1]))[0] + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(parts)]):
                own = (int(parts[lo]), names.dictionary[codes[lo]].as_py())
                if held and own != key:
                    yield block(held, number)
                    held, n, number = [], 0, number + 1
                key = own
                while lo < hi:
                    take = min(hi - lo, block_rows - n)
                    held.append(batch.slice(lo, take))
                    lo, n = lo + take, n + take
                    if n == block_rows:
                        yield block(held, number)
                        held, n, number = [], 0, number + 1
        if held:
            yield block(held, number)

    return run


@dataclass
class Asked:
    """A slice of the questions as the tasks need it. ``floor`` is a score that each question is
    sure to reach with k matches; ``seen`` says which questions have looked into a block."""

    groups: dict[str, tuple[pa.Array, np.ndarray]]
    everywhere: bool
    floor: dict[str, np.ndarray] = field(default_factory=dict)
    seen: dict[int, np.ndarray] = field(default_factory=dict)
    units: dict[str, np.ndarray] = field(default_factory=dict)

    def group(self, namespace: str) -> str | None:
        name = "" if self.everywhere else namespace
        return name if name in self.groups else None

    def unit(self, name: str) -> np.ndarray:
        if name not in self.units:
            self.units[name] = unit_rows(self.groups[name][1])[0]
        return self.units[name]

    def bounds(self, name: str, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
        """questions x blocks: the highest score that a block can hold for a question."""
        apart = np.arccos(np.clip(self.unit(name) @ centres.T, -1.0, 1.0))
        return np.cos(np.maximum(apart - radii - ANGLE_SLACK, 0.0))

    def open(self, name: str, bounds: np.ndarray, digits: int) -> np.ndarray:
        """Whether a question must look into a block; scores count to ``digits`` decimals."""
        return bounds + 10.0**-digits >= self.floor[name][:, None]


def search_blocks(
    questions: DataFrame,
    blocks: DataFrame,
    k: int = TOP_K,
    scope: str = "namespace",
    dim: int = EMBEDDING_DIM,
    digits: int = EXACT_DIGITS,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """Exact best-k matches ``(question_id, rank, namespace, id, score)``, those of
    ``similarity_topk``, from ``blocks`` that :func:`write_blocks` wrote; ``namespace`` is the vector's.

    The search runs when this is called, a slice of the questions after the other, and the result
    is a table in the shared folder; the driver holds one slice at a time. Each slice is three passes: bounds of all
    blocks (first rows only), the first blocks of each question, and the parts that hold a
    block which can still reach a question's floor.
    """
    everywhere = scope == "global"
    schema = T.StructType(
        [
            T.StructField("question_id", questions.schema["question_id"].dataType),
            T.StructField("score", T.DoubleType()),
            T.StructField("namespace", T.StringType()),
            T.StructField("id", blocks.schema["id"].dataType),
        ]
    )

    def one(groups: dict, folder: str) -> DataFrame:
        asked = Asked(groups, everywhere)
        narrowed = blocks if everywhere else prune_namespaces(blocks, sorted(groups))
        return _search_slice(asked, narrowed, k, dim, digits, schema, folder)

    found = in_slices(questions, dim, slice_bytes, everywhere, one)
    if found is None:
        found = blocks.sparkSession.createDataFrame([], schema)
    return topk_per_question(found, k).select("question_id", "rank", "namespace", "id", "score")


def _search_slice(
    asked: Asked, blocks: DataFrame, k: int, dim: int, digits: int, schema: T.StructType, folder: str
) -> DataFrame:
    """Matches of one slice; all that stays is the tables under ``folder``."""
    spark = blocks.sparkSession
    heads = blocks.where("radius is not null").select("namespace", "part", "block", "centre", "radius")
    shipped = spark.sparkContext.broadcast(asked)
    # A few rows for each question of the slice.
    first = heads.mapInArrow(_best_blocks(shipped, dim), "name string, q long, block long, part int, bound double")
    promising = Window.partitionBy("name", "q").orderBy(F.col("bound").desc(), "block")
    first = first.withColumn("n", F.row_number().over(promising)).where(F.col("n") <= FIRST_BLOCKS)
    rows = first.select("q", "block", "part").toArrow()
    shipped.destroy()
    parts = sorted(set(rows.column("part").to_pylist()))
    asked.seen = {int(b): np.sort(g["q"].to_numpy()) for b, g in rows.to_pandas().groupby("block")}
    shipped = spark.sparkContext.broadcast(asked)
    near = blocks.where(F.col("part").isin(parts))
    if len(asked.seen) <= MAX_PRUNE_VALUES:
        near = near.where(F.col("block").isin(list(asked.seen)))
    looked = near.mapInArrow(_scorer(shipped, k, dim, digits, schema.names, first=True), schema)
    topk_per_question(looked, k).write.parquet(f"{folder}/first")
    shipped.destroy()
    best = spark.read.parquet(f"{folder}/first")
    floors = best.where(F.col("rank") == k).select("question_id", "score").toArrow()
    floor = dict(zip(floors.column("question_id").to_pylist(), floors.column("score").to_pylist()))
    for name, (ids, matrix) in asked.groups.items():
        # A question without a length matches nothing.
        asked.floor[name] = np.array([floor.get(i, -np.inf) for i in ids.to_pylist()])
        asked.floor[name][~unit_rows(matrix)[1]] = np.inf
    shipped = spark.sparkContext.broadcast(asked)
    # One number for each part.
    still = heads.mapInArrow(_open_parts(shipped, dim, digits), "part int").distinct()
    parts = sorted(r["part"] for r in still.collect())
    rest = blocks.where(F.col("part").isin(parts))
    rest = rest.mapInArrow(_scorer(shipped, k, dim, digits, schema.names, first=False), schema)
    rest.write.parquet(f"{folder}/rest")
    shipped.destroy()
    return best.select(*schema.names).unionByName(spark.read.schema(schema).parquet(f"{folder}/rest"))


def _heads(batch: pa.RecordBatch, asked: Asked, dim: int) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """``(group, rows, bounds)`` of the block heads in a batch."""
    codes = batch.column("namespace").dictionary_encode()
    which = codes.indices.to_numpy(zero_copy_only=False)
    centres = to_matrix(batch.column("centre"), dim)
    radii = batch.column("radius").to_numpy(zero_copy_only=False)
    for code, namespace in enumerate(codes.dictionary.to_pylist()):
        name = asked.group(namespace)
        if name is None:
            continue
        rows = np.nonzero(which == code)[0]
        step = max(1, PIVOT_PRODUCT // len(asked.unit(name)))
        for lo in range(0, len(rows), step):
            some = rows[lo : lo + step]
            yield name, some, asked.bounds(name, centres[some], radii[some])


def _best_blocks(shipped, dim: int) -> Callable:
    """For each question the blocks of the task with the highest bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shipped.value
        best: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in pieces(batches):
            blocks = batch.column("block").to_numpy(zero_copy_only=False)
            parts = batch.column("part").to_numpy(zero_copy_only=False)
            for name, rows, bounds in _heads(batch, asked, dim):
                size = (len(bounds), len(rows))
                own = [bounds, np.broadcast_to(blocks[rows], size), np.broadcast_to(parts[rows], size)]
                if name in best:
                    own = [np.concatenate([a, b], axis=1) for a, b in zip(best[name], own)]
                order = np.argsort(-own[0], axis=1, kind="stable")[:, :FIRST_BLOCKS]
                best[name] = tuple(np.take_along_axis(a, order, axis=1) for a in own)
        for name, (bounds, blocks, parts) in best.items():
            q = np.repeat(np.arange(len(bounds)), bounds.shape[1])
            columns = [pa.array([name] * len(q), pa.string()), pa.array(q), pa.array(blocks.ravel())]
            columns += [pa.array(parts.ravel(), pa.int32()), pa.array(bounds.ravel())]
            yield pa.RecordBatch.from_arrays(columns, names=["name", "q", "block", "part", "bound"])

    return run


def _open_parts(shipped, dim: int, digits: int) -> Callable:
    """Parts that hold a block into which some question must still look."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, found = shipped.value, set()
        for batch in pieces(batches):
            blocks, parts = batch.column("block").to_pylist(), batch.column("part").to_pylist()
            for name, rows, bounds in _heads(batch, asked, dim):
                wanted = asked.open(name, bounds, digits)
                for at, row in enumerate(rows):
                    seen = asked.seen.get(blocks[row])
                    if seen is not None:
                        wanted[seen, at] = False
                found.update(parts[row] for row in rows[wanted.any(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int32())], names=["part"])

    return run


def _scorer(shipped, k: int, dim: int, digits: int, out: list[str], first: bool) -> Callable:
    """Best k of the task for each question over the blocks that concern it: those it looks into
    first, or else those that are open. Where a task begins inside a block, which then has no
    head, all questions that have not seen it look into it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shipped.value
        best: dict[str, BestMatches] = {}
        current, heads = None, None
        for batch in pieces(batches):
            blocks = batch.column("block").to_numpy(zero_copy_only=False)
            cuts = np.nonzero(blocks[1:] != blocks[:-1])[0] + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(blocks)]):
                rows = batch.slice(lo, hi - lo)
                name = asked.group(rows.column("namespace")[0].as_py())
                if name is None:
                    continue
                number = int(blocks[lo])
                seen = asked.seen.get(number, np.empty(0, int))
                if first:
                    only = seen
                else:
                    if number != current:
                        current, heads = number, None
                    if rows.column("radius")[0].is_valid:
                        heads = asked.bounds(
                            name, to_matrix(rows.column("centre").slice(0, 1), dim), np.array([rows.column("radius")[0].as_py()])
                        )
                    only = np.arange(len(asked.floor[name]))
                    if heads is not None:
                        only = np.nonzero(asked.open(name, heads, digits)[:, 0])[0]
                    only = np.setdiff1d(only, seen, assume_unique=True)
                if len(only) == 0:
                    continue
                if name not in best:
                    best[name] = BestMatches(*asked.groups[name], k, digits, asked.floor.get(name))
                payload = pa.Table.from_batches([rows.select(["namespace", "id"])])
                best[name].offer(to_matrix(rows.column("embedding"), dim), payload, only)
        for matches in best.values():
            table = matches.result()
            if table is not None:
                yield from table.select(out).combine_chunks().to_batches()

    return run
