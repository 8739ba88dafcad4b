"""Exact top-k by inner product with a vector-approximation file.

Every component is quantised to one of 256 cells of its dimension, and the one-byte cells of all
vectors form a file an eighth of the vectors' size. A task scans it in blocks: the corners of the
cells give, with two matrix products, a lower and an upper bound of every score in the block; a
vector stays a candidate if its upper bound reaches the k-th best lower bound seen. After the
scan, exact vectors are read in the order of their bounds: first each query's best few, then
only those whose upper bound still reaches the k-th exact score. Cells only steer the work; all
vectors are indexed and the result is exact.

Queries go in slices of bounded bytes, one after the other: each is sent to a scan of the cell file
whose candidates are written, and dropped, so nothing that is held or shipped grows with the data. Equal vectors are one group of which the k + 1 smallest ids are
enough, so a vector that very many rows share stays small.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkmill.llm.common import saved, ship

CELLS = 256
#: Rows whose components give the inner borders of the cells: those with the smallest id hashes.
SAMPLE = 4_096
#: Bytes of one slice of queries, 8 a component.
SLICE_BYTES = 8 << 20
BLOCK = 2_048
#: Entries of the largest matrix of bounds, queries x rows of a block.
ENTRIES = 1 << 20
#: Candidates that a task holds before it drops those ruled out since.
HELD = 2_000_000
#: From here on doubles no longer tell neighbouring integers apart.
LARGEST = 1 << 53


def integer_vector(embedding: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component, with x as double; an error where that is not exact."""
    beyond = F.lit(f"a component is not within 2^53 / {scale}, where integers are exact")

    def one(x: Column) -> Column:
        scaled = x.cast("double") * scale
        return F.when(F.abs(scaled) < LARGEST, F.floor(scaled)).otherwise(F.raise_error(beyond).cast("long"))

    return F.transform(embedding, one)


def usable(embedding: Column) -> Column:
    """Not null, without null, NaN or infinite components."""
    bad = F.exists(
        embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    )
    return F.coalesce(embedding.isNotNull() & ~bad, F.lit(False))


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)


def _borders(rows: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inner borders (dims x 255), and lowest and highest component of each dimension."""

    def extremes(batches):
        low = high = None
        for batch in batches:
            if batch.num_rows:
                v = _vectors(batch.column(0), dims)
                low = v.min(0) if low is None else np.minimum(low, v.min(0))
                high = v.max(0) if high is None else np.maximum(high, v.max(0))
        if low is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(dims, dtype=np.int32)), pa.array(low), pa.array(high)], names=["d", "low", "high"]
            )

    ends = (
        rows.select("v")
        .mapInArrow(extremes, "d int, low double, high double")
        .groupBy("d")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"))
        .orderBy("d")
        .toArrow()
    )
    sample = rows.orderBy(F.xxhash64("vec_id", "cid"), "cid").limit(SAMPLE).select("v").toArrow()
    v = _vectors(sample["v"], dims)
    inner = np.ceil(np.quantile(v, np.arange(1, CELLS) / CELLS, axis=0)).T
    return np.ascontiguousarray(inner), ends["low"].to_numpy(), ends["high"].to_numpy()


def cells_of(v: np.ndarray, inner: np.ndarray) -> np.ndarray:
    out = np.empty(v.shape, np.uint8)
    for d in range(v.shape[1]):
        out[:, d] = np.searchsorted(inner[d], v[:, d], "right")
    return out


def corners(inner: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest integer in each cell of each dimension."""
    return np.column_stack([low, np.maximum(inner, low[:, None])]), np.column_stack(
        [np.minimum(inner - 1, high[:, None]), high]
    )


def _cell_file(rows: DataFrame, inner: np.ndarray, dims: int) -> DataFrame:
    shipped = ship(rows.sparkSession, inner)

    def run(batches):
        for batch in batches:
            cells = cells_of(_vectors(batch.column(2), dims), shipped.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([c.tobytes() for c in cells], pa.binary())],
                names=["cid", "vec_id", "cells"],
            )

    kind = rows.schema["vec_id"].dataType.simpleString()
    return saved(
        rows.select("cid", "vec_id", "v").mapInArrow(run, f"cid long, vec_id {kind}, cells binary"), "vector-cells"
    )


def bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of q . v for vectors between the corners ``low`` and ``high``;
    widened where sums pass what doubles hold exactly."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    lower, upper = up @ low.T + down @ high.T, up @ high.T + down @ low.T
    reach = np.abs(q).sum(1)[:, None] * np.maximum(np.abs(low), np.abs(high)).max(1, initial=0)[None, :]
    slack = np.where(reach < 2.0**52, 0.0, reach * (q.shape[1] + 16) * 2.0**-52)
    return lower - slack, upper + slack


def _scan(cells: DataFrame, ids: np.ndarray, q: np.ndarray, edges, k: int):
    """``query_id, cid, lower, upper`` of the candidates that the tasks can't rule out, and the
    broadcast that the scan needs until it has run."""
    shipped = ship(cells.sparkSession, (ids, q, *corners(*edges)))

    def run(batches):
        ids, q, low_of, high_of = shipped.value
        dims = np.arange(q.shape[1])
        best = np.full((len(ids), k), -np.inf)
        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        def thinned():
            parts = [np.concatenate(x) for x in zip(*held)]
            ok = parts[3] >= best[parts[0], 0]
            return [p[ok] for p in parts]

        some = max(1, ENTRIES // BLOCK)
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                own = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(part.num_rows, len(dims))
                low, high = low_of[dims, own], high_of[dims, own]
                vec_ids, cids = part.column(1).to_numpy(zero_copy_only=False), part.column(0).to_numpy()
                # A slice of queries in blocks, as the matrices hold an entry for each query and row.
                for b in range(0, len(ids), some):
                    lower, upper = bounds(q[b : b + some], low, high)
                    same = ids[b : b + some, None] == vec_ids[None, :]
                    lower[same] = upper[same] = -np.inf
                    top = np.sort(np.concatenate([best[b : b + some], lower], axis=1), axis=1)[:, -k:]
                    best[b : b + some] = top
                    rows, columns = np.nonzero((upper >= top[:, :1]) & ~same)
                    held.append((rows + b, cids[columns], lower[rows, columns], upper[rows, columns]))
                    count += len(rows)
                    if count > HELD:
                        held[:] = [tuple(thinned())]
                        count = len(held[0][0])
        if held:
            rows, cids, lower, upper = thinned()
            for a in range(0, len(rows), 1 << 16):
                s = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[rows[s]]), pa.array(cids[s]), pa.array(lower[s]), pa.array(upper[s])],
                    names=["query_id", "cid", "lower", "upper"],
                )

    return cells.mapInArrow(run, "query_id long, cid long, lower double, upper double"), shipped


def _scores(pairs: DataFrame, queries: DataFrame, rows: DataFrame, wide: bool) -> DataFrame:
    """Exact scores of the candidate pairs; ``wide`` where sums on the way may pass a long. A score
    that no long can hold is an error."""
    kind = "decimal(38,0)" if wide else "long"
    own = (lambda x: x.cast("decimal(19,0)")) if wide else (lambda x: x)
    dot = F.aggregate(
        F.zip_with("qv", "v", lambda a, b: own(a) * own(b)),
        F.lit(0).cast(kind),
        lambda total, x: (total + x).cast(kind),
    ).cast("long")
    return (
        pairs.join(rows, "cid")
        .join(queries.select("query_id", F.col("v").alias("qv")), "query_id")
        .select("query_id", "vec_id", "n", dot.alias("score"))
    )


def top_k(embeddings: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``embeddings (vec_id, embedding)`` that
    ``is_query`` (a condition on vec_id) admits, the k other rows with the highest integer inner
    products, all if fewer; ties to the smaller vec_id.

    Vectors that are null or hold null or non-finite components and rows without an id take no
    part; vectors meet only those with as many components. A repeated query id counts once, with
    its smallest vector; repeated candidate rows count each, and none with the query's own id.
    Scores are exact; a component whose scaled value passes 2^53, or a score among the best that
    passes a long, is an error.
    """
    spark = embeddings.sparkSession
    valid = (
        embeddings.select("vec_id", "embedding")
        .where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
        .select(F.col("vec_id").cast("long").alias("vec_id"), integer_vector(F.col("embedding")).alias("v"))
    )
    alike = Window.partitionBy("v").orderBy("vec_id")
    rows = saved(
        valid.groupBy("v", "vec_id")
        .agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
        .withColumn("place", F.row_number().over(alike))
        .where(F.col("place") <= k + 1)
        .select(F.monotonically_increasing_id().alias("cid"), "vec_id", "n", "v"),
        "vectors",
    )
    queries = saved(
        valid.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v")), "queries"
    )
    found, wide = [], False
    lengths = sorted(r["dims"] for r in queries.select(F.size("v").alias("dims")).distinct().collect())
    for dims in lengths:
        own = rows.where(F.size("v") == dims)
        edges = _borders(own, dims)
        wide |= dims * float(np.abs(edges[1:]).max(initial=0)) ** 2 >= 2.0**62
        cells = _cell_file(own, edges[0], dims)
        asked = queries.where(F.size("v") == dims)
        n = asked.count()
        most = max(1, SLICE_BYTES // (8 * max(dims, 1)))
        parts = -(-n // most)
        for part in range(parts):
            # By hash, so that slices are even; each is a bounded number of queries.
            chosen = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).toArrow()
            ids = chosen["query_id"].to_numpy()
            if len(ids):
                scan, shipped = _scan(cells, ids, _vectors(chosen["v"], dims), edges, k)
                found.append(saved(scan, "slice-candidates"))
                shipped.destroy()
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    candidates = reduce(DataFrame.unionByName, found)
    by_lower = Window.partitionBy("query_id").orderBy(F.desc("lower"), "cid")
    floor = (
        candidates.withColumn("place", F.row_number().over(by_lower))
        .where(F.col("place") <= k)
        .groupBy("query_id")
        .agg(F.count("*").alias("there"), F.min("lower").alias("floor"))
        .where(F.col("there") >= k)
        .select("query_id", "floor")
    )
    alive = candidates.join(floor, "query_id", "left").where("floor is null or upper >= floor")
    by_upper = Window.partitionBy("query_id").orderBy(F.desc("upper"), "cid")
    ordered = saved(
        alive.withColumn("place", F.row_number().over(by_upper)).select("query_id", "cid", "upper", "place"), "alive"
    )
    first = saved(_scores(ordered.where(F.col("place") <= 2 * k), queries, rows, wide), "first-scores")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    certain = (
        first.withColumn("place", F.row_number().over(by_score))
        .where(F.col("place") == k)
        .select("query_id", F.col("score").alias("kth"))
    )
    rest = (
        ordered.where(F.col("place") > 2 * k)
        .join(certain, "query_id", "left")
        .where("kth is null or upper >= kth")
        .select("query_id", "cid")
    )
    scored = first.unionByName(_scores(rest, queries, rows, wide))
    return (
        scored.withColumn("one", F.explode(F.sequence(F.lit(1), "n")))
        .withColumn("rank", F.row_number().over(by_score))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
