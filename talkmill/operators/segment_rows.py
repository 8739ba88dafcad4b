"""Segments that arrive one per row.

Chunking is an ordered fold: where a chunk ends depends on where it began. A video is cut
into blocks of consecutive segments, one group per block, so that a video with very many
segments never sits in one task. A video of one block (nearly all of them) is folded at
once. For the others every block first states, for each way a chunk may enter it, how the
chunk leaves it; these small tables are chained per video, after which each block knows
its true entry and folds on its own. The result equals the plain fold, row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkmill.functions.text import let, strip
from talkmill.functions.timing import bounded_end
from talkmill.operators.chunking import (
    CHUNK_SIZE,
    FIXED_DURATION,
    MAX_DURATION,
    explode_chunks,
    fold_segments,
    fold_segments_fixed,
    texts_between,
)

BLOCK_ROWS = 4096
SUPER_BLOCKS = 1024
TABLE = "block long, vals array<double>, exits array<double>, counts array<long>"


def validate_rows(segments: DataFrame) -> DataFrame:
    """Row form of segment validation: drop blanks, clamp starts, repair and cap ends."""
    raw_start = F.coalesce("start", F.lit(0.0))
    clean = segments.select(
        *[c for c in segments.columns if c not in ("text", "start", "end")],
        strip(F.coalesce("text", F.lit(""))).alias("text"),
        F.greatest(raw_start, F.lit(0.0)).alias("start"),
        F.coalesce("end", raw_start).alias("_end"),
    ).where("text <> ''")
    fixed = bounded_end(F.col("text"), F.col("start"), F.col("_end"))
    return clean.withColumn("end", fixed).drop("_end")


def lead_start(
    rows: DataFrame, keys: list[str], idx: str = "seg_idx", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add ``next_start``, the start of the following row. ``idx`` counts without gaps.

    The window runs per block of rows; the first row of a block is also shown to the
    block before it.
    """
    block = F.floor(F.col(idx) / block_rows)
    shown = F.when(
        (F.col(idx) % block_rows == 0) & (F.col(idx) > 0), F.array(block, block - 1)
    ).otherwise(F.array(block))
    ahead = Window.partitionBy(*keys, "_block").orderBy(idx)
    return (
        rows.withColumn("_block", F.explode(shown))
        .withColumn("next_start", F.lead("start").over(ahead))
        .where(F.col("_block") == block)
        .drop("_block")
    )


def _groups(segments: DataFrame, keys: list[str], idx: str, missing_end: Column, block_rows: int):
    rows = segments.select(
        *keys,
        F.col(idx).alias("idx"),
        strip(F.coalesce("text", F.lit(""))).alias("text"),
        F.coalesce("start", F.lit(0.0)).alias("start"),
        F.coalesce("end", missing_end).alias("end"),
    ).where("text <> ''")
    return _collect(rows.withColumn("block", F.floor(F.col("idx") / block_rows)), keys)


def _collect(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys, "block").agg(
        F.sort_array(F.collect_list(F.struct("idx", "text", "start", "end"))).alias("segs")
    )



def chunk_rows(
    segments: DataFrame,
    keys: list[str],
    chunk_size: int = CHUNK_SIZE,
    max_duration: float = MAX_DURATION,
    zero_start_compat: bool = True,
    idx: str = "seg_idx",
    block_rows: int = BLOCK_ROWS,
    super_blocks: int = SUPER_BLOCKS,
) -> DataFrame:
    """Chunks ``(*keys, chunk_index, text, start, end)``; closes after appending."""
    # Non-blank texts joined by one blank: a chunk never has more segments than this.
    reach = (chunk_size + 2) // 2
    block_rows = max(block_rows, reach)
    groups = _groups(segments, keys, idx, F.col("start"), block_rows)
    video = Window.partitionBy(*keys)
    sizes = groups.select(*keys, "block", F.size("segs").alias("n"))
    blocks = sizes.select(
        *keys,
        "block",
        F.count("*").over(video).alias("n_blocks"),
        (F.sum("n").over(video.orderBy("block")) - F.col("n")).alias("offset"),
    )
    located = groups.join(blocks, [*keys, "block"])
    fold = lambda segs: fold_segments(segs, chunk_size, max_duration, zero_start_compat)
    single = explode_chunks(located.where("n_blocks = 1"), fold(F.col("segs")), *keys)

    # Videos of several blocks: number the segments without gaps, cut again, and show each
    # block the segments that its last chunk may still take.
    numbered = (
        located.where("n_blocks > 1")
        .select(*keys, "offset", F.posexplode("segs").alias("p", "s"))
        .select(*keys, (F.col("offset") + F.col("p")).alias("idx"), "s.text", "s.start", "s.end")
    )
    own_block = F.floor(F.col("idx") / block_rows)
    seen = F.when(
        (F.col("idx") % block_rows < reach) & (own_block > 0), F.array(own_block, own_block - 1)
    ).otherwise(F.array(own_block))
    dense = _collect(numbered.withColumn("block", F.explode(seen)), keys).withColumn(
        "own", F.least(F.size("segs"), F.lit(block_rows))
    )

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [
                jumps(n, s, e, own, reach, chunk_size, max_duration, zero_start_compat)
                for n, s, e, own in zip(pdf["n"], pdf["s"], pdf["e"], pdf["own"])
            ]
            yield pdf[[*keys, "block"]].assign(
                vals=[[] for _ in out], exits=[o[0] for o in out], counts=[o[1] for o in out]
            )

    slim = dense.select(
        *keys,
        "block",
        "own",
        F.transform("segs", lambda s: F.length(s["text"])).alias("n"),
        F.transform("segs", lambda s: s["start"]).alias("s"),
        F.transform("segs", lambda s: s["end"]).alias("e"),
    )
    key_types = _ddl(segments, keys)
    table = slim.mapInPandas(tables, f"{key_types}, {TABLE}")
    entries = _chain(table, keys, key_types, _compose_jumps, _step_jump, 0.0, super_blocks)
    entered = dense.join(entries, [*keys, "block"]).withColumn("entry", F.col("entry").cast("int"))
    # Fold from the entry; a chunk belongs to the block where it starts.
    rest = entered.select(
        *keys,
        "base",
        F.posexplode(
            _own_chunks(F.col("segs"), F.col("entry"), F.col("own"), fold)
        ).alias("i", "chunk"),
    )
    multi = rest.select(
        *keys,
        (F.col("base") + F.col("i")).cast("int").alias("chunk_index"),
        "chunk.text",
        "chunk.start",
        "chunk.end",
    )
    return single.unionByName(multi)


def _own_chunks(segs: Column, entry: Column, own: Column, fold) -> Column:
    """Chunks of the segments from ``entry`` on that start before ``own``.

    The number of segments of each chunk follows from the lengths of the texts: chunk
    texts are the segment texts joined by single blanks.
    """
    tail = F.slice(segs, entry + 1, F.greatest(F.size(segs) - entry, F.lit(0)))
    budget = F.aggregate(
        F.slice(segs, entry + 1, F.greatest(own - entry, F.lit(0))),
        F.lit(0),
        lambda acc, s: acc + F.length(s["text"]) + 1,
    )

    def keep(both: Column) -> Column:
        chunks, own_chars = both["chunks"], both["budget"]
        # Characters used before each chunk; it starts inside the block while they do
        # not exceed the characters of the block's own segments.
        used = F.aggregate(
            chunks,
            F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n")),
            lambda acc, c: F.struct(
                (acc["sum"] + F.length(c["text"]) + 1).alias("sum"),
                F.when(acc["sum"] < own_chars, acc["n"] + 1).otherwise(acc["n"]).alias("n"),
            ),
        )
        return F.slice(chunks, F.lit(1), used["n"])

    return let(F.struct(fold(tail).alias("chunks"), budget.alias("budget")), keep)


def jumps(
    lengths, starts, ends, own: int, reach: int, size: int, cap: float, zero_start_compat: bool
) -> tuple[np.ndarray, np.ndarray]:
    """For each entry of a block: where the next block is entered, and the chunks made."""
    n, s, e = (np.asarray(a, dtype=np.float64) for a in (lengths, starts, ends))
    total = len(n)
    used = np.concatenate([[0.0], np.cumsum(n + 1)])
    # First position where the joined text is long enough.
    by_size = np.searchsorted(used, used[:own] + size + 1, side="left") - 1
    last = np.minimum(by_size, total - 1)
    timed = np.ones(own, dtype=bool) if not zero_start_compat else s[:own] != 0
    open_ = np.nonzero(timed)[0]
    for step in range(reach + 1):
        at = open_ + step
        live = at < np.minimum(last[open_], total)
        open_, at = open_[live], at[live]
        if len(open_) == 0:
            break
        hit = e[at] - s[open_] >= cap
        last[open_[hit]] = at[hit]
        open_ = open_[~hit]
    following = (last + 1).tolist()
    exits, counts = [0] * own, [0] * own
    for i in range(own - 1, -1, -1):
        j = following[i]
        exits[i], counts[i] = (j - own, 1) if j >= own else (exits[j], counts[j] + 1)
    pad = max(reach - own, 0)
    return (
        np.array(exits[:reach] + [0] * pad, dtype=np.float64),
        np.array(counts[:reach] + [0] * pad, dtype=np.int64),
    )


def _step_jump(state: float, row) -> tuple[float, int]:
    e = int(state)
    return float(row.exits[e]), int(row.counts[e])


def _compose_jumps(rows: list) -> tuple[list, list, list]:
    at = np.arange(len(rows[0].exits))
    made = np.zeros(len(at), dtype=np.int64)
    for row in rows:
        made += np.asarray(row.counts)[at]
        at = np.asarray(row.exits).astype(np.int64)[at]
    return [], at.astype(np.float64).tolist(), made.tolist()


def _ddl(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def _chain(
    table: DataFrame,
    keys: list[str],
    key_types: str,
    compose,
    step,
    first_state: float,
    super_blocks: int,
) -> DataFrame:
    """True entry and number of earlier chunks of each block ``(*keys, block, entry, base)``.

    Two levels: tables of neighbouring blocks are merged into one, the merged ones are
    walked per video, and then the blocks inside each of them.
    """
    table = table.withColumn("sb", F.floor(F.col("block") / super_blocks))
    up = [*keys, "sb"]

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(pdf.sort_values("block").itertuples(index=False))
        vals, exits, counts = compose(rows)
        out = pdf[up].head(1).copy()
        out["block"] = out["sb"]
        return out.drop(columns="sb").assign(vals=[vals], exits=[exits], counts=[counts])

    def walk(pdf: pd.DataFrame, state: float, base: int) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        entries, bases = [], []
        for row in pdf.itertuples(index=False):
            entries.append(state)
            bases.append(base)
            state, made = step(state, row)
            base += made
        return pdf[[*keys, "block"]].assign(entry=entries, base=bases)

    walked = f"{key_types}, block long, entry double, base long"
    merged = table.groupBy(*up).applyInPandas(merge, f"{key_types}, {TABLE}")
    tops = merged.groupBy(*keys).applyInPandas(lambda pdf: walk(pdf, first_state, 0), walked)
    tops = tops.withColumnRenamed("block", "sb")
    inside = table.join(tops, up)
    return inside.groupBy(*up).applyInPandas(
        lambda pdf: walk(pdf, float(pdf["entry"].iloc[0]), int(pdf["base"].iloc[0])), walked
    )


def chunk_rows_fixed(
    segments: DataFrame,
    keys: list[str],
    duration: float = FIXED_DURATION,
    idx: str = "seg_idx",
    block_rows: int = BLOCK_ROWS,
    super_blocks: int = SUPER_BLOCKS,
) -> DataFrame:
    """Chunks ``(*keys, chunk_index, text, start, end)``; closes before appending.

    The only state is the start of the open chunk, and only a segment that starts later
    than all before it can open a chunk, so a block's table lists few segments.
    """
    groups = _groups(segments, keys, idx, F.lit(0.0), block_rows)
    video = Window.partitionBy(*keys)
    latest = groups.select(
        *keys, "block", F.array_max(F.transform("segs", lambda s: s["start"])).alias("latest")
    )
    before = video.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = latest.select(
        *keys,
        "block",
        F.count("*").over(video).alias("n_blocks"),
        F.max("latest").over(before).alias("before"),
    )
    located = groups.join(blocks, [*keys, "block"])
    single = explode_chunks(
        located.where("n_blocks = 1"), fold_segments_fixed(F.col("segs"), duration), *keys
    )
    several = located.where("n_blocks > 1")

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [openings(s, b, duration) for s, b in zip(pdf["s"], pdf["before"])]
            yield pdf[[*keys, "block"]].assign(
                vals=[o[0] for o in out], exits=[o[1] for o in out], counts=[o[2] for o in out]
            )

    slim = several.select(
        *keys,
        "block",
        F.coalesce("before", F.lit(float("-inf"))).alias("before"),
        F.transform("segs", lambda s: s["start"]).alias("s"),
    )
    key_types = _ddl(segments, keys)

    def step(state: float, row) -> tuple[float, int]:
        k = _first_after(row.vals, state, duration)
        return (state, 0) if k < 0 else (float(row.exits[k]), int(row.counts[k]))

    def compose(rows: list) -> tuple[list, list, list]:
        vals, exits, counts = [], [], []
        for i, row in enumerate(rows):
            for k, v in enumerate(row.vals):
                state, made = float(row.exits[k]), int(row.counts[k])
                for later in rows[i + 1 :]:
                    state, more = step(state, later)
                    made += more
                vals.append(float(v))
                exits.append(state)
                counts.append(made)
                # Entries opened before vals[0], so a value at vals[0] + duration or later
                # is reached by all of them and nothing behind it can be first.
                if v - vals[0] >= duration:
                    return vals, exits, counts
        return vals, exits, counts

    table = slim.mapInPandas(tables, f"{key_types}, {TABLE}")
    entries = _chain(table, keys, key_types, compose, step, float("-inf"), super_blocks)
    parts = several.join(entries, [*keys, "block"]).select(
        *keys, "block", F.explode(_parts(F.col("segs"), "entry", "base", duration)).alias("part")
    )
    # A chunk may run over a block border: its parts meet per chunk, in block order.
    pieces = F.array_sort(F.collect_list(F.struct("block", "part")))
    multi = (
        parts.groupBy(*keys, F.col("part.cid").alias("cid"))
        .agg(pieces.alias("pieces"))
        .select(
            *keys,
            F.col("cid").cast("int").alias("chunk_index"),
            F.array_join(F.transform("pieces", lambda p: p["part"]["text"]), " ").alias("text"),
            F.get("pieces", F.lit(0))["part"]["start"].alias("start"),
            F.element_at("pieces", -1)["part"]["end"].alias("end"),
        )
    )
    return single.unionByName(multi)


def _first_after(vals, state: float, duration: float) -> int:
    for k, v in enumerate(vals):
        if v - state >= duration:
            return k
    return -1


def openings(starts, before: float, duration: float) -> tuple[list, list, list]:
    """Segments of a block that may open its first chunk: start, the start of the last
    chunk opened after it within the block, and the number of chunks opened."""
    s = np.asarray(starts, dtype=np.float64)
    top = np.maximum.accumulate(np.concatenate([[before], s]))
    records = s[s > top[:-1]]
    exits, counts = records.copy(), np.ones(len(records), dtype=np.int64)
    after = np.searchsorted(records, records + duration, side="left")
    for i in range(len(records) - 1, -1, -1):
        j = int(after[i])
        # The sum may round across the border that the difference decides.
        while j > i + 1 and records[j - 1] - records[i] >= duration:
            j -= 1
        while j < len(records) and records[j] - records[i] < duration:
            j += 1
        if j < len(records):
            exits[i], counts[i] = exits[j], counts[j] + 1
    # Entries opened after ``before - duration``, so one start at ``before + duration`` or
    # later is reached by all of them and nothing behind it can be first.
    sure = np.nonzero(records - before >= duration)[0]
    n = len(records) if len(sure) == 0 else int(sure[0]) + 1
    if before == float("-inf"):
        n = min(n, 1)
    return records[:n].tolist(), exits[:n].tolist(), counts[:n].tolist()


def _parts(segs: Column, entry: str, base: str, duration: float) -> Column:
    """Pieces of chunks inside one block, numbered over the whole video."""
    zero = F.struct(
        F.array().cast("array<struct<cid:bigint,first:int>>").alias("runs"),
        F.col(entry).alias("start"),
        (F.col(base) - 1).cast("bigint").alias("cid"),
    )

    def step(acc: Column, s: Column) -> Column:
        opens = s["start"] - acc["start"] >= duration
        cid = F.when(opens, acc["cid"] + 1).otherwise(acc["cid"])
        fresh = opens | (F.size(acc["runs"]) == 0)
        run = F.struct(cid.alias("cid"), s["i"].alias("first"))
        return F.struct(
            F.when(fresh, F.concat(acc["runs"], F.array(run))).otherwise(acc["runs"]).alias("runs"),
            F.when(opens, s["start"]).otherwise(acc["start"]).alias("start"),
            cid.alias("cid"),
        )

    slim = F.transform(segs, lambda s, i: F.struct(i.alias("i"), s["start"].alias("start")))
    runs = F.aggregate(slim, zero, step, lambda acc: acc["runs"])

    def one(rs: Column) -> Column:
        def piece(r: Column, i: Column) -> Column:
            stop = F.coalesce(F.get(rs, i + 1)["first"], F.size(segs))
            return F.struct(
                r["cid"].alias("cid"),
                F.array_join(texts_between(segs, r["first"], stop - 1), " ").alias("text"),
                F.get(segs, r["first"])["start"].alias("start"),
                F.get(segs, stop - 1)["end"].alias("end"),
            )

        return F.transform(rs, piece)

    return let(runs, one)
