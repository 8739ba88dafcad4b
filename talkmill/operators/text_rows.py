"""Character windows of very long texts, cut in parallel.

Where a window begins depends on where the one before ended, so a text is a chain. Its positions
are dealt into blocks. A window is shorter than ``chunk_size``, so the chain enters a block at one
of its first ``chunk_size`` positions: for each of them a block states where the chain enters the
next block, and how many chunks begin on the way. These tables are put together for groups of
blocks, walked once per text in two levels, and then all blocks cut their windows at once, from
their true entry. No task but the one that reads a text holds more than a group's tables.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.functions.text import WHITESPACE
from talkmill.operators.chunking import (
    CHUNK_SIZE,
    OVERLAP,
    SENTENCE_LOOKBACK,
    check_window,
    chunk_text,
    explode_chunks,
)
from talkmill.session import scratch_dir

#: Texts of more characters are cut in blocks of ``BLOCK_CHARS``; tables meet in groups.
LONG_TEXT = 1 << 20
BLOCK_CHARS = 1 << 16
GROUP_BLOCKS = 64

TERMINATORS = np.array([ord(c) for c in ".!?"], np.uint32)
BLANKS = np.array([ord(c) for c in WHITESPACE], np.uint32)


class Windows:
    """Where windows end, for the positions of one block: ``text`` begins at the block's first
    position and reaches a window beyond its end; ``left`` characters remain of the whole text."""

    def __init__(self, text: str, left: int, chunk_size: int, overlap: int):
        letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.size, self.overlap, self.left = chunk_size, overlap, left
        at = np.where(np.isin(letters, TERMINATORS), np.arange(len(letters)), -1)
        self.last_stop = np.maximum.accumulate(at) if len(at) else at
        self.said = np.concatenate([[0], np.cumsum(~np.isin(letters, BLANKS))])

    def ends(self, pos: np.ndarray) -> np.ndarray:
        end = pos + self.size
        inside = end < self.left
        stop = self.last_stop[np.minimum(end, len(self.last_stop) - 1)]
        lookback = min(SENTENCE_LOOKBACK, self.size)
        return np.where(inside & (stop > end - lookback), stop + 1, end)

    def holds_words(self, pos: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.said[np.minimum(end, len(self.said) - 1)] > self.said[pos]

    def walk(self, entries: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """For each entry: where the chain leaves the first ``length`` positions, counted from
        their end, and how many windows with words begin there."""
        pos, chunks = entries.copy(), np.zeros(len(entries), np.int64)
        length = min(length, self.left)
        while (going := np.flatnonzero(pos < length)).size:
            own = pos[going]
            end = self.ends(own)
            chunks[going] += self.holds_words(own, end)
            pos[going] = end - self.overlap
        return pos - length, chunks


def chunk_text_rows(
    df: DataFrame, key: str, text: str = "text", chunk_size: int = CHUNK_SIZE, overlap: int = OVERLAP,
    long_text: int = LONG_TEXT, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``key, chunk_index, text``: the windows of :func:`chunk_text`, one per row, for texts of any
    length. Texts of up to ``long_text`` characters are cut where they are; longer ones, whose
    ``key`` must be unique and not null, block by block."""
    check_window(chunk_size, overlap)
    if block_chars < chunk_size:
        raise ValueError("a block must hold a window")
    long = F.coalesce(F.length(text), F.lit(0)) > long_text
    short = explode_chunks(df.where(~long), chunk_text(text, chunk_size, overlap), key)
    cut = _cut_blocks(df.where(long).select(key, F.col(text).alias("text")), key, chunk_size, overlap, block_chars)
    return short.select(key, "chunk_index", "text").unionByName(cut)


def _cut_blocks(df: DataFrame, key: str, chunk_size: int, overlap: int, block_chars: int) -> DataFrame:
    spark, kind = df.sparkSession, df.schema[key].dataType.simpleString()
    path = scratch_dir(spark, "text-blocks")

    def deal(batches):
        for batch in batches:
            for name, whole in zip(batch.column(0), batch.column(1)):
                whole = whole.as_py()
                for block, begin in enumerate(range(0, len(whole), block_chars)):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([name.as_py()], batch.schema.types[0]),
                            pa.array([block], pa.int64()),
                            pa.array([len(whole) - begin], pa.int64()),
                            pa.array([whole[begin : begin + block_chars + chunk_size + 1]], pa.string()),
                        ],
                        names=["key", "block", "left", "text"],
                    )

    columns = f"key {kind}, block long, left long, text string"
    df.mapInArrow(deal, columns).repartition(F.xxhash64("key", "block")).write.parquet(path)
    blocks = spark.read.schema(columns).parquet(path)

    def tables(batches):
        entries = np.arange(chunk_size)
        for batch in in_parts(batches):
            left, text = batch.column(2).to_pylist(), batch.column(3)
            out = [Windows(t.as_py(), n, chunk_size, overlap).walk(entries, block_chars) for n, t in zip(left, text)]
            ends = pa.array(np.arange(len(out) + 1, dtype=np.int32) * chunk_size)
            flat = (np.concatenate([x[i] for x in out]).astype(np.int64) for i in (0, 1))
            exits, chunks = (pa.ListArray.from_arrays(ends, pa.array(f)) for f in flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), exits, chunks], names=TABLE)

    table_columns = f"key {kind}, block long, exits array<long>, chunks array<long>"
    steps = blocks.mapInArrow(tables, table_columns)
    group = F.floor(F.col("block") / GROUP_BLOCKS).cast("long").alias("group")

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        exits, chunks = np.arange(chunk_size), np.zeros(chunk_size, np.int64)
        for own_exits, own_chunks in zip(rows["exits"], rows["chunks"]):
            exits, chunks = _after(exits, chunks, np.asarray(own_exits), np.asarray(own_chunks))
        return pd.DataFrame({"key": [rows["key"].iloc[0]], "block": [rows["group"].iloc[0]], "exits": [exits], "chunks": [chunks]})

    def entries_of(rows: pd.DataFrame, entry: int, before: int) -> pd.DataFrame:
        """Entry of each row's table, walking them in order."""
        rows = rows.sort_values("block")
        found = []
        for exits, chunks in zip(rows["exits"], rows["chunks"]):
            found.append((entry, before))
            if entry < len(exits):
                entry, before = int(exits[entry]), before + int(chunks[entry])
        return pd.DataFrame(
            {"key": rows["key"], "block": rows["block"], "entry": [e for e, _ in found], "before": [b for _, b in found]}
        )

    entry_columns = f"key {kind}, block long, entry long, before long"
    steps = steps.withColumn("group", group)
    groups = steps.groupBy("key", "group").applyInPandas(joined, table_columns)
    group_entries = groups.groupBy("key").applyInPandas(lambda rows: entries_of(rows, 0, 0), entry_columns)
    begun = group_entries.select("key", F.col("block").alias("group"), "entry", "before")
    block_entries = (
        steps.join(begun, ["key", "group"])
        .groupBy("key", "group")
        .applyInPandas(lambda rows: entries_of(rows, int(rows["entry"].iloc[0]), int(rows["before"].iloc[0])), entry_columns)
    )

    def cut(batches):
        for batch in in_parts(batches):
            names, indexes, texts = [], [], []
            for name, left, text, pos, index in zip(*(batch.column(i).to_pylist() for i in range(5))):
                windows = Windows(text, left, chunk_size, overlap)
                while pos < min(block_chars, left):
                    end = int(windows.ends(np.array([pos]))[0])
                    said = text[pos:end].strip(WHITESPACE)
                    if said:
                        names.append(name)
                        indexes.append(index)
                        texts.append(said)
                        index += 1
                    pos = end - overlap
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, batch.schema.types[0]), pa.array(indexes, pa.int32()), pa.array(texts, pa.string())],
                names=[key, "chunk_index", "text"],
            )

    return (
        blocks.join(block_entries, ["key", "block"])
        .select("key", "left", "text", "entry", "before")
        .mapInArrow(cut, f"`{key}` {kind}, chunk_index int, text string")
    )


def in_parts(batches):
    """Record batches in slices of ``GROUP_BLOCKS`` blocks, whose tables and texts a task holds at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, GROUP_BLOCKS):
            yield batch.slice(lo, GROUP_BLOCKS)


TABLE = ["key", "block", "exits", "chunks"]


def _after(exits: np.ndarray, chunks: np.ndarray, own_exits: np.ndarray, own_chunks: np.ndarray):
    """The table of some blocks and the block behind them. A chain that has passed the end of
    the text stays where it is."""
    inside = exits < len(own_exits)
    at = np.where(inside, exits, 0)
    return np.where(inside, own_exits[at], exits), chunks + np.where(inside, own_chunks[at], 0)
