"""Chunking of live captions: one segment per row, in any order within the watermark.

A segment is folded as soon as all before it are, or as soon as the watermark says that those
missing will not come any more. Until then it waits in a buffer, kept in blocks of segment numbers
in map state. A task reads a video's rows part by part and keeps a bounded number of waiting
ones at hand; the rest goes to the blocks."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from talkmill.functions.text import WHITESPACE
from talkmill.operators.chunking import CHUNK_SIZE, MAX_DURATION

OUTPUT = T.StructType(
    [
        T.StructField("video_url", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("start", T.DoubleType()),
        T.StructField("end", T.DoubleType()),
    ]
)
STATE = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("start", T.DoubleType()),
        T.StructField("end", T.DoubleType()),
        T.StructField("next_index", T.IntegerType()),
        T.StructField("last_idx", T.LongType()),
        T.StructField("timer", T.LongType()),
        T.StructField("idle_at", T.LongType()),
        T.StructField("blocks", T.StringType()),
    ]
)
BLOCK_KEY = T.StructType([T.StructField("block", T.LongType())])
BLOCK_ROWS = T.StructType([T.StructField("rows", T.StringType())])
CHUNK, LATE = "chunk", "late"
OUT = Row(*OUTPUT.names)
NOTHING_OPEN = ("", 0.0, 0.0, 0, -1, 0, 0, "")
#: Segment numbers that share an entry of the buffer.
BLOCK = 256
#: Waiting segments that a task keeps at hand before they go to the buffer.
AT_HAND = 4_096


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB; the setting is put back after."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class Fold:
    """One video while its rows or a timer are handled: the open chunk, the waiting segments at
    hand, and the blocks of the buffer. Segments are ``(text, start, end, is_last, event_ms)``."""

    def __init__(self, owner: LiveChunker, key: tuple, watermark: int):
        self.owner, self.key, self.watermark = owner, key, watermark
        state = owner.open.get() or NOTHING_OPEN
        self.text, self.start, self.end, self.index, self.last, self.timer, self.idle_at, blocks = state
        self.blocks = {int(b) for b in blocks.split(",") if b}
        self.waiting: dict[int, tuple] = {}
        self.out: list[tuple] = []

    def late(self, segment: tuple) -> None:
        self.out.append((self.key[0], LATE, None, *segment[:3]))

    def take(self, idx: int, segment: tuple) -> None:
        if idx <= self.last or idx in self.waiting:
            self.late(segment)
        elif idx == self.last + 1:
            self.fold(idx, segment)
        else:
            self.waiting[idx] = segment

    def fold(self, idx: int, segment: tuple) -> None:
        """The rule of the batch fold, for the next segment."""
        said, s, e, is_last, _ = segment
        owner, full, self.last = self.owner, False, idx
        said = (said or "").strip(WHITESPACE)
        if said:
            s = 0.0 if s is None or s != s else s
            self.end = s if e is None or e != e else e
            self.start, self.text = (self.start, f"{self.text} {said}") if self.text else (s, said)
            timed = self.start != 0 or not owner.zero_start_compat
            full = len(self.text) >= owner.size or (timed and self.end - self.start >= owner.cap)
        if self.text and (full or is_last):
            self.close()

    def close(self) -> None:
        times = (max(0.0, self.start), max(self.start, self.end))
        self.out.append((self.key[0], CHUNK, self.index, self.text, *times))
        self.text, self.index = "", self.index + 1

    def load(self, block: int) -> None:
        """Segments of a block from the buffer to those at hand."""
        self.blocks.discard(block)
        rows = json.loads(self.owner.held.getValue((block,))[0])
        self.owner.held.removeKey((block,))
        for idx, *segment in rows:
            if idx <= self.last or idx in self.waiting:
                self.late(segment)
            else:
                self.waiting[idx] = tuple(segment)

    def drain(self) -> None:
        """Fold what follows the last folded segment without a gap."""
        while True:
            following = self.last + 1
            if following not in self.waiting:
                if following // BLOCK not in self.blocks:
                    return
                self.load(following // BLOCK)
                if following not in self.waiting:
                    return
            self.fold(following, self.waiting.pop(following))

    def release(self) -> None:
        """Fold over gaps that the watermark has closed: the first waiting segment, while nothing
        before it can come any more."""
        self.drain()
        while self.waiting or self.blocks:
            at_hand = min(self.waiting, default=None)
            if self.blocks and (at_hand is None or min(self.blocks) <= at_hand // BLOCK):
                self.load(min(self.blocks))
                continue
            if self.waiting[at_hand][-1] > self.watermark:
                return
            self.fold(at_hand, self.waiting.pop(at_hand))
            self.drain()

    def put_away(self) -> None:
        """All segments at hand to the buffer."""
        parts: dict[int, list] = {}
        for idx in sorted(self.waiting):
            parts.setdefault(idx // BLOCK, []).append((idx, *self.waiting[idx]))
        for block, rows in parts.items():
            if block in self.blocks:
                rows = json.loads(self.owner.held.getValue((block,))[0]) + rows
            self.owner.held.updateValue((block,), (json.dumps(rows),))
            self.blocks.add(block)
        self.waiting = {}

    def given_out(self) -> list[tuple]:
        out, self.out = self.out, []
        return out

    def finish(self) -> None:
        """Timer and state. The first waiting segment is due when the watermark reaches it."""
        self.release()
        due = [self.waiting[min(self.waiting)][-1]] if self.waiting else []
        self.put_away()
        if self.text:
            due.append(self.idle_at)
        # The timer is kept in the state: asking for the timers of a key costs a call, and so does
        # setting one. One that comes too early sets the next.
        wanted = max(min(due), self.watermark + 1) if due else 0
        if wanted and not self.watermark < self.timer <= wanted:
            if self.timer:
                self.owner.handle.deleteTimer(self.timer)
            self.owner.handle.registerTimer(wanted)
            self.timer = wanted
        blocks = ",".join(map(str, sorted(self.blocks)))
        self.owner.open.update(
            (self.text, self.start, self.end, self.index, self.last, self.timer, self.idle_at, blocks)
        )


class LiveChunker(StatefulProcessor):
    """State per video: the open chunk, the number of the last segment folded, and the buffer. A
    chunk is emitted by the same rule as in the batch fold, at the end mark of the video, or after
    a time without new segments. Segments that come when a later one has been folded are given
    out as ``late`` rows instead of being folded in the wrong place; so are repeated numbers."""

    def __init__(self, size: int, cap: float, zero_start_compat: bool, idle_ms: int):
        self.size, self.cap = size, cap
        self.zero_start_compat, self.idle_ms = zero_start_compat, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", STATE)
        self.held = handle.getMapState("held", BLOCK_KEY, BLOCK_ROWS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        parts = (_segments(part) for part in rows)
        yield from map(_frame, self.folded(key, parts, timerValues.getCurrentWatermarkInMs()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from map(_frame, self.released(key, timerValues.getCurrentWatermarkInMs()))

    def folded(self, key, parts: Iterator[list[tuple]], watermark: int) -> Iterator[list[tuple]]:
        """What parts ``(seg_idx, text, start, end, is_last, event_ms)`` of a video give out."""
        video = Fold(self, key, watermark)
        newest = watermark
        for part in parts:
            newest = max(newest, max(segment[-1] for segment in part))
            for idx, *segment in sorted(part, key=lambda segment: segment[0]):
                video.take(int(idx), tuple(segment))
            video.drain()
            if len(video.waiting) > AT_HAND:
                video.put_away()
            if video.out:
                yield video.given_out()
        video.idle_at = newest + self.idle_ms
        video.finish()
        if video.out:
            yield video.given_out()

    def released(self, key, watermark: int) -> Iterator[list[tuple]]:
        video = Fold(self, key, watermark)
        video.timer = 0
        video.release()
        if video.text and not video.waiting and not video.blocks and video.idle_at <= video.watermark:
            video.close()
        video.finish()
        if video.out:
            yield video.given_out()

    def close(self) -> None:
        pass


class LiveRowChunker(LiveChunker):
    """The same on plain rows: a frame for each video costs more than its few segments do. Spark puts
    what a video gives out in one micro-batch into one record batch."""

    def handleInputRows(self, key, rows: Iterator[Row], timerValues):
        values = ((r.seg_idx, r.text, r.start, r.end, r.is_last, r.event_ms) for r in rows)
        parts = iter(lambda: list(islice(values, AT_HAND)), [])
        for out in self.folded(key, parts, timerValues.getCurrentWatermarkInMs()):
            yield from (OUT(*given) for given in out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        for out in self.released(key, timerValues.getCurrentWatermarkInMs()):
            yield from (OUT(*given) for given in out)


def _segments(part: pd.DataFrame) -> list[tuple]:
    event = part["event_ts"].astype("datetime64[ms]").astype("int64")
    values = (part[c].tolist() for c in ("seg_idx", "text", "start", "end", "is_last"))
    return list(zip(*values, event.tolist()))


def _frame(out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(out, columns=OUTPUT.names).astype({"chunk_index": "Int32"})


def chunk_live_segments(
    segments: DataFrame,
    chunk_size: int = CHUNK_SIZE,
    max_duration: float = MAX_DURATION,
    zero_start_compat: bool = True,
    watermark: str = "10 minutes",
    idle_ms: int = 60_000,
    frames: bool = False,
) -> DataFrame:
    """Stream of chunks (and ``late`` segments) from a stream of
    ``video_url, seg_idx, text, start, end, is_last, event_ts``. Segments are numbered from 0 in
    the order of their times; they may arrive in any order within ``watermark``.

    With ``frames`` a video's chunks leave the task frame by frame, for streams where one micro-batch
    may bring more of one video than fits in memory; many short videos then take longer. Needs the
    RocksDB state store provider (see :func:`rocksdb_state`).
    """
    options = (chunk_size, max_duration, zero_start_compat, idle_ms)
    stream = segments.withWatermark("event_ts", watermark)
    if frames:
        return stream.groupBy("video_url").transformWithStateInPandas(
            LiveChunker(*options), outputStructType=OUTPUT, outputMode="append", timeMode="eventTime"
        )
    # A segment without a time is as old as can be.
    event_ms = F.coalesce(F.unix_millis("event_ts"), F.lit(-(2**63)))
    return (
        stream.withColumn("event_ms", event_ms)
        .groupBy("video_url")
        .transformWithState(
            LiveRowChunker(*options), outputStructType=OUTPUT, outputMode="append", timeMode="eventTime"
        )
    )
