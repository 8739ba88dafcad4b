"""Chunking expressions: timed segments or plain text to ``array<struct<text,start,end>>``.

Everything here is an expression over one row (one transcript), so chunking needs no
shuffle and runs unchanged on a stream. Segments that arrive one per row are handled in
``talkmill.operators.segment_rows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.functions.text import col, let, strip
from talkmill.functions.timing import has_inline_timestamps, parse_inline_timestamps

CHUNKS_TYPE = "array<struct<text:string,start:double,end:double>>"

CHUNK_SIZE, OVERLAP, MAX_DURATION = 1000, 200, 60.0
LOOM_CHUNK_SIZE, LOOM_MAX_DURATION = 600, 30.0
FIXED_DURATION, FIXED_CHUNK_SIZE, FIXED_OVERLAP = 30.0, 500, 50
SENTENCE_LOOKBACK = 100
WINDOWS_AT_A_TIME = 128


def _clean(segments: Column, missing_end: Column | None = None) -> Column:
    """Trimmed non-blank segments; a missing end becomes the start unless told otherwise."""

    def one(s: Column) -> Column:
        start = F.coalesce(s["start"], F.lit(0.0))
        return F.struct(
            strip(F.coalesce(s["text"], F.lit(""))).alias("text"),
            start.alias("start"),
            F.coalesce(s["end"], start if missing_end is None else missing_end).alias("end"),
        )

    return F.filter(F.transform(segments, one), lambda s: s["text"] != "")


def texts_between(segs: Column, first: Column, last: Column) -> Column:
    """Texts at positions ``first`` to ``last``. Picks them one by one: a slice would copy
    the whole array each time."""
    return F.transform(F.sequence(first, last), lambda i: F.get(segs, i)["text"])


def _spans_to_chunks(segs: Column, spans: Column, clamp: bool) -> Column:
    """Join the texts of each ``[first, last]`` index span."""

    def one(span: Column) -> Column:
        first, last = F.get(segs, span["first"]), F.get(segs, span["last"])
        texts = texts_between(segs, span["first"], span["last"])
        start = F.greatest(F.lit(0.0), first["start"]) if clamp else first["start"]
        end = F.greatest(first["start"], last["end"]) if clamp else last["end"]
        return F.struct(
            F.array_join(texts, " ").alias("text"), start.alias("start"), end.alias("end")
        )

    return F.transform(spans, one)


def flush_after(
    length: Column, start: Column, end: Column, size: int, cap: float, zero_start_compat: bool
) -> Column:
    """Does a chunk of this length and span close after the segment just added?

    With ``zero_start_compat`` a chunk starting exactly at 0 never reaches the time cap.
    """
    duration = end - (F.when(start != 0, start).otherwise(end) if zero_start_compat else start)
    return (length >= size) | (duration >= cap)


def fold_segments(
    segments: Column | str,
    chunk_size: int = CHUNK_SIZE,
    max_duration: float = MAX_DURATION,
    zero_start_compat: bool = True,
) -> Column:
    """Ordered fold: append a segment, then close the chunk when it is long enough."""

    def step(acc: Column, s: Column) -> Column:
        fresh = acc["n"] == 0
        length = F.when(fresh, s["n"]).otherwise(acc["n"] + 1 + s["n"])
        start = F.when(fresh, s["start"]).otherwise(acc["start"])
        first = F.when(fresh, s["i"]).otherwise(acc["first"])
        done = flush_after(length, start, s["end"], chunk_size, max_duration, zero_start_compat)
        span = F.struct(first.alias("first"), s["i"].alias("last"))
        return F.struct(
            F.when(done, F.concat(acc["spans"], F.array(span)))
            .otherwise(acc["spans"])
            .alias("spans"),
            F.when(done, F.lit(0)).otherwise(length).alias("n"),
            start.alias("start"),
            first.alias("first"),
        )

    def build(segs: Column) -> Column:
        zero = F.struct(
            F.array().cast("array<struct<first:int,last:int>>").alias("spans"),
            F.lit(0).alias("n"),
            F.lit(0.0).alias("start"),
            F.lit(0).alias("first"),
        )
        slim = F.transform(
            segs,
            lambda s, i: F.struct(
                i.alias("i"),
                F.length(s["text"]).alias("n"),
                s["start"].alias("start"),
                s["end"].alias("end"),
            ),
        )
        tail = F.size(segs) - 1
        spans = F.aggregate(
            slim,
            zero,
            step,
            lambda acc: F.when(
                acc["n"] > 0,
                F.concat(
                    acc["spans"],
                    F.array(F.struct(acc["first"].alias("first"), tail.alias("last"))),
                ),
            ).otherwise(acc["spans"]),
        )
        return _spans_to_chunks(segs, spans, clamp=True)

    return let(_clean(col(segments)), build)


def fold_segments_fixed(segments: Column | str, duration: float = FIXED_DURATION) -> Column:
    """Close the chunk *before* a segment that starts ``duration`` after the chunk did."""

    def step(acc: Column, s: Column) -> Column:
        opens = (F.size(acc["firsts"]) == 0) | (s["start"] - acc["start"] >= duration)
        return F.struct(
            F.when(opens, F.concat(acc["firsts"], F.array(s["i"])))
            .otherwise(acc["firsts"])
            .alias("firsts"),
            F.when(opens, s["start"]).otherwise(acc["start"]).alias("start"),
        )

    def build(segs: Column) -> Column:
        zero = F.struct(F.array().cast("array<int>").alias("firsts"), F.lit(0.0).alias("start"))
        slim = F.transform(
            segs, lambda s, i: F.struct(i.alias("i"), s["start"].alias("start"))
        )
        firsts = F.aggregate(slim, zero, step, lambda acc: acc["firsts"])
        tail = F.size(segs)
        spans = let(
            firsts,
            lambda f: F.transform(
                f,
                lambda first, i: F.struct(
                    first.alias("first"),
                    (F.coalesce(F.get(f, i + 1), tail) - 1).alias("last"),
                ),
            ),
        )
        return _spans_to_chunks(segs, spans, clamp=False)

    return let(_clean(col(segments), missing_end=F.lit(0.0)), build)


def check_window(chunk_size: int, overlap: int) -> int:
    """Smallest step between two windows; it must be positive or windows never end."""
    step = chunk_size - (SENTENCE_LOOKBACK - 2) - overlap
    if step <= 0:
        raise ValueError("overlap must be smaller than chunk_size - 98")
    return step


def chunk_text(text: Column | str, chunk_size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> Column:
    """Overlapping character windows that prefer to end at a sentence.

    A window that does not reach the end of the text is cut after the last of ``.!?``
    within its last 100 characters (the character after the window included).
    """
    min_step = check_window(chunk_size, overlap)
    lookback = min(SENTENCE_LOOKBACK, chunk_size)
    # Positions are found in fixed-size pieces of the text, not in the whole of it:
    # a window spans at most two pieces, so the work stays linear in the text length.
    piece = max(1024, chunk_size + 1)

    def windows(doc: Column) -> Column:
        pieces, n = doc["pieces"], doc["n"]

        def step(acc: Column, _: Column) -> Column:
            pos = acc["pos"]
            k = F.floor(pos / piece).cast("int")
            near = F.concat(F.get(pieces, k), F.coalesce(F.get(pieces, k + 1), F.lit("")))
            at = pos - k * piece

            def cut(window: Column) -> Column:
                tail = F.substr(window, at + (chunk_size + 2 - lookback), F.lit(lookback))
                back = F.instr(F.reverse(F.translate(tail, "!?", "..")), F.lit("."))
                length = F.when(
                    (pos + chunk_size < n) & (back > 0), F.lit(chunk_size + 2) - back
                ).otherwise(F.lit(chunk_size))
                # Windows gather in short arrays, as an array is copied when it grows.
                full = F.size(acc["texts"]) >= WINDOWS_AT_A_TIME
                none = F.array().cast("array<string>")
                return let(
                    length,
                    lambda m: F.struct(
                        F.when(full, F.concat(acc["done"], F.array(acc["texts"]))).otherwise(acc["done"]).alias("done"),
                        F.concat(
                            F.when(full, none).otherwise(acc["texts"]),
                            F.array(strip(F.substr(window, at + 1, m))),
                        ).alias("texts"),
                        (pos + m - overlap).cast("int").alias("pos"),
                    ),
                )

            return F.when(pos < n, let(near, cut)).otherwise(acc)

        rounds = F.ceil(n / min_step).cast("int") + 1
        zero = F.struct(
            F.array().cast("array<array<string>>").alias("done"),
            F.array().cast("array<string>").alias("texts"),
            F.lit(0).alias("pos"),
        )
        every = lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["texts"])))
        texts = F.aggregate(F.sequence(F.lit(1), rounds), zero, step, every)
        return F.transform(
            F.filter(texts, lambda x: x != ""),
            lambda x: F.struct(
                x.alias("text"), F.lit(0.0).alias("start"), F.lit(0.0).alias("end")
            ),
        )

    text = F.coalesce(col(text), F.lit(""))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{piece}}}"), 0)
    return let(F.struct(pieces.alias("pieces"), F.length(text).alias("n")), windows)


def choose_chunks(
    text: Column | str,
    segments: Column | str,
    chunk_size: int = CHUNK_SIZE,
    overlap: int = OVERLAP,
    max_duration: float = MAX_DURATION,
    inline_timestamps: bool = True,
    zero_start_compat: bool = True,
) -> Column:
    """Timed segments if there are any, else inline timestamps, else character windows."""
    text, segments = col(text), col(segments)
    picked = F.when(
        F.size(F.coalesce(segments, F.array().cast(CHUNKS_TYPE))) > 0,
        fold_segments(segments, chunk_size, max_duration, zero_start_compat),
    )
    if inline_timestamps:
        picked = picked.when(has_inline_timestamps(text), parse_inline_timestamps(text))
    return picked.otherwise(chunk_text(text, chunk_size, overlap))


def choose_chunks_fixed(text: Column | str, segments: Column | str) -> Column:
    """The light variant: fixed 30 s chunks, else small character windows."""
    text, segments = col(text), col(segments)
    return F.when(
        F.size(F.coalesce(segments, F.array().cast(CHUNKS_TYPE))) > 0,
        fold_segments_fixed(segments),
    ).otherwise(chunk_text(text, FIXED_CHUNK_SIZE, FIXED_OVERLAP))


def explode_chunks(df: DataFrame, chunks: Column, *keep: str | Column) -> DataFrame:
    """One row per chunk with its 0-based position; no window is needed for the index.

    The outer form with a filter behind it: under the plain form Spark puts ``size(chunks) > 0``
    below the cut, which makes all chunks anew for the test and once more for the rows.
    """
    return (
        df.select(*keep, F.posexplode_outer(chunks).alias("chunk_index", "chunk"))
        .where("chunk_index is not null")
        .select("*", "chunk.text", "chunk.start", "chunk.end")
        .drop("chunk")
    )
