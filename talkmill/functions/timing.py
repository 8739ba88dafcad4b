"""Clock parsing and segment repair on array or scalar columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talkmill.functions.text import WHITESPACE, WS, col, let, strip, to_number, word_count

SEGMENTS_TYPE = "array<struct<text:string,start:double,end:double>>"

# Inline timestamp formats, tried in this order.
TIMED_LINE = [
    rf"\[\p{{Nd}}{{2}}:\p{{Nd}}{{2}}:\p{{Nd}}{{2}}\][{WS}]*[^\n]+",
    rf"\[\p{{Nd}}{{2}}:\p{{Nd}}{{2}}\][{WS}]*[^\n]+",
    rf"\[\p{{Nd}}+\][{WS}]*[^\n]+",
]


def clock_to_seconds(clock: Column | str) -> Column:
    """``HH:MM:SS``, ``MM:SS`` or ``SS`` to whole seconds; null when not a number."""
    return F.aggregate(
        F.split(col(clock), ":"),
        F.lit(0).cast("long"),
        lambda total, part: total * 60 + to_number(part, "long"),
    )


def has_inline_timestamps(text: Column | str) -> Column:
    text = col(text)
    found = text.rlike(TIMED_LINE[0]) | text.rlike(TIMED_LINE[1]) | text.rlike(TIMED_LINE[2])
    return text.contains("[") & found


def parse_inline_timestamps(text: Column | str) -> Column:
    """Timed lines of a transcript as an array of ``{text,start,end}``.

    The first format that occurs decides for the whole transcript. A line ends where
    the next one starts; the last one gets a length guessed from its text. Row-local,
    so a long transcript never meets a shuffle and the expression also runs on streams.
    """
    text = col(text)
    picked = F.lit(None).cast("array<string>")
    for pattern in reversed(TIMED_LINE):
        picked = F.when(text.rlike(pattern), F.regexp_extract_all(text, F.lit(pattern), 0)).otherwise(
            picked
        )

    def cut(line: Column) -> Column:
        clock = F.substring_index(F.substring_index(line, "]", 1), "[", -1)
        said = F.substr(line, F.instr(line, F.lit("]")) + 1)
        return F.struct(
            strip(said).alias("text"),
            clock_to_seconds(clock).cast("double").alias("start"),
            F.length(F.ltrim(said, F.lit(WHITESPACE))).alias("n"),
        )

    def timed(lines: Column) -> Column:
        def one(line: Column, i: Column) -> Column:
            guess = F.least(F.greatest(F.floor(line["n"] / 15), F.lit(3)), F.lit(20))
            following = F.get(lines, i + 1)["start"]
            return F.struct(
                line["text"].alias("text"),
                line["start"].alias("start"),
                F.coalesce(following, line["start"] + guess).alias("end"),
            )

        return F.transform(lines, one)

    return let(F.transform(picked, cut), timed)


def fill_end(text: Column | str, start: Column | str, end: Column | str) -> Column:
    """End second of recognised speech: guessed at 0.5 s per word when it is not after start."""
    start, end = col(start), F.coalesce(col(end), col(start))
    return F.when(end > start, end).otherwise(
        start + F.greatest(word_count(text) * F.lit(0.5), F.lit(1.0))
    )


def fill_segment_end(segments: Column | str) -> Column:
    """Array form of :func:`fill_end`; also trims the texts."""

    def one(s: Column) -> Column:
        text = strip(F.coalesce(s["text"], F.lit("")))
        start = F.coalesce(s["start"], F.lit(0.0))
        return F.struct(
            text.alias("text"), start.alias("start"), fill_end(text, start, s["end"]).alias("end")
        )

    return F.transform(col(segments), one)


def bounded_end(text: Column, start: Column, end: Column) -> Column:
    """End second for a start already clamped at zero: repaired, then capped at 30 s."""
    repaired = F.when(end > start, end).otherwise(
        start + F.greatest(word_count(text) * F.lit(0.4), F.lit(0.5))
    )
    return F.when(repaired - start > 30, start + 30).otherwise(repaired)


def validate_segments(segments: Column | str) -> Column:
    """Drop blank segments, clamp starts at zero, repair and cap ends."""

    def one(s: Column) -> Column:
        text = strip(F.coalesce(s["text"], F.lit("")))
        raw_start = F.coalesce(s["start"], F.lit(0.0))
        start = F.greatest(raw_start, F.lit(0.0))
        return F.struct(
            text.alias("text"),
            start.alias("start"),
            bounded_end(text, start, F.coalesce(s["end"], raw_start)).alias("end"),
        )

    return F.filter(F.transform(col(segments), one), lambda s: s["text"] != "")


def dropped_lines(text: Column | str) -> Column:
    """Non-blank lines that :func:`parse_inline_timestamps` leaves out: lines before the
    first timestamp and lines in another format."""
    text = col(text)
    rest = text
    for pattern in reversed(TIMED_LINE):
        rest = F.when(text.rlike(pattern), F.regexp_replace(text, pattern, "")).otherwise(rest)
    lines = F.filter(F.split(rest, "\n"), lambda line: strip(line) != "")
    return F.when(has_inline_timestamps(text), F.size(lines)).otherwise(0)
