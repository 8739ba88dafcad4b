"""Text functions. All of them stay inside the JVM (built-in expressions only)."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters that Unicode-aware text processing treats as blank.
WHITESPACE = "".join(
    map(
        chr,
        [
            *range(0x09, 0x0E),
            *range(0x1C, 0x21),
            0x85,
            0xA0,
            0x1680,
            *range(0x2000, 0x200B),
            0x2028,
            0x2029,
            0x202F,
            0x205F,
            0x3000,
        ],
    )
)

# The same set inside a regex character class. Those below U+0100 stand one by one, as Java looks
# such up in one bit set and asks ranges one after the other; one range test rules out other letters.
WS = (
    "".join(rf"\x{{{ord(c):x}}}" for c in WHITESPACE if ord(c) < 0x100)
    + r"[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]"
)

# Decimal digits of all scripts and what they stand for, from the character database.
_DIGITS = [chr(c) for c in range(0x660, sys.maxunicode + 1) if chr(c).isdecimal()]
DIGITS, ASCII_DIGITS = "".join(_DIGITS), "".join(str(int(c)) for c in _DIGITS)

BULLET = rf"[{WS}]*[-•][{WS}]+"
STEP = rf"[{WS}]*\p{{Nd}}+\.[{WS}]+"
SOURCE_LINK = r"\[source\]\([^)]+\)"
SPAN = r"\[(\p{Nd}+)-(\p{Nd}+)\]"

SNIPPET_CHARS = 500
#: Characters at the beginning of a text that tell of most texts that they are not blank.
BLANK_CHARS = 64


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(s: Column | str) -> Column:
    """Trim every Unicode blank on both sides; no regex, so linear in the blanks."""
    return F.btrim(col(s), F.lit(WHITESPACE))


def to_number(s: Column, kind: str) -> Column:
    """Number of a run of digits of any script, null when there is none."""
    return F.nullif(F.translate(s, DIGITS, ASCII_DIGITS), F.lit("")).try_cast(kind)


def is_blank(s: Column | str) -> Column:
    """Null, empty or blanks only. Trimming looks at every character, so a text is trimmed as a
    whole only if its beginning is blank."""
    begins = strip(F.substring(col(s), 1, BLANK_CHARS)) != ""
    return F.when(begins, F.lit(False)).otherwise(F.coalesce(strip(s), F.lit("")) == "")


def word_count(s: Column | str) -> Column:
    """Number of blank-separated tokens (splitting is several times faster than counting
    regex matches, which builds every match). Blanks at an end leave an empty part there, which
    is cheaper to take off than to trim the text."""

    def count(parts: Column) -> Column:
        n = F.size(parts)
        first, last = F.get(parts, F.lit(0)) == "", (n > 1) & (F.get(parts, n - 1) == "")
        return n - first.cast("int") - last.cast("int")

    return let(F.split(col(s), f"[{WS}]+"), count)


def snippet(s: Column | str, n: int = SNIPPET_CHARS) -> Column:
    """First ``n`` characters, trimmed, on one line (in this order)."""
    return F.replace(strip(F.substring(col(s), 1, n)), F.lit("\n"), F.lit(" "))


def preview(s: Column | str, n: int = 120) -> Column:
    """First ``n`` characters on one line."""
    return F.replace(F.substring(F.coalesce(col(s), F.lit("")), 1, n), F.lit("\n"), F.lit(" "))


def unfence_json(s: Column | str) -> Column:
    """Text of a fenced JSON reply: its ``transcription`` field, else the text itself.

    The candidate is parsed inside a one-element array so that several objects in a
    row do not pass as one.
    """
    s = col(s)
    body = F.regexp_extract(s, r"(?s)\{.*\}", 0)
    parsed = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]")))
    inner = let(
        parsed,
        lambda v: F.when(
            F.try_variant_get(v, "$[1]", "variant").isNull(),
            F.try_variant_get(v, "$[0].transcription", "string"),
        ),
    )
    return F.when(s.contains("```json") & (body != ""), F.coalesce(inner, s)).otherwise(s)


def clean_chunk_text(s: Column | str, n: int = SNIPPET_CHARS) -> Column:
    """Unfence, one line, one pass of double to single blanks, trim, cut."""
    flat = F.replace(unfence_json(s), F.lit("\n"), F.lit(" "))
    return F.substring(strip(F.replace(flat, F.lit("  "), F.lit(" "))), 1, n)


def strip_sources(s: Column | str) -> Column:
    return strip(F.regexp_replace(col(s), SOURCE_LINK, ""))


def format_answer(s: Column | str) -> Column:
    """Put bullets and numbered steps on their own lines."""
    bullets = F.regexp_replace(col(s), BULLET, "\n• ")
    steps = F.regexp_replace(bullets, STEP, "\n$0")
    return strip(F.regexp_replace(steps, r"\n+", "\n"))


def source_label(title: Column | str, video_url: Column | str, label_by_id: bool = False) -> Column:
    """Human-readable source of a chunk.

    ``label_by_id`` labels watch-style links by their video id; the default cuts the
    query string first and therefore labels them by the last path part.
    """
    title, url = col(title), col(video_url)
    tail = F.element_at(F.split(F.split_part(url, F.lit("?"), F.lit(1)), "/"), -1)
    if label_by_id:
        from talkmill.functions.urls import youtube_video_id

        tail = F.coalesce(youtube_video_id(url), tail)
    hosted = url.contains("youtu.be") | url.contains("youtube.com")
    return (
        F.when((title != "") & (title != "Unknown"), title)
        .when((url != "") & hosted, F.concat(F.lit("YouTube Video ("), tail, F.lit(")")))
        .when(url != "", F.concat(F.lit("Video ("), F.element_at(F.split(url, "/"), -1), F.lit(")")))
        .otherwise("Unknown")
    )


def span_start(source: Column | str) -> Column:
    """Start second of a source name such as ``name [120-180]``."""
    return to_number(F.regexp_extract(col(source), SPAN, 1), "double")


def span_end(source: Column | str) -> Column:
    return to_number(F.regexp_extract(col(source), SPAN, 2), "double")


def mmss(seconds: Column | str) -> Column:
    whole = F.floor(col(seconds)).cast("int")
    return F.format_string("%02d:%02d", F.floor(whole / 60).cast("int"), whole % 60)


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def source_name(source: Column | str) -> Column:
    """File name of a source label: everything before the first bracket, trimmed.

    A label is first cut at ``" ["``; a bracket that is left cuts again.
    """
    head = strip(F.split_part(F.coalesce(col(source), F.lit("")), F.lit(" ["), F.lit(1)))
    return F.when(head.contains("["), strip(F.split_part(head, F.lit("["), F.lit(1)))).otherwise(head)


def or_unknown(s: Column | str) -> Column:
    return F.coalesce(F.nullif(col(s), F.lit("")), F.lit("Unknown"))
