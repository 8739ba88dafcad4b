"""From ranked matches to answers. After one grouping by question (at most k rows each)
everything is row-local."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.functions.text import (
    clean_chunk_text,
    col,
    format_answer,
    snippet,
    source_label,
    source_name,
    span_end,
    span_start,
    strip_sources,
    to_number,
)

CONTEXT_CHUNKS, SPAN_CHUNKS = 6, 3
BUFFER_SECONDS = 0.3

# Replies, prompts and the phrases that mark an answer without information.
NOTHING_FOUND = (
    "I couldn't find relevant information to answer your question. "
    "Please try rephrasing or ensure videos have been processed."
)
EMBEDDING_FAILED = "Failed to create question embedding."
ANSWER_FAILED = "Failed to generate answer."
NO_INFO_PHRASES = [
    "I do not have that information",
    "I don't have that information",
    "I do not know",
    "I don't know",
    "no information available",
    "I couldn't find any information",
    "Sorry, I couldn't find",
    "Sorry, I do not have",
    "doesn't contain information",
    "does not contain information",
    "not contain information",
]
RERANK_CLOSING = "Which chunk is most relevant to the question above? Just give the number."
SYSTEM_PROMPT = (
    ". Answer ONLY using the provided video content. If the content does not contain relevant "
    "info, say: 'The provided content doesn't contain information about [topic].' Do NOT use "
    "external knowledge. Return ONLY the following markdown sections in this exact order and "
    "nothing else: \n- TL;DR: <one concise line>\n- Steps:\n  1. <step>\n  2. <step>\n"
    "  3. <step>\n- Notes:\n  - <note>\n  - <note>\nKeep it crisp (roughly 120-180 words total)."
)
SYSTEM_OPENING = "You are a product demo assistant for "
ANSWER_CLOSING = "\n\nRespond using the exact structure above."


def collect_matches(questions: DataFrame, matches: DataFrame) -> DataFrame:
    """One row per question with its ``chunks`` in rank order; empty when nothing matched."""
    grouped = matches.groupBy("question_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "id", "score", "metadata"))).alias("chunks")
    )
    return (
        questions.select("question_id", "company_name", "question")
        .join(grouped, "question_id", "left")
    )


def n_chunks(chunks: Column | str) -> Column:
    return F.coalesce(F.size(col(chunks)), F.lit(0))


def take_first(chunks: Column | str, n: int) -> Column:
    return F.slice(col(chunks), 1, n)


def build_rerank_prompt(question: Column | str, chunks: Column | str) -> Column:
    def entry(c: Column) -> Column:
        m = c["metadata"]
        return F.concat(
            c["rank"].cast("string"),
            F.lit(". ["),
            F.coalesce(m["type"], F.lit("video")),
            F.lit("] "),
            F.coalesce(m["context"], F.lit("")),
            F.lit("\n"),
            snippet(m["text"]),
            F.lit("\n\n"),
        )

    return F.concat(
        F.lit("Question: "),
        col(question),
        F.lit("\n\nHere are the chunks:\n"),
        F.array_join(F.transform(col(chunks), entry), ""),
        F.lit(RERANK_CLOSING),
    )


def pick_reranked(reply: Column | str, count: Column) -> Column:
    """1-based rank named by the reply; 1 when it names none or one out of range."""
    named = to_number(F.regexp_extract(col(reply), r"\p{Nd}+", 0), "bigint")
    return F.when(named.between(1, count), named).otherwise(1).cast("int")


def build_context(chunks: Column | str) -> Column:
    return F.array_join(
        F.transform(
            take_first(chunks, CONTEXT_CHUNKS),
            lambda c: F.concat(F.lit("Video Content: "), clean_chunk_text(c["metadata"]["text"])),
        ),
        "\n\n",
    )


def system_prompt(company: Column | str) -> Column:
    return F.concat(F.lit(SYSTEM_OPENING), col(company), F.lit(SYSTEM_PROMPT))


def user_prompt(context: Column | str, question: Column | str) -> Column:
    return F.concat(
        F.lit("Video Content:\n"),
        col(context),
        F.lit("\n\nQuestion: "),
        col(question),
        F.lit(ANSWER_CLOSING),
    )


def clean_answer(raw: Column | str) -> Column:
    return format_answer(strip_sources(raw))


def source_list(chunks: Column | str, label_by_id: bool = False) -> Column:
    """One label per chunk in rank order, repeats kept."""
    return F.transform(
        col(chunks),
        lambda c: source_label(c["metadata"]["title"], c["metadata"]["video_url"], label_by_id),
    )


def is_no_info_answer(answer: Column | str) -> Column:
    lowered = F.lower(col(answer))
    found = F.lit(False)
    for phrase in NO_INFO_PHRASES:
        found = found | lowered.contains(phrase.lower())
    return found


def has_span(m: Column) -> Column:
    return (F.coalesce(m["start"], F.lit(0.0)) > 0) | (F.coalesce(m["end"], F.lit(0.0)) > 0)


def span_of_candidates(chunks: Column | str, same_video_as: Column | None = None) -> Column:
    """Earliest start and latest end over the first three chunks that have a timestamp.

    The chunks may belong to different videos; ``same_video_as`` keeps those of one.
    """
    timed = F.filter(
        take_first(chunks, SPAN_CHUNKS),
        lambda c: has_span(c["metadata"])
        if same_video_as is None
        else has_span(c["metadata"]) & (c["metadata"]["video_url"] == same_video_as),
    )
    bound = lambda f: F.transform(timed, lambda c: F.coalesce(c["metadata"][f], F.lit(0.0)))
    return F.when(
        F.size(timed) > 0,
        F.struct(
            F.array_min(bound("start")).alias("start"), F.array_max(bound("end")).alias("end")
        ),
    )


def playback_span(best: Column, chunks: Column | str, same_video_only: bool = False) -> Column:
    """Where to start and stop playing: the best chunk, its neighbours, or its source name."""
    start, end = F.coalesce(best["start"], F.lit(0.0)), F.coalesce(best["end"], F.lit(0.0))
    around = span_of_candidates(chunks, best["video_url"] if same_video_only else None)
    named = F.struct(
        F.coalesce(span_start(best["source"]), F.lit(0.0)).alias("start"),
        F.coalesce(span_end(best["source"]), F.lit(0.0)).alias("end"),
    )
    span = F.when(
        (start == 0) & (end == 0), F.coalesce(around, named)
    ).otherwise(F.struct(start.alias("start"), end.alias("end")))

    return with_buffer(span)


def with_buffer(span: Column) -> Column:
    """A short lead-in and lead-out for spans that have a length."""
    longer = span["end"] > span["start"]
    return F.struct(
        F.when(longer, F.greatest(F.lit(0.0), span["start"] - BUFFER_SECONDS))
        .otherwise(span["start"])
        .alias("start"),
        F.when(longer, span["end"] + BUFFER_SECONDS).otherwise(span["end"]).alias("end"),
    )


def resolve_video_url(best: DataFrame, registry: DataFrame, key: str = "question_id") -> DataFrame:
    """Add ``resolved_url``: stored URL, original URL, registry entry, or the source itself.

    ``best`` has a ``best`` metadata struct. Rows that need no lookup, or have no name to look
    up, get a key of their own, so they spread over the join instead of meeting in one group. Of
    several registry entries of one name the one with the last address in byte order counts, as
    for a merge of equal versions.
    """
    m = F.col("best")
    direct = F.coalesce(
        F.nullif(m["video_url"], F.lit("")), F.nullif(m["original_video_url"], F.lit(""))
    )
    named = F.nullif(source_name(m["source"]), F.lit(""))
    alone = F.concat(F.lit("\u0000"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    lookup = F.when(direct.isNull(), F.coalesce(named, alone)).otherwise(alone)
    names = registry.groupBy(F.col("video_name").alias("_name")).agg(
        F.max(F.nullif("video_url", F.lit(""))).alias("_mapped")
    )
    return (
        best.withColumn("_direct", direct)
        .withColumn("_name", lookup)
        .join(names, "_name", "left")
        .withColumn("resolved_url", F.coalesce("_direct", "_mapped", m["source"]))
        .drop("_name", "_direct", "_mapped")
    )


def assemble_answers(
    collected: DataFrame, registry: DataFrame, same_video_only: bool = False
) -> DataFrame:
    """Final answers from ``collected`` plus ``rerank_reply`` and ``raw_answer`` columns, and
    ``unembedded`` where the question's embedding may have failed."""
    count = n_chunks("chunks")
    lost = F.col("unembedded") if "unembedded" in collected.columns else F.lit(False)
    prepared = collected.select(
        "question_id",
        "chunks",
        lost.alias("unembedded"),
        clean_answer("raw_answer").alias("clean"),
        F.get("chunks", pick_reranked("rerank_reply", count) - 1)["metadata"].alias("best"),
    )
    located = resolve_video_url(prepared, registry)
    lost = F.col("unembedded")
    empty = (n_chunks("chunks") == 0) & ~lost
    failed = ~empty & ~lost & F.col("clean").isNull()
    located = located.select(
        "question_id",
        F.when(empty, NOTHING_FOUND).otherwise(F.col("clean")).alias("answer"),
        F.when(empty, F.array().cast("array<string>"))
        .when(~failed & ~lost, source_list("chunks"))
        .alias("sources"),
        (~empty & ~failed & ~lost & ~is_no_info_answer("clean")).alias("_located"),
        "resolved_url",
        playback_span(F.col("best"), "chunks", same_video_only).alias("_span"),
        F.when(lost, EMBEDDING_FAILED).when(failed, ANSWER_FAILED).alias("error"),
    )
    shown = lambda c, name: F.when(F.col("_located"), c).alias(name)
    return located.select(
        "question_id",
        "answer",
        "sources",
        shown(F.col("resolved_url"), "video_url"),
        shown(F.col("_span")["start"], "start"),
        shown(F.col("_span")["end"], "end"),
        "error",
    )
