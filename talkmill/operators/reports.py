"""Request checks, ingest outcomes and quality figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.functions.text import col, is_blank, word_count

# Failure reasons and the messages shown for them.
URL_REQUIRED = "video_url is required"
NO_TRANSCRIPT = "Failed to extract transcription"
EMPTY_TRANSCRIPT = "Empty transcription"
NO_CHUNKS = "Failed to create chunks"
NO_EMBEDDINGS = "Failed to create embeddings"
USER_MESSAGES = [
    (
        "API request failed",
        "Transcription service temporarily unavailable. Please try again in a few minutes.",
    ),
    (
        "Failed to extract transcription",
        "Unable to extract video transcription. "
        "The video may not have captions or may be private.",
    ),
]
TIMEOUT_MESSAGE = "Request timed out. Please try again."
SUGGESTION = "Try again in a few minutes or use a different video"


def classify_error(error: Column | str) -> Column:
    """User-facing message of a raw error; the first rule that fits wins."""
    error = col(error)
    message = F.when(F.lit(False), "")
    for needle, shown in USER_MESSAGES:
        message = message.when(error.contains(needle), shown)
    return message.when(F.lower(error).contains("timeout"), TIMEOUT_MESSAGE).otherwise(error)


def failure_reason(
    video_url: Column | str,
    transcript: Column | str,
    n_chunks: Column | str,
    n_vectors: Column | str,
) -> Column:
    """Why a request fails, null when it does not."""
    text, chunks = col(transcript), F.coalesce(col(n_chunks), F.lit(0))
    return (
        F.when(F.coalesce(col(video_url), F.lit("")) == "", URL_REQUIRED)
        .when(text.isNull(), NO_TRANSCRIPT)
        .when(text == "", EMPTY_TRANSCRIPT)
        .when(chunks == 0, NO_CHUNKS)
        .when(F.coalesce(col(n_vectors), F.lit(0)) != chunks, NO_EMBEDDINGS)
    )


def validate_requests(requests: DataFrame) -> DataFrame:
    """Requests with a ``reason``; null means valid. Bad rows are kept, not thrown."""
    missing = is_blank("company_name")
    return requests.withColumn(
        "reason",
        F.when(F.coalesce("video_url", F.lit("")) == "", URL_REQUIRED).when(
            missing, "company_name is required"
        ),
    )


def chunk_counts(requests: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Requests with their numbers of chunks and vectors (0 when there are none)."""
    keys = ["video_url", "company_name"]
    count = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    return (
        requests.join(count(chunks, "chunks_created"), keys, "left")
        .join(count(vectors, "vectors_stored"), keys, "left")
        .fillna(0, ["chunks_created", "vectors_stored"])
    )


def ingest_report(counted: DataFrame, *more: str) -> DataFrame:
    """One outcome row per request, with the columns named in ``more``. A failure is reported as
    one, with its raw error."""
    reason = failure_reason("video_url", "transcription", "chunks_created", "vectors_stored")
    judged = counted.withColumn("original_error", reason)
    ok = F.col("original_error").isNull()
    known = lambda c: F.when(ok, F.coalesce(F.col(c), F.lit("Unknown"))).alias(c)
    return judged.select(
        "video_url",
        "company_name",
        ok.alias("success"),
        known("title"),
        "chunks_created",
        "vectors_stored",
        F.when(ok, F.col("word_count")).alias("word_count"),
        known("language"),
        F.when(ok, F.col("method")).alias("method"),
        classify_error("original_error").alias("error"),
        "original_error",
        F.when(~ok, SUGGESTION).alias("suggestion"),
        *more,
    )


def timestamp_coverage(chunks: DataFrame, *keys: str) -> DataFrame:
    """How many chunks carry a timestamp."""
    timed = (F.coalesce("start", F.lit(0.0)) > 0) | (F.coalesce("end", F.lit(0.0)) > 0)
    return chunks.groupBy(*keys).agg(
        F.count_if(timed).alias("with_ts"), F.count("*").alias("total")
    )


def chunk_stats(chunks: DataFrame, *keys: str) -> DataFrame:
    length = F.coalesce("end", F.lit(0.0)) - F.coalesce("start", F.lit(0.0))
    return chunks.groupBy(*keys).agg(
        F.count("*").alias("n_chunks"),
        F.avg(length).alias("avg_duration"),
        F.avg(F.length("text")).alias("avg_chars"),
    )


# Fixed value: markers that a spoken-word count leaves out.
CLOCK_MARK = r"\[[0-9]{2}:[0-9]{2}(?::[0-9]{2})?\]|\[[0-9]+\]"


def transcript_stats(transcripts: DataFrame, key: str, text: str, segments: Column) -> DataFrame:
    """Words (markers included, as reported; and without them), characters, segments."""
    return transcripts.select(
        key,
        word_count(text).alias("word_count"),
        word_count(F.regexp_replace(F.col(text), CLOCK_MARK, " ")).alias("spoken_word_count"),
        F.length(text).alias("n_chars"),
        F.size(segments).alias("n_segments"),
    )


def registry_count(registry: DataFrame) -> DataFrame:
    return registry.agg(F.count("*").alias("video_mappings"))


def registry_dump(registry: DataFrame) -> DataFrame:
    return registry.select("video_name", "video_url")


def bad_spans(chunks: DataFrame) -> DataFrame:
    """Chunks that end before they start (inline timestamps may run backwards)."""
    return chunks.where(F.col("end") < F.col("start"))
