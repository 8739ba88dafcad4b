"""Transcript selection and rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkmill.functions.text import is_blank, word_count
from talkmill.functions.urls import youtube_video_id
from talkmill.operators.ordered_text import join_texts
from talkmill.sources.readers import (
    LOG_HEADERS,
    LOG_SEPARATOR,
    NAME_MARK,
    SUMMARY_MARK,
    TRANSCRIPT_MARK,
    escaped,
)

# Fixed value: text of the record that stands in for a video without any transcript.
PLACEHOLDER = (
    "This video was processed using fallback transcription due to API limitations. The content "
    "is available for processing but detailed transcription is not available at this time."
)
CAPTIONS_METHOD = "youtube_transcript_api_fallback"
PLACEHOLDER_METHOD = "fallback_transcription"
TRANSCRIPT_COLUMNS = [
    "video_url", "method", "title", "transcription", "summary", "duration", "language", "word_count",
]


def join_caption_text(captions: DataFrame, key: str = "video_url") -> DataFrame:
    """Caption segments (one per row) to one transcript text per video."""
    return join_texts(captions, [key], "seg_idx", F.col("text"), " ", "transcription").drop("n_rows")


def caption_transcripts(texts: DataFrame) -> DataFrame:
    """Transcript records for joined caption texts ``(video_url, transcription)``."""
    return texts.select(
        "video_url",
        F.lit(CAPTIONS_METHOD).alias("method"),
        F.lit("YouTube Video").alias("title"),
        "transcription",
        F.lit("").alias("summary"),
        F.lit("Unknown").alias("duration"),
        F.lit("en").alias("language"),
        word_count("transcription").alias("word_count"),
    )


def placeholder_transcripts(requests: DataFrame) -> DataFrame:
    """Stand-in records for every request whose URL carries a video id."""
    video_id = youtube_video_id("video_url")
    text = F.concat(F.lit("Video ID: "), video_id, F.lit("\n\n" + PLACEHOLDER))
    return requests.where(video_id.isNotNull()).select(
        "video_url",
        F.lit(PLACEHOLDER_METHOD).alias("method"),
        F.concat(F.lit("YouTube Video "), video_id).alias("title"),
        text.alias("transcription"),
        F.lit("").alias("summary"),
        F.lit("Unknown").alias("duration"),
        F.lit("en").alias("language"),
        word_count(text).alias("word_count"),
    )


def select_transcript(
    requests: DataFrame, model_transcripts: DataFrame, caption_texts: DataFrame
) -> DataFrame:
    """Best transcript per video: model output, else captions, else a placeholder.

    One ranked union instead of a chain of joins: a single shuffle by video, and the
    per-partition rank limit drops losing candidates before it.
    """
    candidates = (
        model_transcripts.where(~is_blank("transcription"))
        .select(*TRANSCRIPT_COLUMNS, F.lit(1).alias("priority"))
        .unionByName(
            caption_transcripts(caption_texts)
            .where(~is_blank("transcription"))
            .withColumn("priority", F.lit(2))
        )
        .unionByName(
            placeholder_transcripts(requests.select("video_url")).withColumn("priority", F.lit(3))
        )
    )
    best = Window.partitionBy("video_url").orderBy("priority", "method", "transcription")
    return (
        candidates.withColumn("rn", F.row_number().over(best)).where("rn = 1").drop("rn", "priority")
    )


def render_log() -> Column:
    """Log text of a transcript record; the summary block only when there is one."""
    value = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("Unknown"))
    line = lambda name, end: F.concat(
        F.lit(f"{LOG_HEADERS[name]}: "), value(name), F.lit(end)
    )
    summary = F.when(
        F.coalesce(F.col("summary"), F.lit("")) != "",
        F.concat(F.lit(SUMMARY_MARK + "\n"), F.col("summary"), F.lit("\n\n")),
    ).otherwise("")
    return F.concat(
        line("video_url", "\n\n"),
        line("title", "\n"),
        line("duration", "\n"),
        line("language", "\n"),
        line("word_count", "\n"),
        line("method", "\n\n"),
        summary,
        F.lit(TRANSCRIPT_MARK + "\n"),
        F.coalesce(F.col("transcription"), F.lit("")),
    )


def log_name(run_ts: Column, video_id: Column) -> Column:
    """File name of a log: the video and the time of its run."""
    return F.concat(F.coalesce(video_id, F.lit("video")), F.lit("_"), F.date_format(run_ts, "yyyyMMdd_HHmmss"), F.lit(".txt"))


def write_transcript_logs(transcripts: DataFrame, path: str, partition: str | None = None) -> None:
    """Write rendered logs, many to a file (one file per log would be far too many).

    A record separator stands between them (its first character is escaped in texts), and each begins with its own file name where
    ``transcripts`` has a column ``file_name``; ``scan_transcript_logs`` reads both back.
    """
    value = render_log()
    if "file_name" in transcripts.columns:
        name = F.coalesce(F.concat(F.lit(NAME_MARK), F.col("file_name"), F.lit("\n")), F.lit(""))
        value = F.concat(name, value)
    rows = transcripts.select(*([partition] if partition else []), escaped(value).alias("value"))
    writer = rows.write.mode("append").option("lineSep", LOG_SEPARATOR)
    (writer.partitionBy(partition) if partition else writer).text(path)
