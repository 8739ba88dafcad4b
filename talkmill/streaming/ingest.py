"""Transcripts that keep arriving, chunked and merged into the vector table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from talkmill.functions.text import basename
from talkmill.functions.timing import SEGMENTS_TYPE
from talkmill.functions.urls import route_source
from talkmill.operators.chunking import explode_chunks
from talkmill.operators.kept_vectors import embed_kept
from talkmill.operators.model import EMBEDDING_DIM, BatchFn, embed
from talkmill.operators.store import (
    BUCKETS,
    batch_merged,
    latest_wins,
    merge_vectors,
    read_registry,
    vector_rows,
    vector_table,
)
from talkmill.plans.ingest import STANDARD, chunk_prepared

KEEP = ["video_url", "company_name", "route", "title", "duration", "language", "word_count"]


def read_transcript_stream(
    spark: SparkSession, path: str, schema: str, fmt: str = "parquet", **options: str
) -> DataFrame:
    """Rows of a file or of a folder of files; ``maxFilesPerTrigger`` or ``maxBytesPerTrigger``
    bound what a batch holds after a backlog."""
    return spark.readStream.format(fmt).schema(schema).options(**options).load(exact_pattern(path))


def exact_pattern(path: str) -> str:
    """A pattern that matches just this path. A stream takes a single file by pattern only, so the
    last character stands in brackets and those that mean something in patterns are escaped."""
    plain = path.rstrip("/")
    escaped = "".join(f"\\{c}" if c in "[]{}*?\\" else c for c in plain[:-1])
    last = plain[-1]
    return escaped + (f"\\{last}" if last in "[]{}*?\\^-" else f"[{last}]")


def logged_transcripts(logs: DataFrame, companies: DataFrame) -> DataFrame:
    """Logs (``stream_transcript_logs``, or read as a table) in the form that :func:`stream_ingest`
    takes. ``companies(video_url, company_name)`` says whose videos they are; a video of several
    companies comes for each, one of none, and a log without a run time, is left out."""
    owners = companies.select(F.col("video_url").alias("_url"), "company_name").distinct()
    return logs.where("run_ts is not null").join(owners, F.col("video_url") == F.col("_url")).select(
        "video_url", "company_name", "title", "transcription", "duration", "language", "word_count",
        F.lit(None).cast(SEGMENTS_TYPE).alias("segments"), "run_ts",
    )


def resolved(transcripts: DataFrame, registry: DataFrame) -> DataFrame:
    """Transcripts with the registry's address where ``video_url`` ends in a name it knows."""
    known = registry.select(F.col("video_name").alias("_name"), F.nullif("video_url", F.lit("")).alias("_known"))
    return (
        transcripts.join(known, basename("video_url") == F.col("_name"), "left")
        .withColumn("video_url", F.coalesce("_known", "video_url"))
        .drop("_name", "_known")
    )


def stream_ingest(
    transcripts: DataFrame,
    store: str,
    checkpoint: str,
    embedder: Callable[[], BatchFn],
    dim: int = EMBEDDING_DIM,
    mode: str = STANDARD,
    watermark: str = "1 hour",
    available_now: bool = False,
    replace_video: bool = False,
    buckets: int = BUCKETS,
    registry: str | None = None,
    kept: str | None = None,
) -> StreamingQuery:
    """Start the job. ``transcripts`` has ``video_url, company_name, title, transcription,
    duration, language, word_count, segments`` and the event time ``run_ts``.

    Repeated deliveries of the same run are dropped within the watermark. Choosing among runs of
    one video, chunking and the merge run per batch. The version of a row is the time of its run,
    so late old runs do not replace newer ones. The store notes the last batch of this
    ``checkpoint`` in the snapshot that the batch made, so one that is repeated after a failure is
    merged once, and its model calls are not made again. ``replace_video`` drops rows of a video
    that its newest run no longer has. ``buckets`` counts when the table is made.

    ``registry`` is a stored registry (see ``store_registry``): a ``video_url`` whose last path
    part is a name in it, as for a local file, is replaced by the address there. Every batch reads
    the registry's snapshot of that moment. ``kept`` is a folder of vectors by text: texts embedded
    before, by this or another job, are not sent to the model again.
    """
    spark = transcripts.sparkSession
    once = transcripts.withWatermark("run_ts", watermark).dropDuplicatesWithinWatermark(
        ["video_url", "company_name", "run_ts"]
    )

    def merge(batch: DataFrame, batch_id: int) -> None:
        if batch_merged(vector_table(spark, store).head(), checkpoint, batch_id):
            return
        if registry:
            batch = resolved(batch, read_registry(spark, registry))
        newest = latest_wins(batch, ["company_name", "video_url"], "run_ts")
        chunked = chunk_prepared(newest.withColumn("route", route_source("video_url")), mode)
        chunks = explode_chunks(chunked, F.col("chunks"), *KEEP, "run_ts")
        if kept:
            embedded = embed_kept(chunks, "text", embedder, kept, dim)
        else:
            embedded = embed(chunks, "text", embedder, dim)
        rows = vector_rows(embedded, F.unix_micros("run_ts"))
        source = (checkpoint, batch_id)
        merge_vectors(spark, store, rows, f"{checkpoint}/staging", buckets, replace_video, source)

    writer = once.writeStream.foreachBatch(merge).option(
        "checkpointLocation", f"{checkpoint}/progress"
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()

