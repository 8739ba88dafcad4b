"""Keyed tables: chunk vectors and the video registry."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkmill.functions.text import basename, col
from talkmill.functions.urls import namespace_of, vector_id
from talkmill.operators.snapshots import StoredTable
from talkmill.schemas import CHUNK_VECTORS
from talkmill.session import remove_dir

BUCKETS = 16
#: Replaced ids whose hashes travel with the tasks at a merge; 8 bytes each.
MAX_HASHES = 8_000_000
#: New rows of a partition, on average, that fill files enough wherever they are written.
FULL_ROWS = 50_000
YOUTUBE_SOURCE, LOOM_SOURCE = "youtube_gemini", "loom_video"


def latest_wins(df: DataFrame, keys: list[str], version: str, *ties: str) -> DataFrame:
    """Newest row per key. The per-partition rank limit keeps one row per key and task
    before the shuffle, so a key with very many versions does no harm."""
    newest = Window.partitionBy(*keys).orderBy(
        F.col(version).desc(), *[F.col(t).desc() for t in ties]
    )
    return df.withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").drop("_rn")


def vector_metadata(source: Column | str) -> Column:
    """Metadata struct of a chunk row; ``source`` is ``youtube`` or ``loom``.

    Unknown numbers are null. The last four fields are only filled in tables that come
    from elsewhere.
    """
    text = lambda c: F.lit(None).cast("string").alias(c)
    return F.struct(
        F.col("company_name").alias("company"),
        F.col("video_url"),
        F.col("chunk_index"),
        F.col("text"),
        F.coalesce("start", F.lit(0.0)).alias("start"),
        F.coalesce("end", F.lit(0.0)).alias("end"),
        F.coalesce("title", F.lit("Unknown")).alias("title"),
        F.col("duration").cast("string").try_cast("double").alias("duration"),
        F.coalesce("language", F.lit("Unknown")).alias("language"),
        F.col("word_count").cast("int").alias("word_count"),
        F.when(col(source) == "loom", LOOM_SOURCE).otherwise(YOUTUBE_SOURCE).alias("source_type"),
        text("source"),
        text("original_video_url"),
        text("type"),
        text("context"),
    )


def vector_rows(embedded: DataFrame, version: Column, source: Column | str = "route") -> DataFrame:
    """Embedded chunks to rows of the vector table."""
    return embedded.select(
        namespace_of("company_name").alias("namespace"),
        vector_id("company_name", "video_url", "chunk_index").alias("id"),
        "embedding",
        version.cast("bigint").alias("version"),
        vector_metadata(source).alias("metadata"),
    )


def newest_rows(incoming: DataFrame) -> DataFrame:
    """One row per id of a batch: the highest version; of equal versions the one with the larger
    content hash, so that the order of rows does not matter."""
    marked = incoming.withColumn("_mark", F.xxhash64("embedding", "metadata"))
    return latest_wins(marked, ["namespace", "id"], "version", "_mark").drop("_mark")


def upsert_vectors(
    existing: DataFrame, incoming: DataFrame, replace_video: bool = False, verdicts: DataFrame | None = None
) -> DataFrame:
    """State of the vector table after an upsert by ``(namespace, id)``.

    The last write wins: a stored row gives way to an incoming one of the same or a newer
    version, and an incoming row to a stored one that is newer still (a late run). Only the ids
    and versions of the two sides meet, never their vectors. ``existing`` holds an id once.

    A video that now has fewer chunks keeps its old tail ids, as an upsert only touches the ids
    it is given; ``replace_video`` drops the rows of re-ingested videos that are not newer than
    the incoming run, and the incoming rows of videos whose stored run is newer. A merge on disk
    gives the ``verdicts`` that it wrote before; then few rows move.
    """
    if verdicts is not None:
        return _by_verdicts(existing, incoming, verdicts)
    incoming = newest_rows(incoming)
    if replace_video:
        existing, incoming = _whole_videos(existing, incoming)
    key = ["namespace", "id"]
    version = lambda df, name: df.select(*key, F.col("version").alias(name))
    kept = existing.join(version(incoming, "_new"), key, "left").where("_new is null or version > _new")
    added = incoming.join(version(existing, "_old"), key, "left").where("_old is null or version >= _old")
    return kept.drop("_new").unionByName(added.drop("_old"), allowMissingColumns=True)


def _whole_videos(existing: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides without the rows of videos for which the other side has the run that counts."""
    video = F.coalesce("metadata.video_url", F.lit(""))
    key = ["namespace", "_video"]

    def runs(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("namespace", video.alias("_video")).agg(F.max("version").alias(name))

    mine, theirs = runs(incoming, "_new"), runs(existing, "_old")
    stale = existing.withColumn("_video", video).join(mine, key, "left").where("_new is null or version > _new")
    fresh = incoming.withColumn("_video", video).join(theirs, key, "left").where("_old is null or version >= _old")
    return stale.drop("_video", "_new"), fresh.drop("_video", "_old")


def with_bucket(vectors: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    return vectors.withColumn(
        "bucket", F.pmod(F.xxhash64("metadata.video_url"), F.lit(buckets)).cast("int")
    )


#: Kept for each partition of the vector table, so that reports need no scan of the rows.
VECTOR_MEASURES = {
    "with_ts": "count_if(metadata.start > 0 or metadata.end > 0)",
    "seconds": "sum(metadata.end - metadata.start)",
    "chars": "sum(length(metadata.text))",
}


def vector_table(spark: SparkSession, path: str) -> StoredTable:
    """The stored table of chunk vectors, laid out by namespace and bucket."""
    columns = CHUNK_VECTORS.removeprefix("namespace string, ")
    return StoredTable(spark, path, columns, {"namespace": "string", "bucket": "int"}, VECTOR_MEASURES)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """The current snapshot of a vector table. A reader keeps the snapshot that it began with."""
    return vector_table(spark, path).rows()


def merge_vectors(
    spark: SparkSession,
    path: str,
    incoming: DataFrame,
    staging: str,
    buckets: int = BUCKETS,
    replace_video: bool = False,
    batch: tuple[str, int] | None = None,
) -> None:
    """Upsert into a stored table (made when it is not there): a new snapshot in which only the
    partitions that receive rows are written anew.

    The new rows are written as they come first, so a model behind them is called once and
    all that follows is an ordinary batch. Readers see the old snapshot until the new one is
    whole; a job that dies in between is repeated from the same inputs with the same result. Each
    run stages under a name of its own below ``staging`` and removes it at the end. ``buckets``
    counts when the table is made; later merges keep to the number it was made with. ``batch``
    names a source and the number of its batch: numbers that were merged before are left alone.
    """
    table = vector_table(spark, path)
    head = table.head()
    if batch and batch_merged(head, *batch):
        return
    work = f"{staging.rstrip('/')}/run-{uuid.uuid4().hex}"
    try:
        numbered = incoming.withColumn("_row", F.monotonically_increasing_id())
        numbered.withColumn("_mark", F.xxhash64("embedding", "metadata")).write.option(
            "compression", "zstd"
        ).parquet(f"{work}/incoming")
        buckets = head.get("buckets", buckets)
        staged = spark.read.schema(f"{CHUNK_VECTORS}, _row bigint, _mark bigint").parquet(f"{work}/incoming")
        rows = with_bucket(staged, buckets).withColumn("namespace", F.coalesce("namespace", F.lit("")))
        if replace_video:
            rows = rows.drop("_row", "_mark")
            touched = rows.select("namespace", "bucket").distinct()
            merged = upsert_vectors(table.rows(touched, head), rows, replace_video)
            merged = merged.hint("rebalance", "namespace", "bucket")
        else:
            verdicts = _verdicts(table, head, rows, f"{work}/verdicts")
            touched = verdicts.where("_counts").select("namespace", "bucket").distinct()
            merged = upsert_vectors(table.rows(touched, head), rows, replace_video, verdicts)
        notes = {"batches": {**head.get("batches", {}), batch[0]: batch[1]}} if batch else {}
        table.commit(head, merged, touched, laid=True, buckets=buckets, **notes)
    finally:
        remove_dir(spark, work)


def _verdicts(table: StoredTable, head: dict, rows: DataFrame, work: str) -> DataFrame:
    """What becomes of each new row, found from ids and versions alone and written under ``work``:
    ``_old`` is the version stored for its id, ``_counts`` whether the row replaces or adds to that."""
    key = ["namespace", "id"]
    newest = latest_wins(rows.select(*key, "bucket", "version", "_mark", "_row"), key, "version", "_mark")
    if head:
        asked = rows.select("namespace", "bucket").distinct()
        stored = table.rows(asked, head).select(*key, F.col("version").alias("_old"))
        found = newest.join(stored, key, "left").withColumn("_counts", F.expr("_old is null or version >= _old"))
    else:
        found = newest.withColumns({"_old": F.lit(None).cast("bigint"), "_counts": F.lit(True)})
    found.select(*key, "bucket", "_row", "_old", "_counts").write.parquet(work)
    kinds = "namespace string, id string, bucket int, _row bigint, _old bigint, _counts boolean"
    return table.spark.read.schema(kinds).parquet(work)


def _by_verdicts(existing: DataFrame, incoming: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows after an upsert; ``existing`` holds the partitions in which a new row counts. A new row
    moves once, to the file it stays in."""
    counting = verdicts.where("_counts")
    n = counting.count()
    if n == 0:
        added = incoming.limit(0)
    elif n == incoming.count():
        added = incoming
    else:
        added = incoming.join(counting.select("_row").hint("shuffle_hash"), "_row", "left_semi")
    added = added.drop("_row", "_mark")
    if n < FULL_ROWS * counting.select("namespace", "bucket").distinct().count():
        added = added.hint("rebalance", "namespace", "bucket")
    kept = _without(existing, counting.where("_old is not null").select("namespace", "id"))
    return kept.unionByName(added, allowMissingColumns=True)


def _without(stored: DataFrame, gone: DataFrame) -> DataFrame:
    """Stored rows but those of the ids ``gone``. Rows whose hash is none of theirs stay where they are
    read; only the others meet the ids. More than ``MAX_HASHES`` meet all rows."""
    spark, key = stored.sparkSession, ["namespace", "id"]
    n = gone.count()
    if n == 0:
        return stored
    if n > MAX_HASHES:
        return stored.join(gone.hint("shuffle_hash"), key, "left_anti").hint("rebalance", "namespace", "bucket")
    hashes = gone.select(F.xxhash64(*key).alias("h")).toArrow().column("h").to_numpy()
    known = spark.sparkContext.broadcast(np.sort(hashes))

    @F.pandas_udf("boolean")
    def met(h: pd.Series) -> pd.Series:
        own = h.to_numpy()
        at = np.minimum(np.searchsorted(known.value, own), len(known.value) - 1)
        return pd.Series(known.value[at] == own)

    marked = stored.withColumn("_met", met(F.xxhash64(*key)))
    some = marked.where("_met").join(gone.hint("shuffle_hash"), key, "left_anti").hint("rebalance", "namespace", "bucket")
    return marked.where("not _met").unionByName(some).drop("_met")


def stored_figures(spark: SparkSession, path: str) -> DataFrame:
    """``namespace, vector_count, with_ts, avg_duration, avg_chars`` of a stored table, from the
    measures that its commits kept: no row of the table is read."""
    table = vector_table(spark, path)
    head = table.head()
    if not head:
        kinds = "namespace string, vector_count bigint, with_ts bigint, avg_duration double, avg_chars double"
        return spark.createDataFrame([], kinds)
    return (
        table.manifest(head)
        .groupBy("namespace")
        .agg(
            F.sum("n").alias("vector_count"),
            F.sum("with_ts").alias("with_ts"),
            (F.sum("seconds") / F.sum("n")).alias("avg_duration"),
            (F.sum("chars") / F.sum("n")).alias("avg_chars"),
        )
    )


def batch_merged(head: dict, source: str, number: int) -> bool:
    """Whether a snapshot already holds this batch of a source; batches come in order."""
    return number <= head.get("batches", {}).get(source, -1)


def registry_rows(files: DataFrame, version: Column) -> DataFrame:
    """Registry entries ``(video_name, video_url, version)`` from local file names."""
    return files.select(
        basename("local_filename").alias("video_name"),
        F.col("original_url").alias("video_url"),
        version.alias("version"),
    )


def upsert_registry(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Latest entry per video name; of equal versions the incoming one, and within one side the
    larger URL."""
    side = lambda df, n: df.withColumn("_side", F.lit(n))
    both = side(existing, 0).unionByName(side(incoming, 1))
    return latest_wins(both, ["video_name"], "version", "_side", "video_url").drop("_side")


def merge_registry(left: DataFrame, right: DataFrame) -> DataFrame:
    """Union of two registries; the right side wins."""
    both = left.withColumn("version", F.lit(0)).unionByName(right.withColumn("version", F.lit(1)))
    return latest_wins(both, ["video_name"], "version", "video_url").drop("version")


REGISTRY_BUCKETS = 8


def registry_table(spark: SparkSession, path: str) -> StoredTable:
    """The stored video registry ``(video_name, video_url, version)``, laid out by name."""
    return StoredTable(spark, path, "video_name string, video_url string, version bigint", {"bucket": "int"})


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The current entries of a stored registry, one for each video name."""
    return registry_table(spark, path).rows().drop("bucket")


def store_registry(spark: SparkSession, path: str, incoming: DataFrame, buckets: int = REGISTRY_BUCKETS) -> None:
    """Upsert ``(video_name, video_url, version)`` rows into a stored registry (made when it is not
    there). The entry with the higher version stays; of equal versions the later write. Entries
    without a name are left out, as nothing could ever look them up."""
    table = registry_table(spark, path)
    head = table.head()
    buckets = head.get("buckets", buckets)
    bucket = F.pmod(F.xxhash64("video_name"), F.lit(buckets)).cast("int")
    rows = (
        incoming.where("video_name is not null")
        .select("video_name", "video_url", F.col("version").cast("bigint").alias("version"))
        .withColumn("bucket", bucket)
    )
    touched = rows.select("bucket").distinct()
    table.commit(head, upsert_registry(table.rows(touched, head), rows), touched, buckets=buckets)
