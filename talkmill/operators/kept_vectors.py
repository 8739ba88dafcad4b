"""Vectors kept by the content of their text, so that a model is called for new texts only."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.functions.vectors import is_zero, zero_vector
from talkmill.operators.model import EMBED_BATCH, EMBEDDING_DIM, BatchFn, batch_model
from talkmill.operators.snapshots import SnapshotConflict, StoredTable
from talkmill.session import remove_dir, scratch_dir

#: How often a commit starts again when others commit to the same folder.
TRIES = 10


def kept_table(spark: SparkSession, path: str) -> StoredTable:
    """Vectors by SHA-256 of the text. A commit adds a partition and changes none."""
    return StoredTable(spark, path, "digest binary, embedding array<float>", {"batch": "string"})


def digest(text: str) -> Column:
    return F.unhex(F.sha2(F.col(text).cast("binary"), 256))


def embed_kept(
    df: DataFrame,
    text: str,
    factory: Callable[[], BatchFn],
    path: str,
    dim: int = EMBEDDING_DIM,
    batch_size: int = EMBED_BATCH,
    out_col: str = "embedding",
    model: str = "",
) -> DataFrame:
    """As ``embed``, but texts whose vectors are kept under ``path`` do not reach the model, and of
    equal texts one does. The model runs when this is called; new vectors are kept at once.

    A text whose call fails gets a zero vector as in ``embed`` and is not kept, so the next run asks
    again. ``model`` names what made the vectors: a folder holds those of one model and one length.
    ``df`` is evaluated once for its texts and once for the result. Vectors that are not asked for
    are not shuffled as long as the asked digests are few enough to be broadcast by adaptive execution.
    """
    spark = df.sparkSession
    table = kept_table(spark, path)
    head = table.head()
    if head and (head["dim"], head["model"]) != (dim, model):
        raise ValueError(f"{path} keeps vectors of model {head['model']!r} and length {head['dim']}")
    work, failed = scratch_dir(spark, "new-vectors"), scratch_dir(spark, "failed-texts")
    texts = df.where(F.col(text).isNotNull()).select(digest(text).alias("digest"), F.col(text).alias("text"))
    try:
        new = texts.dropDuplicates(["digest"]).join(table.rows(head=head).select("digest"), "digest", "left_anti")
        zero = np.zeros(dim, dtype=np.float32)
        batch_model(new, "text", "embedding", factory, "array<float>", batch_size, zero, "embed_error").select(
            "digest", "embedding", "embed_error"
        ).write.parquet(work)
        made = spark.read.schema("digest binary, embedding array<float>, embed_error string").parquet(work)
        made.where("embed_error is not null").select("digest", "embed_error").write.parquet(failed)
        head = _keep(table, made.where("embed_error is null").select("digest", "embedding"), dim, model)
    finally:
        remove_dir(spark, work)
    asked = texts.select("digest").distinct()
    known = table.rows(head=head).select("digest", F.col("embedding").alias(out_col))
    known = known.join(asked, "digest", "left_semi").withColumnRenamed("digest", "_digest")
    errors = spark.read.schema("digest binary, embed_error string").parquet(failed).withColumnRenamed("digest", "_digest")
    out = df.withColumn("_digest", digest(text)).join(known, "_digest", "left").join(errors, "_digest", "left")
    vector = F.coalesce(out_col, F.when(F.col(text).isNotNull(), zero_vector(dim)))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], vector.alias(out_col), "embed_error").withColumn(
        "is_zero", F.coalesce(is_zero(out_col), F.lit(True))
    )


def _keep(table: StoredTable, made: DataFrame, dim: int, model: str) -> dict:
    """Add vectors to the table; where another writer was first, those that it did not bring."""
    for _ in range(TRIES):
        head = table.head()
        fresh = made.join(table.rows(head=head).select("digest"), "digest", "left_anti")
        if head and fresh.isEmpty():
            return head
        batch = uuid.uuid4().hex
        own = table.spark.createDataFrame([(batch,)], "batch string")
        try:
            return table.commit(head, fresh.withColumn("batch", F.lit(batch)), own, dim=dim, model=model)
        except SnapshotConflict:
            continue
    raise SnapshotConflict(f"others kept committing to {table.path}")


def compact_kept(spark: SparkSession, path: str) -> None:
    """Put what many small commits added into one partition. Raises ``SnapshotConflict`` if another
    writer commits meanwhile; ``remove_unused`` deletes the old files later."""
    table = kept_table(spark, path)
    head = table.head()
    if head:
        batch = uuid.uuid4().hex
        old = table.manifest(head).select("batch").distinct()
        own = old.union(spark.createDataFrame([(batch,)], "batch string"))
        table.commit(head, table.rows(head=head).withColumn("batch", F.lit(batch)), own)
