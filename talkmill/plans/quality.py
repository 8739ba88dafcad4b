"""Quality figures of a company's transcripts and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkmill.functions.urls import namespace_of


def quality_report(chunks: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Per company: timestamp coverage, chunk sizes, transcript sizes and stored vectors.

    ``chunks(company_name, text, start, end)`` are stored chunks, one row per vector (the
    metadata columns of the vector table will do), read once for all figures.
    ``transcripts`` have ``company_name, word_count, n_chars``. Companies whose names
    differ only in case or blanks share a namespace and with it the vector count.
    """
    timed = (F.col("start") > 0) | (F.col("end") > 0)
    per_chunk = chunks.groupBy("company_name").agg(
        F.count_if(timed).alias("with_ts"),
        F.count("*").alias("total"),
        F.avg(F.col("end") - F.col("start")).alias("avg_duration"),
        F.avg(F.length("text")).alias("avg_chars"),
    )
    per_transcript = transcripts.groupBy("company_name").agg(
        F.count("*").alias("n_videos"),
        F.sum("word_count").alias("words"),
        F.sum("n_chars").alias("chars"),
    )
    shared = Window.partitionBy(namespace_of("company_name"))
    return (
        per_transcript.join(per_chunk, "company_name", "left")
        .fillna(0, ["with_ts", "total"])
        .withColumn("vector_count", F.sum("total").over(shared))
    )
