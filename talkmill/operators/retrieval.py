"""Exact similarity search: questions x stored vectors, best k per question."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkmill.functions.text import col
from talkmill.operators.model import EMBEDDING_DIM
from talkmill.operators.topk_kernel import EXACT_DIGITS, BestMatches, to_matrix
from talkmill.session import remove_dir, scratch_dir

TOP_K, SEARCH_K = 6, 5
#: Bytes of the questions that travel with the tasks at a time. A task holds some ten times as much.
SLICE_BYTES = 16 << 20
MAX_PRUNE_VALUES = 256
VECTOR_BLOCK = 4_096
#: Winners that travel to the carried columns; of more, both sides are shuffled.
MAX_SENT_WINNERS = 100_000


def topk_per_question(scored: DataFrame, k: int, tie: str = "id") -> DataFrame:
    """Best ``k`` rows per question as ``rank``; equal scores go to the smaller id.

    Spark limits each group before the shuffle, so a task sends at most ``k`` rows per
    question.
    """
    best = Window.partitionBy("question_id").orderBy(F.col("score").desc(), tie)
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def of_length(df: DataFrame, dim: int) -> DataFrame:
    """Rows whose embedding has ``dim`` components."""
    return df.where(F.coalesce(F.size("embedding"), F.lit(-1)) == dim)


def wrong_length(df: DataFrame, dim: int) -> DataFrame:
    """Quarantine: rows without an embedding of ``dim`` components, with a ``reason``."""
    found = F.concat(F.lit("embedding has "), F.size("embedding"), F.lit(f" components, not {dim}"))
    reason = F.when(F.col("embedding").isNull(), "no embedding").otherwise(found)
    return df.where(F.coalesce(F.size("embedding"), F.lit(-1)) != dim).withColumn("reason", reason)


def similarity_topk(
    questions: DataFrame,
    vectors: DataFrame,
    k: int = TOP_K,
    carry: tuple[str, ...] = (),
    scope: str = "namespace",
    dim: int = EMBEDDING_DIM,
    digits: int = EXACT_DIGITS,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """Exact best-k matches ``(question_id, rank, id, score, *carry)``.

    ``questions(question_id, namespace, embedding)`` are compared with the
    ``vectors(namespace, id, embedding, *carry)`` of their namespace, or with all of
    them when ``scope='global'``. Vectors without length never match, and rows whose
    embedding has not ``dim`` components take no part (:func:`wrong_length` gives them).

    Questions go in slices of ``slice_bytes``; each slice travels with the tasks and the ids and
    embeddings of the vectors are read once for it, without any shuffle. Several slices are searched
    one after the other when this is called, each into a table of its own. A task keeps the best k
    per question and nothing else. The carried columns are joined to the winners only, which are
    sent to them: stored texts are not shuffled for the few that win.
    Scores are compared to ``digits`` decimals; at the default that is as far as sums of doubles
    agree whatever their order, so that equal vectors tie and go by the smaller id.
    """
    stored = of_length(vectors, dim).select("namespace", "id", "embedding")
    if scope == "global":
        stored = stored.withColumn("_home", F.col("namespace")).withColumn("namespace", F.lit(""))
    else:
        stored = stored.withColumn("_home", F.col("namespace"))
    schema = T.StructType(
        [
            questions.schema["question_id"],
            T.StructField("score", T.DoubleType()),
            stored.schema["id"],
            stored.schema["_home"],
        ]
    )
    everywhere = scope == "global"
    asked = []

    def one(groups: dict, folder: str | None) -> DataFrame:
        """Best k per task for one slice; with a folder, those of all tasks, written there."""
        asked.append(sum(len(ids) for ids, _ in groups.values()))
        narrowed = stored if everywhere else prune_namespaces(stored, sorted(groups))
        if folder is None:
            return narrowed.mapInArrow(_scan(lambda: groups, k, dim, digits, schema.names), schema)
        shipped = stored.sparkSession.sparkContext.broadcast(groups)
        scanned = narrowed.mapInArrow(_scan(lambda: shipped.value, k, dim, digits, schema.names), schema)
        topk_per_question(scanned, k).drop("rank").write.parquet(folder)
        shipped.destroy()
        return stored.sparkSession.read.schema(schema).parquet(folder)

    found = in_slices(questions, dim, slice_bytes, everywhere, one, lazy=True)
    if found is None:
        found = stored.sparkSession.createDataFrame([], schema)
    best = topk_per_question(found, k).select("question_id", "rank", "id", "_home", "score")
    if not carry:
        return best.drop("_home")
    payload = vectors.select(F.col("namespace").alias("_home"), "id", *carry)
    if sum(asked) * k <= MAX_SENT_WINNERS:
        best = F.broadcast(best)
    return best.join(payload, ["_home", "id"]).select("question_id", "rank", "id", "score", *carry)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Record batches in slices small enough for a few matrices of their size."""
    for batch in batches:
        for lo in range(0, batch.num_rows, VECTOR_BLOCK):
            yield batch.slice(lo, VECTOR_BLOCK)


def in_slices(
    questions: DataFrame,
    dim: int,
    slice_bytes: int,
    everywhere: bool,
    search: Callable[[dict, str | None], DataFrame],
    lazy: bool = False,
) -> DataFrame | None:
    """Union of ``search(groups, folder)`` over slices of ``slice_bytes`` of the questions; None if
    there are none. ``groups`` holds a slice by namespace (one without a name, if ``everywhere``) as
    ids and matrix.

    Slices are searched one after the other and each writes what it finds to its folder, so the
    driver holds one at a time. With ``lazy`` a single slice gets no folder and stays a plan.
    """
    asked = of_length(questions, dim).select(
        "question_id", (F.lit("") if everywhere else F.col("namespace")).alias("namespace"), "embedding"
    )
    spark = questions.sparkSession
    n = asked.count()
    if n == 0:
        return None
    parts = -(-n * dim * 8 // slice_bytes)
    if parts == 1 and lazy:
        return search(question_groups(asked, dim), None)
    work, out = scratch_dir(spark, "question-slices"), scratch_dir(spark, "matches")
    place = F.pmod(F.xxhash64("namespace", "question_id"), F.lit(parts)).cast("int")
    found = []
    try:
        asked.withColumn("_slice", place).repartition("_slice").write.partitionBy("_slice").parquet(work)
        sliced = spark.read.schema(T.StructType([*asked.schema.fields, T.StructField("_slice", T.IntegerType())])).parquet(work)
        for i in range(parts):
            groups = question_groups(sliced.where(F.col("_slice") == i).drop("_slice"), dim)
            if groups:
                found.append(search(groups, f"{out}/slice-{i}"))
    finally:
        remove_dir(spark, work)
    return reduce(DataFrame.unionByName, found) if found else None


def question_groups(asked: DataFrame, dim: int) -> dict[str, tuple[pa.Array, np.ndarray]]:
    """Ids and matrix of the questions by namespace; those without one match nothing."""
    rows = asked.where("namespace is not null").toArrow().sort_by("namespace")
    names = rows.column("namespace").to_pylist()
    matrix = to_matrix(rows.column("embedding"), dim) if names else None
    groups, begin = {}, 0
    for name, n in Counter(names).items():
        ids = rows.column("question_id").slice(begin, n).combine_chunks()
        groups[name] = (pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids, matrix[begin : begin + n])
        begin += n
    return groups


def prune_namespaces(vectors: DataFrame, names: list[str]) -> DataFrame:
    """Rows of the asked namespaces: by a filter that reaches the scan, or else by a join."""
    if len(names) <= MAX_PRUNE_VALUES:
        return vectors.where(F.col("namespace").isin(names))
    # At most as many names as questions, whose bytes the slice bounds.
    asked = vectors.sparkSession.createDataFrame(pa.table({"namespace": pa.array(names, pa.string())}))
    return vectors.join(F.broadcast(asked), "namespace", "left_semi")


def _scan(given: Callable[[], dict], k: int, dim: int, digits: int, out: list[str]) -> Callable:
    """One pass over the vectors for one slice of questions: best k per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = given()
        best: dict[str, BestMatches] = {}
        for batch in pieces(batches):
            codes = batch.column("namespace").dictionary_encode()
            which = codes.indices.to_numpy(zero_copy_only=False)
            matrix = to_matrix(batch.column("embedding"), dim)
            payload = pa.Table.from_batches([batch.select(["id", "_home"])])
            for code, name in enumerate(codes.dictionary.to_pylist()):
                if name not in groups:
                    continue
                if name not in best:
                    best[name] = BestMatches(*groups[name], k, digits)
                if len(codes.dictionary) == 1:
                    best[name].offer(matrix, payload)
                else:
                    rows = np.nonzero(which == code)[0]
                    best[name].offer(matrix[rows], payload.take(pa.array(rows)))
        for matches in best.values():
            table = matches.result()
            if table is not None:
                yield from table.select(out).combine_chunks().to_batches()

    return run


def company_filter(company: Column | str, stored_company: Column | str) -> Column:
    """Case-insensitive company test; a missing stored company counts as empty."""
    return F.lower(F.coalesce(col(stored_company), F.lit(""))) == F.lower(col(company))


def similarity_topk_unscoped(
    questions: DataFrame,
    vectors: DataFrame,
    k: int = TOP_K,
    carry: tuple[str, ...] = (),
    dim: int = EMBEDDING_DIM,
    digits: int = EXACT_DIGITS,
) -> DataFrame:
    """Best k over all namespaces first, company filter second (fewer than k may remain)."""
    carry = tuple(dict.fromkeys((*carry, "company")))
    found = similarity_topk(questions, vectors, k, carry, "global", dim, digits)
    asked = questions.select("question_id", "company_name")
    return found.join(asked, "question_id").where(company_filter("company_name", "company"))


def search_results(matches: DataFrame) -> DataFrame:
    """Flat search result with defaults for missing metadata."""
    m = F.col("metadata")
    text = lambda f: F.coalesce(m[f], F.lit("")).alias(f)
    return matches.select(
        "question_id",
        "rank",
        "id",
        "score",
        text("text"),
        text("video_url"),
        text("title"),
        F.coalesce(m["chunk_index"], F.lit(0)).alias("chunk_index"),
    )


def match_debug(matches: DataFrame) -> DataFrame:
    """Per match the names of its non-null metadata fields, and the matches per question."""
    per_question = Window.partitionBy("question_id")
    return matches.select(
        "question_id",
        "rank",
        "id",
        "score",
        F.json_object_keys(F.to_json("metadata")).alias("metadata_keys"),
        F.count("*").over(per_question).alias("chunks_count"),
    )


def namespace_stats(vectors: DataFrame) -> DataFrame:
    """Number of vectors per namespace."""
    return vectors.groupBy("namespace").agg(F.count("*").alias("vector_count"))


def namespace_exists(companies: DataFrame, vectors: DataFrame) -> DataFrame:
    """For each company: does its namespace hold anything, and how much?"""
    from talkmill.functions.urls import namespace_of

    return (
        companies.select("company_name", namespace_of("company_name").alias("namespace"))
        .join(namespace_stats(vectors), "namespace", "left")
        .withColumn("vector_count", F.coalesce("vector_count", F.lit(0)))
        .withColumn("namespace_exists", F.col("vector_count") > 0)
    )
