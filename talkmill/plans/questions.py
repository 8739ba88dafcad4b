"""Search, ask and summarise pipelines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkmill.functions.text import strip
from talkmill.functions.urls import namespace_of
from talkmill.operators import answering, summaries
from talkmill.operators.block_search import search_blocks
from talkmill.operators.model import EMBEDDING_DIM, BatchFn, batch_model, embed
from talkmill.operators.retrieval import (
    SEARCH_K,
    TOP_K,
    company_filter,
    search_results,
    similarity_topk,
    similarity_topk_unscoped,
)
from talkmill.operators.topk_kernel import EXACT_DIGITS
from talkmill.session import scratch_dir

REPLY_BATCH = 100


def pin(df: DataFrame, purpose: str) -> DataFrame:
    """The rows of ``df`` as a table in the shared scratch folder. Survives lost executors."""
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def repeated_questions(questions: DataFrame) -> DataFrame:
    """Quarantine: the rows that :func:`unique_questions` leaves out."""
    return _numbered_questions(questions).where("_nth > 1").drop("_nth")


def unique_questions(questions: DataFrame) -> DataFrame:
    """One row for each ``question_id``, as answers are told apart by it: of several, the one
    whose company and text come first."""
    return _numbered_questions(questions).where("_nth = 1").drop("_nth")


def _numbered_questions(questions: DataFrame) -> DataFrame:
    own = Window.partitionBy("question_id").orderBy("company_name", "question")
    return questions.withColumn("_nth", F.row_number().over(own))


def embed_questions(
    questions: DataFrame, embedder: Callable[[], BatchFn], dim: int = EMBEDDING_DIM
) -> DataFrame:
    """Questions with embedding and namespace. One of another length than ``dim`` counts as failed."""
    other = F.coalesce(F.size("embedding"), F.lit(-1)) != dim
    return (
        embed(unique_questions(questions), "question", embedder, dim)
        .withColumn("is_zero", F.col("is_zero") | other)
        .withColumn("namespace", namespace_of("company_name"))
    )


def retrieve(
    questions: DataFrame,
    vectors: DataFrame,
    embedder: Callable[[], BatchFn],
    dim: int = EMBEDDING_DIM,
    k: int = TOP_K,
    scope: str = "namespace",
    digits: int = EXACT_DIGITS,
    blocks: DataFrame | None = None,
) -> DataFrame:
    """Best k stored chunks per question, with metadata. With ``blocks`` of the vectors
    (``block_search.write_blocks``) the search reads those that can hold a match only.

    The embedded questions are written once and read back: the search looks at them more
    than once, and the model must not be called again for that.
    """
    asked = pin(embed_questions(questions, embedder, dim), "questions")
    return best_chunks(asked, vectors, dim, k, scope, digits, blocks)


def best_chunks(
    asked: DataFrame,
    vectors: DataFrame,
    dim: int,
    k: int,
    scope: str,
    digits: int = EXACT_DIGITS,
    blocks: DataFrame | None = None,
) -> DataFrame:
    """Matches of questions that have their embedding."""
    asked = asked.where("not is_zero")
    if blocks is not None:
        found = search_blocks(asked, blocks, k, scope, dim, digits)
        found = found.join(vectors.select("namespace", "id", "metadata"), ["namespace", "id"])
        if scope == "global":
            found = found.join(asked.select("question_id", "company_name"), "question_id")
            found = found.where(company_filter("company_name", "metadata.company"))
        return found.select("question_id", "rank", "id", "score", "metadata")
    if scope == "global":
        flat = vectors.withColumn("company", F.col("metadata.company"))
        return similarity_topk_unscoped(asked, flat, k, ("metadata",), dim, digits).select(
            "question_id", "rank", "id", "score", "metadata"
        )
    return similarity_topk(asked, vectors, k, ("metadata",), dim=dim, digits=digits)


def search(
    questions: DataFrame,
    vectors: DataFrame,
    embedder: Callable[[], BatchFn],
    dim: int = EMBEDDING_DIM,
    k: int = SEARCH_K,
    digits: int = EXACT_DIGITS,
    blocks: DataFrame | None = None,
) -> DataFrame:
    return search_results(retrieve(questions, vectors, embedder, dim, k, digits=digits, blocks=blocks))


def rerank_prompts(collected: DataFrame) -> DataFrame:
    return collected.withColumn(
        "rerank_prompt",
        F.when(
            answering.n_chunks("chunks") > 0, answering.build_rerank_prompt("question", "chunks")
        ),
    )


def answer_prompts(collected: DataFrame) -> DataFrame:
    return collected.withColumn("context", answering.build_context("chunks")).select(
        "*",
        answering.system_prompt("company_name").alias("system_prompt"),
        answering.user_prompt("context", "question").alias("user_prompt"),
    )


def ask(
    questions: DataFrame,
    vectors: DataFrame,
    registry: DataFrame,
    embedder: Callable[[], BatchFn],
    reranker: Callable[[], BatchFn],
    answerer: Callable[[], BatchFn],
    dim: int = EMBEDDING_DIM,
    k: int = TOP_K,
    scope: str = "namespace",
    same_video_only: bool = False,
    digits: int = EXACT_DIGITS,
    blocks: DataFrame | None = None,
) -> DataFrame:
    """Answer many questions at once, one row for each question_id (``repeated_questions`` gives
    the rows that share an id with another).

    ``answerer`` gets the system and the user prompt as one text, separated by a blank
    line. A failed rerank falls back to the first match; a failed answer and a failed embedding
    of the question are error rows. Models are only asked about questions that have matches, and
    a call that fails fails one question.
    """
    asked = pin(embed_questions(questions, embedder, dim), "questions")
    matches = best_chunks(asked, vectors, dim, k, scope, digits, blocks)
    collected = answer_prompts(rerank_prompts(answering.collect_matches(asked, matches)))
    prompted = collected.join(asked.select("question_id", F.col("is_zero").alias("unembedded")), "question_id")
    prompted = prompted.withColumn(
        "prompt",
        F.when(
            answering.n_chunks("chunks") > 0,
            F.concat(F.coalesce("system_prompt", F.lit("")), F.lit("\n\n"), F.coalesce("user_prompt", F.lit(""))),
        ),
    )
    replied = batch_model(
        prompted, "rerank_prompt", "rerank_reply", reranker, "string", REPLY_BATCH
    )
    replied = batch_model(replied, "prompt", "raw_answer", answerer, "string", REPLY_BATCH)
    return answering.assemble_answers(replied, registry, same_video_only)


def summary_prompts(pairs: DataFrame) -> DataFrame:
    """One prompt per session: the system message, a blank line, and the session."""
    return summaries.format_qa_session(pairs).withColumn(
        "prompt",
        F.concat(
            F.lit(summaries.SUMMARY_SYSTEM + "\n\n"),
            summaries.build_summary_prompt("qa_text", "company_name", "buyer_name"),
        ),
    )


def summarize(pairs: DataFrame, summarizer: Callable[[], BatchFn]) -> DataFrame:
    """One summary per session; a failed model call, or a session without a complete pair, leaves
    ``success`` false and says why in ``error``, for that session alone."""
    out = batch_model(
        summary_prompts(pairs), "prompt", "reply", summarizer, "string", REPLY_BATCH, error_col="cause"
    )
    why = F.coalesce("cause", F.when(F.col("prompt").isNull(), summaries.NO_PAIRS), F.lit("no reply"))
    return out.select(
        "session_id",
        F.col("reply").isNotNull().alias("success"),
        strip("reply").alias("summary"),
        "company_name",
        "buyer_name",
        "qa_count",
        F.when(F.col("reply").isNull(), F.concat(F.lit(summaries.SUMMARY_FAILED), why))
        .alias("error"),
    )
