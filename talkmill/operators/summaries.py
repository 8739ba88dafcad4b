"""Q/A sessions to summary prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.functions.text import col, or_unknown
from talkmill.operators.ordered_text import join_texts

# The prompt, whose lines keep their indent, cut only where values go in.
PROMPT_UP_TO_TEXT = """Based on the following questions and answers from a video demo session, create a concise summary.
        
        Questions and Answers:
        """
PROMPT_UP_TO_COMPANY = """
        
        Company: """
PROMPT_UP_TO_BUYER = """
        Buyer: """
PROMPT_END = """
        
        Summary:"""
SUMMARY_FAILED = "Summary generation failed: "
NO_PAIRS = "no question has an answer"
SUMMARY_SYSTEM = "You are a helpful assistant that creates concise summaries of demo sessions."


def complete_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("question").isNotNull() & F.col("answer").isNotNull())


def quarantined_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs without a question or an answer; they must not spoil the session."""
    return pairs.where(F.col("question").isNull() | F.col("answer").isNull())


def format_qa_session(pairs: DataFrame) -> DataFrame:
    """One row per session: its complete pairs as one text in order, their number, and the first
    non-empty company and buyer name. A session without a complete pair has no text and count 0."""
    line = F.concat(F.lit("Q: "), F.col("question"), F.lit("\nA: "), F.col("answer"))
    texts = join_texts(complete_pairs(pairs), ["session_id"], "seq", line, "\n\n", "qa_text")
    names = [c for c in ("company_name", "buyer_name") if c in pairs.columns]

    def first_named(name: str) -> Column:
        # Pairs whose names are all empty keep the empty name.
        own = F.min(F.when(F.col(name) != "", F.struct("seq", name)))[name]
        return F.coalesce(own, F.max(name)).alias(name)

    sessions = pairs.groupBy("session_id").agg(F.count("*").alias("_pairs"), *[first_named(n) for n in names])
    # No name is joined to itself: a session is one row on either side, and null is a session too.
    both = sessions.join(texts.withColumnRenamed("session_id", "_id"), F.col("session_id").eqNullSafe(F.col("_id")), "left")
    return both.select("session_id", *names, "qa_text", F.coalesce("n_rows", F.lit(0)).alias("qa_count"))


def build_summary_prompt(qa_text: Column | str, company: Column | str, buyer: Column | str) -> Column:
    return F.concat(
        F.lit(PROMPT_UP_TO_TEXT),
        col(qa_text),
        F.lit(PROMPT_UP_TO_COMPANY),
        or_unknown(company),
        F.lit(PROMPT_UP_TO_BUYER),
        or_unknown(buyer),
        F.lit(PROMPT_END),
    )
