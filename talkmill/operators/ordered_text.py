"""Ordered concatenation of texts per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE_ROWS = 1024


def _ordered_join(order: Column, text: Column, sep: str) -> Column:
    pairs = F.sort_array(F.collect_list(F.struct(order.alias("o"), text.alias("t"))))
    return F.array_join(F.transform(pairs, lambda p: p["t"]), sep)


def join_texts(
    df: DataFrame,
    keys: list[str],
    order: str,
    text: Column,
    sep: str,
    out: str,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Join the texts of each key by ``order``; adds the row count as ``n_rows``.

    Works in two steps: pieces of ``piece_rows`` positions, then the pieces. The first
    step spreads a key that holds very many rows over many tasks, so only ready pieces
    meet in one place. ``order`` is an integer position within the key (gaps are fine).
    """
    piece = F.floor(F.col(order) / piece_rows).cast("long").alias("piece")
    return (
        df.groupBy(*keys, piece)
        .agg(_ordered_join(F.col(order), text, sep).alias("text"), F.count("*").alias("n"))
        .groupBy(*keys)
        .agg(
            _ordered_join(F.col("piece"), F.col("text"), sep).alias(out),
            F.sum("n").alias("n_rows"),
        )
    )
