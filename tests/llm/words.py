"""Texts for the tests: drawn from a few hundred words of made-up syllables."""

import random

SYLLABLES = "ka lo mi ten rus vel dar pon shi gru".split()


def vocabulary(seed, n=300):
    r = random.Random(seed)
    return sorted({"".join(r.choices(SYLLABLES, k=r.randint(1, 3))) for _ in range(n)})


def text(r, words, n):
    return " ".join(r.choices(words, k=n))


def hostile_rows():
    """``doc_id, text, lang, source`` with nulls, empties, long texts, repeats and odd letters."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    return [
        (1, "plain words of one text here", "en", "a"),
        (1, "plain words of one text here", "en", "a"),
        (1, "another text under the same id", "en", None),
        (None, "a text without an id of any kind", "en", "b"),
        (None, None, None, None),
        (2, None, "en", "a"),
        (3, "", None, "b"),
        (4, " \t\n ", "fr", "a"),
        (5, "x", "fr", "b"),
        (6, long, "en", "a"),
        (7, "漢字 и кириллица <|endoftext|> \U0001f600 é", "xx", "b"),
        (8, "12345 !!! ***", "en", "c"),
        (9, "A" * 5_000, "en", "c"),
    ]


COLUMNS = "doc_id long, text string, lang string, source string"


def frame(spark, rows, columns=COLUMNS):
    return spark.createDataFrame(rows, columns)


def clashing(docs):
    """The same documents with further columns under names that operators use inside."""
    from pyspark.sql import functions as F

    names = "score size key fp target rate copies toxic matched tokens hits n v cid rank path license".split()
    return docs.select("*", *[F.lit(1).alias(n) for n in names])
