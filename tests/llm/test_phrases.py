"""Collocations against a plain statement of the same rules."""

import random
import re
from collections import Counter

import pytest

import words
from talkmill.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, support=10, share=50, most=2_000):
    counts, size = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und" if lang is None else lang
        own = counts.setdefault(lang, Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            size[lang] += len(w)
            own.update(tuple(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        held = []
        for p, a in f.items():
            if len(p) == 1 or a < support:
                continue
            cuts = [(1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            longer = [n for q, n in f.items() if len(q) == 3 and n >= support and p in (q[:2], q[1:])] if len(p) == 2 else []
            if not any(100 * n >= share * a for n in longer):
                held.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(held)[:most], 1):
            out.append((lang, rank, p.decode(), -a, left, right, size[lang], -score))
    return sorted(out)


def got(docs, **options):
    return sorted(tuple(r) for r in phrases.collocations(docs, **options).collect())


def rows(seed, n=250):
    r = random.Random(seed)
    vocabulary = words.vocabulary(seed, 60)
    fixed = ["New york city", "salt and pepper", "a b", "漢字 é\x85x", "the\tend", "\xa0odd\x1c ones"]
    out = []
    for i in range(n):
        parts = [r.choice(fixed) if r.random() < 0.2 else r.choices(vocabulary, k=1)[0] for _ in range(r.randint(0, 50))]
        text = "".join(p + r.choice([" ", " ", " ", "  ", ". ", ",", "\n", "\t", " : "]) for p in parts)
        out.append((i, text, r.choice(["en", "fr", None, "und", "a\nb"]), "a"))
    return out + [(9_000, "many rows share this text, as they do", "en", "b")] * (n // 3) + words.hostile_rows()


@pytest.mark.parametrize("options", [{}, {"support": 3, "share": 20, "most": 7}])
def test_collocations_are_the_plain_rules(spark, options):
    own = rows(4)
    docs = words.clashing(words.frame(spark, own)).repartition(5)
    assert got(docs, **options) == plain(own, **options)


@pytest.mark.parametrize("support", [2, 10**9])
def test_border_failures_expand_until_closed(spark, monkeypatch, support):
    """A sample that proposes little, or nothing at all, changes the passes and not the result."""
    monkeypatch.setattr(phrases, "SAMPLE_SUPPORT", support)
    passes = []
    real = phrases.counted
    monkeypatch.setattr(phrases, "counted", lambda *args: passes.append(args) or real(*args))
    own = rows(5, 120)
    assert got(words.frame(spark, own), support=4) == plain(own, support=4)
    assert len(passes) == 2 if support > 2 else len(passes) <= 2


def test_a_full_filter_only_costs_work(spark, monkeypatch):
    monkeypatch.setattr(phrases, "LEAST_BITS", 7)
    monkeypatch.setattr(phrases, "MOST_BITS", 7)
    monkeypatch.setattr(phrases, "KEPT_WORDS", 3)
    own = rows(6, 120)
    assert got(words.frame(spark, own)) == plain(own)


def test_empty_tables(spark):
    assert got(words.frame(spark, [])) == []
    assert got(words.frame(spark, [(1, None, None, None), (2, "", "en", None)])) == []


def test_products_pass_64_bits(spark, monkeypatch):
    big = 6_000_000_000
    known = spark.createDataFrame(
        [("en", 0, "", 10 * big), ("en", 1, "a", big + 7), ("en", 1, "b", big + 1), ("en", 2, "a b", big)],
        "lang string, words int, phrase string, n long",
    )
    monkeypatch.setattr(phrases, "frequent_phrases", lambda docs, support: known)
    assert got(words.frame(spark, [])) == [
        ("en", 1, "a b", big, big + 7, big + 1, 10 * big, 1_000_000 * big * big // ((big + 7) * (big + 1)))
    ]
