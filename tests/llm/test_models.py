"""Language identification and toxicity: held-out accuracy, odd rows, and edge cases."""

import random

import numpy as np
import pytest

import words
from pyspark.sql import functions as F
from talkmill.llm import language, toxicity


def corpus(spark, n=240):
    r = random.Random(7)
    by_lang = {lang: words.vocabulary(seed) for seed, lang in enumerate(("aa", "bb", "cc"))}
    for seed, lang in enumerate(by_lang):
        by_lang[lang] = [w.replace("k", "kqx"[seed]).replace("t", "tjz"[seed]) + "aeo"[seed] for w in by_lang[lang]]
    rows = []
    for i in range(n):
        lang = ("aa", "bb", "cc")[i % 3]
        rows.append((i, words.text(r, by_lang[lang], r.randint(4, 80)), lang, "s"))
    return rows


def test_language_of_held_out_rows(spark):
    docs = words.frame(spark, corpus(spark))
    model = language.train(docs, ~language.held_out())
    got = language.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id")
    held = got.where(language.held_out()).collect()
    assert len(held) > 30
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.collect())


def test_language_is_the_plain_rule(spark):
    """Posterior of a plain statement of the rule, gram by gram."""
    docs = words.frame(spark, corpus(spark, 60))
    model = language.train(docs, F.lit(True))
    texts = ["Kalo mi TEN", "x", "mi-mi", "漢 kalo"]
    got = language.posteriors(model, texts)
    for row, text in zip(got, texts):
        letters = "".join(c if c.isalpha() else " " for c in text.lower()) + " "
        while "  " in letters:
            letters = letters.replace("  ", " ")
        total = model.prior.copy()
        for n in language.ORDERS:
            for k in range(len(letters) - n + 1):
                gram = letters[k : k + n]
                if gram != " ":
                    total += model.matrix[bucket(gram)].astype(float)
        p = np.exp(total - total.max())
        assert row == pytest.approx(p / p.sum(), abs=1e-6)


def bucket(gram):
    h = np.uint32(len(gram))
    with np.errstate(over="ignore"):
        for c in gram:
            h = (h ^ np.uint32(ord(c))) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        return int(h * np.uint32(0x85EBCA6B) >> np.uint32(32 - language.BITS))


def test_language_ignores_labels_of_rows_it_may_not_learn_from(spark):
    rows = corpus(spark, 120)
    docs = words.frame(spark, rows)
    held = {r["doc_id"] for r in docs.where(language.held_out()).collect()}
    spoiled = words.frame(spark, [(i, t, "zz" if i in held else lang, s) for i, t, lang, s in rows])
    a = language.train(docs, ~language.held_out())
    b = language.train(spoiled, ~language.held_out())
    assert a.languages == b.languages and np.array_equal(a.matrix, b.matrix)


def test_language_of_hostile_rows(spark):
    docs = words.clashing(words.frame(spark, words.hostile_rows()))
    model = language.train(docs, ~language.held_out())
    got = language.predict(docs, model).collect()
    assert len(got) == len(words.hostile_rows())
    unknown = [r for r in got if r["lang_pred"] == "und"]
    assert sorted((r["doc_id"] or 0) for r in unknown) == [0, 2, 3, 4, 8]
    assert language.train(words.frame(spark, []), F.lit(True)) is None
    assert {r["lang_pred"] for r in language.predict(docs, None).collect()} == {"und"}


MARKS = ["blargh", "grumfus", "zotwick"]


def toxic_corpus(n=900):
    r = random.Random(3)
    plain = words.vocabulary(5, 600)
    rows, labels = [], []
    for i in range(n):
        own = r.choices(plain, k=r.randint(8, 150))
        if i % 6 == 0:
            for _ in range(max(1, len(own) // 25)):
                own.insert(r.randrange(len(own)), r.choice(MARKS))
        rows.append((i, " ".join(own), "en", "s"))
        labels.append((i, 0, int(i % 6 == 0)))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def test_toxic_held_out_rows(spark):
    rows, labels = toxic_corpus()
    docs, marks = words.frame(spark, rows), spark.createDataFrame(labels, LABELS)
    model = toxicity.train(docs, marks, ~toxicity.held_out())
    got = toxicity.score(docs, model).withColumn("held", toxicity.held_out()).collect()
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r["held"]]
    assert len(held) > 200
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and (r["score"] >= 0.7) == bool(r["predicted"]) for r in got)
    kept = {r["doc_id"] for r in toxicity.reject_toxic(docs, marks).collect()}
    assert kept == {r["doc_id"] for r in got if not r["predicted"]}


def test_toxicity_ignores_labels_it_may_not_learn_from(spark):
    rows, labels = toxic_corpus(300)
    docs = words.frame(spark, rows)
    held = {r["doc_id"] for r in docs.where(toxicity.held_out()).collect()}
    a = toxicity.train(docs, spark.createDataFrame(labels, LABELS), ~toxicity.held_out())
    spoiled = [(i, q, 1 - t if i in held else t) for i, q, t in labels]
    b = toxicity.train(docs, spark.createDataFrame(spoiled, LABELS), ~toxicity.held_out())
    assert a.toxic == b.toxic and a.ordinary == b.ordinary and np.allclose(a.weights, b.weights)


def test_a_marked_window_far_inside_a_long_text_counts(spark):
    rows, labels = toxic_corpus(600)
    docs = words.frame(spark, rows)
    model = toxicity.train(docs, spark.createDataFrame(labels, LABELS), F.lit(True))
    r = random.Random(1)
    long = words.text(r, words.vocabulary(5, 600), 3_000)
    marked = long + " " + " ".join(MARKS * 60)
    got = [x["score"] for x in toxicity.score(words.frame(spark, [(1, long, "", ""), (2, marked, "", "")]), model).orderBy("doc_id").collect()]
    assert got[0] < 0.7 <= got[1]


def test_toxicity_of_hostile_rows(spark):
    rows, labels = toxic_corpus(200)
    odd = [(None if k is None else 10_000 + k, *rest) for k, *rest in words.hostile_rows()]
    docs = words.clashing(words.frame(spark, rows + odd))
    marks = spark.createDataFrame([*labels, (None, 0, 1), (10_001, None, None), (10_002, 0, 1), (77_777, 0, 1), (0, 0, 0)], LABELS)
    model = toxicity.train(docs, marks, ~toxicity.held_out())
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) + len(odd)
    assert docs.columns == toxicity.reject_toxic(docs, marks).columns


def test_toxicity_without_both_classes(spark):
    docs = words.frame(spark, words.hostile_rows())
    none = spark.createDataFrame([], LABELS)
    assert toxicity.train(docs, none, F.lit(True)) is None
    assert {r["score"] for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.reject_toxic(docs, none).count() == docs.count()
    empty = words.frame(spark, [])
    assert toxicity.score(empty, None).collect() == []


def test_windows_cover_the_whole_text():
    text = bytes(range(65, 91)) * 30
    covered = np.zeros(len(text), bool)
    for k, w in enumerate(toxicity.windows(text)):
        begin = k * toxicity.STEP
        assert text[begin : begin + len(w)] == w
        covered[begin : begin + len(w)] = True
    assert covered.all()


def test_the_toxicity_sample_has_one_row_for_each_id(spark):
    docs = words.frame(spark, [(1, f"text {i}", "en", "s") for i in range(50)] + [(2, "b", "en", "s"), (3, None, "en", "s")])
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    got = toxicity._sample(docs, labels, F.lit(True), 5, 5).collect()
    assert sorted((r["doc_id"], r["toxic"]) for r in got) == [(1, 1), (2, 0), (3, 0)]
