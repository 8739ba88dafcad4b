"""URL rules, exact top-k and licences against plain statements of their rules."""

import math
import random
import re
import textwrap

import numpy as np
import pytest

import oracle
import words
from pyspark.sql import functions as F
from talkmill.llm import licenses, url_rules, vector_file
from talkmill.llm.queries import ORACLES, QUERIES, URL_RULES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    message, rows = oracle.compare(QUERIES[name](spark, SF), oracle.connect(SF), ORACLES[name])
    assert message == "" and rows > 0


def plain_judgement(url, rules, default="allow"):
    found = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda m: m.group().lower(), found[1]), found[2]) if found else ("", "")
    fits = [
        (len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[3] if best else default


URLS = [
    None, "", "no scheme", "http://", "http://Example.COM/en/x", "https://www.example.com/en/", "ftp://a.www.example.com/en/1?x#y",
    "http://example.com/EN/", "http://example.com", "http://com/", "http://badexample.com/en/", "http://site.net/es/1", "http://net/fr/",
    "http://site.net/es", "x://y://z.com/", "http://a.b#://c.com/", "http://ÄB.com/", "http://a..com/x", "http://u@h.net:80/es/", "://q.com/",
    "http://e.com/\n/x",
]


def test_judgements(spark):
    rules = [*URL_RULES, ("a.b.c", "/", "block"), ("c", "/aa", "allow"), ("c", "/aabbccdd", "block")]
    urls = [*URLS, "http://a.b.c/aabbccddee", "http://a.b.c/aabb", "http://x.a.b.c/"]
    pages = words.clashing(spark.createDataFrame(list(enumerate(urls)) + [(None, urls[4]), (0, urls[5])], "page_id long, url string"))
    frame = spark.createDataFrame([*rules, ("com", "/", "allow"), (None, "/", "block")], "host string, path string, verdict string")
    got = sorted((tuple(r) for r in url_rules.judge(pages, frame).collect()), key=repr)
    expected = [(r["page_id"], *plain_judgement(r["url"], rules)) for r in pages.collect()]
    assert got == sorted(expected, key=repr)


def test_rules_in_several_index_files(spark, monkeypatch):
    monkeypatch.setattr(url_rules, "SLICE_RULES", 7)
    r = random.Random(1)
    hosts = ["a.com", "b.a.com", "com", "c.net", "net", "d.c.net"]
    rules = {(r.choice(hosts), "/" + "".join(r.choices("xy", k=r.randint(0, 3)))): r.choice(["allow", "block"]) for _ in range(40)}
    rules = [(*k, v) for k, v in rules.items()]
    urls = [f"http://{r.choice(['', 'w.'])}{r.choice(hosts)}/{''.join(r.choices('xyz', k=4))}" for _ in range(200)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    frame = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = sorted(tuple(x) for x in url_rules.judge(pages, frame).collect())
    assert got == [(i, *plain_judgement(u, rules)) for i, u in enumerate(urls)]


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert [tuple(r) for r in url_rules.judge(pages, none).collect()] == [(1, "a.com", "/", None, "allow")]
    assert url_rules.judge(pages.limit(0), none).collect() == []


def test_colliding_digests_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(url_rules.xxhash, "xxh64_intdigest", lambda key, seed=0: len(key) % 3)
    file = tmp_path / "i"
    url_rules.write_index(list(URL_RULES), file)
    index = url_rules.Index(str(file))
    for url in URLS:
        host, path, rule, verdict = plain_judgement(url, URL_RULES)
        best = index.best([host], [path])[0]
        assert (best[1] + best[2] if best else None) == rule


# --- vectors ---

VECTORS = "vec_id long, embedding array<float>"


def plain_top(rows, k=10, step=100):
    def whole(e):
        return [math.floor(1024 * float(np.float32(x))) for x in e]

    ok = [(i, whole(e)) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for q in sorted({i for i, _ in ok if i % step == 0}):
        own = min(v for i, v in ok if i == q)
        scored = sorted(
            ((-sum(a * b for a, b in zip(own, v)), i) for i, v in ok if i != q and len(v) == len(own))
        )
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)]
    return out


def top(spark, rows, k=10, step=100):
    frame = spark.createDataFrame(rows, VECTORS)
    return sorted(tuple(r) for r in vector_file.top_k(frame, F.col("vec_id") % step == 0, k).collect())


def test_top_k_equals_all_scores(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(0, 0.2, 12).astype(np.float32).tolist()) for i in range(700)]
    assert top(spark, rows, 10, 50) == plain_top(rows, 10, 50)


def test_top_k_in_slices_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector_file, "SLICE_BYTES", 8 * 6 * 3)
    monkeypatch.setattr(vector_file, "BLOCK", 16)
    r = np.random.default_rng(2)
    rows = [(i, (r.integers(-3, 4, 6) / 1024).tolist()) for i in range(300)]  # many ties
    assert top(spark, rows, 4, 10) == plain_top(rows, 4, 10)


def test_many_queries_keep_the_matrices_small(spark, monkeypatch):
    monkeypatch.setattr(vector_file, "BLOCK", 16)
    monkeypatch.setattr(vector_file, "ENTRIES", 16 * 7)
    monkeypatch.setattr(vector_file, "HELD", 500)
    bounds = vector_file.bounds

    def small(q, low, high):
        assert len(q) * len(low) <= 16 * 7
        return bounds(q, low, high)

    monkeypatch.setattr(vector_file, "bounds", small)
    r = np.random.default_rng(5)
    rows = [(i, (r.integers(-3, 4, 6) / 1024).tolist()) for i in range(400)]
    edges = (np.tile(np.arange(-2.0, 253.0), (6, 1)), np.full(6, -3.0), np.full(6, 3.0))
    v = np.array([e for _, e in rows]) * 1024
    cells = vector_file.cells_of(v, edges[0])
    file = spark.createDataFrame([(i, i, bytes(c)) for i, c in enumerate(cells)], "cid long, vec_id long, cells binary")
    seen = {}

    class Kept:  # runs a task's function here, where the patched values hold
        sparkSession = spark

        def mapInArrow(self, run, schema):
            seen["rows"] = [x for b in run(file.toArrow().to_batches()) for x in b.to_pylist()]

    ids = np.arange(0, 400, 2)
    vector_file._scan(Kept(), ids, v[ids], edges, 3)
    got = {(x["query_id"], x["cid"]) for x in seen["rows"]}
    for i in ids:
        scores = sorted(((-(v[i] @ v[j]), j) for j in range(400) if j != i))
        assert all((i, j) in got for s, j in scores if s <= scores[2][0])


def test_one_vector_that_most_rows_share(spark):
    r = np.random.default_rng(3)
    hot = [0.5, -0.25, 0.125]
    rows = [(i, hot if i % 3 else r.normal(0, 1, 3).astype(np.float32).tolist()) for i in range(900)]
    assert top(spark, rows) == plain_top(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [0.5, 9.0]), (100, [3.0, None]), (200, None), (300, [nan, 1.0]), (400, [inf, 1.0]),
        (500, []), (501, []), (600, [1.0, 2.0, 3.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [-1.0, 0.0]), (None, [1.0, 1.0]),
        (-100, [1.0, 0.0]), (700, [0.0, 0.0]),
    ]
    assert top(spark, rows, 3) == plain_top(rows, 3)
    assert top(spark, [], 3) == []
    assert top(spark, [(1, [1.0])], 3) == []


def test_large_components_are_exact(spark):
    assert [s for *_, s in top(spark, [(0, [1.0, 0.0]), (1, [40_000.0, 0.0]), (2, [50_000.0, 0.0])], 2)] == [52_428_800_000, 41_943_040_000]
    r = np.random.default_rng(8)
    rows = [(i, r.uniform(-1e6, 1e6, 24).astype(np.float32).tolist()) for i in range(300)]
    assert top(spark, rows, 5, 20) == plain_top(rows, 5, 20)
    rows = [(i, r.uniform(-3e4, 3e4, 4096).astype(np.float32).tolist()) for i in range(40)]
    assert top(spark, rows, 3, 10) == plain_top(rows, 3, 10)
    # Sums on the way pass a long, the score does not.
    big = [2.0**31, 2.0**31, 1.0]
    rows = [(0, big), (1, [2.0**31, -(2.0**31), 3.0]), (2, [-(2.0**31), 2.0**31, 4.0])]
    assert top(spark, rows, 2) == plain_top(rows, 2)


def test_what_no_long_can_hold_is_an_error(spark):
    for rows in ([(0, [1e30]), (1, [1.0])], [(0, [2.0**40]), (1, [2.0**40])]):
        with pytest.raises(Exception, match="2\\^53|overflow|OVERFLOW|out of range|OUT_OF_RANGE"):
            top(spark, rows, 1)


def test_many_slices_with_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(vector_file, "SLICE_BYTES", 8 * 4)
    r = np.random.default_rng(9)
    rows = [(i, (r.integers(-9, 9, 4) / 1024).tolist()) for i in range(240)]
    frame = spark.createDataFrame(rows, VECTORS)
    clash = frame.select("*", *[F.lit(1).alias(n) for n in ("v", "cid", "place", "score", "query_id", "n", "lower", "one", "rank")])
    shipped = []
    real = vector_file.ship
    monkeypatch.setattr(vector_file, "ship", lambda s, v: shipped.append(1) or real(s, v))
    got = sorted(tuple(x) for x in vector_file.top_k(clash, F.col("vec_id") % 2 == 0, 3).collect())
    assert got == plain_top(rows, 3, 2) and len(shipped) > 50


def test_bounds_hold():
    r = np.random.default_rng(4)
    v = np.floor(r.normal(0, 300, (500, 8)))
    inner = np.ceil(np.quantile(v[:100], np.arange(1, 256) / 256, axis=0)).T
    low, high = vector_file.corners(inner, v.min(0), v.max(0))
    cells = vector_file.cells_of(v, inner)
    d = np.arange(8)
    assert (low[d, cells] <= v).all() and (v <= high[d, cells]).all()
    q = np.floor(r.normal(0, 300, (20, 8)))
    lower, upper = vector_file.bounds(q, low[d, cells], high[d, cells])
    assert (lower <= q @ v.T).all() and (q @ v.T <= upper).all()


# --- licences ---


def plain_license(text):
    space, best = licenses.Space(), None
    if not any(w in (text or "").lower() for w in licenses.STATEMENT_WORDS):
        return None, 0.0, False
    matched, all_words = 0, len(re.findall(r"\S+", text or ""))
    for sentence in re.split(licenses.SENTENCE, (text or "").lower()):
        terms = licenses.terms_of(sentence)
        n = len(terms)
        starts = [0] if n <= licenses.WINDOW else range(0, n - (licenses.WINDOW - licenses.STEP), licenses.STEP)
        for i in starts:
            own = terms[i : i + licenses.WINDOW]
            if not own:
                continue
            weight = lambda t: space.idf.get(t, space.unknown)
            norm = math.sqrt(sum((own.count(t) * weight(t)) ** 2 for t in set(own)))
            found = max((sum(weight(t) * v.get(t, 0.0) for t in own) / norm, name) for name, v in space.vectors)
            if round(found[0], 6) >= licenses.THRESHOLD:
                matched += len(own)
                best = max(best or (0, ""), (round(found[0], 6), found[1]))
    return (best[1], best[0], matched >= licenses.FILE_SHARE * all_words) if best else (None, 0.0, False)


def test_own_licenses_equal_the_plain_rule(spark):
    r = random.Random(6)
    plain = words.vocabulary(4, 200)
    rows = []
    for i in range(200):
        lines = [words.text(r, plain, r.randint(1, 60)) for _ in range(r.randint(0, 4))]
        if i % 2:
            own = r.choice(licenses.TEMPLATES)[1].split()
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                own[r.randrange(len(own))] = r.choice(plain)
            lines.insert(r.randint(0, len(lines)), " ".join(own))
        rows.append((i, r.choice(["\n", ". ", " "]).join(lines), "en", "s"))
    got = licenses.own_licenses(words.frame(spark, rows), F.lit("d")).collect()
    for x in got:
        name, score, is_file = plain_license(rows[x["doc_id"]][1])
        assert (x["license"], x["is_file"]) == (name, is_file), rows[x["doc_id"]]
        assert x["score"] == pytest.approx(score, abs=2e-6)
    assert sum(x["license"] is not None for x in got) > 50


MIT, GPL = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."


def test_inheritance_from_the_nearest_directory(spark):
    rows = [
        (1, MIT, "", "/a"), (2, "text", "", "a/b/c"), (3, GPL, "", "a/b/"), (4, "text", "", "a/x"), (5, "text", "", "z"),
        (6, "own words and more of them\n" + MIT, "", "a/b/c"), (7, None, "", "a/b"), (8, "text", "", None), (9, "text", "", "ab"),
        (None, "text", "", "a//b/"),
    ]
    docs = words.clashing(words.frame(spark, rows))
    got = {r["doc_id"]: (r["license"], r["origin"]) for r in licenses.scan(docs, F.col("source")).collect()}
    assert got == {
        1: ("MIT", "own"), 2: ("GPL-3.0", "inherited"), 3: ("GPL-3.0", "own"), 4: ("MIT", "inherited"), 5: (None, "none"),
        6: ("MIT", "own"), 7: ("GPL-3.0", "inherited"), 8: (None, "none"), 9: (None, "none"), None: ("GPL-3.0", "inherited"),
    }


def test_a_root_licence_reaches_all(spark):
    rows = [(1, MIT, "", None), (2, "text", "", "a/b"), (3, "text", "", "")]
    got = licenses.scan(words.frame(spark, rows), F.col("source")).collect()
    assert {(r["doc_id"], r["license"]) for r in got} == {(1, "MIT"), (2, "MIT"), (3, "MIT")}


def test_licences_of_hostile_rows(spark):
    docs = words.clashing(words.frame(spark, words.hostile_rows()))
    got = licenses.scan(docs, F.col("source")).collect()
    assert len(got) == len(words.hostile_rows()) and {r["origin"] for r in got} == {"none"}
    assert licenses.scan(words.frame(spark, []), F.col("source")).collect() == []


def test_the_licence_plan_stays_in_the_jvm(spark):
    plan = licenses.own_licenses(words.frame(spark, [(1, MIT, "", "")]), F.lit(""))._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "UDF" not in plan


def judged(spark, texts):
    rows = [(i, t, "", f"d{i}") for i, t in enumerate(texts)]
    got = licenses.scan(words.frame(spark, rows), F.col("source")).collect()
    return [(r["license"], r["origin"]) for r in sorted(got, key=lambda r: r["doc_id"])]


def wrapped(text, width, start=""):
    return "\n".join(start + line for line in textwrap.wrap(" ".join(text.split()), width))


def test_whole_licence_texts_are_licence_files(spark):
    texts = [(n, t.replace("Copyright (c)", "Copyright (c) 2024 Some Company, Inc.")) for n, t in licenses.whole_templates()]
    shapes = [lambda t: t, lambda t: " ".join(t.split()), lambda t: wrapped(t, 50, " * ")]
    rows, names = [], []
    for i, (name, text) in enumerate(texts):
        for j, shape in enumerate(shapes):
            rows += [(len(rows), shape(text), "", f"/{i}/{j}"), (len(rows) + 1, "own words", "", f"{i}/{j}/src/lib")]
            names += [(name, "own"), (name, "inherited")]
    got = licenses.scan(words.frame(spark, rows), F.col("source")).collect()
    assert [(r["license"], r["origin"]) for r in sorted(got, key=lambda r: r["doc_id"])] == names


def test_a_header_above_other_text_is_no_licence_file(spark):
    header = dict(licenses.whole_templates()[::-1])["Apache-2.0"]  # the first of the name: the header
    own = words.text(random.Random(3), words.vocabulary(3), 400)
    rows = [(1, wrapped(header, 70, "# ") + "\n" + own, "", "a"), (2, "text", "", "a")]
    got = {r["doc_id"]: (r["license"], r["origin"]) for r in licenses.scan(words.frame(spark, rows), F.col("source")).collect()}
    assert got == {1: ("Apache-2.0", "own"), 2: (None, "none")}


def test_statements_inside_sentences_comments_and_wrapped_lines(spark):
    own = words.text(random.Random(4), words.vocabulary(4), 90)
    bsd = next(t for n, t in licenses.TEMPLATES if t.startswith("Redistribution"))
    assert judged(
        spark,
        [
            "This program is licensed under the MIT license (see LICENSE).",
            f"{own} the library that we use here is released under the MIT License {own}",
            "Copyright 2024 Foo Authors, all rights reserved, licensed under CC BY-NC 4.0.",
            "// SPDX-License-Identifier: MIT\n" + own,
            "/* SPDX-License-Identifier: (GPL-2.0-or-later WITH Linux-syscall-note) */ " + own,
            own + "\n" + wrapped(bsd, 40, "# ") + "\n" + own,
            own + "\n * Licensed under the Apache\n * License, Version 2.0 (the \"License\")\n" + own,
            "SPDX-License-Identifier: Foo-1.0 " + own,
            own + " Released under " + own,
        ],
    ) == [
        ("MIT", "own"), ("MIT", "own"), ("CC-BY-NC-4.0", "own"), ("MIT", "own"), ("GPL-2.0", "own"), ("BSD-3-Clause", "own"),
        ("Apache-2.0", "own"), (None, "none"), (None, "none"),
    ]


def test_every_template_uses_a_licence_word():
    texts = [t for _, t in (*licenses.TEMPLATES, *licenses.whole_templates())] + [licenses.SPDX_TAG]
    assert all(any(w in t.lower() for w in licenses.STATEMENT_WORDS) for t in texts)


def plain_inside(low):
    """Best cosine of any run of terms that is as long as a template."""
    space, terms, best = licenses.Space(), licenses.terms_of(low), (0.0, "")
    if not any(w in low for w in licenses.STATEMENT_WORDS):
        return 0.0, None
    for (name, v), (_, count) in zip(space.vectors, space.counts):
        n = sum(count.values())
        for i in range(len(terms) - n + 1):
            own = terms[i : i + n]
            weight = lambda t: space.idf.get(t, space.unknown)
            norm = math.sqrt(sum((own.count(t) * weight(t)) ** 2 for t in set(own)))
            best = max(best, (round(sum(weight(t) * v.get(t, 0.0) for t in own) / norm, 6), name))
    return best if best[0] >= licenses.THRESHOLD else (0.0, None)


def test_statements_inside_equal_the_plain_rule(spark):
    r = random.Random(8)
    plain = words.vocabulary(4, 60) + ["license", "released", "mit", "under", "the", "version", "public"]
    rows = []
    for i in range(150):
        own = r.choice(licenses.TEMPLATES)[1].split()
        for _ in range(r.choice([0, 1, 2, 4])):
            own[r.randrange(len(own))] = r.choice(plain)
        around = [words.text(r, plain, r.randint(0, 80)) for _ in range(2)]
        rows.append((i, r.choice([" ", "\n"]).join([around[0], *own, around[1]]), "en", "s"))
    got = licenses._found(words.frame(spark, rows), F.lit("d"), licenses.THRESHOLD).collect()
    for x in got:
        score, name = plain_inside(rows[x["doc_id"]][1].lower())
        assert (x["inside"] and x["inside"]["name"]) == name, rows[x["doc_id"]]
        assert (x["inside"]["cosine"] if name else 0.0) == pytest.approx(score, abs=2e-6)
    assert sum(x["inside"] is not None for x in got) > 50
