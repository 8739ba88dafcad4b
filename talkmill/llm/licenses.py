"""Licence scan: sparse TF-IDF cosine to templates, then inheritance along directories.

Three rules find a document's own licence, all with the same kind of cosine:

- whole sentences, or windows of long ones, against one-sentence templates;
- runs of terms as long as each template, wherever they begin, so that a statement inside a
  sentence, a comment or a wrapped line counts; and SPDX identifiers, read as they are;
- the whole text against whole licence texts and file headers (``license_texts``), as one vector
  each, joined on terms, so that wrapping and length do not matter.

A text that uses no licence word at all (``STATEMENT_WORDS``) states no licence. Others are cut into
sentences, long ones into windows of terms; each is compared with every
template by TF-IDF cosine (idf over the templates; an unknown term weighs as one that no template
has). A sentence can only reach the threshold if it holds some of a template's heaviest terms, so
sentences without any are passed over first; nothing that would match is lost; texts without any are passed over before they are cut at all. The best
match is a document's own licence, that of the whole text before others. A document that is a
whole licence text or header, or nearly all of whose words are in matching sentences, is a licence
file, and a document without a licence of its own inherits from the licence file in its nearest
ancestor directory, found by joins on paths.

All of it is DataFrame expressions over one row, but for the joins on directories.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.functions.text import let
from talkmill.llm.common import saved

THRESHOLD = 0.7
#: Terms of a window, and from one window to the next, in sentences that are longer.
WINDOW, STEP = 32, 16
#: A licence file has at least this share of its words in matching sentences.
FILE_SHARE = 0.9
#: Cosine of a whole text to a whole licence text or header from which on it is a licence file.
WHOLE = 0.85
#: First terms of runs that are looked at together.
STRETCH = 32

# Statements by which texts and files declare public licences.
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)

#: Words that all texts hold; they only steer which terms :meth:`Space.anchors` takes.
EVERYDAY = frozenset("a and are as be by from in is it of or that the this to with".split())
#: Likewise, where they can be: numbers, and words of other subjects.
COMMON = frozenset("1.0 2 2.0 3 4.0 v version use copy file files form forms free code terms charge met later subject person work international general conditions associated following provided documentation domain universal can either any except without into may not you under".split())
#: A whole licence text uses one of these, whatever its cosine; so do all of ``license_texts``.
LICENCE_WORDS = ("licens", "licenc", "copyright", "permission", "warrant", "redistribut")

#: A text that makes any statement uses one of these, as all templates and SPDX tags do.
STATEMENT_WORDS = (*LICENCE_WORDS, "public domain", "cc0")

#: SPDX identifiers, lower case, and what they are called here.
SPDX = {name.lower(): name for name in {n for n, _ in TEMPLATES} | {"BSD-2-Clause", "ISC", "LGPL-2.1"}}
SPDX |= {i + end: name for i, name in SPDX.items() if "gpl" in i for end in ("+", "-only", "-or-later")}

SPDX_ID = r"\(*[a-z0-9]+(?:[.+-]+[a-z0-9]+)*\+?\)*"
SPDX_TAG = "spdx-license-identifier"

SENTENCE = r"[\r\n]+|(?<=[.!?])\s+"
SEPARATOR = r"[^a-z0-9.+-]+"


def terms_of(text: str) -> list[str]:
    """Lower-cased terms of a sentence, without the full stop at their end."""
    return [t for t in (re.sub(r"\.+$", "", t) for t in re.split(SEPARATOR, text.lower())) if t]


def whole_templates() -> list[tuple[str, str]]:
    """Names and texts of whole licences and of the headers they ask for."""
    files = sorted((Path(__file__).parent / "license_texts").glob("*.txt"))
    return [(f.name.removesuffix(".txt").removesuffix(".header"), f.read_text()) for f in files]


class Space:
    """TF-IDF weights of a set of templates."""

    def __init__(self, templates=TEMPLATES) -> None:
        self.counts = [(name, Counter(terms_of(text))) for name, text in templates]
        seen = Counter(t for _, c in self.counts for t in c)
        n = len(self.counts)
        idf = lambda df: math.log((1 + n) / (1 + df)) + 1
        self.idf = {t: idf(seen[t]) for t in sorted(seen)}
        self.unknown = idf(0)
        self.vectors = []
        for name, count in self.counts:
            own = {t: k * self.idf[t] for t, k in sorted(count.items())}
            norm = math.sqrt(sum(w * w for w in own.values()))
            self.vectors.append((name, {t: w / norm for t, w in own.items()}))

    def anchors(self, threshold: float, only: int | None = None) -> tuple[list[str], list[list[str]]]:
        """Terms of which a sentence must hold one to reach ``threshold`` with any template, or else
        all terms of one of the further lists: the cosine is at most the length of the template's
        vector on the shared terms. Any terms will do that leave too little of the vector; where
        only everyday words could, the sentence needs each without which the others are too little.
        ``only`` is the number of one template."""
        out: set[str] = set()
        together = []
        for _, vector in self.vectors if only is None else [self.vectors[only]]:
            rest = 1.0
            everyday = {t: w**2 for t, w in vector.items() if t in EVERYDAY}
            for term, weight in sorted(vector.items(), key=lambda x: (x[0] in COMMON, -x[1], x[0])):
                if rest >= threshold**2 and term not in EVERYDAY:
                    out.add(term)
                    rest -= weight**2
            if rest >= threshold**2:
                together.append([t for t, w in everyday.items() if rest - w < threshold**2])
        return sorted(out), together


def _holds(terms: Column, anchors: tuple[list[str], list[list[str]]]) -> Column:
    one, together = anchors
    some = F.exists(terms, lambda t: t.isin(one))
    for needed in together:
        some = some | reduce(lambda a, b: a & b, [F.array_contains(terms, t) for t in needed], F.lit(True))
    return some


def _terms(sentence: Column) -> Column:
    cut = F.transform(F.split(sentence, SEPARATOR), lambda t: F.rtrim(t, F.lit(".")))
    return F.filter(cut, lambda t: t != "")


def _windows(terms: Column) -> Column:
    size = F.size(terms)
    many = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), size - (WINDOW - STEP)), F.lit(STEP)),
        lambda i: F.slice(terms, i, F.lit(WINDOW)),
    )
    return F.when(size <= WINDOW, F.array(terms)).otherwise(many)


def _map(values: dict[str, float]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def _within_reach(terms: Column, space: Space, threshold: float) -> Column:
    """Whether a window can reach ``threshold`` at all. Unknown terms weigh the most, so with s the
    sum of squared counts of the known terms and o the number of unknown ones the squared cosine is
    at most s / (s + o)."""
    known = F.filter(terms, lambda t: t.isin(list(space.idf)))
    often = F.transform(known, lambda t: F.size(F.filter(known, lambda u: u == t)))
    squares = F.aggregate(often, F.lit(0), lambda a, b: a + b)
    return squares >= threshold**2 * (squares + F.size(terms) - F.size(known)) - 1e-9


def _match(terms: Column, space: Space) -> Column:
    """Best ``(cosine, name)`` of one window; equal cosines go to the later name."""
    weight = lambda t: F.coalesce(F.try_element_at(_map(space.idf), t), F.lit(space.unknown))
    often = lambda t: F.size(F.filter(terms, lambda u: u == t))
    add = lambda values: F.aggregate(values, F.lit(0.0), lambda a, b: a + b)
    norm = F.sqrt(add(F.transform(terms, lambda t: often(t) * weight(t) * weight(t))))

    def product(vector: dict[str, float]) -> Column:
        return add(F.transform(terms, lambda t: weight(t) * F.coalesce(F.try_element_at(_map(vector), t), F.lit(0.0))))

    best = F.array_max(
        F.array(*(F.struct(product(v).alias("dot"), F.lit(name).alias("name")) for name, v in space.vectors))
    )
    return F.struct(
        F.round(F.try_divide(best["dot"], norm), 6).alias("cosine"), best["name"].alias("name"), F.size(terms).alias("words")
    )


def _may_hold(low: Column, anchors: tuple[list[str], list[list[str]]]) -> Column:
    """False only for lower-case texts whose terms do not hold the anchors."""
    one, together = anchors
    some = reduce(lambda a, b: a | b, [F.contains(low, F.lit(a)) for a in one])
    some = some & low.rlike(r"(?<![a-z0-9.+-])(?:" + "|".join(map(re.escape, one)) + r")(?![a-z0-9+-])")
    for needed in together:
        some = some | reduce(lambda a, b: a & b, [F.contains(low, F.lit(t)) for t in needed], F.lit(True))
    return some


def _stretches(terms: Column, space: Space, longest: int, anchors: tuple[list[str], list[list[str]]]) -> Column:
    """``(terms, weights, known)`` of overlapping stretches of a text's terms, so that each run of
    up to ``longest`` terms is in the one that its first term belongs to; without an anchor: none."""
    cut = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(terms) - 1), F.lit(STRETCH)),
        lambda i: F.slice(terms, i + 1, F.lit(STRETCH + longest - 1)),
    )
    held = F.filter(cut, lambda part: _holds(part, anchors))
    weight = lambda t: F.coalesce(F.try_element_at(_map(space.idf), t), F.lit(space.unknown))
    return F.transform(
        held,
        lambda part: F.struct(
            part.alias("terms"),
            F.transform(part, weight).alias("weights"),
            F.array_distinct(F.filter(part, lambda t: t.isin(list(space.idf)))).alias("known"),
        ),
    )


def _runs(part: Column, space: Space, number: int, threshold: float) -> Column:
    """``(cosine, name)`` of a stretch's runs of as many terms as the template has."""
    name, vector = space.vectors[number]
    n = sum(space.counts[number][1].values())
    anchors = space.anchors(threshold, number)
    add = lambda values: F.aggregate(values, F.lit(0.0), lambda a, b: a + b)
    shared = reduce(
        lambda a, b: a + b, [F.when(F.array_contains(part["known"], t), w * w).otherwise(0.0) for t, w in vector.items()]
    )

    def cosine(i: Column) -> Column:
        terms, weights = F.slice(part["terms"], i, F.lit(n)), F.slice(part["weights"], i, F.lit(n))
        both = F.arrays_zip(terms.alias("t"), weights.alias("w"))
        own = F.zip_with(terms, weights, lambda t, w: w * F.coalesce(F.try_element_at(_map(vector), t), F.lit(0.0)))
        often = lambda t: F.size(F.filter(terms, lambda u: u == t))
        norm = F.sqrt(add(F.zip_with(terms, weights, lambda t, w: often(t) * w * w)))
        return F.round(F.try_divide(add(own), norm), 6)

    last = F.least(F.lit(STRETCH), F.size(part["terms"]) - (n - 1))
    first = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    anchored = F.filter(first, lambda i: _holds(F.slice(part["terms"], i, F.lit(n)), anchors))
    found = F.transform(anchored, lambda i: F.struct(cosine(i).alias("cosine"), F.lit(name).alias("name")))
    # No run's cosine is above the length of the template's vector on the terms in the stretch.
    return F.when(shared >= threshold**2 - 1e-9, F.filter(found, lambda m: m["cosine"] >= threshold))


def _inside(stretches: Column, space: Space, threshold: float) -> Column:
    def best(part: Column) -> Column:
        nothing = F.array().cast("array<struct<cosine:double,name:string>>")
        runs = [F.coalesce(_runs(part, space, i, threshold), nothing) for i in range(len(space.vectors))]
        return F.array_max(F.flatten(F.array(*runs)))

    return F.array_max(F.transform(stretches, best))


def _spdx(low: Column) -> Column:
    """``(1.0, name)`` of the known identifier after an SPDX tag, the latest name of several."""
    tag = SPDX_TAG + r":\s*(" + SPDX_ID + r"(?:[ \t]+(?:or|and|with)[ \t]+" + SPDX_ID + ")*)"
    ids = F.flatten(F.transform(F.regexp_extract_all(low, F.lit(tag), 1), lambda x: F.split(x, r"[ \t()]+")))
    names = F.create_map(*(F.lit(x) for pair in sorted(SPDX.items()) for x in pair))
    known = F.filter(F.transform(ids, lambda i: F.try_element_at(names, i)), lambda n: n.isNotNull())
    found = F.when(F.contains(low, F.lit(SPDX_TAG)), F.array_max(known))
    return F.when(found.isNotNull(), F.struct(F.lit(1.0).alias("cosine"), found.alias("name")))


def _bag(terms: Column) -> Column:
    """``(term, n)`` of each distinct term of a sorted array, which must be bound by ``let``."""
    places = F.sequence(F.lit(1), F.size(terms))
    first = F.filter(places, lambda i: (i == 1) | (F.get(terms, i - 1) != F.get(terms, i - 2)))

    def counted(first: Column) -> Column:
        return F.transform(
            first,
            lambda i, k: F.struct(
                F.get(terms, i - 1).alias("term"), (F.coalesce(F.get(first, k + 1), F.size(terms) + 1) - i).alias("n")
            ),
        )

    return let(first, counted)


def _found(docs: DataFrame, directory: Column, threshold: float) -> DataFrame:
    """``doc_id, directory``, what the whole sentences say (``best, is_file``), the best statement
    ``inside`` them, and the ``bag`` of terms of texts that may be a whole licence text."""
    space = Space()
    anchors = space.anchors(threshold)
    longest = max(sum(count.values()) for _, count in space.counts)

    def anchored(part: Column) -> Column:
        return _holds(F.transform(F.split(part, SEPARATOR), lambda t: F.rtrim(t, F.lit("."))), anchors)

    low = F.col("low")
    none = F.array().cast("array<string>")
    held = docs.select(
        "doc_id", directory.alias("directory"), F.lower(F.coalesce(F.col("text"), F.lit(""))).alias("low")
    ).select(
        "doc_id",
        "directory",
        "low",
        (reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in STATEMENT_WORDS]) & _may_hold(low, anchors)).alias("near"),
        reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in LICENCE_WORDS]).alias("maybe_whole"),
    )
    cut = held.select(
        "doc_id",
        "directory",
        "maybe_whole",
        F.when(F.col("near"), F.filter(F.split(low, SENTENCE), anchored)).otherwise(none).alias("sentences"),
        F.when(F.col("near"), F.regexp_count(low, F.lit(r"\S+"))).otherwise(0).alias("all_words"),
        F.when(F.col("near") | F.col("maybe_whole"), _terms(low)).otherwise(none).alias("terms"),
        _spdx(low).alias("spdx"),
    )
    windows = F.flatten(F.transform("sentences", lambda s: _windows(_terms(s))))
    parts = cut.withColumn("windows", F.filter(windows, lambda w: _within_reach(w, space, threshold))).withColumn(
        "stretches", _stretches(F.col("terms"), space, longest, anchors)
    )
    scored = parts.withColumn(
        "matches", F.filter(F.transform("windows", lambda w: _match(w, space)), lambda m: m["cosine"] >= threshold)
    )
    words = F.aggregate("matches", F.lit(0), lambda a, m: a + m["words"])
    best = F.array_max("matches")
    return scored.select(
        "doc_id",
        "directory",
        F.when(best.isNotNull(), F.struct(best["cosine"].alias("cosine"), best["name"].alias("name"))).alias("best"),
        F.coalesce((F.size("matches") > 0) & (words >= F.col("all_words") * FILE_SHARE), F.lit(False)).alias("is_file"),
        F.greatest(_inside(F.col("stretches"), space, threshold), F.col("spdx")).alias("inside"),
        # Bound once: as a plain column the sorted array would be made anew for every term.
        F.when(F.col("maybe_whole") & (F.size("terms") > 0), let(F.array_sort("terms"), _bag)).alias("bag"),
    )


def own_licenses(docs: DataFrame, directory: Column, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, directory, license, score, is_file`` of every row by its whole sentences alone;
    null and 0 without a match."""
    return _found(docs, directory, threshold).select(
        "doc_id",
        "directory",
        F.col("best.name").alias("license"),
        F.coalesce("best.cosine", F.lit(0.0)).alias("score"),
        "is_file",
    )


def whole_licenses(bags: DataFrame) -> DataFrame:
    """``key, whole``: ``(cosine, name)`` of the licence text or header nearest to each bag of terms
    ``(key, bag)``, where it is near enough."""
    space = Space(whole_templates())
    rows = [(t, w, [v.get(t, 0.0) for _, v in space.vectors]) for t, w in space.idf.items()]
    weights = bags.sparkSession.createDataFrame(rows, "term string, idf double, shares array<double>")
    each = (
        bags.select("key", F.explode("bag").alias("one"))
        .select("key", "one.term", "one.n")
        .join(F.broadcast(weights), "term", "left")
        .select("key", (F.col("n") * F.coalesce("idf", F.lit(space.unknown))).alias("w"), "shares")
    )
    sums = [F.sum(F.coalesce(F.col("w") * F.col("shares")[i], F.lit(0.0))) for i in range(len(space.vectors))]
    cosines = [
        F.struct(F.round(total / F.sqrt(F.sum(F.col("w") * F.col("w"))), 6).alias("cosine"), F.lit(name).alias("name"))
        for total, (name, _) in zip(sums, space.vectors)
    ]
    return each.groupBy("key").agg(F.greatest(*cosines).alias("whole")).where(F.col("whole.cosine") >= WHOLE)


def ancestors(directory: Column) -> Column:
    """``(path, depth)`` of a directory and all above it, the root (empty path, depth 0) included."""
    parts = F.filter(F.split(directory, "/"), lambda p: p != "")
    return F.transform(
        F.sequence(F.lit(0), F.size(parts)),
        lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), "/").alias("path"), k.alias("depth")),
    )


def scan(docs: DataFrame, directory: Column, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, directory, license, score, origin`` of every row of ``docs``.

    ``origin`` is ``own``, ``inherited`` (score then is the licence file's) or ``none``. A text that is
    a whole licence text or header has that licence. Of several statements in others the one with the
    highest cosine counts, the later name among equals; of several licence files in a directory
    likewise. ``directory`` is a path with ``/``; null is the root.
    Null and empty texts have no licence of their own. Repeated rows come out as often.
    """
    found = saved(
        _found(docs, F.coalesce(directory, F.lit("")), threshold).withColumn("key", F.monotonically_increasing_id()),
        "found-licenses",
    )
    whole = whole_licenses(found.where("bag is not null").select("key", "bag"))
    kept = found.select("key", "doc_id", "directory", "is_file", F.greatest("best", "inside").alias("stated"))
    mine = F.coalesce("whole", "stated")
    own = saved(
        kept.join(whole, "key", "left").select(
            "doc_id",
            "directory",
            mine["name"].alias("license"),
            F.coalesce(mine["cosine"], F.lit(0.0)).alias("score"),
            (F.col("is_file") | F.col("whole").isNotNull()).alias("is_file"),
        ),
        "own-licenses",
    )
    files = (
        own.where("is_file")
        .select(F.element_at(ancestors(F.col("directory")), -1)["path"].alias("path"), "score", "license")
        .groupBy("path")
        .agg(F.max(F.struct("score", "license")).alias("file"))
    )
    places = (
        own.where("license is null")
        .select("directory")
        .distinct()
        .select("directory", F.explode(ancestors(F.col("directory"))).alias("above"))
        .select("directory", "above.path", "above.depth")
        .join(files, "path")
        .groupBy("directory")
        .agg(F.max_by("file", "depth").alias("file"))
    )
    given = own.join(places, "directory", "left")
    mine = F.col("license").isNotNull()
    return given.select(
        "doc_id",
        "directory",
        F.coalesce("license", "file.license").alias("license"),
        F.when(mine, F.col("score")).otherwise(F.coalesce("file.score", F.lit(0.0))).alias("score"),
        F.when(mine, "own").when(F.col("file").isNotNull(), "inherited").otherwise("none").alias("origin"),
    )
