"""Packing: pieces against the tokenizers library, sequences for wholeness and fill."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import words
from talkmill.llm import packing

BYTES = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(BYTES)
OWN = packing.Encoder(BYTES)


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


LETTERS = st.characters(max_codepoint=0x24F)
PARTS = st.one_of(
    st.sampled_from(["'s", "'LL", " ", "\n\n", "\t ", "\x1c", "\x85", "\xa0", "ª", "²", "12", "<|endoftext|>", "漢", "é"]),
    st.text(LETTERS, max_size=4),
    st.characters(),
)


@settings(max_examples=1_500, deadline=None)
@given(st.lists(PARTS, max_size=12).map("".join))
def test_ids_are_the_librarys(text):
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    assert OWN.ids(text).tolist() == library_ids(text)


@pytest.mark.parametrize("letter", ["a", " ", "1", "ab", ". "])
def test_long_unbroken_texts(letter):
    text = letter * 60_000
    assert OWN.ids(text).tolist() == library_ids(text)


def plain_pieces(rows, size):
    out = []
    for key, text, *_ in rows:
        ids = [*library_ids(text), 0]
        first = len(ids) % size or size
        cuts = [0, *range(first, len(ids) + 1, size)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            out.append((key, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return sorted(out, key=repr)


def checked(rows, size):
    """Whether ``rows`` of pack() are whole: gapless sequences of ``size`` at most; their number."""
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return len(by_sequence)


@pytest.mark.parametrize("size", [16, 256])
def test_packs_every_piece_once(spark, size):
    r = random.Random(size)
    vocabulary = words.vocabulary(2)
    rows = [(i, words.text(r, vocabulary, r.randint(0, size // 2)), "en", "a") for i in range(500)]
    rows += [(9_000, "the same text again", "en", "b")] * 300 + words.hostile_rows()
    docs = words.clashing(words.frame(spark, rows)).repartition(6)
    got = packing.pack(docs, BYTES, size=size).collect()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted((tuple(x[n] for n in names) for x in got), key=repr) == plain_pieces(rows, size)
    n, total = checked(got, size), sum(x["length"] for x in got)
    assert n <= -(-total // size) * 1.03 + 1


def test_sequences_hold_the_ids(spark):
    rows = [(1, "one two three", "en", "a"), (None, None, "en", "a"), (3, "x " * 90, "en", "a")]
    packed = packing.pack(words.frame(spark, rows), BYTES, size=32, with_ids=True)
    packed = spark.createDataFrame(packed.collect(), packed.schema)
    found = packing.sequences(packed).collect()
    every = [i for s in found for i in np.frombuffer(s["ids"], "<u4").tolist()]
    assert sorted(every) == sorted(i for _, t, *_ in rows for i in [*library_ids(t), 0])
    assert all(len(s["ids"]) == 4 * s["n_tokens"] for s in found)


def test_empty_table(spark):
    assert packing.pack(words.frame(spark, []), BYTES).collect() == []


def best_fit_plainly(lengths, size):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, space in enumerate(bins) if space >= n]
        if fits:
            i = min(fits, key=lambda i: bins[i])
            bins[i] -= n
        else:
            bins.append(size - n)
    return len(bins)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.integers(40, 50))
def test_counted_best_fit_is_best_fit(lengths, size):
    histogram = np.bincount(lengths, minlength=size + 1) if lengths else np.zeros(size + 1, int)
    bins = packing.best_fit(histogram.astype(np.int64), size)
    assert sum(b.count for b in bins) == best_fit_plainly(lengths, size)
    found = np.zeros(size + 1, np.int64)
    for b in bins:
        assert sum(n * k for n, k in b.runs) <= size
        for n, k in b.runs:
            found[n] += k * b.count
    assert found.tolist() == histogram.tolist()


def test_patterns_are_all_exact_ones():
    present = np.array([False] + [True] * 20)
    found = {tuple(int(v) for v in row) for row in packing.patterns(present, 20)}
    two = {(0, i, 20 - i) for i in range(1, 11)}
    three = {(i, j, 20 - i - j) for i in range(1, 20) for j in range(i, 20) if 20 - i - j >= j}
    assert found == two | three


@pytest.mark.parametrize("scale", [30, 3_000])
def test_patterns_fill_most_sequences(scale):
    """Spread lengths: the fit places most pieces, and all but a sliver of the space is used."""
    r = np.random.default_rng(scale)
    lengths = np.minimum(np.maximum(r.lognormal(4.2, 0.8, scale * 50).astype(int), 1), 256)
    histogram = np.bincount(lengths, minlength=257).astype(np.int64)
    left = histogram.copy()
    left[256] = 0
    packing.rounded(*packing.fitted(left, 256), left)
    lower = -(-int(lengths.sum()) // 256)
    used = sum(b.count for b in packing.plan(histogram, 256))
    assert used <= lower * 1.005 + 1
    if scale > 100:
        assert left.sum() < 0.5 * histogram.sum()
