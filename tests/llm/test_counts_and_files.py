"""Prefix counts and token-id files against the tokenizers themselves."""

import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import words
from talkmill.llm import prefix_counts, token_files

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = ["a", "b", "'", "s", "re", "ll", "ve", " ", "  ", "\n", "\t", "é", "ß", "<|endoftext|>", "<|endo", "12", "!",
          "...", "the", " moron", "漢", " ", " ", "😀", "é", "İ", "ǅ", "\x1c", "\x85"]


def library_prefixes(library, text):
    return [len(library.encode(text[:j], add_special_tokens=False).ids) for j in range(1, len(text) + 1)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_every_prefix_count_is_the_librarys(text):
    own = prefix_counts.counter(BYTES)
    counts, ends = own.prefix_counts(["x y", text, " z", text])
    expected = library_prefixes(own.library, text)
    assert counts[ends[0] : ends[1]].tolist() == expected
    assert counts[ends[2] : ends[3]].tolist() == expected


RARE = ["мир", "’s", "’", "'re", "“", "—", "日本語", "の", "😀", "👩‍👩‍👧", "é", " ", "\u3000", "\u2003", "a", "12", "٣", "𝒜", "ⅷ", "\u200d", "\ufeff",
        "ꟊ", "🫠", "\n", "!", "<|endoftext|>"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(RARE), max_size=30).map("".join))
def test_every_prefix_count_of_other_scripts_is_the_librarys(text):
    own = prefix_counts.counter(BYTES)
    counts, ends = own.prefix_counts(["я x", text])
    assert counts[ends[0] :].tolist() == library_prefixes(own.library, text)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=80))
def test_every_prefix_count_of_any_text_is_the_librarys(text):
    own = prefix_counts.counter(BYTES)
    assert own.prefix_counts([text])[0].tolist() == library_prefixes(own.library, text)


def test_neighbours_are_those_that_merging_leaves():
    own, r = prefix_counts.Counter(BYTES), random.Random(6)
    tokens = sorted(t for t in own.tokens if own.made(t))
    short = [t for t in tokens if len(t) < 4]
    pairs = [(r.choice(short), r.choice(short)) for _ in range(20_000)] + [(r.choice(tokens), r.choice(tokens)) for _ in range(5_000)]
    pairs += [(t[:i], t[i:]) for t in r.sample(tokens, 3_000) for i in range(1, len(t)) if t[:i] in own.tokens and t[i:] in own.tokens and own.made(t[:i])]
    for a, b in [*pairs, *((t, t) for t in tokens[::7])]:
        text = a + b
        assert own.follows(a, b) == (own.merged([text[i : i + 1] for i in range(len(text))]) == [a, b]), (a, b)


def test_unbroken_texts_are_counted_in_one_pass():
    """Many letters without a blank: no prefix is encoded, and a sample of them agrees."""
    r = random.Random(8)
    for letters, n in (("abcdefgh", 100_000), ("дружба", 20_000), ("日本語漢字仮名", 20_000), ("😀🎉🫠", 10_000)):
        own = prefix_counts.Counter(BYTES)
        text = "".join(r.choice(letters) for _ in range(n))
        library, own.library = own.library, Splitter(own.library)
        counts, _ = own.prefix_counts([text])
        assert len(counts) == len(text) and not own.words
        for j in [1, 2, 3, 64, 65, 1_000, n - 1, n]:
            assert counts[j - 1] == len(library.encode(text[:j], add_special_tokens=False).ids)


class Splitter:
    """A tokenizer that can split but not encode."""

    def __init__(self, library):
        self.pre_tokenizer = library.pre_tokenizer


def test_counts_survive_full_caches(monkeypatch):
    for name in ("KEPT_UNITS", "KEPT_WORDS", "KEPT_PAIRS", "KEPT_STEMS", "KEPT_COUNTS", "KEPT_LENGTH"):
        monkeypatch.setattr(prefix_counts, name, 5)
    own = prefix_counts.Counter(BYTES)
    r = random.Random(4)
    for _ in range(20):
        text = words.text(r, words.vocabulary(1), 20)
        counts, _ = own.prefix_counts([text])
        assert counts.tolist() == library_prefixes(own.library, text)


def test_answers_on_hostile_rows(spark):
    docs = words.clashing(words.frame(spark, words.hostile_rows()))
    got = prefix_counts.answers(docs, BYTES, 6).collect()
    library = Tokenizer.from_file(BYTES)
    expected = []
    for key, text, *_ in words.hostile_rows():
        text = text or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        expected.append((key, len(text.encode()), n, n > 6))
    key = lambda r: (r[0] is None, r)
    assert sorted((tuple(r)[:4] for r in got), key=repr) == sorted(expected, key=repr)
    short = {r["n_bytes"]: r["cut_chars"] for r in got if not r["over_limit"]}
    for _, text, *_ in words.hostile_rows():
        if text and len(text) < 40 and len(text.encode()) in short:
            assert short[len(text.encode())] == len(text)


def test_longest_prefix_within_a_budget(spark):
    own = prefix_counts.counter(BYTES)
    text = "it're the of moronic ñandú 12345"
    counts, _ = own.prefix_counts([text])
    for budget in range(0, 12):
        best = max([j for j, n in enumerate(library_prefixes(own.library, text), 1) if n <= budget], default=0)
        assert prefix_counts.longest_within(counts, budget) == best


def test_prefix_table_holds_every_count(spark):
    got = prefix_counts.prefix_table(words.frame(spark, [(1, "two words", "", ""), (2, None, "", "")]), BYTES)
    rows = {r["doc_id"]: r["counts"] for r in got.collect()}
    assert rows[2] == []
    assert rows[1] == library_prefixes(prefix_counts.counter(BYTES).library, "two words")


def test_empty_tables(spark, tmp_path):
    empty = words.frame(spark, [])
    assert prefix_counts.answers(empty, BYTES, 5).collect() == []
    token_files.write(empty, WORDS, str(tmp_path / "f"), 2)
    assert token_files.read(spark, str(tmp_path / "f")).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=60))
def test_ranks_round_trip(values):
    v = np.array(values, np.uint32)
    control, data = token_files.encode_ranks(v)
    assert len(control) == -(-len(v) // 4)
    assert token_files.decode_ranks(control, data, len(v)).tolist() == values


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 70_000), min_size=1, max_size=200))
def test_segments_round_trip_and_rank_by_frequency(ids):
    ranks, control, data = token_files.pack(np.array(ids, np.uint32))
    assert token_files.unpack(ranks, control, data, len(ids)).tolist() == ids
    table = np.frombuffer(ranks, "<u4").tolist()
    often = [ids.count(i) for i in table]
    assert often == sorted(often, reverse=True)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*PIECES, "Σ", "ΑΣ", "ﬁ", "\r\n", "́"]), max_size=14).map("".join))
def test_pieces_encode_like_whole_texts(text):
    own = token_files.encoder(WORDS)
    ids, n = own.encode([text, "and " + text])
    expected = own.library.encode(text, add_special_tokens=False).ids
    assert ids[: n[0]].tolist() == expected


def test_ids_survive_a_full_table(monkeypatch):
    monkeypatch.setattr(token_files, "KEPT_PIECES", 40)
    own = token_files.Encoder(WORDS)
    r = random.Random(8)
    for _ in range(60):
        texts = [words.text(r, words.vocabulary(1), 15) + r.choice(["", ".", "!?", " x***"]) for _ in range(3)]
        ids, n = own.encode(texts)
        expected = [own.plain(t) for t in texts]
        assert ids.tolist() == sum(expected, []) and n.tolist() == [len(e) for e in expected]
        assert len(own.places) < 40 + 60


def expected_file(rows, end_id=2):
    library = Tokenizer.from_file(WORDS)
    out, start = [], 0
    for key, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [end_id]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_in_id_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_IDS", 50)
    r = random.Random(2)
    rows = [(i * 7 % 101, words.text(r, words.vocabulary(3), r.randint(0, 60)), "", "") for i in range(101)]
    rows[5] = (rows[5][0], None, "", "")
    token_files.write(words.frame(spark, rows).repartition(5), WORDS, str(tmp_path / "f"), 2)
    got = sorted(tuple(r) for r in token_files.read(spark, str(tmp_path / "f")).collect())
    assert got == expected_file(sorted((k, t) for k, t, *_ in rows))


def test_files_of_hostile_rows(spark, tmp_path):
    docs = words.clashing(words.frame(spark, words.hostile_rows()))
    token_files.write(docs, WORDS, str(tmp_path / "f"), 2)
    got = [tuple(r) for r in token_files.read(spark, str(tmp_path / "f")).collect()]
    expected = expected_file([(k, t) for k, t, *_ in words.hostile_rows()])
    plain = lambda rows: sorted(((k, n, c) for k, _, n, c in rows), key=repr)
    assert plain(got) == plain(expected)
    by_start = sorted(got, key=lambda r: r[1])
    assert [r[1] for r in by_start] == np.cumsum([0, *(r[2] for r in by_start)])[:-1].tolist()
    ids = [-1 if r[0] is None else r[0] for r in by_start]
    assert ids == sorted(ids)
