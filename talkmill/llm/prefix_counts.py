"""Exact token counts at every prefix of a text, by dynamic programming.

In a byte-level merge vocabulary the tokens of a piece of text without its last token are the
tokens of the shorter piece. So the last token at a prefix of length j is the one w[i:j] that
may follow the last token at length i, and ``count[j] = count[i] + 1``: one pass gives the
count at every prefix. Whether two tokens may stand side by side is found once by undoing
their merges at the border and then remembered.

A text is cut where a blank follows a non-blank: no piece of the vocabulary's splitting
pattern spans such a place, so counts of the pieces add up, for every prefix. The same pieces
come again and again; a worker keeps their counts, in bounded memory.
"""

from __future__ import annotations

import json
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from talkmill.llm.common import slices, small, worker_value

#: Fixed value: the pattern by which the vocabulary splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries that a worker keeps for units, split words (twice), token pairs and beginnings of words,
#: in about 350 MB.
KEPT_UNITS, KEPT_WORDS, KEPT_PAIRS, KEPT_STEMS = 800_000, 250_000, 300_000, 60_000
#: Counts that the kept units may have in all, and characters of a split word that is kept: very
#: long unbroken texts are not.
KEPT_COUNTS, KEPT_LENGTH = 1 << 24, 256
#: Bytes of a word's beginning whose states are kept: words share them often.
STEM = 5
#: Texts with letters beyond are split by the tokenizer's own splitter, since versions of the letter
#: tables differ.
PLAIN = "\u024f"
#: Marks that are one token behind a word.
TAILS = ".,;:!?"
SLICE = 1 << 19


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary: printable Latin-1
    characters for themselves, the others moved up, in order, from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(moved)}


class Units(dict):
    """Place of the counts of each unit, a piece of text behind ``lead``; new ones are added."""

    def __init__(self, counter: Counter, lead: str) -> None:
        self.counter, self.lead = counter, lead

    def __missing__(self, piece: str) -> int:
        place = self[piece] = self.counter.add(self.lead + piece)
        return place


class Counter:
    """Prefix counts with one vocabulary; one per worker."""

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.specials = [t["content"] for t in model["added_tokens"]]
        self.split = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}
        self.tokens = {a + b for a, b in self.rank} | {bytes([b]) for b in range(256)}
        self.longest = max(map(len, self.tokens))
        self.words: dict[str, bytes | list[int]] = {}
        self.older: dict[str, bytes | list[int]] = {}
        self.stems: dict[bytes, tuple[tuple[bytes, ...], tuple[int, ...]]] = {}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.origins: dict[bytes, tuple[int, bytes, bytes] | None] = {}  # one a token of the vocabulary at most
        self.pattern, self.blanks = regex.compile(PATTERN), regex.compile(r"\s+")
        self.cut = regex.compile(r"(?<=\S)(?= )")
        self.blank_pair = regex.compile(r"\s ")
        self.reset()

    def reset(self) -> None:
        self.units = [Units(self, ""), Units(self, " ")]
        self.pool, self.ends = array("i"), array("q", [0])

    def merged(self, parts: list[bytes], least: int = 1) -> list[bytes]:
        """``parts`` after all merges, lowest rank first, leftmost among equals, down to ``least``."""
        rank = self.rank
        while len(parts) > least:
            best = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), 1 << 40))
            if (parts[best], parts[best + 1]) not in rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def made(self, token: bytes) -> tuple[int, bytes, bytes] | None:
        """The merge that makes a token last, as its rank and its two sides; rank -1 for a byte, and
        None where the token's bytes do not become that token."""
        if token not in self.origins:
            parts = self.merged([token[i : i + 1] for i in range(len(token))], 2)
            rank = self.rank.get(tuple(parts)) if len(parts) == 2 else None
            own = (-1, token, token) if len(token) == 1 else None
            self.origins[token] = own if rank is None else (rank, *parts)
        return self.origins[token]

    def follows(self, a: bytes, b: bytes) -> bool:
        """Whether the tokens of a's and b's bytes together are exactly a and b; a is the token of
        its bytes, or empty."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self.made(b) is not None and (not a or self.apart(a, b))
        return known

    def apart(self, a: bytes, b: bytes) -> bool:
        """Whether no merge joins a and b across their border. Their own merges are undone, the last
        one first: the two parts at the border must have no merge that comes before the one undone.
        Of equal merges the left one comes first."""
        rank, made, before = self.rank, self.made, len(self.rank)
        while True:
            if rank.get((a, b), before) < before:
                return False
            (left, _, a_end), (right, b_begin, _) = made(a), made(b)
            if left > right:
                before, a = left, a_end
            elif right >= 0:
                before, b = right + 1, b_begin
            else:
                return True

    def chain(self, word: str) -> bytes | list[int]:
        """Counts at each character of one piece of the pattern, taken as a text of its own.
        Words of the last and the current generation are kept."""
        known = self.words.get(word) or self.older.get(word)
        if known is None:
            known = self._chain(word.encode("utf-8", "surrogatepass"))
            if len(word) > KEPT_LENGTH:
                return known
        elif word in self.words:
            return known
        if len(self.words) >= KEPT_WORDS:
            self.older, self.words = self.words, {}
        self.words[word] = known
        return known

    def _chain(self, text: bytes) -> bytes | list[int]:
        tokens, pairs, follows, longest = self.tokens, self.pairs.get, self.follows, self.longest
        stem = self.stems.get(text[:STEM])
        last, count = (list(stem[0]), list(stem[1])) if stem else ([b""], [0])
        for j in range(len(last), len(text) + 1):
            for i in range(max(0, j - longest), j):
                token = text[i:j]
                if token in tokens:
                    fits = pairs((last[i], token))
                    if fits or (fits is None and follows(last[i], token)):
                        last.append(token)
                        count.append(count[i] + 1)
                        break
            if j == STEM:
                if len(self.stems) >= KEPT_STEMS:
                    self.stems.clear()
                self.stems[text[:STEM]] = (tuple(last), tuple(count))
        if not text.isascii():
            count = [count[j] for j in range(len(text)) if text[j] & 0xC0 != 0x80] + count[-1:]
        return bytes(count[1:]) if max(count) < 256 else count[1:]

    def unit_counts(self, unit: str) -> bytes | list[int]:
        """Counts at each character of a text without special tokens."""
        if unit[1:].isalpha() and max(unit) <= PLAIN and (unit[0] == " " or unit[0].isalpha()):
            return self.chain(unit)  # the common case: a blank and letters
        if unit[-1] in TAILS and unit[1:-1].isalpha() and max(unit) <= PLAIN and (unit[0] == " " or unit[0].isalpha()):
            own = self.chain(unit[:-1])
            return own + bytes([own[-1] + 1]) if isinstance(own, bytes) and own[-1] < 255 else [*own, own[-1] + 1]
        return self._by_pattern(unit)

    def split_words(self, unit: str) -> list[str]:
        """The pieces of the pattern."""
        if max(unit) <= PLAIN:
            return self.pattern.findall(unit)
        return [unit[begin:end] for _, (begin, end) in self.library.pre_tokenizer.pre_tokenize_str(unit)]

    def _by_pattern(self, unit: str) -> list[int]:
        out: list[int] = []
        for word in self.split_words(unit):
            base, own = out[-1] if out else 0, self.chain(word)
            if len(word) == 3 and word[0] == "'" and word[1] != "'" and word in ("'re", "'ve", "'ll"):
                own = [1, self.chain("'")[0] + self.chain(word[1])[0], own[-1]]
            out += [base + n for n in own] if base else own
        for found in self.blanks.finditer(unit):
            begin, end = found.span()
            if end - begin > 1:  # a prefix that ends in blanks has all of them in one piece
                base = out[begin - 1] if begin else 0
                out[begin:end] = [base + n for n in self.chain(found.group())]
        return out

    def add(self, unit: str) -> int:
        self.pool.extend(self.unit_counts(unit))
        self.ends.append(len(self.pool))
        return len(self.ends) - 2

    def pieces(self, text: str) -> list[str]:
        """``text`` cut where a blank follows a non-blank; all but the first without that blank."""
        if text[:1] != " " and not self.blank_pair.search(text):
            return text.split(" ")
        first, *rest = self.cut.split(text)
        return [first, *(r[1:] for r in rest)]

    def spans(self, text: str):
        """Parts between special tokens, each with whether a special token ends it."""
        if not self.split:
            yield text, ""
            return
        at = 0
        for found in self.split.finditer(text):
            yield text[at : found.start()], found.group()
            at = found.end()
        yield text[at:], ""

    def prefix_counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Counts at every character of all texts in one array, and where each text ends."""
        if sum(map(len, self.units)) > KEPT_UNITS or len(self.pool) > KEPT_COUNTS:
            self.reset()
        first_units, units = self.units
        places: list[np.ndarray] = []
        specials: list[tuple[int, str, str]] = []
        ends, at = np.zeros(len(texts), np.int64), 0
        for i, text in enumerate(texts):
            for part, special in self.spans(text):
                if part:
                    own = self.pieces(part)
                    found = np.fromiter(map(units.__getitem__, own), np.int64, len(own)) if len(own) > 1 else np.zeros(1, np.int64)
                    found[0] = first_units[own[0]]
                    places.append(found)
                    at += len(part)
                if special:
                    specials.append((at, part, special))
                    places.append(np.array([-len(special)], np.int64))
                    at += len(special)
            ends[i] = at
        if not places:
            return np.zeros(0, np.int64), ends
        place = np.concatenate(places)
        known = np.maximum(place, 0)
        pool, unit_ends = np.frombuffer(self.pool, np.int32), np.frombuffer(self.ends, np.int64)
        if not len(pool):
            pool, unit_ends = np.zeros(1, np.int32), np.array([0, 1])
        size = np.where(place < 0, -place, unit_ends[known + 1] - unit_ends[known])
        begin = np.where(place < 0, 0, unit_ends[known])
        total = np.where(place < 0, 1, pool[unit_ends[known + 1] - 1])
        first = np.cumsum(size) - size
        text_first = np.concatenate([[0], ends[:-1]])
        before = np.cumsum(total) - total
        # Counting starts anew in each text: take off what stood before its first unit.
        head = np.searchsorted(first, text_first)
        offset = np.append(before, before[-1] + total[-1])[head]
        base = before - offset[np.searchsorted(text_first, first, side="right") - 1]
        where = np.arange(int(size.sum())) + np.repeat(begin - first, size)
        counts = np.repeat(base, size) + pool[np.minimum(where, len(pool) - 1)]
        del pool, unit_ends  # else the arrays could not grow
        for start, part, special in specials:
            # A prefix that ends inside a special token is ordinary text going on from the part.
            extra = self.stem_prefixes(part + special[:-1], len(part))
            opened = start - len(part)
            upto = 0 if self._starts(opened, text_first) else counts[opened - 1]
            counts[start : start + len(special) - 1] = upto + np.array(extra)
            counts[start + len(special) - 1] = (counts[start - 1] if part else upto) + 1
        return counts, ends

    @staticmethod
    def _starts(at: int, text_first: np.ndarray) -> bool:
        i = np.searchsorted(text_first, at)
        return bool(i < len(text_first) and text_first[i] == at)

    def stem_prefixes(self, text: str, after: int) -> list[int]:
        """Counts of the prefixes of ``text`` longer than ``after``, piece by piece."""
        out, base, at = [], 0, 0
        first, *rest = self.pieces(text)
        for piece in (first, *(" " + r for r in rest)):
            if at + len(piece) > after:
                own = self.unit_counts(piece)
                out += [base + n for n in own[max(0, after - at) :]]
            base += self.unit_counts(piece)[-1]
            at += len(piece)
        return out


def counter(path: str) -> Counter:
    return worker_value(("prefix counter", path), lambda: Counter(path), large=True)


def longest_within(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def prefix_table(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, counts array<int>``: the exact token count of every prefix of every text, one
    entry per character. Empty for a null or empty text."""

    def run(batches):
        own = counter(path)
        for batch in small(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = batch.column(0)
            for a, b in slices([len(t) for t in texts], SLICE):
                counts, ends = own.prefix_counts(texts[a:b])
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(counts.astype(np.int32))
                )
                yield pa.RecordBatch.from_arrays([ids[a:b], lists], names=["doc_id", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, counts array<int>")


def answers(docs: DataFrame, path: str, limit: int) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, cut_chars`` read off the prefix counts of every
    whole text: its length in UTF-8 and in tokens, whether it has more than ``limit`` tokens, and
    the characters of its longest prefix of at most ``limit``. Null counts as empty; repeated
    rows are counted each. Prefix counts live in the task only, about 0.5 million at a time."""

    def run(batches):
        own = counter(path)
        for batch in small(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens, cuts = [], []
            for a, b in slices([len(t) for t in texts], SLICE):
                counts, ends = own.prefix_counts(texts[a:b])
                for begin, end in zip([0, *ends[:-1]], ends):
                    tokens.append(int(counts[end - 1]) if end > begin else 0)
                    cuts.append(longest_within(counts[begin:end], limit))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_()),
                    pa.array(cuts, pa.int64()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "cut_chars"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, cut_chars long"
    )
