"""Packing documents into token sequences of fixed size by length patterns.

Documents are encoded once, where they are read; only longer ones than a sequence are cut. What
is left to decide depends on the histogram of piece lengths alone, which has one number for each
length: patterns of two and three lengths that fill a sequence exactly are enumerated, their
repeat counts fitted to the histogram by non-negative least squares and rounded, and what
remains is packed by best fit, largest first, counting equal sequences instead of listing them.

Pieces then find their places without meeting each other: tasks number the pieces of each length,
and the plan, a table of runs (the pieces of one length from number to number go to these
sequences at this offset), travels with the tasks. Its size depends on the sequence size, not on
the number of documents.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from talkmill.llm.common import saved, ship, slices, small, worker_value

#: Fixed value: the pattern by which the vocabulary splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts within these letters and without longer unbroken runs take the faster of two encoders.
FAMILIAR = re.compile(r"[^\x00-ɏ]")
RUNS = re.compile(r"\s{0,999}+(?:\S{1,999}+\s{1,999}+)*+\S{0,999}+")
#: Rounds of the fit, patterns that join in a round, and steps in a round.
ROUNDS, JOINING, STEPS = 30, 600, 150
#: Bits for the number of a piece among those of its length.
NUMBER_BITS = 44


class Encoder:
    """Token ids as the tokenizers library gives them. The library's vocabulary is also loaded
    into tiktoken, which merges the same tokens several times as fast; texts with special tokens,
    letters beyond U+024F (letter tables differ) or runs of a thousand characters without a
    boundary go to the library itself."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        self.specials = [t["content"] for t in config["added_tokens"]]
        self.fast = self._fast(config)

    def _fast(self, config: dict):
        """None for a vocabulary of another kind: then the library does all."""
        model, split = config["model"], config["pre_tokenizer"] or {}
        bytewise = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        if model["type"] != "BPE" or not bytewise or config["normalizer"]:
            return None
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        moved = [b for b in range(256) if b not in own]
        letters = {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(moved)}
        ranks = {
            bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in self.specials
        }
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        order = [model["vocab"][a + b] for a, b in merges]
        if order != sorted(order):  # ids must stand in order of the merges
            return None
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe

    def ids(self, text: str) -> np.ndarray:
        familiar = text.isascii() or not FAMILIAR.search(text)
        if self.fast and familiar and not any(s in text for s in self.specials) and RUNS.fullmatch(text):
            return np.frombuffer(self.fast.encode_to_tiktoken_buffer(text, set()), np.uint32)
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)


def pieces(docs: DataFrame, tokenizer: str, size: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, part, within`` (and ``ids``, little-endian
    uint32) of every document's pieces of at most ``size`` tokens, ``end_id`` counted. Only longer
    documents are cut, the first piece takes what does not fill one. ``within`` numbers the pieces
    of one length in one ``part``. A null text is empty."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        own = worker_value(("packing encoder", tokenizer), lambda: Encoder(tokenizer), large=True)
        part, numbers = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        end = np.array([end_id], np.uint32)
        for batch in small(batches):
            texts = batch.column(1).to_pylist()
            for a, b in slices([len(t or "") for t in texts]):
                row, piece, start, length, crc, within, held = [], [], [], [], [], [], []
                for i in range(a, b):
                    ids = np.concatenate([own.ids(texts[i] or ""), end]).astype("<u4")
                    raw, n = memoryview(ids.tobytes()), len(ids)
                    begin, stop = 0, (n - 1) % size + 1
                    while begin < n:
                        row.append(i)
                        piece.append(begin and -(-begin // size))
                        start.append(begin)
                        length.append(stop - begin)
                        cut = raw[4 * begin : 4 * stop]
                        crc.append(zlib.crc32(cut))
                        within.append(int(numbers[stop - begin]))
                        numbers[stop - begin] += 1
                        if with_ids:
                            held.append(bytes(cut))
                        begin, stop = stop, stop + size
                columns = [
                    batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                    pa.array([part] * len(row), pa.int32()), pa.array(within, pa.int64()),
                    *([pa.array(held, pa.binary())] if with_ids else []),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=NAMES[: len(columns)])

    columns = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, within long"
    return docs.select("doc_id", "text").mapInArrow(run, columns + (", ids binary" if with_ids else ""))


NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "within", "ids"]


def patterns(present: np.ndarray, size: int) -> np.ndarray:
    """All rows of two or three lengths, in order, that add up to ``size``; 0 fills up pairs."""
    lengths = np.flatnonzero(present[:size])
    lengths = lengths[lengths > 0]
    pairs = lengths[(2 * lengths <= size) & present[size - lengths]]
    rows = [np.column_stack([np.zeros_like(pairs), pairs, size - pairs])]
    for i in lengths[3 * lengths <= size]:
        j = lengths[(lengths >= i) & (2 * lengths <= size - i)]
        j = j[present[size - i - j]]
        rows.append(np.column_stack([np.full_like(j, i), j, size - i - j]))
    return np.concatenate(rows)


def fitted(histogram: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns and how often to repeat each (not whole numbers), by least squares with no
    negative repeat. Residuals weigh by length, as short pieces find places anyway. Patterns join
    by their gradient, some hundreds at a time, so that few patterns with many repeats are used;
    between joins, accelerated projected gradient steps fit the ones held."""
    every = patterns(histogram > 0, size)
    weight = np.sqrt(np.arange(size + 1) / size)
    wanted = weight * histogram
    wanted[0] = weight[0] = wanted[size] = 0
    held, x = np.zeros(0, np.int64), np.zeros(0)
    left = wanted.copy()

    def made(rows: np.ndarray, repeats: np.ndarray) -> np.ndarray:
        return weight * np.bincount(rows.reshape(-1), np.repeat(repeats, 3), size + 1)

    for _ in range(ROUNDS if len(every) else 0):
        slope = (weight * left)[every].sum(1) if len(every) else np.zeros(0)
        slope[held] = 0
        new = np.argpartition(-slope, JOINING)[:JOINING] if len(slope) > JOINING else np.arange(len(slope))
        new = new[slope[new] > 0]
        held, x = np.concatenate([held, new]), np.concatenate([x, np.zeros(len(new))])
        rows = every[held]
        uses = np.bincount(rows.reshape(-1), minlength=size + 1) * weight**2
        bound = max(uses[rows].sum(1).max(initial=0), 1e-9)  # of the squared norm
        at, speed = x.copy(), 1.0
        for _ in range(STEPS):
            move = (weight * (wanted - made(rows, at)))[rows].sum(1) / bound
            after = np.maximum(at + move, 0)
            faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
            at, x, speed = after + (speed - 1) / faster * (after - x), after, faster
        keep = x > 1e-3
        held, x = held[keep], x[keep]
        left = wanted - made(every[held], x)
        if not len(new) or np.linalg.norm(left) < 0.005 * np.linalg.norm(wanted):
            break
    return every[held], x


@dataclass
class Bins:
    """Equal sequences: the lengths in each, as runs of ``(length, copies)``, and how many."""

    runs: tuple[tuple[int, int], ...]
    count: int


def rounded(rows: np.ndarray, repeats: np.ndarray, left: np.ndarray) -> list[Bins]:
    """Repeats rounded down, as far as pieces are left; takes them off ``left``."""
    out = []
    for i in np.argsort(-repeats, kind="stable"):
        need = Counter(int(v) for v in rows[i] if v)
        n = min(int(repeats[i]), *(int(left[v]) // k for v, k in need.items()))
        if n > 0:
            for v, k in need.items():
                left[v] -= n * k
            out.append(Bins(tuple(sorted(need.items(), reverse=True)), n))
    return out


def best_fit(left: np.ndarray, size: int) -> list[Bins]:
    """Best-fit decreasing over a histogram: each length goes to the fullest sequences it fits in,
    as many copies to one as fit, equal sequences together."""
    opened: list[list[Bins]] = [[] for _ in range(size + 1)]  # by space left
    filled = np.zeros(size + 2, bool)

    def put(bins: Bins, space: int, length: int, copies: int, count: int) -> None:
        opened[space - length * copies].append(Bins((*bins.runs, (length, copies)), count))
        filled[space - length * copies] = True

    for length in range(size, 0, -1):
        n = int(left[length])
        while n:
            fits = np.flatnonzero(filled[length : size + 1])
            if len(fits):
                space = length + int(fits[0])
                bins = opened[space].pop()
                filled[space] = bool(opened[space])
            else:
                space, bins = size, Bins((), n)
            copies = min(space // length, n)
            count = min(bins.count, n // copies)
            put(bins, space, length, copies, count)
            n -= count * copies
            if bins.runs and bins.count > count:
                opened[space].append(Bins(bins.runs, bins.count - count))
                filled[space] = True
    return [b for same in opened for b in same]


def plan(histogram: np.ndarray, size: int) -> list[Bins]:
    """Sequences for all pieces that ``histogram`` (by length, from 0) counts."""
    left = histogram.astype(np.int64).copy()
    out = [Bins(((size, 1),), int(left[size]))] if left[size] else []
    left[size] = 0
    out += rounded(*fitted(left, size), left)
    return out + best_fit(left, size)


def runs_of(bins: list[Bins]) -> dict[str, np.ndarray]:
    """The plan as arrays: for pieces of one length from a number on (``key`` holds both), the
    first sequence, the offset there, and the copies in each sequence."""
    numbers: Counter = Counter()
    rows, sequence = [], 0
    for b in bins:
        offset = 0
        for length, copies in b.runs:
            rows.append((length << NUMBER_BITS | numbers[length], numbers[length], sequence, offset, copies))
            numbers[length] += b.count * copies
            offset += length * copies
        sequence += b.count
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("key", "first", "sequence", "offset", "copies"), table.T.copy()))


def placed(found: DataFrame, size: int) -> DataFrame:
    """``pieces`` rows with ``sequence_id`` and ``offset``. ``found`` must be a stored table."""
    histogram = np.zeros(size + 1, np.int64)
    counts = found.groupBy("part", "length").agg(F.count("*").alias("n"))
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # ``size`` rows at most
        histogram[row["length"]] = row["n"]
    shared = ship(found.sparkSession, runs_of(plan(histogram, size)))
    # One row for each part and length.
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))

    def run(batches):
        runs = shared.value
        for batch in batches:
            at = batch.schema.get_field_index
            length, number = (batch.column(at(n)).to_numpy() for n in ("length", "number"))
            i = np.searchsorted(runs["key"], length << NUMBER_BITS | number, side="right") - 1
            nth = number - runs["first"][i]
            copies = runs["copies"][i]
            kept = [n for n in batch.schema.names if n != "number"]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(at(n)) for n in kept),
                    pa.array(runs["sequence"][i] + nth // copies),
                    pa.array(runs["offset"][i] + nth % copies * length),
                ],
                names=[*kept, "sequence_id", "offset"],
            )

    kept = [n for n in found.columns if n not in ("part", "within")]
    columns = ", ".join(f"{n} {found.schema[n].dataType.simpleString()}" for n in kept)
    return (
        found.join(before, ["part", "length"])
        .select(*kept, (F.col("before") + F.col("within")).alias("number"))
        .mapInArrow(run, f"{columns}, sequence_id long, offset long")
    )


def pack(docs: DataFrame, tokenizer: str, *, size: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``) of every piece
    of every row of ``docs`` (``doc_id, text``). Each document ends in ``end_id``; a null or empty
    text is that one token. Rows are packed each, whether or not their id or text repeats or is
    null; an empty table gives no rows. Sequences are numbered without gaps."""
    return placed(saved(pieces(docs, tokenizer, size, end_id, with_ids), "packing-pieces"), size)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, n_tokens, doc_ids, ids``: the token sequences themselves (ids little-endian
    uint32), from ``pack(..., with_ids=True)``. A group is one sequence, so it is small."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    return packed.groupBy("sequence_id").agg(rows.alias("rows"), F.sum("length").alias("n_tokens")).select(
        "sequence_id",
        "n_tokens",
        F.col("rows.doc_id").alias("doc_ids"),
        F.aggregate("rows", F.unhex(F.lit("")), lambda all_, r: F.concat(all_, r["ids"])).alias("ids"),
    )
