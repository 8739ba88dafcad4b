"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

A file segment holds a run of whole documents. Its ids are replaced by their rank in the
segment, the most frequent id having rank 0, and each rank takes 1 to 4 bytes. The byte counts
stand apart from the bytes: a control byte holds four 2-bit lengths. Decoding is numpy table
lookup: control byte -> four lengths, running sum -> offsets, gathered words & mask -> ranks.

Segments are rows of a Parquet folder (so that any store Spark writes to will do): ``part, seq``
(order), ``doc_ids``, ``lengths`` (ids a document, little-endian uint32), ``ranks`` (id of each
rank, uint32), ``control``, ``data``, ``n_ids``. A segment is self-contained, so a lost task
rewrites only its own. Documents are dealt to tasks by ranges of id, so files are in id order.
"""

from __future__ import annotations

import os
import string
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from talkmill.llm.common import SLICE_CHARS, slices, small, worker_value

#: Ids of a segment; a single longer document gets a larger one.
SEGMENT_IDS = 1 << 20
#: Pieces whose ids a worker keeps, in about 150 MB.
KEPT_PIECES = 650_000
#: A character that encodes to one id which nothing else yields.
MARK = "\x01"
#: Fixed value: how the vocabulary marks tokens at the end of a word.
WORD_END = "</w>"
TAILS = string.punctuation
KEPT_TAILS = 10_000
#: Up to here a letter lower-cases to one letter.
PLAIN = "\u00ff"

LENGTH_TABLE = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)
MASK_TABLE = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def encode_ranks(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    v = values.astype(np.uint32)
    width = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    padded = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    padded[: len(v)] = width - 1
    control = padded[0::4] | padded[1::4] << 2 | padded[2::4] << 4 | padded[3::4] << 6
    begin = np.cumsum(width, dtype=np.int64) - width
    data = np.empty(int(begin[-1]) + int(width[-1]) if len(v) else 0, np.uint8)
    data[begin] = v & 0xFF
    for k in (1, 2, 3):
        more = np.flatnonzero(width > k)
        data[begin[more] + k] = v[more] >> 8 * k & 0xFF
    return control.tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    width = LENGTH_TABLE[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(width, dtype=np.int64)
    buffer = np.frombuffer(data + bytes(4), np.uint8)
    words = buffer[(ends - width)[:, None] + np.arange(4)].view("<u4").reshape(-1)
    return words & MASK_TABLE[width]


def pack(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """``ranks, control, data`` of a segment's ids; equally frequent ids rank by number."""
    if len(ids) and int(ids.max()) < SEGMENT_IDS:
        counts = np.bincount(ids)
        found = np.flatnonzero(counts)
        order = found[np.argsort(-counts[found], kind="stable")]
        rank = np.zeros(len(counts), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        return order.astype("<u4").tobytes(), *encode_ranks(rank[ids])
    found, where, n = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    return found[order].astype("<u4").tobytes(), *encode_ranks(rank[where])


def unpack(ranks: bytes, control: bytes, data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(ranks, "<u4")[decode_ranks(control, data, n)]


class Pieces(dict):
    """Place of each piece; a new piece gets the next place and is noted in ``new``."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        place = self[piece] = len(self)
        self.new.append(piece)
        return place


class Encoder:
    """Ids of texts, piece by piece.

    The tokenizer drops white space and no token spans a blank, so a text's ids are those of its
    blank-separated pieces in order. Pieces come again and again: a worker keeps the ids of up to
    ``KEPT_PIECES``. New ones go to the library in one text, between marks that no other piece can
    yield; one that is a known piece and a full stop, say, is put together from the two.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.mark = self.plain(MARK)
        vocabulary = self.library.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.tails: dict[str, list[int]] = {}
        self.reset()

    def plain(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def reset(self) -> None:
        self.places = Pieces()
        self.pool = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1, np.int64)
        self.uses = np.zeros(0, np.int32)

    def forget(self) -> None:
        """Of a full table keep the pieces used most, half of it at most, and none used once."""
        pieces, ends, pool, uses = list(self.places), self.ends, self.pool, self.uses
        kept = np.flatnonzero(uses > 1)
        if len(kept) > KEPT_PIECES // 2:
            kept = np.sort(kept[np.argsort(-uses[kept], kind="stable")[: KEPT_PIECES // 2]])
        self.reset()
        size = ends[kept + 1] - ends[kept]
        self.places.update((pieces[i], k) for k, i in enumerate(kept.tolist()))
        self.pool = pool[_runs(ends[kept], size)]
        self.ends = np.concatenate([[0], np.cumsum(size)])
        self.uses = uses[kept] // 2

    def learn(self) -> None:
        """Ids of the pieces that ``places`` has noted, at the pool's end."""
        pieces, self.places.new = self.places.new, []
        begin, used = len(self.ends) - 1, int(self.ends[-1])
        whole, joined, heads, tails = [], [], [], []
        for i, p in enumerate(pieces):
            stem = p.rstrip(TAILS)
            if stem and len(stem) < len(p) and stem[-1].isalnum() and stem[-1] <= PLAIN and "<|" not in p:
                head = self.places.get(stem, begin)
                if head < begin:
                    joined.append(i)
                    heads.append(head)
                    tails.append(self.tail(p[len(stem) :]))
                    continue
            whole.append(i)
        ids, n = self._encoded([pieces[i] for i in whole])
        whole, joined, heads = (np.array(x, np.int64) for x in (whole, joined, heads))
        size = np.zeros(len(pieces), np.int64)
        size[whole] = n
        head_size, tail_size = self.ends[heads + 1] - self.ends[heads], np.array([len(t) for t in tails], np.int64)
        size[joined] = head_size + tail_size
        first = used + np.cumsum(size) - size
        need = used + int(size.sum())
        if need > len(self.pool):
            self.pool = np.concatenate([self.pool[:used], np.zeros(max(need, 2 * len(self.pool)) - used, np.uint32)])
        self.pool[_runs(first[whole], n)] = ids
        self.pool[_runs(first[joined], head_size)] = self.pool[_runs(self.ends[heads], head_size)]
        self.pool[_runs(first[joined] + head_size, tail_size)] = [i for t in tails for i in t]
        self.ends = np.concatenate([self.ends, first + size])

    def tail(self, marks: str) -> list[int]:
        """Ids of a run of punctuation, which is always a word of the tokenizer's own."""
        found = self.tails.get(marks)
        if found is None:
            found = self.plain(marks)
            if len(self.tails) < KEPT_TAILS:
                self.tails[marks] = found
        return found

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and how many each has."""
        n = np.zeros(len(pieces), np.int64)
        plain = [i for i, p in enumerate(pieces) if p.isalpha() and latin(p)]
        # Pieces of letters alone are one word each, and words end in ids of their own kind.
        found, ended = self._words([pieces[i] for i in plain])
        n[plain] = np.diff(np.concatenate([[-1], ended]))
        rest = np.setdiff1d(np.arange(len(pieces)), plain)
        others, n[rest] = self._marked([pieces[i] for i in rest])
        first = np.cumsum(n) - n
        ids = np.zeros(int(n.sum()), np.uint32)
        ids[_runs(first[plain], n[plain])] = found
        ids[_runs(first[rest], n[rest])] = others
        return ids, n

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in a row, and the position of each word's last id."""
        found = np.array(self.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        ended = np.flatnonzero(self.last[found])
        if len(ended) != len(words):  # a vocabulary that marks no ends, or counts words in another way
            own = [self.plain(w) for w in words]
            found = np.array([i for w in own for i in w], np.uint32)
            ended = np.cumsum([len(w) for w in own], dtype=np.int64) - 1
        return found, ended

    def _marked(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for any pieces, with marks between them."""
        if len(self.mark) == 1 and not any(MARK in p for p in pieces):
            ids = np.array(self.plain("".join(f"{p} {MARK} " for p in pieces)), np.uint32)
            marks = np.flatnonzero(ids == self.mark[0])
            if len(marks) == len(pieces):
                return ids[ids != self.mark[0]], np.diff(np.concatenate([[-1], marks])) - 1
        found = [self.plain(p) for p in pieces]
        return np.array([i for f in found for i in f], np.uint32), np.array([len(f) for f in found], np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts`` in a row, and how many each text has."""
        pieces = [self.cut(t) for t in texts]
        if len(self.places) > KEPT_PIECES:
            self.forget()
        n = [len(own) for own in pieces]
        place = np.fromiter(map(self.places.__getitem__, chain.from_iterable(pieces)), np.int64, sum(n))
        if self.places.new:
            self.learn()
            self.uses = np.concatenate([self.uses, np.zeros(len(self.ends) - 1 - len(self.uses), np.int32)])
        self.uses += np.bincount(place, minlength=len(self.uses)).astype(np.int32)
        size = self.ends[place + 1] - self.ends[place]
        ids = self.pool[_runs(self.ends[place], size)]
        bound = np.concatenate([[0], np.cumsum(n)])
        return ids, np.diff(np.concatenate([[0], np.cumsum(size)])[bound])

    @staticmethod
    def cut(text: str) -> list[str]:
        """Pieces between blanks and line feeds; Latin text is lower-cased as the tokenizer would,
        so that fewer are different. Special tokens are told by case, so texts that may hold one
        stay as they are."""
        if "<|" not in text and latin(text):
            text = text.lower()
        return text.replace("\n", " ").split(" ")


def latin(text: str) -> bool:
    """Whether all characters are Latin-1."""
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


def _runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All positions of runs given by their first position and length."""
    return np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)


def encoder(path: str) -> Encoder:
    return worker_value(("token encoder", path), lambda: Encoder(path), large=True)


SEGMENTS = (
    "part int, seq int, doc_ids array<{kind}>, n_ids long, "
    "lengths binary, ranks binary, control binary, data binary"
)


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int) -> None:
    """Encode every whole text (null: empty), append ``end_id`` to each document, and write the
    segments to ``folder`` in ascending doc_id order, a null doc_id first; rows that share an id
    are ordered by their text's hash. Any number of equal ids is allowed."""
    kind = docs.schema["doc_id"].dataType
    order = [F.col("doc_id"), F.xxhash64("text")]
    ordered = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches):
        own = encoder(tokenizer)
        part, seq = TaskContext.get().partitionId(), 0
        names, ids, sizes, held = [], [], [], 0

        def segment():
            every = np.concatenate(ids)
            ranks, control, data = pack(every)
            lengths = np.concatenate(sizes).astype("<u4").tobytes()
            columns = [
                pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([names], pa.list_(names_type)),
                pa.array([len(every)], pa.int64()),
                *(pa.array([x], pa.binary()) for x in (lengths, ranks, control, data)),
            ]
            return pa.RecordBatch.from_arrays(
                columns, names=["part", "seq", "doc_ids", "n_ids", "lengths", "ranks", "control", "data"]
            )

        for batch in small(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            keys, names_type = batch.column(0).to_pylist(), batch.column(0).type
            for a, b in slices([len(t) for t in texts], SLICE_CHARS):
                found, n = own.encode(texts[a:b])
                with_end = np.full(len(found) + len(n), end_id, np.uint32)
                ends = np.cumsum(n + 1) - 1
                rest = np.ones(len(with_end), bool)
                rest[ends] = False
                with_end[rest] = found
                ids.append(with_end)
                sizes.append(n + 1)
                names += keys[a:b]
                held += len(with_end)
                if held >= SEGMENT_IDS:
                    yield segment()
                    seq += 1
                    names, ids, sizes, held = [], [], [], 0
        if names:
            yield segment()

    ordered.mapInArrow(run, SEGMENTS.format(kind=kind.simpleString())).write.parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the files."""
    segments = spark.read.parquet(folder)
    kind = segments.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["ranks"], row["control"], row["data"], row["n_ids"]).astype("<u4")
                size = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
                ends = np.cumsum(size)
                raw, n = memoryview(ids.tobytes()), len(size)
                crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), size.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], batch.schema.field("doc_ids").type.value_type),
                        pa.array(np.full(n, row["part"], np.int32)),
                        pa.array(np.full(n, row["seq"], np.int32)),
                        pa.array(ends - size),
                        pa.array(size),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["doc_id", "part", "seq", "within", "n_tokens", "ids_crc32"],
                )

    documents = segments.select("part", "seq", "n_ids", "doc_ids", "lengths", "ranks", "control", "data").mapInArrow(
        run, f"doc_id {kind}, part int, seq int, within long, n_tokens long, ids_crc32 long"
    )
    return documents.join(_starts(segments), ["part", "seq"]).select(
        "doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32"
    )


def _starts(segments: DataFrame) -> DataFrame:
    """Ids before each segment: a running sum over the parts and one inside each part."""
    sums = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # One row for each task of the writer.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return (
        segments.select("part", "seq", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("inner"))
        .join(parts, "part")
        .select("part", "seq", (F.col("base") + F.col("inner")).alias("before"))
    )
