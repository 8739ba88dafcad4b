"""Benchmark decontamination by spaced-seed hashing.

A mask fixes which tokens of a stretch count; the others may differ. Seeds of all masks at every
token position of the benchmark items and of the documents are joined on their hashes, and every
hit is verified on its diagonal: some window of ``WINDOW`` tokens around it must agree in all
but ``MISMATCHES``. The three masks are chosen so that a window with any two substitutions still
holds an untouched seed, so nothing that would verify is missed (a test tries all placements).

Documents pass once. A bit filter of fixed size over the benchmark's seeds, sent to all tasks,
lets through only document seeds that may be in the benchmark; the exact join follows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.llm.common import saved, ship, slices, small, worker_value

WINDOW, MISMATCHES = 13, 2
#: Token offsets that count, of each mask.
MASKS = ((0, 3, 4, 5, 7, 8, 9), (0, 2, 3, 4, 5, 6, 8), (0, 1, 2, 4, 7, 8, 9))
#: Items of fewer tokens than ``WINDOW`` must occur word for word; of fewer than this, they say
#: nothing about a document.
LEAST_TOKENS = 5
#: 2**26 bits are 8 MB, whatever the benchmark's size; a larger benchmark lets more chance hits
#: through to the exact join, nothing else.
FILTER_BITS = 26
KEPT_WORDS = 400_000
#: Tokens kept on either side of a hit for its verification.
MARGIN = WINDOW

TOKEN = re.compile(r"\w+")


class Words(dict):
    def __missing__(self, word: str) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def token_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased word tokens of all texts in a row, and where each text ends."""
    words = worker_value("decontamination words", Words, large=True)
    if len(words) > KEPT_WORDS:
        words.clear()
    tokens = [TOKEN.findall(t.lower()) for t in texts]
    n = [len(t) for t in tokens]
    found = np.fromiter((words[w] for own in tokens for w in own), np.uint64, sum(n))
    return found, np.cumsum(n)


def seeds(tokens: np.ndarray, offsets: tuple[int, ...], kind: int) -> np.ndarray:
    """Hash of the tokens under one mask at each position where it fits."""
    n = len(tokens) - offsets[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, kind + 1, np.uint64)
    for o in offsets:
        out = (out ^ tokens[o : o + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def masks(short: list[int]) -> list[tuple[int, tuple[int, ...]]]:
    """The masks for long items, and a gapless one for each length of short items."""
    return [*enumerate(MASKS), *((100 + n, tuple(range(n))) for n in short)]


def agreement(same: np.ndarray, whole: int) -> int:
    """Agreeing tokens within windows that pass; 0 if none does. ``same``: where the two texts
    agree on a diagonal; ``whole``: the item's length."""
    if whole < WINDOW:
        return whole if len(same) == whole and same.all() else 0
    if len(same) < WINDOW:
        return 0
    run = np.concatenate([[0], np.cumsum(same)])
    good = np.flatnonzero(run[WINDOW:] - run[:-WINDOW] >= WINDOW - MISMATCHES)
    if not len(good):
        return 0
    covered = np.zeros(len(same), bool)
    for g in good:
        covered[g : g + WINDOW] = True
    return int((covered & same).sum())


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *(len(v) for v in values)]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.uint64), *values]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _items(benchmark: DataFrame) -> DataFrame:
    """``item_id, tokens`` of the items long enough to be looked for."""

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens, ends = token_hashes(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _lists(np.split(tokens, ends[:-1]) if len(ends) else [])], names=["item_id", "tokens"]
            )

    kind = benchmark.schema["item_id"].dataType.simpleString()
    return (
        benchmark.select("item_id", "text")
        .mapInArrow(run, f"item_id {kind}, tokens array<long>")
        .where(F.size("tokens") >= LEAST_TOKENS)
        .distinct()
        .withColumn("item", F.monotonically_increasing_id())
    )


def _item_seeds(items: DataFrame) -> DataFrame:
    """``seed, item, at`` of every item: all masks for long ones, the whole item for short ones."""

    def run(batches):
        for batch in batches:
            seed, item, at = [], [], []
            for key, tokens in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = tokens.values.to_numpy().view(np.uint64)
                for kind, offsets in masks([len(own)] if len(own) < WINDOW else []):
                    if (kind >= 100) == (len(own) < WINDOW):
                        found = seeds(own, offsets, kind)
                        seed.append(found)
                        item.append(np.full(len(found), key, np.int64))
                        at.append(np.arange(len(found), dtype=np.int32))
            if seed:
                yield pa.RecordBatch.from_arrays(
                    [_signed(np.concatenate(seed)), pa.array(np.concatenate(item)), pa.array(np.concatenate(at))],
                    names=["seed", "item", "at"],
                )

    return items.select("item", "tokens").mapInArrow(run, "seed long, item long, at int")


def _filter(found: DataFrame) -> np.ndarray:
    """Two bits of each seed, in ``2 ** FILTER_BITS`` bits."""
    bit = F.explode(
        F.array(
            F.col("seed").bitwiseAND((1 << FILTER_BITS) - 1),
            F.shiftrightunsigned("seed", FILTER_BITS).bitwiseAND((1 << FILTER_BITS) - 1),
        )
    )
    words = (
        found.select(bit.alias("bit"))
        .groupBy(F.shiftright("bit", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
        .toArrow()
    )
    out = np.zeros(1 << FILTER_BITS - 6, np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def _may_hold(bits: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Positions of ``seed`` whose two bits are set."""
    size = np.uint64((1 << FILTER_BITS) - 1)

    def among(s):
        at = s & size
        return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)

    first = np.flatnonzero(among(seed))
    return first[among(seed[first] >> np.uint64(FILTER_BITS))]


def _stretches(docs: DataFrame, bits: np.ndarray, short: list[int]) -> DataFrame:
    """The token stretches of documents around possible hits, with the hits:
    ``doc_id, text_hash, first, tokens, hits``."""
    shipped = ship(docs.sparkSession, bits)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        held = shipped.value
        for batch in small(batches):
            texts = [t or "" for t in batch.column(2).to_pylist()]
            rows, firsts, tokens_out, hits_out = [], [], [], []
            for a, b in slices([len(t) for t in texts]):
                tokens, ends = token_hashes(texts[a:b])
                begins = np.concatenate([[0], ends[:-1]])
                at, seed, reach = [], [], []
                for number, offsets in masks(short):
                    found = seeds(tokens, offsets, number)
                    where = _may_hold(held, found)
                    own = np.searchsorted(ends, where, side="right")
                    fits = where + offsets[-1] < ends[np.minimum(own, len(ends) - 1)]
                    at.append(where[fits])
                    seed.append(found[where[fits]])
                    reach.append(np.full(int(fits.sum()), offsets[-1] + 1))
                at, seed, reach = map(np.concatenate, (at, seed, reach))
                order = np.argsort(at, kind="stable")
                at, seed, reach = at[order], seed[order], reach[order]
                own = np.searchsorted(ends, at, side="right")
                low = np.maximum(begins[own], at - MARGIN)
                high = np.minimum(ends[own], at + reach + MARGIN)
                i = 0
                while i < len(at):
                    j, end = i + 1, high[i]
                    while j < len(at) and own[j] == own[i] and low[j] <= end:
                        end = max(end, high[j])
                        j += 1
                    rows.append(a + int(own[i]))
                    firsts.append(int(low[i] - begins[own[i]]))
                    tokens_out.append(tokens[low[i] : end])
                    hits_out.append((seed[i:j].view(np.int64), at[i:j] - begins[own[i]]))
                    i = j
            if rows:
                ends = np.cumsum([0, *(len(s) for s, _ in hits_out)]).astype(np.int32)
                hits = pa.StructArray.from_arrays(
                    [
                        pa.array(np.concatenate([s for s, _ in hits_out])),
                        pa.array(np.concatenate([p for _, p in hits_out]).astype(np.int32)),
                    ],
                    names=["seed", "pos"],
                )
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(take),
                        batch.column(1).take(take),
                        pa.array(firsts, pa.int32()),
                        _lists(tokens_out),
                        pa.ListArray.from_arrays(pa.array(ends), hits),
                    ],
                    names=["doc_id", "text_hash", "first", "tokens", "hits"],
                )

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        run,
        f"doc_id {kind}, text_hash long, first int, tokens array<long>, hits array<struct<seed:long,pos:int>>",
    )


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Verified overlaps: ``doc_id, text_hash, item_id, matched`` (agreeing tokens, the most on
    one diagonal), one row for each document text and item. No rows for clean documents.

    Tokens are lower-cased runs of word characters of the whole text. Null and empty texts and
    items of fewer than ``LEAST_TOKENS`` tokens match nothing; repeated documents or items come
    out once.
    """
    items = saved(_items(benchmark), "benchmark-items")
    found = saved(_item_seeds(items), "benchmark-seeds")
    lengths = items.where(F.size("tokens") < WINDOW).select(F.size("tokens").alias("n")).distinct()
    short = sorted(r["n"] for r in lengths.collect())  # at most WINDOW - LEAST_TOKENS values
    stretches = saved(
        _stretches(docs, _filter(found), short).withColumn("stretch", F.monotonically_increasing_id()),
        "document-stretches",
    )
    diagonals = (
        stretches.select("stretch", F.explode("hits").alias("hit"))
        .select("stretch", F.col("hit.seed").alias("seed"), F.col("hit.pos").alias("pos"))
        .join(found, "seed")
        .select("stretch", "item", (F.col("at") - F.col("pos")).alias("shift"))
        .distinct()
    )
    # The part of the item that lies beside the stretch on this diagonal.
    start = F.greatest(F.lit(0), F.col("first") + F.col("shift"))
    stop = F.least(F.size("item_tokens"), F.col("first") + F.col("shift") + F.size("tokens"))
    aligned = (
        diagonals.join(stretches.drop("hits"), "stretch")
        .join(items.withColumnRenamed("tokens", "item_tokens"), "item")
        .withColumn("n_item", F.size("item_tokens"))
        .withColumn("start", start)
        .withColumn("n", stop - start)
        .where("n > 0")
        .select(
            "doc_id", "text_hash", "item_id", "n_item",
            F.slice("tokens", F.col("start") - F.col("first") - F.col("shift") + 1, F.col("n")).alias("x"),
            F.slice("item_tokens", F.col("start") + 1, F.col("n")).alias("y"),
        )
    )

    def verify(batches):
        for batch in batches:
            x, y = batch.column(4), batch.column(5)
            whole = batch.column(3).to_pylist()
            matched = [
                agreement(x[i].values.to_numpy() == y[i].values.to_numpy(), whole[i]) for i in range(batch.num_rows)
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(matched, pa.int32())], names=["doc_id", "text_hash", "item_id", "matched"]
            )

    kinds = {c: aligned.schema[c].dataType.simpleString() for c in ("doc_id", "item_id")}
    return (
        aligned.mapInArrow(
            verify, f"doc_id {kinds['doc_id']}, text_hash long, item_id {kinds['item_id']}, matched int"
        )
        .where("matched > 0")
        .groupBy("doc_id", "text_hash", "item_id")
        .agg(F.max("matched").alias("matched"))
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a verified overlap, columns unchanged."""
    bad = saved(
        overlaps(docs, benchmark).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct(),
        "contaminated",
    )
    same = docs["doc_id"].eqNullSafe(bad["__id"]) & (F.xxhash64(docs["text"]) == bad["__hash"])
    return docs.join(bad, same, "left_anti")
