"""Phrase collocations, mined by sampling with a negative border.

Phrases of 1 to 3 words are counted per language. A sample of documents proposes the phrases
that may be frequent. A full pass counts exactly, over all documents: all words, and all longer
phrases whose every part (without its first or its last word) the sample proposed. Those are the
proposed phrases that can be frequent, plus their negative border: the smallest ones it did not
propose. No part of a frequent phrase is less frequent than the phrase, so if nothing in the
border turns out frequent, no frequent phrase was left uncounted. Where the border fails, the
phrases that turned out frequent join the proposed ones, and an expansion pass counts what that
newly lets in, up to closure: phrases over newly counted parts are counted in the same pass.
The sample only steers the work; counts never depend on it.

Proposed phrases travel as a bit filter of bounded size. A chance hit in it counts a phrase that
could have been left out, nothing else: what a pass has counted is told by the filter itself.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkmill.llm.common import saved, ship, slices, small, worker_value

LONGEST = 3
SUPPORT = 10
#: One document in so many is in the sample, and a phrase that it holds so often is proposed.
#: ``SUPPORT`` occurrences mean 1.25 in the sample, so some are missed and left to the border.
SAMPLE, SAMPLE_SUPPORT = 8, 2
#: Bits of the filter for each proposed phrase, within these bounds (16 MB at most).
BITS_EACH, LEAST_BITS, MOST_BITS = 24, 20, 27
#: Different words that a worker keeps, in about 120 MB.
KEPT_WORDS = 400_000
ROTATION = 23
NO_LANGUAGE = "und"

#: A-Z lower-cased, blanks as blanks, and all marks that end a piece as full stops.
LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else 32 if b in b" \t" else 46 if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256)
)
STOP = b"."


def rotated(x: np.ndarray) -> np.ndarray:
    return x << np.uint64(ROTATION) | x >> np.uint64(64 - ROTATION)


def phrase_key() -> Column:
    """The filter key of a phrase of one or two words, as tasks compute it from word hashes."""
    part = lambda i: F.xxhash64("lang", F.get(F.split("phrase", " "), i))
    first = part(0)
    turned = F.shiftleft(first, ROTATION).bitwiseOR(F.shiftrightunsigned(first, 64 - ROTATION))
    return F.when(F.col("words") == 1, first).otherwise(turned.bitwiseXOR(part(1)))


class Words(dict):
    """Place of each word of one language; place 0 is the end of a piece."""

    def __init__(self, lang: str) -> None:
        self.seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 42)
        self.hashes = array("Q", [0])
        self[STOP] = 0

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(word, self.seed))
        return place


class Filter:
    """Bits by key: ``(key >> 6) mod blocks`` names a block of 64, the low six bits the bit."""

    def __init__(self, blocks: np.ndarray) -> None:
        self.blocks = blocks

    def holds(self, keys: np.ndarray) -> np.ndarray:
        block = self.blocks[(keys >> np.uint64(6)) & np.uint64(len(self.blocks) - 1)]
        return (block >> (keys & np.uint64(63)) & np.uint64(1)).astype(bool)


def filter_of(keys: DataFrame, n: int) -> Filter:
    """Bit filter of ``keys`` (``key long``), of which there are about ``n``. Tasks set the bits;
    the driver gets one number for each block that has any, a bounded number of them."""
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * max(n, 1) - 1).bit_length()))
    count = 1 << bits - 6
    rows = (
        keys.select(
            F.shiftrightunsigned("key", 6).bitwiseAND(count - 1).alias("block"),
            F.expr("shiftleft(1L, cast(key & 63 as int))").alias("bit"),
        )
        .groupBy("block")
        .agg(F.bit_or("bit").alias("bits"))
        .toArrow()
    )
    blocks = np.zeros(count, np.uint64)
    blocks[rows["block"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return Filter(blocks)


def _of_worker(lang: str) -> Words:
    held = worker_value("phrase words", dict, large=True)
    if sum(map(len, held.values())) > KEPT_WORDS:
        held.clear()
    if lang not in held:
        held[lang] = Words(lang)
    return held[lang]


def _streams(batches):
    """``lang, known, words, places, hashes`` of the texts of one language, few at a time: words in
    a row with a stop after each piece, the place of each in ``known``, and each place's hash."""
    for batch in small(batches):
        langs = batch.column(1).to_pylist()
        texts = [t or b"" for t in batch.column(0).cast(pa.large_binary()).to_pylist()]
        for a, b in slices([len(t) for t in texts]):
            own: dict[str, list[bytes]] = {}
            for lang, text in zip(langs[a:b], texts[a:b]):
                own.setdefault(lang, []).append(text)
            for lang, some in own.items():
                line = STOP.join([*some, b""]).translate(LETTERS).replace(STOP, b" . ")
                words = line.split()
                known = _of_worker(lang)
                places = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                yield lang, known, words, places, np.array(known.hashes, np.uint64)


def _first(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each different key stands first, and how often it stands."""
    _, at, n = np.unique(keys, return_index=True, return_counts=True)
    return at, n


def _pairs(places: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions where two words of a piece begin, and the keys of these pairs."""
    at = np.flatnonzero((places[:-1] > 0) & (places[1:] > 0))
    own = hashes[places]
    return at, rotated(own[at]) ^ own[at + 1]


def sample_keys(docs: DataFrame) -> DataFrame:
    """``key`` of the words and pairs that the sample holds ``SAMPLE_SUPPORT`` times or more."""

    def run(batches):
        for *_, places, hashes in _streams(batches):
            word = places[places > 0]
            for keys in (hashes[word], _pairs(places, hashes)[1]):
                if len(keys):
                    at, n = _first(keys)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[at].view(np.int64)), pa.array(n, pa.int64())], names=["key", "n"]
                    )

    return (
        docs.where("sampled")
        .select("text", "lang")
        .mapInArrow(run, "key long, n long")
        .groupBy("key")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= SAMPLE_SUPPORT)
        .select("key")
    )


def counted(docs: DataFrame, new: Filter, old: Filter | None) -> DataFrame:
    """``lang, words, phrase, n``: exact counts of the phrases that ``new`` lets in and ``old``
    did not. Without ``old`` all words too, and per language the number of all words, as a phrase
    of none. With ``old`` the border is closed at once: a pair that has not been counted before
    counts as one that may be frequent, so triples over it are counted in the same pass."""
    shared = ship(docs.sparkSession, (new, old))

    def table(texts, n):
        return pa.RecordBatch.from_arrays(
            [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=["line", "n"]
        )

    def tallied(lang, known, sums):
        lead, words = lang.encode("utf-8", "surrogatepass") + b"\n", list(known)
        found = (np.flatnonzero(sums[1:]) + 1).tolist()
        yield table([lead, *(lead + words[i] for i in found)], [int(sums[1:].sum()), *sums[found].tolist()])

    def run(batches):
        new, old = shared.value
        tallies: dict[str, list] = {}
        for lang, known, words, places, hashes in _streams(batches):
            lead = lang.encode("utf-8", "surrogatepass") + b"\n"
            if old is None:
                tally = tallies.get(lang)
                if tally is None or tally[0] is not known:  # the worker began a new table of words
                    if tally:
                        yield from tallied(lang, *tally)
                    tally = tallies[lang] = [known, np.zeros(0, np.int64)]
                sums = np.bincount(places, minlength=len(hashes))
                sums[: len(tally[1])] += tally[1]
                tally[1] = sums
            at, keys = _pairs(places, hashes)
            if not len(at):
                continue
            word_in, pair_in = new.holds(hashes), new.holds(keys)
            both = word_in[places[at]] & word_in[places[at + 1]]
            triple = np.flatnonzero(np.diff(at) == 1)
            may = both & pair_in
            done = np.zeros(len(at), bool)
            if old is not None:
                word_old = old.holds(hashes)
                both_old = word_old[places[at]] & word_old[places[at + 1]]
                done = both_old & old.holds(keys)
                both &= ~both_old
                may |= both
            here = np.flatnonzero(both)
            if len(here):
                # Places name the words of this worker exactly, so keys cannot collide here.
                first, n = _first(places[at[here]] << 32 | places[at[here] + 1])
                begin = at[here[first]].tolist()
                yield table([b"%b%b %b" % (lead, words[i], words[i + 1]) for i in begin], n)
            here = triple[may[triple] & may[triple + 1] & ~(done[triple] & done[triple + 1])]
            if len(here):
                begin = at[here]
                _, pair = np.unique(places[begin] << 32 | places[begin + 1], return_inverse=True)
                first, n = _first(pair.astype(np.int64) << 32 | places[begin + 2])
                yield table([lead + b" ".join(words[i : i + 3]) for i in begin[first].tolist()], n)
        for lang, tally in tallies.items():
            yield from tallied(lang, *tally)

    # One key for language and phrase: no phrase holds a line feed.
    phrase = F.substring_index("line", "\n", -1)
    return (
        docs.select("text", "lang")
        .mapInArrow(run, "line string, n long")
        .groupBy("line")
        .agg(F.sum("n").alias("n"))
        .select(
            F.expr(r"substring(line, 1, length(line) - length(substring_index(line, '\n', -1)) - 1)").alias("lang"),
            F.when(phrase == "", 0).otherwise(F.size(F.split(phrase, " "))).alias("words"),
            phrase.alias("phrase"),
            "n",
        )
    )


def frequent_phrases(docs: DataFrame, support: int = SUPPORT) -> DataFrame:
    """``lang, words, phrase, n`` of all phrases of up to ``LONGEST`` words with ``support``
    occurrences or more, and one row of no words for each language: its number of words."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE))
    sampled = F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0
    docs = docs.select("text", lang.alias("lang"), sampled.alias("sampled"))
    proposed = saved(sample_keys(docs), "phrases-proposed")
    new = filter_of(proposed, proposed.count())

    def full_pass(new: Filter, old: Filter | None) -> DataFrame:
        wanted = (F.col("n") >= support) | (F.col("words") == 0)
        return saved(counted(docs, new, old).where(wanted), "phrases-counted")

    first = full_pass(new, None)
    shared = ship(docs.sparkSession, new)

    def outside(batches):
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            yield batch.filter(pa.array(~shared.value.holds(own)))

    keys = first.where(F.col("words").isin(1, 2)).select(phrase_key().alias("key"))
    failed = saved(keys.mapInArrow(outside, "key long"), "phrases-border-failures")
    n = failed.count()
    if not n:
        return first
    return first.unionByName(full_pass(joined(new, filter_of(failed, n)), new))


def joined(a: Filter, b: Filter) -> Filter:
    """A filter that holds what either holds: the shorter one repeats along the longer one."""
    if len(a.blocks) < len(b.blocks):
        a, b = b, a
    return Filter(a.blocks | np.tile(b.blocks, len(a.blocks) // len(b.blocks)))


def collocations(docs: DataFrame, *, support: int = SUPPORT, share: int = 50, most: int = 2_000) -> DataFrame:
    """The ``most`` best phrases of two and three words of each language (null: ``und``):
    ``lang, rank, phrase, a, l, r, n, score``.

    ``a`` counts the phrase, ``l`` and ``r`` its two parts at its lowest-scoring cut, ``n`` all
    words of the language; the score is floor(1,000,000 a a / (l r)), in exact arithmetic. A
    phrase inside a longer frequent one that takes ``share`` percent of its occurrences goes. Ties
    are broken by higher ``a``, then by the phrase's bytes. ``docs`` needs ``doc_id, text, lang``;
    null and empty texts hold no words, repeated rows count each, an empty table gives no rows."""
    known = saved(frequent_phrases(docs, support), "phrases-frequent")
    phrases = known.where(F.col("words").between(2, LONGEST)).select("lang", "words", "phrase", F.col("n").alias("a"))
    parts = known.where(F.col("words").between(1, LONGEST - 1)).select("lang", "phrase", F.col("n").alias("part_n"))

    def piece(begin, size):
        return F.array_join(F.slice(F.split("phrase", " "), begin, size), " ")

    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "*", piece(F.lit(1), F.col("k")).alias("head"), piece(F.col("k") + 1, F.col("words") - F.col("k")).alias("tail")
    )
    head = parts.select("lang", F.col("phrase").alias("head"), F.col("part_n").alias("l"))
    tail = parts.select("lang", F.col("phrase").alias("tail"), F.col("part_n").alias("r"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    share_of = F.expr("(cast(1000000 as decimal(7,0)) * (a_ * a_)) div (l_ * r_)")
    scored = (
        cuts.join(head, ["lang", "head"])
        .join(tail, ["lang", "tail"])
        .select("*", wide("a").alias("a_"), wide("l").alias("l_"), wide("r").alias("r_"))
        .select("lang", "words", "phrase", "a", "k", "l", "r", share_of.cast("long").alias("score"))
        .groupBy("lang", "words", "phrase", "a")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
        .select("lang", "words", "phrase", "a", "low.l", "low.r", "low.score")
    )
    inside = (
        phrases.where(F.col("words") > 2)
        .select("lang", F.explode(F.array(piece(F.lit(1), F.lit(2)), piece(F.lit(2), F.lit(2)))).alias("phrase"), "a")
        .groupBy("lang", "phrase")
        .agg(F.max("a").alias("longer"))
    )
    own = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = (
        scored.join(inside, ["lang", "phrase"], "left")
        .where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
        .withColumn("rank", F.row_number().over(own))
        .where(F.col("rank") <= most)
    )
    # One row for each language.
    sizes = known.where(F.col("words") == 0).groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(sizes, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
