"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, every stretch of non-letters becomes one blank, and all 1- to 3-grams
are hashed to ``2 ** BITS`` buckets, in numpy over many texts at once. Training counts
(language, bucket) over all training texts with one shuffle of pre-aggregated counts. The
model is a matrix of log-probabilities, buckets x languages, whose size is bounded by
``MAX_LANGUAGES``; it is broadcast, and a text's score is the sum of its grams' rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.llm.common import remainder, ship, slices, small, worker_value

BITS = 16
ORDERS = (1, 2, 3)
#: 2**16 buckets x 512 languages x 4 bytes = 128 MB is the most that is broadcast.
MAX_LANGUAGES = 512
SMOOTHING = 0.5
UNKNOWN = "und"
#: Rows of the log-probability matrix that are added up at a time.
GATHER = 1 << 22


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray
    matrix: np.ndarray


def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def hashed_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of ``texts`` and the text that each belongs to, for each order
    in ascending text order. Blanks bound words and join in; grams never cross texts."""
    lowered = [t.lower() for t in texts]
    joined = " ".join(lowered) + " "
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 1 for t in lowered])
    code = np.where(worker_value("letters", _letters)[code], code, np.uint32(32))
    blank = code == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    code, owner = code[keep], owner[keep]
    buckets, owners = [], []
    for n in ORDERS:
        mixed = np.full(max(0, len(code) - n + 1), n, np.uint32)
        for k in range(n):
            mixed = (mixed ^ code[k : k + len(mixed)]) * np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(15)
        within = owner[: len(mixed)] == owner[n - 1 :][: len(mixed)]
        if n == 1:
            within = within & (code != 32)
        buckets.append((mixed * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS))[within].astype(np.int32))
        owners.append(owner[: len(mixed)][within])
    return np.concatenate(buckets), np.concatenate(owners)


def _columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def train(docs: DataFrame, use: Column) -> Model | None:
    """Fit on the rows that ``use`` (a condition on doc_id) admits and whose text and lang are
    not null. None if there are none. More than ``MAX_LANGUAGES`` languages are refused."""
    rows = docs.where(use & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    found = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if not found:
        return None
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; raise MAX_LANGUAGES if the matrix fits")
    languages = [r["lang"] for r in found]
    place = {lang: i for i, lang in enumerate(languages)}
    size = 1 << BITS

    def count(batches):
        total: dict[int, np.ndarray] = {}
        for batch in small(batches):
            texts, langs = _columns(batch, "text", "lang")
            for a, b in slices([len(t) for t in texts]):
                bucket, owner = hashed_grams(texts[a:b])
                of = np.array([place[x] for x in langs[a:b]])
                for side in np.unique(of):
                    got = np.bincount(bucket[of[owner] == side], minlength=size)
                    total[side] = total[side] + got if side in total else got
        for side, counts in total.items():
            full = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(full), side, np.int32)),
                    pa.array(full.astype(np.int32)),
                    pa.array(counts[full].astype(np.int64)),
                ],
                names=["side", "bucket", "n"],
            )

    counted = (
        rows.mapInArrow(count, "side int, bucket int, n long")
        .groupBy("side", "bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()  # at most languages x buckets rows
    )
    counts = np.zeros((size, len(languages)))
    counts[counted["bucket"].to_numpy(), counted["side"].to_numpy()] = counted["n"].to_numpy()
    matrix = np.log(counts + SMOOTHING) - np.log(counts.sum(0) + SMOOTHING * size)
    n = np.array([r["n"] for r in found], float)
    return Model(languages, np.log(n / n.sum()), matrix.astype(np.float32))


def posteriors(model: Model, texts: list[str]) -> np.ndarray:
    """Probability of each language for each text."""
    total = np.tile(model.prior, (len(texts), 1))
    for a, b in slices([len(t) for t in texts]):
        bucket, owner = hashed_grams(texts[a:b])
        for i in range(0, len(bucket), GATHER):
            part, whose = bucket[i : i + GATHER], owner[i : i + GATHER]
            begin = np.flatnonzero(np.concatenate([[True], whose[1:] != whose[:-1]]))
            sums = np.add.reduceat(model.matrix[part], begin, axis=0, dtype=np.float64)
            np.add.at(total, a + whose[begin], sums)
    shifted = np.exp(total - total.max(1, keepdims=True))
    return shifted / shifted.sum(1, keepdims=True)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row: the likeliest language and its probability;
    ``und`` and 0 for a null text, one without a letter, or where nothing could be learned.
    Equal probabilities go to the first language by code point. Whole texts are scored;
    repeated rows are scored each."""
    shipped = ship(docs.sparkSession, (model.languages, model.prior, model.matrix)) if model else None

    def run(batches):
        learned = Model(*shipped.value) if shipped else None
        letters = worker_value("letters", _letters)
        for batch in small(batches):
            texts = _columns(batch, "text")[0]
            langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            real = [i for i, t in enumerate(texts) if t and has_letter(t, letters)]
            if learned and real:
                found = posteriors(learned, [texts[i] for i in real])
                for i, best, row in zip(real, found.argmax(1), found):
                    langs[i], scores[i] = learned.languages[best], float(row[best])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index("doc_id")),
                    pa.array(langs, pa.string()),
                    pa.array(scores, pa.float64()),
                ],
                names=["doc_id", "lang_pred", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def has_letter(text: str, letters: np.ndarray) -> bool:
    if text[:64].isalpha() or any(map(str.isalpha, text[:64])):
        return True
    return bool(letters[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any())


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(remainder(column, 4) == 2, F.lit(False))
