"""The one extension point: a model called on batches of texts."""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkmill.functions.vectors import is_zero

EMBEDDING_DIM = 1536
EMBED_BATCH, LIGHT_EMBED_BATCH = 100, 50

#: Rows, and bytes of rows, that a task holds back at most until a call is full.
MAX_HELD_ROWS, MAX_HELD_BYTES = 20_000, 32 << 20
#: Bytes of rows whose texts are Python strings at a time, unless one row alone has more.
PIECE_BYTES = 1 << 20
#: Tokens that the stand-in embedder remembers, and characters that it splits at a time.
MAX_SLOTS, EMBED_CHARS = 1 << 17, 1 << 20

BatchFn = Callable[[list[str]], list]


def batch_model(
    df: DataFrame,
    in_col: str,
    out_col: str,
    factory: Callable[[], BatchFn],
    out_type: str,
    batch_size: int = EMBED_BATCH,
    default=None,
    error_col: str | None = None,
) -> DataFrame:
    """Append ``out_col = fn(texts)``, calling ``fn`` on ``batch_size`` texts, fewer only at the end of
    a task (or among very many nulls or very long rows): calls are filled across Arrow batches.

    ``factory`` runs once per task (load the model there). Null texts never reach the model and
    get null. A batch that fails, or that returns another number of results, is tried again text
    by text; only texts that fail alone get ``default``, and ``error_col``, if named, says why.
    Rows, order and all other columns stay as they are; the data leaves the JVM as Arrow
    batches.

    An Arrow batch may hold very many or very long rows: a task works on ``PIECE_BYTES`` of it at a
    time and gives rows out as soon as they have their replies.

    Model calls may not be repeatable: write the result before using it twice.
    """
    arrow_type = pa.list_(pa.float32()) if "array<float>" in out_type else pa.string()
    added = [T.StructField(out_col, _parse(out_type))]
    if error_col:
        added.append(T.StructField(error_col, T.StringType()))
    schema = T.StructType(df.schema.fields + added)

    def finished(batch: pa.RecordBatch, results: list, errors: list) -> pa.RecordBatch:
        columns, names = [*batch.columns, _column(results, arrow_type)], [*batch.schema.names, out_col]
        if error_col:
            columns.append(pa.array(errors, pa.string()))
            names.append(error_col)
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = factory()
        held: deque[pa.RecordBatch] = deque()
        results: list = []
        errors: list[str | None] = []
        # Rows are numbered from the first one held; ``waiting`` are those not yet asked about.
        waiting: deque[tuple[int, str]] = deque()
        gone = held_bytes = 0

        def ask(n: int) -> None:
            part = [waiting.popleft() for _ in range(n)]
            for (row, _), reply in zip(part, _replies(fn, [t for _, t in part], default)):
                results[row - gone], errors[row - gone] = reply

        for batch in (piece for whole in batches for piece in _pieces(whole)):
            texts = batch.column(in_col).to_pylist()
            waiting.extend((gone + len(results) + i, t) for i, t in enumerate(texts) if t is not None)
            results.extend([None] * len(texts))
            errors.extend([None] * len(texts))
            held.append(batch)
            held_bytes += batch.nbytes
            while len(waiting) >= batch_size:
                ask(batch_size)
            if waiting and (len(results) > MAX_HELD_ROWS or held_bytes > MAX_HELD_BYTES):
                ask(len(waiting))
            ready = waiting[0][0] - gone if waiting else len(results)
            while held and held[0].num_rows <= ready:
                n = held[0].num_rows
                held_bytes -= held[0].nbytes
                yield finished(held.popleft(), results[:n], errors[:n])
                del results[:n], errors[:n]
                gone, ready = gone + n, ready - n
        if waiting:
            ask(len(waiting))
        for batch in held:
            n = batch.num_rows
            yield finished(batch, results[:n], errors[:n])
            del results[:n], errors[:n]

    return df.mapInArrow(run, schema)


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``PIECE_BYTES``, or of one row; halved, as rows differ much in length."""
    if batch.num_rows > 1 and batch.nbytes > PIECE_BYTES:
        half = batch.num_rows // 2
        yield from _pieces(batch.slice(0, half))
        yield from _pieces(batch.slice(half))
    else:
        yield batch


def _replies(fn: BatchFn, texts: list[str], default) -> list[tuple]:
    """``(result, error)`` of each text."""
    try:
        got = list(fn(texts))
        if len(got) == len(texts):
            return [(g, None) for g in got]
        error = f"{len(got)} results for {len(texts)} texts"
    except Exception as e:
        error = f"{type(e).__name__}: {e}"
    if len(texts) == 1:
        return [(default, error)]
    return [_replies(fn, [t], default)[0] for t in texts]


def _column(results: list, arrow_type: pa.DataType) -> pa.Array:
    """Results as an Arrow column; numpy vectors are laid end to end instead of boxed."""
    if results and all(isinstance(r, np.ndarray) for r in results):
        ends = np.cumsum([0] + [len(r) for r in results], dtype=np.int32)
        flat = pa.array(np.concatenate(results).astype(np.float32))
        return pa.ListArray.from_arrays(pa.array(ends), flat)
    return pa.array(results, type=arrow_type)


def _parse(out_type: str) -> T.DataType:
    if out_type == "array<float>":
        return T.ArrayType(T.FloatType())
    if out_type == "string":
        return T.StringType()
    raise ValueError("out_type is 'array<float>' or 'string'")


def embed(
    df: DataFrame,
    text: str,
    factory: Callable[[], BatchFn],
    dim: int = EMBEDDING_DIM,
    batch_size: int = EMBED_BATCH,
    out_col: str = "embedding",
) -> DataFrame:
    """Embed a text column. Texts whose call fails get zero vectors and null texts null ones,
    both flagged as ``is_zero``; ``embed_error`` says why a call failed."""
    zero = np.zeros(dim, dtype=np.float32)
    out = batch_model(df, text, out_col, factory, "array<float>", batch_size, zero, "embed_error")
    return out.withColumn("is_zero", F.coalesce(is_zero(out_col), F.lit(True)))


def hashing_embedder(dim: int = 64) -> Callable[[], BatchFn]:
    """Offline stand-in for an embedding model: L2-normalised counts of hashed tokens."""

    def factory() -> BatchFn:
        class Slots(dict):
            """Slot of a token, worked out when it is first asked for."""

            def __missing__(self, token: str) -> int:
                self[token] = slot = int.from_bytes(hashlib.md5(token.encode()).digest()[:4]) % dim
                return slot

        slots = Slots()

        def some(texts: list[str]) -> list[np.ndarray]:
            tokens = [t.lower().split() for t in texts]
            if len(slots) > MAX_SLOTS:
                slots.clear()
            n = [len(own) for own in tokens]
            found = np.fromiter(map(slots.__getitem__, chain.from_iterable(tokens)), np.int64, sum(n))
            rows = np.repeat(np.arange(len(texts)), n)
            counts = np.bincount(rows * dim + found, minlength=len(texts) * dim).reshape(-1, dim).astype(float)
            norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
            return list((counts / np.where(norms == 0, 1.0, norms)).astype(np.float32))

        def run(texts: list[str]) -> list[np.ndarray]:
            out, part, chars = [], [], 0
            for t in texts:
                if part and chars + len(t) > EMBED_CHARS:
                    out.extend(some(part))
                    part, chars = [], 0
                part.append(t)
                chars += len(t)
            return out + some(part) if part else out

        return run

    return factory


#: What tells a chunk from all others: two companies may ingest the same video.
CHUNK_KEY = ["company_name", "video_url", "chunk_index"]


def zip_embeddings(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Attach separately made embeddings to their chunks by position."""
    return chunks.join(embeddings.select(*CHUNK_KEY, "embedding"), CHUNK_KEY)


def missing_vectors(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Chunks that did not get a vector."""
    return chunks.join(embeddings, CHUNK_KEY, "left_anti")


def count_check(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Per video of a company: number of chunks, number of vectors, and whether they agree."""
    key = CHUNK_KEY[:2]
    side = lambda df, name: df.groupBy(*key).agg(F.count("*").alias(name))
    counts: Column = F.coalesce("n_vectors", F.lit(0))
    return (
        side(chunks, "n_chunks")
        .join(side(embeddings, "n_vectors"), key, "left")
        .withColumn("n_vectors", counts)
        .withColumn("complete", F.col("n_chunks") == F.col("n_vectors"))
    )
