"""URL rules looked up in a sorted digest array.

A rule is a host and a path prefix. Its key is hashed to 64 bits (xxhash); the index file holds
the sorted digests, and beside them the full keys. Tasks map the file into memory, probe it by
vectorised binary search with every key that could fit a URL (its host's suffixes x its path's
prefixes, only of lengths that rules have), and confirm hits on the full strings. The file
travels with ``SparkContext.addFile``; rules beyond ``SLICE_RULES`` go in several such files,
one pass each, so that what is shipped at a time stays bounded.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict
from functools import reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkmill.llm.common import worker_value

SLICE_RULES = 2_000_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    low = F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(low, F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(host: str, path: str) -> bytes:
    return f"{host}\n{path}".encode("utf-8", "surrogatepass")


def write_index(rules: list[tuple[str, str, str]], file: Path) -> None:
    """``n``, sorted digests, offsets, then each rule as ``verdict, host, path`` lines."""
    rows = sorted((xxhash.xxh64_intdigest(key_of(h, p)), key_of(h, p), v.encode()) for h, p, v in rules)
    bodies = [v + b"\n" + key for _, key, v in rows]
    head = np.array([len(rows)], "<u8").tobytes() + np.array([d for d, _, _ in rows], "<u8").tobytes()
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in bodies])]).astype("<u8").tobytes()
    file.write_bytes(head + offsets + b"".join(bodies))


class Index:
    """A memory-mapped index file."""

    def __init__(self, file: str) -> None:
        raw = np.memmap(file, np.uint8, "r")
        n = int(raw[:8].view("<u8")[0])
        self.digests = raw[8 : 8 + 8 * n].view("<u8")
        self.offsets = raw[8 + 8 * n : 16 + 16 * n].view("<u8")
        self.bodies = raw[16 + 16 * n :]
        #: For each number of host labels, the path lengths that rules have.
        self.shapes: dict[int, set[int]] = defaultdict(set)
        for i in range(n):
            _, host, path = self.rule(i)
            self.shapes[host.count(".") + 1].add(len(path))

    def rule(self, i: int) -> tuple[str, str, str]:
        body = self.bodies[int(self.offsets[i]) : int(self.offsets[i + 1])].tobytes()
        verdict, host, path = body.decode("utf-8", "surrogatepass").split("\n", 2)
        return verdict, host, path

    def candidates(self, host: str, path: str):
        labels = host.split(".")
        for n, lengths in self.shapes.items():
            if host and n <= len(labels):
                suffix = ".".join(labels[len(labels) - n :])
                for length in lengths:
                    if length <= len(path):
                        yield suffix, path[:length]

    def best(self, hosts: list[str], paths: list[str]) -> list[tuple[str, str, str] | None]:
        """The longest fitting rule of each URL, a longer host first among equals."""
        keys, owner = [], []
        for i, (host, path) in enumerate(zip(hosts, paths)):
            for pair in self.candidates(host, path):
                keys.append(pair)
                owner.append(i)
        out: list[tuple[str, str, str] | None] = [None] * len(hosts)
        if not keys or not len(self.digests):
            return out
        probes = np.array([xxhash.xxh64_intdigest(key_of(*k)) for k in keys], np.uint64)
        left = np.searchsorted(self.digests, probes, "left")
        right = np.searchsorted(self.digests, probes, "right")
        for j in np.flatnonzero(right > left):
            for at in range(left[j], right[j]):  # more than one only if digests collide
                rule = self.rule(at)
                if rule[1:] == keys[j]:
                    old = out[owner[j]]
                    rank = (len(rule[1]) + len(rule[2]), len(rule[1]))
                    if old is None or rank > (len(old[1]) + len(old[2]), len(old[1])):
                        out[owner[j]] = rule
        return out


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``pages (page_id, url)``.

    ``rules (host, path, verdict)``: a rule fits its host and all its subdomains if the URL's path
    starts with the rule's. The longest host plus path wins; a URL that no rule fits gets
    ``default`` and a null rule, and so do null URLs and those without ``://``. A rule given twice
    with different verdicts blocks. Rules with a null part are ignored. Repeated pages come out
    as often.
    """
    spark = pages.sparkSession
    known = (
        rules.select("host", "path", "verdict")
        .dropna()
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
    )
    n = known.count()
    parts = max(1, -(-n // SLICE_RULES))
    out = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    for part in range(parts):
        own = known.where(F.pmod(F.xxhash64("host", "path"), F.lit(parts)) == part)
        rows = [(r["host"], r["path"], r["verdict"]) for r in own.toLocalIterator()]
        folder = Path(tempfile.mkdtemp(prefix="rules-"))  # the driver's; tasks get it by addFile
        file = folder / f"{folder.name}.idx"
        write_index(rows, file)
        spark.sparkContext.addFile(str(file))
        out = _probe(out, file.name, f"rule_{part}")
    found = [F.col(f"rule_{part}") for part in range(parts)]
    size = lambda c: F.struct(F.length(c["host"]) + F.length(c["path"]), F.length(c["host"]), c)
    best = reduce(lambda a, b: F.when(b.isNull() | (size(a) >= size(b)), a).otherwise(b), found)
    return out.withColumn("best", best).select(
        "page_id",
        "host",
        "path",
        F.concat("best.host", "best.path").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


def _probe(pages: DataFrame, name: str, column: str) -> DataFrame:
    found = T.StructType([T.StructField(k, T.StringType()) for k in ("verdict", "host", "path")])
    schema = T.StructType([*pages.schema, T.StructField(column, found)])

    def run(batches):
        index = worker_value(("rules", name), lambda: Index(SparkFiles.get(name)))
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            rows = [
                None if r is None else {"verdict": r[0], "host": r[1], "path": r[2]} for r in index.best(hosts, paths)
            ]
            kinds = pa.struct([(k, pa.string()) for k in ("verdict", "host", "path")])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(rows, kinds)], names=[*batch.schema.names, column]
            )

    return pages.mapInArrow(run, schema)
