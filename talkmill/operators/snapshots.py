"""Stored tables as a sequence of snapshots.

A table is a folder of three parts. ``data/run=<name>/…`` holds what one commit wrote, laid out by
the table's partition columns, and is never changed. ``manifests/<name>`` lists, for one snapshot,
the run that holds each partition, with measures of its rows. ``versions/<number>.json`` is the
pointer: the highest number is the current snapshot and names its manifest.

A commit writes its run and its manifest beside what is there and then adds one version file, by a
rename that fails if the number is taken. Until then readers follow the version before; a job that
dies at any point leaves at most folders that nothing points to. Of two writers that start from
the same snapshot one wins, the other gets an error and starts again.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.session import add_small_file, dir_exists, file_names, read_small_file, remove_dir

#: Up to so many partitions are chosen when a read is planned; beyond, by a join.
MAX_PRUNED = 2_000


class SnapshotConflict(RuntimeError):
    """Another writer committed since the snapshot that a commit started from."""


@dataclass
class StoredTable:
    """``columns`` is the DDL of the rows without the partition columns, ``parts`` those columns
    with their types. ``measures`` are named aggregate expressions over the rows of a partition,
    computed when a run is committed and kept in the manifest."""

    spark: SparkSession
    path: str
    columns: str
    parts: dict[str, str]
    measures: dict[str, str] = field(default_factory=dict)

    def head(self) -> dict:
        """The current version with its notes; empty when nothing has been committed."""
        numbers = [int(n.removesuffix(".json")) for n in file_names(self.spark, f"{self.path}/versions") if n[0].isdigit()]
        if not numbers:
            return {}
        return json.loads(read_small_file(self.spark, self._version(max(numbers))))

    def manifest(self, head: dict | None = None) -> DataFrame:
        """A row for each partition of a snapshot: partition columns, ``run``, ``n`` and measures."""
        head = self.head() if head is None else head
        if not head:
            own = ", ".join(f"{n} {t}" for n, t in self.parts.items())
            return self.spark.createDataFrame([], f"{own}, run string, n bigint")
        return self.spark.read.schema(head["schema"]).parquet(f"{self.path}/manifests/{head['manifest']}")

    def rows(self, touched: DataFrame | None = None, head: dict | None = None) -> DataFrame:
        """The rows of a snapshot, or those of the partitions that ``touched`` names. Partitions
        are chosen when the read is planned, so nothing else is opened."""
        live = self.manifest(head)
        if touched is not None:
            live = live.join(touched.select(*self.parts), [*self.parts], "left_semi")
        live = live.select("run", *self.parts)
        # One name for each commit that still holds a partition.
        runs = sorted(r["run"] for r in live.select("run").distinct().collect())
        own = ", ".join(f"{n} {t}" for n, t in self.parts.items())
        if not runs:
            return self.spark.createDataFrame([], f"{self.columns}, {own}")
        data = self._data(own, *runs)
        keys = [r["k"] for r in live.select(self._place().alias("k")).limit(MAX_PRUNED + 1).collect()]
        if len(keys) <= MAX_PRUNED:
            data = data.where(self._place().isin(keys))
        else:
            data = data.join(live, ["run", *self.parts], "left_semi")
        return data.drop("run")

    def commit(self, head: dict, rows: DataFrame, touched: DataFrame, laid: bool = False, **notes) -> dict:
        """Replace the ``touched`` partitions of snapshot ``head`` by ``rows`` and make that the
        current snapshot. ``notes`` go into the version; those of ``head`` are kept. ``laid`` rows
        are written by the tasks that hold them, others are brought together by partition."""
        run, number = uuid.uuid4().hex, head.get("version", 0) + 1
        placed = rows if laid else rows.hint("rebalance", *self.parts)
        placed.write.option("compression", "zstd").partitionBy(*self.parts).parquet(f"{self.path}/data/run={run}")
        own = ", ".join(f"{n} {t}" for n, t in self.parts.items())
        measured = [F.expr(e).alias(n) for n, e in self.measures.items()]
        if dir_exists(self.spark, f"{self.path}/data/run={run}/_SUCCESS") and self._wrote_rows(run):
            fresh = self._data(own, run).groupBy(*self.parts).agg(F.count("*").alias("n"), *measured)
        else:
            fresh = rows.limit(0).groupBy(*self.parts).agg(F.count("*").alias("n"), *measured)
        fresh = fresh.withColumn("run", F.lit(run))
        kept = self.manifest(head).join(touched.select(*self.parts).distinct(), [*self.parts], "left_anti")
        manifest = kept.unionByName(fresh, allowMissingColumns=True)
        manifest.write.parquet(f"{self.path}/manifests/{run}")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in manifest.schema.fields)
        new = {**head, **notes, "version": number, "manifest": run, "schema": schema}
        self._publish(number, new)
        return new

    def remove_unused(self, keep: int = 2) -> None:
        """Delete versions before the last ``keep``, and runs and manifests that no version left
        names. Jobs that read an older snapshot, and commits under way, must have ended."""
        numbers = sorted(int(n.removesuffix(".json")) for n in file_names(self.spark, f"{self.path}/versions") if n[0].isdigit())
        manifests, runs = set(), set()
        for number in numbers[-keep:]:
            head = json.loads(read_small_file(self.spark, self._version(number)))
            manifests.add(head["manifest"])
            runs |= {r["run"] for r in self.manifest(head).select("run").distinct().collect()}
        for number in numbers[:-keep]:
            remove_dir(self.spark, self._version(number))
        for name in file_names(self.spark, f"{self.path}/manifests"):
            if name not in manifests:
                remove_dir(self.spark, f"{self.path}/manifests/{name}")
        for name in file_names(self.spark, f"{self.path}/data"):
            if name.removeprefix("run=") not in runs:
                remove_dir(self.spark, f"{self.path}/data/{name}")

    def _version(self, number: int) -> str:
        return f"{self.path}/versions/{number:010d}.json"

    def _publish(self, number: int, content: dict) -> None:
        if not add_small_file(self.spark, self._version(number), json.dumps(content)):
            raise SnapshotConflict(f"version {number} of {self.path} was committed by another writer")

    def _wrote_rows(self, run: str) -> bool:
        return any("=" in n for n in file_names(self.spark, f"{self.path}/data/run={run}"))

    def _data(self, own: str, *runs: str) -> DataFrame:
        """Rows of runs with ``run`` and the partition columns. An empty string has no folder name
        of its own and comes back as null from Spark; here it is the empty string again."""
        read = self.spark.read.schema(f"{self.columns}, run string, {own}").option("basePath", f"{self.path}/data")
        found = read.parquet(*[f"{self.path}/data/run={r}" for r in runs])
        texts = {n: F.coalesce(n, F.lit("")) for n, t in self.parts.items() if t == "string"}
        return found.withColumns(texts) if texts else found

    def _place(self) -> Column:
        """Run and partition as one text, different for different ones: each value behind its length."""
        values = [F.col(n).cast("string") for n in ("run", *self.parts)]
        return F.concat(*[x for v in values for x in (F.length(v).cast("string"), F.lit(":"), v)])
