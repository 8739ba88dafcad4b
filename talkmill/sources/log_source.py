"""Transcript logs as a data source of Spark, with filters on the run time pushed down.

``read_logs`` gives parsed logs; ``spark.read.format("transcript_logs").load(folder)``, or ``create
temporary view … using transcript_logs options (path '…')`` in SQL, gives the records (``register_logs``
first). Files are read by the tasks, in byte ranges that begin at a record; any file system that Arrow
reaches will do. Streams of logs use Spark's own file stream (``readers.stream_transcript_logs``), which
remembers the files it has seen.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from zoneinfo import ZoneInfo

import pyarrow as pa
import pyarrow.fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

from talkmill.sources.readers import ESCAPED_MARK, LOG_MARK, LOG_SEPARATOR, NAME_MARK, parse_transcript_logs

FORMAT = "transcript_logs"
SCHEMA = "value string, file_name string, run_ts timestamp"
#: Bytes that a task reads, and what opening a file counts for.
RANGE_BYTES, OPEN_BYTES = 128 << 20, 4 << 20
#: Bytes read at a time, and of the records of one Arrow batch.
READ_BYTES, BATCH_BYTES = 1 << 20, 8 << 20
ARROW = pa.schema([("value", pa.string()), ("file_name", pa.string()), ("run_ts", pa.timestamp("us", "UTC"))])
SEPARATOR = LOG_SEPARATOR.encode()
OWN_NAME = re.compile(rf"{NAME_MARK}([^\r\n]*)\r?\n")
STAMP = re.compile(r"\d{8}_\d{6}")


def register_logs(spark: SparkSession) -> None:
    """Make the format known to a session, and let Spark hand it filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LogSource)


def read_logs(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Parsed logs, as ``readers.scan_transcript_logs`` gives them. Where ``run_ts`` is compared with
    constants, files of other run times are not opened and records of others are not parsed."""
    register_logs(spark)
    zone = spark.conf.get("spark.sql.session.timeZone")
    source = spark.read.format(FORMAT).option("timeZone", zone).option("rangeBytes", str(range_bytes))
    return parse_transcript_logs(source.load(path))


def run_time(name: str, zone: ZoneInfo) -> dt.datetime | None:
    """The first time in a file's name."""
    found = STAMP.search(name)
    try:
        return dt.datetime.strptime(found.group(), "%Y%m%d_%H%M%S").replace(tzinfo=zone) if found else None
    except ValueError:
        return None


@dataclass
class Times:
    """Run times that filters leave, as bounds that are never too narrow: Spark compares again."""

    low: dt.datetime | None = None
    high: dt.datetime | None = None
    known: bool = False

    def narrow(self, given: ds.Filter) -> None:
        if getattr(given, "attribute", None) != ("run_ts",):
            return
        if isinstance(given, ds.IsNotNull):
            self.known = True
            return
        values = given.value if isinstance(given, ds.In) else [getattr(given, "value", None)]
        if not values or not all(isinstance(v, dt.datetime) and v.tzinfo for v in values):
            return
        if isinstance(given, (ds.EqualTo, ds.In, ds.GreaterThan, ds.GreaterThanOrEqual)):
            self.low = max(filter(None, [self.low, min(values)]))
        if isinstance(given, (ds.EqualTo, ds.In, ds.LessThan, ds.LessThanOrEqual)):
            self.high = min(filter(None, [self.high, max(values)]))
        self.known = self.known or self.low is not None or self.high is not None

    def may_hold(self, time: dt.datetime | None) -> bool:
        if time is None:
            return not self.known
        return not (self.low and time < self.low) and not (self.high and time > self.high)


@dataclass
class Ranges(ds.InputPartition):
    """``(path, begin, end)`` of the parts of files that one task reads."""

    parts: list[tuple[str, int, int]] = field(default_factory=list)


class LogSource(ds.DataSource):
    """Options: ``path``; ``timeZone`` of the times in names (UTC); ``rangeBytes`` a task reads."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LogReader:
        return LogReader(self.options)


class LogReader(ds.DataSourceReader):
    def __init__(self, options) -> None:
        self.path = options["path"]
        self.zone = ZoneInfo(options.get("timeZone", "UTC"))
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.times = Times()

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for given in filters:
            self.times.narrow(given)
            yield given

    def partitions(self) -> list[Ranges]:
        files, root = file_system(self.path)
        info = files.get_file_info(root)
        if info.type == arrow_fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else files.get_file_info(arrow_fs.FileSelector(root, recursive=True))
        out, room = [Ranges()], self.range_bytes
        for own in sorted((f for f in found if f.is_file and f.size), key=lambda f: f.path):
            inside = own.path[len(root) :].strip("/").split("/")
            if any(n[:1] in ("_", ".") and "=" not in n for n in inside):
                continue
            if STAMP.search(own.base_name) and not self.times.may_hold(run_time(own.base_name, self.zone)):
                continue
            for begin in range(0, own.size, self.range_bytes):
                end = min(own.size, begin + self.range_bytes)
                if out[-1].parts and room < end - begin:
                    out.append(Ranges())
                    room = self.range_bytes
                out[-1].parts.append((own.path, begin, end))
                room -= end - begin + OPEN_BYTES
        return out

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        files, _ = file_system(self.path)
        rows: list[tuple] = []
        size = 0
        for path, begin, end in partition.parts:
            own = path.rsplit("/", 1)[-1]
            dated = STAMP.search(own) is not None
            with files.open_input_file(path) as file:
                for record in records(file, begin, end):
                    text = record.decode("utf-8", "replace")
                    named = OWN_NAME.match(text)
                    name = unescaped(named.group(1)) if named and not dated else ""
                    time = run_time(name or own, self.zone)
                    if not self.times.may_hold(time):
                        continue
                    rows.append((unescaped(text[named.end() :] if named else text), name or own, time))
                    size += len(record)
                    if size >= BATCH_BYTES:
                        yield as_batch(rows)
                        rows, size = [], 0
        if rows:
            yield as_batch(rows)


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(values, kind) for values, kind in zip(zip(*rows), ARROW.types)]
    return pa.RecordBatch.from_arrays(columns, schema=ARROW)


def unescaped(text: str) -> str:
    return text.replace(ESCAPED_MARK, LOG_MARK)


def file_system(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """Arrow's file system for a path or URI, and the path there."""
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    if "://" in path:
        return arrow_fs.FileSystem.from_uri(path.rstrip("/"))
    return arrow_fs.LocalFileSystem(), path.rstrip("/")


def records(file, begin: int, end: int) -> Iterator[bytes]:
    """The records that begin in ``[begin, end)`` of a file, empty ones left out. One is held at a time."""
    at = max(0, begin - len(SEPARATOR))
    file.seek(at)
    held, searched, whole = bytearray(), 0, begin == 0
    while True:
        cut = held.find(SEPARATOR, searched)
        if cut < 0:
            searched = max(0, len(held) - len(SEPARATOR) + 1)
            block = file.read(READ_BYTES)
            if block:
                held += block
                continue
            if whole and held:
                yield bytes(held)
            return
        if whole and cut:
            yield bytes(held[:cut])
        del held[: cut + len(SEPARATOR)]
        at, searched, whole = at + cut + len(SEPARATOR), 0, True
        if at >= end:
            return
