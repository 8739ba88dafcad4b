from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill import schemas
from talkmill.functions.text import strip
from talkmill.functions.urls import namespace_of

TRANSCRIPT_MARK = "--- TRANSCRIPTION ---"
SUMMARY_MARK = "--- VIDEO SUMMARY ---"

# Header labels of the transcript log format.
LOG_HEADERS = {
    "video_url": "YouTube Video URL",
    "title": "Title",
    "duration": "Duration",
    "language": "Language",
    "word_count": "Word Count",
    "method": "Method",
}


#: Between the records of a file of many logs, and before the file name that a record carries.
LOG_SEPARATOR = "\x1e\n"
#: The separator's first character inside a record, and how it stands in the file.
LOG_MARK, ESCAPED_MARK = "\x1e", "\x1e."
NAME_MARK = "Log File: "


def read_table(spark: SparkSession, source: str | DataFrame, fmt: str, schema: str) -> DataFrame:
    """A path in one of Spark's formats, or a DataFrame that is passed through."""
    if isinstance(source, DataFrame):
        return source
    return spark.read.format(fmt).schema(schema).load(source)


def parse_transcript_logs(logs: DataFrame, value: str = "value") -> DataFrame:
    """Whole log texts to one row per transcript; other columns are kept."""
    text = F.col(value)
    cut = F.instr(text, F.lit(TRANSCRIPT_MARK))
    keep = [c for c in logs.columns if c != value]
    split = logs.select(
        *keep,
        F.when(cut > 0, F.substr(text, F.lit(1), cut - 1)).otherwise(text).alias("_head"),
        F.when(
            cut > 0,
            F.regexp_replace(F.substr(text, cut + len(TRANSCRIPT_MARK)), r"^\r?\n", ""),
        ).alias("transcription"),
    )
    head = F.col("_head")

    def header(label: str):
        value = F.regexp_extract(head, rf"(?m)^{label}: ([^\r\n]*)", 1)
        return F.nullif(value, F.lit(""))

    summary = F.regexp_extract(head, rf"(?s){SUMMARY_MARK}\r?\n(.*?)(?:\r?\n)*$", 1)
    fields = [
        *[
            (header(label).try_cast("int") if name == "word_count" else header(label)).alias(name)
            for name, label in LOG_HEADERS.items()
        ],
        summary.alias("summary"),
        F.col("transcription"),
    ]
    # As rows of an array of one: Spark moves filters and join keys below a plain projection, where
    # each mention of a header would read the whole log again.
    return split.select(*keep, F.inline_outer(F.array(F.struct(*fields))))


def escaped(record: Column) -> Column:
    """A record in which nothing looks like a separator."""
    return F.replace(record, F.lit(LOG_MARK), F.lit(ESCAPED_MARK))


def unescaped(record: Column) -> Column:
    return F.replace(record, F.lit(ESCAPED_MARK), F.lit(LOG_MARK))


def scan_transcript_logs(spark: SparkSession, path: str) -> DataFrame:
    """Read a folder of logs: files of one log each, whose name tells the run time, or files of
    many as :func:`write_transcript_logs` makes them, whose records carry their file name. Any text
    comes back as it was written. ``log_source.read_logs`` reads the same and skips by run time."""
    return _records(spark.read.text(path, lineSep=LOG_SEPARATOR))


def stream_transcript_logs(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Logs that keep arriving in a folder, as :func:`scan_transcript_logs` gives them."""
    return _records(spark.readStream.options(**options).text(path, lineSep=LOG_SEPARATOR))


def _records(files: DataFrame) -> DataFrame:
    """Parsed logs. A record's run time is in its file's name or else in the name it carries."""
    stamp = lambda name: F.regexp_extract(name, r"(\d{8}_\d{6})", 1)
    files = files.select("value", F.col("_metadata.file_name").alias("_file"))
    named = F.when(stamp("_file") == "", F.regexp_extract("value", f"^{NAME_MARK}([^\r\n]*)\r?\n", 1))
    records = files.where(F.length("value") > 0).select(
        unescaped(F.regexp_replace("value", f"^{NAME_MARK}[^\r\n]*\r?\n", "")).alias("value"),
        F.coalesce(F.nullif(unescaped(named), F.lit("")), F.col("_file")).alias("file_name"),
    )
    run = F.try_to_timestamp(stamp("file_name"), F.lit("yyyyMMdd_HHmmss"))
    return parse_transcript_logs(records.select("value", "file_name", run.alias("run_ts")))


def scan_caption_items(source, spark: SparkSession | None = None, fmt: str = "json") -> DataFrame:
    """Caption items (nested per video) to one row per segment, blank items dropped.

    Blanks go before the index is given, so ``seg_idx`` is dense.
    """
    videos = read_table(spark, source, fmt, schemas.CAPTIONS)
    return videos.select(
        "video_url", F.posexplode(caption_segments("items")).alias("seg_idx", "s")
    ).select("video_url", "seg_idx", "s.text", "s.start", "s.end")


def caption_segments(items):
    """Array of caption items ``{text,start,duration}`` to segments ``{text,start,end}``."""
    items = F.col(items) if isinstance(items, str) else items

    def one(i):
        start = F.coalesce(i["start"], F.lit(0.0))
        return F.struct(
            strip(F.coalesce(i["text"], F.lit(""))).alias("text"),
            start.alias("start"),
            (start + F.coalesce(i["duration"], F.lit(0.0))).alias("end"),
        )

    return F.filter(F.transform(items, one), lambda s: s["text"] != "")


def scan_asr_segments(source, spark: SparkSession | None = None, fmt: str = "json") -> DataFrame:
    """Speech-to-text output (nested per video) to one row per raw segment."""
    videos = read_table(spark, source, fmt, schemas.ASR_OUTPUT)
    return videos.select(
        "video_url",
        F.coalesce("language", F.lit("en")).alias("language"),
        F.posexplode("segments").alias("seg_idx", "s"),
    ).select("video_url", "language", "seg_idx", "s.text", "s.start", "s.end")


def scan_video_registry(source, spark: SparkSession | None = None, fmt: str = "parquet") -> DataFrame:
    table = read_table(spark, source, fmt, schemas.VIDEO_REGISTRY)
    return table.select("video_name", "video_url")


def scan_vectors(store: DataFrame, company: str | DataFrame) -> DataFrame:
    """Vectors of one company, or of every company named in a table.

    The store is partitioned by ``namespace``: a literal prunes partitions at planning
    time, a table prunes them at run time.
    """
    if isinstance(company, str):
        return store.where(F.col("namespace") == namespace_of(F.lit(company)))
    wanted = company.select(namespace_of("company_name").alias("namespace")).distinct()
    return store.join(wanted, "namespace", "left_semi")


def scan_pages(source, spark: SparkSession | None = None, fmt: str = "parquet") -> DataFrame:
    table = read_table(spark, source, fmt, schemas.SHARE_PAGES)
    return table.select("page_id", "url", "html")


def scan_questions(source, spark: SparkSession | None = None, fmt: str = "json") -> DataFrame:
    table = read_table(spark, source, fmt, schemas.QUESTIONS)
    return table.select("question_id", "company_name", "question")


def scan_qa_pairs(source, spark: SparkSession | None = None, fmt: str = "json") -> DataFrame:
    return read_table(spark, source, fmt, schemas.QA_PAIRS).select(
        "session_id", "seq", "question", "answer", "buyer_name", "company_name"
    )


