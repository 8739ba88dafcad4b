"""Sources, sinks, keyed tables, joins for reports, aggregations and the model hook."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkmill.functions.text import word_count
from talkmill.operators import chunking as ch
from talkmill.operators import kept_vectors as kv
from talkmill.operators import model as mo
from talkmill.operators import reports as rp
from talkmill.operators import store as st
from talkmill.operators import transcripts as tr
from talkmill.queries import inputs as inp
from talkmill.queries import sql
from talkmill.queries.inputs import words_sql
from talkmill.queries.registry import query
from talkmill.session import scratch_dir
from talkmill.sources import log_source
from talkmill.sources import readers as rd

DIM = 64

# --- sources -----------------------------------------------------------------------------

LOG_CASES = """'https://youtu.be/'||doc_id||'?si=x' as video_url, 'Video '||doc_id as title,
  'Unknown' as duration, lang as language, 'gemini_raw_api_analysis' as method,
  case when doc_id%3 = 0 then 'About '||source else '' end as summary,
  case when doc_id%10 = 3 then substr(text, 1, 50)||chr(30)||chr(10)||'Log File: x'||chr(10)||chr(30)||'.'||text||chr(30) else text end as transcription"""
LOG_COLUMNS = [
    "concat('https://youtu.be/', doc_id, '?si=x') as video_url", "concat('Video ', doc_id) as title",
    "'Unknown' as duration", "lang as language", "'gemini_raw_api_analysis' as method",
    "case when doc_id%3 = 0 then concat('About ', source) else '' end as summary",
    "case when doc_id%10 = 3 then concat(substr(text, 1, 50), '\x1e\nLog File: x\n\x1e.', text, '\x1e') else text end as transcription",
]
LOGS = f"select doc_id, {LOG_CASES}, {words_sql('text')} as word_count from documents"


def log_records(spark, sf):
    """Documents as logs; the text of a tenth holds what separates records."""
    columns = inp.documents(spark, sf).selectExpr("*", *LOG_COLUMNS)
    return columns.select("doc_id", *[c.rsplit(" as ", 1)[1] for c in LOG_COLUMNS], word_count("text").alias("word_count"))


LOG_TEXT = """'YouTube Video URL: '||video_url||chr(10)||chr(10)||'Title: '||title||chr(10)||
  'Duration: '||duration||chr(10)||'Language: '||language||chr(10)||'Word Count: '||word_count||chr(10)||
  'Method: '||method||chr(10)||chr(10)||
  case when summary <> '' then '--- VIDEO SUMMARY ---'||chr(10)||summary||chr(10)||chr(10) else '' end||
  '--- TRANSCRIPTION ---'||chr(10)||transcription"""


RUN_TS_SPARK = "timestamp_seconds(1700000000 + doc_id)"
NAME_SQL = "'v'||doc_id||'_'||strftime(to_timestamp(1700000000 + doc_id) at time zone 'UTC', '%Y%m%d_%H%M%S')||'.txt'"


def written_logs(spark, sf):
    """All documents as logs, written by the sink."""
    folder = scratch_dir(spark, "logs")
    name = tr.log_name(F.expr(RUN_TS_SPARK), F.concat(F.lit("v"), F.col("doc_id")))
    tr.write_transcript_logs(log_records(spark, sf).withColumn("file_name", name), folder)
    return folder


@query(
    "s1_scan_transcript_logs",
    f"select {NAME_SQL} as file_name, 1700000000 + doc_id as run_second, video_url, title, duration, language, word_count, "
    f"method, summary, transcription from ({LOGS})",
)
def s1(spark, sf):
    """Write logs and read the folder back into records."""
    return rd.scan_transcript_logs(spark, written_logs(spark, sf)).withColumn(
        "run_second", F.unix_seconds("run_ts")
    ).drop("run_ts")


LOG_FIELDS = "video_url, title, duration, language, word_count, method, summary, transcription"


@query(
    "s1_log_source_since",
    f"select {NAME_SQL} as file_name, 1700000000 + doc_id as run_second, {LOG_FIELDS} from ({LOGS}) where doc_id between 50 and 749",
)
def s1_since(spark, sf):
    """Logs of a span of run times through the data source, which skips the others."""
    span = "run_ts >= timestamp_seconds(1700000050) and run_ts < timestamp_seconds(1700000750)"
    logs = log_source.read_logs(spark, written_logs(spark, sf)).where(span)
    return logs.withColumn("run_second", F.unix_seconds("run_ts")).drop("run_ts")


@query(
    "s1_stream_transcript_logs",
    f"select {NAME_SQL} as file_name, 1700000000 + doc_id as run_second, {LOG_FIELDS} from ({LOGS})",
)
def s1_stream(spark, sf):
    """The same logs as a stream of files."""
    work = scratch_dir(spark, "log-stream")
    logs = rd.stream_transcript_logs(spark, written_logs(spark, sf))
    writer = logs.writeStream.format("parquet").option("path", f"{work}/rows")
    writer.option("checkpointLocation", f"{work}/progress").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(logs.schema).parquet(f"{work}/rows")
    return rows.withColumn("run_second", F.unix_seconds("run_ts")).drop("run_ts")


@query(
    "s1_parse_transcript_logs",
    f"select doc_id, video_url, title, duration, language, word_count, method, summary, "
    f"transcription from ({LOGS})",
)
def s1_parse(spark, sf):
    """Parse rendered logs (with CRLF line ends in the header) back into records."""
    crlf = F.when(
        F.col("doc_id") % 2 == 0,
        F.concat(
            F.replace(F.substring_index("value", rd.TRANSCRIPT_MARK, 1), F.lit("\n"), F.lit("\r\n")),
            F.lit(rd.TRANSCRIPT_MARK + "\r\n"),
            F.col("transcription"),
        ),
    ).otherwise(F.col("value"))
    logs = log_records(spark, sf).withColumn("value", tr.render_log()).select(
        "doc_id", crlf.alias("value")
    )
    return rd.parse_transcript_logs(logs)


CAPTION_CASES = """transform(split(text,'\n'), (c,p) -> struct(
  concat('  ', c, ' ') as text, case p%4 when 3 then null else p*5.5D end as start,
  case p%5 when 4 then null else 5.5D end as duration))"""
CAPTIONS = f"""select doc_id, pos, {inp.trim_sql('c')} as text, start, start + duration as "end"
  from (select doc_id, c, p as pos, case (p-1)%4 when 3 then 0.0 else (p-1)*5.5::double end as start,
          case (p-1)%5 when 4 then 0.0 else 5.5::double end as duration
        from (select doc_id, unnest(string_split(text,chr(10))) c,
                     generate_subscripts(string_split(text,chr(10)),1) p from documents))
  where {inp.trim_sql('c')} <> ''"""


def captions(spark, sf):
    return inp.documents(spark, sf).selectExpr(
        "cast(doc_id as string) as video_url", f"{CAPTION_CASES} as items"
    )


@query(
    "s2_scan_caption_items",
    f"""select doc_id::varchar as video_url,
      (row_number() over (partition by doc_id order by pos) - 1)::int as seg_idx, text, start, "end"
      from ({CAPTIONS})""",
)
def s2(spark, sf):
    return rd.scan_caption_items(captions(spark, sf))


@query(
    "s3_scan_asr_segments",
    f"""select doc_id::varchar as video_url, lang as language, seg_idx, text, start, "end"
      from ({inp.SEG}) join (select doc_id, lang from documents) using (doc_id)""",
)
def s3(spark, sf):
    docs = inp.segment_arrays(spark, sf).join(
        inp.documents(spark, sf).select("doc_id", "lang"), "doc_id"
    )
    return rd.scan_asr_segments(
        docs.selectExpr("cast(doc_id as string) as video_url", "text", "lang as language", "segments")
    )


REGISTRY = f"select 'vid_'||page_id||'.mp4' as video_name, video_url from ({inp.URLS})"


def registry(spark, sf):
    return inp.video_urls(spark, sf).selectExpr(
        "concat('vid_', page_id, '.mp4') as video_name", "video_url", "html"
    )


@query("s4_scan_video_registry", REGISTRY)
def s4(spark, sf):
    return rd.scan_video_registry(registry(spark, sf))


@query(
    "s5_scan_vectors",
    f"select namespace, id, list_sum(embedding::double[]) as total from ({inp.VECTORS}) "
    "where namespace = 'label-3'",
)
def s5(spark, sf):
    """One company's vectors; the company name is normalised like the stored namespace."""
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return rd.scan_vectors(inp.vectors(spark, sf), "Label 3").select(
        "namespace", "id", total.alias("total")
    )


@query("s6_scan_pages", "select page_id, url, html from pages")
def s6(spark, sf):
    return rd.scan_pages(f"{sf}/pages.parquet", spark)


@query("s7_scan_questions", inp.QUESTIONS)
def s7(spark, sf):
    return rd.scan_questions(inp.questions(spark, sf))


@query("s7_scan_qa_pairs", inp.QA)
def s7_pairs(spark, sf):
    return rd.scan_qa_pairs(inp.qa_pairs(spark, sf))


# --- sinks and keyed tables --------------------------------------------------------------

ID_SQL = "company||'_https://youtu.be/'||doc_id||'_'||chunk_index"


def stored_chunks(spark, sf, docs, size, version):
    chunks = ch.explode_chunks(docs, ch.chunk_text("text", size, 200), "doc_id", "source")
    rows = chunks.selectExpr(
        "source as company_name",
        "concat('https://youtu.be/', doc_id) as video_url",
        "chunk_index",
        "text",
        "start",
        "end",
        "cast(null as string) as title",
        "'Unknown' as duration",
        "cast(null as string) as language",
        "cast(null as int) as word_count",
        "array(cast(length(text) as float)) as embedding",
    )
    return st.vector_rows(rows, F.lit(version), F.lit("youtube"))


@query(
    "k1_upsert_vectors",
    sql.with_ctes(
        sql.cte("again", "select * from documents where doc_id in (select doc_id from labels)"),
        sql.windows("documents", "doc_id", 1000, 200, "a"),
        sql.windows("again", "doc_id", 2000, 200, "b"),
        sql.cte(
            "rows",
            f"""select 1 as version, doc_id, chunk_index, text from a_chunks
                union all select 2, doc_id, chunk_index, text from b_chunks""",
        ),
    )
    + f""" select lower(source) as namespace, source||'_https://youtu.be/'||doc_id||'_'||chunk_index as id,
        version::bigint as version, text, 'Unknown' as title, 'youtube_gemini' as source_type,
        null::double as duration
      from rows join (select doc_id, source from documents) using (doc_id)
      qualify row_number() over (partition by doc_id, chunk_index order by version desc) = 1""",
)
def k1(spark, sf):
    """Ingest all documents, then again (larger chunks) those that got labels since."""
    docs = inp.documents(spark, sf)
    again = docs.join(inp.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    first = stored_chunks(spark, sf, docs, 1000, 1)
    second = stored_chunks(spark, sf, again, 2000, 2)
    return st.upsert_vectors(first, second).select(*STORED_COLUMNS)


STORED_COLUMNS = [
    "namespace", "id", "version", "metadata.text", "metadata.title", "metadata.source_type",
    "metadata.duration",
]


MERGED_SQL = (
    sql.with_ctes(
        sql.cte("again", "select * from documents where doc_id in (select doc_id from labels)"),
        sql.cte("third", "select * from documents where doc_id in (select doc_id from labels where quality = 1)"),
        sql.windows("documents", "doc_id", 1000, 200, "a"),
        sql.windows("again", "doc_id", 2000, 200, "b"),
        sql.windows("third", "doc_id", 1500, 200, "c"),
        sql.cte(
            "rows",
            f"""select 1 as run, 1 as version, doc_id, chunk_index, text from a_chunks
                union all select 2, 2, doc_id, chunk_index, text from b_chunks
                union all select 3, 2, doc_id, chunk_index, text from c_chunks
                union all select 4, 1, doc_id, chunk_index, text from b_chunks""",
        ),
    )
    + f""" select lower(source) as namespace, source||'_https://youtu.be/'||doc_id||'_'||chunk_index as id,
        version::bigint as version, text, 'Unknown' as title, 'youtube_gemini' as source_type,
        null::double as duration
      from rows join (select doc_id, source from documents) using (doc_id)
      qualify row_number() over (partition by doc_id, chunk_index order by version desc, run desc) = 1"""
)


def merged_store(spark, sf):
    """Path of a table on disk after four merges: all documents, a newer run of those that have labels, a
    run of the same version for some of these, and an old run that comes late."""
    docs, labels = inp.documents(spark, sf), inp.table(spark, sf, "labels")
    among = lambda rows: docs.join(rows.select("doc_id"), "doc_id", "left_semi")
    runs = [
        (docs, 1000, 1),
        (among(labels), 2000, 2),
        (among(labels.where("quality = 1")), 1500, 2),
        (among(labels), 2000, 1),
    ]
    work = scratch_dir(spark, "vector-store")
    for rows, size, version in runs:
        st.merge_vectors(
            spark, f"{work}/store", stored_chunks(spark, sf, rows, size, version), f"{work}/staging", buckets=2
        )
    return f"{work}/store"


@query("k1_merge_vectors", MERGED_SQL)
def k1_merge(spark, sf):
    """The current snapshot of a table on disk after four merges."""
    return st.read_vectors(spark, merged_store(spark, sf)).select(*STORED_COLUMNS)


@query(
    "a4_stored_figures",
    f"""select namespace, count(*) as vector_count, 0::bigint as with_ts, 0.0::double as avg_duration,
          round(avg(length(text)), 6) as avg_chars from ({MERGED_SQL}) group by namespace""",
)
def a4_stored(spark, sf):
    """Counts and figures per namespace after the same merges, from what the commits kept."""
    figures = st.stored_figures(spark, merged_store(spark, sf))
    return figures.withColumn("avg_chars", F.round("avg_chars", 6))


NEW_REGISTRY = f"""select 'vid_'||page_id||'.mp4' as video_name, 'https://cdn/'||page_id as video_url
  from ({inp.URLS}) where contains(lower(video_url), 'loom.com')"""


def new_registry(spark, sf):
    return inp.video_urls(spark, sf).where("contains(lower(video_url), 'loom.com')").selectExpr(
        "concat('/tmp/in/vid_', page_id, '.mp4') as local_filename",
        "concat('https://cdn/', page_id) as original_url",
    )


REGISTRY_MERGED = f"""select coalesce(b.video_name, a.video_name) as video_name,
    coalesce(b.video_url, a.video_url) as video_url
  from ({REGISTRY}) a full join ({NEW_REGISTRY}) b using (video_name)"""


@query("k2_upsert_registry", REGISTRY_MERGED)
def k2(spark, sf):
    known = rd.scan_video_registry(registry(spark, sf)).withColumn("version", F.lit(1))
    added = st.registry_rows(new_registry(spark, sf), F.lit(2))
    return st.upsert_registry(known, added).drop("version")


@query(
    "k2_stored_registry",
    f"""select video_name, case when c.page_id is not null then 'https://new/'||c.page_id else m.video_url end as video_url
      from ({REGISTRY_MERGED}) m left join (select page_id, 'vid_'||page_id||'.mp4' as video_name from pages where page_id % 3 = 0) c
        using (video_name)
      union all select 'vid_'||page_id||'.mp4', 'https://new/'||page_id from pages
        where page_id % 3 = 0 and 'vid_'||page_id||'.mp4' not in (select video_name from ({REGISTRY_MERGED}))""",
)
def k2_stored(spark, sf):
    """A registry on disk after four merges: what is known, new entries, a third batch of still newer
    ones, and the first again, which is older by then and changes nothing."""
    known = rd.scan_video_registry(registry(spark, sf)).withColumn("version", F.lit(1))
    added = st.registry_rows(new_registry(spark, sf), F.lit(2))
    newest = inp.table(spark, sf, "pages").where("page_id % 3 = 0").selectExpr(
        "concat('vid_', page_id, '.mp4') as video_name", "concat('https://new/', page_id) as video_url", "3 as version"
    )
    path = scratch_dir(spark, "registry")
    for batch in (known, added, newest, known):
        st.store_registry(spark, path, batch)
    return st.read_registry(spark, path).select("video_name", "video_url")


@query("k3_write_transcript_logs", f"select doc_id, {LOG_TEXT} as value from ({LOGS})")
def k3(spark, sf):
    return log_records(spark, sf).select("doc_id", tr.render_log().alias("value"))


@query(
    "k3_written_log_files",
    f"select {NAME_SQL} as file_name, {LOG_TEXT} as value from ({LOGS})",
)
def k3_files(spark, sf):
    """Records as they stand in the files that the sink wrote."""
    raw = spark.read.text(written_logs(spark, sf), lineSep=rd.LOG_SEPARATOR)
    return raw.select(
        F.regexp_extract("value", f"^{rd.NAME_MARK}([^\n]*)\n", 1).alias("file_name"),
        rd.unescaped(F.regexp_replace("value", f"^{rd.NAME_MARK}[^\n]*\n", "")).alias("value"),
    )


def requests(spark, sf):
    """Every document and every label is a request; labelled ones come twice per company."""
    docs = inp.documents(spark, sf)
    return docs.selectExpr(
        "doc_id",
        "case when doc_id%11 = 0 then '' else concat('https://youtu.be/', doc_id) end as video_url",
        "source as company_name",
        "case when doc_id%7 = 0 then null when doc_id%7 = 1 then '' else text end as transcription",
        "concat('T', doc_id) as title",
        "lang as language",
        "'gemini_transcription' as method",
    ).withColumn("word_count", word_count("transcription"))


REQUESTS = f"""select doc_id, case when doc_id%11 = 0 then '' else 'https://youtu.be/'||doc_id end as video_url,
  source as company_name,
  case when doc_id%7 = 0 then null when doc_id%7 = 1 then '' else text end as transcription,
  'T'||doc_id as title, lang as language, 'gemini_transcription' as method from documents"""
# Vectors of the videos with a label of quality 1 are incomplete.
COUNTED = sql.with_ctes(
    sql.cte("req", REQUESTS),
    sql.cte("src", "select doc_id, transcription as text from req where transcription <> ''"),
    sql.windows("src", "doc_id"),
    sql.cte("low", "select doc_id from labels where quality = 1"),
    sql.cte(
        "counted",
        """select r.*, coalesce(c.n, 0) as chunks_created,
             coalesce(case when l.doc_id is null then c.n else nullif(c.n - 1, 0) end, 0) as vectors_stored
           from req r left join (select doc_id, count(*) as n from w_chunks group by 1) c using (doc_id)
           left join low l using (doc_id)""",
    ),
)


def counted_requests(spark, sf):
    reqs = requests(spark, sf)
    chunks = ch.explode_chunks(
        reqs, ch.chunk_text("transcription"), "doc_id", "video_url", "company_name"
    )
    low = inp.table(spark, sf, "labels").where("quality = 1").select("doc_id", F.lit(0).alias("cut"))
    vectors = chunks.join(low, "doc_id", "left").where(
        F.col("cut").isNull() | (F.col("chunk_index") > 0)
    )
    return reqs, chunks, vectors


@query(
    "k4_ingest_report",
    COUNTED
    + f""" select video_url, company_name, e is null as success,
        case when e is null then title end as title, chunks_created, vectors_stored,
        case when e is null then {words_sql('transcription')} end as word_count,
        case when e is null then language end as language,
        case when e is null then method end as method,
        case when contains(e, 'Failed to extract transcription') then
          'Unable to extract video transcription. The video may not have captions or may be private.'
          else e end as error, e as original_error,
        case when e is not null then 'Try again in a few minutes or use a different video' end as suggestion
      from (select *, case when video_url = '' then 'video_url is required'
          when transcription is null then 'Failed to extract transcription'
          when transcription = '' then 'Empty transcription'
          when chunks_created = 0 then 'Failed to create chunks'
          when chunks_created <> vectors_stored then 'Failed to create embeddings' end as e
        from counted where video_url <> '')""",
)
def k4(spark, sf):
    reqs, chunks, vectors = counted_requests(spark, sf)
    return rp.ingest_report(rp.chunk_counts(reqs.where("video_url <> ''"), chunks, vectors))


@query(
    "j4_join_chunk_counts",
    COUNTED
    + " select video_url, company_name, chunks_created, vectors_stored from counted where video_url <> ''",
)
def j4(spark, sf):
    reqs, chunks, vectors = counted_requests(spark, sf)
    return rp.chunk_counts(
        reqs.where("video_url <> ''").select("video_url", "company_name"), chunks, vectors
    )


@query(
    "j5_missing_vectors",
    COUNTED
    + """ select doc_id, w.chunk_index from w_chunks w join low using (doc_id)
          where w.chunk_index = 0""",
)
def j5(spark, sf):
    _, chunks, vectors = counted_requests(spark, sf)
    by_doc = lambda df: df.selectExpr(
        "concat('d', doc_id) as video_url", "'c' as company_name", "chunk_index", "doc_id"
    )
    return mo.missing_vectors(by_doc(chunks), by_doc(vectors).drop("doc_id")).select(
        "doc_id", "chunk_index"
    )


# --- model hook --------------------------------------------------------------------------

LINES = f"select doc_id, seg_idx, text from ({inp.SEG})"


@query(
    "e1_batch_model",
    f"""select doc_id, seg_idx, case when seg_idx%5 = 3 then null when contains(text, 'e,') then 'failed'
          else length(text)||':'||text end as reply,
        case when seg_idx%5 <> 3 and contains(text, 'e,') then 'ValueError: no' end as error from ({LINES})""",
)
def e1(spark, sf):
    """The hook with a stand-in model, on every line: nulls are passed over, and a text that the
    model refuses fails alone."""
    rows = inp.segment_rows(spark, sf).select("doc_id", "seg_idx", "text")
    rows = rows.withColumn("text", F.when(F.col("seg_idx") % 5 != 3, F.col("text")))
    out = mo.batch_model(rows, "text", "reply", length_model, "string", default="failed", error_col="error")
    return out.select("doc_id", "seg_idx", "reply", "error")


def length_model():
    def run(texts):
        if any("e," in t for t in texts):
            raise ValueError("no")
        return [f"{len(t)}:{t}" for t in texts]

    return run


def failing_model():
    inner = mo.hashing_embedder(DIM)()

    def run(texts):
        if any("\n" in t for t in texts):
            raise RuntimeError("model refused the batch")
        return inner(texts)

    return run


@query(
    "e2_zero_vector_fallback",
    f"select doc_id, contains(text, chr(10)) or {words_sql('text')} = 0 as is_zero, "
    f"{DIM} as dim from documents",
)
def e2(spark, sf):
    """A model that refuses texts of several lines: these fail, and not those beside them."""
    out = mo.embed(inp.documents(spark, sf), "text", failing_model, DIM, batch_size=8)
    return out.select("doc_id", "is_zero", F.size("embedding").alias("dim"))


@query(
    "e1_kept_vectors",
    f"select doc_id, contains(text, chr(10)) or {words_sql('text')} = 0 as is_zero, "
    f"{DIM} as dim from documents",
)
def e1_kept(spark, sf):
    """All documents twice with one folder of kept vectors: the second time the model sees only the
    texts that it refused the first time."""
    docs, kept = inp.documents(spark, sf), scratch_dir(spark, "kept-vectors")
    kv.embed_kept(docs, "text", failing_model, kept, DIM)
    out = kv.embed_kept(docs, "text", failing_model, kept, DIM)
    return out.select("doc_id", "is_zero", F.size("embedding").alias("dim"))


@query(
    "e3_zip_embeddings",
    f"""select vec_id, label, company_name, list_sum(embedding::double[]) * f as total
        from embeddings, (values ('one', 1.0), ('two', 2.0)) c(company_name, f)""",
)
def e3(spark, sf):
    """Two companies hold the same videos; each chunk gets its own company's vector."""
    emb = inp.table(spark, sf, "embeddings")
    company = F.explode(F.array(F.lit("one"), F.lit("two")))
    both = emb.selectExpr("concat('v', label) as video_url", "vec_id as chunk_index", "label", "vec_id", "embedding")
    both = both.withColumn("company_name", company)
    factor = F.when(F.col("company_name") == "two", 2.0).otherwise(1.0).cast("float")
    vectors = both.withColumn("embedding", F.transform("embedding", lambda x: x * factor))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return mo.zip_embeddings(both.drop("embedding"), vectors.drop("label", "vec_id")).select(
        "vec_id", "label", "company_name", total.alias("total")
    )


@query(
    "e3_count_check",
    f"""select video_url, company_name, n_chunks, n_vectors, n_chunks = n_vectors as complete from (
      select label::varchar as video_url, 'c'||vec_id%2 as company_name, count(*) as n_chunks,
        count_if(vec_id in (select doc_id from labels))::bigint as n_vectors from embeddings group by all)""",
)
def e3_check(spark, sf):
    emb = inp.table(spark, sf, "embeddings")
    chunks = emb.selectExpr(
        "cast(label as string) as video_url", "concat('c', vec_id % 2) as company_name", "vec_id as doc_id"
    )
    vectors = chunks.join(inp.table(spark, sf, "labels"), "doc_id", "left_semi")
    return mo.count_check(chunks, vectors)


# --- aggregations ------------------------------------------------------------------------

TIMED_CHUNKS = [sql.cte("src", inp.SEG), sql.fold("src", "doc_id")]


def timed_chunks(spark, sf):
    segs = inp.segment_arrays(spark, sf)
    return ch.explode_chunks(segs, ch.fold_segments("segments"), "doc_id", "company")


@query(
    "a1_timestamp_coverage",
    sql.with_ctes(sql.cte("src", inp.TIMED), sql.inline("src", "doc_id"), recursive=False)
    + """ select source as company, count_if(start > 0 or "end" > 0)::bigint as with_ts, count(*) as total
      from i_chunks join documents using (doc_id) group by source""",
)
def a1(spark, sf):
    docs = inp.documents(spark, sf).select("doc_id", F.col("source").alias("company"))
    chunks = ch.explode_chunks(
        inp.timed_texts(spark, sf), ch.parse_inline_timestamps("t"), "doc_id"
    )
    return rp.timestamp_coverage(chunks.join(docs, "doc_id"), "company")


@query(
    "a2_chunk_stats",
    sql.with_ctes(*TIMED_CHUNKS)
    + """ select source as company, count(*) as n_chunks, round(avg("end"-start), 6) as avg_duration,
      round(avg(length(f.text)), 6) as avg_chars from f_chunks f join documents using (doc_id) group by source""",
)
def a2(spark, sf):
    stats = rp.chunk_stats(timed_chunks(spark, sf), "company")
    return stats.withColumn("avg_duration", F.round("avg_duration", 6)).withColumn(
        "avg_chars", F.round("avg_chars", 6)
    )


SPOKEN_SQL = r"regexp_replace(t, '\[[0-9]{2}:[0-9]{2}(?::[0-9]{2})?\]|\[[0-9]+\]', ' ', 'g')"


@query(
    "a3_transcript_stats",
    f"""select doc_id, {words_sql('t')} as word_count, {words_sql(SPOKEN_SQL)} as spoken_word_count,
      length(t)::int as n_chars, len(string_split(t, chr(10)))::int as n_segments from ({inp.TIMED})""",
)
def a3(spark, sf):
    return rp.transcript_stats(inp.timed_texts(spark, sf), "doc_id", "t", F.split("t", "\n"))


@query(
    "a4_namespace_stats",
    "select 'label-'||label as namespace, count(*) as vector_count from embeddings group by label",
)
def a4(spark, sf):
    from talkmill.operators.retrieval import namespace_stats

    return namespace_stats(inp.vectors(spark, sf))


@query(
    "a4_namespace_exists",
    """select 'Label '||doc_id as company_name, 'label-'||doc_id as namespace,
      count(vec_id) as vector_count, count(vec_id) > 0 as namespace_exists
      from labels left join embeddings on label = doc_id group by doc_id""",
)
def a4_exists(spark, sf):
    from talkmill.operators.retrieval import namespace_exists

    companies = inp.table(spark, sf, "labels").selectExpr("concat('Label ', doc_id) as company_name")
    return namespace_exists(companies, inp.vectors(spark, sf)).select(
        "company_name", "namespace", "vector_count", "namespace_exists"
    )


@query("a10_registry_count", f"select count(*) as video_mappings from ({REGISTRY})")
def a10(spark, sf):
    return rp.registry_count(rd.scan_video_registry(registry(spark, sf)))


@query("a10_registry_dump", REGISTRY)
def a10_dump(spark, sf):
    return rp.registry_dump(registry(spark, sf))


JOINED_CAPTIONS = f"""select doc_id::varchar as video_url, string_agg(text, ' ' order by pos) as transcription
  from ({CAPTIONS}) group by doc_id"""


@query("a12_join_caption_text", JOINED_CAPTIONS)
def a12(spark, sf):
    return tr.join_caption_text(rd.scan_caption_items(captions(spark, sf)))


# Model transcripts exist for labelled videos of quality 1, captions for the toxic ones.
C9_URL = "case when doc_id%4 = 0 then 'https://x/'||doc_id else 'https://youtu.be/v'||doc_id end"
PLACEHOLDER_SQL = f"'Video ID: v'||doc_id||chr(10)||chr(10)||'{tr.PLACEHOLDER}'"


@query(
    "c9_select_transcript",
    f"""select video_url, method, transcription, {words_sql('transcription')} as word_count, title from (
      select {C9_URL} as video_url,
        case when quality = 1 then 'gemini_raw_api_analysis'
          when toxic = 1 then 'youtube_transcript_api_fallback' else 'fallback_transcription' end as method,
        case when quality = 1 then text when toxic = 1 then caption else {PLACEHOLDER_SQL} end as transcription,
        case when quality = 1 or toxic = 1 then 'YouTube Video' else 'YouTube Video v'||doc_id end as title
      from documents left join labels using (doc_id)
      left join (select video_url::bigint as doc_id, transcription as caption from ({JOINED_CAPTIONS})) using (doc_id)
      where quality = 1 or toxic = 1 or doc_id%4 <> 0)""",
)
def c9(spark, sf):
    docs = inp.documents(spark, sf).join(inp.table(spark, sf, "labels"), "doc_id", "left")
    videos = docs.selectExpr("doc_id", f"{C9_URL} as video_url", "quality", "toxic", "text")
    model = videos.where("quality = 1").selectExpr(
        "video_url", "'gemini_raw_api_analysis' as method", "'YouTube Video' as title",
        "text as transcription", "'' as summary", "'Unknown' as duration", "'en' as language",
    ).withColumn("word_count", word_count("transcription"))
    texts = a12(spark, sf).withColumn("doc_id", F.col("video_url").cast("bigint")).drop("video_url")
    spoken = videos.where("toxic = 1").select("doc_id", "video_url").join(texts, "doc_id")
    return tr.select_transcript(
        videos.select("video_url"), model, spoken.select("video_url", "transcription")
    ).select("video_url", "method", "transcription", "word_count", "title")


# --- set operations and ranks ------------------------------------------------------------


@query("u1_merge_registry", REGISTRY_MERGED)
def u1(spark, sf):
    known = rd.scan_video_registry(registry(spark, sf))
    added = st.registry_rows(new_registry(spark, sf), F.lit(1)).drop("version")
    return st.merge_registry(known, added)


@query(
    "u2_union_branches",
    sql.with_ctes(
        sql.cte("src", inp.SEG), sql.fold("src", "doc_id"), sql.windows("documents", "doc_id")
    )
    + """ select 'loom_video' as source_type, doc_id, chunk_index, text, "end" from f_chunks
        union all select 'youtube_gemini', doc_id, chunk_index, text, 0.0 from w_chunks""",
)
def u2(spark, sf):
    """Timed and plain chunks of the same documents in one table."""
    plain = ch.explode_chunks(inp.documents(spark, sf), ch.chunk_text("text"), "doc_id")
    columns = ["source_type", "doc_id", "chunk_index", "text", "end"]
    return (
        timed_chunks(spark, sf)
        .withColumn("source_type", F.lit(st.LOOM_SOURCE))
        .unionByName(plain.withColumn("source_type", F.lit(st.YOUTUBE_SOURCE)), allowMissingColumns=True)
        .select(*columns)
    )


@query(
    "w4_latest_wins",
    "select user_id, event_id, event_type from (select *, row_number() over "
    "(partition by user_id order by event_id desc) as rn from events) where rn = 1",
)
def w4(spark, sf):
    events = inp.table(spark, sf, "events")
    return st.latest_wins(events, ["user_id"], "event_id").select("user_id", "event_id", "event_type")


@query(
    "p11_vector_metadata",
    f"""select {ID_SQL} as id, company, video_url, chunk_index, text, start, "end", title, duration,
        language, word_count, source_type from (
      select doc_id, company, 'https://youtu.be/'||doc_id as video_url, seg_idx as chunk_index, text, start, "end",
        'Unknown' as title, case doc_id%2 when 0 then 12.5 end::double as duration, 'Unknown' as language,
        null::int as word_count,
        case doc_id%3 when 0 then 'loom_video' else 'youtube_gemini' end as source_type from ({inp.SEG}))""",
)
def p11(spark, sf):
    rows = inp.segment_rows(spark, sf).selectExpr(
        "company as company_name", "concat('https://youtu.be/', doc_id) as video_url",
        "seg_idx as chunk_index", "text", "start", "end", "cast(null as string) as title",
        "case doc_id%2 when 0 then '12.5' else 'Unknown' end as duration",
        "cast(null as string) as language", "cast(null as int) as word_count",
        "case doc_id%3 when 0 then 'loom' else 'youtube' end as route",
        "array(1f) as embedding",
    )
    out = st.vector_rows(rows, F.lit(1)).select("id", "metadata.*")
    return out.drop("source", "original_video_url", "type", "context")


