"""Whole pipelines and streaming jobs over videos derived from documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkmill.functions.text import word_count
from talkmill.functions.timing import SEGMENTS_TYPE
from talkmill.operators import transcripts as tr
from talkmill.operators.model import hashing_embedder
from talkmill.operators.store import read_vectors
from talkmill.plans import ingest as ing
from talkmill.plans import quality, questions
from talkmill.queries import answers as ans
from talkmill.queries import chunks as chq
from talkmill.queries import inputs as inp
from talkmill.queries import sql
from talkmill.queries import tables as tab
from talkmill.queries.inputs import words_sql
from talkmill.queries.registry import ORACLES, query
from talkmill.queries.scalars import MEDIA_SQL, TITLE_SQL, label_sql
from talkmill.session import scratch_dir
from talkmill.sources import readers as rd
from talkmill.streaming import (
    chunk_live_segments,
    logged_transcripts,
    read_transcript_stream,
    rocksdb_state,
    stream_ingest,
)

DIM = 64

# Kinds of videos: a third is recorded speech, the rest has a model transcript, captions, both
# or neither. A few requests are invalid.
# Some links name the site in their query only; these are failures.
URL_SPARK = """case when doc_id%50=7 then '' when doc_id%50=11 and doc_id%3<>0 then concat('https://other.example/?u=youtu.be/v',doc_id)
  when doc_id%3=0 then concat('https://www.loom.com/share/v',doc_id)
  else concat('https://youtu.be/v',doc_id,'?si=x') end"""


def ingest_inputs(spark, sf):
    """Every document is a request; what its video lacks is null or empty, not left out."""
    docs = inp.documents(spark, sf).selectExpr("*", f"{URL_SPARK} as video_url")
    loom = F.col("video_url").contains("loom.com")
    requests = docs.selectExpr("video_url", "source as company_name")
    model = (
        docs.where(~loom)
        .selectExpr(
            "video_url", "'gemini_raw_api_analysis' as method", "'YouTube Video' as title",
            f"case when doc_id%7 <> 0 then {inp.TIMED_SPARK} end as transcription",
            "'' as summary", "'Unknown' as duration", "'en' as language",
        )
        .withColumn("word_count", word_count("transcription"))
    )
    captions = docs.where(~loom).selectExpr(
        "video_url", f"case when doc_id%5 = 0 then {tab.CAPTION_CASES} else array() end as items"
    )
    asr = docs.where(loom).selectExpr(
        "video_url",
        "case when doc_id%12 <> 0 then text end as text",
        "lang as language",
        f"case when doc_id%9 = 0 then cast(array() as {SEGMENTS_TYPE}) else {chq.ROUGH_ARRAY} end as segments",
    )
    pages = (
        inp.table(spark, sf, "pages")
        .selectExpr("page_id as doc_id", f"{inp.SHARE_CASE} as html")
        .join(docs.where(loom).select("doc_id", "video_url"), "doc_id")
        .selectExpr("doc_id as page_id", "video_url as url", "html")
    )
    return requests, model, captions, asr, pages


def ingested(spark, sf, mode=ing.STANDARD, embedded_path=None):
    return ing.ingest(
        *ingest_inputs(spark, sf), hashing_embedder(DIM), DIM, mode, version=1, embedded_path=embedded_path
    )


def stored_vectors(spark, sf):
    """Vectors of an ingest that ran: chunks are cut and embedded once, whatever reads them."""
    return ingested(spark, sf, embedded_path=scratch_dir(spark, "embedded")).vectors


def ingest_ctes(mode: str) -> list[str]:
    """CTEs ``chunks`` (all chunks with their video) and ``info`` (one row per request)."""
    if mode == ing.STANDARD:
        loom = [sql.fold("lsegs", "doc_id", 600, 30, p="lc"), sql.windows("ltext", "doc_id", 600, 200, "lw")]
        lsegs = f"select * from ({chq.VALID}) where doc_id%3=0 and doc_id%50<>7 and doc_id%9<>0 and doc_id%12<>0"
    else:
        loom = [sql.fold_fixed("lsegs", "doc_id", p="lc"), sql.windows("ltext", "doc_id", 500, 50, "lw")]
        lsegs = f"select * from ({chq.ROUGH}) where doc_id%3=0 and doc_id%50<>7 and doc_id%9<>0 and doc_id%12<>0"
    marked = f"regexp_matches(text,'{sql.P1}') or regexp_matches(text,'{sql.P2}') or regexp_matches(text,'{sql.P3}')"
    method = "loom_transcription" + ("" if mode == ing.STANDARD else "_lightweight")
    return [
        sql.cte("timed", inp.TIMED),
        sql.cte("cap", f"select * from ({tab.CAPTIONS}) where doc_id%5=0 and doc_id%3<>0 and doc_id%50 not in (7, 11)"),
        sql.cte("captext", "select doc_id, string_agg(text,' ' order by pos) as c from cap group by doc_id"),
        sql.cte(
            "info",
            f"""select doc_id, source as company, lang,
              case when doc_id%3=0 then 'loom' else 'youtube' end as route,
              case when doc_id%3=0 then 'https://www.loom.com/share/v'||doc_id
                when doc_id%50=11 then 'https://other.example/?u=youtu.be/v'||doc_id else 'https://youtu.be/v'||doc_id||'?si=x' end as video_url,
              case when doc_id%3=0 then case when doc_id%12<>0 then text end
                when doc_id%50=11 then null when doc_id%7<>0 then t when c is not null then c
                else 'Video ID: v'||doc_id||chr(10)||chr(10)||'{tr.PLACEHOLDER}' end as text,
              case when doc_id%3=0 then case when m is not null then coalesce(ti,'Unknown') else 'Loom Video - v'||doc_id end
                when doc_id%7<>0 or c is not null then 'YouTube Video' else 'YouTube Video v'||doc_id end as title,
              case when doc_id%3=0 then lang else 'en' end as language,
              case when doc_id%3=0 then '{method}' else 'gemini_transcription' end as method
            from documents join timed using (doc_id) left join captext using (doc_id)
            left join (select page_id as doc_id, {MEDIA_SQL} as m, {TITLE_SQL} as ti from ({inp.SHARES})) using (doc_id)
            where doc_id%50<>7""",
        ),
        sql.cte("capsegs", 'select doc_id, pos as seg_idx, text, start, "end" from cap'),
        sql.cte("rest", "select doc_id, text from info where route='youtube' and text is not null and doc_id not in (select doc_id from cap)"),
        sql.cte("marked", f"select doc_id, text as t from rest where {marked}"),
        sql.cte("plain", f"select doc_id, text from rest where not ({marked})"),
        sql.cte("lsegs", lsegs),
        sql.cte("ltext", "select doc_id, text from info where route='loom' and doc_id%9=0 and text is not null"),
        sql.fold("capsegs", "doc_id", p="yc"),
        sql.inline("marked", "doc_id"),
        sql.windows("plain", "doc_id", p="yw"),
        *loom,
        sql.cte(
            "chunks",
            """select i.company, i.video_url, i.title, i.route, i.language, i.doc_id, i.text as transcription,
                i.company||'_'||i.video_url||'_'||k.chunk_index as id, k.chunk_index, k.text, k.start, k."end"
              from info i join (
                select doc_id, chunk_index, text, start, "end" from yc_chunks
                union all select doc_id, chunk_index, text, start, "end" from i_chunks
                union all select doc_id, chunk_index, text, 0.0, 0.0 from yw_chunks
                union all select doc_id, chunk_index, text, start, "end" from lc_chunks
                """
            + "union all select doc_id, chunk_index, text, 0.0, 0.0 from lw_chunks) k using (doc_id)",
        ),
    ]


VECTOR_SQL = f""" select lower(company) as namespace, id, text, start, "end", title,
  {words_sql('transcription')} as word_count, language,
  case when route='loom' then 'loom_video' else 'youtube_gemini' end as source_type from chunks"""
REPORT_SQL = f""" select video_url, company as company_name, text is not null as success,
    case when text is not null then title end as title, coalesce(n, 0) as chunks_created,
    coalesce(n, 0) as vectors_stored, case when text is not null then {words_sql('text')} end as word_count,
    case when text is not null then method end as method,
    case when text is null then 'Unable to extract video transcription. The video may not have captions or may be private.' end as error
  from info left join (select doc_id, count(*) as n from chunks group by 1) using (doc_id)"""
VECTOR_COLUMNS = [
    "namespace", "id", "metadata.text", "metadata.start", "metadata.end", "metadata.title",
    "metadata.word_count", "metadata.language", "metadata.source_type",
]
REPORT_COLUMNS = [
    "video_url", "company_name", "success", "title", "chunks_created", "vectors_stored",
    "word_count", "method", "error",
]


@query("q1_ingest", sql.with_ctes(*ingest_ctes(ing.STANDARD)) + VECTOR_SQL)
def q1(spark, sf):
    return ingested(spark, sf).vectors.select(*VECTOR_COLUMNS)


@query("q1_ingest_report", sql.with_ctes(*ingest_ctes(ing.STANDARD)) + REPORT_SQL)
def q1_report(spark, sf):
    return ingested(spark, sf).report.select(*REPORT_COLUMNS)


@query("q2_ingest_fixed30", sql.with_ctes(*ingest_ctes(ing.FIXED30)) + VECTOR_SQL)
def q2(spark, sf):
    return ingested(spark, sf, ing.FIXED30).vectors.select(*VECTOR_COLUMNS)


def found_ctes(k: int) -> list[str]:
    """CTE ``found``: best ``k`` chunks per question by hashed embeddings."""
    return [
        sql.cte("asked", inp.QUESTIONS),
        sql.hashed("chunks", "id", p="cv"),
        sql.hashed("asked", "question_id", "question", p="qv"),
        sql.cte(
            "dots",
            """select q.question_id, c.id, sum(qv.v * cv.v) / (any_value(qv.nn) * any_value(cv.nn)) as s
              from asked q join chunks c on c.company = q.company_name
              join qv_vec qv on qv.question_id = q.question_id
              join cv_vec cv on cv.id = c.id and cv.b = qv.b group by all""",
        ),
        sql.cte(
            "found",
            f"""select q.question_id, q.company_name, q.question, c.*, round(coalesce(s, 0.0), 6) as score,
                (row_number() over (partition by q.question_id
                  order by round(coalesce(s, 0.0), 6) desc, c.id))::int as rank
              from asked q join chunks c on c.company = q.company_name
              left join dots d on d.question_id = q.question_id and d.id = c.id
              qualify rank <= {k}""",
        ),
    ]


@query(
    "q3_search",
    sql.with_ctes(*ingest_ctes(ing.STANDARD), *found_ctes(5))
    + " select question_id, rank, id, score, text, video_url, title, chunk_index from found",
)
def q3(spark, sf):
    vectors = stored_vectors(spark, sf)
    return questions.search(inp.questions(spark, sf), vectors, hashing_embedder(DIM), DIM, digits=6)


def refusing(when, reply):
    """A stand-in model that fails for a whole batch when it holds a text it refuses."""

    def factory():
        def run(texts):
            if any(when(t) for t in texts):
                raise ValueError("no")
            return [reply(t) for t in texts]

        return run

    return factory


length_reranker = refusing(lambda p: len(p) % 11 == 3, lambda p: f"Chunk {len(p) % 8}")
length_answerer = refusing(lambda p: len(p) % 13 == 5, lambda p: f"- chars: {len(p)} [source](x)\n1. done")
length_summarizer = refusing(lambda p: len(p) % 7 == 3, lambda p: f"  {len(p)} chars\n")


def question_embedder():
    inner = hashing_embedder(DIM)()

    def run(texts):
        if any(t.startswith("refuse ") for t in texts):
            raise ValueError("no")
        return inner(texts)

    return run


SNIPPET = ans.SNIPPET_SQL
CLEANED = f"""substr({inp.trim_sql("replace(replace(text, chr(10), ' '), '  ', ' ')")}, 1, 500)"""
SYSTEM_CHARS = len(ans.an.SYSTEM_OPENING) + len(ans.an.SYSTEM_PROMPT)
ASK_SQL = f"""
prompts as (
  select question_id, count(*) as cnt,
    length('Question: '||any_value(question)||chr(10)||chr(10)||'Here are the chunks:'||chr(10)
      ||string_agg(rank||'. [video] '||chr(10)||{SNIPPET}||chr(10)||chr(10), '' order by rank)
      ||'{ans.an.RERANK_CLOSING}') as asked_chars,
    {SYSTEM_CHARS} + length(any_value(company_name)) + 2 + length('Video Content:'||chr(10)
      ||string_agg('Video Content: '||{CLEANED}, chr(10)||chr(10) order by rank)
      ||chr(10)||chr(10)||'Question: '||any_value(question)||'{ans.an.ANSWER_CLOSING}') as chars,
    string_agg({label_sql('title', 'video_url')}, ' | ' order by rank) as sources,
    min(case when rank <= 3 and (start > 0 or "end" > 0) then start end) as s3,
    max(case when rank <= 3 and (start > 0 or "end" > 0) then "end" end) as e3
  from found group by question_id),
best as (
  select p.question_id, p.chars, p.sources, f.video_url,
    case when f.start = 0 and f."end" = 0 then coalesce(s3, 0.0) else f.start end as s1,
    case when f.start = 0 and f."end" = 0 then coalesce(e3, 0.0) else f."end" end as e1
  from prompts p join found f on f.question_id = p.question_id
    and f.rank = case when asked_chars % 11 <> 3 and asked_chars % 8 between 1 and cnt then asked_chars % 8 else 1 end)
select question_id, '• chars: '||chars||chr(10)||' '||chr(10)||'1. done' as answer, sources, video_url,
  round(case when e1 > s1 then greatest(0.0, s1-0.3) else s1 end, 6) as start,
  round(case when e1 > s1 then e1+0.3 else e1 end, 6) as "end", null as error from best where chars % 13 <> 5
union all select question_id, null, null, null, null, null, '{ans.an.ANSWER_FAILED}' from best where chars % 13 = 5
union all select 1000000 + question_id, '{ans.an.NOTHING_FOUND.replace("'", "''")}', '', null, null, null, null from asked
union all select 2000000 + question_id, null, null, null, null, null, '{ans.an.EMBEDDING_FAILED}' from asked"""


@query("q4_ask", sql.with_ctes(*ingest_ctes(ing.STANDARD), *found_ctes(6)) + "," + ASK_SQL)
def q4(spark, sf):
    """Questions to answers with stand-in models that reply by the length of the prompt and fail
    for some. Beside every question stand one of a company without videos and one that the
    embedding model refuses."""
    asked = inp.questions(spark, sf)
    asked = asked.unionByName(
        asked.selectExpr("1000000 + question_id as question_id", "'Nobody' as company_name", "question")
    ).unionByName(
        asked.selectExpr(
            "2000000 + question_id as question_id", "company_name", "concat('refuse ', question) as question"
        )
    )
    out = questions.ask(
        asked,
        stored_vectors(spark, sf),
        ans.registry(spark, sf),
        question_embedder,
        length_reranker,
        length_answerer,
        DIM,
        digits=6,
    )
    return out.select(
        "question_id",
        "answer",
        F.array_join("sources", " | ").alias("sources"),
        "video_url",
        F.round("start", 6).alias("start"),
        F.round("end", 6).alias("end"),
        "error",
    )


@query(
    "q5_summarize",
    f"""select session_id, coalesce(n%7 <> 3, false) as success, case when n%7 <> 3 then n||' chars' end as summary,
      company_name, buyer_name, qa_count,
      case when n%7 = 3 then '{ans.su.SUMMARY_FAILED}ValueError: no'
        when n is null then '{ans.su.SUMMARY_FAILED}{ans.su.NO_PAIRS}' end as error
      from (select *, {len(ans.su.SUMMARY_SYSTEM) + 2} + length({ans.PROMPT_SQL}) as n from ({ans.SESSIONS}))""",
)
def q5(spark, sf):
    """A model that refuses some prompts: those sessions fail, and not those beside them. Sessions
    without any answer fail too."""
    return questions.summarize(inp.mixed_pairs(spark, sf), length_summarizer)


@query(
    "q6_quality_report",
    sql.with_ctes(*ingest_ctes(ing.STANDARD))
    + f""" select company as company_name, n_videos, words, chars, coalesce(with_ts, 0) as with_ts,
        coalesce(total, 0) as total, round(avg_duration, 6) as avg_duration,
        round(avg_chars, 6) as avg_chars, coalesce(total, 0) as vector_count
      from (select company, count(*) as n_videos, sum({words_sql('text')})::bigint as words,
              sum(length(text))::bigint as chars from info where text is not null group by 1)
      left join (select company, count_if(start > 0 or "end" > 0)::bigint as with_ts, count(*) as total,
              avg("end" - start) as avg_duration, avg(length(text)) as avg_chars from chunks group by 1)
        using (company)""",
)
def q6(spark, sf):
    out = ingested(spark, sf)
    texts = out.prepared.where("transcription is not null").select(
        "company_name", "word_count", F.length("transcription").alias("n_chars")
    )
    report = quality.quality_report(out.chunks, texts)
    return report.withColumn("avg_duration", F.round("avg_duration", 6)).withColumn(
        "avg_chars", F.round("avg_chars", 6)
    )


# --- streams -----------------------------------------------------------------------------


def document_stream(spark, sf):
    """The table as a stream, whether it is one file or a folder of files."""
    schema = inp.documents(spark, sf).schema
    return read_transcript_stream(spark, f"{sf}/documents.parquet", schema)


@query(
    "t1_stream_ingest",
    sql.with_ctes(sql.windows("documents", "doc_id"))
    + """ select lower(source) as namespace, source||'_https://youtu.be/'||doc_id||'_'||chunk_index as id, w.text
          from w_chunks w join documents using (doc_id)""",
)
def t1(spark, sf):
    """Documents as a stream of transcripts; the result is the table it leaves."""
    work = scratch_dir(spark, "stream-ingest")
    stream = document_stream(spark, sf).selectExpr(
        "concat('https://youtu.be/', doc_id) as video_url", "source as company_name",
        "cast(null as string) as title", "text as transcription", "'Unknown' as duration",
        "lang as language", "cast(null as int) as word_count",
        f"cast(null as {SEGMENTS_TYPE}) as segments", "timestamp_seconds(1700000000 + doc_id) as run_ts",
    )
    job = stream_ingest(
        stream, f"{work}/store", f"{work}/checkpoint", hashing_embedder(DIM), DIM, available_now=True, buckets=2
    )
    job.awaitTermination()
    return read_vectors(spark, f"{work}/store").select("namespace", "id", "metadata.text")


@query("t1_stream_ingest_logs", ORACLES["t1_stream_ingest"])
def t1_logs(spark, sf):
    """The same documents, written as transcript logs and ingested from the folder as it is read."""
    work = scratch_dir(spark, "stream-ingest-logs")
    docs = inp.documents(spark, sf).selectExpr(
        "*", "concat('https://youtu.be/', doc_id) as video_url", "source as company_name", "'m' as method",
        "cast(null as string) as title", "'Unknown' as duration", "lang as language", "'' as summary",
        "text as transcription", "cast(null as int) as word_count",
    )
    name = tr.log_name(F.expr(tab.RUN_TS_SPARK), F.concat(F.lit("v"), F.col("doc_id")))
    tr.write_transcript_logs(docs.withColumn("file_name", name), f"{work}/logs")
    companies = docs.select("video_url", "company_name")
    job = stream_ingest(
        logged_transcripts(rd.stream_transcript_logs(spark, f"{work}/logs"), companies),
        f"{work}/store", f"{work}/checkpoint", hashing_embedder(DIM), DIM, available_now=True, buckets=2,
    )
    job.awaitTermination()
    return read_vectors(spark, f"{work}/store").select("namespace", "id", "metadata.text")


@query(
    "t2_stream_chunk_segments",
    sql.with_ctes(sql.cte("src", inp.SEG), sql.fold("src", "doc_id"))
    + """ select doc_id::varchar as video_url, 'chunk' as kind, chunk_index, text, start, "end" from f_chunks""",
)
def t2(spark, sf):
    """Lines of documents as live captions, which come shuffled over several triggers; equals the
    batch fold."""
    work = scratch_dir(spark, "live-chunks")
    lines = (
        inp.documents(spark, sf)
        .selectExpr("cast(doc_id as string) as video_url", "split(text, '\n') as lines")
        .select("video_url", F.size("lines").alias("n"), F.posexplode("lines").alias("p", "text"))
        .selectExpr(
            "video_url", "cast(p as bigint) as seg_idx", "text", "p*5.5D as start", "(p+1)*5.5D as end",
            "p = n - 1 as is_last", "timestamp_seconds(1700000000 + p) as event_ts",
        )
    )
    lines.repartition(3, F.xxhash64("video_url", "seg_idx")).write.parquet(f"{work}/lines")
    arriving = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(f"{work}/lines")
    with rocksdb_state(spark):
        job = (
            chunk_live_segments(arriving, watermark="1 day")
            .writeStream.format("parquet")
            .option("path", f"{work}/chunks")
            .option("checkpointLocation", f"{work}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        job.awaitTermination()
    return spark.read.parquet(f"{work}/chunks")


