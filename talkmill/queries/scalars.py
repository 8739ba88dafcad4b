"""Column-level operators: text, URL and vector functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkmill.functions import text as tx
from talkmill.functions import urls as ur
from talkmill.functions import vectors as ve
from talkmill.operators import answering
from talkmill.operators.reports import classify_error, validate_requests
from talkmill.operators.retrieval import company_filter
from talkmill.plans.ingest import video_info_defaults
from talkmill.queries import inputs as inp
from talkmill.queries.inputs import ANSWER_CASE_SPARK, ANSWER_CASE_SQL, trim_sql, words_sql
from talkmill.queries.registry import query


@query("f1_word_count", f"select doc_id, {words_sql('text')} as words from documents")
def f1(spark, sf):
    return inp.documents(spark, sf).select("doc_id", tx.word_count("text").alias("words"))


PADDED = "concat('\t\n ', text, '  　', chr(10))"


@query("f2_py_strip", f"select doc_id, {trim_sql(PADDED)} as stripped from documents")
def f2(spark, sf):
    return (
        inp.documents(spark, sf)
        .withColumn("padded", F.expr("concat('\t\n ', text, '  　', chr(10))"))
        .select("doc_id", tx.strip("padded").alias("stripped"))
    )


@query(
    "f3_snippet",
    f"select doc_id, replace({trim_sql('substr(text,1,500)')}, chr(10), ' ') as snippet from documents",
)
def f3(spark, sf):
    return inp.documents(spark, sf).select("doc_id", tx.snippet("text").alias("snippet"))


@query(
    "f4_preview",
    "select doc_id, replace(substr(text,1,120), chr(10), ' ') as p120, "
    "replace(substr(text,1,80), chr(10), ' ') as p80 from documents",
)
def f4(spark, sf):
    return inp.documents(spark, sf).select(
        "doc_id", tx.preview("text").alias("p120"), tx.preview("text", 80).alias("p80")
    )


UNFENCED = """select doc_id, company, case when contains(t, '```json') and j <> '' and json_valid(j)
    then coalesce(json_extract_string(j, '$.transcription'), t) else t end as u
  from (select *, regexp_extract(t, '(?s)\\{.*\\}') as j from (""" + inp.FENCED + "))"


@query("f5_unfence_json", f"select doc_id, u as unfenced from ({UNFENCED})")
def f5(spark, sf):
    return inp.fenced_texts(spark, sf).select("doc_id", tx.unfence_json("t").alias("unfenced"))


FLAT = trim_sql("replace(replace(u, chr(10), ' '), '  ', ' ')")


@query("f6_clean_chunk_text", f"select doc_id, substr({FLAT}, 1, 500) as cleaned from ({UNFENCED})")
def f6(spark, sf):
    return inp.fenced_texts(spark, sf).select("doc_id", tx.clean_chunk_text("t").alias("cleaned"))


RAW = f"select question_id, {ANSWER_CASE_SQL} as raw from (select doc_id as question_id from documents)"
STRIPPED_SOURCES = trim_sql(r"regexp_replace(raw, '\[source\]\([^)]+\)', '', 'g')")


def raw_answers(spark, sf):
    return inp.documents(spark, sf).selectExpr("doc_id as question_id", "text").selectExpr(
        "question_id", "text", f"{ANSWER_CASE_SPARK} as raw"
    )


@query("f7_strip_sources", f"select question_id, {STRIPPED_SOURCES} as stripped from ({RAW})")
def f7(spark, sf):
    return raw_answers(spark, sf).select("question_id", tx.strip_sources("raw").alias("stripped"))


def format_sql(expr: str) -> str:
    ws = inp.WS_SQL
    step1 = f"regexp_replace({expr}, '[{ws}]*[-•][{ws}]+', chr(10)||'• ', 'g')"
    step2 = f"regexp_replace({step1}, '([{ws}]*[0-9]+\\.[{ws}]+)', chr(10)||'\\1', 'g')"
    return trim_sql(f"regexp_replace({step2}, '\\n+', chr(10), 'g')")


@query(
    "f8_format_answer",
    f"select question_id, {format_sql('raw')} as answer, {format_sql('text')} as shown from "
    f"(select doc_id as question_id, text, {ANSWER_CASE_SQL.replace('question_id', 'doc_id')} as raw from documents)",
)
def f8(spark, sf):
    return raw_answers(spark, sf).select(
        "question_id", tx.format_answer("raw").alias("answer"), tx.format_answer("text").alias("shown")
    )


def label_sql(title: str, url: str) -> str:
    return f"""case when {title} <> '' and {title} <> 'Unknown' then {title}
      when {url} <> '' and (contains({url},'youtu.be') or contains({url},'youtube.com'))
        then 'YouTube Video ('||string_split(string_split({url},'?')[1],'/')[-1]||')'
      when {url} <> '' then 'Video ('||string_split({url},'/')[-1]||')' else 'Unknown' end"""


TITLE_CASE = "case page_id%4 when 0 then 'Unknown' when 1 then '' when 2 then concat('T ',page_id) end"


@query(
    "f9_source_label",
    f"select page_id, {label_sql('title', 'video_url')} as label "
    f"from (select *, {TITLE_CASE} as title from ({inp.URLS}))",
)
def f9(spark, sf):
    return (
        inp.video_urls(spark, sf)
        .withColumn("title", F.expr(TITLE_CASE))
        .select("page_id", tx.source_label("title", "video_url").alias("label"))
    )


SOURCE_CASE = """case page_id%4 when 0 then concat('v',page_id,'.mp4 [',page_id,'-',page_id+60,']')
  when 1 then concat('v',page_id,'.mp4') when 2 then concat('v',page_id,'.mp4[x]') end"""
SOURCES = f"select page_id, {SOURCE_CASE} as src from pages"


def sources(spark, sf):
    return inp.table(spark, sf, "pages").selectExpr("page_id", f"{SOURCE_CASE} as src")


@query(
    "f10_parse_source_span",
    rf"""select page_id, try_cast(nullif(regexp_extract(src,'\[(\d+)-(\d+)\]',1),'') as double) as start,
      try_cast(nullif(regexp_extract(src,'\[(\d+)-(\d+)\]',2),'') as double) as "end" from ({SOURCES})""",
)
def f10(spark, sf):
    return sources(spark, sf).select(
        "page_id", tx.span_start("src").alias("start"), tx.span_end("src").alias("end")
    )


@query(
    "f12_mmss",
    f"select doc_id, seg_idx, printf('%02d:%02d', floor(start/60)::int, floor(start)::int%60) as s, "
    f"printf('%02d:%02d', floor(\"end\"/60)::int, floor(\"end\")::int%60) as e from ({inp.SEG})",
)
def f12(spark, sf):
    return inp.segment_rows(spark, sf).select(
        "doc_id", "seg_idx", tx.mmss("start").alias("s"), tx.mmss("end").alias("e")
    )


@query("f13_basename", f"select page_id, string_split(video_url,'/')[-1] as name from ({inp.URLS})")
def f13(spark, sf):
    return inp.video_urls(spark, sf).select("page_id", tx.basename("video_url").alias("name"))


NAME_SQL = trim_sql("string_split(string_split(coalesce(src,''),' [')[1],'[')[1]")


@query("f14_source_name", f"select page_id, {NAME_SQL} as name from ({SOURCES})")
def f14(spark, sf):
    return sources(spark, sf).select("page_id", tx.source_name("src").alias("name"))


@query(
    "f15_cosine",
    """select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as score
      from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""",
)
def f15(spark, sf):
    """Every vector against its neighbour."""
    emb = inp.table(spark, sf, "embeddings")
    neighbour = emb.selectExpr("vec_id - 1 as vec_id", "embedding as other")
    return emb.join(neighbour, "vec_id").select(
        "vec_id", F.round(ve.cosine("embedding", "other"), 6).alias("score")
    )


# --- URLs, predicates, routing -----------------------------------------------------------

NETLOC_SQL = r"lower(regexp_extract(video_url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1))"


@query(
    "p1_route_source",
    "select page_id, case when contains(lower(video_url),'loom.com') then 'loom' else 'youtube' end "
    f"as route from ({inp.URLS})",
)
def p1(spark, sf):
    return inp.video_urls(spark, sf).select("page_id", ur.route_source("video_url").alias("route"))


@query(
    "p2_host_tests",
    f"select page_id, contains(h,'youtube.com') or contains(h,'youtu.be') as is_youtube, "
    f"contains(h,'loom.com') as is_loom from (select page_id, {NETLOC_SQL} as h from ({inp.URLS}))",
)
def p2(spark, sf):
    return inp.video_urls(spark, sf).select(
        "page_id",
        ur.is_youtube_host("video_url").alias("is_youtube"),
        ur.is_loom_host("video_url").alias("is_loom"),
    )


YT_SQL = r"nullif(regexp_extract(video_url,'(?:youtube\.com/watch\?v=|youtu\.be/)([a-zA-Z0-9_-]+)',1),'')"


@query("p3_youtube_video_id", f"select page_id, {YT_SQL} as video_id from ({inp.URLS})")
def p3(spark, sf):
    return inp.video_urls(spark, sf).select(
        "page_id", ur.youtube_video_id("video_url").alias("video_id")
    )


PARTS_SQL = (
    r"string_split(trim(regexp_extract(video_url, "
    r"'^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '/'), '/')"
)
LOOM_SQL = f"case when len({PARTS_SQL}) >= 2 then {PARTS_SQL}[-1] end"


@query("p4_loom_video_id", f"select page_id, {LOOM_SQL} as video_id from ({inp.URLS})")
def p4(spark, sf):
    return inp.video_urls(spark, sf).select("page_id", ur.loom_video_id("video_url").alias("video_id"))


@query(
    "p5_namespace_of",
    "select c_custkey, replace(lower(c_name||' Co '||c_mktsegment),' ','-') as namespace from customer",
)
def p5(spark, sf):
    return inp.table(spark, sf, "customer").select(
        "c_custkey",
        ur.namespace_of(F.concat("c_name", F.lit(" Co "), "c_mktsegment")).alias("namespace"),
    )


@query(
    "p6_vector_id",
    f"select doc_id, seg_idx, company||'_https://youtu.be/'||doc_id||'_'||seg_idx as id from ({inp.SEG})",
)
def p6(spark, sf):
    url = F.concat(F.lit("https://youtu.be/"), F.col("doc_id"))
    return inp.segment_rows(spark, sf).select(
        "doc_id", "seg_idx", ur.vector_id("company", url, "seg_idx").alias("id")
    )


ASKED_CASE = "case doc_id%3 when 0 then upper(source) when 1 then source else 'other' end"
STORED_CASE = "case doc_id%7 when 0 then null else source end"


@query(
    "p7_company_filter",
    f"""select doc_id from (select doc_id, {ASKED_CASE} as asked, {STORED_CASE} as stored from documents)
        where lower(coalesce(stored, '')) = lower(asked)""",
)
def p7(spark, sf):
    matches = inp.documents(spark, sf).selectExpr(
        "doc_id", f"{ASKED_CASE} as company_name", f"{STORED_CASE} as company"
    )
    return matches.where(company_filter("company_name", "company")).select("doc_id")


@query(
    "p8_require_nonempty",
    f"select doc_id, seg_idx, {trim_sql('text')} as text from ({inp.SEG}) where {trim_sql('text')} <> ''",
)
def p8(spark, sf):
    return (
        inp.segment_rows(spark, sf)
        .where(~tx.is_blank("text"))
        .select("doc_id", "seg_idx", tx.strip("text").alias("text"))
    )


REQUEST_CASE = "case page_id%5 when 0 then '' when 1 then null else url end"


@query(
    "p9_validate_requests",
    f"""select page_id, case when coalesce({REQUEST_CASE},'') = '' then 'video_url is required' end
        as reason from pages""",
)
def p9(spark, sf):
    requests = inp.table(spark, sf, "pages").selectExpr(
        "page_id", f"{REQUEST_CASE} as video_url", "'acme' as company_name"
    )
    return validate_requests(requests).select("page_id", "reason")


NO_INFO_SQL = " or ".join(
    "contains(lower(answer), '" + p.lower().replace("'", "''") + "')"
    for p in answering.NO_INFO_PHRASES
)


@query(
    "p10_is_no_info_answer",
    f"select question_id, ({NO_INFO_SQL}) as no_info from (select question_id, raw as answer from ({RAW}))",
)
def p10(spark, sf):
    return raw_answers(spark, sf).select(
        "question_id", answering.is_no_info_answer("raw").alias("no_info")
    )


ERROR_CASE = """case page_id%5 when 0 then concat('API request failed with status ', page_id)
  when 1 then 'Failed to extract transcription' when 2 then 'Read TimeOut of API'
  when 3 then 'timeout: API request failed' else concat('other ', page_id) end"""


@query(
    "p12_classify_error",
    f"""select page_id, case
      when contains(e,'API request failed') then
        'Transcription service temporarily unavailable. Please try again in a few minutes.'
      when contains(e,'Failed to extract transcription') then
        'Unable to extract video transcription. The video may not have captions or may be private.'
      when contains(lower(e),'timeout') then 'Request timed out. Please try again.'
      else e end as error from (select page_id, {ERROR_CASE} as e from pages)""",
)
def p12(spark, sf):
    return inp.table(spark, sf, "pages").select(
        "page_id", classify_error(F.expr(ERROR_CASE)).alias("error")
    )


def _hits(patterns, group):
    return [f"nullif(regexp_extract(html, '{p}', {g}), '')" for p, g in zip(patterns, group)]


MEDIA_HITS = _hits([p for p, _ in ur.MEDIA_PATTERNS], [g for _, g in ur.MEDIA_PATTERNS])
MEDIA_SQL = (
    "coalesce("
    + ", ".join(f"case when starts_with({h}, 'http') then {h} end" for h in MEDIA_HITS)
    + ", "
    + ", ".join(reversed(MEDIA_HITS))
    + ")"
)
TITLE_SQL = "coalesce(" + ", ".join(_hits(ur.TITLE_PATTERNS, [1, 1, 1])) + ")"


@query(
    "p15_page_media_extract",
    f"select page_id, {MEDIA_SQL} as media_url, coalesce({TITLE_SQL}, 'Unknown') as title "
    f"from ({inp.SHARES})",
)
def p15(spark, sf):
    return inp.share_pages(spark, sf).select(
        "page_id",
        ur.page_media_url("html").alias("media_url"),
        F.coalesce(ur.page_title("html"), F.lit("Unknown")).alias("title"),
    )


@query(
    "p16_video_info_defaults",
    f"""select page_id, video_url, {LOOM_SQL} as video_id,
      case when m is not null then coalesce(ti,'Unknown') else 'Loom Video - '||{LOOM_SQL} end as title,
      0.0::double as duration, coalesce(m, video_url) as media_url
      from (select page_id, video_url, {MEDIA_SQL} as m, {TITLE_SQL} as ti
            from (select page_id, url as video_url, html from ({inp.SHARES.replace('select page_id,', 'select page_id, url,', 1)})))""",
)
def p16(spark, sf):
    pages = inp.table(spark, sf, "pages").selectExpr("page_id", "url", f"{inp.SHARE_CASE} as html")
    requests = pages.selectExpr("page_id", "url as video_url")
    return video_info_defaults(requests, pages)
