"""Answer assembly. Matches are derived from documents: seven in a row answer a question."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkmill.operators import answering as an
from talkmill.operators import summaries as su
from talkmill.queries import inputs as inp
from talkmill.queries.inputs import RERANK_CASE, trim_sql
from talkmill.queries.registry import query
from talkmill.queries.scalars import ANSWER_CASE_SPARK, ANSWER_CASE_SQL, NO_INFO_SQL, format_sql, label_sql

# The same text runs in both engines; "q" is the question, "d" the document.
FIELDS = {
    "company": "concat('Company ', q)",
    "video_url": """case d%5 when 0 then concat('https://youtu.be/v',d,'?si=1')
        when 1 then concat('https://www.youtube.com/watch?v=v',d)
        when 2 then concat('https://x.com/a/',d) when 3 then '' end""",
    "chunk_index": "cast(d%100 as int)",
    "text": "t",
    "start": "cast(case when q%3=0 or d%2=0 then 0 else d%90 + 0.25 end as double)",
    "end": "cast(case when q%3=0 or d%2=0 then 0 else d%90 + 0.25 + (d%3)*5 end as double)",
    "title": "case d%4 when 0 then 'Unknown' when 1 then concat('Title ',d) when 2 then '' end",
    "duration": "cast(null as double)",
    "language": "'en'",
    "word_count": "cast(null as int)",
    "source_type": "'youtube_gemini'",
    "source": """case d%3 when 0 then concat('vid_',d%250,'.mp4 [10-',20+d%5,']')
        when 1 then concat('file',d,'.mp4') end""",
    "original_video_url": "case when d%15=3 then concat('https://orig/',d) end",
    "type": "case when d%10=0 then 'pdf' end",
    "context": "case when d%10=0 then concat('ctx ',d) end",
}
SQL_FIELDS = ", ".join(f'{e} as "{n}"' for n, e in FIELDS.items())
MATCHES = f"""select q as question_id, (d%7+1)::int as rank, d as id, {SQL_FIELDS}
  from (select doc_id as d, doc_id//7 as q, t from ({inp.FENCED}))"""
# Questions with matches, and every benchmark item as a question without any.
ASKED = """select distinct doc_id//7 as question_id, 'Company '||(doc_id//7) as company_name,
    'What is '||(doc_id//7)||'?' as question from documents
  union all select 1000000000 + item_id, 'Nobody', text from benchmark"""


def matches(spark, sf):
    fields = ", ".join(f"{e} as `{n}`" for n, e in FIELDS.items())
    return (
        inp.fenced_texts(spark, sf)
        .selectExpr("doc_id as d", "doc_id div 7 as q", "t")
        .selectExpr(
            "q as question_id",
            "cast(d%7+1 as int) as rank",
            "d as id",
            "1.0D as score",
            f"struct({fields}) as metadata",
        )
    )


def asked(spark, sf):
    own = inp.documents(spark, sf).selectExpr("doc_id div 7 as question_id").distinct()
    return own.selectExpr(
        "question_id",
        "concat('Company ', question_id) as company_name",
        "concat('What is ', question_id, '?') as question",
    ).unionByName(
        inp.table(spark, sf, "benchmark").selectExpr(
            "1000000000 + item_id as question_id", "'Nobody' as company_name", "text as question"
        )
    )


def collected(spark, sf):
    return an.collect_matches(asked(spark, sf), matches(spark, sf))


SNIPPET_SQL = f"replace({trim_sql('substr(text,1,500)')}, chr(10), ' ')"
CLEAN_MATCHES = f"""select *, substr({trim_sql("replace(replace(u, chr(10), ' '), '  ', ' ')")}, 1, 500) as cleaned
  from (select *, case when contains(text, '```json') and j <> '' and json_valid(j)
      then coalesce(json_extract_string(j, '$.transcription'), text) else text end as u
    from (select *, regexp_extract(text, '(?s)\\{{.*\\}}') as j from ({MATCHES})))"""

SPAN = f"""select question_id, min(start) as start, max("end") as "end" from ({MATCHES})
  where rank <= 3 and (start > 0 or "end" > 0) group by question_id"""


@query("a5_span_of_candidates", f'select question_id, start, "end" from ({SPAN})')
def a5(spark, sf):
    span = an.span_of_candidates("chunks")
    return (
        collected(spark, sf)
        .select("question_id", span.alias("span"))
        .where("span is not null")
        .select("question_id", "span.start", "span.end")
    )


CONTEXT = f"""select question_id, string_agg('Video Content: '||cleaned, chr(10)||chr(10) order by rank) as context
  from ({CLEAN_MATCHES}) where rank <= 6 group by question_id"""


@query("a6_build_context", f"select question_id, context from ({ASKED}) left join ({CONTEXT}) using (question_id)")
def a6(spark, sf):
    return collected(spark, sf).select("question_id", an.build_context("chunks").alias("context"))


RERANK = f"""select question_id, 'Question: '||any_value(question)||chr(10)||chr(10)||'Here are the chunks:'||chr(10)
    ||string_agg(rank||'. ['||coalesce("type",'video')||'] '||coalesce("context",'')||chr(10)
        ||{SNIPPET_SQL}||chr(10)||chr(10), '' order by rank)
    ||'Which chunk is most relevant to the question above? Just give the number.' as prompt
  from ({MATCHES}) join ({ASKED}) using (question_id) group by question_id"""


@query("a7_build_rerank_prompt", RERANK)
def a7(spark, sf):
    return (
        collected(spark, sf)
        .where(an.n_chunks("chunks") > 0)
        .select("question_id", an.build_rerank_prompt("question", "chunks").alias("prompt"))
    )


QA_TEXT = """string_agg('Q: '||question||chr(10)||'A: '||answer, chr(10)||chr(10) order by seq)"""
SESSIONS = f"""select session_id,
    coalesce(arg_min(company_name, seq) filter (company_name <> ''), max(company_name)) as company_name,
    coalesce(arg_min(buyer_name, seq) filter (buyer_name <> ''), max(buyer_name)) as buyer_name,
    {QA_TEXT} filter (answer is not null) as qa_text, count(answer) as qa_count
  from ({inp.MIXED_QA}) group by session_id"""


@query("a8_format_qa_session", SESSIONS)
def a8(spark, sf):
    """Sessions with names beside some of their pairs, and some without any answer."""
    return su.format_qa_session(inp.mixed_pairs(spark, sf))


def _text(s: str) -> str:
    return "'" + s.replace("\n", "'||chr(10)||'") + "'"


PROMPT_SQL = "||".join(
    [
        _text(su.PROMPT_UP_TO_TEXT),
        "qa_text",
        _text(su.PROMPT_UP_TO_COMPANY),
        "coalesce(nullif(company_name,''),'Unknown')",
        _text(su.PROMPT_UP_TO_BUYER),
        "coalesce(nullif(buyer_name,''),'Unknown')",
        _text(su.PROMPT_END),
    ]
)


@query("a9_build_summary_prompt", f"select session_id, {PROMPT_SQL} as prompt from ({SESSIONS})")
def a9(spark, sf):
    return a8(spark, sf).select(
        "session_id",
        su.build_summary_prompt("qa_text", "company_name", "buyer_name").alias("prompt"),
    )


LABELS = f"""select question_id, string_agg({label_sql('title', 'video_url')}, ' | ' order by rank) as labels,
    count(*)::int as n from ({MATCHES}) group by question_id"""


@query("a11_source_list", LABELS)
def a11(spark, sf):
    return (
        collected(spark, sf)
        .where(an.n_chunks("chunks") > 0)
        .select("question_id", an.source_list("chunks").alias("s"))
        .select("question_id", F.array_join("s", " | ").alias("labels"), F.size("s").alias("n"))
    )


@query(
    "w3_take_first_n",
    f"""select question_id, string_agg(id::varchar, ',' order by rank) as first_three
        from ({MATCHES}) where rank <= 3 group by question_id""",
)
def w3(spark, sf):
    first = F.transform(an.take_first("chunks", 3), lambda c: c["id"].cast("string"))
    return (
        collected(spark, sf)
        .where(an.n_chunks("chunks") > 0)
        .select("question_id", F.array_join(first, ",").alias("first_three"))
    )


PICKED = f"""select question_id, case when n between 1 and cnt then n else 1 end::int as picked
  from (select question_id, count(*) as cnt,
          try_cast(nullif(regexp_extract({RERANK_CASE}, '[0-9]+'), '') as bigint) as n
        from ({MATCHES}) group by question_id)"""


@query("r1_pick_reranked", PICKED)
def r1(spark, sf):
    return (
        collected(spark, sf)
        .where(an.n_chunks("chunks") > 0)
        .select(
            "question_id",
            an.pick_reranked(F.expr(RERANK_CASE), an.n_chunks("chunks")).alias("picked"),
        )
    )


def registry(spark, sf):
    return inp.video_urls(spark, sf).selectExpr(
        "concat('vid_', page_id, '.mp4') as video_name", "video_url"
    )


NAME = trim_sql("string_split(string_split(coalesce(source,''),' [')[1],'[')[1]")
REGISTRY = f"select 'vid_'||page_id||'.mp4' as video_name, video_url from ({inp.URLS})"


def resolved_sql(entries: str) -> str:
    return f"""select m.*, coalesce(nullif(m.video_url,''), nullif(m.original_video_url,''),
      r.video_url, m.source) as resolved_url
  from (select *, {NAME} as nm from ({MATCHES})) m
  left join (select video_name, max(nullif(video_url,'')) as video_url from ({entries}) group by 1) r
    on r.video_name = m.nm"""


RESOLVED = resolved_sql(REGISTRY)
AGAIN = """select 'vid_'||page_id||'.mp4' as video_name, case page_id%3 when 0 then 'https://www.zz.example/'||page_id
  when 1 then 'ftp://old/'||page_id end as video_url from pages where page_id%2 = 0"""


@query("j3_resolve_video_url", f"select id, resolved_url from ({resolved_sql(f'{REGISTRY} union all {AGAIN}')})")
def j3(spark, sf):
    """Every match as if it were the best one of its question; half of the registry's names stand
    in it twice, some with an empty address."""
    best = matches(spark, sf).select("id", F.col("metadata").alias("best"))
    again = inp.table(spark, sf, "pages").where("page_id%2 = 0").selectExpr(
        "concat('vid_', page_id, '.mp4') as video_name",
        "case page_id%3 when 0 then concat('https://www.zz.example/', page_id) when 1 then concat('ftp://old/', page_id) end as video_url",
    )
    entries = registry(spark, sf).unionByName(again)
    return an.resolve_video_url(best, entries, "id").select("id", "resolved_url")


BUFFERED = """case when e1 > s1 then greatest(0.0, s1 - 0.3) else s1 end as start,
    case when e1 > s1 then e1 + 0.3 else e1 end as "end" """
LOCATED = f"""select *, {BUFFERED} from (
  select b.question_id, b.id, b.resolved_url,
    case when b.start = 0 and b."end" = 0 then coalesce(s.start,
      try_cast(nullif(regexp_extract(b.source,'\\[([0-9]+)-([0-9]+)\\]',1),'') as double), 0.0) else b.start end as s1,
    case when b.start = 0 and b."end" = 0 then coalesce(s."end",
      try_cast(nullif(regexp_extract(b.source,'\\[([0-9]+)-([0-9]+)\\]',2),'') as double), 0.0) else b."end" end as e1
  from ({RESOLVED}) b join ({PICKED}) p on p.question_id = b.question_id and p.picked = b.rank
  left join ({SPAN}) s on s.question_id = b.question_id)"""


def with_best(spark, sf):
    picked = an.pick_reranked(F.expr(RERANK_CASE), an.n_chunks("chunks"))
    return (
        collected(spark, sf)
        .where(an.n_chunks("chunks") > 0)
        .withColumn("best", F.get("chunks", picked - 1)["metadata"])
    )


@query("f11_playback_span", f'select question_id, round(start, 6) as start, round("end", 6) as "end" from ({LOCATED})')
def f11(spark, sf):
    span = an.playback_span(F.col("best"), "chunks")
    return (
        with_best(spark, sf)
        .select("question_id", span.alias("span"))
        .select(
            "question_id",
            F.round("span.start", 6).alias("start"),
            F.round("span.end", 6).alias("end"),
        )
    )


@query(
    "f16_render_answer_prompt",
    f"""select question_id, '{an.SYSTEM_OPENING}'||company_name||'{an.SYSTEM_PROMPT.replace("'", "''")}' as system_prompt,
      'Video Content:'||chr(10)||context||chr(10)||chr(10)||'Question: '||question||'{an.ANSWER_CLOSING}' as user_prompt
      from ({ASKED}) join ({CONTEXT}) using (question_id)""",
)
def f16(spark, sf):
    return (
        collected(spark, sf)
        .where(an.n_chunks("chunks") > 0)
        .withColumn("context", an.build_context("chunks"))
        .select(
            "question_id",
            an.system_prompt("company_name").alias("system_prompt"),
            an.user_prompt("context", "question").alias("user_prompt"),
        )
    )


ANSWERED = f"""select question_id, case when labels is null then '{an.NOTHING_FOUND.replace("'", "''")}' else answer end as answer,
    coalesce(labels, '') as sources,
    case when labels is not null and not ({NO_INFO_SQL}) then resolved_url end as video_url,
    case when labels is not null and not ({NO_INFO_SQL}) then round(start, 6) end as start,
    case when labels is not null and not ({NO_INFO_SQL}) then round("end", 6) end as "end"
  from (select question_id, {format_sql(trim_sql("regexp_replace(raw, '\\[source\\]\\([^)]+\\)', '', 'g')"))} as answer
        from (select question_id, {ANSWER_CASE_SQL} as raw from ({ASKED})))
  left join ({LABELS}) using (question_id) left join ({LOCATED}) using (question_id)"""


@query("q4_assemble_answers", ANSWERED)
def q4_assemble(spark, sf):
    """Everything behind the model replies, for questions with and without matches."""
    replied = collected(spark, sf).selectExpr(
        "*", f"{RERANK_CASE} as rerank_reply", f"{ANSWER_CASE_SPARK} as raw_answer"
    )
    out = an.assemble_answers(replied, registry(spark, sf))
    return out.select(
        "question_id",
        "answer",
        F.array_join("sources", " | ").alias("sources"),
        "video_url",
        F.round("start", 6).alias("start"),
        F.round("end", 6).alias("end"),
    )
