"""Inputs derived from the driver tables, in Spark and in SQL. All of them use whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.functions.text import WHITESPACE

SEGMENT_SECONDS = 5.5


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark, sf):
    return table(spark, sf, "documents")


def segment_arrays(spark, sf):
    """Documents as videos whose lines are segments (the first one starts at 0)."""
    return documents(spark, sf).selectExpr(
        "doc_id",
        "source as company",
        "text",
        "transform(split(text,'\n'), (c,p) -> "
        "struct(c as text, p*5.5D as start, (p+1)*5.5D as end)) as segments",
    )


def segment_rows(spark, sf):
    return (
        segment_arrays(spark, sf)
        .select("doc_id", "company", F.posexplode("segments").alias("seg_idx", "s"))
        .select("doc_id", "company", "seg_idx", "s.text", "s.start", "s.end")
    )


SEG = """select doc_id, source as company, (p-1)::int as seg_idx, c as text,
    (p-1)*5.5::double as start, p*5.5::double as "end"
  from (select doc_id, source, unnest(string_split(text,chr(10))) c,
               generate_subscripts(string_split(text,chr(10)),1) p from documents)"""


TIMED_SPARK = """array_join(transform(split(text,'\n'), (c,p) -> concat(
  case doc_id%4
    when 0 then format_string('[%02d:%02d:%02d] ', p*7 div 3600, p*7 div 60 % 60, p*7%60)
    when 1 then format_string('[%02d:%02d] ', p*7 div 60, p*7%60)
    when 2 then format_string('[%d] ', p*7) else '' end, c)), '\n')"""


def timed_texts(spark, sf):
    """Documents whose lines carry one of four timestamp styles (the fourth is none)."""
    return documents(spark, sf).selectExpr("doc_id", f"{TIMED_SPARK} as t")


TIMED = """select doc_id, array_to_string(list_transform(string_split(text,chr(10)), lambda c,i: (
    case doc_id%4
      when 0 then printf('[%02d:%02d:%02d] ', (i-1)*7//3600, (i-1)*7//60%60, (i-1)*7%60)
      when 1 then printf('[%02d:%02d] ', (i-1)*7//60, (i-1)*7%60)
      when 2 then printf('[%d] ', (i-1)*7) else '' end) || c), chr(10)) as t
  from documents"""


def fenced_texts(spark, sf):
    """Fenced JSON, a broken fence, or plain text."""
    return documents(spark, sf).selectExpr(
        "doc_id",
        "source as company",
        """case when doc_id%3=0
              then concat('```json\n', to_json(struct(text as transcription)), '\n```')
            when doc_id%3=1 then concat('```json\n{oops ', text) else text end as t""",
    )


FENCED = """select doc_id, source as company, case when doc_id%3=0
      then '```json'||chr(10)||to_json({'transcription':text})::varchar||chr(10)||'```'
    when doc_id%3=1 then '```json'||chr(10)||'{oops '||text else text end as t
  from documents"""

URL_CASE = """case page_id%6
  when 0 then concat('https://youtu.be/vid_',page_id,'?si=x')
  when 1 then concat('https://www.youtube.com/watch?v=vid-',page_id)
  when 2 then concat('https://www.loom.com/share/',page_id,'a?sid=1')
  when 3 then concat('https://example.com/?next=LOOM.com/',page_id)
  when 4 then concat('https://loom.com/',page_id)
  else url end"""
URLS = f"select page_id, html, {URL_CASE} as video_url from pages"


def video_urls(spark, sf):
    """Page URLs turned into video URLs of six kinds."""
    return table(spark, sf, "pages").selectExpr("page_id", "html", f"{URL_CASE} as video_url")


# Pages get a media link of one of several kinds (or none), titles stay as they are.
SHARE_CASE = """concat(html, case page_id%6
  when 0 then concat('"videoUrl":"https://cdn.example.com/',page_id,'.mp4"')
  when 1 then concat('"videoUrl":"/rel/',page_id,'","video_url":"https://v.example.com/',page_id,'"')
  when 2 then concat('"url":"/a/',page_id,'.mp4?x=1","src":"b',page_id,'.mp4"')
  when 3 then concat('<a href=https://x.example.com/',page_id,'.mp4>')
  when 4 then concat('"title":"Demo ',page_id,'","name":"n"')
  else '' end)"""
SHARES = f"select page_id, ({URL_CASE}) as video_url, {SHARE_CASE} as html from pages"


def share_pages(spark, sf):
    return table(spark, sf, "pages").selectExpr(
        "page_id", f"{URL_CASE} as video_url", f"{SHARE_CASE} as html"
    )


def questions(spark, sf):
    """Benchmark texts as questions; the document of the same number names the company."""
    companies = documents(spark, sf).selectExpr("doc_id as item_id", "source as company_name")
    return (
        table(spark, sf, "benchmark")
        .join(companies, "item_id")
        .selectExpr("item_id as question_id", "company_name", "text as question")
    )


QUESTIONS = """select b.item_id as question_id, d.source as company_name, b.text as question
  from benchmark b join documents d on b.item_id = d.doc_id"""


def qa_pairs(spark, sf):
    """User turns followed by an assistant turn; some sessions name company and buyer."""
    turns = table(spark, sf, "conversations")
    answer = turns.selectExpr(
        "conv_id as session_id", "turn - 1 as turn", "role as next_role", "text as answer"
    )
    asked = turns.selectExpr("conv_id as session_id", "turn", "role", "text as question")
    return (
        asked.join(answer, ["session_id", "turn"])
        .where("role = 'user' and next_role = 'assistant'")
        .selectExpr(
            "session_id",
            "turn as seq",
            "question",
            "answer",
            "case session_id%3 when 0 then concat('Company ', session_id) when 1 then '' end"
            " as company_name",
            "case session_id%2 when 0 then concat('Buyer ', session_id) end as buyer_name",
        )
    )


QA = """select a.conv_id as session_id, a.turn as seq, a.text as question, b.text as answer,
    case a.conv_id%3 when 0 then concat('Company ', a.conv_id) when 1 then '' end as company_name,
    case a.conv_id%2 when 0 then concat('Buyer ', a.conv_id) end as buyer_name
  from conversations a join conversations b
    on a.conv_id = b.conv_id and b.turn = a.turn + 1
  where a.role = 'user' and b.role = 'assistant'"""

# Pairs as they come from a form: names stand beside some pairs only, some answers are missing, and
# of some sessions all.
def mixed_pairs(spark, sf):
    return qa_pairs(spark, sf).selectExpr(
        "session_id", "seq", "question",
        "case when session_id%11 <> 4 and (session_id + seq)%9 <> 2 then answer end as answer",
        "case when seq%3 = 0 then null when session_id%4 = 1 then concat(company_name, ' ', seq) else company_name end as company_name",
        "case when seq%4 <> 0 then buyer_name end as buyer_name",
    )


MIXED_QA = f"""select session_id, seq, question,
    case when session_id%11 <> 4 and (session_id + seq)%9 <> 2 then answer end as answer,
    case when seq%3 = 0 then null when session_id%4 = 1 then company_name||' '||seq else company_name end as company_name,
    case when seq%4 <> 0 then buyer_name end as buyer_name from ({QA})"""

# Replies of the rerank and answer models, one of five kinds per question.
RERANK_CASE = """case question_id%5 when 0 then 'Chunk 3 is best' when 1 then 'none'
  when 2 then '99' when 3 then '0' else '2 or 4' end"""
ANSWER_CASE = """case question_id%5
  when 0 then concat('- TL;DR: see ', question_id, ' [source](http://x) • two  - three')
  when 1 then 'Steps: 1. open 2. click\n\n\n3. done'
  when 2 then 'The provided content Doesn''t contain information about this.'
  when 3 then concat(' plain answer ', question_id, ' ')
  else 'a - b 10. c [source](y)\n- d' end"""
ANSWER_CASE_SQL = ANSWER_CASE.replace("\n\n\n", "'||chr(10)||chr(10)||chr(10)||'").replace(
    "(y)\n- d", "(y)'||chr(10)||'- d"
)
ANSWER_CASE_SPARK = ANSWER_CASE.replace("Doesn''t", "Doesn\\'t").replace("\n\n\n", "\\n\\n\\n").replace(
    "(y)\n- d", "(y)\\n- d"
)


def vectors(spark, sf):
    """The embedding table as stored vectors; the label is the namespace."""
    return table(spark, sf, "embeddings").selectExpr(
        "concat('label-', label) as namespace", "vec_id as id", "embedding"
    )


VECTORS = "select 'label-'||label as namespace, vec_id as id, embedding from embeddings"

# Blanks in a character class of the SQL side.
WS_SQL = (
    r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
BLANKS_SQL = "||".join(f"chr({ord(c)})" for c in WHITESPACE)


def trim_sql(expr: str) -> str:
    return f"trim({expr}, {BLANKS_SQL})"


def words_sql(expr: str) -> str:
    return f"len(regexp_extract_all({expr}, '[^{WS_SQL}]+'))::int"
