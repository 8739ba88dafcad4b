"""Registered queries of the training-data operators, with SQL where it can state the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.llm import (
    decontaminate,
    language,
    licenses,
    mixing,
    packing,
    phrases,
    prefix_counts,
    resampling,
    simhash,
    token_files,
    toxicity,
    url_rules,
    vector_file,
)
from talkmill.llm.common import table
from talkmill.session import scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query()
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


@query(
    """
    with usable as (
      select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v
      from embeddings
      where embedding is not null and vec_id is not null
        and list_count(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
    q as (select vec_id as query_id, min(v) as qv from usable where vec_id % 100 = 0 group by vec_id),
    s as (
      select query_id, vec_id, cast(list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i] * qv[i])) as bigint) as score
      from q join usable u on u.vec_id <> q.query_id and len(u.v) = len(q.qv)),
    r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as "rank" from s)
    select query_id, "rank", vec_id, score from r where "rank" <= 10
    """
)
def op2_vector_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_file.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


@query()
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs, ~language.held_out())
    found = language.predict(docs, model)
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


@query(
    r"""
    with rules(rhost, rpath, rverdict) as (values
      ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
      ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
    u as (
      select page_id,
        translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path,
        row_number() over () as row_no
      from pages),
    m as (
      select u.*, rhost || rpath as rule, rverdict,
        row_number() over (partition by row_no order by length(rhost || rpath) desc nulls last, length(rhost) desc) as place
      from u left join rules
        on (u.host = rhost or ends_with(u.host, '.' || rhost)) and starts_with(u.path, rpath))
    select page_id, host, path, rule, coalesce(rverdict, 'allow') as verdict from m where place = 1
    """
)
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return url_rules.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


def token_file_query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    folder = scratch_dir(spark, "token-files")
    token_files.write(docs, public_tokenizers.path("word_bpe_49k.json"), folder, end_id=2)
    return token_files.read(spark, folder)


@query()
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_query(spark, table(spark, sf_dir, "documents"))


@query()
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")))
    return licenses.scan(table(spark, sf_dir, "documents"), place)


@query()
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"))


@query()
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_counts.answers(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024)


@query()
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out())
    found = toxicity.score(docs, model)
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


@query()
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


@query(
    r"""
    with w as (
      select coalesce(lang, 'und') as lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') as w
      from (select lang, unnest(regexp_split_to_array(
              translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[.,;:!?\n\x0B\x0C\r]')) as piece
            from documents)),
    g as (
      select lang, 1 as words, unnest(w) as phrase from w
      union all
      select lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from w
      union all
      select lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from w),
    f as (select lang, words, phrase, count(*) as f from g group by all having count(*) >= 10),
    size as (select lang, count(*) as n from g where words = 1 group by lang),
    c as (select lang, words, phrase, f as a, string_split(phrase, ' ') as p from f where words > 1),
    cut as (
      select lang, words, phrase, a, 1 as k, p[1] as head, array_to_string(p[2:], ' ') as tail from c
      union all
      select lang, words, phrase, a, 2, p[1] || ' ' || p[2], p[3] from c where words = 3),
    s as (
      select cut.*, h.f as l, t.f as r,
        cast((1000000 * cast(a as hugeint) * a) // (cast(h.f as hugeint) * t.f) as bigint) as score
      from cut join f h on h.lang = cut.lang and h.phrase = cut.head
               join f t on t.lang = cut.lang and t.phrase = cut.tail),
    low as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
    inner_pairs as (
      select lang, phrase, max(a) as longer from (
        select lang, p[1] || ' ' || p[2] as phrase, a from c where words = 3
        union all select lang, p[2] || ' ' || p[3], a from c where words = 3) group by all),
    kept as (
      select low.* from low left join inner_pairs i on i.lang = low.lang and i.phrase = low.phrase
      where i.longer is null or 100 * i.longer < 50 * low.a),
    ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as "rank" from kept)
    select lang, cast("rank" as bigint) as "rank", phrase, a, l, r, n, score
    from ranked join size using (lang) where "rank" <= 2000
    """
)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


@query()
def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
