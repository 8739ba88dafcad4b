"""Similarity search over the embedding table: every vector asks its own namespace."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkmill.operators import block_search as bs
from talkmill.operators import retrieval as rt
from talkmill.queries import inputs as inp
from talkmill.queries.registry import query
from talkmill.schemas import METADATA
from talkmill.session import scratch_dir


# Components of the stored vectors, and the decimals to which both engines compare scores.
DIM, DIGITS = 64, 6


def topk_sql(k: int, scoped: bool = True) -> str:
    on = "q.namespace = v.namespace" if scoped else "true"
    return f"""select q.id as question_id, v.id, v.namespace,
        round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) as score,
        (row_number() over (partition by q.id order by
          round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) desc, v.id))::int as rank
      from ({inp.VECTORS}) q join ({inp.VECTORS}) v on {on} qualify rank <= {k}"""


def asked(spark, sf):
    return inp.vectors(spark, sf).withColumnRenamed("id", "question_id")


@query(
    "j1_similarity_join",
    f"select question_id, rank, id, score from ({topk_sql(6)})",
)
def j1(spark, sf):
    return rt.similarity_topk(asked(spark, sf), inp.vectors(spark, sf), 6, dim=DIM, digits=DIGITS)


@query(
    "j1_similarity_join_large",
    f"select question_id, rank, id, score from ({topk_sql(6)})",
)
def j1_large(spark, sf):
    """The way taken when the questions are too many to travel with the tasks at once."""
    return rt.similarity_topk(
        asked(spark, sf),
        inp.vectors(spark, sf),
        6,
        dim=DIM,
        digits=DIGITS,
        slice_bytes=DIM * 8 * 4_000,
    )


@query(
    "j2_similarity_join_unscoped",
    f"""select question_id, rank, t.id, score from ({topk_sql(6, scoped=False)}) t
        join ({inp.VECTORS}) q on q.id = t.question_id where t.namespace = q.namespace""",
)
def j2(spark, sf):
    """Best six of all vectors first; then only those of the asking company remain."""
    questions = asked(spark, sf).withColumn("company_name", F.upper("namespace"))
    stored = inp.vectors(spark, sf).withColumn("company", F.col("namespace"))
    return rt.similarity_topk_unscoped(questions, stored, 6, dim=DIM, digits=DIGITS).select(
        "question_id", "rank", "id", "score"
    )


def stored_blocks(spark, sf):
    stored, path = inp.vectors(spark, sf), scratch_dir(spark, "blocks")
    bs.write_blocks(stored, path, DIM)
    return bs.read_blocks(spark, path, stored.schema["id"].dataType.simpleString())


@query(
    "j1_block_search",
    f"select question_id, rank, id, score from ({topk_sql(6)})",
)
def j1_blocks(spark, sf):
    """The same over blocks that know their centre and radius."""
    found = bs.search_blocks(asked(spark, sf), stored_blocks(spark, sf), 6, dim=DIM, digits=DIGITS)
    return found.select("question_id", "rank", "id", "score")


@query(
    "j2_block_search_unscoped",
    f"""select question_id, rank, t.id, score from ({topk_sql(6, scoped=False)}) t
        join ({inp.VECTORS}) q on q.id = t.question_id where t.namespace = q.namespace""",
)
def j2_blocks(spark, sf):
    """Best six of all blocks first; then only those of the asking namespace remain."""
    found = bs.search_blocks(asked(spark, sf), stored_blocks(spark, sf), 6, "global", DIM, DIGITS)
    own = asked(spark, sf).select("question_id", "namespace")
    return found.join(own, ["question_id", "namespace"]).select("question_id", "rank", "id", "score")


@query(
    "w1_topk_per_question",
    """select user_id as question_id, event_id as id, value as score,
        (row_number() over (partition by user_id order by value desc, event_id))::int as rank
      from events qualify rank <= 6""",
)
def w1(spark, sf):
    scored = inp.table(spark, sf, "events").selectExpr(
        "user_id as question_id", "event_id as id", "value as score"
    )
    return rt.topk_per_question(scored, 6)


def stored_with_metadata(spark, sf):
    names = {
        "company": "namespace",
        "video_url": "case id%4 when 0 then null else concat('https://youtu.be/', id) end",
        "chunk_index": "case id%5 when 0 then null else cast(id as int) end",
        "text": "case id%3 when 0 then null else concat('text ', id) end",
        "title": "case id%2 when 0 then concat('Title ', id) end",
        "start": "cast(id as double)",
    }
    fields = [f.split(":") for f in METADATA[len("struct<") : -1].split(",")]
    parts = [f"cast({names.get(n, 'null')} as {t}) as {n}" for n, t in fields]
    return inp.vectors(spark, sf).withColumn("metadata", F.expr(f"struct({', '.join(parts)})"))


@query(
    "p13_search_result_projection",
    f"""select question_id, rank, id, score,
        case when id%3 = 0 then '' else 'text '||id end as text,
        case when id%4 = 0 then '' else 'https://youtu.be/'||id end as video_url,
        case when id%2 = 0 then 'Title '||id else '' end as title,
        case when id%5 = 0 then 0 else id end::int as chunk_index from ({topk_sql(5)})""",
)
def p13(spark, sf):
    found = rt.similarity_topk(asked(spark, sf), stored_with_metadata(spark, sf), 5, ("metadata",), dim=DIM, digits=DIGITS)
    return rt.search_results(found)


@query(
    "p14_match_debug_projection",
    f"""select question_id, rank, id, score, 'company'
        || case when id%4 <> 0 then ',video_url' else '' end
        || case when id%5 <> 0 then ',chunk_index' else '' end
        || case when id%3 <> 0 then ',text' else '' end || ',start'
        || case when id%2 = 0 then ',title' else '' end as metadata_keys,
        count(*) over (partition by question_id) as chunks_count from ({topk_sql(6)})""",
)
def p14(spark, sf):
    found = rt.similarity_topk(asked(spark, sf), stored_with_metadata(spark, sf), 6, ("metadata",), dim=DIM, digits=DIGITS)
    return rt.match_debug(found).withColumn("metadata_keys", F.array_join("metadata_keys", ","))
