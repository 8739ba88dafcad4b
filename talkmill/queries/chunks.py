"""Transcript, segment and chunk operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkmill.functions import timing as ti
from talkmill.functions.text import strip
from talkmill.operators import chunking as ch
from talkmill.operators import text_rows as tx
from talkmill.operators.segment_rows import chunk_rows, chunk_rows_fixed, lead_start
from talkmill.queries import inputs as inp
from talkmill.queries import sql
from talkmill.queries.inputs import trim_sql, words_sql
from talkmill.queries.registry import query

CHUNK_COLUMNS = 'doc_id, chunk_index, text, start, "end"'


@query(
    "c1_parse_inline_timestamps",
    sql.with_ctes(sql.cte("src", inp.TIMED), sql.inline("src", "doc_id"), recursive=False)
    + f" select {CHUNK_COLUMNS} from i_chunks",
)
def c1(spark, sf):
    return ch.explode_chunks(inp.timed_texts(spark, sf), ti.parse_inline_timestamps("t"), "doc_id")


@query(
    "c2_clock_to_seconds",
    f"""select doc_id, seg_idx, seg_idx*7 as hms, seg_idx*7%3600 as ms, seg_idx*7 as s
        from (select doc_id, seg_idx::bigint as seg_idx from ({inp.SEG}))""",
)
def c2(spark, sf):
    clock = F.expr(
        "format_string('%02d:%02d:%02d', seg_idx*7 div 3600, seg_idx*7 div 60 % 60, seg_idx*7 % 60)"
    )
    return (
        inp.segment_rows(spark, sf)
        .withColumn("seg_idx", F.col("seg_idx").cast("bigint"))
        .select(
            "doc_id",
            "seg_idx",
            ti.clock_to_seconds(clock).alias("hms"),
            ti.clock_to_seconds(F.substring(clock, -5, 5)).alias("ms"),
            ti.clock_to_seconds((F.col("seg_idx") * 7).cast("string")).alias("s"),
        )
    )


# Segments with missing, reversed and negative times, by position.
ROUGH_START = "case when seg_idx%7=3 then -2.0 else start end"
ROUGH_END = """case seg_idx%5 when 0 then start when 1 then null when 2 then start-1
    when 3 then start+45 else "end" end"""
ROUGH = f"""select doc_id, company, seg_idx, text, ({ROUGH_START})::double as start,
    ({ROUGH_END})::double as "end" from ({inp.SEG})"""


ROUGH_ARRAY = """transform(split(text,'\n'), (c,p) -> struct(c as text,
  cast(case when p%7=3 then -2.0 else p*5.5 end as double) as start,
  cast(case p%5 when 0 then p*5.5 when 1 then null when 2 then p*5.5-1 when 3 then p*5.5+45
    else (p+1)*5.5 end as double) as end))"""


def rough_segments(spark, sf):
    return (
        inp.documents(spark, sf)
        .selectExpr("doc_id", "source as company", f"posexplode({ROUGH_ARRAY}) as (seg_idx, s)")
        .select("doc_id", "company", "seg_idx", "s.text", "s.start", "s.end")
    )


TRIMMED = trim_sql("text")
FILLED = f"""select doc_id, seg_idx, {TRIMMED} as text, start,
    case when "end" > start then "end"
      else start + greatest({words_sql('text')} * 0.5, 1.0) end as "end" from ({ROUGH})"""


@query("c3_fill_segment_end", FILLED)
def c3(spark, sf):
    return rough_segments(spark, sf).select(
        "doc_id",
        "seg_idx",
        strip("text").alias("text"),
        "start",
        ti.fill_end("text", "start", "end").alias("end"),
    )


VALID = f"""select doc_id, seg_idx, text, s as start,
    case when e - s > 30 then s + 30 else e end as "end"
  from (select *, case when "end" > s then "end"
            else s + greatest({words_sql('text')} * 0.4, 0.5) end as e
        from (select *, greatest(start, 0.0) as s from ({FILLED}) where text <> ''))"""


@query("c4_validate_segments", VALID)
def c4(spark, sf):
    """Repair, then validation, as the recognised speech path applies them."""
    from talkmill.operators.segment_rows import validate_rows

    filled = rough_segments(spark, sf).withColumn("end", ti.fill_end("text", "start", "end"))
    return validate_rows(filled).select("doc_id", "seg_idx", "text", "start", "end")


@query(
    "c5_chunk_segments",
    sql.with_ctes(sql.cte("src", inp.SEG), sql.fold("src", "doc_id"))
    + f" select {CHUNK_COLUMNS} from f_chunks",
)
def c5(spark, sf):
    return chunk_rows(inp.segment_rows(spark, sf), ["doc_id"])


@query(
    "c5_chunk_segments_loom",
    sql.with_ctes(sql.cte("src", VALID), sql.fold("src", "doc_id", 600, 30))
    + f" select {CHUNK_COLUMNS} from f_chunks",
)
def c5_loom(spark, sf):
    """The same operator with smaller limits, on repaired segments."""
    from talkmill.operators.segment_rows import validate_rows

    filled = rough_segments(spark, sf).withColumn("end", ti.fill_end("text", "start", "end"))
    return chunk_rows(validate_rows(filled), ["doc_id"], ch.LOOM_CHUNK_SIZE, ch.LOOM_MAX_DURATION)


@query(
    "c6_chunk_segments_fixed",
    sql.with_ctes(sql.cte("src", inp.SEG), sql.fold_fixed("src", "doc_id"))
    + f" select {CHUNK_COLUMNS} from x_chunks",
)
def c6(spark, sf):
    return chunk_rows_fixed(inp.segment_rows(spark, sf), ["doc_id"])


@query(
    "c7_chunk_text",
    sql.with_ctes(sql.windows("documents", "doc_id"))
    + ' select doc_id, chunk_index, text, 0.0::double as start, 0.0::double as "end" from w_chunks',
)
def c7(spark, sf):
    return ch.explode_chunks(inp.documents(spark, sf), ch.chunk_text("text"), "doc_id")


@query(
    "c7_chunk_text_small",
    sql.with_ctes(sql.windows("documents", "doc_id", 500, 50))
    + ' select doc_id, chunk_index, text, 0.0::double as start, 0.0::double as "end" from w_chunks',
)
def c7_small(spark, sf):
    chunks = ch.chunk_text("text", ch.FIXED_CHUNK_SIZE, ch.FIXED_OVERLAP)
    return ch.explode_chunks(inp.documents(spark, sf), chunks, "doc_id")


@query(
    "c7_chunk_text_rows",
    sql.with_ctes(sql.windows("documents", "doc_id")) + " select doc_id, chunk_index, text from w_chunks",
)
def c7_rows(spark, sf):
    """The same windows where texts of more than 10,000 characters are cut block by block."""
    return tx.chunk_text_rows(inp.documents(spark, sf), "doc_id", long_text=10_000, block_chars=4_096)


# A third of the videos has segments, the others inline timestamps or plain text.
MIXED_SPARK = "doc_id % 3 = 0"


@query(
    "c8_choose_chunker",
    sql.with_ctes(
        sql.cte("timed", inp.TIMED),
        sql.cte("segs", f"select * from ({inp.SEG}) where doc_id % 3 = 0"),
        sql.cte("rest", "select doc_id, t from timed where doc_id % 3 <> 0"),
        sql.cte("plain", "select doc_id, t as text from rest where doc_id % 4 = 3"),
        sql.cte("marked", "select doc_id, t from rest where doc_id % 4 <> 3"),
        sql.fold("segs", "doc_id"),
        sql.inline("marked", "doc_id"),
        sql.windows("plain", "doc_id"),
    )
    + f""" select {CHUNK_COLUMNS} from f_chunks union all select {CHUNK_COLUMNS} from i_chunks
      union all select doc_id, chunk_index, text, 0.0, 0.0 from w_chunks""",
)
def c8(spark, sf):
    timed = inp.timed_texts(spark, sf)
    segs = inp.segment_arrays(spark, sf).select("doc_id", "segments")
    mixed = timed.join(segs, "doc_id").withColumn(
        "segments", F.when(F.expr(MIXED_SPARK), F.col("segments"))
    )
    return ch.explode_chunks(mixed, ch.choose_chunks("t", "segments"), "doc_id")


@query(
    "c10_chunk_index",
    sql.with_ctes(sql.windows("documents", "doc_id"))
    + " select doc_id, max(chunk_index) as last_index, count(*) as n_chunks,"
    " sum(chunk_index)::bigint as index_sum from w_chunks group by doc_id",
)
def c10(spark, sf):
    return (
        c7(spark, sf)
        .groupBy("doc_id")
        .agg(
            F.max("chunk_index").alias("last_index"),
            F.count("*").alias("n_chunks"),
            F.sum("chunk_index").alias("index_sum"),
        )
    )


@query(
    "w2_lead_start",
    f"""select doc_id, seg_idx, start,
      coalesce(lead(start) over (partition by doc_id order by seg_idx),
        start + least(greatest(length(text)//15, 3), 20)) as "end" from ({inp.SEG})""",
)
def w2(spark, sf):
    guess = F.least(F.greatest(F.floor(F.length("text") / 15), F.lit(3)), F.lit(20))
    return lead_start(inp.segment_rows(spark, sf), ["doc_id"]).select(
        "doc_id", "seg_idx", "start", F.coalesce("next_start", F.col("start") + guess).alias("end")
    )
