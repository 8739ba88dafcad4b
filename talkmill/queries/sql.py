"""SQL text fragments (CTE bodies) of the chunking and retrieval operators.

They state each operator a second time, in another dialect and by another method
(recursion, joins), so that agreement means something.
"""

from __future__ import annotations

from talkmill.queries.inputs import WS_SQL, trim_sql


def windows(src: str, key: str, size: int = 1000, overlap: int = 200, p: str = "w") -> str:
    """CTEs ``{p}_chunks(key, chunk_index, text)`` over ``src(key, text)``; needs recursive."""
    back = f"strpos(reverse(translate(substr(t, pos+{size}-98, 100), '!?', '..')), '.')"
    cut = f"case when pos+{size} < n and back > 0 then pos+{size}+2-back else pos+{size} end"
    return f"""
{p}_step as (
  select {key}, t, n, pos, {cut} as e from (
    select *, {back} as back from (
      select {key}, text as t, length(text) as n, 0 as pos from {src} where length(text) > 0))
  union all
  select {key}, t, n, pos, {cut} as e from (
    select *, {back} as back from (
      select {key}, t, n, e-{overlap} as pos from {p}_step where e-{overlap} < n))),
{p}_chunks as (
  select {key}, (row_number() over (partition by {key} order by pos) - 1)::int as chunk_index, text
  from (select {key}, pos, {trim_sql('substr(t, pos+1, e-pos)')} as text from {p}_step)
  where text <> '')"""


def fold(
    src: str, key: str, size: int = 1000, cap: float = 60, compat: bool = True, p: str = "f"
) -> str:
    """CTEs ``{p}_chunks(key, chunk_index, text, start, end)`` over non-blank segment rows."""
    zero = f"case when st = 0 then {{e}} else st end" if compat else "st"
    closed = lambda ln, st, e: (
        f"({ln} >= {size} or {e} - ({zero.format(e=e).replace('st', st)}) >= {cap})"
    )
    return f"""
{p}_seg as (
  select {key}, row_number() over (partition by {key} order by seg_idx) - 1 as pos,
    {trim_sql('text')} as text, start as s0, "end" as e0
  from {src} where {trim_sql('text')} <> ''),
{p}_walk as (
  select {key}, pos, text, s0, e0, 0 as cid, length(text) as ln, s0 as sx,
    {closed('length(text)', 's0', 'e0')} as shut
  from {p}_seg where pos = 0
  union all
  select {key}, pos, text, s0, e0, cid, ln, sx, {closed('ln', 'sx', 'e0')} as shut from (
    select s.{key}, s.pos, s.text, s.s0, s.e0,
      case when w.shut then w.cid + 1 else w.cid end as cid,
      case when w.shut then length(s.text) else w.ln + 1 + length(s.text) end as ln,
      case when w.shut then s.s0 else w.sx end as sx
    from {p}_walk w join {p}_seg s on s.{key} = w.{key} and s.pos = w.pos + 1)),
{p}_chunks as (
  select {key}, cid::int as chunk_index, string_agg(text, ' ' order by pos) as text,
    greatest(0.0, min_by(s0, pos)) as start,
    greatest(min_by(s0, pos), max_by(e0, pos)) as "end"
  from {p}_walk group by {key}, cid)"""


def fold_fixed(src: str, key: str, duration: float = 30, p: str = "x") -> str:
    return f"""
{p}_seg as (
  select {key}, row_number() over (partition by {key} order by seg_idx) - 1 as pos,
    {trim_sql('text')} as text, start as s0, coalesce("end", 0.0) as e0
  from {src} where {trim_sql('text')} <> ''),
{p}_walk as (
  select {key}, pos, text, s0, e0, 0 as cid, s0 as sx from {p}_seg where pos = 0
  union all
  select s.{key}, s.pos, s.text, s.s0, s.e0,
    case when s.s0 - w.sx >= {duration} then w.cid + 1 else w.cid end,
    case when s.s0 - w.sx >= {duration} then s.s0 else w.sx end
  from {p}_walk w join {p}_seg s on s.{key} = w.{key} and s.pos = w.pos + 1),
{p}_chunks as (
  select {key}, cid::int as chunk_index, string_agg(text, ' ' order by pos) as text,
    min_by(s0, pos) as start, max_by(e0, pos) as "end"
  from {p}_walk group by {key}, cid)"""


P1 = rf"\[[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}\][{WS_SQL}]*[^\n]+"
P2 = rf"\[[0-9]{{2}}:[0-9]{{2}}\][{WS_SQL}]*[^\n]+"
P3 = rf"\[[0-9]+\][{WS_SQL}]*[^\n]+"


def inline(src: str, key: str, text: str = "t", p: str = "i") -> str:
    """CTEs ``{p}_chunks(key, chunk_index, text, start, end)`` from inline timestamps."""
    return f"""
{p}_lines as (
  select {key}, unnest(hits) as line, generate_subscripts(hits, 1) - 1 as chunk_index
  from (select {key}, case
      when regexp_matches({text}, '{P1}') then regexp_extract_all({text}, '{P1}')
      when regexp_matches({text}, '{P2}') then regexp_extract_all({text}, '{P2}')
      when regexp_matches({text}, '{P3}') then regexp_extract_all({text}, '{P3}')
      else [] end as hits from {src})),
{p}_parts as (
  select {key}, chunk_index,
    string_split(regexp_extract(line, '^\\[([0-9:]+)\\]', 1), ':') as clock,
    regexp_replace(line, '^\\[[0-9:]+\\]', '') as said
  from {p}_lines),
{p}_timed as (
  select {key}, chunk_index, said, case len(clock)
      when 3 then clock[1]::int * 3600 + clock[2]::int * 60 + clock[3]::int
      when 2 then clock[1]::int * 60 + clock[2]::int else clock[1]::int end as sec
  from {p}_parts),
{p}_chunks as (
  select {key}, chunk_index::int as chunk_index, {trim_sql('said')} as text,
    sec::double as start,
    coalesce(lead(sec) over (partition by {key} order by chunk_index),
      sec + least(greatest(length(l{trim_sql('said')}) // 15, 3), 20))::double as "end"
  from {p}_timed)"""


def hashed(src: str, key: str, text: str = "text", dim: int = 64, p: str = "h") -> str:
    """CTE ``{p}_vec(key..., b, v, nn)``: sparse float32 embedding and its norm."""
    return f"""
{p}_tok as (
  select {key}, unnest(regexp_extract_all(lower({text}), '[^{WS_SQL}]+')) as tok from {src}),
{p}_cnt as (
  select {key}, ('0x'||substr(md5(tok), 1, 8))::bigint % {dim} as b, count(*) as c
  from {p}_tok group by all),
{p}_val as (
  select {key}, b, (c / sqrt(sum(c*c) over (partition by {key})))::float::double as v from {p}_cnt),
{p}_vec as (
  select {key}, b, v, sqrt(sum(v*v) over (partition by {key})) as nn from {p}_val)"""



def with_ctes(*parts: str, recursive: bool = True) -> str:
    return ("with recursive " if recursive else "with ") + ",".join(parts)


def cte(name: str, body: str) -> str:
    return f"\n{name} as ({body})"
