"""Compare a Spark result with its SQL counterpart, row by row and type by type."""

import math

import duckdb
import pyarrow as pa

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def kind(t):
    if pa.types.is_integer(t):
        return "int"
    if pa.types.is_floating(t) or pa.types.is_decimal(t):
        return "float"
    if pa.types.is_string(t) or pa.types.is_large_string(t):
        return "string"
    return str(t)


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "as_tuple"):
        return round(float(v), 6)
    if isinstance(v, list):
        return tuple(norm(x) for x in v)
    return v


def rows(table, names):
    cols = [[norm(v) for v in table.column(n).to_pylist()] for n in names]
    return sorted(zip(*cols), key=repr)


def compare(df, con, sql):
    """Empty string when equal, else what differs."""
    got = df.toArrow()
    exp = con.execute(sql).to_arrow_table()
    if sorted(got.column_names) != sorted(exp.column_names):
        return f"columns {sorted(got.column_names)} != {sorted(exp.column_names)}", len(got)
    names = sorted(got.column_names)
    for n in names:
        a, b = got.schema.field(n).type, exp.schema.field(n).type
        if kind(a) != kind(b):
            return f"type of {n}: {a} != {b}", len(got)
    if len(got) != len(exp):
        return f"rows {len(got)} != {len(exp)}", len(got)
    a, b = rows(got, names), rows(exp, names)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, e.g. {names}: {bad[0]}"[:1500], len(got)
    return "", len(got)
