"""Compare a registered query with its SQL twin."""

import datetime
import decimal
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _value(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    return v


SAME_TYPE = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
    "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}


def compare(spark, con, name, fn, sql, sf_dir):
    """Problem text, or None when names, types and values agree."""
    df = fn(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted((tuple(_value(r[c]) for c in names) for r in df.collect()), key=repr)
    plan = df._jdf.queryExecution().executedPlan().toString()
    loops = [x for x in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF") if x in plan]
    if loops:
        return f"plan contains {loops}"
    rel = con.sql(sql)
    if sorted(rel.columns) != names:
        return f"columns {names} != {sorted(rel.columns)}"
    types = dict(zip(rel.columns, [str(x) for x in rel.types]))
    wrong = {c: (t, types[c]) for c, t in df.dtypes if SAME_TYPE.get(t, t) != types[c]}
    index = [rel.columns.index(c) for c in names]
    want = sorted((tuple(_value(r[i]) for i in index) for r in rel.fetchall()), key=repr)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; {_first(got, want, names)}"
    if got != want:
        bad = sum(a != b for a, b in zip(got, want))
        return f"{bad} of {len(got)} rows differ; {_first(got, want, names)}"
    if wrong:
        return f"types {wrong}"
    return None if got else "empty result"


def _first(got, want, names):
    extra, missing = set(map(repr, got)) - set(map(repr, want)), set(map(repr, want)) - set(map(repr, got))
    return f"{names} spark only {sorted(extra)[:2]} sql only {sorted(missing)[:2]}"[:900]
