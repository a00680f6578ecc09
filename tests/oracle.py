"""Holds a query against its SQL, run by DuckDB on the same files."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or isinstance(x, (str, bool)):
        return x
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, int):
        return x
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in sorted(x.items()))
    return str(x)


def kind(t: str) -> str:
    t = str(t).lower()
    for name, words in (("int", ("int", "long", "hugeint")), ("float", ("double", "float", "decimal")), ("text", ("string", "varchar")), ("time", ("timestamp",))):
        if any(t.startswith(w) or t.endswith(w) for w in words) and "[" not in t and "<" not in t:
            return name
    return "list" if "[" in t or "<" in t else t


def compare(spark, path, query, sql) -> str:
    df = query(spark, path)
    names = sorted(df.columns)
    got = Counter(tuple(plain(x) for x in r) for r in df.select(*names).collect())
    if sql is None:
        return "ok" if got else "no rows"
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    made = con.execute(sql)
    types = {c[0]: c[1] for c in made.description}
    if sorted(types) != names:
        return f"columns {names} and {sorted(types)}"
    order = [list(types).index(n) for n in names]
    want = Counter(tuple(plain(r[i]) for i in order) for r in made.fetchall())
    odd = {n: (t, str(types[n])) for n, t in df.dtypes if kind(t) != kind(str(types[n]))}
    if got != want:
        return f"rows {sum(got.values())} and {sum(want.values())}; only here {list((got - want).items())[:2]}; only in SQL {list((want - got).items())[:2]}"
    return f"types {odd}" if odd else "ok" if got else "no rows"
