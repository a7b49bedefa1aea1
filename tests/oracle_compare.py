"""Run a registered query on Spark and its oracle SQL on DuckDB; compare results.

Comparison is order-insensitive: column names (sorted), row count, and the
multiset of rows with every value rendered canonically.
"""

from __future__ import annotations

import datetime as dt
import decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int,)):
        return str(v)
    if isinstance(v, decimal.Decimal):
        return format(v.quantize(decimal.Decimal("0.000001")), "f")
    if isinstance(v, float):
        return f"{v:.6f}"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{canon(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "date": "DATE",
                 "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "double": "DOUBLE"}


def type_mismatches(spark_schema, description) -> list:
    """Columns whose Spark type and DuckDB type differ (decimals compare by kind)."""
    sch = {f.name: f.dataType.simpleString() for f in spark_schema.fields}
    bad = []
    for name, typ in ((c[0], str(c[1])) for c in description):
        st = sch.get(name)
        if st is None or (st.startswith("decimal") and typ.startswith("DECIMAL")):
            continue
        if SPARK_TO_DUCK.get(st) != typ:
            bad.append((name, st, typ))
    return bad


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark, key: str, fn, sql: str, sf_dir: str, con=None) -> dict:
    sdf = fn(spark, sf_dir)
    s_names = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    con = con or duck(sf_dir)
    res = con.execute(sql)
    d_names = [c[0] for c in res.description]
    d_rows = res.fetchall()
    out = {"key": key, "spark_rows": len(s_rows), "oracle_rows": len(d_rows),
           "names_match": sorted(s_names) == sorted(d_names),
           "type_mismatches": type_mismatches(sdf.schema, res.description)}
    out["values_match"] = out["names_match"] and rows_of(s_names, s_rows) == rows_of(d_names, d_rows)
    if not out["names_match"]:
        out["spark_cols"] = sorted(s_names)
        out["oracle_cols"] = sorted(d_names)
    elif not out["values_match"]:
        a = rows_of(s_names, s_rows)
        b = rows_of(d_names, d_rows)
        sa, sb = set(a), set(b)
        out["only_spark"] = sorted(sa - sb)[:3]
        out["only_oracle"] = sorted(sb - sa)[:3]
    return out
