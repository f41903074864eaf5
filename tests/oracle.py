"""Run queries next to their SQL: ``python -m tests.oracle <sf> [names...]``."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

ROOT = "/root/testdata"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(out, key=repr)


def kind(name: str) -> str:
    name = name.upper()
    if "INT" in name or "LONG" in name or "SHORT" in name:
        return {"HUGEINT": "HUGEINT"}.get(name, "BIGINT" if name in ("BIGINT", "LONG") else "INT")
    return {"VARCHAR": "STRING", "FLOAT": "FLOAT"}.get(name, name)


def compare(df, con, sql):
    """Empty text when equal, otherwise what differs."""
    got = df.collect()
    cur = con.execute(sql)
    want_names = [d[0] for d in cur.description]
    want_types = {d[0]: kind(str(d[1])) for d in cur.description}
    want = cur.fetchall()
    g_names, g = rows_of(df.columns, got)
    w_names, w = rows_of(want_names, want)
    if g_names != w_names:
        return f"columns {g_names} != {w_names}"
    if len(g) != len(w):
        return f"{len(g)} rows != {len(w)}"
    if not g:
        return "no rows"
    types = {n: kind(t) for n, t in df.dtypes}
    off = [(n, types[n], want_types[n]) for n in types
           if types[n] != want_types[n] and not types[n].startswith(("ARRAY", "STRUCT", "DECIMAL"))]
    bad = [(a, b) for a, b in zip(g, w) if a != b]
    if bad:
        return f"{len(bad)} of {len(g)} rows differ, e.g. {bad[0][0]} != {bad[0][1]} ({g_names})"
    return f"types {off}" if off else ""


def main(argv):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = f"{ROOT}/{argv[0]}"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    oracles = entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if argv[1:] and name not in argv[1:]:
            continue
        start = time.time()
        try:
            if name in oracles:
                text = compare(fn(spark, sf), con, oracles[name])
            else:
                n = len(fn(spark, sf).collect())
                text = "" if n else "no rows"
                name += f" (rows only: {n})"
        except Exception as e:  # noqa: BLE001
            text = f"{type(e).__name__}: {str(e)[:900]}"
        failed += bool(text)
        print(f"{'FAIL' if text else 'ok  '} {time.time() - start:6.2f}s {name} {text}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
