"""Runs registered queries on Spark and their SQL on DuckDB and compares schema, rows and values.

Usage: python tests/oracle_check.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(value):
    if value is None:
        return None
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0 if value != 0 else 0.0
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t0
    if sql is None:
        return ("rows-only" if got else "EMPTY"), took, len(got), ""
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    types = {d[0]: str(d[1]) for d in res.description}
    want = _rows(cols, res.fetchall())
    if sorted(cols) != sorted(df.columns):
        return "SCHEMA", took, len(got), f"{sorted(df.columns)} vs {sorted(cols)}"
    if len(got) != len(want):
        return "COUNT", took, len(got), f"{len(got)} vs {len(want)}"
    if got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        return "VALUES", took, len(got), f"{len(bad)} differ, columns {sorted(cols)}; first {bad[0]}"
    spark_types = dict(df.dtypes)
    pairs = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}
    odd = {c: (spark_types[c], types[c]) for c in cols if pairs.get(spark_types[c]) != types[c].upper().replace("STRING", "VARCHAR").replace("NUMBER", "BIGINT")}
    if not got:
        return "EMPTY", took, 0, ""
    return ("ok" if not odd else "ok-types"), took, len(got), odd or ""


def main(argv):
    from riskloom.session import build_session
    import __spark_entry__ as entry

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark = build_session(**{"spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    failed = 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            status, took, n, note = compare(spark, con, name, fn, entry.oracle_sql().get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001 - report and go on with the next query
            status, took, n, note = "ERROR", 0.0, 0, f"{type(exc).__name__}: {str(exc)[:1500]}"
        failed += status not in ("ok", "rows-only")
        print(f"{status:10s} {name:34s} {took:6.2f}s rows={n} {note}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
