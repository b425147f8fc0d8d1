"""Runs registered queries in Spark and their oracle SQL in DuckDB and
compares row count, column names and order-insensitive values."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    return v


def canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def compare(spark, con, name, q, sql, sf_dir):
    t = time.time()
    df = q(spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    ts = time.time() - t
    t = time.time()
    rel = con.sql(sql)
    d_cols = list(rel.columns)
    d_rows = rel.fetchall()
    td = time.time() - t
    ok_cols = sorted(s_cols) == sorted(d_cols)
    ok_n = len(s_rows) == len(d_rows)
    ok_v = ok_cols and ok_n and canon(s_rows, s_cols) == canon(d_rows, d_cols)
    return dict(name=name, cols=ok_cols, rows=(len(s_rows), len(d_rows)), values=ok_v, spark_s=round(ts, 2),
                duck_s=round(td, 2), s_cols=s_cols, d_cols=d_cols)


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as E
    from condfuse.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    qs, sqls = E.queries(), E.oracle_sql()
    names = sys.argv[2:] or [n for n in qs if n in sqls]
    spark = local_session(8)
    con = duck(sf_dir)
    bad = 0
    for n in names:
        try:
            r = compare(spark, con, n, qs[n], sqls[n], sf_dir)
        except Exception as e:  # report and continue
            print(f"ERROR {n}: {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        flag = "OK " if r["values"] else "BAD"
        bad += 0 if r["values"] else 1
        print(f"{flag} {n:28s} rows={r['rows']} cols={r['cols']} spark={r['spark_s']}s duck={r['duck_s']}s"
              + ("" if r["cols"] else f" {r['s_cols']} vs {r['d_cols']}"))
    print("mismatches:", bad)
