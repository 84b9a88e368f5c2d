"""Side-by-side run of a Spark query and its DuckDB oracle."""

from __future__ import annotations

import math
import sys
import tempfile
import time
import traceback

import duckdb

from acadspark.sources.fixtures import BASE_TABLES


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{norm(x)}" for k, x in sorted(v.items())) + "}"
    return f"{type(v).__name__}:{v}"


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, sf_dir, fn, sql, con):
    df = fn(spark, sf_dir)
    sc, sr = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    dc, dr = rows_of([d[0] for d in cur.description], cur.fetchall())
    if sc != dc:
        return f"columns differ: {sc} vs {dc}"
    if sr != dr:
        a, b = set(sr), set(dr)
        only_s, only_d = sorted(a - b)[:3], sorted(b - a)[:3]
        return f"rows {len(sr)} vs {len(dr)}\n  cols {sc}\n  spark only ({len(a - b)}): {only_s}\n  duck only ({len(b - a)}): {only_d}"
    return None


def main(argv):
    import __spark_entry__ as e
    from acadspark.session import build_session

    sf = "/root/testdata/sf0.01"
    names = []
    for a in argv:
        if a.startswith("/"):
            sf = a
        else:
            names.append(a)
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                  "spark.driver.memory": "8g", "spark.acadspark.scan.tasks": "8",
                                                  "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp")})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    qs, os_ = e.queries(), e.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        t = time.time()
        try:
            if name in os_:
                msg = compare(spark, sf, fn, os_[name], con)
                status = "ok" if msg is None else "DIFF " + msg
            else:
                df = fn(spark, sf)
                n = df.count()
                status = f"rows-only {n}" if n else "DIFF empty"
        except Exception as ex:
            status = "DIFF error " + "".join(traceback.format_exception_only(ex))[:1500]
        bad += status.startswith("DIFF")
        if status.startswith("DIFF") or names or time.time() - t > 5:
            print(f"{name}: {status} [{time.time() - t:.1f}s]", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
