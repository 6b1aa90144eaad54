"""Run registered queries against their SQL twins: python tests/compare.py [sf] [name ...]."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, list):
        return tuple(canon(x) for x in v)
    if isinstance(v, dict):
        return tuple(canon(x) for x in v.values())
    if hasattr(v, "asDict"):
        return tuple(canon(x) for x in v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(canon(r[i]) for i in order) for r in rows), key=repr)


def check(spark, con, sf_dir, q):
    df = q.plan(spark, sf_dir)
    got = df.collect()
    if q.sql is None:
        return len(got), "rows only"
    cur = con.execute(q.sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return len(got), f"COLUMNS {sorted(set(cols) ^ set(df.columns))}"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if len(a) != len(b):
        return len(got), f"ROWS spark={len(a)} duck={len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        near = all(
            all(p == r or (isinstance(p, float) and isinstance(r, float) and abs(p - r) < 1e-5 * max(1, abs(p)))
                for p, r in zip(x, y)) for x, y in bad)
        names = sorted(df.columns)
        x, y = bad[0]
        diff = {n: (p, r) for n, p, r in zip(names, x, y) if p != r}
        return len(got), f"VALUES {len(bad)} {'near' if near else ''} {str(diff)[:600]}\n      row {str(dict(zip(names, x)))[:500]}"
    return len(got), "ok"


def main(argv):
    sf = "/root/testdata/sf" + (argv[0] if argv else "0.01")
    from __spark_entry__ import catalogue
    from sessionledger.session import spark_session

    spark = spark_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g",
        "spark.sql.session.timeZone": "UTC"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    con.execute("SET TimeZone='UTC'")
    want = argv[1:]
    failed = 0
    for name, q in catalogue().items():
        if want and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in want):
            continue
        t = time.time()
        try:
            n, status = check(spark, con, sf, q)
        except Exception as e:  # noqa: BLE001
            n, status = -1, f"ERROR {type(e).__name__} {str(e)[:900]}"
        if status not in ("ok", "rows only"):
            failed += 1
        print(f"{name:44s} rows={n:<7d} {time.time() - t:6.2f}s {status}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
