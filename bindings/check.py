"""Compare queries with their SQL twins in DuckDB: python -m bindings.check [prefix ...]."""

from __future__ import annotations

import math
import os
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(v)
    return f"{type(v).__name__}:{v}"


def rows_of(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in records)


def close(names_a, rows_a, names_b, rows_b):
    """Equal up to the last rounded digit of a float (a tie that the sum order decides)."""

    def arranged(names, rows):
        order = sorted(range(len(names)), key=lambda i: names[i])

        def key(r):
            fixed = [norm(r[i]) for i in order if not isinstance(r[i], float)]
            return fixed, [f"{r[i]:.5g}" for i in order if isinstance(r[i], float)]

        return [[r[i] for i in order] for r in sorted(rows, key=key)]

    a, b = arranged(names_a, rows_a), arranged(names_b, rows_b)
    if len(a) != len(b):
        return False
    for x, y in zip(a, b):
        for v, w in zip(x, y):
            if isinstance(v, float) and isinstance(w, float):
                if not math.isclose(v, w, rel_tol=1e-9, abs_tol=1e-12) and norm(v) != norm(w):
                    return False
            elif norm(v) != norm(w):
                return False
    return True


def compare(key, fn, sql, spark, con, d):
    from spendlens.session import scope

    start = time.time()
    with scope(spark) as owned:
        df = fn(spark, d)
        got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    left = [p for p in owned.paths if os.path.exists(p.removeprefix("file:"))]
    if left:
        return took, f"LEFT {left}"
    if sql is None:
        return took, f"rows-only n={len(got)} {got[:2]}"
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    want = rel.fetchall()
    if sorted(names) != sorted(df.columns):
        return took, f"COLUMNS {sorted(df.columns)} vs {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        return took, f"ok n={len(a)}"
    if close(df.columns, got, names, want):
        return took, f"ok~ n={len(a)} (equal to 1e-9)"
    extra = [x for x in a if x not in set(b)][:2]
    missing = [x for x in b if x not in set(a)][:2]
    return took, f"DIFF n={len(a)}/{len(b)} {sorted(names)}\n    spark {extra}\n    sql   {missing}"


def main(prefixes):
    import duckdb

    from bindings import catalogue
    from spendlens.session import build_session

    d = os.environ.get("CHECK_DIR", "/root/testdata/sf0.01")
    spark = build_session(
        "check",
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    oracles = catalogue.oracle_sql()
    bad = 0
    for key, fn in catalogue.queries().items():
        if prefixes and not any(key.startswith(p) for p in prefixes):
            continue
        try:
            took, note = compare(key, fn, oracles.get(key), spark, con, d)
        except Exception as exc:  # report and go on with the next query
            took, note = 0.0, f"ERROR {type(exc).__name__}: {str(exc)[:1500]}"
        bad += not note.startswith(("ok", "rows-only"))
        print(f"{key:34s} {took:6.2f}s {note}", flush=True)
    print("failing:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
