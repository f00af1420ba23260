"""Runs registered queries next to their SQL in DuckDB and compares sorted values."""

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def ordered(rows):
    return sorted((tuple(plain(v) for v in r) for r in rows), key=repr)


def same(a, b, tol):
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(same(x, y, tol) for x, y in zip(a, b))
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return a == b if tol == 0 else abs(a - b) <= tol * max(1.0, abs(a))
    return a == b


def compare(spark, con, sf, f, sql, tol=0.0):
    """An empty string when both agree, else what differs."""
    df = f(spark, sf)
    cols = sorted(df.columns)
    left = ordered(df.select(*cols).collect())
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    if sorted(names) != cols:
        return f"columns {cols} != {sorted(names)}"
    order = [names.index(c) for c in cols]
    right = ordered([[r[i] for i in order] for r in res.fetchall()])
    if len(left) != len(right):
        return f"{len(left)} rows != {len(right)}"
    bad = [(a, b) for a, b in zip(left, right) if not same(a, b, tol)]
    return "" if not bad else f"{len(bad)} of {len(left)} rows differ, first {cols}: {bad[0][0]} != {bad[0][1]}"


if __name__ == "__main__":
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    from tessella.session import local_session

    sf = sys.argv[1]
    want = sys.argv[2:]
    spark = local_session(8, "oracle")
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle, failed = connect(sf), entry.oracle_sql(), 0
    for name, f in entry.queries().items():
        if want and not any(name.startswith(w) for w in want):
            continue
        start = time.time()
        try:
            if name in oracle:
                result = compare(spark, con, sf, f, oracle[name])
            else:
                result = "" if f(spark, sf).count() >= 0 else "?"
        except Exception as e:  # noqa: BLE001
            result = f"{type(e).__name__}: {str(e)[:700]}"
        failed += bool(result)
        print(f"{'ok  ' if not result else 'FAIL'} {name}{'' if name in oracle else ' (no sql)'} {time.time() - start:.1f}s {result}", flush=True)
    print("failed", failed)
