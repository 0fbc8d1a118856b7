"""Run registered queries in Spark and their oracles in DuckDB and compare the rows.

Command line: python tests/oracle_compare.py sf0.01 [query-name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return str(v)
    return str(v) if isinstance(v, (list, dict)) else v


def _sorted(rows, order):
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark, con, sf_dir: str, fn, sql: str) -> tuple[int, str]:
    """Row count, and a description of the difference (empty when equal)."""
    df = fn(spark, sf_dir)
    rows, cols = [tuple(r) for r in df.collect()], df.columns
    res = con.execute(sql)
    ocols = [x[0] for x in res.description]
    orows = res.fetchall()
    if sorted(cols) != sorted(ocols):
        return len(rows), f"columns {sorted(cols)} vs {sorted(ocols)}"
    names = sorted(cols)
    a = _sorted(rows, [cols.index(x) for x in names])
    b = _sorted(orows, [ocols.index(x) for x in names])
    if a == b:
        return len(rows), ""
    sa, sb = set(map(str, a)), set(map(str, b))
    da, db = [x for x in a if str(x) not in sb], [x for x in b if str(x) not in sa]
    text = f"rows {len(a)} vs {len(b)}, only spark {len(da)}, only oracle {len(db)}\n    {names}"
    for x, y in list(zip(da, db))[:2]:
        text += f"\n    S {x}\n    O {y}"
    if da and not db:
        text += f"\n    S {da[0]}"
    if db and not da:
        text += f"\n    O {db[0]}"
    return len(rows), text


def main() -> None:
    import __spark_entry__ as entry
    from panelkit.session import local_session

    sf_dir = f"/root/testdata/{sys.argv[1]}"
    prefixes = sys.argv[2:]
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not prefixes or any(n.startswith(p) for p in prefixes)]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("OFF")
    con, bad = connect(sf_dir), 0
    for n in names:
        t = time.time()
        try:
            if n in oracles:
                count, diff = compare(spark, con, sf_dir, queries[n], oracles[n])
                bad += bool(diff)
                print(f"{'DIFF' if diff else 'ok  '} {n} {count} {time.time() - t:.1f}s {diff}", flush=True)
            else:
                print(f"rows {n} {queries[n](spark, sf_dir).count()} {time.time() - t:.1f}s", flush=True)
        except Exception as ex:  # report and go on with the next query
            bad += 1
            print(f"ERR  {n} {str(ex)[:900]}".replace("\n", " | "), flush=True)
    print("failed", bad, "of", len(names))


if __name__ == "__main__":
    main()
