"""Run queries next to their SQL and compare rows: ``python -m checks.compare [name part ...]``."""

from __future__ import annotations

import os
import sys
import time
import traceback

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(repr(r[i]) for i in order) for r in rows))


def main(parts: list[str], sf_dir: str) -> int:
    from checks import ORACLES, QUERIES
    from kinesift.session import get_spark

    spark = get_spark(
        master=f"local[{os.environ.get('BENCH_CPUS', '8')}]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    for name, fn in QUERIES.items():
        if parts and not any(p in name for p in parts):
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            got = canonical(df.columns, [tuple(r) for r in df.collect()])
            took = time.time() - t
            if name not in ORACLES:
                print(f"rows  {name:32s} {len(got[1]):7d} {took:6.2f}s", flush=True)
                continue
            rel = con.execute(ORACLES[name])
            want = canonical([c[0] for c in rel.description], rel.fetchall())
            if got == want and got[1]:
                print(f"ok    {name:32s} {len(got[1]):7d} {took:6.2f}s {time.time() - t - took:5.2f}s", flush=True)
                continue
            bad += 1
            print(f"DIFF  {name}: {len(got[1])} rows, want {len(want[1])}; columns {got[0]} / {want[0]}", flush=True)
            only = [r for r in got[1] if r not in set(want[1])][:3], [r for r in want[1] if r not in set(got[1])][:3]
            print("   got ", str(only[0])[:1500], "\n   want", str(only[1])[:1500], flush=True)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: {type(e).__name__} {str(e)[:700]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:], os.environ.get("SF_DIR", "/root/testdata/sf0.01")))
