"""Run registered queries against their SQL on the given tables and compare the rows.

    python tests/oracle_check.py [name ...]     # all queries when no name is given

ORACLE_SF_DIR chooses the data folder (default: sf0.01).
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def plain(value):
    if value is None or type(value).__name__ == "NAType":
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else float(value)
    if hasattr(value, "item"):
        return plain(value.item())
    if hasattr(value, "isoformat"):
        return None if str(value) == "NaT" else str(value)[:26]
    return value


def multiset(frame) -> Counter:
    frame = frame[sorted(frame.columns)]
    return Counter(tuple(plain(v) for v in row) for row in frame.itertuples(index=False, name=None))


def compare(spark_frame, oracle_frame) -> str | None:
    """None when equal, else a short reason."""
    if sorted(spark_frame.columns) != sorted(oracle_frame.columns):
        return f"columns {sorted(spark_frame.columns)} != {sorted(oracle_frame.columns)}"
    if len(spark_frame) != len(oracle_frame):
        return f"rows {len(spark_frame)} != {len(oracle_frame)}"
    ours, theirs = multiset(spark_frame), multiset(oracle_frame)
    if ours == theirs:
        return None
    left, right = list((ours - theirs).elements()), list((theirs - ours).elements())
    left.sort(key=str), right.sort(key=str)
    names = sorted(spark_frame.columns)
    diff = [
        f"{n}: {a!r} / {b!r}" for n, a, b in zip(names, left[0], right[0], strict=True) if a != b
    ]
    return f"{len(left)} rows differ; first: {diff[:6]}"


def oracle_connection(sf_dir: str):
    import duckdb

    from gridgale.plans.base import TABLES

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def main(names: list[str]) -> int:
    import __spark_entry__ as entry

    from gridgale.session import local_session

    sf_dir = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
    spark = local_session(8)
    con = oracle_connection(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or list(queries):
        started = time.time()
        try:
            ours = queries[name](spark, sf_dir).toPandas()
            took = time.time() - started
            if name not in oracles:
                print(f"rows  {name:36s} {len(ours):8d} rows {took:6.1f}s", flush=True)
                continue
            started = time.time()
            theirs = con.execute(oracles[name]).df()
            reason = compare(ours, theirs)
        except Exception as error:  # report and go on with the next query
            bad += 1
            print(f"ERROR {name:36s} {type(error).__name__}: {str(error)[:600]}", flush=True)
            continue
        bad += reason is not None
        print(
            f"{'ok   ' if reason is None else 'DIFF '} {name:36s} {len(ours):8d} rows "
            f"{took:6.1f}s (sql {time.time() - started:.1f}s) {reason or ''}", flush=True,
        )
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
