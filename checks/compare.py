"""Run registered queries beside their SQL and report every difference.

Usage: python -m checks.compare SF_DIR [name prefix ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from checks.oracle import ORACLE
from checks.queries import QUERIES
from signalframe.session import get_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else (0.0 if value == 0 else value)
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, int):
        return value
    return value if isinstance(value, str) else str(value)


def main() -> int:
    sf_dir, prefixes = sys.argv[1], sys.argv[2:]
    spark = get_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    bad = 0
    for name, run in QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            columns = sorted(df.columns)
            ours = [tuple(normal(r[c]) for c in columns) for r in df.collect()]
        except Exception as error:
            causes = [l for l in str(error).splitlines() if "Caused by" in l or "erialization" in l or "- object" in l or "- field" in l]
            print(f"{name}: SPARK FAILED {str(error)[:400]}", *[c[:300] for c in causes[:12]], sep="\n", flush=True)
            bad += 1
            continue
        took = time.time() - start
        if name not in ORACLE:
            print(f"{name}: {len(ours)} rows, no SQL ({took:.1f}s)", flush=True)
            bad += not ours
            continue
        start = time.time()
        try:
            found = db.execute(ORACLE[name])
            names = [d[0] for d in found.description]
            theirs = [tuple(normal(r[names.index(c)]) for c in columns) for r in found.fetchall()]
        except Exception as error:
            print(f"{name}: SQL FAILED {str(error)[:600]}", flush=True)
            bad += 1
            continue
        sql_took = time.time() - start
        key = lambda row: tuple((v is None, str(type(v)), v) for v in row)
        a, b = sorted(map(str, ours)), sorted(map(str, theirs))
        if sorted(names) != columns or a != b:
            bad += 1
            only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
            print(f"{name}: DIFFERS {len(a)} vs {len(b)} rows, {len(only_a)} / {len(only_b)} unmatched; {columns} {sorted(names)}")
            for line in only_a[:3]:
                print("   spark", line[:300])
            for line in only_b[:3]:
                print("   sql  ", line[:300])
        else:
            print(f"{name}: ok {len(a)} rows (spark {took:.1f}s, sql {sql_took:.1f}s)", flush=True)
    print(f"{bad} problems")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
