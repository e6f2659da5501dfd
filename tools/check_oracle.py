"""Run registered queries and their SQL side by side; print what differs.

    python tools/check_oracle.py [folder] [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from caseledger.plans import catalog  # noqa: E402
from caseledger.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(canonical(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=repr)


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = build_session("check", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    bad = 0
    for name, q in catalog.REGISTRY.items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            df = q.run(spark, folder)
            got = rows_of(df.columns, [tuple(r) for r in df.collect()])
        except Exception as problem:
            bad += 1
            print(f"FAIL {name}: {type(problem).__name__}: {str(problem)[:1500]}", flush=True)
            continue
        took = time.time() - start
        if q.sql is None:
            print(f"rows {name}: {len(got[1])} rows, {took:.2f}s", flush=True)
            continue
        try:
            cursor = con.execute(q.sql)
            want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
        except Exception as problem:
            bad += 1
            print(f"SQL  {name}: {str(problem)[:800]}", flush=True)
            continue
        if got == want:
            print(f"ok   {name}: {len(got[1])} rows, {took:.2f}s", flush=True)
        else:
            bad += 1
            print(f"DIFF {name}: {len(got[1])} vs {len(want[1])} rows {got[0]} {want[0]}")
            a, b = set(map(repr, got[1])), set(map(repr, want[1]))
            for side, only in (("spark", sorted(a - b)), ("sql", sorted(b - a))):
                print(f"   only {side} ({len(only)}):", *[o[:400] for o in only[:3]], sep="\n      ")
            sys.stdout.flush()
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
