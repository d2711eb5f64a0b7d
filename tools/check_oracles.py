"""Run registered queries beside their SQL twins in DuckDB and compare the rows.

    python tools/check_oracles.py [folder] [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

from shortlist.catalog import load
from shortlist.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "item"):
        return plain(value.item())
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        number = float(value)
        return 0.0 if number == 0 else number
    return str(value)


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in records]
    return sorted(out, key=repr)


def main(argv):
    folder = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark = local_session()
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    bad = 0
    total = 0.0
    for name, entry in load().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            start = time.time()
            df = entry.run(spark, folder)
            got = [tuple(r) for r in df.collect()]
            spent = time.time() - start
            total += spent
            if entry.sql is None:
                print(f"rows  {name:32s} {len(got):7d} rows {spent:6.2f}s")
                continue
            start = time.time()
            cur = con.execute(entry.sql)
            cols = [d[0] for d in cur.description]
            want = cur.fetchall()
            duck = time.time() - start
            if sorted(cols) != sorted(df.columns):
                bad += 1
                print(f"COLS  {name}: spark {sorted(df.columns)} sql {sorted(cols)}")
                continue
            a, b = rows_of(df.columns, got), rows_of(cols, want)
            if a == b:
                print(f"ok    {name:32s} {len(a):7d} rows {spent:6.2f}s  sql {duck:5.2f}s")
            else:
                bad += 1
                diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
                print(f"DIFF  {name}: {len(a)} vs {len(b)} rows; {sorted(cols)}; first {diff}")
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: {type(e).__name__} {str(e)[:900]}")
    print(f"{bad} problems; spark {total:.1f}s")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
