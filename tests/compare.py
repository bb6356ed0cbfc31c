"""Run reports against the SQL they are checked with, outside pytest or in it.

    python tests/compare.py [--sf 0.01] [name prefix ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def canonical(value):
    if isinstance(value, bool):
        return ("n", int(value))
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return ("n", int(value)) if value.is_integer() else ("n", float(f"{value:.12g}"))
    if isinstance(value, int):
        return ("n", value)
    if isinstance(value, date) and not isinstance(value, datetime):
        return datetime(value.year, value.month, value.day)
    return value


def fingerprint(rows) -> list[str]:
    return sorted(repr([canonical(v) for v in row]) for row in rows)


def compare(spark, con, name, query, oracle, folder):
    """None when equal, else a message."""
    df = query(spark, folder)
    columns = sorted(df.columns)
    got = fingerprint(tuple(r) for r in df.select(*columns).collect())
    if oracle is None:
        return None, len(got)
    relation = con.execute(oracle)
    found = [d[0] for d in relation.description]
    if sorted(found) != columns:
        return f"columns {columns} != {sorted(found)}", len(got)
    order = [found.index(c) for c in columns]
    want = fingerprint(tuple(r[i] for i in order) for r in relation.fetchall())
    if got != want:
        only_got = [g for g in got if g not in set(want)][:2]
        only_want = [w for w in want if w not in set(got)][:2]
        return f"{len(got)} rows vs {len(want)}; {columns}\n   got  {only_got}\n   want {only_want}", len(got)
    # floats in one engine and integers in the other would hash apart
    return None, len(got)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    from fleetgauge.oracles.registry import ORACLES
    from fleetgauge.plans.registry import queries
    from fleetgauge.session import local_session

    folder = f"/root/testdata/sf{args.sf}"
    spark, con = local_session(8), connect(folder)
    bad = 0
    for name, query in queries().items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        start = time.time()
        try:
            message, rows = compare(spark, con, name, query, ORACLES.get(name), folder)
        except Exception as error:  # noqa: BLE001 - report and go on
            message, rows = f"{type(error).__name__}: {str(error)[:1500]}", -1
        bad += message is not None
        note = "" if name in ORACLES else " (rows only)"
        print(f"{'OK  ' if message is None else 'FAIL'} {name} rows={rows} {time.time() - start:.1f}s{note} {message or ''}")
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
