"""Compare registered queries with their SQL in DuckDB, value by value.

Usage: python tests/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from feedloom.plans.fixtures import TABLE_NAMES  # noqa: E402


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLE_NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def both(spark, con, build, sql, sf_dir):
    df = build(spark, sf_dir)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    want = table([c[0] for c in cursor.description], cursor.fetchall())
    return got, want


def main():
    from __spark_entry__ import oracle_sql, queries
    from feedloom.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    registered, sqls = queries(), oracle_sql()
    names = sys.argv[2:] or [name for name in registered if name in sqls]
    spark = local_session("compare", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    print("without SQL:", sorted(set(registered) - set(sqls)), "unknown:", sorted(set(sqls) - set(registered)))
    for name in names:
        started = time.time()
        try:
            got, want = both(spark, con, registered[name], sqls[name], sf_dir)
            ok = got == want
            note = f"{len(got[1])} rows" if ok else f"columns {got[0]} / {want[0]} rows {len(got[1])} / {len(want[1])}"
            if not ok:
                extra = [r for r in got[1] if r not in set(want[1])][:2]
                missing = [r for r in want[1] if r not in set(got[1])][:2]
                note += f"\n   spark only {str(extra)[:1500]}\n   duckdb only {str(missing)[:1500]}"
        except Exception as exc:
            ok, note = False, "".join(traceback.format_exception_only(exc))[:1500]
        bad += not ok
        print("ok  " if ok else "BAD ", name, f"{time.time() - started:.1f}s", note, flush=True)
    print("bad:", bad, "of", len(names))


if __name__ == "__main__":
    main()
