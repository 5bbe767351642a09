"""Compare registered queries with their SQL: ``python -m checks.run [--sf 0.01] [names...]``."""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

from checks import oracle  # noqa: E402
from diagtab.plans import catalog  # noqa: E402
from diagtab.session import builder  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if isinstance(v, float):
            v = round(v, 10)
            return 0.0 if v == 0 else v
        return v

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


def differences(name, df, sql, con, limit=3):
    """None when equal, else a text that shows the first differences."""
    ours = [tuple(r) for r in df.collect()]
    cursor = con.execute(sql)
    theirs_columns = [c[0] for c in cursor.description]
    theirs_types = {c[0]: str(c[1]) for c in cursor.description}
    theirs = cursor.fetchall()
    if sorted(df.columns) != sorted(theirs_columns):
        return f"columns {sorted(df.columns)} != {sorted(theirs_columns)}"
    kinds = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    wrong = [(c, t, theirs_types[c]) for c, t in df.dtypes if kinds.get(t) != theirs_types[c]]
    if wrong:
        return f"types {wrong}"
    a, b = normal(ours, df.columns), normal(theirs, theirs_columns)
    if a == b:
        return None
    sa, sb = set(a), set(b)
    return (f"rows {len(a)} vs {len(b)}; columns {sorted(df.columns)}\n   only spark: {sorted(sa - sb, key=repr)[:limit]}"
            f"\n   only sql:   {sorted(sb - sa, key=repr)[:limit]}")


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--rows-only", action="store_true")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    spark = builder("check", 8, 8).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    sqls = oracle.statements()
    bad = 0
    for name, q in catalog.queries().items():
        if args.names and name not in args.names:
            continue
        started = time.time()
        try:
            df = q(spark, folder)
            if args.rows_only or name not in sqls:
                n = df.count()
                print(f"rows  {name} {n} {time.time() - started:.1f}s", flush=True)
                continue
            problem = differences(name, df, sqls[name], con)
        except Exception as exc:  # noqa: BLE001
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += problem is not None
        print(f"{'OK   ' if problem is None else 'FAIL '} {name} {time.time() - started:.1f}s {problem or ''}", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
