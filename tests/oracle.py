"""Compare registered queries with their SQL in DuckDB on the driver tables."""

from __future__ import annotations

import os
import sys
import time
import traceback

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def family(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    return {int: "int", float: "float", str: "str"}.get(type(value), type(value).__name__)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, fn, sql):
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None, f"{len(got)} rows"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}; {got[:2]} {want[:2]}"
    for g, w in zip(got, want):
        if tuple(map(family, g)) != tuple(map(family, w)):
            return False, f"types {g} != {w}"
    bad = [(g, w) for g, w in zip(got, want) if g != w and repr(g) != repr(w)]
    if bad:
        return False, f"{len(bad)} rows differ, e.g. {bad[0]}"
    return True, f"{len(got)} rows"


def main(argv):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from tests.session import make_session
    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = make_session(), connect(sf_dir)
    sqls, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if argv and not any(name.startswith(a) for a in argv):
            continue
        t = time.time()
        try:
            ok, note = compare(spark, con, sf_dir, fn, sqls.get(name))
        except Exception as e:  # report and go on with the next query
            ok, note = False, "".join(traceback.format_exception_only(e))[:700] + traceback.format_exc()[-600:]
        bad += ok is False
        print(f"{ {True: 'ok  ', False: 'BAD ', None: 'rows'}[ok]} {name} {time.time() - t:.2f}s {note}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
