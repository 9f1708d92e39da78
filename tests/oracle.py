"""Run registered queries beside their SQL in DuckDB and compare columns, types and values."""
from __future__ import annotations

import math
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP", "date": "DATE",
}


def connect(sf: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def compare(spark, con, sf: str, fn, sql: str):
    """Empty text when both give the same rows, else what differs."""
    df = fn(spark, sf)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}", 0
    order = sorted(names)
    for f in df.schema.fields:
        kind = KINDS.get(f.dataType.simpleString(), f.dataType.simpleString())
        if kind != types[f.name]:
            return f"type of {f.name}: {kind} vs {types[f.name]}", 0
    got = [tuple(plain(r[c]) for c in order) for r in df.collect()]
    at = [names.index(c) for c in order]
    want = [tuple(plain(r[i]) for i in at) for r in want]
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    got, want = sorted(got, key=key), sorted(want, key=key)
    if len(got) != len(want):
        extra = [r for r in got if r not in set(want)][:2] if len(got) < 20000 else []
        return f"rows {len(got)} vs {len(want)} {order} e.g. {str(extra)[:600]}", len(got)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)}/{len(got)} rows differ {order}: {str(bad[0])[:900]}", len(got)
    return "", len(got)


def main(argv):
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    from tastemap.session import local_session

    sf = "/root/testdata/sf0.01"
    names = argv or list(entry.queries())
    spark = local_session(8)
    con = connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for pattern in names:
        for name in [n for n in queries if n == pattern or (pattern.endswith("*") and n.startswith(pattern[:-1]))]:
            t = time.time()
            try:
                if name in oracles:
                    msg, n = compare(spark, con, sf, queries[name], oracles[name])
                else:
                    n, msg = queries[name](spark, sf).count(), ""
            except Exception as exc:  # a check tool reports and goes on
                msg, n = f"{type(exc).__name__}: {str(exc)[:400]}", 0
            failed += bool(msg)
            print(f"{'FAIL' if msg else 'ok  '} {name:40s} rows={n:<7d} {time.time() - t:5.1f}s {'' if name in oracles else '(no sql)'} {msg}".replace(chr(10), " "), flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
