"""Side-by-side run of a registered query and its SQL."""

from __future__ import annotations

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


def compare(spark, con, sf_dir, run, sql):
    """None if both give the same rows, else what differs."""
    df = run(spark, sf_dir)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    answer = con.execute(sql)
    names = [d[0] for d in answer.description]
    want = _rows(names, answer.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if got == want:
        return None
    extra, missing = [r for r in got if r not in set(want)], [r for r in want if r not in set(got)]
    return f"{len(got)} rows, SQL {len(want)}; only here {extra[:3]}; only SQL {missing[:3]}"
