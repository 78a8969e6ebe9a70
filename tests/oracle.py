"""Runs a query and its SQL and compares the rows."""

import math
from pathlib import Path

import duckdb


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [tuple(r[i] for i in order) for r in rows], [names[i] for i in order]


def _key(row):
    return tuple((x is None, str(type(x).__name__ in ("str",)), x if not isinstance(x, float) else round(x, 4)) if x is not None else (True, "", 0) for x in row)


def differences(spark, sf_dir, query, sql):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    cur = con.execute(sql)
    want, want_names = rows_of([c[0] for c in cur.description], cur.fetchall())
    df = query(spark, sf_dir)
    got, got_names = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if want_names != got_names:
        return [f"columns {got_names} against {want_names}"]
    if len(want) != len(got):
        return [f"{len(got)} rows against {len(want)}"]
    out = []
    for a, b in zip(sorted(got, key=_key), sorted(want, key=_key), strict=True):
        same = all(x == y or (isinstance(x, float) or isinstance(y, float)) and x is not None and y is not None and math.isclose(float(x), float(y), rel_tol=1e-6, abs_tol=2e-6) for x, y in zip(a, b, strict=True))
        if not same:
            out.append(f"{a} against {b}")
    return out[:5]
