"""Long series cut into chunks: row numbers, running values, halos for bounded frames, and linear recurrences.

A series is the rows of one symbol (or of several key columns) in the order of an integer time. Chunks are spans of CHUNK
time units, so a row's chunk follows from the row alone and no task passes over a whole long series: windows inside a
chunk are partitioned by (symbol, chunk), and what a chunk needs of those before it comes from one row per chunk, joined
back by the same keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Time units a chunk, and chunks a group of chunks.
CHUNK, GROUP = 256, 256


def _prefix(by: str, c: str = "_c") -> str:
    return f"OVER (PARTITION BY {by} ORDER BY {c} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _within(by: str, order: str, end: str = "CURRENT ROW") -> str:
    return f"OVER (PARTITION BY {by}, _c ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND {end})"


def indexed(df: DataFrame, sums: dict[str, str] | None = None, by: str = "symbol", order: str = "hour") -> DataFrame:
    """Adds _i, the row's number in its series from 0, and the running sums of `sums` (output: expression)."""
    sums = sums or {}
    d = df.withColumn("_c", F.expr(f"{order} div {CHUNK}")).selectExpr("*", f"row_number() OVER (PARTITION BY {by}, _c ORDER BY {order}) - 1 AS _k", *(f"coalesce(sum({x}) {_within(by, order)}, 0) AS {out}" for out, x in sums.items()))
    ends = d.groupBy(by, "_c").agg(F.count("*").alias("_rows"), *(F.max_by(out, "_k").alias(f"_e_{out}") for out in sums))
    before = ends.selectExpr(by, "_c", f"coalesce(sum(_rows) {_prefix(by)}, 0) AS _before", *(f"coalesce(sum(_e_{out}) {_prefix(by)}, 0) AS _b_{out}" for out in sums))
    d = d.join(before, [by, "_c"])
    for out in sums:
        d = d.withColumn(out, F.expr(f"{out} + _b_{out}"))
    return d.withColumn("_i", F.expr("cast(_before + _k AS bigint)")).drop("_c", "_k", "_before", *(f"_b_{out}" for out in sums))


def with_halo(df: DataFrame, halo: int, ahead: int = 0, rows: int = 8192) -> DataFrame:
    """Rows that have _i, cut into parts of `rows`, each with the last `halo` rows before and the first `ahead` after it; the symbol names the part.

    Frames that reach no farther may then be partitioned by symbol as before; without_halo undoes it.
    """
    if halo + ahead >= rows:
        raise ValueError("a halo must be shorter than a part")
    part = f"filter(array(_i div {rows} - 1, _i div {rows}, _i div {rows} + 1), (p, j) -> (j = 0 AND p >= 0 AND _i % {rows} < {ahead}) OR j = 1 OR (j = 2 AND _i % {rows} >= {rows - halo}))"
    return df.withColumn("_part", F.explode(F.expr(part))).withColumn("symbol", F.concat_ws("\u0001", F.col("_part").cast("string"), "symbol")).withColumn("_own", F.expr(f"_i div {rows} = _part")).drop("_part")


def without_halo(df: DataFrame) -> DataFrame:
    return df.where("_own").withColumn("symbol", F.substring_index("symbol", "\u0001", -1)).drop("_own")


#: (of a chunk's rows up to one, from the chunks before and the chunk's own) of each kind of running value.
_RUNNING = {
    "sum": ("coalesce(sum({x}), 0)", "sum({x})", "coalesce(sum({e}) {w}, 0)", "{b} + {o}"), "max": ("max({x})", "max({x})", "max({e}) {w}", "greatest({b}, {o})"), "min": ("min({x})", "min({x})", "min({e}) {w}", "least({b}, {o})"),
    "last": ("last({x}, true)", "max_by({x}, CASE WHEN {x} IS NOT NULL THEN {order} END)", "last({e}, true) {w}", "coalesce({o}, {b})"),
}


def running(df: DataFrame, outs: dict[str, tuple[str, str]], by: list[str], order: str, backwards: bool = False, exclusive: bool = False) -> DataFrame:
    """Adds each output (kind, expression) over the rows of a key up to the current one: sum, max, min or the last value that is not null.

    `backwards` takes the rows from the current one on, the last first; `exclusive` leaves the current row out. Rows of a key have different orders, or the
    result within equal ones is any of theirs.
    """
    keys, way = ", ".join(by), "DESC" if backwards else ""
    here = f"OVER (PARTITION BY {keys}, _c ORDER BY {order} {way} ROWS BETWEEN UNBOUNDED PRECEDING AND {'1 PRECEDING' if exclusive else 'CURRENT ROW'})"
    before = f"OVER (PARTITION BY {keys} ORDER BY _c {way} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    when = f"-({order})" if backwards else f"({order})"
    d = df.withColumn("_c", F.expr(f"({order}) div {CHUNK}"))
    ends = d.groupBy(*by, "_c").agg(*(F.expr(_RUNNING[kind][1].format(x=x, order=when)).alias(f"_e_{out}") for out, (kind, x) in outs.items()))
    carried = ends.selectExpr(*by, "_c", *(f"{_RUNNING[kind][2].format(e=f'_e_{out}', w=before)} AS _b_{out}" for out, (kind, _) in outs.items()))
    d = d.selectExpr("*", *(f"{_own(kind, x, here)} AS _o_{out}" for out, (kind, x) in outs.items())).join(carried, [*by, "_c"])
    return d.selectExpr(*(f"`{c}`" for c in df.columns if c not in outs), *(f"{_RUNNING[kind][3].format(b=f'_b_{out}', o=f'_o_{out}')} AS {out}" for out, (kind, _) in outs.items()))


def _own(kind: str, x: str, here: str) -> str:
    return {"sum": f"coalesce(sum({x}) {here}, 0)", "max": f"max({x}) {here}", "min": f"min({x}) {here}", "last": f"last({x}, true) {here}"}[kind]


def previous(df: DataFrame, outs: dict[str, str], by: list[str], order: str) -> DataFrame:
    """Adds each output: the column's value in the row before, null in the first."""
    keys, row = ", ".join(by), f"struct({', '.join(outs.values())})"
    d = df.withColumn("_c", F.expr(f"({order}) div {CHUNK}"))
    carried = d.groupBy(*by, "_c").agg(F.expr(f"max_by({row}, {order})").alias("_l")).selectExpr(*by, "_c", f"lag(_l) OVER (PARTITION BY {keys} ORDER BY _c) AS _l")
    d = d.selectExpr("*", f"lag({row}) OVER (PARTITION BY {keys}, _c ORDER BY {order}) AS _p").join(carried, [*by, "_c"])
    return d.selectExpr(*(f"`{c}`" for c in df.columns if c not in outs), *(f"coalesce(_p, _l).{x} AS {out}" for out, x in outs.items()))


def _composed(ends: DataFrame, maps: list[str], by: str, c: str = "_c", levels: int = 2) -> DataFrame:
    """(by, c, a_<m>, b_<m>): for each chunk the map y -> a y + b of all chunks before it, from the chunks' own a_<m>, b_<m>.

    Chunks are composed in groups of GROUP, and these in groups again, so a list holds GROUP maps at most but on the last
    level, where a row stands for GROUP^2 chunks.
    """
    columns = [f"{x}_{m}" for m in maps for x in "ab"]
    fold = "aggregate({rows}, named_struct('a', 1D, 'b', 0D), (s, e) -> named_struct('a', s.a * e.a_{m}, 'b', s.b * e.a_{m} + e.b_{m}))"
    row = f"named_struct('c', {c}, {', '.join(f'{x!r}, {x}' for x in columns)})"
    if not levels:
        d = ends.selectExpr(by, c, f"collect_list({row}) {_prefix(by, c)} AS _rows")
        return d.selectExpr(by, c, *(f"{fold.format(rows='_rows', m=m)} AS _{m}" for m in maps)).selectExpr(by, c, *(f"_{m}.{x} AS {x}_{m}" for m in maps for x in "ab"))
    d = ends.withColumn("_g", F.expr(f"{c} div {GROUP}"))
    totals = d.groupBy(by, "_g").agg(F.expr(f"sort_array(collect_list({row}))").alias("_rows")).selectExpr(by, f"_g AS _g{levels}", *(f"{fold.format(rows='_rows', m=m)} AS _{m}" for m in maps)).selectExpr(by, f"_g{levels}", *(f"_{m}.{x} AS {x}_{m}" for m in maps for x in "ab"))
    above = _composed(totals, maps, by, f"_g{levels}", levels - 1).withColumnsRenamed({x: f"_up_{x}" for x in columns}).withColumnRenamed(f"_g{levels}", "_g")
    own = d.selectExpr(by, c, "_g", f"collect_list({row}) {_prefix(f'{by}, _g', c)} AS _rows").selectExpr(by, c, "_g", *(f"{fold.format(rows='_rows', m=m)} AS _{m}" for m in maps))
    return own.join(above, [by, "_g"]).selectExpr(by, c, *(y for m in maps for y in (f"_up_a_{m} * _{m}.a AS a_{m}", f"_up_b_{m} * _{m}.a + _{m}.b AS b_{m}")))


def ewms(df: DataFrame, averages: dict[str, tuple[str, float, int]], by: str = "symbol", order: str = "hour") -> DataFrame:
    """Adds y = (1 - a) * y_prev + a * x for every (output: x, a, warm-up), all in one pass.

    Each is seeded with the series' first x, which must not be null, and null in the first warm - 1 rows. Inside a chunk
    it is a windowed sum of x scaled by powers of 1 - a; the value carried into a chunk composes all chunks before it.
    """
    for _, alpha, _ in averages.values():
        if not 0.002 <= alpha <= 0.93:
            raise ValueError("alpha must be between 0.002 and 0.93")
    r = {out: f"{1 - alpha!r}D" for out, (_, alpha, _) in averages.items()}
    d = df.withColumn("_c", F.expr(f"{order} div {CHUNK}")).withColumn("_k", F.expr(f"row_number() OVER (PARTITION BY {by}, _c ORDER BY {order}) - 1"))
    d = d.selectExpr("*", *(f"pow({r[out]}, _k) * sum({alpha!r}D * ({x}) * pow({r[out]}, -_k)) {_within(by, order)} AS _s_{out}" for out, (x, alpha, _) in averages.items()))
    ends = d.groupBy(by, "_c").agg(F.count("*").alias("_rows"), *(F.max_by(f"_s_{out}", "_k").alias(f"_e_{out}") for out in averages), *(F.min_by(F.expr(x), "_k").alias(f"_x_{out}") for out, (x, _, _) in averages.items()))
    maps = _composed(ends.selectExpr(by, "_c", *(y for out in averages for y in (f"pow({r[out]}, _rows) AS a_{out}", f"_e_{out} AS b_{out}"))), list(averages), by)
    begun = ends.groupBy(by).agg(*(F.min_by(f"_x_{out}", "_c").alias(f"_f_{out}") for out in averages))
    counted = ends.selectExpr(by, "_c", f"coalesce(sum(_rows) {_prefix(by)}, 0) AS _before")
    carry = counted.join(maps, [by, "_c"]).join(begun, by).selectExpr(by, "_c", "_before", *(f"a_{out} * _f_{out} + b_{out} AS _y_{out}" for out in averages))
    d = d.join(carry, [by, "_c"])
    d = d.selectExpr(*(f"`{c}`" for c in df.columns if c not in averages), *(f"CASE WHEN _before + _k + 1 >= {warm} THEN _s_{out} + pow({r[out]}, _k + 1) * _y_{out} END AS {out}" for out, (_, _, warm) in averages.items()))
    return d


def scan(df: DataFrame, a: str, b: str, out: str, by: str = "symbol", order: str = "hour") -> DataFrame:
    """Adds y = a * y_prev + b, with y_prev = 0 before the first row; 0 < a <= 1 may differ by row."""
    d = df.withColumn("_c", F.expr(f"{order} div {CHUNK}")).selectExpr("*", f"exp(sum(ln({a})) {_within(by, order)}) AS _a")
    d = d.withColumn("_s", F.expr(f"_a * sum(({b}) / _a) {_within(by, order)}"))
    ends = d.groupBy(by, "_c").agg(F.max_by(F.struct("_a", "_s"), order).alias("_e")).selectExpr(by, "_c", "_e._a AS a_y", "_e._s AS b_y")
    carry = _composed(ends, ["y"], by).selectExpr(by, "_c", "b_y AS _y")
    return d.join(carry, [by, "_c"]).withColumn(out, F.expr("_s + _a * _y")).drop("_c", "_a", "_s", "_y")


def ewm_gaps(df: DataFrame, x: str, alpha: float, out: str, warm: int = 0, by: str = "symbol", order: str = "hour") -> DataFrame:
    """The average of a column with nulls: seeded with the first value, null before it and until `warm` values were seen.

    After m rows without a value a step weighs the past by w = (1 - a)^(m + 1): y = (w * y_prev + a * x) / (w + a); a row
    without a value repeats the last average. Rows need _i.
    """
    d = df.withColumn("_c", F.expr(f"{order} div {CHUNK}")).selectExpr("*", f"max(CASE WHEN {x} IS NOT NULL THEN _i END) {_within(by, order, '1 PRECEDING')} AS _l", f"count({x}) {_within(by, order)} AS _n")
    ends = d.groupBy(by, "_c").agg(F.expr(f"max(CASE WHEN {x} IS NOT NULL THEN _i END)").alias("_le"), F.expr(f"count({x})").alias("_ne"))
    before = ends.selectExpr(by, "_c", f"max(_le) {_prefix(by)} AS _lb", f"coalesce(sum(_ne) {_prefix(by)}, 0) AS _nb")
    d = d.join(before, [by, "_c"]).withColumn("_w", F.expr(f"pow({1 - alpha!r}D, _i - coalesce(_l, _lb))"))
    d = scan(d.withColumn("_seen", F.expr("_n + _nb")), f"CASE WHEN {x} IS NULL OR _w IS NULL THEN 1D ELSE _w / (_w + {alpha!r}D) END", f"CASE WHEN {x} IS NULL THEN 0D WHEN _w IS NULL THEN {x} ELSE {alpha!r}D * {x} / (_w + {alpha!r}D) END", "_o", by, order)
    return d.withColumn(out, F.expr(f"CASE WHEN _seen >= greatest(1, {warm}) THEN _o END")).drop("_c", "_l", "_n", "_lb", "_nb", "_w", "_seen", "_o")


def ewm_gaps_sql(x: str, alpha: float, warm: int = 0, by: str = "symbol", order: str = "hour") -> str:
    """DuckDB's form: a fold over all rows so far, the first with a value first."""
    w = f"OVER (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    rows = f"list({{'y': {x}, 'm': 0}}) {w}"
    r = f"pow({1 - alpha!r}::DOUBLE, s.m + 1)"
    fold = f"list_reduce(({rows})[list_position(list_transform({rows}, lambda v: v.y IS NOT NULL), true):], lambda s, v: CASE WHEN v.y IS NULL THEN {{'y': s.y, 'm': s.m + 1}} ELSE {{'y': ({r} * s.y + {alpha!r}::DOUBLE * v.y) / ({r} + {alpha!r}::DOUBLE), 'm': 0}} END)"
    return f"CASE WHEN count({x}) {w} >= greatest(1, {warm}) THEN ({fold}).y END"
