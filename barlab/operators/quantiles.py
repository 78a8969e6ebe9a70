"""Exact quantiles of groups of any size, in two passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Relative accuracy of the sketch that brackets a quantile; groups of at most so many values are taken whole.
ACCURACY = 10_000


def exact_quantiles(df: DataFrame, by: list[str], value: str, ps: list[float], accuracy: int = ACCURACY) -> DataFrame:
    """(by, n, q): of each group, how many values are not null and their quantiles, with linear interpolation, as an array.

    The first pass brackets each quantile by a sketch of bounded size; the second counts the values below each bracket
    and takes the distinct values in it with their counts, some ten-thousandths of the group. No task holds a group's
    values. Keys must not be null.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("_x")).where("_x IS NOT NULL")
    edges = [min(1.0, max(0.0, p + d)) for p in ps for d in (-3 / accuracy, 3 / accuracy)]
    sketch = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.percentile_approx("_x", edges, accuracy).alias("_e"))
    small = f"_n <= {accuracy}"
    met = rows.join(sketch, by)
    low, high = ([f"CASE WHEN {small} THEN double('-Infinity') ELSE _e[{2 * i + j}] END" for i in range(len(ps))] for j in (0, 1))
    below = met.groupBy(*by).agg(F.first("_n").alias("_n"), F.array(*(F.sum(F.expr(f"CASE WHEN _x < {x} THEN 1L ELSE 0L END")) for x in low)).alias("_below"))
    inside = F.expr(f"filter(array({', '.join(f'CASE WHEN ({small}) OR (_x >= {a} AND _x <= {b}) THEN {i} END' for i, (a, b) in enumerate(zip(low, high, strict=True)))}), i -> i IS NOT NULL)")
    values = met.withColumn("_i", F.explode(inside)).groupBy(*by, "_i", "_x").agg(F.count("*").alias("_k"))
    upto = f"sum(_k) OVER (PARTITION BY {', '.join([*by, '_i'])} ORDER BY _x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    ranked = values.withColumn("_to", F.expr(upto)).join(below, by).withColumn("_at", F.expr(f"(_n - 1) * element_at(array({', '.join(f'{p!r}D' for p in ps)}), _i + 1)")).withColumn("_to", F.expr("_to + _below[_i]"))
    holds = "{} >= _to - _k AND {} < _to"
    ends = ranked.groupBy(*by, "_i").agg(F.first("_n").alias("n"), F.first("_at").alias("_at"), *(F.max(F.expr(f"CASE WHEN {holds.format(k, k)} THEN _x END")).alias(out) for k, out in (("floor(_at)", "_a"), ("ceil(_at)", "_b"))))
    found = ends.withColumn("_q", F.expr("_a + (_b - _a) * (_at - floor(_at))"))
    return found.groupBy(*by).agg(F.first("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("_i", "_q"))), lambda v: v["_q"]).alias("q"))
