"""Choice of the best that lie apart from each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlab.sources.shared import written


def distinct_best(rows: DataFrame, by: str, axes: dict[str, tuple[float, float]], score: str, tie: str, apart: float = 0.15, batch: int = 256) -> DataFrame:
    """The rows of each `by` that are kept if they are taken from the best score on, each unless one already kept lies nearer than `apart`.

    The distance is the mean of the differences of the axes (column: low, high), each over its range; a null counts as
    no difference. Scores are compared to nine digits, then by `tie`. So a row that is itself too near suppresses nothing.

    In each round the `batch` best rows left of every `by` are folded in order, then all rows left are held against what
    that kept, and the near ones go. Rows are compared with kept ones alone, never with each other; how many can lie
    apart in a bounded space does not grow with the rows, so rounds end soon.
    """
    place = F.array(*((F.col(c).cast("double") - F.lit(float(lo))) / F.lit(float(hi - lo)) for c, (lo, hi) in axes.items()))
    order = F.struct((-F.round(F.col(score), 9)).alias("s"), F.col(tie).cast("string").alias("t"))
    left = rows.withColumn("_at", place).withColumn("_o", order)
    near = f"aggregate(zip_with(x._at, y._at, (a, b) -> coalesce(abs(a - b), 0D)), 0D, (s, d) -> s + d) / {len(axes)} < {apart!r}D"
    found = None
    while True:
        left = written(left, "left-to-choose")
        top = left.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy("_o"))).where(F.col("_r") <= batch)
        folded = top.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("_o", "_at"))).alias("_all"))
        chosen = written(folded.selectExpr(by, f"aggregate(_all, filter(_all, x -> false), (kept, x) -> if(exists(kept, y -> {near}), kept, concat(kept, array(x)))) AS _kept", "element_at(_all, -1)._o AS _last"), "chosen")
        if chosen.isEmpty():
            break
        kept = left.join(chosen.select(F.col(by).alias("_by"), F.explode("_kept").alias("_k")), (F.col(by) == F.col("_by")) & (F.col("_o") == F.col("_k._o")), "left_semi").dropDuplicates([by, "_o"])
        found = kept if found is None else found.unionByName(kept)
        own = chosen.select(F.col(by).alias("_by"), "_kept", "_last")
        left = left.join(own, F.col(by) == F.col("_by")).where("_o > _last").where(F.expr(f"NOT exists(_kept, y -> {near.replace('x._at', '_at')})")).select(*left.columns)
    return (left if found is None else found).select(*rows.columns)
