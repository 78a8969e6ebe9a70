"""As-of joins over long series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.functions.series import running


def _merged(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, value: str, last: bool) -> DataFrame:
    """Rows of left (_row) and of right (_v), with an order in which equal times have right's rows first, or last."""
    tagged = left.select(F.struct(*left.columns).alias("_row"), *by, F.expr(f"2 * ({left_time}) + {0 if last else 1}").alias("_t"))
    other = right.select(F.expr(f"struct({value})").alias("_v"), *by, F.expr(f"2 * ({right_time}) + {1 if last else 0}").alias("_t"))
    return tagged.unionByName(other, allowMissingColumns=True)


def asof(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, value: str, default: float = 0.0) -> DataFrame:
    """left with the latest `value` of right at or before left_time, per `by`; the default before the first. Times are whole numbers.

    Both sides meet in chunks of time; each chunk carries its last value over to those after it, so nothing is
    multiplied and no key is sorted whole.
    """
    both = _merged(left, right.where(F.col(value).isNotNull()), [by], left_time, right_time, value, False)
    found = running(both, {"_x": ("last", "_v")}, [by], "_t").where("_row IS NOT NULL")
    return found.select("_row.*", F.coalesce(F.col(f"_x.{value}").cast("double"), F.lit(default)).alias(value))


def next_at_or_after(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str], out: str) -> DataFrame:
    """left with `out`: the values of right's first row at or after left_time, null where there is none, in chunks of time as well."""
    both = _merged(left, right, by, left_time, right_time, ", ".join(values), True)
    return running(both, {out: ("last", "_v")}, by, "_t", backwards=True).where("_row IS NOT NULL").select("_row.*", out)
