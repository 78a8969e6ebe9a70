"""One linear recurrence y = (1 - a) * y_prev + a * x, and its SQL; several at once are in series.ewms."""

from __future__ import annotations

from pyspark.sql import DataFrame

from barlab.functions.series import ewms


def ewm(df: DataFrame, x: str, alpha: float, out: str, warm: int = 0, by: str = "symbol", order: str = "hour") -> DataFrame:
    """Adds `out`, seeded with the first row's x, which must not be null; null in the first warm - 1 rows."""
    return ewms(df, {out: (x, alpha, warm)}, by, order)


def ewm_sql(x: str, alpha: float, warm: int = 0, by: str = "symbol", order: str = "hour") -> str:
    """DuckDB's form: a fold over the list of all rows so far."""
    w = f"OVER (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(*) {w} >= {warm} THEN list_reduce(list({x}) {w}, lambda a, v: a * {1 - alpha!r}::DOUBLE + v * {alpha!r}::DOUBLE) END"
