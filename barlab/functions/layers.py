"""Column layers: each layer adds columns that may use those of the layers before it.

Expressions stay inside Spark's built-in functions; layers over the same partition and order share one sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

Layer = dict[str, str]


def over(n: int, by: str = "symbol", order: str = "hour", skip: int = 0) -> str:
    """The frame of the last n rows, ending `skip` rows before the current one."""
    end = "CURRENT ROW" if not skip else f"{skip} PRECEDING"
    return f"OVER (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN {n - 1 + skip} PRECEDING AND {end})"


def upto(by: str = "symbol", order: str = "hour") -> str:
    return f"OVER (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def lag(x: str, n: int = 1, by: str = "symbol", order: str = "hour") -> str:
    return f"lag({x}, {n}) OVER (PARTITION BY {by} ORDER BY {order})"


def lead(x: str, n: int = 1, by: str = "symbol", order: str = "hour") -> str:
    return f"lead({x}, {n}) OVER (PARTITION BY {by} ORDER BY {order})"


def full(f: str, x: str, n: int, **where) -> str:
    """f over the last n rows, NULL until n rows hold x."""
    return f"CASE WHEN count({x}) {over(n, **where)} >= {n} THEN {f}({x}) {over(n, **where)} END"


def ratio(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def add_layers(df: DataFrame, layers: list[Layer]) -> DataFrame:
    for layer in layers:
        df = df.selectExpr("*", *(f"{e} AS {name}" for name, e in layer.items()))
    return df


def layers_sql(base: str, layers: list[Layer]) -> str:
    for layer in layers:
        base = f"SELECT *, {', '.join(f'{e} AS {name}' for name, e in layer.items())} FROM ({base})"
    return base


def rounded(keys: list[str], names: list[str]) -> list[str]:
    return [*keys, *(f"round({n}, 6) AS {n}" for n in names)]
