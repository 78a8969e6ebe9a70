"""Clusters of whole-number vectors: flat, in given groups, and bisecting k-means, as tables of centroids.

Vectors are arrays of whole numbers, and centroids are floored means, so every distance is exact and a fit does not depend on
the order or the partitions of rows; ties go to the lower number. A round is one pass: tasks assign their rows by a
product of matrices and send one row of sums a centroid; what comes to the driver has the size of the centroids alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Place = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _matrix(rows: pa.RecordBatch) -> np.ndarray:
    x = rows.column("q").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return x.reshape(rows.num_rows, len(x) // rows.num_rows)


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The number of the nearest centroid of each row; all values are whole and far below 2^53, so products are exact."""
    return np.argmin((centroids**2).sum(1)[None, :] - 2 * x @ centroids.T, axis=1)


def _summed(rows: DataFrame, place: Place) -> list:
    """(grp, entry, n, sums) of all rows that `place` puts to an entry (grp -1: none); rows have grp and q."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b)
            grp, entry = place(x, b.column("grp").to_numpy(zero_copy_only=False))
            key = grp.astype(np.int64) * (1 << 20) + entry
            by = np.argsort(key, kind="stable")
            by = by[np.searchsorted(key[by], 0) :]
            cut = np.flatnonzero(np.diff(key[by], prepend=-1))
            for k, own in zip(key[by][cut].tolist(), np.split(x[by], cut[1:]), strict=False):
                n, s = held.get(k, (0, 0.0))
                held[k] = (n + len(own), s + own.sum(0))
        yield pa.RecordBatch.from_arrays(
            [pa.array([k >> 20 for k in held], pa.int32()), pa.array([k & ((1 << 20) - 1) for k in held], pa.int32()), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([s.astype(np.int64).tolist() for _, s in held.values()], pa.list_(pa.int64()))],
            names=["grp", "entry", "n", "sums"],
        )

    parts = rows.select("grp", "q").mapInArrow(sums, "grp int, entry int, n long, sums array<long>").select("grp", "entry", "n", F.posexplode("sums").alias("dim", "s"))
    found: dict[tuple[int, int], dict] = {}
    for r in sorted(parts.groupBy("grp", "entry", "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()):
        found.setdefault((r["grp"], r["entry"]), {"grp": r["grp"], "entry": r["entry"], "n": r["n"], "sums": []})["sums"].append(r["s"])
    return list(found.values())


def _means(books: dict[int, np.ndarray], found: list) -> dict[int, np.ndarray]:
    out = {g: b.copy() for g, b in books.items()}
    for r in found:
        out[r["grp"]][r["entry"]] = [s // r["n"] for s in r["sums"]]
    return out


def _within(books: dict[int, np.ndarray]) -> Place:
    def place(x: np.ndarray, grp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        entry, own = np.zeros(len(x), np.int64), np.full(len(x), -1, np.int64)
        for g, book in books.items():
            here = grp == g
            if here.any():
                entry[here], own[here] = nearest(x[here], book), g
        return own, entry

    return place


def _first_rows(rows: DataFrame, k: int) -> dict[int, np.ndarray]:
    """The k rows of each group with the smallest `o`."""
    best = F.row_number().over(Window.partitionBy("grp").orderBy("o"))
    out: dict[int, list] = {}
    for r in rows.select("grp", "o", "q").withColumn("n", best).where(F.col("n") <= k).orderBy("grp", "n").collect():
        out.setdefault(r["grp"], []).append(r["q"])
    return {g: np.array(v, dtype=np.float64) for g, v in out.items()}


def fit(rows: DataFrame, k: int, rounds: int = 6) -> dict[int, np.ndarray]:
    """Centroids of each group: rows have grp (int), o (text that orders them, unlike in a group) and q; the k first begin."""
    books = _first_rows(rows, k)
    for _ in range(rounds):
        books = _means(books, _summed(rows, _within(books)))
    return books


def leaves(x: np.ndarray, levels: list[dict[int, tuple[int, np.ndarray]]]) -> np.ndarray:
    """The leaf of each row after the splits of all levels: leaf -> (number of the second half, its two centroids)."""
    at = np.zeros(len(x), np.int64)
    for level in levels:
        before = at.copy()
        for leaf, (second, pair) in level.items():
            here = before == leaf
            if here.any():
                at[here] = np.where(nearest(x[here], pair) == 1, second, leaf)
    return at


def bisected(rows: DataFrame, k: int, rounds: int = 3) -> np.ndarray:
    """k centroids by levels: on each, the largest leaves are halved, as many as there are or are lacking; rows have o and q."""
    levels: list[dict[int, tuple[int, np.ndarray]]] = []
    n = 1
    plain = rows.select(F.lit(0).alias("grp"), "o", "q")
    while n < k:
        sizes = {r["entry"]: r["n"] for r in _summed(plain, lambda x, g, done=list(levels): (np.zeros(len(x), np.int64), leaves(x, done)))}
        chosen = sorted((leaf for leaf in sizes if sizes[leaf] >= 2), key=lambda leaf: (-sizes[leaf], leaf))[: min(n, k - n)]

        def leaf_of(batches: Iterator[pa.RecordBatch], done=list(levels)) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(leaves(_matrix(b), done).astype(np.int32)), b.column("o"), b.column("q")], names=["grp", "o", "q"])

        halves = fit(plain.mapInArrow(leaf_of, "grp int, o string, q array<long>").where(F.col("grp").isin(chosen or [-1])), 2, rounds)
        levels.append({leaf: (n + i, halves[leaf]) for i, leaf in enumerate(chosen)})
        n += min(n, k - n)
    found = _summed(plain, lambda x, g: (np.zeros(len(x), np.int64), leaves(x, levels)))
    return np.array([[s // r["n"] for s in r["sums"]] for r in found], dtype=np.float64)


def macros(books: dict[int, np.ndarray]) -> np.ndarray:
    """The floored mean of each group's centroids."""
    return np.array([books[g].sum(0) // len(books[g]) for g in sorted(books)])


def assigned(rows: DataFrame, books: dict[int, np.ndarray], keys: list[str], per: int = 0) -> DataFrame:
    """keys and `cluster`: the nearest macro centroid's group, and in it the nearest centroid, numbered from group x per."""
    groups, of_group = sorted(books), macros(books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b)
            group = nearest(x, of_group)
            out = np.zeros(len(x), np.int64)
            for i in np.unique(group).tolist():
                out[group == i] = groups[i] * per + nearest(x[group == i], books[groups[i]])
            i = b.schema.get_field_index("q")
            yield pa.RecordBatch.from_arrays([*(c for j, c in enumerate(b.columns) if j != i), pa.array(out.astype(np.int32))], names=[*(c for j, c in enumerate(b.schema.names) if j != i), "cluster"])

    plain = rows.select(*keys, "q")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema if f.name != "q")
    return plain.mapInArrow(assign, f"{schema}, cluster int")


def as_table(spark: SparkSession, books: dict[int, np.ndarray]) -> DataFrame:
    """(grp, entry, q): the centroids as a table that can be written, shared and read again."""
    return spark.createDataFrame([(g, i, [int(v) for v in c]) for g in sorted(books) for i, c in enumerate(books[g])], "grp int, entry int, q array<long>")


def from_table(table: DataFrame) -> dict[int, np.ndarray]:
    out: dict[int, list] = {}
    for r in table.orderBy("grp", "entry").collect():
        out.setdefault(r["grp"], []).append(r["q"])
    return {g: np.array(v, dtype=np.float64) for g, v in out.items()}


# ---------------------------------------------------------------- the same in SQL


def _round_sql(rows: str, book: str) -> str:
    """(id, grp, e): the nearest entry of the row's group."""
    return f"SELECT id, grp, arg_min(e, d * 1024 + e) AS e FROM (SELECT x.id, x.grp, b.e, list_inner_product(b.c, b.c) - 2 * list_inner_product(x.v, b.c) AS d FROM {rows} x JOIN {book} b ON b.grp = x.grp) GROUP BY id, grp"


def _mean_sql(rows: str, placed: str) -> str:
    """(grp, e, c): floored means."""
    return f"SELECT grp, e, list(c ORDER BY j) AS c FROM (SELECT n.grp, n.e, j, floor(sum(x.v[j]) / count(*)) AS c FROM {placed} n JOIN {rows} x USING (id), unnest(range(1, (SELECT max(len(v)) FROM {rows}) + 1)) AS u(j) GROUP BY ALL) GROUP BY grp, e"


def fit_sql(p: str, rows: str, k: int, rounds: int = 6) -> list[tuple[str, str]]:
    """Common table expressions, the last of which, {p}b{rounds}, holds (grp, e, c); rows: (id, grp, o, v as DOUBLE[])."""
    out = [(f"{p}b0", f"SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY o) - 1 AS e, v AS c FROM {rows} QUALIFY e < {k}")]
    for i in range(rounds):
        out += [(f"{p}n{i}", _round_sql(rows, f"{p}b{i}")), (f"{p}m{i}", _mean_sql(rows, f"{p}n{i}")), (f"{p}b{i + 1}", f"SELECT b.grp, b.e, coalesce(m.c, b.c) AS c FROM {p}b{i} b LEFT JOIN {p}m{i} m USING (grp, e)")]
    return out


def bisected_sql(p: str, rows: str, k: int, rounds: int = 3) -> list[tuple[str, str]]:
    """The last expression, {p}c, holds (grp = 0, e, c)."""
    out, n, level = [(f"{p}a0", f"SELECT id, 0::BIGINT AS leaf FROM {rows}")], 1, 0
    while n < k:
        a = f"{p}a{level}"
        out += [
            (f"{p}l{level}", f"SELECT leaf, row_number() OVER (ORDER BY count(*) DESC, leaf) - 1 AS place FROM {a} GROUP BY leaf HAVING count(*) >= 2 QUALIFY place < {min(n, k - n)}"),
            (f"{p}x{level}", f"SELECT x.id, a.leaf AS grp, x.o, x.v FROM {rows} x JOIN {a} a USING (id) JOIN {p}l{level} USING (leaf)"),
            *fit_sql(f"{p}{level}_", f"{p}x{level}", 2, rounds), (f"{p}h{level}", _round_sql(f"{p}x{level}", f"{p}{level}_b{rounds}")),
            (f"{p}a{level + 1}", f"SELECT a.id, CASE WHEN h.e = 1 THEN {n} + l.place ELSE a.leaf END AS leaf FROM {a} a LEFT JOIN {p}h{level} h USING (id) LEFT JOIN {p}l{level} l ON l.leaf = a.leaf"),
        ]
        n, level = n + min(n, k - n), level + 1
    final = f"SELECT 0 AS grp, row_number() OVER (ORDER BY e) - 1 AS e, c FROM ({_mean_sql(rows, f'(SELECT id, 0 AS grp, leaf AS e FROM {p}a{level})')})"
    return [*out, (f"{p}c", final)]


def assigned_sql(rows: str, book: str, keys: str, per: int) -> str:
    """(keys, cluster) for rows (id, v, keys) by the centroids (grp, e, c) of a book."""
    macro = f"SELECT grp, list(c ORDER BY j) AS m FROM (SELECT grp, j, floor(sum(c[j]) / count(*)) AS c FROM {book}, unnest(range(1, (SELECT max(len(c)) FROM {book}) + 1)) AS u(j) GROUP BY ALL) GROUP BY grp"
    group = f"SELECT id, arg_min(grp, d * 1024 + grp) AS grp FROM (SELECT x.id, k.grp, list_inner_product(k.m, k.m) - 2 * list_inner_product(x.v, k.m) AS d FROM {rows} x CROSS JOIN ({macro}) k) GROUP BY id"
    return f"SELECT {keys}, (grp * {per} + e)::INT AS cluster FROM {rows} JOIN (SELECT id, grp, arg_min(e, d * 1024 + e) AS e FROM (SELECT x.id, g.grp, b.e, list_inner_product(b.c, b.c) - 2 * list_inner_product(x.v, b.c) AS d FROM {rows} x JOIN ({group}) g USING (id) JOIN {book} b ON b.grp = g.grp) GROUP BY id, grp) USING (id)"
