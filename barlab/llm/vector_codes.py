"""Vector code compression: product codes of integer vectors, the nearest entry found by Orchard's search.

Components become floor(4096 x); vectors are cut into `parts` consecutive parts. Each part's codebook starts as that part of
the vectors with the smallest ids and is refined for some rounds: every part goes to its nearest entry, and every entry
becomes the floored mean of its parts. All arithmetic is on 64-bit integers, so results do not depend on the order of rows.

Orchard's search keeps, for every entry, a list of the other entries by their distance from it. A part walks down the
list of its best entry so far, marks what it visits, jumps to the start of an improved entry's list, and stops at the
first listed entry beyond twice its current distance: by the triangle inequality no later one is as near. (In squares: beyond
four times the squared distance; entries at just that distance are still visited, so ties go to the lower index.) All
parts of a batch walk at once.

The integer vectors are written once to the shared folder and read in every round; a round shuffles `entries` sums a part
and task and collects parts x entries rows, which is all that reaches the driver. Sums per label are aggregated before the
shuffle and come back by two joins: labels with more than 1/1024 of the rows (so 1024 at most) are broadcast, the others
are shuffled.

Defined cases: rows with null vectors, null or non-finite components take no part, nor do vectors of another length than
the most common one (the shorter on ties); a null id sorts last; among equal ids the smaller vector comes first; with
fewer rows than entries the codebooks are smaller; a length that the parts do not divide is cut at floor(i d / parts); an
empty table gives an empty result; other columns are ignored. Components of 2^17 and more raise an error, as their
squares would leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.llm import common as C

SCALE = 4096
#: Labels with more than this share of the rows are joined by broadcast.
HOT_SHARE = 1 / 1024
_LARGEST = 1 << 29


def neighbour_lists(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per entry, the other entries by distance (ties by index), and the greatest squared distance at which a part still stops there.

    A squared distance D is beyond four times d when (D - 1) // 4 >= d; the second array holds (D - 1) // 4.
    """
    n = len(entries)
    apart = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(2)
    order = np.argsort(apart, axis=1, kind="stable")
    others = order[order != np.arange(n)[:, None]].reshape(n, n - 1)
    return others, (np.take_along_axis(apart, others, 1) - 1) >> 2


def orchard(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, its squared distance) of each part; ties go to the lower index."""
    others, quarter = neighbour_lists(entries)
    n, most = len(parts), len(entries) - 1
    best = np.zeros(n, dtype=np.int64)
    near = ((parts - entries[0]) ** 2).sum(1)
    seen = np.zeros((n, len(entries)), dtype=bool)
    seen[:, 0] = True
    place = np.zeros(n, dtype=np.int64)
    walking = np.arange(n if most else 0)
    while len(walking):
        current, at = best[walking], place[walking]
        going = quarter[current, at] < near[walking]
        walking, current, at = walking[going], current[going], at[going]
        entry = others[current, at]
        place[walking] = at + 1
        fresh = ~seen[walking, entry]
        who, entry, current = walking[fresh], entry[fresh], current[fresh]
        seen[who, entry] = True
        distance = ((parts[who] - entries[entry]) ** 2).sum(1)
        better = (distance < near[who]) | (distance == near[who]) & (entry < current)
        improved = who[better]
        best[improved], near[improved], place[improved] = entry[better], distance[better], 0
        walking = walking[place[walking] < most]
    return best, near


def _vectors(rows: pa.RecordBatch) -> np.ndarray:
    x = rows.column("vec").flatten().to_numpy(zero_copy_only=False)
    x = x.reshape(rows.num_rows, len(x) // rows.num_rows)
    if x.size and np.abs(x).max() >= _LARGEST:
        raise ValueError("components of 2^17 and more leave the range in which squared distances are exact")
    return x


def _sums(books: list[np.ndarray], cuts: list[int]):
    """What a task adds to each entry: part, entry, rows, sums of components."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [np.zeros(len(b), dtype=np.int64) for b in books]
        total = [np.zeros(b.shape, dtype=np.int64) for b in books]
        for rows in batches:
            if not rows.num_rows:
                continue
            x = _vectors(rows)
            for i, entries in enumerate(books):
                part = x[:, cuts[i] : cuts[i + 1]]
                near, _ = orchard(part, entries)
                n[i] += np.bincount(near, minlength=len(entries))
                np.add.at(total[i], near, part)
        found = [(i, e) for i in range(len(books)) for e in np.flatnonzero(n[i]).tolist()]
        columns = pa.array([i for i, _ in found], pa.int32()), pa.array([e for _, e in found], pa.int32()), pa.array([int(n[i][e]) for i, e in found], pa.int64())
        yield pa.RecordBatch.from_arrays([*columns, pa.array([total[i][e].tolist() for i, e in found], pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    return sums


def _codes(books: list[np.ndarray], cuts: list[int]):
    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not rows.num_rows:
                continue
            x = _vectors(rows)
            found = [orchard(x[:, cuts[i] : cuts[i + 1]], entries) for i, entries in enumerate(books)]
            code = np.column_stack([near for near, _ in found]).astype(np.uint8)
            error = np.sum([d for _, d in found], axis=0)
            yield pa.RecordBatch.from_arrays([rows.column("vec_id"), rows.column("label"), pa.array([c.hex() for c in map(bytes, code)], pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return codes


def integer_vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, vec) of the rows that take part, with vec as integers."""
    finite = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("_v")).where(F.col("_v").isNotNull()).where(finite)
    size = rows.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.where(F.size("_v") == (size["d"] if size else 0))
    return rows.select("vec_id", "label", F.transform("_v", lambda x: F.floor(x * SCALE).cast("long")).alias("vec"))


def refined(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> tuple[list[np.ndarray], list[int]]:
    """The codebook of each part, and where parts are cut."""
    first = np.array([r["vec"] for r in vectors.orderBy(F.asc_nulls_last("vec_id"), "vec").limit(entries).select("vec").collect()], dtype=np.int64)
    d = first.shape[1]
    cuts = [i * d // parts for i in range(parts + 1)]
    books = [first[:, a:b].copy() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    widest = max(b - a for a, b in zip(cuts[:-1], cuts[1:], strict=True))
    for _ in range(rounds):
        sums = vectors.select("vec").mapInArrow(_sums(books, cuts), "part int, entry int, n long, sums array<long>")
        for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.get("sums", F.lit(j))).alias(f"s{j}") for j in range(widest))).collect():
            book = books[r["part"]]
            book[r["entry"]] = [r[f"s{j}"] // r["n"] for j in range(book.shape[1])]
    return books, cuts


def vector_codes(table: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of every vector that takes part; 256 entries at most."""
    vectors = C.materialised(integer_vectors(table), "code-vectors")
    schema = f"vec_id long, label {vectors.schema['label'].dataType.simpleString()}, code string, error long"
    if vectors.isEmpty():
        return table.sparkSession.createDataFrame([], f"{schema}, label_error long, codebooks_sha256 string")
    books, cuts = refined(vectors, parts, entries, rounds)
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    coded = C.materialised(vectors.mapInArrow(_codes(books, cuts), schema), "codes")
    sums = C.checkpointed(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n")))
    rows = sums.agg(F.sum("_n")).first()[0]
    hot = sums.where(F.col("_n") > rows * HOT_SHARE).select(F.col("label").alias("_label"), "label_error")
    rest = sums.where(F.col("_n") <= rows * HOT_SHARE).select(F.col("label").alias("_label"), "label_error")
    same = F.col("label").eqNullSafe(F.col("_label"))
    frequent = coded.join(F.broadcast(hot), same)
    others = coded.join(F.broadcast(hot), same, "left_anti").join(rest, same)
    return frequent.unionByName(others).drop("_label").withColumn("codebooks_sha256", F.lit(digest))
