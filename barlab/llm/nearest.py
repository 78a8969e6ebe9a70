"""Approximate nearest neighbours by inner product: inverted lists with an adaptive dimension scan.

Vectors get one more component, sqrt(M^2 - |x|^2) with M the largest norm (0 for queries), so that the largest inner
product is the smallest distance; all are turned by one random rotation. There are as many lists as the root of the number
of vectors, so a list holds as many vectors as there are lists. A list's centroid is the sum of a coarse one, of `coarse`
at most, and a fine one, of what the nearest coarse ones leave; both are fitted on a bounded sample, and up to coarse^2
vectors the fine one is zero. Every vector goes to the nearest coarse centroid, then to the fine one nearest to what is
left. The model has coarse + root / coarse centroids and a count for each list: 8 MB at 10^12 vectors.

A query probes the lists with the nearest centroids, empty ones last; how many is set by brute force on a bounded sample
of queries against all vectors, for the asked recall. A query whose lists hold
fewer than k vectors of other ids probes further lists, in the same order, until they do or no list is left, so every query
gets k rows, or all candidates if there are fewer.

Within a list, vectors lie in blocks of at most `block_rows`, scanned in column blocks. After each, a candidate is
abandoned if its partial distance, scaled to all dimensions, exceeds the current k-th distance by more than sampling
error explains; the k that set this distance always stay. What is left is measured exactly, in double precision, on the
original vectors.

Lists and query sets of any size are split by hash, so no task gets more than block_rows vectors and query_rows queries
at a time. Defined cases: null, zero, non-finite vectors and vectors of another length than the most common one (the
shorter on ties) take no part; a null id takes no part; repeated ids are candidates of their own but never of a query
with the same id; equal scores go to the smaller id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlab.llm import common as C

SAMPLE, TUNING_QUERIES, COARSE = 16_384, 64, 1024
#: Distances of queries to lists held at once: 32 MB.
_DISTANCES = 1 << 22
_COLUMNS = 16
#: Queries scanned at once: 128 by 4096 pairs of single precision are 2 MB.
_QUERIES = 128
#: Standard errors of the test; a larger value abandons fewer candidates.
_ERRORS = 2.1


def rotation(d: int, seed: int = 17) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _matrix(col) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 19) -> np.ndarray:
    centres = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(1)[None, :] - 2 * x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def fit_lists(x: np.ndarray, n: int, coarse: int) -> tuple[np.ndarray, np.ndarray]:
    """Coarse and fine centroids of at least n lists; list c * len(fine) + f has the centroid coarse[c] + fine[f]."""
    centres = kmeans(x, min(n, coarse))
    if n <= coarse:
        return centres, np.zeros((1, x.shape[1]))
    left = x - centres[_closest(x, centres)]
    return centres, kmeans(left, -(-n // len(centres)), seed=23)


def _closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1)[None, :] - 2 * x @ centres.T, axis=1)


def list_of(x: np.ndarray, lists: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    coarse, fine = lists
    near = _closest(x, coarse)
    return near if len(fine) == 1 else near * len(fine) + _closest(x - coarse[near], fine)


def list_order(q: np.ndarray, lists: tuple[np.ndarray, np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """The lists of each row of q, nearest centroid first, those without vectors last."""
    coarse, fine = lists
    far = ((coarse**2).sum(1)[None, :] - 2 * q @ coarse.T)[:, :, None] + ((fine**2).sum(1)[None, :] - 2 * q @ fine.T)[:, None, :] + 2 * (coarse @ fine.T)[None]
    far = far.reshape(len(q), -1)
    far[:, sizes == 0] = np.inf
    return np.argsort(far, axis=1, kind="stable")


def _lifted(x: np.ndarray, most: float | None) -> np.ndarray:
    last = np.zeros(len(x)) if most is None else np.sqrt(np.maximum(most - (x**2).sum(1), 0))
    return np.column_stack([x, last])


def _assign(model):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, lists, most = model.value
        for rows in batches:
            if rows.num_rows:
                near = list_of(_lifted(_matrix(rows.column("vec")), most) @ turn, lists)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(near.astype(np.int32))], names=[*rows.schema.names, "list"])

    return assign


def probed(near: np.ndarray, sizes: np.ndarray, needed: np.ndarray, n: int) -> np.ndarray:
    """How many of each query's lists, in the order `near`, to probe: n, or more until they hold the needed vectors."""
    held = np.cumsum(sizes[near], axis=1)
    return np.minimum(np.maximum(n, (held < needed[:, None]).sum(1) + 1), near.shape[1])


def _probes(model, sizes: np.ndarray, n: int, k: int):
    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, lists, _ = model.value
        step = max(1, _DISTANCES // len(sizes))
        for whole in batches:
            for rows in (whole.slice(a, step) for a in range(0, whole.num_rows, step)):
                near = list_order(_lifted(_matrix(rows.column("vec")), None) @ turn, lists, sizes)
                most = probed(near, sizes, k + rows.column("own").to_numpy(), n)
                read = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(most)).astype(np.int32)), pa.array(near[np.arange(near.shape[1])[None, :] < most[:, None]].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([rows.column("vec_id"), rows.column("vec"), read], names=["vec_id", "vec", "lists"])

    return probes


def adaptive_scan(x: np.ndarray, q: np.ndarray, barred: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of q, row of x) that may be among the k nearest of their query; `barred` pairs never are.

    Partial distances of all pairs are a matrix product while many pairs live, then sums over the living pairs alone.
    """
    n, d = len(x), x.shape[1]
    pairs = np.nonzero(~barred)
    if n <= 2 * k:
        return pairs
    x2, q2 = (x**2).sum(1), (q**2).sum(1)
    slack = 1e-5 * (q2 + x2.max())  # what single precision may lose
    partial = np.zeros((len(q), n), dtype=np.float32)
    blocks = [slice(a, min(a + _COLUMNS, d)) for a in range(0, d, _COLUMNS)]
    xs, qs = [np.ascontiguousarray(x[:, c]) for c in blocks], [np.ascontiguousarray(q[:, c]) for c in blocks]
    dense, bound = True, None
    for c, xc, qc in zip(blocks, xs, qs, strict=True):
        if dense:
            partial += (qc**2).sum(1)[:, None] + (xc**2).sum(1)[None, :] - 2 * (qc @ xc.T)
        else:
            i, j = pairs
            left = left + ((xc[j] - qc[i]) ** 2).sum(1)
        if bound is None:
            partial[barred] = np.inf
            near = np.argpartition(partial, 2 * k - 1, axis=1)[:, : 2 * k]
            whole = q2[:, None] + x2[near] - 2 * np.einsum("qkd,qd->qk", x[near], q)
            whole[np.take_along_axis(barred, near, 1)] = np.inf
            bound = np.partition(whole, k - 1, axis=1)[:, k - 1]
            stay = np.isfinite(whole) & (whole <= bound[:, None])
            sure = np.nonzero(stay)[0], near[stay]
        share = c.stop / d
        limit = bound * (share * (1 + _ERRORS / np.sqrt(c.stop)) ** 2 if c.stop < d else 1) + slack
        if dense:
            partial[partial > limit[:, None]] = np.inf
            alive = np.isfinite(partial)
            if c.stop == d or alive.sum() < alive.size / 8:
                pairs, dense = np.nonzero(alive), False
                left = partial[pairs]
        else:
            keep = left <= limit[i]
            pairs, left = (i[keep], j[keep]), left[keep]
    both = np.unique(np.concatenate([pairs[0] * n + pairs[1], sure[0] * n + sure[1]]))
    return both // n, both % n


def _search(model, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, _, most = model.value
        for group in C.sorted_groups(batches, ["list", "block", "part"]):
            is_query = group.column("is_query").to_numpy(zero_copy_only=False)
            if is_query.all() or not is_query.any():
                continue
            vec, ids = _matrix(group.column("vec")), group.column("vec_id").to_numpy()
            base, asked = vec[~is_query], vec[is_query]
            base_ids, query_ids = ids[~is_query], ids[is_query]
            x, q = (_lifted(base, most) @ turn).astype(np.float32), (_lifted(asked, None) @ turn).astype(np.float32)
            for a in range(0, len(q), _QUERIES):
                i, j = adaptive_scan(x, q[a : a + _QUERIES], query_ids[a : a + _QUERIES, None] == base_ids[None, :], k)
                i = i + a
                score = (base[j] * asked[i]).sum(1)
                order = np.lexsort((base_ids[j], -score, i))
                i, j, score = i[order], j[order], score[order]
                best = np.arange(len(i)) - np.searchsorted(i, i) < k
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[i[best]]), pa.array(base_ids[j[best]]), pa.array(score[best])], names=["query_id", "vec_id", "score"])

    return search


def valid_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, vec) of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vec")).where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull()).where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vec", lambda x: x != 0))
    size = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("vec") == (size["d"] if size else 0))


def nearest(table: DataFrame, queries: DataFrame, k: int = 20, recall: float = 0.97, block_rows: int = 4096, query_rows: int = 2048, coarse: int = COARSE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found, by inner product; both frames hold (vec_id, vec)."""
    spark = table.sparkSession
    whole = table.agg(F.count("*").alias("n"), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)).alias("most")).first()
    if not whole["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fitted = np.array([r["vec"] for r in table.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec").collect()])
    turn = rotation(fitted.shape[1] + 1)
    lists = fit_lists(_lifted(fitted, whole["most"]) @ turn, max(1, round(whole["n"] ** 0.5)), coarse)
    model = spark.sparkContext.broadcast((turn, lists, whole["most"]))
    placed = C.materialised(table.mapInArrow(_assign(model), "vec_id long, vec array<double>, list int"), "nearest-lists")
    sizes = np.zeros(len(lists[0]) * len(lists[1]), dtype=np.int64)
    for r in placed.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    probes = _tuned(placed, queries, model, sizes, k, recall)
    # rows that share a query's id are none of its candidates
    repeated = placed.groupBy("vec_id").count().where("count > 1").withColumnRenamed("count", "own")
    known = queries.join(repeated, "vec_id", "left").select("vec_id", "vec", F.coalesce("own", F.lit(1)).alias("own"))
    asked = known.mapInArrow(_probes(model, sizes, probes, k), "vec_id long, vec array<double>, lists array<int>").select("vec_id", "vec", F.explode("lists").alias("list"))
    blocks = placed.groupBy("list").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    parts = asked.groupBy("list").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("parts"))
    shape = C.checkpointed(blocks.join(parts, "list"))

    def spread(rows: DataFrame, own: str, other: str, own_n: str, other_n: str, is_query: bool) -> DataFrame:
        return rows.join(shape, "list").select("list", F.pmod(F.xxhash64("vec_id"), F.col(own_n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(other_n) - 1)).alias(other), F.lit(is_query).alias("is_query"), "vec_id", "vec")

    both = spread(placed, "block", "part", "blocks", "parts", False).unionByName(spread(asked, "part", "block", "parts", "blocks", True))
    found = both.repartition("list", "block", "part").sortWithinPartitions("list", "block", "part").mapInArrow(_search(model, k), "query_id long, vec_id long, score double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _tuned(placed: DataFrame, queries: DataFrame, model, sizes: np.ndarray, k: int, recall: float) -> int:
    """Lists to probe so that sampled queries find `recall` of their true neighbours."""
    sample = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(TUNING_QUERIES).collect()
    turn, lists, _ = model.value
    if not sample:
        return 1
    q = np.array([r["vec"] for r in sample])
    ids = np.array([r["vec_id"] for r in sample])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not rows.num_rows:
                continue
            score = q @ _matrix(rows.column("vec")).T
            vec_ids, at = rows.column("vec_id").to_numpy(), rows.column("list").to_numpy()
            score[ids[:, None] == vec_ids[None, :]] = -np.inf
            top = np.argsort(-score, axis=1)[:, :k]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(q)), top.shape[1])), pa.array(np.take_along_axis(score, top, 1).ravel()), pa.array(at[top.ravel()])], names=["i", "score", "list"])

    best = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("score")))
    rows = placed.mapInArrow(exact, "i long, score double, list int").withColumn("r", best).where(F.col("r") <= k).collect()
    holding: dict[int, list[int]] = {}
    for r in rows:
        holding.setdefault(r["i"], []).append(r["list"])
    need = np.sort([p for i, held in holding.items() for p in np.argsort(list_order(_lifted(q[i : i + 1], None) @ turn, lists, sizes)[0])[held]])
    return int(need[min(len(need) - 1, int(np.ceil(recall * len(need))))]) + 1 if len(need) else 1
