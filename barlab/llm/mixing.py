"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets share all words by source weight, none above `most` times its source's words. The mix is counted in seats of
`block` words: sources get seats by the highest quotients target/(2k+1), and the shards of a source get its seats in the
same way by their words, in two levels (groups of `group_shards` shards, then the shards of a group). A source has as
many shards as its own words need. A shard lays its documents in a seeded order end to end and takes as many words as it
has seats for: whole rounds of all of it, and the rest as the blocks with the smallest seeded hashes, the last of them
cut to fit. So a source misses its target by half a seat, and by less than a seat per shard where it takes `most` times
all it has.

Rows with one id and one text are counted before they are dealt and dealt in parts of a shard's size, so neither a
source with any share of the corpus nor a text with any number of copies makes a large group. The driver sees one row
per source and one per group of shards (2^30 words).

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a source without words has
target 0; repeated rows count as separate documents; a null id is the smallest; an empty table gives an empty mix.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.llm import common as C

WEIGHTS = (5, 2, 1)


def targets(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Shares of sum(sizes) by weight, each at most `most` times its own size; what is cut is shared again by weight."""
    total, out = float(sum(sizes)), [0.0] * len(sizes)
    free = [i for i in range(len(sizes)) if sizes[i] > 0]
    for i in set(range(len(sizes))) - set(free):
        out[i] = 0.0
    left = total
    while free:
        unit = left / sum(weights[i] for i in free)
        above = [i for i in free if unit * weights[i] > most * sizes[i]]
        if not above:
            for i in free:
                out[i] = unit * weights[i]
            break
        for i in above:
            out[i] = float(most * sizes[i])
            left -= out[i]
        free = [i for i in free if i not in above]
    return out


def sainte_lague(weights: np.ndarray, seats: int, caps: np.ndarray | None = None) -> np.ndarray:
    """Seats by highest quotients w/(2k+1), at most caps[i] each; equal quotients go to the earlier index."""
    weights = np.asarray(weights, dtype=np.float64)
    caps = np.full(len(weights), seats, dtype=np.int64) if caps is None else np.where(weights > 0, caps, 0)
    seats = int(min(seats, caps[weights > 0].sum()))
    if seats <= 0:
        return np.zeros(len(weights), dtype=np.int64)

    def won(q: float) -> np.ndarray:
        return np.minimum(np.floor((weights / q + 1) / 2), caps).astype(np.int64)

    lo, hi = weights[weights > 0].min() / (4.0 * seats + 4), weights.max() * 2  # won(hi) is none; won(lo) is enough
    for _ in range(200):
        mid = (lo + hi) / 2
        if won(mid).sum() > seats:
            lo = mid
        else:
            hi = mid
    out = won(hi)
    heap = [(-weights[i] / (2 * out[i] + 1), i) for i in np.flatnonzero((weights > 0) & (out < caps)).tolist()]
    heapq.heapify(heap)
    for _ in range(seats - int(out.sum())):
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * out[i] + 1), i))
    return out


def _quotas(block: int, most: int):
    def quotas(rows: pd.DataFrame) -> pd.DataFrame:
        """Seats of the shards of one group, from the group's seats."""
        rows = rows.sort_values("shard", ignore_index=True)
        words = rows["words"].to_numpy()
        return rows[["at", "shard"]].assign(quota=sainte_lague(words, int(rows["seats"].iloc[0]), -(-most * words // block)))

    return quotas


def _hash(values: np.ndarray, seed: int) -> np.ndarray:
    return C.mix(values.astype(np.int64).view(np.uint64) + np.uint64(C.mix_int(seed)))


def _runs(lo: np.ndarray, hi: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans [lo, hi) of documents `of`, in order, with those that touch made one."""
    if not len(of):
        return lo, hi, of
    new = np.append(True, (of[1:] != of[:-1]) | (lo[1:] != hi[:-1]))
    first = np.flatnonzero(new)
    return lo[first], hi[np.append(first[1:], len(of)) - 1], of[first]


def _take(block: int, most: int, seed: int):
    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in C.sorted_groups(batches, ["at", "shard"]):
            t = group.combine_chunks()
            ids, h, part, copies = (t.column(c).to_numpy() for c in ("_id", "_h", "part", "copies"))
            order = np.lexsort((part, h, ids, _hash(ids, seed) ^ C.mix(h.view(np.uint64) + part.astype(np.uint64))))
            order = np.repeat(order, copies[order])
            size = t.column("size").to_numpy()[order]
            end = np.cumsum(size)
            start, total = end - size, int(end[-1])
            rounds, rest = divmod(min(int(t.column("quota")[0].as_py() or 0) * block, most * total), total) if total else (0, 0)
            use = np.zeros(-(-total // block) + 1, dtype=np.int64)
            if rest:
                words = np.minimum(block, total - block * np.arange(len(use) - 1))
                key = _hash(np.arange(len(words), dtype=np.int64) + int(t.column("shard")[0].as_py()) * 1_000_003 + int(t.column("at")[0].as_py()) * 7_919, seed + 1)
                chosen = np.argsort(key, kind="stable")
                before = np.cumsum(words[chosen]) - words[chosen]
                use[chosen] = np.clip(rest - before, 0, words[chosen])
            first = start // block
            n = np.where(size > 0, (end - 1) // block - first + 1, 0)
            b, of = C.ranges(first, n), np.repeat(np.arange(len(n)), n)
            lo, hi = np.maximum(b * block, start[of]) - start[of], np.minimum(b * block + use[b], end[of]) - start[of]
            some = hi > lo
            lo, hi, of = _runs(lo[some], hi[some], of[some])
            taken = rounds * size + np.bincount(of, weights=hi - lo, minlength=len(n)).astype(np.int64)
            spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(n) + 1)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(lo), pa.array(hi)], names=["a", "b"]))
            yield pa.RecordBatch.from_arrays([pa.array(ids[order]), pa.array(h[order]), t.column("at").combine_chunks().take(pa.array(order)), pa.array(size), pa.array(taken), pa.array(np.full(len(n), rounds, dtype=np.int32)), spans], names=["_id", "_h", "at", "size", "taken", "rounds", "spans"])

    return take


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = 3, block: int = 64, shard_words: int = 1 << 20, group_shards: int = 1 << 10, seed: int = 11) -> DataFrame:
    """(_id, _h, source, size, source_size, target, taken, rounds, spans) for every row.

    The row gives its whole text `rounds` times and its words [a, b) for each of `spans`.
    """
    spark = docs.sparkSession
    size = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(C.WORD_PATTERN)).cast("long")
    row = docs.select(C.row_id().alias("_id"), C.text_hash().alias("_h"), F.col("source").cast("string").alias("source"), size.alias("size"))
    sized = C.materialised(row.groupBy("_id", "_h", "source", "size").agg(F.count("*").alias("copies")), "mix-sizes")
    totals = [(r["source"], int(r["words"]), int(r["rows"])) for r in sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("words"), F.sum("copies").alias("rows")).collect()]  # one row per source
    totals.sort(key=lambda x: (x[0] is None, x[0] or ""))
    goal = targets([n for _, n, _ in totals], [weights[i % len(weights)] for i in range(len(totals))], most)
    seats = sainte_lague(np.array(goal), round(sum(goal) / block)) if totals else np.zeros(0, np.int64)
    table = spark.createDataFrame([(s, i, n, float(g), max(1, (n + rows) // shard_words)) for i, ((s, n, rows), g) in enumerate(zip(totals, goal, strict=True))], "source string, at int, source_size long, target double, shards long")
    same = F.col("l.source").eqNullSafe(F.col("r.source"))
    each = F.greatest(F.lit(1), F.floor(F.lit(shard_words) / F.greatest("size", F.lit(1)))).cast("long")  # copies of a text that go together
    parts = sized.alias("l").join(table.alias("r"), same).select("_id", "_h", "at", "size", "copies", "shards", each.alias("each")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / F.col("each")))))
    dealt = parts.select("_id", "_h", "at", "size", "part", F.least("each", F.col("copies") - F.col("part") * F.col("each")).alias("copies"), F.pmod(F.xxhash64("_id", "_h", "part", F.lit(seed)), F.col("shards")).alias("shard"))
    words = C.checkpointed(dealt.groupBy("at", "shard").agg(F.sum(F.col("size") * F.col("copies")).alias("words")).withColumn("band", F.floor(F.col("shard") / group_shards)))
    bands = sorted(tuple(r) for r in words.groupBy("at", "band").agg(F.sum("words").alias("words")).collect())  # one row per group of shards
    given = []
    for i, n in enumerate(seats.tolist()):
        own = [(b, w) for a, b, w in bands if a == i]
        w = np.array([w for _, w in own], dtype=np.int64)
        given += [(i, b, int(x)) for (b, _), x in zip(own, sainte_lague(w, n, -(-most * w // block)).tolist(), strict=True)]
    quota = words.join(spark.createDataFrame(given, "at int, band long, seats long"), ["at", "band"]).groupBy("at", "band").applyInPandas(_quotas(block, most), "at int, shard long, quota long")
    took = dealt.join(quota, ["at", "shard"]).repartition("at", "shard").sortWithinPartitions("at", "shard").mapInArrow(_take(block, most, seed), "_id long, _h long, at int, size long, taken long, rounds int, spans array<struct<a: long, b: long>>")
    return took.join(table, "at").select("_id", "_h", "source", "size", "source_size", "target", "taken", "rounds", "spans")
