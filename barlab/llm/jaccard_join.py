"""N-gram Jaccard join by chosen paths.

A document's set holds the 64-bit hashes of its k-word shingles (a text with 1 to k-1 words has one shingle, all of
it). Documents with the same set form one class of copies and are represented once.

Each run draws a hash of every shingle and sends a set to the shingles whose draw is below 1/(t*size), 1/t of them on
average, so a pair with similarity t or more shares at least one of them with probability 1-1/e or more. A bucket that
stays large is split again on its members' own further draws; small ones are compared by brute force. Near copies draw
the same shingles, so splitting does not part them: a large bucket of which nearly all members are like its first sets
is left to the exact check as one group, at whatever level. The number of runs is what brings the chance that a pair at
the threshold meets in some run, at the deepest level, to the target recall.

Inside a bucket, sets are compared by 64 one-byte minhashes, and only one link per set is kept: enough to know which
sets may belong together. The exact check then compares whole shingle sets, all pairs of a connected group, in blocks
of bounded size, so that groups of any size are counted without ever listing their pairs.

Defined cases: null and empty texts have no shingles, link to nothing and are their own class; a null id is the
smallest; repeated rows are copies of each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlab.llm import common as C

MINHASHES = 64
#: Of 64 minhashes; a pair at 0.8 agrees in 51 on average and in fewer than this with a chance of about 1e-6.
LEAST_AGREEING = 36
#: The share of a large bucket that must be like one of its first sets, those being connected, for the bucket to be one group.
NEARLY_ALL, FIRST_SETS = 0.8, 8
_SIGNED = np.int64


def runs_for(recall: float, depth: int) -> int:
    """Runs after which a pair at the threshold has met with probability `recall`, when its buckets split `depth` times.

    Each level gives a pair one shared draw on average: p(d) = 1 - exp(-p(d-1)), as for a branching process.
    """
    p = 1.0
    for _ in range(depth):
        p = 1 - math.exp(-p)
    return math.ceil(math.log(1 - recall) / math.log(1 - p))


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, concatenated, and where each text's begin."""
    lower = buf + np.where((buf >= 65) & (buf <= 90), np.uint8(32), np.uint8(0))
    words = C.Words(lower, offsets)
    hashes = C.Prefix(lower).slices(words.starts, words.ends)
    at, text = C.window_starts(words.first, k)
    values = C.window_hashes(hashes, k)[at] if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(short):
        whole = [C.mix_int(int(np.add.reduce(hashes[words.first[i] : words.first[i + 1]] * C._powers(k + 2)[0][1 : words.counts[i] + 1], dtype=np.uint64)) + int(words.counts[i])) for i in short.tolist()]
        values, text = np.append(values, np.array(whole, np.uint64)), np.append(text, short)
    out, first = [], np.zeros(len(offsets), dtype=np.int64)
    order = np.argsort(text, kind="stable") if len(short) else slice(None)
    values, text = values[order], text[order]
    cuts = np.searchsorted(text, np.arange(len(offsets)))
    for i in range(len(offsets) - 1):
        u = np.unique(values[cuts[i] : cuts[i + 1]])
        out.append(u)
        first[i + 1] = first[i] + len(u)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), first


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(_SIGNED)


def _sum_per(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return sums[first[1:]] - sums[first[:-1]]


def minhashes(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One byte of the smallest of 64 hashes of each non-empty set."""
    full = np.flatnonzero(np.diff(first) > 0)
    out = np.zeros((len(first) - 1, MINHASHES), dtype=np.uint8)
    if not len(full):
        return out
    low = (values >> np.uint64(32)).astype(np.uint32)
    rng = np.random.default_rng(5)
    for j, (a, b) in enumerate(rng.integers(1, 1 << 32, (MINHASHES, 2), dtype=np.uint64)):
        drawn = low * np.uint32(a | 1) + np.uint32(b)
        drawn ^= drawn >> np.uint32(15)
        least = np.minimum.reduceat(drawn * np.uint32(0x2C1B3C6D), first[full])
        out[full, j] = (least * np.uint32(0x9E3779B1)) >> np.uint32(24)
    return out


def _draws(values: np.ndarray, node: int) -> np.ndarray:
    """Uniform 64-bit numbers: the draw of each shingle at a node."""
    drawn = values * np.uint64(C.mix_int(node) | 1)
    drawn ^= drawn >> np.uint64(32)
    drawn *= np.uint64(0xD6E8FEB86659FD93)
    return drawn


def _limits(size: np.ndarray, threshold: float) -> np.ndarray:
    """Draws below this choose a shingle of a set of this size: one in threshold * size, all where that is under one."""
    return np.minimum(2.0**64 / (threshold * np.maximum(size, 1)), 2.0**64 - 2048).astype(np.uint64)


def _sets(k: int, threshold: float, runs: int):
    seeds = [C.mix_int(1000 + r) for r in range(runs)]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offsets in C.text_chunks(batches):
            values, first = shingle_sets(buf, offsets, k)
            size = np.diff(first)
            k1, k2 = _sum_per(C.mix(values), first), _sum_per(C.mix(values ^ np.uint64(0x5851F42D4C957F2D)), first)
            limit = np.repeat(_limits(size, threshold), size)
            of = np.repeat(np.arange(len(size)), size)
            nodes, owner = [], []
            for s in seeds:
                hit = np.flatnonzero(_draws(values, s) < limit)
                nodes.append(C.mix(values[hit] + np.uint64(s)))
                owner.append(of[hit])
            nodes, owner = np.concatenate(nodes), np.concatenate(owner)
            order = np.argsort(owner, kind="stable")
            starts = np.searchsorted(owner[order], np.arange(len(size) + 1)).astype(np.int32)
            sketch = minhashes(values, first)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("_id"), rows.column("_h"), pa.array(_signed(C.mix(k1 + size.astype(np.uint64)))), pa.array(_signed(k2)), pa.array(size.astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(starts), pa.array(_signed(nodes[order]))),
                    pa.array([r.tobytes() for r in sketch], pa.binary()),
                ],
                names=["_id", "_h", "v", "k2", "n", "nodes", "sketch"],
            )

    return sets


def _deeper(k: int, threshold: float):
    """Children of large buckets: each member draws again among its shingles, at the node."""

    def deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offsets in C.text_chunks(batches):
            values, first = shingle_sets(buf, offsets, k)
            out_v, out_n = [], []
            for i, (v, nodes) in enumerate(zip(rows.column("v").to_pylist(), rows.column("nodes").to_pylist(), strict=True)):
                own = values[first[i] : first[i + 1]]
                for node in nodes:
                    x = node & 0xFFFFFFFFFFFFFFFF
                    hit = own[_draws(own, x) < _limits(np.array([len(own)]), threshold)[0]]
                    out_v += [v] * len(hit)
                    out_n.append(C.mix(hit + np.uint64(x)))
            child = _signed(np.concatenate(out_n)) if out_n else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(out_v, pa.int64()), pa.array(child)], names=["v", "node"])

    return deeper


def _labels(adjacent: np.ndarray) -> np.ndarray:
    """The smallest index that each row reaches."""
    label = np.arange(len(adjacent))
    while True:
        new = np.where(adjacent, label[None, :], len(label)).min(axis=1)
        new = np.minimum(new, label)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _bucket_links(threshold: float):
    """Links of a small bucket: one edge from each set to the first set that it may be connected with."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for group in C.sorted_groups(batches, ["node"]):
            if group.num_rows < 2:
                continue
            v = group.column("v").to_numpy()
            n = group.column("n").to_numpy()
            sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(-1, MINHASHES)
            if len(v) == 2:
                if (sketch[0] == sketch[1]).sum() >= LEAST_AGREEING:
                    a.append(v[0])
                    b.append(v[1])
                continue
            near = np.zeros((len(v), len(v)), dtype=np.uint8)
            for j in range(MINHASHES):
                near += sketch[:, j, None] == sketch[None, :, j]
            fits = np.minimum(n[:, None], n[None, :]) >= threshold * np.maximum(n[:, None], n[None, :]) - 1e-9
            label = _labels((near >= LEAST_AGREEING) & fits)
            own = np.flatnonzero(label != np.arange(len(v)))
            a += v[own].tolist()
            b += v[label[own]].tolist()
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return links


def _near(threshold: float):
    """Of each large bucket's rows in a batch: how many, and how many may link to the largest connected part of the bucket's first sets."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            nodes, at = np.unique(b.column("node").to_numpy(), return_inverse=True)
            close = np.zeros(len(nodes), np.int64)
            for i in range(len(nodes)):
                rows = np.flatnonzero(at == i)
                own, n = _sketches(b.column("sketch").take(pa.array(rows))), b.column("n").to_numpy()[rows]
                first = b.column("first")[int(rows[0])].values
                firsts, m = _sketches(first.field("sketch")), first.field("n").to_numpy()
                label = _labels(_may_link(firsts, m, firsts, m, threshold))
                part = label == np.bincount(label).argmax()
                close[i] = _may_link(own, n, firsts[part], m[part], threshold).any(1).sum()
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.bincount(at)), pa.array(close)], names=["node", "rows", "near"])

    return near


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, MINHASHES)


def _may_link(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    """Which sets of the first sketches and sizes may link to which of the second."""
    agreeing = np.stack([(a == x).sum(1) for x in b], axis=1)
    return (agreeing >= LEAST_AGREEING) & (np.minimum(n[:, None], m[None, :]) >= threshold * np.maximum(n[:, None], m[None, :]) - 1e-9)


def _alike(hot: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """The large buckets whose members may nearly all link to the same of the bucket's first sets; keys are salted."""
    sets = reps.select("v", "n", "sketch")
    place = F.row_number().over(Window.partitionBy("node").orderBy("v"))
    first = hot.withColumn("place", place).where(F.col("place") <= FIRST_SETS).join(sets, "v").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("v", "n", "sketch"))).alias("first"))
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(31))))
    rows = hot.join(sets, "v").withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(32)).cast("int")).join(first, ["node", "salt"])
    counted = rows.select("node", "n", "sketch", "first").mapInArrow(_near(threshold), "node long, rows long, near long")
    return counted.groupBy("node").agg(F.sum("rows").alias("rows"), F.sum("near").alias("near")).where(F.col("near") >= NEARLY_ALL * F.col("rows")).select("node")


def _shared(values: np.ndarray, first: np.ndarray, rows: int) -> np.ndarray:
    """The number of common values of each of the first `rows` sets with each set; memory stays bounded for long sets."""
    m = len(first) - 1
    if m == 2 and rows == 1:
        return np.array([[first[1], len(np.intersect1d(values[: first[1]], values[first[1] :], assume_unique=True))]])
    of = np.repeat(np.arange(m), np.diff(first))
    order = np.argsort(values, kind="stable")
    sorted_values, of = values[order], of[order]
    new = np.append(True, sorted_values[1:] != sorted_values[:-1])
    term = np.cumsum(new) - 1
    often = np.bincount(term)[term] > 1
    term, of = term[often], of[often]
    out = np.zeros((rows, m), dtype=np.float32)
    if len(term):
        term = np.cumsum(np.append(True, term[1:] != term[:-1])) - 1
        width = max(1, (8 << 20) // m)
        for lo in range(0, int(term[-1]) + 1, width):
            i, j = np.searchsorted(term, [lo, lo + width])
            dense = np.zeros((m, min(width, int(term[-1]) + 1 - lo)), dtype=np.float32)
            dense[of[i:j], term[i:j] - lo] = 1
            out += dense[:rows] @ dense.T
    return np.rint(out).astype(np.int64)


def _verify(k: int, threshold: float):
    """Exact links of a block pair of a connected group: per set, the rows that it links to, and edges that connect them."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in C.sorted_groups(batches, ["root", "i", "j"]):
            t = group.combine_chunks().sort_by([("side", "ascending"), ("v", "ascending")])
            v = t.column("v").to_numpy()
            if (v[1:] == v[:-1]).any():  # repeated rows of one document
                t = t.take(np.flatnonzero(np.append(True, v[1:] != v[:-1])))
                v = t.column("v").to_numpy()
            cross = group.column("i")[0].as_py() != group.column("j")[0].as_py()  # pairs between two blocks, or within one
            copies, side = t.column("copies").to_numpy(), t.column("side").to_numpy()
            rows = int((side == 0).sum())
            if cross and rows in (0, len(v)):
                continue
            col = t.column("_text").combine_chunks()
            buf, offsets = C.text_buffer(col)
            values, first = shingle_sets(buf, offsets, k)
            n = np.diff(first)
            common = _shared(values, first, rows if cross or len(v) > 2 else 1)
            common = common[:, rows:] if cross else common
            left, right = (np.arange(rows), np.arange(rows, len(v))) if cross else (np.arange(common.shape[0]), np.arange(len(v)))
            linked = common >= threshold * (n[left][:, None] + n[right][None, :] - common) - 1e-9
            if not cross:
                linked[left, left] = False
                if common.shape[0] < len(v):
                    linked = np.array([[False, linked[0, 1]], [linked[0, 1], False]])
                label = _labels(linked)
                links = linked @ copies
            else:
                whole = np.zeros((len(v), len(v)), dtype=bool)
                whole[:rows, rows:] = linked
                whole[rows:, :rows] = linked.T
                label = _labels(whole)
                links = np.concatenate([linked @ copies[rows:], copies[:rows] @ linked])
            ids, h = t.column("_id").combine_chunks(), t.column("_h").combine_chunks()
            first = pa.array(label)
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(links.astype(np.int64)), ids, h, ids.take(first), h.take(first)], names=["v", "links", "_id", "_h", "b_id", "b_h"])

    return verify


def jaccard_join(docs: DataFrame, k: int = 5, threshold: float = 0.8, recall: float = 0.999, depth: int = 4, bucket_limit: int = 256, block_limit: int = 256) -> DataFrame:
    """(_id, _h, class_id, class_h, n_links, n_shingles) for every row.

    class_id: the smallest id of the rows that are connected by links (similarity of threshold or more, copies
    included), class_h: the smallest _h of its rows of that id, so the pair names one document where ids repeat; n_links: the number of other rows that the row itself links to.
    """
    keyed = C.keyed_documents(docs)
    runs = runs_for(recall, depth)
    sigs = C.materialised(keyed.mapInArrow(_sets(k, threshold, runs), "_id long, _h long, v long, k2 long, n int, nodes array<long>, sketch binary"), "jaccard-sets")
    classes = C.materialised(
        sigs.where("n > 0").groupBy("v", "k2").agg(F.count("*").alias("copies"), F.min(F.struct("_id", "_h")).alias("rep")), "jaccard-classes"
    )
    reps = sigs.where("n > 0").join(classes.select("v", "k2", "rep._id", "rep._h"), ["v", "k2", "_id", "_h"], "left_semi").dropDuplicates(["v"]).select("v", "n", "nodes", "sketch")
    member = reps.select("v", F.explode("nodes").alias("node"))
    small, whole, deep = [], [], 0
    while True:
        deep += 1
        counts = member.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
        counts = C.checkpointed(counts)
        small.append(member.join(counts.where(F.col("size") <= bucket_limit).select("node"), "node", "left_semi"))
        large = counts.where(F.col("size") > bucket_limit).select("node")
        if large.isEmpty():
            break
        hot = C.checkpointed(member.join(large, "node", "left_semi"))
        if deep == depth:  # still large after the last split
            whole.append(hot)
            break
        alike = C.checkpointed(_alike(hot, reps, threshold))
        whole.append(hot.join(alike, "node", "left_semi"))
        hot = hot.join(alike, "node", "left_anti")
        if hot.isEmpty():
            break
        at = hot.groupBy("v").agg(F.collect_list("node").alias("nodes")).join(classes.select("v", "rep"), "v").select("v", "nodes", F.col("rep._id").alias("_id"), F.col("rep._h").alias("_h"))
        member = C.materialised(keyed.join(at, ["_id", "_h"]).select("_text", "v", "nodes").mapInArrow(_deeper(k, threshold), "v long, node long").distinct(), "jaccard-deeper")
    buckets = small[0]
    for x in small[1:]:
        buckets = buckets.unionByName(x)
    edges = buckets.join(reps.select("v", "n", "sketch"), "v").repartition("node").sortWithinPartitions("node").mapInArrow(_bucket_links(threshold), "a long, b long")
    for hot in whole:  # left to the exact check as one group
        first = hot.groupBy("node").agg(F.min("v").alias("b")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(31))))
        edges = edges.unionByName(hot.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(32)).cast("int")).join(first, ["node", "salt"]).select(F.col("v").alias("a"), "b"))
    groups = C.checkpointed(C.components(edges))

    # only groups of several blocks are joined back, by salted keys; all others are one block
    several = groups.groupBy("root").agg(F.ceil(F.count("*") / F.lit(block_limit)).cast("int").alias("blocks")).where("blocks > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(31))))
    where = groups.withColumn("salt", F.pmod(F.xxhash64("v", F.lit(1)), F.lit(32)).cast("int")).join(several, ["root", "salt"], "left").select("v", "root", F.coalesce("blocks", F.lit(1)).alias("blocks")).withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = classes.select("v", "copies", "rep").join(where, "v").select("v", "copies", F.col("rep._id").alias("_id"), F.col("rep._h").alias("_h"), "root", "block", "blocks")
    texts = keyed.join(placed, ["_id", "_h"]).withColumn("other", other).select("v", "copies", "_id", "_h", "_text", "root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"))
    checked = C.materialised(texts.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(_verify(k, threshold), "v long, links long, _id long, _h long, b_id long, b_h long"), "jaccard-links")
    # vertices are ordered as documents are, so that a root is its class's smallest document
    final = C.components(checked.select(F.struct("_id", "_h").alias("a"), F.struct(F.col("b_id").alias("_id"), F.col("b_h").alias("_h")).alias("b")))
    per = (
        classes.select("v", "k2", "copies", "rep")
        .join(checked.groupBy("v").agg(F.sum("links").alias("links")), "v", "left")
        .join(final.withColumnRenamed("v", "rep"), "rep", "left")
        .select("v", "k2", F.coalesce("root", "rep").alias("first"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
        .select("v", "k2", F.col("first._id").alias("class_id"), F.col("first._h").alias("class_h"), "n_links")
    )
    return sigs.select("_id", "_h", "v", "k2", "n").join(per, ["v", "k2"], "left").select("_id", "_h", F.coalesce("class_id", "_id").alias("class_id"), F.coalesce("class_h", "_h").alias("class_h"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("n").cast("long").alias("n_shingles"))
