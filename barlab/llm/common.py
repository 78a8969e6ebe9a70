"""Shared parts of the text operators: byte kernels on Arrow columns, bucket exchange, shared-folder tables.

Words are the maximal runs of bytes outside 0x20 and 0x09-0x0D of the UTF-8 text, that is `[^\\x20\\x09-\\x0D]+`.
The kernels work on the concatenated bytes of many texts at once, so that no Python code runs per character or word.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel handles at once; a longer text is handled alone.
CHUNK_BYTES = 2 << 20

_SEP = np.zeros(256, dtype=bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_POWERS: dict[str, tuple[np.ndarray, np.ndarray]] = {}

WORD_PATTERN = r"[^\x20\x09-\x0D]+"


# ---------------------------------------------------------------- tables in the shared folder


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where that is unset and all runs on one machine."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="barlab-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of a narrow frame; Spark removes the files once the frame is collected as garbage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def materialised(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as compressed Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Stands for a null id, as the smallest; original_id gives the null back.
NO_ID = -(1 << 63)


def row_id(id_col: str = "doc_id"):
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))


def text_hash(text_col: str = "text"):
    """64 bits that tell the texts of one id apart."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def keyed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _h, _text): the row's identity and its text.

    A null id counts as the smallest id. Rows that share an id are told apart by their text's 64-bit hash, and rows that
    also share the text get one and the same result. A null text is empty.
    """
    return docs.select(row_id(id_col).alias("_id"), text_hash(text_col).alias("_h"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))


def original_id(col: str = "_id"):
    return F.when(F.col(col) != F.lit(NO_ID), F.col(col))


# ---------------------------------------------------------------- byte kernels


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; the table of the largest usual chunk is kept."""
    if "table" not in _POWERS or len(_POWERS["table"][0]) < n:
        size = -(-n // (1 << 20)) << 20
        both = []
        for p in (_P, _P_INV):
            a = np.full(size, p, dtype=np.uint64)
            a[0] = 1
            both.append(np.multiply.accumulate(a, out=a))
        if size > 2 * CHUNK_BYTES:
            return both[0], both[1]
        _POWERS["table"] = (both[0], both[1])
    return _POWERS["table"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def mix_int(x: int) -> int:
    return int(mix(np.array([x & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64))[0])


class Prefix:
    """Hashes of any slices of a byte buffer from one pass of prefix sums (mod 2^64)."""

    def __init__(self, buf: np.ndarray):
        self.up, self.down = _powers(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, dtype=np.uint64)
        self.sums[1:] = buf
        self.sums[1:] += np.uint64(1)
        self.sums[1:] *= self.up[: len(buf)]
        np.cumsum(self.sums, out=self.sums)

    def slices(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its offsets, without a copy; nulls must have been replaced."""
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        width = np.int64
    else:
        width = np.int32
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=width)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def release() -> None:
    """Give freed memory back to the system, so that a reused worker doesn't carry one stage's peak into the next."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def text_chunks(batches: Iterable[pa.RecordBatch], column: str = "_text", size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of about `size` bytes of text each."""
    for batch in batches:
        n, at = batch.num_rows, 0
        if not n:
            continue
        buf, offsets = text_buffer(batch.column(batch.schema.get_field_index(column)))
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
            to = min(to, n)
            yield batch.slice(at, to - at), buf[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to
        release()


class Words:
    """Word boundaries of many texts: starts, ends (bytes), first[i]..first[i+1] are the words of text i."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        word = ~_SEP[buf]
        edge = np.zeros(len(buf) + 1, dtype=bool)
        edge[offsets] = True
        before = np.empty(len(buf), dtype=bool)
        if len(buf):
            before[0] = False
            before[1:] = word[:-1]
            before[edge[:-1]] = False
        self.starts = np.flatnonzero(word & ~before)
        after = np.empty(len(buf), dtype=bool)
        if len(buf):
            after[-1] = False
            after[:-1] = word[1:]
            after[edge[1:]] = False
        self.ends = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def texts(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive values; position i holds the window that starts there (len - k + 1 of them)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += words[j : j + n]
    return mix(out)


def window_starts(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a window of k words lies within one text, and the text of each."""
    n = np.maximum(np.diff(first) - k + 1, 0)
    text = np.repeat(np.arange(len(n)), n)
    local = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return first[:-1][text] + local, text


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(s, s + l)."""
    total = int(lengths.sum())
    out = np.arange(total, dtype=np.int64)
    return out + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


# ---------------------------------------------------------------- grouped rows of a sorted partition


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of a partition that was repartitioned by `keys` and sorted by them, over batch borders."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(n, dtype=bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), n]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in cols)
            if held and key != held_key:
                yield pa.Table.from_batches(held)
                held = []
            held_key = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
    release()


def components(edges: DataFrame, a: str = "a", b: str = "b", salts: int = 32) -> DataFrame:
    """(v, root) for every vertex of the undirected edges, of any type with an order; root is the smallest vertex of its component.

    Alternating large-star and small-star steps: O(log n) rounds of groupings and joins on narrow rows, each round cut by
    a checkpoint in the shared folder. Only vertices whose edges change take part in a join: those between two others in
    a large-star step, those with several smaller neighbours in a small-star step. So a finished star, which a component
    of any size ends as, is never gathered at its centre, and the edges of the others are dealt by `salts` keys a vertex.
    """
    salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("s")
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("w")).where("u != w").distinct()
    pairs = checkpointed(pairs)
    seen = None
    while True:
        low = pairs.groupBy("u").agg(F.min("w").alias("m"))
        between = low.join(pairs.select(F.col("w").alias("u")).distinct(), "u").select(F.col("u").alias("w"), "m", salt)
        large = pairs.withColumn("s", F.pmod(F.xxhash64("u"), F.lit(salts)).cast("int")).join(between, ["w", "s"], "left").select("u", F.coalesce("m", "w").alias("w")).distinct()
        low = large.groupBy("u").agg(F.min("w").alias("m"), F.count("*").alias("n"))
        several = low.where("n > 1").select("u", "m", salt)
        small = large.withColumn("s", F.pmod(F.xxhash64("w"), F.lit(salts)).cast("int")).join(several, ["u", "s"]).where("w != m").select(F.col("w").alias("u"), F.col("m").alias("w"))
        pairs = checkpointed(small.unionByName(low.select("u", F.col("m").alias("w"))).distinct())
        # finished once no pair changes any more
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "w").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = pairs.select(F.col("u").alias("v"), F.col("w").alias("root"))
    return roots.unionByName(pairs.select(F.col("w").alias("v"), F.col("w").alias("root")).distinct())
