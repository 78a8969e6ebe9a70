"""LM scoring by a probabilistic suffix tree.

A text is a sequence of tokens: its words, A-Z lower-cased, and one end. The tree's symbols are the bytes that spell
the tokens: each word's bytes and a space, and a newline for the end, so every sequence of tokens has a probability,
known words or not, and the probabilities of all sequences sum to one.

Contexts of up to `order` bytes are counted over all training texts. A context is a candidate where it occurs `least`
times, however large the corpus, so the tree grows with it; a candidate of more than two bytes is retained where its
next-symbol distribution diverges from its parent's by more than its extra parameters cost, or an extension of it is
retained. Distributions are smoothed towards the parent's by the number of distinct next symbols. A symbol's probability
is that of its longest retained suffix, so it follows from the window of its order + 1 last bytes alone.

The tree is never in one place. A block of texts sends each of its distinct windows once, with its count in the block's
training texts, to a shard by the three bytes before the symbol. A shard builds its part of the tree from these windows
and sends back the probability of each. Only the counts of windows of three bytes, whose number the alphabet bounds (256^3,
270 MB), are known to all shards.

A context to which blocks send more than `hot_windows` windows in all is split by the byte before it, and again, up to the
order. The parts need that context's own counts, which go along as a table, and to know whether it is retained: only
contexts that diverge by themselves are split, as what their extensions do then no longer matters. At most 65,536 of a
length are split, those with the most windows, so the table has 256 rows for each of these at most (268 MB).

The unigram base needs the exact count of every token, and the vocabulary grows with the corpus: a block of some
megabytes of texts sends each of its distinct tokens once, with its count in the block, to the token's bucket, and gets
back the counts over all texts. What belongs to single documents stays with the block, one row, and is never dealt by
token.

Defined cases: a null text is empty and has one token, the end; a null id is not held out, so it is learned from; repeated rows are
scored alike and each is learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.llm import common as C

ORDER = 6
LEAST = 8
#: Text of a block; its distinct windows cost the less a byte the larger it is.
BLOCK_BYTES = 8 << 20
END = 10
#: Buckets from this one on hold windows, those below it tokens; from the second one on they are parts of split contexts, SPLIT a shard.
_SHARDS, _DEEP, SPLIT = 1 << 20, 1 << 26, 64
#: Windows that blocks send for one context before it is split, and contexts of a length that may be.
HOT_WINDOWS, MOST_HOT = 1 << 20, 1 << 16


def tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spelled bytes, the offset of each token in them, and the first token of each text."""
    lower = buf + np.where((buf >= 65) & (buf <= 90), np.uint8(32), np.uint8(0))
    words = C.Words(lower, offsets)
    n = len(offsets) - 1
    length = words.ends - words.starts
    first = words.first + np.arange(n + 1)
    size = np.ones(len(length) + n, dtype=np.int64)
    is_word = np.ones(len(size), dtype=bool)
    is_word[first[1:] - 1] = False
    size[is_word] = length + 1
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.full(int(at[-1]), 32, dtype=np.uint8)
    out[at[first[1:] - 1]] = END
    out[C.ranges(at[:-1][is_word], length)] = lower[C.ranges(words.starts, length)]
    return out, at, first


# ---------------------------------------------------------------- the tree


def _add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a sorted array and the sums of their counts."""
    if not len(keys):
        return keys, counts
    cut = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[cut], np.add.reduceat(counts, cut)


def window_keys(spelled: np.ndarray, sizes: np.ndarray, order: int) -> np.ndarray:
    """The window that ends at each symbol: the symbol, the highest byte, and the `order` bytes before it, the nearest first; a text starts after `order` ends."""
    padded = np.full(len(spelled) + order * len(sizes), END, dtype=np.uint8)
    place = np.arange(len(spelled)) + order * np.repeat(np.arange(1, len(sizes) + 1), sizes)
    padded[place] = spelled
    # the windows of all places by shifted slices, of which those of the ends before a text are not taken
    key = padded[order:].astype(np.uint64)
    for j in range(1, order + 1):
        key <<= np.uint64(8)
        key |= padded[order - j : len(padded) - j]
    return key[place - order]


def parts(sizes: np.ndarray, size: int = C.CHUNK_BYTES) -> Iterator[tuple[int, int, int, int]]:
    """Runs of texts of about `size` symbols: the texts [a, b) and their symbols [from, to)."""
    at = np.concatenate([[0], np.cumsum(sizes)])
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(at, at[a] + size, side="right")) - 1)
        yield a, b, int(at[a]), int(at[b])
        a = b


def block_windows(spelled: np.ndarray, sizes: np.ndarray, held: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct windows of a block, sorted, and their counts in its training texts; worked out in parts of the block."""
    windows, counts = [], []
    for a, b, lo, hi in parts(sizes):
        keys, learned = window_keys(spelled[lo:hi], sizes[a:b], order), np.repeat(~held[a:b], sizes[a:b])
        for own, counted in ((np.sort(keys[learned]), 1), (np.sort(keys[~learned]), 0)):
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
            windows.append(own[first])
            counts.append(np.diff(np.append(first, len(own))) * counted)
    windows, counts = np.concatenate(windows), np.concatenate(counts)
    by = np.argsort(windows, kind="stable")
    return _add_up(windows[by], counts[by])


def contexts(keys: np.ndarray, order: int, m: int) -> np.ndarray:
    """The last m bytes before the symbol of each window."""
    return (keys & np.uint64((1 << (8 * order)) - 1)) >> np.uint64(8 * (order - m))


class Splits:
    """The contexts that are split, by length from three bytes on, with their own counts: m -> sorted windows of m bytes and a symbol, and how often they occur.

    What is split at one length extends what is split at the one before.
    """

    def __init__(self, side: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.side = side
        self.sets = {m: np.unique(k & np.uint64((1 << (8 * m)) - 1)) for m, (k, _) in side.items()}
        self._table: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"_table": None}

    def place(self, context: np.ndarray, m: int) -> np.ndarray:
        """Where each context of m bytes is among the split ones; -1 if it is not."""
        s = self.sets[m]
        if m > 3:
            i = np.minimum(np.searchsorted(s, context), len(s) - 1)
            return np.where(s[i] == context, i, -1)
        if self._table is None:
            self._table = np.full(1 << 24, -1, dtype=np.int32)
            self._table[s] = np.arange(len(s))
        return self._table[context]

    def chains(self, keys: np.ndarray, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(m, windows, places): for each length, which windows have split contexts of it, and which of them."""
        at = np.arange(len(keys))
        for m in sorted(self.sets):
            if m >= order or not len(at):
                return
            i = self.place(contexts(keys[at], order, m), m)
            at, i = at[i >= 0], i[i >= 0]
            yield m, at, i

    def depths(self, keys: np.ndarray, order: int) -> np.ndarray:
        """How many bytes before its symbol name the shard of each window: three, and one more for each split context."""
        out = np.full(len(keys), min(3, order), dtype=np.int8)
        for m, at, _ in self.chains(keys, order):
            out[at] = m + 1
        return out


def _shard_of(keys: np.ndarray, order: int, shards: int, splits: Splits | None = None) -> np.ndarray:
    first = (C.mix(contexts(keys, order, min(3, order))) % np.uint64(shards)).astype(np.int64)
    out = _SHARDS + first
    if splits and splits.sets:
        depth = splits.depths(keys, order)
        for m in range(4, order + 1):
            at = np.flatnonzero(depth == m)
            out[at] = _DEEP + first[at] * SPLIT + (C.mix(contexts(keys[at], order, m) ^ np.uint64(m << 56)) % np.uint64(SPLIT)).astype(np.int64)
    return out


class _Level:
    """Contexts of m bytes: their next symbols and counts, and which are candidates or retained."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, m: int, least: int):
        self.keys, self.n, self.mask = keys, n.astype(np.float64), np.uint64((1 << (8 * m)) - 1)
        self.context, self.of = np.unique(keys & self.mask, return_inverse=True)
        self.total = np.bincount(self.of, weights=self.n, minlength=len(self.context))
        self.kinds = np.bincount(self.of, minlength=len(self.context)).astype(np.float64)
        self.candidate = (self.total >= least) | (m == 0)
        self.kept = self.candidate

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The context of each key, and whether it is a candidate."""
        if not len(self.context):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        own = keys & self.mask
        i = np.minimum(np.searchsorted(self.context, own), len(self.context) - 1)
        return i, (self.context[i] == own) & self.candidate[i]

    def smooth(self, keys: np.ndarray, parent: np.ndarray, i: np.ndarray, found: np.ndarray) -> np.ndarray:
        if not found.any():
            return parent
        j = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        n = np.where(self.keys[j] == keys, self.n[j], 0)
        return np.where(found, (n + self.kinds[i] * parent) / (self.total[i] + self.kinds[i]), parent)

    def diverges(self, parent: np.ndarray) -> np.ndarray:
        """parent: the parent's probability of each key of this level."""
        gain = np.bincount(self.of, weights=self.n * np.log(self.n / self.total[self.of] / parent), minlength=len(self.context))
        return self.candidate & (gain > 0.5 * self.kinds * np.log(np.maximum(self.total, 2)))


class Shard:
    """The tree's part for some last three bytes or more, with all shorter contexts.

    keys, counts: the windows of training texts; asked: all whose probability is wanted. Contexts shorter than those that
    name a part take their counts from `low` (up to two bytes) and `splits`.
    """

    def __init__(self, low: tuple[np.ndarray, np.ndarray], keys: np.ndarray, counts: np.ndarray, order: int, least: int, splits: Splits, asked: np.ndarray | None = None):
        self.order, self.levels = order, []
        depth = splits.depths(keys, order)
        present = {m: np.bincount(i, minlength=len(splits.sets[m])) > 0 for m, _, i in splits.chains(keys if asked is None else asked, order)}
        for m in range(order + 1):
            if m <= 2:
                k, n = low[0] >> np.uint64(8 * (min(2, order) - m)), low[1]
            else:
                own = slice(None) if not present else depth <= m
                k, n = keys[own] >> np.uint64(8 * (order - m)), counts[own]
                if m in present and present[m].any():
                    extra, times = splits.side[m]
                    held = present[m][splits.place(extra & np.uint64((1 << (8 * m)) - 1), m)]
                    k, n = np.concatenate([k, extra[held]]), np.concatenate([n, times[held]])
                    by = np.argsort(k, kind="stable")
                    k, n = k[by], n[by]
            self.levels.append(_Level(*_add_up(k, n), m, least))
        for m in range(3, order + 1):
            level = self.levels[m]
            level.kept = level.diverges(self._probability(level.keys, m, m - 1))
        for m in range(order - 1, 2, -1):
            child = self.levels[m + 1]
            own = np.uint64((1 << (8 * m)) - 1)
            level = self.levels[m]
            level.kept = level.kept | np.isin(level.context, (child.context[child.kept] >> np.uint64(8)) & own)

    def _probability(self, keys: np.ndarray, length: int, to: int, kept: bool = False) -> np.ndarray:
        """The probability of each key, a symbol and `length` bytes before it, by candidates of up to `to` bytes, or by its longest retained one."""
        p = np.full(len(keys), 1 / 256)
        out = p
        for m in range(to + 1):
            level, own = self.levels[m], keys >> np.uint64(8 * (length - m))
            i, found = level.find(own)
            p = level.smooth(own, p, i, found)
            if kept and found.any():
                out = np.where(found & level.kept[i], p, out)
        return out if kept else p

    def log10(self, keys: np.ndarray) -> np.ndarray:
        return np.log10(self._probability(keys, self.order, self.order, kept=True))


#: Marks rows of _low_counts that say how many windows blocks send for a context of three bytes.
_LOAD = np.uint64(1 << 62)


def _low_counts(order: int):
    """Counts of the windows of three bytes, and for orders over three how many windows blocks send for each context of three."""

    def low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        for batch in batches:
            parts = [held]
            for own, n in _read(batch):
                keys, counts = _add_up(own >> np.uint64(8 * max(0, order - 2)), n)
                parts.append((keys[counts > 0], counts[counts > 0]))
                if order > 3:
                    near = np.sort(contexts(own, order, 3).astype(np.uint32))
                    first = np.flatnonzero(np.append(True, near[1:] != near[:-1]))
                    parts.append((near[first].astype(np.uint64) | _LOAD, np.diff(np.append(first, len(near)))))
            keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
            by = np.argsort(keys)
            held = _add_up(keys[by], counts[by])
        yield pa.RecordBatch.from_arrays([pa.array(held[0].view(np.int64)), pa.array(held[1])], names=["key", "n"])

    return low


def low_counts(windows: DataFrame, order: int, hot_windows: int) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """The windows of three bytes and their counts, and the contexts of three bytes with more than hot_windows windows, MOST_HOT at most."""
    found = windows.mapInArrow(_low_counts(order), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where((F.col("key") < int(_LOAD)) | (F.col("n") > hot_windows)).toArrow()
    keys, n = found.column("key").to_numpy().astype(np.uint64), found.column("n").to_numpy()
    load = keys >= _LOAD
    by = np.argsort(keys[~load])
    hot, windows_of = keys[load] ^ _LOAD, n[load]
    return (keys[~load][by], n[~load][by]), np.sort(hot[np.lexsort((hot, -windows_of))[:MOST_HOT]])


def _read(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for k, n in zip(batch.column("words").to_pylist(), batch.column("learned").to_pylist(), strict=True):
        yield np.cumsum(_ut(k, "<u8"), dtype=np.uint64), _ut(n, "<u4").astype(np.int64)


def _sums(order: int, m: int, splits: Splits, among: Splits | None):
    """A task's share of the windows that blocks send for each context of m bytes that extends split ones; or, of the contexts `among`, of the counts of each with its symbols."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        for batch in batches:
            parts = [held]
            for keys, n in _read(batch):
                if among is None:
                    own = keys[splits.depths(keys, order) == m]
                    k, n = np.unique(contexts(own, order, m), return_counts=True)
                    parts.append((k, n.astype(np.int64)))
                else:
                    at = (among.place(contexts(keys, order, m), m) >= 0) & (n > 0)
                    parts.append(_add_up(keys[at] >> np.uint64(8 * (order - m)), n[at]))
            keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
            by = np.argsort(keys, kind="stable")
            held = _add_up(keys[by], counts[by])
        yield pa.RecordBatch.from_arrays([pa.array(held[0].view(np.int64)), pa.array(held[1])], names=["key", "n"])

    return sums


def split_contexts(windows: DataFrame, low: tuple[np.ndarray, np.ndarray], many: np.ndarray, order: int, least: int, hot_windows: int) -> Splits:
    """The contexts to split: those with too many windows (of three bytes: `many`) that diverge from their parents."""
    splits = Splits({})
    for m in range(3, order):
        if m > 3:
            loads = windows.mapInArrow(_sums(order, m, splits, None), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > hot_windows)
            many = np.sort(np.array([r["key"] for r in loads.orderBy(F.desc("n"), "key").limit(MOST_HOT).collect()], dtype=np.int64).view(np.uint64))
        if not len(many):
            break
        found = windows.mapInArrow(_sums(order, m, splits, Splits({m: (many, many)})), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
        keys, counts = found.column("key").to_numpy().view(np.uint64), found.column("n").to_numpy()
        by = np.argsort(keys)
        keys, counts = keys[by], counts[by]
        # windows of m bytes in a tree of that order, whose last level are the contexts in question
        tree = Shard(low, keys, counts, m, least, splits)
        top = tree.levels[m]
        own = np.isin(keys & np.uint64((1 << (8 * m)) - 1), top.context[top.diverges(tree._probability(top.keys, m, m - 1))])
        if not own.any():
            break
        splits = Splits(splits.side | {m: (keys[own], counts[own])})
    return splits


def _resplit(order: int, shards: int, splits):
    """Rows of windows whose contexts are split, by the buckets of their parts."""

    def resplit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for block, bucket, words, learned in zip(*(batch.column(c).to_pylist() for c in ("block", "bucket", "words", "learned")), strict=True):
                keys = np.cumsum(_ut(words, "<u8"), dtype=np.uint64)
                own = _shard_of(keys, order, shards, splits.value)
                if (own == bucket).all():
                    out.append((block, bucket, words, learned))
                    continue
                n = _ut(learned, "<u4")
                by = np.argsort(own, kind="stable")
                own, keys, n = own[by], keys[by], n[by]
                cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
                out += [(block, int(own[a]), _zt(np.diff(keys[a:b], prepend=np.uint64(0))), _zt(n[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], kind) for j, kind in enumerate(kinds)], names=["block", "bucket", "words", "learned"])

    return resplit


def _score_windows(low, splits, order: int, least: int):
    """Per block of a shard, log10 of the probability of its windows."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in C.sorted_groups(batches, ["bucket"]):
            blocks = group.to_pylist()
            parts, size, every = [], 0, (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            for at, b in enumerate(blocks):
                parts.append((np.cumsum(_ut(b["words"], "<u8"), dtype=np.uint64), _ut(b["learned"], "<u4").astype(np.int64)))
                size += len(parts[-1][0])
                if size > 1_000_000 or at == len(blocks) - 1:
                    keys, counts = (np.concatenate(x) for x in zip(every, *parts, strict=True))
                    by = np.argsort(keys, kind="stable")
                    every, parts, size = _add_up(keys[by], counts[by]), [], 0
            seen = every[1] > 0
            p = Shard(low.value, every[0][seen], every[1][seen], order, least, splits.value, every[0]).log10(every[0]).astype("<f4")
            for b in blocks:
                own = p[np.searchsorted(every[0], np.cumsum(_ut(b["words"], "<u8"), dtype=np.uint64))]
                yield pa.RecordBatch.from_arrays([pa.array([b["block"]], pa.int64()), pa.array([b["bucket"]], pa.int32()), pa.array([_zt(own)], pa.binary())], names=["block", "bucket", "counts"])

    return score


# ---------------------------------------------------------------- exact token counts


def _z(x: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(x)


def _u(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def _zt(x: np.ndarray) -> bytes:
    """Numbers packed by the place of their bytes."""
    return _z(np.ascontiguousarray(x.view("u1").reshape(len(x), -1).T).tobytes())


def _ut(x: bytes, kind: str) -> np.ndarray:
    raw = _u(x, "u1").reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(raw.T).view(kind).ravel()


_SENT = "block long, bucket int, n int, docs binary, text binary, lengths binary, words binary, learned binary"


def _by_shard(windows: np.ndarray, order: int, shards: int, splits: Splits | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The order of distinct windows by shard, and their shards in this order."""
    shard = _shard_of(windows, order, shards, splits)
    by = np.argsort(shard, kind="stable")
    return by, shard[by]


def _by_bucket(spelled: np.ndarray, at: np.ndarray, first: np.ndarray, buckets: int):
    """The distinct tokens (bytes, offsets), their order by bucket, their buckets in this order, and of each distinct token of a document the document, the token's place in this order and its count."""
    coded = pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(spelled.tobytes())]).dictionary_encode()
    names, name_at = C.text_buffer(coded.dictionary)
    bucket = (C.Prefix(names).slices(name_at[:-1], name_at[1:]) % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    place = np.empty(len(by), dtype=np.int64)
    place[by] = np.arange(len(by))
    key, tf = np.unique(np.repeat(np.arange(len(first) - 1), np.diff(first)) * len(by) + place[coded.indices.to_numpy()], return_counts=True)
    return names, name_at, by, bucket[by], key // len(by), key % len(by), tf


def _send_tokens(order: int, buckets: int, shards: int, block_bytes: int):
    """Of a block of texts, bucket -1 holds its documents and their symbols; the other buckets hold its distinct tokens or windows and their counts in the block's training texts."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offsets in C.text_chunks(batches, size=block_bytes):
            spelled, at, first = tokens(buf, offsets)
            sizes = np.diff(at[first])
            n = len(offsets) - 1
            names, name_at, by, of, doc, at_place, tf = _by_bucket(spelled, at, first, buckets)
            held = rows.column("held_out").to_numpy(zero_copy_only=False)
            learned = np.bincount(at_place, weights=tf * ~held[doc], minlength=len(by)).astype("<u4")
            raw = names.tobytes()
            docs = b"".join((rows.column("_id").to_numpy().astype("<i8").tobytes(), rows.column("_h").to_numpy().astype("<i8").tobytes(), held.astype("<i8").tobytes(), np.diff(first).astype("<i8").tobytes(), sizes.astype("<i8").tobytes()))
            out = [(-1, n, _z(docs), _z(spelled.tobytes()), None, None, None)]
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                words = [raw[name_at[c] : name_at[c + 1]] for c in by[a:b].tolist()]
                out.append((int(of[a]), None, None, None, _z(np.array([len(w) for w in words], "<u4").tobytes()), _z(b"".join(words)), _z(learned[a:b].tobytes())))
            windows, seen = block_windows(spelled, sizes, held, order)
            by, of_shard = _by_shard(windows, order, shards)
            windows, seen = windows[by], seen[by].astype("<u4")
            cuts = [0, *(np.flatnonzero(np.diff(of_shard)) + 1).tolist(), len(windows)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                out.append((int(of_shard[a]), *[None] * 4, _zt(np.diff(windows[a:b], prepend=np.uint64(0))), _zt(seen[a:b])))
            block = int.from_bytes(xxhash.xxh64_digest(docs + spelled.tobytes()), "little", signed=True)  # equal blocks hold equal rows
            kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
            del spelled, names, raw, windows, seen, by, of_shard
            C.release()
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(out), pa.int64()), *(pa.array([r[j] for r in out], kind) for j, kind in enumerate(kinds))], names=["block", "bucket", "n", "docs", "text", "lengths", "words", "learned"])

    return send


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block of a bucket, the counts of its tokens in all training texts; the row without a block has the bucket's training tokens and distinct ones."""
    for group in C.sorted_groups(batches, ["bucket"]):
        blocks = group.to_pylist()
        lengths = [_u(b["lengths"], "<u4").astype(np.int64) for b in blocks]
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype(np.int64)
        words = b"".join(_u(b["words"], "u1").tobytes() for b in blocks)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(words)]).dictionary_encode()
        code = coded.indices.to_numpy()
        count = np.bincount(code, weights=np.concatenate([_u(b["learned"], "<u4") for b in blocks]), minlength=len(coded.dictionary)).astype(np.int64)
        at = 0
        for b, own in zip(blocks, lengths, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([b["block"]]), pa.array([b["bucket"]], pa.int32()), pa.array([_z(count[code[at : at + len(own)]].astype("<i8").tobytes())], pa.binary()), pa.array([None], pa.int64()), pa.array([None], pa.int64())], names=["block", "bucket", "counts", "tokens", "kinds"])
            at += len(own)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([blocks[0]["bucket"]], pa.int32()), pa.array([None], pa.binary()), pa.array([int(count.sum())]), pa.array([int((count > 0).sum())])], names=["block", "bucket", "counts", "tokens", "kinds"])


def _base(order: int, buckets: int, shards: int, splits):
    """Per document of a block, its known tokens, the sum of log10(c + 1) and its score, from the block's own row (bucket -1, first) and what came back by bucket."""

    def base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in C.sorted_groups(batches, ["block"]):
            found = group.to_pylist()
            same = sum(r["bucket"] == -1 for r in found)  # equal blocks come more than once
            by_bucket = {r["bucket"]: r["counts"] for r in found if r["bucket"] >= 0}
            c = np.concatenate([_u(by_bucket[b], "<i8") for b in sorted(by_bucket) if b < _SHARDS])
            p = np.concatenate([_ut(by_bucket[b], "<f4") for b in sorted(by_bucket) if b >= _SHARDS])
            own = found[0]
            n = own["n"]
            raw = _u(own["docs"], "u1")
            ids, h, held, n_tokens, sizes = raw.view("<i8").reshape(5, n)
            spelled = _u(own["text"], "u1")
            own_parts, windows = [], []
            for x, y, lo, hi in parts(sizes):
                keys, inverse = np.unique(window_keys(spelled[lo:hi], sizes[x:y], order), return_inverse=True)
                own_parts.append((keys, inverse.astype(np.int32), sizes[x:y]))
                windows.append(keys)
            windows = np.sort(np.concatenate(windows))  # np.unique would hash
            windows = windows[np.append(True, windows[1:] != windows[:-1])]
            by, _ = _by_shard(windows, order, shards, splits.value)
            of_window = np.empty(len(p), dtype=np.float64)
            of_window[by] = p
            score = np.concatenate([np.add.reduceat(of_window[np.searchsorted(windows, keys)][inverse], np.cumsum(m) - m) for keys, inverse, m in own_parts])
            del own_parts
            at = np.append(0, np.flatnonzero((spelled == 32) | (spelled == END)) + 1)  # a token ends with either
            *_, doc, place, tf = _by_bucket(spelled, at, np.append(0, np.cumsum(n_tokens)), buckets)
            known = np.bincount(doc, weights=tf * (c[place] > 0), minlength=n).astype(np.int64)
            logs = np.bincount(doc, weights=tf * np.log10(c + 1.0)[place], minlength=n)
            out = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(h), pa.array(held.astype(bool)), pa.array(n_tokens), pa.array(known), pa.array(logs), pa.array(score)], names=["_id", "_h", "held_out", "n_tokens", "n_known", "logs", "score"])
            del raw, spelled, windows, by, of_window, at, doc, place, tf, c, p
            C.release()
            for _ in range(same):
                yield out

    return base


def language_model(docs: DataFrame, order: int = ORDER, least: int = LEAST, bucket_bytes: int = 32 << 20, block_bytes: int = BLOCK_BYTES, hot_windows: int = HOT_WINDOWS) -> DataFrame:
    """(_id, _h, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    if not 1 <= order <= 7:
        raise ValueError("order must be from 1 to 7: a window and its symbol are the bytes of one 64-bit number")
    spark = docs.sparkSession
    keyed = C.keyed_documents(docs).withColumn("held_out", F.coalesce(F.crc32(C.original_id().cast("string").cast("binary")) % 7 == 2, F.lit(False)))
    total = keyed.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    buckets, shards = max(8, total // bucket_bytes), min(1 << 24, max(8, total // (16 << 20)))
    sent = C.materialised(keyed.mapInArrow(_send_tokens(order, buckets, shards, block_bytes), _SENT), "lm-blocks")
    windows = sent.where(f"bucket >= {_SHARDS}")
    counted, many = low_counts(windows.select("words", "learned"), order, hot_windows)
    found_splits = split_contexts(windows.select("words", "learned"), counted, many, order, least, hot_windows)
    low, splits = spark.sparkContext.broadcast(counted), spark.sparkContext.broadcast(found_splits)
    dealt = windows.select("block", "bucket", "words", "learned")
    if found_splits.sets:
        dealt = dealt.mapInArrow(_resplit(order, shards, splits), dealt.schema)
    scored = dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_score_windows(low, splits, order, least), "block long, bucket int, counts binary")
    by_token = sent.where(f"bucket BETWEEN 0 AND {_SHARDS - 1}").select("block", "bucket", "lengths", "words", "learned").repartition("bucket").sortWithinPartitions("bucket")
    counts = C.materialised(by_token.mapInArrow(_count_tokens, "block long, bucket int, counts binary, tokens long, kinds long"), "lm-counts")
    whole = counts.agg(F.sum("tokens").alias("tokens"), F.sum("kinds").alias("kinds")).first()
    n, v = int(whole["tokens"] or 0), int(whole["kinds"] or 0)
    own = sent.where("bucket = -1").select("block", "bucket", "n", "docs", "text")
    both = own.unionByName(counts.where("block IS NOT NULL").select("block", "bucket", "counts").unionByName(scored), allowMissingColumns=True)
    based = both.repartition("block").sortWithinPartitions("block", "bucket").mapInArrow(_base(order, buckets, shards, splits), "_id long, _h long, held_out boolean, n_tokens long, n_known long, logs double, score double")
    return based.select(
        "_id", "_h", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"), "score"
    )
