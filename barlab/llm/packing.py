"""Best-fit packing after Martello-Toth dominance reduction.

Only the number of pieces of each length matters for the plan, so the driver sees a histogram of at most `capacity`
rows, whatever the size of the corpus. The plan fixes small sets that dominate every other set with the same largest
piece (a piece that fits with no other; a pair that fills a sequence; the best pair where no three fit; a triple where
no four fit and none is better), shrinks the histogram, and places the rest by best fit in decreasing length. It comes
out as runs of equal patterns; pieces take their place in it by their rank among pieces of their length.

Defined cases: a null or empty text is one piece with the end id only; repeated rows are packed separately; a null id
stays null. Equal lengths are ranked by id, text hash and piece, so reruns agree.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlab.llm import common as C

CAPACITY = 2048
END_ID = 0
#: White space outside ASCII; a text that holds it is tokenized as one string.
_OTHER_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


class Encoder:
    """Ids of many texts at once.

    The vocabulary's pattern starts a new token wherever ASCII white space follows another character, so texts are cut
    there, and a piece has the same ids wherever it stands. The ids of pieces of up to `longest` bytes are kept by the
    64-bit hash and the length of their bytes; once `kept` pieces are held the cache starts anew. Pieces that are not
    held are strung together and tokenized in one go: the bytes of their tokens tell where each of them ends.
    """

    def __init__(self, path: str, kept: int = 1_000_000, longest: int = 255, together: int = 1 << 12):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.width = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(token)  # one character of the byte-level alphabet a byte
        for i, token in self.tokenizer.get_added_tokens_decoder().items():
            self.width[i] = len(token.content.encode())
        self.kept, self.longest, self.together = kept, longest, together
        self.bits = (4 * kept - 1).bit_length()
        self._clear()

    def _clear(self) -> None:
        self.slot = np.zeros(1 << self.bits, np.int32)  # entry + 1
        self.n, self.n_ids = 0, 0
        self.hash, self.size = np.zeros(self.kept, np.uint64), np.zeros(self.kept, np.int16)
        self.start, self.length = np.zeros(self.kept, np.int32), np.zeros(self.kept, np.int16)
        self.ids = np.zeros(4 * self.kept, np.uint32)

    def _find(self, h: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The entry of each piece, -1 where none is held."""
        out = np.full(len(h), -1, dtype=np.int64)
        left = np.flatnonzero(size <= self.longest)
        at = (h[left] >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(left):
            entry = self.slot[at].astype(np.int64) - 1
            same = (entry >= 0) & (self.hash[entry] == h[left]) & (self.size[entry] == size[left])
            out[left[same]] = entry[same]
            on = (entry >= 0) & ~same
            left, at = left[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def _keep(self, h: np.ndarray, size: np.ndarray, ids: np.ndarray, length: np.ndarray) -> None:
        """Hold distinct pieces that are not held yet."""
        if self.n + len(h) > self.kept or self.n_ids + len(ids) > len(self.ids):
            self._clear()
            if len(h) > self.kept or len(ids) > len(self.ids):
                return
        new = np.arange(self.n, self.n + len(h))
        self.hash[new], self.size[new], self.length[new] = h, size, length
        self.start[new] = self.n_ids + np.cumsum(length) - length
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(new):
            free = np.flatnonzero(self.slot[at] == 0)
            self.slot[at[free]] = new[free] + 1  # of several that want one slot the last gets it
            lost = self.slot[at] != new + 1
            new, at = new[lost], (at[lost] + 1) & ((1 << self.bits) - 1)
        self.n += len(h)
        self.n_ids += len(ids)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _tokenize(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, and how many each has; `inner` pieces begin with white space and end without."""
        size = ends - starts
        length = np.zeros(len(starts), dtype=np.int64)
        order = np.argsort(~inner, kind="stable")
        flat, at, last = [], 0, int(inner.sum())
        own, to = size[order], np.cumsum(size[order])
        while at < last:
            till = max(at + 1, min(last, int(np.searchsorted(to, (to[at - 1] if at else 0) + self.together))))
            group = order[at:till]
            text = b"".join(raw[a:b] for a, b in zip(starts[group].tolist(), ends[group].tolist(), strict=True))
            ids = np.array(self._encode([text.decode()])[0], dtype=np.uint32)
            n_at = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(own[at:till])) + 1
            length[group] = np.diff(n_at, prepend=0)
            flat.append(ids)
            at = till
        alone = order[last:]
        for ids, i in zip(self._encode([raw[a:b].decode() for a, b in zip(starts[alone].tolist(), ends[alone].tolist(), strict=True)]), alone.tolist(), strict=True):
            flat.append(np.array(ids, dtype=np.uint32))
            length[i] = len(ids)
        ids = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
        first = np.zeros(len(starts), dtype=np.int64)
        first[order] = np.cumsum(length[order]) - length[order]
        return ids[C.ranges(first, length)], length

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and per text where its ids end."""
        sep = C._SEP[buf]
        cut = np.zeros(len(buf) + 1, dtype=bool)
        cut[1:-1] = sep[1:] & ~sep[:-1]
        raw = buf.tobytes()
        for m in _OTHER_SPACE.finditer(raw):
            i = int(np.searchsorted(offsets, m.start(), side="right")) - 1
            cut[offsets[i] + 1 : offsets[i + 1]] = False
        cut[offsets] = True
        cut[-1] = True
        at = np.flatnonzero(cut)
        if at[0] == len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        size = np.diff(at)
        h = C.Prefix(buf).slices(at[:-1], at[1:])
        entry = self._find(h, size)
        miss = np.flatnonzero(entry < 0)
        _, one, of = np.unique(h[miss] + size[miss].astype(np.uint64), return_index=True, return_inverse=True)
        long = size[miss] > self.longest  # told apart by their place, not by their hash
        if long.any():
            one = np.append(one[size[miss[one]] <= self.longest], np.flatnonzero(long))
            key = np.where(long, np.arange(len(miss)) + len(miss), of)
            back = np.full(2 * len(miss), -1, dtype=np.int64)
            back[key[one]] = np.arange(len(one))
            of = back[key]
        new = miss[one]
        starts, ends = at[new], at[new + 1]
        inner = sep[starts] & ~sep[ends - 1] & (size[new] <= self.longest)
        ids, length = self._tokenize(raw, starts, ends, inner)
        first = np.cumsum(length) - length
        per_piece = np.empty(len(size), dtype=np.int64)
        source = np.empty(len(size), dtype=np.int64)
        held = np.flatnonzero(entry >= 0)
        per_piece[held], source[held] = self.length[entry[held]], self.start[entry[held]]
        per_piece[miss], source[miss] = length[of], first[of] + self.n_ids
        place = C.ranges(source, per_piece)
        fresh = np.flatnonzero(place >= self.n_ids)
        out = self.ids[np.minimum(place, len(self.ids) - 1)]
        out[fresh] = ids[place[fresh] - self.n_ids]
        done = np.concatenate([[0], np.cumsum(per_piece)])
        short = np.flatnonzero(size[new] <= self.longest)
        self._keep(h[new[short]], size[new[short]], ids[C.ranges(first[short], length[short])], length[short])
        return out, done[np.searchsorted(at, offsets[1:])]


_ENCODERS: dict[str, Encoder] = {}


def _pieces(path: str, capacity: int, with_ids: bool):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        encoder = _ENCODERS[path]
        for rows, buf, offsets in C.text_chunks(batches):
            ids, ends = encoder.encode(buf, offsets)
            begins = np.concatenate([[0], ends[:-1]])
            total = ends - begins + 1
            n = -(-total // capacity)
            of = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            shift = (total - n * capacity)[of]  # the first piece is the one that may be shorter
            start = np.maximum(0, piece * capacity + shift)
            length = np.minimum((piece + 1) * capacity + shift, total[of]) - start
            own = ids.astype("<u4")
            end_id = np.array([END_ID], "<u4").tobytes()
            crc, kept = [], []
            for a, s, m, last in zip(begins[of].tolist(), start.tolist(), length.tolist(), (piece == n[of] - 1).tolist(), strict=True):
                raw = own[a + s : a + s + m - last].tobytes() + end_id * last
                crc.append(zlib.crc32(raw))
                if with_ids:
                    kept.append(np.frombuffer(raw, "<i4"))
            take = pa.array(of)
            out = [rows.column("_id").take(take), rows.column("_h").take(take), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            names = ["_id", "_h", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                out.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names=names)
            C.release()

    return pieces


# ---------------------------------------------------------------- the plan, on counts of lengths


def _three_smallest(count: np.ndarray) -> tuple[int, int, int]:
    """The three smallest lengths, counting repeats; 1 << 30 where there are fewer."""
    out: list[int] = []
    for s in np.flatnonzero(count)[:3].tolist():
        out += [s] * min(3, int(count[s]))
    return tuple([*out, 1 << 30, 1 << 30, 1 << 30][:3])


def _largest(count: np.ndarray, most: int) -> int:
    """The largest length present up to `most`, or 0."""
    if most < 1:
        return 0
    have = np.flatnonzero(count[: most + 1])
    return int(have[-1]) if len(have) else 0


def reduce_instance(count: np.ndarray, capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Sets that some best packing holds, as (lengths, how many), and the counts that are left."""
    count = count.copy()
    fixed: list[tuple[tuple[int, ...], int]] = []
    changed = True

    def fix(lengths: tuple[int, ...], times: int) -> None:
        nonlocal changed
        for s in lengths:
            count[s] -= times
        fixed.append((lengths, times))
        changed = True

    while changed:
        changed = False
        for s in np.flatnonzero(count)[::-1].tolist():
            while count[s] > 0:
                count[s] -= 1  # the item itself
                low = _three_smallest(count)
                k = _largest(count, capacity - s)
                count[s] += 1
                if not k:
                    fix((s,), int(count[s]) if s * 2 > capacity else 1)
                    continue
                times = int(count[s] // 2 if k == s else min(count[s], count[k]))
                if s + k == capacity or s + low[0] + low[1] > capacity:
                    # a pair that fills the sequence, or the largest partner where no third piece fits
                    fix((s, k), times)
                    continue
                if s + low[0] + low[1] + low[2] > capacity:
                    # at most two partners: the best pair of partners against the best single one
                    free = capacity - s
                    count[s] -= 1
                    best, q = _best_pair(count, free, k)
                    half = _largest(count, free // 2)  # the smaller of two partners is never longer than this
                    count[s] += 1
                    if k >= best:
                        fix((s, k), times)
                        continue
                    if q and q >= half:
                        fix((s, k, q), min(int(count[x]) // (s, k, q).count(x) for x in (s, k, q)))
                        continue
                break
    return fixed, count


def _best_pair(count: np.ndarray, free: int, k: int) -> tuple[int, int]:
    """The largest sum of two pieces within `free` (0 if no two fit), and the largest partner that fits beside k."""
    sizes = np.arange(free + 1)
    upto = np.maximum.accumulate(np.where(count[: free + 1] > 0, sizes, 0))
    x = np.flatnonzero(count[: free + 1])
    partner = upto[free - x]
    partner = np.where((partner == x) & (count[x] == 1), upto[x - 1], partner)
    sums = np.where(partner > 0, x + partner, 0)
    return int(sums.max(initial=0)), int(partner[x == k].max(initial=0))


def best_fit(count: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit in decreasing length; equal bins are handled together."""
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    free = np.zeros(capacity + 1, dtype=np.int64)
    for s in np.flatnonzero(count)[::-1].tolist():
        left = int(count[s])
        while left:
            fit = np.flatnonzero(free[s:])
            r = int(fit[0]) + s if len(fit) else capacity
            q = r // s
            if len(fit):
                pattern, bins = open_bins[r].pop()
                free[r] -= bins
            else:
                pattern, bins = (), -(-left // q)
            full = min(bins, left // q)
            parts = [(pattern + (s,) * q, full)]
            left -= full * q
            rest = bins - full
            if left and rest:
                parts.append((pattern + (s,) * left, 1))
                left, rest = 0, rest - 1
            parts.append((pattern, rest))
            for p, n in parts:
                if n:
                    room = capacity - sum(p)
                    open_bins.setdefault(room, []).append((p, n))
                    free[room] += n
    return [x for group in open_bins.values() for x in group]


def plan(count: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, times per sequence, offset) for every run of equal patterns."""
    fixed, rest = reduce_instance(count, capacity)
    used = np.zeros(capacity + 1, dtype=np.int64)
    out, sequence = [], 0
    for pattern, bins in fixed + best_fit(rest, capacity):
        offset = 0
        for s in sorted(set(pattern), reverse=True):
            times = pattern.count(s)
            out.append((s, int(used[s]), int(used[s] + bins * times), sequence, times, offset))
            used[s] += bins * times
            offset += s * times
        sequence += bins
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False, rank_rows: int = 100_000) -> DataFrame:
    """(_id, _h, piece, start, length, ids_crc32, sequence_id, offset[, ids]) of every piece."""
    spark = docs.sparkSession
    schema = "_id long, _h long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    pieces = C.materialised(C.keyed_documents(docs).mapInArrow(_pieces(tokenizer, capacity, with_ids), schema), "packing-pieces")
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for r in pieces.groupBy("length").count().collect():  # capacity rows at most
        histogram[r["length"]] = r["count"]
    runs = plan(histogram, capacity)
    table = spark.createDataFrame(runs, "length long, lo long, hi long, sequence long, times long, place long")
    parts = max(1, int(histogram.sum()) // rank_rows)
    ranked = pieces.withColumn("part", F.pmod(F.xxhash64("_id", "_h", "piece"), F.lit(parts)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = ranked.groupBy("length", "part").agg(F.count("*").alias("n")).select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    local = F.row_number().over(Window.partitionBy("length", "part").orderBy("_id", "_h", "piece")) - 1
    ranked = ranked.withColumn("local", local).join(base, ["length", "part"]).withColumn("rank", F.col("base") + F.col("local"))
    # the plan's rows depend on the capacity alone, not on the corpus
    placed = ranked.join(F.broadcast(table), "length").where("rank >= lo and rank < hi")
    nth = F.col("rank") - F.col("lo")
    return placed.select("_id", "_h", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.floor(nth / F.col("times"))).alias("sequence_id"), (F.col("place") + nth % F.col("times") * F.col("length")).alias("offset"), *(["ids"] if with_ids else []))
