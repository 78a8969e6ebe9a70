"""Substring dedup by super-k-mer partitioning.

A window is k consecutive words of one text. Consecutive windows whose smallest m-word hash (the minimiser) is the same
form a super-k-mer, which travels once, as one packed string, to the bucket of its minimiser. Equal windows have equal
minimisers, so a bucket holds every occurrence of its windows: it sorts them by a 64-bit hash, compares the bytes of
those that sort together, and knows for each the smallest document in which it starts.

Texts are held in blocks, written compressed to the shared folder. A block sends each distinct string once, with the
smallest and the greatest document in which it stands there, and a bucket sends back, to the blocks that have a greater
document, the smallest document of each window. Where a string stands in its documents is known to the block alone, so
a passage that a third of all documents share costs a string and two numbers per block, and never meets its occurrences
in one place. A minimiser of several words is rare unless its passage is repeated, so buckets stay small; one passage's
strings, one a block, do meet in one bucket: larger blocks make them fewer.

Defined cases: a null text has no words; a text under k words has no window; rows with equal id and text get the same
result; a null id is the smallest; rows with one id but different texts never count as smaller than each other; other
columns, whatever their names, come back as they were; an empty table gives an empty result. Equal strings are told by a
64-bit hash and their length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from barlab.llm import common as C

_SENT = "block long, bucket int, strings binary, docs binary"
_ANSWER = np.dtype([("string", "<u4"), ("window", "<u4"), ("least", "<i8")])


def _pack(x: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=6).compress(x)


def _unpack(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min of x[i:i+w]; doubles the covered width in each pass."""
    have = 1
    while have * 2 <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (w - have)], x[w - have :]) if w > have else x


def super_kmers(buf: np.ndarray, offsets: np.ndarray, k: int, m: int):
    """(text, first word within the text, start byte, end byte, minimiser) of each super-k-mer, and the bytes, with white space squeezed to one space."""
    sep = C._SEP[buf]
    starts_text = np.zeros(len(buf) + 1, dtype=bool)
    starts_text[offsets] = True
    keep = ~sep
    keep[1:] |= ~sep[:-1]
    keep |= starts_text[:-1]
    flat = np.where(sep, np.uint8(32), buf)[keep]
    to = np.zeros(len(buf) + 1, dtype=np.int64)
    np.cumsum(keep, out=to[1:])
    words = C.Words(flat, to[offsets])
    hashes = C.Prefix(flat).slices(words.starts, words.ends)
    at, text = C.window_starts(words.first, k)
    if not len(at):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, none.astype(np.uint64), flat
    least = _sliding_min(C.window_hashes(hashes, m), k - m + 1)[at]
    cut = np.ones(len(at), dtype=bool)
    cut[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(at)) - 1
    return text[first], at[first] - words.first[text[first]], words.starts[at[first]], words.ends[at[last] + k - 1], least[first], flat


def _blocks(block_bytes: int):
    """Blocks of rows, each as one compressed blob under a hash of its content."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in C.text_chunks(batches, size=block_bytes):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as out:
                out.write_batch(rows)
            blob = sink.getvalue().to_pybytes()
            yield pa.RecordBatch.from_arrays([pa.array([int.from_bytes(xxhash.xxh64_digest(blob), "little", signed=True)], pa.int64()), pa.array([blob], pa.binary())], names=["block", "blob"])

    return blocks


def _opened(blob: bytes) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    """The rows of a block, its text and the texts' offsets."""
    rows = pa.ipc.open_stream(blob).read_all().combine_chunks().to_batches()[0]
    buf, offsets = C.text_buffer(rows.column(rows.schema.get_field_index("_text")))
    return rows, buf, offsets


class _Strings:
    """The distinct super-k-mers of a block by bucket; strings of a bucket are numbered in the order of their hashes."""

    def __init__(self, rows: pa.RecordBatch, buf: np.ndarray, offsets: np.ndarray, k: int, m: int, buckets: int):
        self.text, self.pos, self.a, self.b, least, self.flat = super_kmers(buf, offsets, k, m)
        bucket = (least % np.uint64(buckets)).astype(np.int64)
        h = C.Prefix(self.flat).slices(self.a, self.b) + (self.b - self.a).astype(np.uint64) if len(self.a) else least
        self.order = np.lexsort((h, bucket))  # occurrences by string
        bucket, h = bucket[self.order], h[self.order]
        new = np.append(True, (bucket[1:] != bucket[:-1]) | (h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
        self.first = np.flatnonzero(new)  # the first occurrence of each string
        self.bucket = bucket[self.first]
        self.n = np.diff(np.append(self.first, len(h)))
        self.ids = rows.column(rows.schema.get_field_index("_id")).to_numpy().astype(np.int64)

    def by_bucket(self) -> Iterator[tuple[int, int, int]]:
        """(bucket, first string, end)."""
        cuts = np.flatnonzero(np.append(True, np.diff(self.bucket) != 0)) if len(self.bucket) else np.zeros(0, np.int64)
        yield from zip(self.bucket[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(self.bucket)], strict=True)


def _send(k: int, m: int, buckets: int):
    """The distinct strings of each block and bucket, and the smallest and greatest document of each."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("blob"), strict=True):
                s = _Strings(*_opened(blob.as_py()), k, m, buckets)
                if not len(s.first):
                    continue
                raw, out = s.flat.tobytes(), []
                ids = s.ids[s.text[s.order]]
                least, greatest = np.minimum.reduceat(ids, s.first), np.maximum.reduceat(ids, s.first)
                a, b = s.a[s.order[s.first]].tolist(), s.b[s.order[s.first]].tolist()
                for bucket, lo, hi in s.by_bucket():
                    out.append((bucket, _pack(b"\n".join([raw[x:y] for x, y in zip(a[lo:hi], b[lo:hi], strict=True)])), _pack(np.concatenate([least[lo:hi], greatest[lo:hi] - least[lo:hi]]).tobytes())))
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(out), pa.int64()), pa.array([r[0] for r in out], pa.int32()), *(pa.array([r[j] for r in out], pa.binary()) for j in (1, 2))], names=["block", "bucket", "strings", "docs"])
            C.release()

    return send


def repeated_windows(strings: bytes, least_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For strings joined by newlines and the smallest document of each: per string its first window and number of windows, and per window the smallest document over all equal windows."""
    buf = np.frombuffer(strings, dtype=np.uint8)
    offsets = np.concatenate([[0], np.flatnonzero(buf == 10) + 1, [len(buf)]])
    words = C.Words(buf, offsets)
    at, of = C.window_starts(words.first, k)
    n = np.bincount(of, minlength=len(offsets) - 1)
    key = C.window_hashes(C.Prefix(buf).slices(words.starts, words.ends), k)[at]
    order = np.argsort(key)
    same = np.append(False, key[order][1:] == key[order][:-1])
    group = np.flatnonzero(~same)
    low = np.minimum.reduceat(least_id[of[order]], group) if len(group) else np.zeros(0, np.int64)
    smallest = np.empty(len(at), dtype=np.int64)
    sizes = np.diff(np.append(group, len(order)))
    smallest[order] = np.repeat(low, sizes)
    # equal hashes are confirmed by the windows' bytes; should two differ, the group is counted by its bytes
    s, e = words.starts[at], words.ends[at + k - 1]
    for g in np.flatnonzero(sizes > 1).tolist():
        members = order[group[g] : group[g] + sizes[g]].tolist()
        first = strings[s[members[0]] : e[members[0]]]
        if any(strings[s[i] : e[i]] != first for i in members[1:]):
            by: dict[bytes, int] = {}
            for i in members:
                w = strings[s[i] : e[i]]
                by[w] = min(by.get(w, int(least_id[of[i]])), int(least_id[of[i]]))
            for i in members:
                smallest[i] = by[strings[s[i] : e[i]]]
    return np.cumsum(n) - n, n, smallest


def _count(k: int):
    """Per block of a bucket, its windows that also start in a smaller document than one in which the block has them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in C.sorted_groups(batches, ["bucket"]):
            strings = b"\n".join(_unpack(x) for x in group.column("strings").to_pylist())
            docs = [np.frombuffer(_unpack(x), "<i8").reshape(2, -1) for x in group.column("docs").to_pylist()]
            least = np.concatenate([d[0] for d in docs])
            greatest = least + np.concatenate([d[1] for d in docs])
            first, n, smallest = repeated_windows(strings, least, k)
            of = np.repeat(np.arange(len(n)), n)
            found = np.flatnonzero(smallest < greatest[of])
            cuts = np.searchsorted(of[found], np.cumsum([0, *(d.shape[1] for d in docs)]))
            at, out = 0, []
            for block, d, lo, hi in zip(group.column("block").to_pylist(), docs, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if hi > lo:
                    answer = np.zeros(hi - lo, dtype=_ANSWER)
                    own = found[lo:hi]
                    answer["string"], answer["window"], answer["least"] = of[own] - at, own - first[of[own]], smallest[own]
                    out.append((block, _pack(b"".join(answer[f].tobytes() for f in _ANSWER.names))))
                at += d.shape[1]
            bucket = group.column("bucket")[0].as_py()
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([bucket] * len(out), pa.int32()), pa.array([r[1] for r in out], pa.binary())], names=["block", "bucket", "answer"])

    return count


def _gone(words: C.Words, rows: pa.RecordBatch, buf: np.ndarray, offsets: np.ndarray, answers: dict[int, bytes], k: int, m: int, buckets: int) -> np.ndarray:
    """Which words of a block are covered by windows that also start in a smaller document."""
    change = np.zeros(len(words.starts) + 1, dtype=np.int64)
    if answers:
        s = _Strings(rows, buf, offsets, k, m, buckets)
        for bucket, lo, _ in s.by_bucket():
            if bucket not in answers:
                continue
            raw = np.frombuffer(_unpack(answers[bucket]), np.uint8)
            n = len(raw) // _ANSWER.itemsize
            string, window, least = raw[: 4 * n].view("<u4").astype(np.int64) + lo, raw[4 * n : 8 * n].view("<u4").astype(np.int64), raw[8 * n :].view("<i8")
            occurrence = s.order[C.ranges(s.first[string], s.n[string])]
            window, least = np.repeat(window, s.n[string]), np.repeat(least, s.n[string])
            text = s.text[occurrence]
            hit = least < s.ids[text]
            at = words.first[text[hit]] + s.pos[occurrence[hit]] + window[hit]
            np.add.at(change, at, 1)
            np.add.at(change, at + k, -1)
    return np.cumsum(change)[:-1] > 0


def _cut(k: int, m: int, buckets: int, names: list[str], with_text: bool, as_is: bool):
    """The rows of each block, with the counts of their words and the text of the kept ones, or its SHA-256."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in C.sorted_groups(batches, ["block"]):
            found = group.column("bucket").to_pylist()
            blobs = [i for i, b in enumerate(found) if b == -1]  # equal blocks come more than once
            answers = {b: group.column("answer")[i].as_py() for i, b in enumerate(found) if b >= 0}
            rows, buf, offsets = _opened(group.column("answer")[blobs[0]].as_py())
            words = C.Words(buf, offsets)
            keep = ~_gone(words, rows, buf, offsets, answers, k, m, buckets)
            raw = buf.tobytes()
            kept_per = np.add.reduceat(np.append(keep, False).astype(np.int64), words.first[:-1]) * (words.counts > 0)
            kept_words = np.flatnonzero(keep)
            s, e = words.starts[kept_words].tolist(), words.ends[kept_words].tolist()
            ends = np.cumsum(kept_per).tolist()
            texts = [b" ".join([raw[s[i] : e[i]] for i in range(lo, hi)]) for lo, hi in zip([0, *ends[:-1]], ends, strict=True)]
            if as_is:
                same = np.flatnonzero(kept_per == words.counts).tolist()
                for i in same:
                    texts[i] = raw[offsets[i] : offsets[i + 1]]
            last = pa.array([t.decode() for t in texts], pa.string()) if with_text else pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())
            carried = [rows.column(rows.schema.get_field_index(c)) for c in names]
            out = pa.RecordBatch.from_arrays([*carried, pa.array(words.counts.astype(np.int64)), pa.array((words.counts - kept_per).astype(np.int64)), last], names=[*names, "n_words", "n_removed", "kept"])
            for _ in blobs:
                yield out

    return cut


def substring_dedup(docs: DataFrame, k: int = 13, m: int = 4, with_text: bool = True, as_is: bool = False, bucket_bytes: int = 5 << 20, block_bytes: int = 4 << 20) -> DataFrame:
    """The columns of docs without its text, then n_words, n_removed and kept (`_kept` and so on where docs has such a column).

    kept is the text of the kept words, joined by one space, or with with_text=False its SHA-256; with as_is a text that
    loses nothing stays as it is.
    """
    others = [c for c in docs.columns if c != "text"]
    names = [f"_c{i}" for i in range(len(others))]
    plain = docs.toDF(*[names[others.index(c)] if c in others else "_t" for c in docs.columns])
    keyed = plain.select(F.coalesce(F.col("_t").cast("string"), F.lit("")).alias("_text"), C.row_id(names[others.index("doc_id")]).alias("_id"), *names)
    carried = keyed.select(*names).schema
    blocks = C.materialised(keyed.mapInArrow(_blocks(block_bytes), "block long, blob binary"), "dedup-blocks")
    total = keyed.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    buckets = max(16, 3 * total // bucket_bytes)  # each word is in about three super-k-mers
    sent = blocks.mapInArrow(_send(k, m, buckets), _SENT)
    answers = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_count(k), "block long, bucket int, answer binary")
    both = blocks.select("block", F.lit(-1).alias("bucket"), F.col("blob").alias("answer")).unionByName(answers)
    schema = StructType([*carried.fields, StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType())])
    out = both.repartition("block").sortWithinPartitions("block", "bucket").mapInArrow(_cut(k, m, buckets, names, with_text, as_is), schema)
    return out.toDF(*others, *("_" * (c in others) + c for c in ("n_words", "n_removed", "kept")))
