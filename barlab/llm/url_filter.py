"""URL filters from a sorted digest array.

Rules (host, path) are kept as the sorted 64-bit xxhash of host and path, with their full strings beside. A task maps
the array from a file in its own temporary folder, which is removed as soon as it is mapped, probes all candidates of
a batch of urls with one vectorised binary search, and confirms each hit by the stored string. A url's candidates are
the suffixes of its host joined with the prefixes of its path, of the lengths that rules have.

An array larger than `shard_bytes` is split, and its shards are applied one after another, so no broadcast exceeds that
bound; the longest rule wins over all of them.

Defined cases: a null url and one without `://` have an empty host and path and match no rule; unmatched urls get the
default verdict; rules that repeat count once, the last verdict holds; repeated pages get one row each; an empty table
gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import mmap
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1), F.lit(""))


def digest_array(rules: list[tuple[str, str, str]], digest=xxhash.xxh64_intdigest) -> bytes:
    """(verdict, host, path) rules as: their number, sorted digests, string offsets, verdict codes, strings."""
    unique = {f"{host}{path}".encode(): verdict for verdict, host, path in rules}
    keyed = sorted((digest(s), s, v) for s, v in unique.items())
    strings = [s for _, s, _ in keyed]
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype("<u8")
    verdicts = np.array([v == "allow" for _, _, v in keyed], dtype="u1")
    return np.array([len(keyed)], "<u8").tobytes() + np.array([k for k, _, _ in keyed], "<u8").tobytes() + offsets.tobytes() + verdicts.tobytes() + b"".join(strings)


class DigestArray:
    def __init__(self, raw, digest=xxhash.xxh64_intdigest):
        n = int(np.frombuffer(raw, "<u8", 1)[0])
        self.keys = np.frombuffer(raw, "<u8", n, 8)
        self.offsets = np.frombuffer(raw, "<u8", n + 1, 8 + 8 * n)
        self.allow = np.frombuffer(raw, "u1", n, 16 + 16 * n)
        self.strings = memoryview(raw)[16 + 17 * n :]
        self.digest = digest

    def find(self, candidates: list[bytes]) -> np.ndarray:
        """The rule's index of each candidate, or -1."""
        out = np.full(len(candidates), -1, dtype=np.int64)
        if not len(self.keys) or not candidates:
            return out
        keys = np.array([self.digest(c) for c in candidates], dtype=np.uint64)
        at = np.searchsorted(self.keys, keys)
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys).tolist():
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == keys[i]:  # digests may collide; strings decide
                if self.strings[int(self.offsets[j]) : int(self.offsets[j + 1])] == candidates[i]:
                    out[i] = j
                j += 1
        return out


def mapped(raw: bytes) -> mmap.mmap:
    with tempfile.TemporaryFile(dir=os.environ.get("TMPDIR") or None) as f:
        f.write(raw)
        f.flush()
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)


def candidates(host: str, path: str, lengths: list[int]) -> list[bytes]:
    labels = host.split(".") if host else []
    prefixes = [path[:n] for n in lengths if n <= len(path)]
    return [f"{'.'.join(labels[i:])}{p}".encode() for i in range(len(labels)) for p in prefixes]


def _probe(array, lengths: list[int]):
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = DigestArray(mapped(array.value))
        for rows in batches:
            i, j = rows.schema.get_field_index("_rule"), rows.schema.get_field_index("_verdict")
            hosts, paths = rows.column("_host").to_pylist(), rows.column("_path").to_pylist()
            best, verdict = rows.column("_rule").to_pylist(), rows.column("_verdict").to_pylist()
            flat: list[bytes] = []
            ends = []
            for h, p in zip(hosts, paths, strict=True):
                flat += candidates(h, p, lengths)
                ends.append(len(flat))
            hit = found.find(flat)
            owner = np.searchsorted(np.array(ends), np.flatnonzero(hit >= 0), side="right")
            for c, row in zip(np.flatnonzero(hit >= 0).tolist(), owner.tolist(), strict=True):
                rule = flat[c].decode()
                if best[row] is None or (len(rule), best[row]) > (len(best[row]), rule):
                    best[row], verdict[row] = rule, "allow" if found.allow[hit[c]] else "block"
            out = list(rows.columns)
            out[i], out[j] = pa.array(best, pa.string()), pa.array(verdict, pa.string())
            yield pa.RecordBatch.from_arrays(out, names=rows.schema.names)

    return probe


def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", default: str = "allow", shard_bytes: int = 64 << 20) -> DataFrame:
    """(id, host, path, rule, verdict) of every row."""
    host, path = url_parts(F.col("url").cast("string"))
    out = pages.select(F.col(id_col).alias("_key"), host.alias("_host"), path.alias("_path"), F.lit(None).cast("string").alias("_rule"), F.lit(default).alias("_verdict"))
    lengths = sorted({len(p) for _, _, p in rules})
    shards: list[list[tuple[str, str, str]]] = [[]]
    size = 0
    for r in dict.fromkeys(rules):
        size += len(f"{r[1]}{r[2]}".encode()) + 17
        if size > shard_bytes:
            shards.append([])
            size = 0
        shards[-1].append(r)
    for shard in shards:
        array = pages.sparkSession.sparkContext.broadcast(digest_array(shard))
        out = out.mapInArrow(_probe(array, lengths), out.schema)
    return out.toDF(id_col, "host", "path", "rule", "verdict")
