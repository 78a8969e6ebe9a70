"""Periodic runs of words: Lyndon arrays by Baier's grouping, Lyndon roots extended into runs.

A run is a stretch of consecutive words with smallest period q, of at least max(6, 4 q) words, that no neighbouring word
extends. Phase one of Baier's suffix sorter keeps suffixes in ordered groups by a common prefix and goes through the
groups from the greatest: what stands before k members in a row gets their prefix k times behind its own, and so a new
group just above its old one. When a group is reached, its prefix is the longest Lyndon word at its members: the Lyndon
array, without sorting suffixes further. Members in a row are a Lyndon root u repeated; done for the order of words and
for the reverse one, this gives every run's root. A run of four periods holds u three times in a row at least, so only such
rows of members are extended, by longest common extensions at the distance |u| to the left and right.

Before that, stretches are cut down: each word of a run occurs in it four times or more, so words that occur less often
in their stretch belong to no run and split it, and stretches under six words go. That is vectorised over many texts and
leaves the grouping what repeats.

One pass over the documents without a shuffle; a task holds one chunk of texts (2 MB, or one longer text). Words are told
apart within a text by 64-bit hashes of their bytes. Defined cases: null and empty texts have no words, no runs and the
hashes of the empty string; repeated rows each get their own row; an empty table gives an empty result; other columns
are ignored. The rewriting of the query (every tenth crc32 of the id) takes no part for a null id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.llm import common as C

#: A run has four periods and six words or more.
PERIODS, SHORTEST = 4, 6
_CUT_ROUNDS = 8
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def lyndon_groups(x: list[int], symbols: int) -> Iterator[tuple[int, int, int]]:
    """(start, period, k) of every Lyndon word that stands k times in a row, k as large as it can be, by groups from the greatest.

    Positions that are not done form a chain in which each is followed by the end of its own prefix, so the length of the
    longest Lyndon word at a position is the distance to its successor in the chain when its group is reached.
    """
    n = len(x)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    group = list(x)
    members: list[list[int]] = [[] for _ in range(symbols)]
    for i, g in enumerate(x):
        members[g].append(i)
    lower, upper = list(range(-1, symbols - 1)), list(range(1, symbols + 1))
    top = symbols - 1
    while top >= 0:
        moved: dict[tuple[int, int], list[int]] = {}
        for i in members[top]:
            if group[i] != top:  # it has gone to a greater group
                continue
            j = before[i]
            if j >= 0 and group[j] == top:  # not the first of those in a row
                continue
            k, end = 0, i
            while end < n and group[end] == top:
                k += 1
                end = after[end]
            yield i, after[i] - i, k
            if end < n:
                before[end] = j
            if j >= 0:
                after[j] = end
                moved.setdefault((group[j], -k), []).append(j)
        for old, k in sorted(moved):  # the most often repeated first, each just above the old group
            new, above = len(members), upper[old]
            members.append(moved[old, k])
            lower.append(old)
            upper.append(above)
            lower[above] = upper[old] = new
            for j in members[new]:
                group[j] = new
        top = lower[top]


def extension(x: list[int], a: int, b: int, most: int) -> int:
    """How many words are equal from a and from b on, `most` at most."""
    found, step = 0, 1
    while found + step <= most and x[a + found : a + found + step] == x[b + found : b + found + step]:
        found += step
        step *= 2
    while step:
        if found + step <= most and x[a + found : a + found + step] == x[b + found : b + found + step]:
            found += step
        step //= 2
    return found


def runs_of(x: list[int], symbols: int) -> set[tuple[int, int, int]]:
    """(start, length, period) of the runs of a text of words 0 .. symbols - 1."""
    n, found = len(x), set()
    mirrored = x[::-1]
    for text in (x, [symbols - 1 - w for w in x]):
        for i, p, k in lyndon_groups(text, symbols):
            if k < PERIODS - 1:
                continue
            end = i + k * p
            end += extension(x, end - p, end, n - end)
            start = i - extension(mirrored, n - i - p, n - i, i)
            if end - start >= max(SHORTEST, PERIODS * p):
                found.add((start, end - start, p))
    return found


def stretches(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, length) of the stretches of words that may hold runs; equal words have equal values, text says whose they are."""
    at, own = np.arange(len(words)), text.astype(np.uint64)
    for _ in range(_CUT_ROUNDS):
        if not len(at):
            break
        key = C.mix(words[at] ^ C.mix(own + np.uint64(1)))
        order = np.argsort(key)
        first = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
        sizes = np.diff(np.append(first, len(order)))
        often = np.empty(len(at), dtype=bool)
        often[order] = np.repeat(sizes >= PERIODS, sizes)
        kept, kept_own = at[often], own[often]
        if not len(kept):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        new = np.append(True, (kept[1:] != kept[:-1] + 1) | (kept_own[1:] != kept_own[:-1]))
        number = np.cumsum(new) - 1
        long = (np.bincount(number) >= SHORTEST)[number]
        done = len(kept) == len(at) and long.all()
        at, own = kept[long], number[long].astype(np.uint64)
        if done:
            break
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    return at[new], np.diff(np.append(new, len(at)))


def chunk_runs(words: np.ndarray, first: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """The runs of each text that has some, by start, then period; text i has the words first[i] .. first[i + 1]."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for a, n in zip(*(v.tolist() for v in stretches(words, text)), strict=True):
        distinct, x = np.unique(words[a : a + n], return_inverse=True)
        runs = runs_of(x.tolist(), len(distinct))
        if runs:
            own = int(text[a])
            found.setdefault(own, []).extend((s + a - int(first[own]), length, p) for s, length, p in runs)
    return {own: sorted(runs, key=lambda r: (r[0], r[2])) for own, runs in found.items()}


def greatest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run with the greatest length / period; ties go to the smallest start, then period."""
    best = runs[0]
    for r in runs[1:]:
        a, b = r[1] * best[2], best[1] * r[2]
        if a > b or a == b and (r[0], r[2]) < (best[0], best[2]):
            best = r
    return best


def repeated_tail(checksum: int, n: int) -> tuple[int, int]:
    """(a, p): in the query's documents whose checksum is a multiple of ten, words from a on repeat the first p of them."""
    g = checksum // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _find(rewrite: bool):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offsets in C.text_chunks(batches):
            words = C.Words(buf, offsets)
            first, counts = words.first, words.counts.tolist()
            source = np.arange(len(words.starts))
            for i, h in enumerate(rows.column("checksum").to_pylist() if rewrite else []):
                if h is not None and h % 10 == 0 and counts[i]:
                    a, p = repeated_tail(h, counts[i])
                    source[first[i] + a : first[i + 1]] = first[i] + a + np.arange(counts[i] - a) % p
            hashes = C.Prefix(buf).slices(words.starts, words.ends)[source]
            runs = chunk_runs(hashes, first)
            keep = np.ones(len(source), dtype=bool)
            for i, own in runs.items():
                for s, length, p in own:
                    keep[first[i] + s + p : first[i] + s + length] = False
            kept = source[keep]
            sizes = words.ends[kept] - words.starts[kept] + 1
            out = np.append(buf, np.uint8(32))[C.ranges(words.starts[kept], sizes)]
            ends = np.cumsum(sizes)
            out[ends - 1] = 32
            per = np.append(0, np.cumsum(keep))[first]
            ends = np.append(0, ends)[per].tolist()
            raw = memoryview(out.tobytes())
            collapsed = [hashlib.sha256(raw[a : max(a, b - 1)]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            best = [greatest(runs[i]) if i in runs else None for i in range(len(counts))]
            lines = ["".join(f"{s},{length},{p}\n" for s, length, p in runs.get(i, ())) for i in range(len(counts))]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array([len(runs.get(i, ())) for i in range(len(counts))], pa.int64()), *(pa.array([b and b[j] for b in best], pa.int64()) for j in range(3)), pa.array([b and 1000 * b[1] // b[2] for b in best], pa.int64()), pa.array([hashlib.sha256(s.encode()).hexdigest() for s in lines]), pa.array(collapsed, pa.string())],
                names=[c.split()[0] for c in SCHEMA.split(", ")],
            )

    return find


def periodic_runs(docs: DataFrame, rewrite: bool = False) -> DataFrame:
    """One row per document: its runs, the greatest of them, and its text without what repeats (SCHEMA).

    `rewrite` makes the repetitions that the query's contract asks for.
    """
    number = F.col("doc_id").cast("long")
    texts = docs.select(number.alias("doc_id"), F.crc32(number.cast("string").cast("binary")).alias("checksum"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    return texts.mapInArrow(_find(rewrite), SCHEMA)
