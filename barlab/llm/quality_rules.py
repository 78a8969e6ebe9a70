"""Quality rules: a decision list learned by sequential covering.

Statistics of every text are taken in one pass. On a bounded sample of labelled rows, rules for rejection are learned
one after another: conditions on thresholds are added while they raise the information gain on the growing part, cut
back from the end while that raises the worth on the pruning part, and the rule is kept if it is right more often than
not there; the rows that it covers leave the sample. The list is emitted as one ordered Spark conditional expression.

Defined cases: null and empty texts have no words and fail the base rule; ratios over no words are 0; a label that is
null, or contradicted by another row of its id, is not learned from; without both classes the list is empty; equal gains
go to the first feature by name and its lowest threshold; repeated rows get one verdict each, the same; an empty table
gives an empty result; other columns of docs, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlab.llm import common as C

SAMPLE = 20_000
#: A rule must be right for this share of the rows it covers, when pruned, and cover this many rows.
LEAST_PRECISION, LEAST_COVER = 0.8, 5

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_punct", "n_upper")
#: What the rules may test, as Spark expressions over the statistics.
FEATURES = {
    "words": "double(n_words)",
    "word_length": "coalesce(try_divide(word_chars, n_words), 0d)",
    "symbol_share": "coalesce(try_divide(n_symbols, n_words), 0d)",
    "dup_line_share": "coalesce(try_divide(n_dup_lines, n_lines), 0d)",
    "repeat_share": "coalesce(try_divide(n_repeat_words, n_words), 0d)",
    "punct_share": "coalesce(try_divide(n_punct, n_words), 0d)",
    "upper_share": "coalesce(try_divide(n_upper, n_words), 0d)",
    "line_words": "coalesce(try_divide(n_words, n_lines), 0d)",
}


def text_statistics(buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The statistics of each text."""
    n = len(offsets) - 1
    words = C.Words(buf, offsets)

    def per(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[offsets[1:]] - total[offsets[:-1]]

    prefix = C.Prefix(buf)
    hashes = prefix.slices(words.starts, words.ends)
    at, text = C.window_starts(words.first, 3)
    key = C.mix(C.window_hashes(hashes, 3)[at] + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(words.starts) + 4, dtype=np.int64)
    cover[at[twice]] += 1
    cover[at[twice] + 3] -= 1  # one window starts at each position
    covered = np.concatenate([[0], np.cumsum(np.cumsum(cover)[: len(words.starts)] > 0)])

    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[offsets] = True
    breaks = np.flatnonzero(buf == 10)
    starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    starts = starts[starts < len(buf)] if len(buf) else starts[:0]
    stop = np.zeros(len(buf) + 1, dtype=bool)
    stop[breaks] = True
    stop[offsets] = True
    stops = np.flatnonzero(stop)
    ends = stops[np.searchsorted(stops, starts + (buf[starts] != 10 if len(starts) else 0))] if len(starts) else starts
    line_text = np.searchsorted(offsets, starts, side="right") - 1
    full = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    line_key = C.mix(prefix.slices(starts, ends) + line_text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[full]
    line_text = line_text[full]
    _, first = np.unique(line_key, return_index=True)
    lines = np.bincount(line_text, minlength=n)
    return {
        "n_words": words.counts,
        "word_chars": per(~C._SEP[buf] & ((buf & 0xC0) != 0x80)),
        "n_symbols": per(_SYMBOL[buf]),
        "n_dup_lines": lines - np.bincount(line_text[first], minlength=n),
        "n_repeat_words": covered[words.first[1:]] - covered[words.first[:-1]],
        "n_lines": lines,
        "n_punct": per((buf == 44) | (buf == 46)),
        "n_upper": per((buf >= 65) & (buf <= 90)),
    }


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, buf, offsets in C.text_chunks(batches):
        found = text_statistics(buf, offsets)
        yield pa.RecordBatch.from_arrays([rows.column("_id"), *(pa.array(found[s].astype(np.int64)) for s in STATISTICS)], names=["_id", *STATISTICS])


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    value: float

    def column(self) -> Column:
        x = F.expr(FEATURES[self.feature])
        return x > F.lit(self.value) if self.above else x <= F.lit(self.value)

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        return table[self.feature] > self.value if self.above else table[self.feature] <= self.value


def covered_by(rule: list[Condition], table: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, dtype=bool)
    for c in rule:
        out &= c.holds(table)
    return out


def _best_condition(table: dict[str, np.ndarray], bad: np.ndarray, inside: np.ndarray) -> tuple[float, Condition | None]:
    """The condition with the largest information gain among the rows inside."""
    p0, n0 = int((bad & inside).sum()), int(inside.sum())
    best: tuple[float, Condition | None] = (1e-9, None)
    base = np.log2(p0 / n0)
    for name in sorted(table):
        x = table[name][inside]
        order = np.argsort(x, kind="stable")
        x, hit = x[order], np.cumsum(bad[inside][order])
        cut = np.flatnonzero(x[1:] > x[:-1])
        if not len(cut):
            continue
        below_p, below_n = hit[cut], cut + 1
        for above, p, m in ((False, below_p, below_n), (True, p0 - below_p, n0 - below_n)):
            gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / m) - base), 0.0)
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (float(gain[i]), Condition(name, above, float((x[cut[i]] + x[cut[i] + 1]) / 2)))
    return best


def learn(table: dict[str, np.ndarray], bad: np.ndarray, seed: int = 3, most_rules: int = 20, most_conditions: int = 4) -> list[list[Condition]]:
    """Ordered rules; a row that meets all conditions of one is rejected."""
    left = np.ones(len(bad), dtype=bool)
    rules: list[list[Condition]] = []
    rng = np.random.default_rng(seed)
    while len(rules) < most_rules and (bad & left).sum() >= LEAST_COVER:
        grow = left & (rng.random(len(bad)) < 2 / 3)
        prune = left & ~grow
        rule: list[Condition] = []
        inside = grow.copy()
        while len(rule) < most_conditions and 0 < (bad & inside).sum() < inside.sum():
            _, c = _best_condition(table, bad, inside)
            if c is None:
                break
            rule.append(c)
            inside &= c.holds(table)

        def worth(r: list[Condition], rows: np.ndarray) -> float:
            at = covered_by(r, table, len(bad)) & rows
            p, n = int((at & bad).sum()), int((at & ~bad).sum())
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1], prune) >= worth(rule, prune):
            rule = rule[:-1]
        at = covered_by(rule, table, len(bad)) & left
        checked = at & prune
        if not rule or at.sum() < LEAST_COVER or not checked.any() or (checked & bad).sum() < LEAST_PRECISION * checked.sum():
            break
        rules.append(rule)
        left &= ~at
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """True where no rule of the ordered list rejects the row."""
    out = None
    for rule in rules:
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def quality_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, list[list[Condition]]]:
    """(doc_id, statistics, base_failed, kept) of every row, and the learned rules."""
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    stats = C.materialised(texts.mapInArrow(_statistics, "_id long, " + ", ".join(f"{s} long" for s in STATISTICS)), "quality-statistics")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    known = (
        labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("other")).where("q = other")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("_id"), "q")
    )
    # `sample` rows at most come to the driver
    rows = stats.where(~failed).join(F.broadcast(known), "_id").select("q", *(F.expr(e).alias(f) for f, e in FEATURES.items())).orderBy(F.xxhash64("q", *FEATURES)).limit(sample).toPandas()
    table = {f: rows[f].to_numpy(dtype=np.float64) for f in FEATURES}
    rules = learn(table, rows["q"].to_numpy() == 0)
    return stats.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(rules)).withColumnRenamed("_id", "doc_id"), rules
