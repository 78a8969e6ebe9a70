"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Features are hashed byte n-grams of 3 to 7 bytes inside one word with a space before and after it, A-Z lower-cased.
A feature's value is log(1 + its count in the text) times the log ratio of its smoothed document frequencies among
toxic and clean training texts; logistic regression with an L2 penalty is fitted to these values.

The classifier is fitted on a sample of at most `sample` labelled rows (the smallest hashes of their ids), in one task,
which reads the sample twice and keeps only features that tell the classes apart. Scoring is one pass over the texts
with no shuffle; the model that is broadcast has 2^18 weights.

Defined cases: null and empty texts get the score of a text without features; a label that is null, or an id that
labels hold more than once with different values, is not learned from; with one class only, every score is its share,
with no labelled row one half; repeated rows are scored alike; an empty table gives an empty result. score names its
columns itself; keep_clean returns the columns of docs, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.llm import common as C

LENGTHS = (3, 4, 5, 6, 7)
BITS = 18
SAMPLE = 4000
#: Features whose absolute log ratio is smaller, or that fewer texts hold, do not take part.
LEAST_RATIO, LEAST_TEXTS = 1.0, 3
L2 = 1.0


def spaced(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes with a space around every text and for all white space, the offsets, and separator counts."""
    lower = buf + np.where((buf >= 65) & (buf <= 90), np.uint8(32), np.uint8(0))
    lower[C._SEP[lower]] = 32
    n = len(offsets) - 1
    out = np.full(len(buf) + 2 * n, 32, dtype=np.uint8)
    if len(buf):
        shift = np.zeros(len(buf), dtype=np.int64)
        np.add.at(shift, offsets[1:-1][offsets[1:-1] < len(buf)], 2)
        out[np.arange(len(buf)) + np.cumsum(shift) + 1] = lower
    return out, offsets + 2 * np.arange(n + 1), np.concatenate([[0], np.cumsum(out == 32)])


def features(buf: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position, feature) of every n-gram, or of those in `wanted`, one n at a time."""
    prefix = C.Prefix(buf)
    spaces = np.cumsum(buf == 32)
    for n in LENGTHS:
        m = len(buf) - n + 1
        if m <= 0:
            continue
        h = prefix.sums[n:] - prefix.sums[:m]
        h *= prefix.down[:m]
        h *= np.uint64(0xD6E8FEB86659FD93 + 2 * n)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        f = (h >> np.uint64(64 - BITS)).astype(np.int32)
        inner = spaces[n - 2 : n - 2 + m] == spaces[:m]  # no space strictly inside
        at = np.flatnonzero(inner if wanted is None else inner & wanted[f])
        yield at, f[at]


def counted(buf: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, count) of the wanted features of each text."""
    text, offsets, _ = spaced(buf, offsets)
    keys = [(np.searchsorted(offsets, at, side="right") - 1) << BITS | f for at, f in features(text, offsets, wanted)]
    key, count = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True)
    return key >> BITS, key & ((1 << BITS) - 1), count


def logistic(text: np.ndarray, feature: np.ndarray, value: np.ndarray, y: np.ndarray, width: int, rounds: int = 80) -> np.ndarray:
    """Weights and bias that minimise the penalised logistic loss (limited-memory quasi-Newton steps)."""
    n = len(y)

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(text, weights=value * x[:-1][feature], minlength=n) + x[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        value_ = -np.log(np.where(y == 1, p, 1 - p) + 1e-12).sum() + L2 * (x[:-1] ** 2).sum() / 2
        return value_, np.append(np.bincount(feature, weights=value * (p - y)[text], minlength=width) + L2 * x[:-1], (p - y).sum())

    x = np.append(np.zeros(width), np.log(y.mean() / (1 - y.mean())))
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    f, g = loss(x)
    for _ in range(rounds):
        q, alphas = g.copy(), []
        for s, d in reversed(steps):
            alphas.append((s @ q) / (d @ s))
            q -= alphas[-1] * d
        q *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(1.0, np.abs(g).max())
        for (s, d), a in zip(steps, reversed(alphas), strict=True):
            q += s * (a - (d @ q) / (d @ s))
        t = 1.0
        while True:
            new = x - t * q
            fn, gn = loss(new)
            if fn <= f - 1e-4 * t * (g @ q) or t < 1e-6:
                break
            t /= 2
        if (gn - g) @ (new - x) > 1e-12:
            steps = [*steps, (new - x, gn - g)][-8:]
        done = f - fn < 1e-5 * abs(f)
        x, f, g = new, fn, gn
        if done:
            break
    return x


def train(chunks: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> tuple[np.ndarray, float]:
    """(weight per hashed feature, bias) from (bytes, offsets) chunks of texts and their labels."""
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return np.zeros(1 << BITS, np.float32), float(np.log((share + 1e-4) / (1 - share + 1e-4)))
    toxic, clean = np.zeros(1 << BITS), np.zeros(1 << BITS)
    at = 0
    for buf, offsets in chunks:
        text, feature, _ = counted(buf, offsets, None)
        is_toxic = y[at + text] == 1
        toxic += np.bincount(feature[is_toxic], minlength=1 << BITS)
        clean += np.bincount(feature[~is_toxic], minlength=1 << BITS)
        at += len(offsets) - 1
    ratio = np.log((toxic + 0.5) / (y.sum() + 1)) - np.log((clean + 0.5) / ((1 - y).sum() + 1))
    wanted = (np.abs(ratio) >= LEAST_RATIO) & (toxic + clean >= LEAST_TEXTS)
    column = np.cumsum(wanted) - 1
    parts, at = [], 0
    for buf, offsets in chunks:
        text, feature, count = counted(buf, offsets, wanted)
        parts.append((text + at, feature, np.log1p(count)))
        at += len(offsets) - 1
    text, feature, value = (np.concatenate(p) for p in zip(*parts, strict=True))
    x = logistic(text, column[feature], value * ratio[feature], y, int(wanted.sum()))
    weights = np.zeros(1 << BITS)
    weights[wanted] = x[:-1] * ratio[wanted]
    return weights.astype(np.float32), float(x[-1])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunks, y = [], []
    for rows, buf, offsets in C.text_chunks(batches):
        chunks.append((buf, offsets))
        y.append(rows.column("toxic").to_numpy())
    weights, bias = train(chunks, np.concatenate(y).astype(np.float64) if y else np.zeros(0))
    yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([bias])], names=["weights", "bias"])


def learnable(id_col: str = "doc_id"):
    """Rows to learn from: crc32 of the id as text, mod 4, is not 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """The model of a sample of labelled rows outside the held-out quarter."""
    chosen = (
        labels.where(learnable() & F.col("toxic").isin(0, 1))
        .groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    # `sample` ids at most are broadcast; where ids repeat in docs, `sample` rows of theirs at most are learned from
    rows = texts.join(F.broadcast(chosen), "_id").orderBy(F.xxhash64("_id"), "_id", F.xxhash64("_text")).limit(sample).repartition(1).sortWithinPartitions("_id", "_text").mapInArrow(_fit, "weights binary, bias double").collect()
    if not rows:
        return np.zeros(1 << BITS, np.float32), 0.0
    return np.frombuffer(rows[0]["weights"], np.float32), rows[0]["bias"]


def _score(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value
        wanted = weights != 0
        for rows, buf, offsets in C.text_chunks(batches):
            text, feature, count = counted(buf, offsets, wanted)
            z = np.bincount(text, weights=np.log1p(count) * weights[feature], minlength=len(offsets) - 1) + bias
            i = rows.schema.get_field_index("_text")
            out = [c for j, c in enumerate(rows.columns) if j != i]
            names = [c for j, c in enumerate(rows.schema.names) if j != i]
            yield pa.RecordBatch.from_arrays([*out, pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))))], names=[*names, "score"])

    return score


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """(doc_id, score) of every text."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    return texts.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, score double")


def keep_clean(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.3) -> DataFrame:
    """The rows of `docs` whose score is under the threshold, with all their columns."""
    columns = [f"_c{i}" for i in range(len(docs.columns))]
    renamed = docs.toDF(*columns).withColumn("_text", F.coalesce(F.col(columns[docs.columns.index("text")]).cast("string"), F.lit("")))
    schema = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(columns, docs.schema, strict=True)) + ", score double"
    return renamed.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), schema).where(F.col("score") < threshold).drop("score").toDF(*docs.columns)
