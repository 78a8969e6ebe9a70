"""Language identification: blended-spectrum string kernels, Nystrom landmarks, one-versus-rest kernel ridge regression.

The kernel of two texts is the number of distinct n-grams of 1 to 4 bytes that both hold (presence, not counts; lower-case,
white space as one space, one before and after each text), divided by the root of the product of their own numbers. A set
of landmark texts spans the Nystrom space: features are K(x, landmarks) K(landmarks, landmarks)^(-1/2). Ridge regression on
them gives a value per language, trained against all others with targets 1 and -1; the greatest wins.

Scoring is one pass without a shuffle. A batch of texts is a 0/1 matrix over the n-grams that landmarks hold, multiplied
by the landmarks' matrix in blocks of columns, then by the regression weights. N-grams that no landmark holds count in
a text's own number alone.

Learned from: at most `per_language` texts of each language, by the smallest hashes, those of at most `short` bytes first;
of these the first are landmarks, `landmarks` in all divided among the languages (two each at least). Normal equations
are summed in tasks; what is collected and broadcast grows with the number of languages and landmarks only.

Defined cases: a text that is null or has no letter is `und` with score 0, as is everything where nothing can be learned; with
one language it is predicted with a score of about 1; rows of equal id and text are learned from once; ties go to the smaller language;
repeated rows are scored alike; a null id is neither learned from nor held out; an empty table gives an empty result; other
columns are ignored. The score is (1 + value) / 2, cut to 0 to 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlab.llm import common as C
from barlab.llm.toxicity import learnable, spaced

LENGTHS = (1, 2, 3, 4)
UNKNOWN = "und"
#: Texts scored at once, and n-grams of the landmarks in one block of columns: the 0/1 matrix has at most 16 MB.
_TEXTS, _BLOCK = 256, 16_384
RIDGE = 1e-4


def grams(buf: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, n-gram) of the distinct n-grams of each text, for one length after the other, sorted; n-grams carry their length in the top byte."""
    buf, offsets, _ = spaced(buf, offsets)
    single = np.append(True, (buf[1:] != 32) | (buf[:-1] != 32))  # runs of spaces count as one
    single[offsets[:-1]] = True
    offsets = np.append(0, np.cumsum(single))[offsets]
    buf = buf[single]
    text = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(offsets))
    code = np.zeros(len(buf), dtype=np.uint64)
    for n in LENGTHS:
        if len(buf) < n:
            return
        code = (code[: len(buf) - n + 1] << np.uint64(8)) | buf[n - 1 :]
        inside = text[: len(code)] == text[n - 1 :]
        key = np.sort(((text[: len(code)] << np.uint64(40)) | np.uint64(n << 32) | code)[inside])
        key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
        yield (key >> np.uint64(40)).astype(np.int64), key & np.uint64((1 << 40) - 1)


@dataclass
class Model:
    """names: the languages; known: the landmarks' n-grams, sorted; rows: their 0/1 matrix, scaled; weights: from kernel values (and 1) to languages."""

    names: list[str]
    known: np.ndarray
    rows: np.ndarray
    weights: np.ndarray | None = None


def kernel(model: Model, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The kernel of each text with each landmark."""
    n = len(offsets) - 1
    own, at, column = np.zeros(n), [], []
    for text, gram in grams(buf, offsets):
        own += np.bincount(text, minlength=n)
        place = np.minimum(np.searchsorted(model.known, gram), len(model.known) - 1)
        held = model.known[place] == gram
        at.append(text[held])
        column.append(place[held])
    at, column = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (at, column))
    out = np.zeros((n, model.rows.shape[1]), dtype=np.float32)
    for a in range(0, len(model.known), _BLOCK):
        here = (column >= a) & (column < a + _BLOCK)
        rows = model.rows[a : a + _BLOCK]
        x = np.zeros((n, len(rows)), dtype=np.float32)
        x[at[here], column[here] - a] = 1
        out += x @ rows
    return out / np.sqrt(np.maximum(own, 1))[:, None]


def landmark_model(texts: list[bytes], names: list[str]) -> Model:
    """The 0/1 matrix of the landmarks, each column over the root of its own number of n-grams."""
    offsets = np.append(0, np.cumsum([len(t) for t in texts]))
    found = list(grams(np.frombuffer(b"".join(texts), np.uint8), offsets))
    text, gram = (np.concatenate(v) for v in zip(*found, strict=True))
    known, place = np.unique(gram, return_inverse=True)
    rows = np.zeros((len(known), len(texts)), dtype=np.float32)
    rows[place, text] = 1
    return Model(names, known, rows / np.sqrt(np.bincount(text, minlength=len(texts))).astype(np.float32))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for rows, buf, offsets in C.text_chunks(batches):
        for a in range(0, rows.num_rows, _TEXTS):
            part = offsets[a : a + _TEXTS + 1]
            yield rows.slice(a, _TEXTS), buf[part[0] : part[-1]], part - part[0]


def _equations(model):
    """A task's share of the normal equations: products of the kernel rows and 1 with themselves and with the targets."""

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        size = m.rows.shape[1] + 1
        inner, outer = np.zeros((size, size)), np.zeros((size, len(m.names)))
        for rows, buf, offsets in _batches(batches):
            x = np.column_stack([kernel(m, buf, offsets), np.ones(rows.num_rows)]).astype(np.float64)
            target = np.where(np.array(rows.column("lang").to_pylist())[:, None] == np.array(m.names)[None, :], 1.0, -1.0)
            inner += x.T @ x
            outer += x.T @ target
        yield pa.RecordBatch.from_arrays([pa.array([inner.tobytes()], pa.binary()), pa.array([outer.tobytes()], pa.binary())], names=["inner", "outer"])

    return equations


def solve(between: np.ndarray, inner: np.ndarray, outer: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights of kernel values and the constant, by ridge regression in the Nystrom space; the constant is not penalised."""
    value, vector = np.linalg.eigh(between)
    kept = value > 1e-6 * value.max()
    root = np.zeros((len(between) + 1, kept.sum() + 1))
    root[:-1, :-1] = vector[:, kept] / np.sqrt(value[kept])
    root[-1, -1] = 1
    penalty = ridge * max(inner[-1, -1], 1) * np.eye(root.shape[1])
    penalty[-1, -1] = 0
    return root @ np.linalg.solve(root.T @ inner @ root + penalty, root.T @ outer)


def chosen_texts(docs: DataFrame, per_language: int, short: int) -> DataFrame:
    """(lang, n, _text): the texts to learn from, numbered from 1 in each language."""
    text = F.lower(F.col("text").cast("string"))
    usable = docs.where(learnable() & F.col("lang").isNotNull() & F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)))
    rows = usable.select(F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", text).alias("h"), (F.octet_length(text) > short).alias("long"), text.alias("_text"))
    best = F.row_number().over(Window.partitionBy("lang").orderBy("long", "h"))
    numbered = rows.select("lang", "h", "long").distinct().withColumn("n", best).where(F.col("n") <= per_language).select("lang", "h", "n")
    # at most per_language rows a language are broadcast
    return rows.join(F.broadcast(numbered), ["lang", "h"]).groupBy("lang", "h", "n").agg(F.first("_text").alias("_text")).drop("h")


def fit(docs: DataFrame, landmarks: int = 192, per_language: int = 1500, short: int = 8192) -> Model | None:
    """The model, or None where no text can be learned from."""
    rows = C.materialised(chosen_texts(docs, per_language, short), "language-sample")
    names = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    if not names:
        return None
    each = max(2, landmarks // len(names))
    picked = rows.where(F.col("n") <= each).orderBy("lang", "n").collect()
    model = landmark_model([r["_text"].encode() for r in picked], names)
    parts = rows.repartition(8).mapInArrow(_equations(docs.sparkSession.sparkContext.broadcast(model)), "inner binary, outer binary").collect()
    size = len(picked) + 1
    inner, outer = (sum(np.frombuffer(p[c], np.float64).reshape(size, -1) for p in parts) for c in ("inner", "outer"))
    scaled = model.rows.astype(np.float64)
    model.weights = solve(scaled.T @ scaled, inner, outer).astype(np.float32)
    return model


def _predict(model):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        names = np.array(m.names, dtype=object)
        for rows, buf, offsets in _batches(batches):
            value = kernel(m, buf, offsets) @ m.weights[:-1] + m.weights[-1]
            best = value.argmax(1)
            letters = rows.column("letters").to_numpy(zero_copy_only=False)
            score = np.clip((1 + value[np.arange(len(value)), best].astype(np.float64)) / 2, 0, 1)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.where(letters, names[best], UNKNOWN), pa.string()), pa.array(np.where(letters, score, 0.0))], names=["doc_id", "lang_pred", "score"])

    return predict


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.rlike(r"\p{L}").alias("letters"), F.lower(text).alias("_text"))
    if model is None:
        return texts.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return texts.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, lang_pred string, score double")
