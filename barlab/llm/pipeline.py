"""Corpus pipeline: toxic documents go, one document of each near-duplicate group stays, repeated passages go, sources are mixed to their target weights, and the rest is packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of docs, extra ones too, whatever their names.

Defined cases, in every stage: a null text is empty; a null id is a document's own, and documents that share an id or
have none are told apart by their texts; empty tables give empty tables; equal inputs give equal outputs. Of rows that
are equal in id and text, near_duplicates keeps the one with the smallest hash of all its columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlab.llm import common as C
from barlab.llm.jaccard_join import jaccard_join
from barlab.llm.mixing import mix
from barlab.llm.packing import pack
from barlab.llm.substring_dedup import substring_dedup
from barlab.llm.toxicity import fit, keep_clean
from barlab.shipping import ship

TOXIC_FROM = 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _one_of_equals(docs: DataFrame) -> DataFrame:
    """(_id, _h, _row): one row of those with equal id and text; the row's columns are _c0, _c1 and so on."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    at = {c: n for c, n in zip(docs.columns, names, strict=True)}
    row = F.struct(*names)
    return docs.toDF(*names).groupBy(C.row_id(at["doc_id"]).alias("_id"), C.text_hash(at["text"]).alias("_h")).agg(F.min_by(row, F.xxhash64(*names)).alias("_row"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.3 or more. The classifier learns from the labels of the documents at hand."""
    ship(spark)
    return keep_clean(docs, fit(docs, table(spark, sf_dir, "labels")), TOXIC_FROM)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, with the smallest id and of that the smallest hash, of each connected group of 5-word-shingle similarity 0.8 or more. Texts without words are each other's copies only where id and text are equal."""
    ship(spark)
    first = jaccard_join(docs).where("_id = class_id AND _h = class_h").select("_id", "_h").distinct()
    return _one_of_equals(docs).join(first, ["_id", "_h"], "left_semi").select("_row.*").toDF(*docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes words in 13-word windows that also start in a document with a smaller id; a text that changes keeps its other words, joined by spaces, and a document that loses all of them goes. Other texts stay as they are."""
    ship(spark)
    names = [f"_c{i}" for i in range(len(docs.columns))]
    at, doc_id = docs.columns.index("text"), docs.columns.index("doc_id")
    renamed = docs.toDF(*names)
    text = F.col(names[at])
    cut = substring_dedup(renamed.select(F.col(names[doc_id]).alias("doc_id"), text.alias("text"), text.isNull().alias("_null"), *(c for c in names if c != names[at])), as_is=True)
    changed = cut.where("n_words = 0 OR n_words > n_removed").withColumn(names[at], F.when(~F.col("_null"), F.col("kept")))
    return changed.select(*(_length(names[at], c, docs, i) for i, c in enumerate(names))).toDF(*docs.columns)


def _length(text: str, column: str, docs: DataFrame, i: int):
    """n_chars follows the text where docs has it; other columns stay."""
    return F.length(F.coalesce(text, F.lit(""))).cast(docs.schema[i].dataType) if docs.columns[i] == "n_chars" else F.col(column)


def _give(text_column: str, step: int = 4 << 20):
    """A row as often as the mix takes its whole text, and once for each run of words that it takes besides."""

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offsets in C.text_chunks(batches):
            words = C.Words(buf, offsets)
            raw = buf.tobytes()
            names = [c for c in rows.schema.names if c not in ("_text", "_taken")]
            i_text = names.index(text_column)
            carried = [rows.column(rows.schema.get_field_index(c)) for c in names]
            of, texts, held = [], [], 0

            def batch() -> pa.RecordBatch:
                take = pa.array(of, pa.int64())
                out = [pa.array(texts, pa.string()) if j == i_text else c.take(take) for j, c in enumerate(carried)]  # noqa: B023
                return pa.RecordBatch.from_arrays(out, names=names)  # noqa: B023

            for i, taken in enumerate(rows.column(rows.schema.get_field_index("_taken")).to_pylist()):
                at = words.first[i]
                for t in taken:
                    text = (raw[offsets[i] : offsets[i + 1]] if t["a"] < 0 else raw[words.starts[at + t["a"]] : words.ends[at + t["b"] - 1]]).decode()
                    for _ in range(t["n"]):
                        of.append(i)
                        texts.append(text)
                        held += len(text)
                        if held > step:
                            yield batch()
                            of.clear(), texts.clear()
                            held = 0
            yield batch()

    return give


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document becomes what the mix takes of it: a row for each time it is taken whole and one for each run of words taken besides, at most three times its words in all; a document of which nothing is taken goes, one without words stays."""
    ship(spark)
    names = [f"_c{i}" for i in range(len(docs.columns))]
    taken = mix(docs)
    whole = taken.where("rounds > 0 OR size = 0").select("_id", "_h", F.lit(-1).cast("long").alias("a"), F.lit(-1).cast("long").alias("b"), F.when(F.col("size") == 0, 1).otherwise(F.col("rounds")).cast("long").alias("n"))
    parts = taken.select("_id", "_h", F.explode("spans").alias("p")).select("_id", "_h", "p.a", "p.b", F.lit(1).cast("long").alias("n"))
    counted = whole.unionByName(parts).groupBy("_id", "_h", "a", "b").agg(F.sum("n").alias("n"))
    per = counted.groupBy("_id", "_h").agg(F.sort_array(F.collect_list(F.struct("a", "b", "n"))).alias("_taken"))
    at = names[docs.columns.index("text")]
    joined = _one_of_equals(docs).join(per, ["_id", "_h"]).select("_row.*", "_taken").withColumn("_text", F.coalesce(F.col(at).cast("string"), F.lit("")))
    out = joined.mapInArrow(_give(at), docs.toDF(*names).schema)
    return out.select(*(_length(at, names[i], docs, i) for i in range(len(names)))).toDF(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    ship(spark)
    return pack(docs, tokenizer_path()).select(C.original_id().alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Training a classifier and tokenizing have no SQL form; tests/llm/test_pipeline.py compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    at = f"{C.shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return docs
