"""The thin queries over the driver's tables, one per operator, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlab.llm import common as C
from barlab.llm import language_id
from barlab.llm import pipeline as stages
from barlab.llm.jaccard_join import jaccard_join
from barlab.llm.language_model import language_model
from barlab.llm.mixing import mix
from barlab.llm.nearest import nearest, valid_vectors
from barlab.llm.packing import pack
from barlab.llm.periodic_runs import periodic_runs
from barlab.llm.pipeline import TOXIC_FROM, table, tokenizer_path
from barlab.llm.quality_rules import quality_rules
from barlab.llm.substring_dedup import substring_dedup
from barlab.llm.toxicity import fit, learnable, score
from barlab.llm.url_filter import url_filter
from barlab.llm.vector_codes import vector_codes
from barlab.llm.warc import round_trip

#: (verdict, host, path)
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).select(C.original_id().alias("doc_id"), C.original_id("class_id").alias("class_id"), "n_links", "n_shingles")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (~learnable() & F.col("doc_id").isNotNull()).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model(table(spark, sf_dir, "documents")).withColumn("_id", C.original_id()).withColumnRenamed("_id", "doc_id").drop("_h")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path()).select(C.original_id().alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False).withColumnRenamed("kept", "kept_sha256")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), URL_RULES)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(C.original_id().alias("doc_id"), "size", "source_size", "target", "taken")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = valid_vectors(table(spark, sf_dir, "embeddings"))
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.predict(docs, language_id.fit(docs))
    return found.select("doc_id", (~learnable() & F.col("doc_id").isNotNull()).alias("held_out"), "lang_pred", "score")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), rewrite=True)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_jaccard_join, op2_toxicity, op3_language_model, op4_packing, op5_substring_dedup, op6_quality_rules, op7_url_filter, op8_mixing, op9_warc, op10_nearest, op11_language_id, op12_vector_codes, op13_periodic_runs, pipeline)
    return {f.__name__: f for f in found}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP1 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
per AS (SELECT a, count(*) AS k FROM links GROUP BY a)
SELECT d.doc_id, least(d.doc_id, coalesce(m, d.doc_id)) AS class_id, coalesce(k, 0) AS n_links, coalesce(n.n, 0) AS n_shingles
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least ON least.a = d.doc_id LEFT JOIN per ON per.a = d.doc_id
"""

_OP5 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
k AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT s, min(doc_id) AS m FROM k GROUP BY s),
hit AS (SELECT DISTINCT doc_id, p FROM (SELECT k.doc_id, unnest(range(k.i, k.i + 13)) AS p FROM k JOIN f USING (s) WHERE f.m < k.doc_id)),
w AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM w ANTI JOIN hit USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

_OP7 = """
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path FROM u
), r(v, h, q) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (SELECT page_id, arg_max(h || q, length(h || q)) AS rule, arg_max(v, length(h || q)) AS v FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""

_OP9 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY ALL)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON f.payload_digest = p.payload_digest AND payload_bytes >= 100
"""


def _op12(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Each round assigns all parts by comparing them with all entries."""

    def near(book: str) -> str:
        return f"""
  SELECT r, label, p, arg_min(e, d * {entries} + e) AS e, min(d) AS d FROM (
    SELECT x.r, x.label, x.p, b.e, list_sum(list_transform(list_zip(x.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x JOIN {book} b USING (p)
  ) GROUP BY r, label, p"""

    ctes = [f"""
k AS (SELECT vec_id, label, list_transform(embedding, lambda v: floor(4096 * v::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v::DOUBLE))) = 0),
x AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS c FROM (SELECT *, unnest(range({parts})) AS p FROM k)),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, c FROM x QUALIFY e < {entries})"""]
    for i in range(rounds):
        ctes.append(f"""
n{i} AS MATERIALIZED ({near(f"b{i}")}),
m{i} AS MATERIALIZED (SELECT p, e, list(c ORDER BY j) AS c FROM (SELECT n.p, n.e, j, floor(sum(x.c[j]) / count(*))::BIGINT AS c FROM n{i} n JOIN x USING (r, p), unnest(range(1, 9)) AS u(j) GROUP BY ALL) GROUP BY p, e),
b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{i} b LEFT JOIN m{i} m USING (p, e))""")
    return f"""WITH {",".join(ctes)},
f AS (SELECT x.vec_id, n.label, string_agg(format('{{:02x}}', n.e), '' ORDER BY n.p) AS code, sum(n.d)::BIGINT AS error FROM ({near(f"b{rounds}")}) n JOIN x USING (r, p) GROUP BY x.vec_id, n.label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256 FROM f
"""


#: Stretches of equal words at each distance q, of at least three q words; of equal stretches the least q is the period.
_OP13 = f"""
WITH h AS (
  SELECT doc_id, {_WORDS} AS w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) AS h FROM documents
), g AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS again, h // 10 AS g FROM h),
a AS (SELECT *, CASE WHEN again THEN g % n END AS a FROM g),
x AS MATERIALIZED (
  SELECT doc_id, n, i, w[1 + CASE WHEN again AND i >= a THEN a + (i - a) % (1 + (n - a) // (3 + g % 8)) ELSE i END] AS word FROM (SELECT *, unnest(range(n)) AS i FROM a)
), e AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM x JOIN x y ON y.doc_id = x.doc_id AND y.word = x.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS m FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS o FROM e) GROUP BY doc_id, q, o HAVING count(*) + q >= greatest(6, 4 * q)),
r AS MATERIALIZED (SELECT doc_id, s, m, min(q) AS q FROM s GROUP BY doc_id, s, m),
best AS (SELECT doc_id, count(*) AS n_runs, sha256(string_agg(s || ',' || m || ',' || q || chr(10), '' ORDER BY s, q)) AS runs FROM r GROUP BY doc_id),
top AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY m / q DESC, s, q) = 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + m)) AS i FROM r),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, m AS length, q AS period, 1000 * m // q AS exponent_milli, coalesce(runs, sha256('')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM documents LEFT JOIN best USING (doc_id) LEFT JOIN top USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_jaccard_join": _OP1, "op5_substring_dedup": _OP5, "op7_url_filter": _OP7, "op9_warc": _OP9, "op12_vector_codes": _op12(), "op13_periodic_runs": _OP13}
