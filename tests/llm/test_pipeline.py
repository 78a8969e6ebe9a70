"""Every stage of the pipeline against brute force, with null and repeated ids, empty texts, extra columns and empty tables."""

import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("barlab.llm.queries")
from barlab.llm import common as C
from barlab.llm import mixing, packing, pipeline, queries, toxicity
from barlab.shipping import ship

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id int, kept array<int>, `_c0` string"


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 40)) for _ in range(30)]
    texts += [texts[0] + " tail", texts[3], " ".join([*texts[1].split()[:20], *(f"v{i}" for i in range(30))]), "", None, " \n ", "two  words", "two  words"]
    ids = [None if i % 5 == 0 else 7 if i % 5 == 1 else 100 + i for i in range(len(texts))]
    rows = [(d, t, "en", ["a", "b", None][i % 3], len(t or ""), i, [i], str(i)) for i, (d, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame([*rows, rows[2], rows[2]], SCHEMA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("1 = 0")


def key(r):
    return (-1 if r.doc_id is None else r.doc_id, r.text, r["_id"])


def test_stages_keep_the_columns_and_take_empty_tables(spark, docs, empty, sf_dir):
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).schema.simpleString() == docs.schema.simpleString(), name
        assert stage(spark, empty, sf_dir).count() == 0, name
    assert pipeline.packing_stage(spark, empty, sf_dir).count() == 0


def test_toxicity_stage_drops_what_scores_high(spark, sf_dir):
    t = pipeline.table(spark, sf_dir, "documents")
    model = toxicity.fit(t, pipeline.table(spark, sf_dir, "labels"))
    toxic = {r.doc_id for r in toxicity.score(t, model).where("score >= 0.3").collect()}
    assert toxic and {r.doc_id for r in pipeline.toxicity_stage(spark, t, sf_dir).collect()} == {r.doc_id for r in t.collect()} - toxic


def test_near_duplicate_stage(spark, docs, sf_dir):
    rows = docs.collect()
    sets = []
    for r in rows:
        w = WORD.findall((r.text or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            same = rows[i].doc_id == rows[j].doc_id and (rows[i].text or "") == (rows[j].text or "")
            if same or (sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
    groups = collections.defaultdict(list)
    for r, g in zip(rows, root, strict=True):
        groups[g].append(r)
    got = collections.Counter(key(r) for r in pipeline.near_duplicate_stage(spark, docs, sf_dir).collect())
    assert sum(got.values()) == len(groups)
    for members in groups.values():
        least = min(-1 if r.doc_id is None else r.doc_id for r in members)
        assert sum(got[k] for k in {key(r) for r in members if key(r)[0] == least}) == 1


def test_substring_stage(spark, docs, sf_dir):
    rows = docs.collect()
    order = lambda r: -1 if r.doc_id is None else r.doc_id
    first = {}
    for r in rows:
        w = WORD.findall(r.text or "")
        for j in range(len(w) - 12):
            first[tuple(w[j : j + 13])] = min(first.get(tuple(w[j : j + 13]), 10**9), order(r))
    want = []
    for r in rows:
        w = WORD.findall(r.text or "")
        gone = {q for j in range(len(w) - 12) if first[tuple(w[j : j + 13])] < order(r) for q in range(j, j + 13)}
        if not w or len(gone) < len(w):
            want.append((order(r), r.text if not gone else " ".join(x for q, x in enumerate(w) if q not in gone), r["_id"]))
    got = pipeline.substring_stage(spark, docs, sf_dir)
    assert sorted(map(str, map(key, got.collect()))) == sorted(map(str, want))
    assert got.where("n_chars <> length(coalesce(text, ''))").count() == 0


def test_mixing_stage(spark, docs, sf_dir):
    taken = collections.Counter()
    for r in mixing.mix(docs).collect():
        taken[(r._id, r._h)] += r.taken
    given, whole = collections.Counter(), docs.select(C.row_id().alias("i"), C.text_hash().alias("h"), "text").distinct().collect()
    got = pipeline.mixing_stage(spark, docs, sf_dir).collect()
    for r in got:
        i = C.NO_ID if r.doc_id is None else r.doc_id
        homes = [x for x in whole if x.i == i and (r.text or "") in (x.text or "") and ((r.text or "") != "" or not (x.text or ""))]
        assert homes
        given[r.doc_id] += len(WORD.findall(r.text or ""))
    want = collections.Counter()
    for (i, _), n in taken.items():
        want[None if i == C.NO_ID else i] += n
    assert {d: n for d, n in given.items() if n} == {d: n for d, n in want.items() if n}


def test_packing_stage(spark, docs, sf_dir):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(pipeline.tokenizer_path())
    got = pipeline.packing_stage(spark, docs, sf_dir).collect()
    want = collections.Counter((r.doc_id, len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in docs.collect())
    assert collections.Counter((r.doc_id, r.length) for r in got) == want


def test_every_stage_equals_itself_when_run_again(spark, sf_dir):
    one, two = (pipeline.run(spark, sf_dir).groupBy("doc_id").agg(F.sum("length").alias("n"), F.count("*").alias("c")) for _ in range(2))
    assert one.exceptAll(two).count() == 0 and one.count() > 0
