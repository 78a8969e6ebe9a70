"""Cases that the larger tests leave out: archives inside payloads, empty tables, ties, clashing columns, and models against brute force."""

import collections
import io
import math
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("barlab.llm.queries")
from barlab.llm import nearest, quality_rules, queries, toxicity, url_filter, warc
from barlab.shipping import ship


def member(record, level=6):
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(record) + c.flush()


def test_an_archive_inside_a_payload_is_no_record():
    rng = np.random.default_rng(1)
    inner = member(warc.record_bytes(99, "u", b"x" * 500, warc.hashlib.sha256(b"x" * 500).hexdigest(), None))
    payload = rng.bytes(200_000) + inner + rng.bytes(200_000)
    data = b"".join(member(warc.record_bytes(i, "u", p, warc.hashlib.sha256(p).hexdigest(), None), 0) for i, p in enumerate((payload, b"y" * 300)))
    for step in (50_000, 100_000, 10**7):
        assert [warc.parse_record(r)[0] for a in range(0, len(data), step) for r in warc.records_in(io.BytesIO(data), len(data), a, min(a + step, len(data)))] == [0, 1]


def test_warc_takes_long_records_and_empty_tables(spark):
    ship(spark)
    long = "".join(np.random.default_rng(2).choice(list("abcdefghijklmnop"), 3_000_000))
    pages = spark.createDataFrame([(1, "u", long, 5), (2, "u", long, 5), (3, "v", "", 5)], "page_id long, url string, html string, digest int")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()}
    assert got == {1: (3_000_000, "response", None), 2: (3_000_000, "revisit", 1), 3: (0, "response", None)}
    assert warc.round_trip(pages.where("1 = 0")).count() == 0


def test_url_filter_takes_empty_and_repeated_pages_and_other_columns(spark):
    ship(spark)
    pages = spark.createDataFrame([(1, "http://a.com/fr/", "x"), (1, "http://a.com/fr/", "y"), (None, None, "z")], "page_id long, url string, _host string")
    got = url_filter.url_filter(pages, queries.URL_RULES).collect()
    assert sorted(r.rule or "" for r in got) == ["", "com/fr/", "com/fr/"] and got[0].asDict().keys() == {"page_id", "host", "path", "rule", "verdict"}
    assert url_filter.url_filter(pages.where("1 = 0"), queries.URL_RULES).count() == 0


def test_equal_scores_go_to_the_smaller_id(spark):
    ship(spark)
    same = [1.0, 2.0, 3.0]
    t = nearest.valid_vectors(spark.createDataFrame([(i, same, "x") for i in range(60)], "vec_id long, embedding array<double>, list string"))
    got = nearest.nearest(t, t.where("vec_id IN (0, 20)"), k=5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, 1), (0, 2), (0, 3), (0, 4), (0, 5), (20, 0), (20, 1), (20, 2), (20, 3), (20, 4)]


def test_quality_verdicts_are_those_of_the_ordered_list(spark):
    ship(spark)
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(900):
        symbols, upper = int(rng.integers(0, 40)), int(rng.integers(0, 40))
        words = [f"w{x}" for x in rng.integers(0, 10**6, 80)]
        for j in range(symbols):
            words[j] += "#"
        for j in range(upper):
            words[j] = words[j].upper()
        bad = (symbols > 24 and upper > 20) or upper < 6
        rows.append((i, " ".join(words), 1))
        labels.append((i, int(not bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    out, rules = quality_rules.quality_rules(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert len(rules) >= 2 and any(len(r) > 1 for r in rules)
    right = 0
    truth = dict(labels)
    for r in out.collect():
        value = {"words": r.n_words, "word_length": r.word_chars / r.n_words, "symbol_share": r.n_symbols / r.n_words, "dup_line_share": r.n_dup_lines / r.n_lines, "repeat_share": r.n_repeat_words / r.n_words, "punct_share": r.n_punct / r.n_words, "upper_share": r.n_upper / r.n_words, "line_words": r.n_words / r.n_lines}
        rejected = any(all((value[c.feature] > c.value) if c.above else (value[c.feature] <= c.value) for c in rule) for rule in rules)
        assert r.kept == (not r.base_failed and not rejected)
        right += r.kept == bool(truth[r.doc_id])
    assert right > 0.93 * len(rows)


def grams(text):
    s = " " + re.sub(r"[\x20\x09-\x0D]", " ", text).lower() + " "
    out = collections.Counter()
    for n in toxicity.LENGTHS:
        out.update(s[i : i + n] for i in range(len(s) - n + 1) if " " not in s[i + 1 : i + n - 1])
    return out


def test_toxicity_equals_a_plain_fit(spark):
    """Ratios and the penalised logistic fit, with n-grams as strings and plain descent."""
    ship(spark)
    rng = np.random.default_rng(4)
    rows = []
    for i in range(120):
        toxic = int(rng.random() < 0.4)
        words = list(rng.choice(["calm", "tree", "river", "stone"], 12)) + list(rng.choice(["vile", "scum", "calm"], 3) if toxic else rng.choice(["kind", "good", "vile", "calm"], 3))
        rows.append((i, " ".join(words), toxic))
    y = np.array([r[2] for r in rows], float)
    counts = [grams(r[1]) for r in rows]
    t, c = collections.Counter(), collections.Counter()
    for g, k in zip(counts, y, strict=True):
        (t if k else c).update(g.keys())
    ratio = {g: math.log((t[g] + 0.5) / (y.sum() + 1)) - math.log((c[g] + 0.5) / (len(y) - y.sum() + 1)) for g in t.keys() | c.keys() if t[g] + c[g] >= toxicity.LEAST_TEXTS}
    names = sorted(g for g, r in ratio.items() if abs(r) >= toxicity.LEAST_RATIO)
    x = np.array([[math.log1p(g[n]) * ratio[n] for n in names] for g in counts])
    w, b = np.zeros(len(names)), 0.0
    step = 1 / (0.25 * np.linalg.norm(np.c_[x, np.ones(len(y))], 2) ** 2 + toxicity.L2)
    for _ in range(6000):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        w, b = w - step * (x.T @ (p - y) + toxicity.L2 * w), b - step * (p - y).sum()
    want = 1 / (1 + np.exp(-(x @ w + b)))
    weights, bias = toxicity.train([toxicity.C.text_buffer(toxicity.pa.array([r[1] for r in rows]))], y)
    model_scores = toxicity.score(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), (weights, bias)).orderBy("doc_id").collect()
    assert np.abs(np.array([r.score for r in model_scores]) - want).max() < 0.03
