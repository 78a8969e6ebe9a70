"""Each operator against brute force, on a small table with nulls, empty and long texts, repeated rows, ties and clashing columns."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("barlab.llm.queries")
from barlab.llm import common as C
from barlab.llm import jaccard_join, language_model, mixing, nearest, packing, quality_rules, queries, substring_dedup, toxicity, url_filter, warc
from barlab.shipping import ship

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(300)]
    texts = [" ".join(rng.choice(vocabulary, 60)) for _ in range(40)]
    texts += [texts[0], texts[1], texts[0] + " tail", texts[2].replace("W1 ", "X1 ", 1)] + [" ".join(rng.choice(vocabulary, 5)) + " " + texts[3] for _ in range(6)]
    texts += ["", None, " \n\t ", "one two three", "one two three", "a b  c\n\nd 　e", " ".join(rng.choice(vocabulary, 4000))]
    rows = [(i, t, ["en", None][i % 2], ["s1", "s2", None][i % 3], 0, 7, "x") for i, t in enumerate(texts)]
    rows += [rows[5], (None, "null id text", "en", "s1", 0, 7, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _id long, words string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("1 = 0")


def texts_of(docs):
    return [(-(1 << 63) if r.doc_id is None else r.doc_id, r.text or "") for r in docs.collect()]


def test_jaccard_join(docs, empty):
    rows = texts_of(docs)
    sets = []
    for _, t in rows:
        w = WORD.findall(t.translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    linked = [[bool(a and b) and i != j and len(a & b) >= 0.8 * len(a | b) - 1e-9 for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    root = list(range(len(rows)))
    for _ in rows:
        root = [min([root[i], *(root[j] for j in range(len(rows)) if linked[i][j])], key=lambda x: (rows[x][0], x)) for i in range(len(rows))]
    want = sorted((rows[i][0], rows[root[i]][0], sum(linked[i])) for i in range(len(rows)))
    for limits in ({}, {"bucket_limit": 2, "block_limit": 2}):
        got = sorted((r._id, r.class_id, r.n_links) for r in jaccard_join.jaccard_join(docs, **limits).collect())
        assert got == want
    assert jaccard_join.jaccard_join(empty).count() == 0


def test_near_copies_are_one_group_without_splitting(spark, monkeypatch):
    """Draws of near copies fall on the same shingles: before, each of them was drawn again on every level."""
    rows = [(i, " ".join(f"x{i}" if w == i % 100 else f"w{w}" for w in range(100))) for i in range(600)]
    rows += [(600 + i, " ".join(f"y{i}_{w}" for w in range(50)) + " w0 w1 w2 w3 w4 w5 w6 w7 w8") for i in range(20)]
    split = []
    whole = jaccard_join._deeper
    monkeypatch.setattr(jaccard_join, "_deeper", lambda *a: split.append(a) or whole(*a))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r._id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_join(docs).collect()}
    assert got == {i: (0, 599) for i in range(600)} | {600 + i: (600 + i, 0) for i in range(20)}
    assert not split


def test_runs_reach_the_target():
    assert jaccard_join.runs_for(0.999, 1) == 7 and jaccard_join.runs_for(0.999, 4) == 19


def test_toxicity_learns_and_scores_every_row(spark, docs, empty):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(["plain", "words", "here", "and", "there"], 30)) + (" awfulness" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(200)]
    t = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(t.drop("toxic"), t.select("doc_id", "toxic"))
    got = {r.doc_id: r.score for r in toxicity.score(t, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert held and all((got[i] >= 0.3) == bool(y) for i, _, y in held)
    assert toxicity.score(docs, model).count() == docs.count()
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, model).collect())
    assert toxicity.keep_clean(docs, model).columns == docs.columns
    assert toxicity.score(empty, toxicity.fit(empty, t.select("doc_id", "toxic").where("1 = 0"))).count() == 0


def test_language_model_base_and_normalisation(docs, empty):
    rows = [(i, [*WORD.findall(t.translate(LOWER)), "\n"]) for i, t in texts_of(docs)]
    count = collections.Counter(w for i, t in rows if i < 0 or zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    n, v = sum(count.values()), len(count)
    want = sorted((i, len(t), sum(count[w] > 0 for w in t), round(sum(np.log10((count[w] + 1) / (n + v + 1)) for w in t), 6)) for i, t in rows)
    got = language_model.language_model(docs).collect()
    assert sorted((r._id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 for r in got)
    assert language_model.language_model(empty).count() == 0


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    docs = docs.unionByName(docs.limit(1).select(F.lit(900).cast("long").alias("doc_id"), F.lit("a <|endoftext|> b  <|endoftext|>c\n").alias("text"), *docs.columns[2:]))
    ids = collections.defaultdict(list)
    for i, t in texts_of(docs):
        ids[i].append([*tokenizer.encode(t, add_special_tokens=False).ids, 0])
    got = packing.pack(docs, path, with_ids=True).collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in got)
    for i, lists in ids.items():
        pieces = sorted((r.piece, r.start, r.length, tuple(r.ids)) for r in got if r._id == i)
        want = []
        for x in lists:
            cuts = [0, *range(len(x) % 2048 or min(2048, len(x)), len(x) + 1, 2048)]
            want += [(p, a, b - a, tuple(x[a:b])) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
        assert pieces == sorted(want)
    places = collections.defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(empty, path).count() == 0


def test_dominance_keeps_the_optimum():
    def best(items, capacity):
        found = len(items)

        def place(i, bins):
            nonlocal found
            if len(bins) >= found:
                return
            if i == len(items):
                found = len(bins)
                return
            for b in {x: j for j, x in enumerate(bins) if x >= items[i]}.values():
                bins[b] -= items[i]
                place(i + 1, bins)
                bins[b] += items[i]
            bins.append(capacity - items[i])
            place(i + 1, bins)
            bins.pop()

        place(0, [])
        return found

    rng = np.random.default_rng(4)
    for _ in range(100):
        capacity = int(rng.choice([10, 20, 30]))
        items = sorted(rng.integers(1, capacity + 1, rng.integers(1, 9)).tolist(), reverse=True)
        fixed, rest = packing.reduce_instance(np.bincount(items, minlength=capacity + 1), capacity)
        left = sorted(np.repeat(np.arange(capacity + 1), rest).tolist(), reverse=True)
        assert sum(n for _, n in fixed) + (best(left, capacity) if left else 0) == best(items, capacity)


def test_substring_dedup(docs, empty):
    rows = [(i, WORD.findall(t)) for i, t in texts_of(docs)]
    first = {}
    for i, w in rows:
        for j in range(len(w) - 12):
            key = tuple(w[j : j + 13])
            first[key] = min(first.get(key, i), i)
    want = []
    for i, w in rows:
        gone = {q for j in range(len(w) - 12) if first[tuple(w[j : j + 13])] < i for q in range(j, j + 13)}
        want.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for q, x in enumerate(w) if q not in gone).encode()).hexdigest()))
    for size in (4000, 4 << 20):
        out = substring_dedup.substring_dedup(docs, with_text=False, block_bytes=size)
        assert out.columns == [*(c for c in docs.columns if c != "text"), "n_words", "n_removed", "kept"]
        got = out.collect()
        assert sorted((C.NO_ID if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == sorted(want)
        assert {r["_id"] for r in got} == {7} and {r["words"] for r in got} == {"x"}
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_quality_rules(spark, docs, empty):
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(40)] + [(1, 0), (None, 1)], "doc_id long, quality int")
    out, _ = quality_rules.quality_rules(docs, labels)
    want = []
    for i, t in texts_of(docs):
        w = WORD.findall(t)
        c = collections.Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        twice = {q for j in range(len(w) - 2) if c[tuple(w[j : j + 3])] > 1 for q in range(j, j + 3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want.append((-1 if i < 0 else i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(twice), len(w) < 50 or 2 * len(twice) > len(w)))
    got = [(-1 if r.doc_id is None else r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out.collect()]
    assert sorted(got) == sorted(want) and out.where("base_failed AND kept").count() == 0
    assert quality_rules.quality_rules(empty, labels)[0].count() == 0
    x = np.arange(400) / 100
    assert quality_rules.learn({"a": x, "b": x * 0}, x > 3)[0][0].feature == "a"


def test_url_filter(spark):
    ship(spark)
    urls = ["http://Sub.Example.org/es/x?q", "https://example.org/en/123", "http://a.com/de/", "http://a.com/fr/#t", "no scheme", None, "http://org", "http://x.net/de/", "http://notexample.org/es/", "http://example.org?x/es/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    want = ["block", "block", "block", "allow", "allow", "allow", "allow", "allow", "allow", "allow"]
    for limit in (64 << 20, 20):
        got = {r.page_id: (r.rule, r.verdict) for r in url_filter.url_filter(pages, queries.URL_RULES, shard_bytes=limit).collect()}
        assert [got[i][1] for i in range(len(urls))] == want
        assert got[0][0] == "example.org/es/" and got[1][0] == "example.org/en/1" and got[6][0] is None and got[8][0] == "org/"
    collide = url_filter.DigestArray(url_filter.digest_array(queries.URL_RULES, digest=lambda s: 5), digest=lambda s: 5)
    assert [int(x) >= 0 for x in collide.find([b"org/", b"nothing", b"com/de/"])] == [True, False, True]


def by_quotients(weights, seats, caps):
    """Seats one by one, each to the highest quotient."""
    out = [0] * len(weights)
    for _ in range(seats):
        free = [i for i in range(len(weights)) if weights[i] > 0 and out[i] < caps[i]]
        if not free:
            break
        out[max(free, key=lambda i: (weights[i] / (2 * out[i] + 1), -i))] += 1
    return out


def test_seats_go_to_the_highest_quotients():
    rng = np.random.default_rng(8)
    for _ in range(50):
        n = int(rng.integers(1, 9))
        weights, seats = rng.integers(0, 200, n), int(rng.integers(0, 40))
        caps = rng.integers(0, 30, n)
        assert mixing.sainte_lague(weights, seats, caps).tolist() == by_quotients(weights.tolist(), seats, caps.tolist())


def test_mixing(docs, empty):
    for sizes in ({"block": 16, "shard_words": 500, "group_shards": 2}, {"block": 64}):
        got = mixing.mix(docs, **sizes).collect()
        again = mixing.mix(docs.repartition(5), **sizes).collect()
        key = lambda r: (r._id, r._h, r.taken, r.spans)
        assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == docs.count()
        taken, target, shards = collections.Counter(), {}, collections.Counter()
        for r in got:
            assert r.taken <= 3 * r.size and r.taken == r.rounds * r.size + sum(s.b - s.a for s in r.spans)
            taken[r.source] += r.taken
            target[r.source] = r.target
            shards[r.source] = max(1, r.source_size // sizes.get("shard_words", 1 << 20))
        assert all(abs(taken[s] - target[s]) <= sizes["block"] * shards[s] for s in target)
    assert mixing.sainte_lague(np.array([53.0, 24, 23]), 7).tolist() == [3, 2, 2]
    assert mixing.targets([100, 0, 10], [5, 2, 1], 3) == pytest.approx([91.6666667, 0, 18.3333333])
    assert mixing.mix(empty).count() == 0


def test_mixing_meets_the_target_of_a_small_source(spark):
    """One source has a hundredth of the words of the other, which is dealt over many shards; a third of it is one text."""
    ship(spark)
    rows = [(i, " ".join(["w"] * 40), "a") for i in range(5000)] + [(None, "same text", "a")] * 2500 + [(10**6 + i, "x y z q " * 5, "b") for i in range(100)] + [(10**7 + i, None, "c") for i in range(50)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), shard_words=2000).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.count("*").alias("n")).collect()
    got = {r.source: r for r in got}
    assert got["b"].target == 6000 and 6000 - 64 <= got["b"].taken <= 6000
    assert abs(got["a"].taken - got["a"].target) <= 64 * 105 and got["c"].taken == 0 and got["a"].n == 7500


def test_warc(spark):
    ship(spark)
    long = "x" * 120
    rows = [(3, "http://a", long), (1, "http://b\r\nc", long), (2, None, None), (5, "u", "é" * 60), (4, "u", "é" * 60), (6, "u", "ab"), (7, "u", "ab"), (None, "u", long)]
    got = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"), with_payload=True).collect()}
    assert len(got) == len(rows) and {i: got[i].refers_to for i in got} == {1: None, 2: None, 3: 1, 4: None, 5: 4, 6: None, 7: None, None: 1}
    assert got[5].payload_bytes == 120 and got[5].payload_digest == hashlib.sha256(("é" * 60).encode()).hexdigest() and got[1].payload == long.encode()


def test_warc_ranges_own_each_record_once():
    import io

    parts = []
    for i in range(20):
        p = hashlib.sha256(str(i).encode()).digest() * 40 + warc.MAGIC
        c = zlib.compressobj(0, zlib.DEFLATED, 31)
        parts.append(c.compress(warc.record_bytes(i, "u", p, hashlib.sha256(p).hexdigest(), None)) + c.flush())
    data = b"".join(parts)
    for step in (100, 999, 5000, 10**6):
        found = [warc.parse_record(r)[0] for a in range(0, len(data), step) for r in warc.records_in(io.BytesIO(data), len(data), a, min(a + step, len(data)))]
        assert found == list(range(20))


def test_nearest(spark):
    ship(spark)
    rng = np.random.default_rng(6)
    x = rng.standard_normal((600, 16))
    rows = [(i, [float(v) for v in np.float32(r)]) for i, r in enumerate(x)] + [(600, None), (601, [0.0] * 16), (602, [float("nan")] * 16), (603, [1.0]), (604, [None] * 16), (None, [1.0] * 16), (605, rows_0 := [float(v) for v in np.float32(x[0])])]
    t = nearest.valid_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert t.count() == 601
    got = collections.defaultdict(list)
    for r in nearest.nearest(t, t.where("vec_id % 20 = 0"), block_rows=100, query_rows=7).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    base = {i: np.array(v) for i, v in rows[:600]} | {605: np.array(rows_0)}
    hits = 0
    for q, found in got.items():
        score = {i: float(base[q] @ v) for i, v in base.items() if i != q}
        want = sorted(score, key=lambda i: (-score[i], i))[:20]
        hits += len(set(want) & {i for i, _ in found})
        assert len(found) == 20 and all(abs(score[i] - s) < 1e-9 for i, s in found) and found == sorted(found, key=lambda p: (-p[1], p[0]))
    assert hits >= 0.9 * 20 * len(got)
    assert nearest.nearest(t.where("1 = 0"), t.where("1 = 0")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, name):
    from oracle import differences

    ship(spark)
    assert differences(spark, sf_dir, queries.queries()[name], queries.oracle_sql()[name]) == []


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 2), (2, 1), (8, 8)], "a long, b long")
    assert sorted(map(tuple, C.components(edges).collect())) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (8, 8), (9, 8)]
