"""Language identification, vector codes and periodic runs; nearest neighbours of small and unequal lists."""

import hashlib
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("barlab.llm.queries")
from barlab.llm import language_id, nearest, periodic_runs, queries, vector_codes
from barlab.shipping import ship
from oracle import differences

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", ["op12_vector_codes", "op13_periodic_runs"])
def test_query_equals_its_sql(spark, sf_dir, name):
    ship(spark)
    assert differences(spark, sf_dir, queries.queries()[name], SQL[name]) == []


# ---------------------------------------------------------------- nearest neighbours


def brute_nearest(rows, k):
    """Ids of the k best of every row whose id 20 divides."""
    x, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    out = {}
    for i in sorted({int(i) for i in ids if i % 20 == 0}):
        score = x @ x[np.flatnonzero(ids == i)[0]]
        order = np.lexsort((ids, -score))
        out[i] = [int(j) for j in ids[order] if j != i][:k]
    return out


def found_nearest(spark, rows, k=20, **how):
    t = nearest.valid_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    out = {}
    for r in nearest.nearest(t, t.where("vec_id % 20 = 0"), k=k, **how).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


@pytest.mark.parametrize("n", [1, 2, 20, 21, 22])
def test_few_vectors_all_come_back(spark, n):
    ship(spark)
    rng = np.random.default_rng(n)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(n)]
    want = {q: found for q, found in brute_nearest(rows, 20).items() if found}
    got = found_nearest(spark, rows)
    assert {q: len(v) for q, v in got.items()} == {q: min(20, n - 1) for q in want}
    if n < 22:
        assert got == want


def test_every_query_gets_twenty_rows_from_unequal_groups(spark):
    ship(spark)
    rng = np.random.default_rng(5)
    sizes = [300] * 10 + [3] * 20
    centres = rng.standard_normal((len(sizes), 32)) * 6
    points = np.concatenate([c + rng.standard_normal((n, 32)) for c, n in zip(centres, sizes, strict=True)])
    rows = [(i, v.tolist()) for i, v in zip(rng.permutation(len(points)).tolist(), points, strict=True)]
    want, got = brute_nearest(rows, 20), found_nearest(spark, rows)
    assert got.keys() == want.keys() and {len(v) for v in got.values()} == {20}
    assert sum(len(set(want[q]) & set(got[q])) for q in want) >= 0.9 * 20 * len(want)


@pytest.mark.parametrize("coarse", [1, 4, 16])
def test_lists_of_two_levels_give_whole_results(spark, coarse):
    """Fewer coarse centroids than lists are wanted, as beyond a million vectors; groups of unequal size leave lists empty."""
    ship(spark)
    rng = np.random.default_rng(11)
    sizes = [400] * 6 + [40] * 15 + [2] * 10
    centres = rng.standard_normal((len(sizes), 24)) * 4
    points = np.concatenate([c + rng.standard_normal((n, 24)) for c, n in zip(centres, sizes, strict=True)])
    rows = [(i, v.tolist()) for i, v in zip(rng.permutation(len(points)).tolist(), points, strict=True)]
    want, got = brute_nearest(rows, 20), found_nearest(spark, rows, coarse=coarse, block_rows=256)
    assert got.keys() == want.keys() and {len(v) for v in got.values()} == {20}
    assert sum(len(set(want[q]) & set(got[q])) for q in want) >= 0.9 * 20 * len(want)


@pytest.mark.parametrize("n", [2, 20, 22])
def test_few_vectors_in_lists_of_two_levels(spark, n):
    ship(spark)
    rng = np.random.default_rng(n)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(n)]
    got = found_nearest(spark, rows, coarse=1)
    assert {q: len(v) for q, v in got.items()} == {q: min(20, n - 1) for q in brute_nearest(rows, 20)}


def test_lists_of_two_levels_by_their_sums():
    rng = np.random.default_rng(12)
    x, q = rng.standard_normal((4000, 6)), rng.standard_normal((30, 6))
    lists = nearest.fit_lists(x, 60, 8)
    assert len(lists[0]) == 8 and len(lists[1]) == 8
    whole = np.array([c + f for c in lists[0] for f in lists[1]])
    held = np.bincount(nearest.list_of(x, lists), minlength=64)
    assert held.sum() == 4000 and held.max() < 4000 / 8
    held[5] = 0
    far = ((q[:, None] - whole[None]) ** 2).sum(2)
    far[:, 5] = np.inf
    got = nearest.list_order(q, lists, held)
    full = np.flatnonzero(held)
    assert (np.sort(got, axis=1) == np.arange(64)).all()
    for a, order in zip(far, got, strict=True):
        d = a[order[: len(full)]]
        assert np.isfinite(d).all() and (np.diff(d) > -1e-9).all()


def test_rows_of_the_querys_own_id_do_not_count(spark):
    """Sixty rows of id 0 fill its lists; its neighbours lie further away."""
    ship(spark)
    rng = np.random.default_rng(6)
    rows = [(0, (np.ones(4) * 5 + rng.standard_normal(4) * 0.01).tolist()) for _ in range(60)] + [(i, rng.standard_normal(4).tolist()) for i in range(1, 40)]
    got = found_nearest(spark, rows)
    assert set(range(1, 40)) >= set(got[0]) and len(got[20]) == 20 and len(got[0]) == 20


def test_a_scan_keeps_k_pairs_a_query():
    rng = np.random.default_rng(7)
    x, q = rng.standard_normal((500, 64)).astype(np.float32), rng.standard_normal((9, 64)).astype(np.float32)
    x[:, :16] *= 3  # the first columns mislead
    i, _ = nearest.adaptive_scan(x, q, np.zeros((9, 500), bool), 20)
    assert (np.bincount(i, minlength=9) >= 20).all()


# ---------------------------------------------------------------- language identification


def set_of_grams(text):
    s = (" " + re.sub(r"[\x20\x09-\x0D]+", " ", text.lower()) + " ").encode()
    s = re.sub(rb" +", b" ", s)
    return {s[i : i + n] for n in language_id.LENGTHS for i in range(len(s) - n + 1)}


def plain_kernel(a, b):
    return np.array([[len(x & y) / np.sqrt(len(x) * len(y)) for y in b] for x in a])


def test_kernels_and_values_equal_a_plain_regression():
    rng = np.random.default_rng(8)
    words = {"a": ["lo", "mar", "teé", "sol"], "b": ["kun", "zur", "mar", "ßo"], "c": ["why", "sol", "thé", "zur"]}
    texts, langs = zip(*((" ".join(rng.choice(words[la], rng.integers(1, 30))) + rng.choice(["", "\n\n x", "  "]), la) for la in rng.choice(list("abc"), 90)), strict=True)
    marks = list(range(0, 90, 9))
    model = language_id.landmark_model([texts[i].lower().encode() for i in marks], list("abc"))
    buf, offsets = language_id.C.text_buffer(language_id.pa.array([t.lower() for t in texts]))
    k = language_id.kernel(model, buf, offsets)
    sets = [set_of_grams(t) for t in texts]
    assert np.allclose(k, plain_kernel(sets, [sets[i] for i in marks]), atol=1e-5)
    x = np.column_stack([k, np.ones(90)]).astype(float)
    y = np.where(np.array(langs)[:, None] == np.array(list("abc")), 1.0, -1.0)
    between = model.rows.astype(float).T @ model.rows
    got = x @ language_id.solve(between, x.T @ x, x.T @ y, 1e-3)
    # the same in the features themselves: penalised least squares by an augmented system
    value, vector = np.linalg.eigh(between)
    phi = np.column_stack([k @ vector / np.sqrt(value), np.ones(90)])
    free = np.r_[np.full(len(value), np.sqrt(1e-3 * 90)), 0.0]
    w = np.linalg.lstsq(np.vstack([phi, np.diag(free)]), np.vstack([y, np.zeros((len(free), 3))]), rcond=None)[0]
    assert np.allclose(got, phi @ w, atol=1e-3) and (got.argmax(1) == y.argmax(1)).mean() > 0.9


def test_held_out_languages_are_predicted(spark):
    import os

    ship(spark)
    at = "/root/testdata/sf0.01" if os.path.isdir("/root/testdata/sf0.01") else pytest.skip("no data")
    docs = spark.read.parquet(f"{at}/documents.parquet")
    got = queries.op11_language_id(spark, at).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)


def test_language_cases(spark):
    ship(spark)
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2][:40]
    rng = np.random.default_rng(13)
    rows = [(i, " ".join(rng.choice(["der", "und", "die", "nicht", "schon", "zwei"] if n < 20 else ["the", "and", "of", "with", "why", "that"], 12)), "de" if n < 20 else "en", "x") for n, i in enumerate(ids)]
    more = [(1000, None, "en", "x"), (1001, "", "en", "x"), (1002, "12 34 !?", "en", "x"), (None, "the and", None, "x"), (1003, "the of " * 60_000, None, "x"), (1003, "nicht die", None, "x")]
    docs = spark.createDataFrame(rows + more, "doc_id long, text string, lang string, letters string")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.lang_pred, r.score) for r in language_id.predict(docs, language_id.fit(docs)).collect() if r.doc_id is None or r.doc_id >= 1000)
    assert [g[:2] for g in got] == [(-1, "en"), (1000, "und"), (1001, "und"), (1002, "und"), (1003, "de"), (1003, "en")]
    assert [g[2] for g in got[1:4]] == [0.0, 0.0, 0.0]
    nothing = docs.where("doc_id >= 1000")
    assert language_id.fit(nothing.where("lang IS NULL")) is None and {r.lang_pred for r in language_id.predict(nothing, None).collect()} == {"und"}
    one = docs.where("lang = 'de'")
    assert all(r.lang_pred == "de" and r.score > 0.999 for r in language_id.predict(one, language_id.fit(one)).collect())
    empty = docs.where("1 = 0")
    assert language_id.predict(empty, language_id.fit(empty)).count() == 0


def test_one_text_repeated_does_not_crowd_out_the_sample(spark):
    ship(spark)
    learned = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(learned[0], "same words again", "en")] * 500 + [(i, f"text number {i}", "en") for i in learned[1:60]]
    got = language_id.chosen_texts(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 30, 8192).collect()
    assert len(got) == 30 and len({r._text for r in got}) == 30


# ---------------------------------------------------------------- vector codes


def test_orchard_finds_the_nearest_entry_with_ties():
    rng = np.random.default_rng(9)
    for _ in range(200):
        k, w, m = rng.integers(1, 17), rng.integers(1, 9), rng.choice([2, 5, 300])
        entries, x = rng.integers(-m, m, (k, w)), rng.integers(-m, m, (200, w))
        apart = ((x[:, None] - entries[None]) ** 2).sum(2)
        index, near = vector_codes.orchard(x, entries)
        assert (index == apart.argmin(1)).all() and (near == apart.min(1)).all()


def plain_codes(rows, parts=8, entries=16, rounds=6):
    rows = sorted(((i, [int(np.floor(4096 * float(c))) for c in v], la) for i, v, la in rows), key=lambda r: (r[0] is None, r[0], r[1]))
    d = len(rows[0][1])
    cuts = [i * d // parts for i in range(parts + 1)]
    books = [[r[1][a:b] for r in rows[:entries]] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def nearest_entry(part, book):
        return min((sum((x - y) ** 2 for x, y in zip(part, e, strict=True)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for r in rows:
                part = r[1][cuts[p] : cuts[p + 1]]
                groups.setdefault(nearest_entry(part, books[p])[1], []).append(part)
            for j, g in groups.items():
                books[p][j] = [sum(c) // len(g) for c in zip(*g, strict=True)]
    out = []
    for i, v, la in rows:
        found = [nearest_entry(v[cuts[p] : cuts[p + 1]], books[p]) for p in range(parts)]
        out.append([i, la, "".join(f"{j:02x}" for _, j in found), sum(x for x, _ in found)])
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, code, e, sum(r[3] for r in out if r[1] == la), digest) for i, la, code, e in out), key=str)


@pytest.mark.parametrize("n", [1, 5, 16, 120])
def test_vector_codes_equal_a_plain_loop(spark, n):
    ship(spark)
    rng = np.random.default_rng(n)
    rows = [(int(rng.integers(0, n)), np.round(rng.standard_normal(16), 2).tolist(), None if i % 7 == 0 else int(i % 3)) for i in range(n)]
    rows += [rows[0]] * 3 + [(None, rows[0][1], 1)]
    bad = [(7, None, 1), (8, [float("nan")] + [0.0] * 15, 1), (9, [None] + [0.0] * 15, 1), (10, [float("inf")] * 16, 1), (11, [0.5], 1), (12, [], None)]
    t = spark.createDataFrame([(i, v, la, "x") for i, v, la in rows + bad], "vec_id long, embedding array<double>, label int, code string").repartition(3)
    got = sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.vector_codes(t).collect()), key=str)
    assert got == plain_codes(rows)


def test_vector_codes_of_an_empty_table_and_of_zeros(spark):
    ship(spark)
    t = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<double>, label int")
    assert vector_codes.vector_codes(t).count() == 0
    zeros = spark.createDataFrame([(i, [0.0] * 8, None) for i in range(40)], "vec_id long, embedding array<double>, label int")
    assert {(r.code, r.error, r.label_error) for r in vector_codes.vector_codes(zeros).collect()} == {("00" * 8, 0, 0)}


def test_frequent_and_rare_labels_get_their_sums(spark):
    ship(spark)
    rows = [(i, [float(i % 50)] * 8, 0 if i % 3 == 0 else i) for i in range(3000)]
    got = vector_codes.vector_codes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), rounds=1).collect()
    want = {}
    for r in got:
        key = 0 if r.vec_id % 3 == 0 else r.vec_id
        want[key] = want.get(key, 0) + r.error
    assert len(got) == 3000 and all(r.label_error == want[0 if r.vec_id % 3 == 0 else r.vec_id] for r in got)


# ---------------------------------------------------------------- periodic runs


def plain_runs(words):
    n, best = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                best.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, m, q) for (s, m), q in best.items()), key=lambda r: (r[0], r[2]))


def plain_row(i, text, rewrite=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(i).encode()), len(words)
    if rewrite and i is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[j] if j < a else words[a + (j - a) % p] for j in range(n)]
    runs = plain_runs(words)
    gone = {j for s, m, q in runs for j in range(s + q, s + m)}
    top = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else None
    text_of_runs = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = " ".join(w for j, w in enumerate(words) if j not in gone)
    return (i, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, hashlib.sha256(text_of_runs.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_lyndon_groups_give_the_lyndon_array():
    rng = np.random.default_rng(10)
    for _ in range(300):
        x = rng.integers(0, rng.integers(1, 5), rng.integers(1, 40)).tolist()
        symbols = max(x) + 1
        want = [max(m for m in range(1, len(x) - i + 1) if all(x[i : i + m] < x[i + c : i + m] for c in range(1, m))) for i in range(len(x))]
        got = {}
        for i, p, k in periodic_runs.lyndon_groups(x, symbols):
            got |= {i + j * p: p for j in range(k)}
        assert [got[i] for i in range(len(x))] == want


def test_runs_equal_a_plain_search():
    rng = np.random.default_rng(11)
    for _ in range(1500):
        n = int(rng.integers(0, 60))
        x = rng.integers(0, rng.choice([1, 2, 3, 6]), n)
        if n > 8 and rng.random() < 0.6:
            a = int(rng.integers(0, n))
            p = int(rng.integers(1, max(2, (n - a) // 4 + 1)))
            x[a:] = x[a + np.arange(n - a) % p]
        want = plain_runs(x.tolist())
        words = periodic_runs.C.mix(x.astype(np.uint64) + np.uint64(77))
        assert periodic_runs.chunk_runs(words, np.array([0, n])).get(0, []) == want
        assert periodic_runs.runs_of(x.tolist(), int(x.max()) + 1 if n else 0) == set(want)


def test_long_texts_of_one_word_and_of_rising_words():
    assert periodic_runs.runs_of([0] * 50_000, 1) == {(0, 50_000, 1)}
    assert periodic_runs.runs_of(list(range(20_000)), 20_000) == set()
    assert periodic_runs.runs_of(list(range(500)) * 40, 500) == {(0, 20_000, 500)}


def test_periodic_runs_of_documents_equal_a_plain_search(spark):
    ship(spark)
    rng = np.random.default_rng(12)
    rows = []
    for i in range(300):
        words = rng.choice(["a", "b", "é", "dd", "e!"], rng.integers(0, 80)).tolist()
        if i % 3 == 0 and words:
            words = words + words[-int(rng.integers(1, 6)) :] * 6 + words[:4]
        rows.append((i, rng.choice([" ", "\n", "\t  "]).join(words), 5))
    rows += [(1000, None, 5), (1001, "", 5), (1002, " \n ", 5), (None, "x " * 30, 5), (1003, "la " * 200_000, 5), (4, rows[4][1], 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_runs int").repartition(4)
    long = plain_row(0, "la " * 8)
    for rewrite in (True, False):
        got = sorted(map(tuple, periodic_runs.periodic_runs(docs, rewrite).collect()), key=str)
        want = [plain_row(i, t, rewrite) for i, t, _ in rows if i != 1003]
        assert [g for g in got if g[0] != 1003] == sorted(want, key=str)
        one = next(g for g in got if g[0] == 1003)
        assert one[1] == 1 and one[3] == 200_000 and one[4] == 1 and one[7] == long[7]
    assert periodic_runs.periodic_runs(docs.where("1 = 0")).count() == 0
