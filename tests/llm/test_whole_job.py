"""What must not be lost on larger or unusual inputs."""

import collections
import math
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("barlab.llm.queries")
from barlab.llm import language_model
from barlab.shipping import ship

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LEARNED = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 7 != 2]
HELD = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 7 == 2]


def spelled(text):
    return b"".join(w.encode() + b" " for w in WORD.findall(text.lower())) + b"\n"


def plain_scores(rows, order, least):
    """The tree as dictionaries of all contexts."""
    count = collections.defaultdict(collections.Counter)
    padded = [(i, b"\n" * order + spelled(t)) for i, t in rows]
    for i, t in padded:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            for at in range(order, len(t)):
                for m in range(order + 1):
                    count[t[at - m : at]][t[at]] += 1
    tree = {c: (n, sum(n.values())) for c, n in count.items() if not c or sum(n.values()) >= least}

    def p(context, s):
        n, total = tree.get(context, ({}, 0))
        parent = p(context[1:], s) if context else 1 / 256
        return (n.get(s, 0) + len(n) * parent) / (total + len(n)) if n else parent

    kept = {c for c in tree if len(c) <= 2}
    for c, (n, total) in tree.items():
        if len(c) > 2 and sum(k * math.log(k / total / p(c[1:], s)) for s, k in n.items()) > 0.5 * len(n) * math.log(max(total, 2)):
            kept |= {c[j:] for j in range(len(c))}

    def score(t):
        return sum(math.log10(p(next(t[at - m : at] for m in range(order, -1, -1) if t[at - m : at] in kept), t[at])) for at in range(order, len(t)))

    return {i: score(t) for i, t in padded}


def test_language_model_scores_equal_a_plain_tree(spark):
    ship(spark)
    rng = np.random.default_rng(3)
    vocabulary = [f"{a}{b}é" if i % 5 == 0 else f"{a}{b}{a}" for i, (a, b) in enumerate((a, b) for a in ("ka", "lo", "mi", "nur") for b in ("ta", "te", "sol", "x"))]
    rows = [(i, " ".join(rng.choice(vocabulary, 40, p=(w := np.arange(1, 17) ** 2.0) / w.sum()))) for i in range(60)] + [(60, ""), (61, "Zq kata!")]
    want = plain_scores(rows, 6, 8)
    t = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for size, hot in ((2 << 20, 1 << 20), (500, 1 << 20), (500, 20), (500, 1)):
        got = {r._id: r.score for r in language_model.language_model(t, block_bytes=size, hot_windows=hot).collect()}
        assert got == pytest.approx(want, rel=1e-5)


def test_contexts_with_many_windows_are_split_up_to_the_order(spark):
    ship(spark)
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(["he la", "he lo", "she", "the la", "hex", "la he"], 60))) for i in range(80)]
    sent = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id AS _id", "0L AS _h", "text AS _text", "false AS held_out").mapInArrow(language_model._send_tokens(6, 8, 8, 400), language_model._SENT).where("bucket >= 1048576").select("block", "bucket", "words", "learned")
    low, many = language_model.low_counts(sent.select("words", "learned"), 6, 60)
    splits = language_model.split_contexts(sent.select("words", "learned"), low, many, 6, 8, 60)
    assert 3 in splits.sets and 4 in splits.sets
    assert np.isin(splits.sets[4] >> np.uint64(8), splits.sets[3]).all()
    before = [len(language_model._ut(r.words, "<u8")) for r in sent.collect()]
    parts = sent.mapInArrow(language_model._resplit(6, 8, spark.sparkContext.broadcast(splits)), sent.schema).collect()
    assert len({(r.block, r.bucket) for r in parts}) == len(parts) > len(before) and sum(len(language_model._ut(r.words, "<u8")) for r in parts) == sum(before)


def test_language_model_keeps_its_evidence_as_the_corpus_grows(spark):
    """Twenty passages count the same with nothing or ten million other bytes beside them."""
    ship(spark)
    passage = "zqxjkv wyzqp jxqkz vvqzj"
    filler = "some other words of no meaning " * 32_000
    rows = [(i, passage) for i in LEARNED[:20]] + [(HELD[0], passage)]
    scores = []
    for more in ([], [(i, filler) for i in LEARNED[20:30]]):
        got = language_model.language_model(spark.createDataFrame(rows + more, "doc_id long, text string"))
        scores.append(got.where(f"_id = {HELD[0]}").first().score)
    assert scores[0] > -8 and scores[1] > -12


def test_near_duplicate_stage_keeps_a_row_of_every_class(spark):
    from barlab.llm import pipeline

    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 60)) for _ in range(40)]
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else 100 + i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    copies = [(None, texts[0] + " tail", "en", "s", 0), (7, texts[1], "de", "s", 0), (7, texts[1] + " tail", "en", "s", 0), (999, texts[3], "en", "s", 0), (None, None, "en", "s", 0), (None, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows + copies, "doc_id long, text string, lang string, source string, n_chars long")
    got = [r.text or "" for r in pipeline.near_duplicate_stage(spark, docs, "").collect()]
    assert sorted(t.removesuffix(" tail") for t in got) == sorted([*texts, ""])


def test_windows_of_every_symbol_equal_a_plain_loop():
    texts = [b"a b\n", b"\n", b"\xff\x00ab ab ab\n"]
    for order in (1, 6, 7):
        want = []
        for text in texts:
            full = bytes([language_model.END]) * order + text
            want += [int.from_bytes(full[i - order : i + 1][::-1], "big") for i in range(order, len(full))]
        got = language_model.window_keys(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts]), order)
        assert got.tolist() == want
    assert len(language_model.window_keys(np.zeros(0, np.uint8), np.zeros(0, np.int64), 6)) == 0
