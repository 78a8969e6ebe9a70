from barlab.plans import registry


def test_folds_follow_each_symbols_own_length(spark):
    lengths = {"a": 720, "b": 344, "c": 343, "d": 1000, "e": 403, "f": 404}
    bars = spark.createDataFrame([(s, h, 1.0 + h % 7) for s, n in lengths.items() for h in range(n)], "symbol string, hour long, close double")
    got = sorted((r.symbol, r.fold, r.role, r.bars) for r in registry.walk_forward(bars).collect())
    want, start = [], 0
    for s, n in lengths.items():
        start = 0
        while start + 344 <= n:
            want += [(s, start // 60, "train", 200), (s, start // 60, "val", 60), (s, start // 60, "test", 60)]
            start += 60
    assert got == sorted(want)
    assert sum(s == "a" and role == "test" for s, _, role, _ in got) == 7
