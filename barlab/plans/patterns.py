"""Candle windows, scaling, clusters, their profiles, labels and sequences.

Window vectors are arrays made by one framed window over bars. Clusters are fitted to the training part of their scaled
values as whole numbers (`operators/clusters.py`), so SQL can fit the same; a fit is a table of centroids, and labels,
profiles, blends and predictions read it. Centroids are few and known in size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.functions.layers import layers_sql, over
from barlab.functions.series import running
from barlab.operators import clusters
from barlab.operators.quantiles import exact_quantiles
from barlab.plans.frame import framed
from barlab.plans.relations import Tables, computed, derived, query, relation

SIZE = 10
_W = over(SIZE)
#: Per candle: open, high, low and close from the first close by the window's range, volume by its mean, body, wicks, range, return.
_FIELDS = ["(c.o - r) / g", "(c.h - r) / g", "(c.l - r) / g", "(c.c - r) / g", "c.v / m", "(c.c - c.o) / g", "(c.h - greatest(c.c, c.o)) / g", "(least(c.c, c.o) - c.l) / g", "(c.h - c.l) / g", "c.d"]


def _window(spark: bool) -> list[dict[str, str]]:
    ret = "coalesce(close / lag(close) OVER (PARTITION BY symbol ORDER BY hour) - 1, 0)"
    row = "named_struct('o', open, 'h', high, 'l', low, 'c', close, 'v', volume, 'd', dr)" if spark else "{'o': open, 'h': high, 'l': low, 'c': close, 'v': volume, 'd': dr}"
    fields = [f.replace("c.d", "CASE WHEN i = 0 THEN 0e0 ELSE c.d END") for f in _FIELDS]
    if spark:
        vector = f"flatten(transform(candles, (c, i) -> array({', '.join(fields)})))"
    else:
        vector = f"flatten(list_transform(candles, lambda c, i: [{', '.join(f.replace('i = 0', 'i = 1') for f in fields)}]))"
    return [
        {"dr": ret}, {"candles": f"{'collect_list' if spark else 'list'}({row}) {_W}", "g": f"max(high) {_W} - min(low) {_W}", "r": f"first_value(close) {_W}", "m": f"avg(volume) {_W}", "held": f"count(*) {_W}", "fwd": "lead(close, 5) OVER (PARTITION BY symbol ORDER BY hour) / close - 1"},
        {"v": f"CASE WHEN held = {SIZE} AND g > 0 AND r > 0 AND m > 0 THEN {vector} END"},
    ]


relation("windows", lambda t: framed(t.get("b").select("symbol", "hour", "_i", "open", "high", "low", "close", "volume"), _window(True), 16, 5).where("v IS NOT NULL").select("symbol", "hour", "_i", "fwd", "v"), f"SELECT symbol, hour, _i, fwd, v FROM ({layers_sql('SELECT symbol, hour, _i, open, high, low, close, volume FROM b', _window(False))}) WHERE v IS NOT NULL", "b", write=True)
computed("m01_candle_windows", lambda t: t.get("windows").selectExpr("symbol", "hour", "size(v) AS n", "round(aggregate(v, 0D, (a, x) -> a + x), 5) AS total", "round(v[3], 6) AS first_close", "round(v[99], 6) AS last_return"), "SELECT symbol, hour, len(v)::INT AS n, round(list_sum(v), 5) AS total, round(v[4], 6) AS first_close, round(v[100], 6) AS last_return FROM windows", "windows")
query("m02_forward_returns", "SELECT symbol, hour, round(fwd, 8) AS fwd FROM {windows} WHERE fwd IS NOT NULL")

# ---------------------------------------------------------------- scaling

relation("dims", lambda t: t.get("t_embeddings").where("vec_id IS NOT NULL").selectExpr("vec_id", "label", "posexplode(embedding) AS (dim, x)").selectExpr("vec_id", "label", "dim", "cast(x AS double) AS x"), "SELECT vec_id, label, unnest(range(len(embedding)))::INT AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE vec_id IS NOT NULL")
derived("train_dims", "SELECT * FROM {dims} WHERE vec_id % 10 < 7")
query("m03_standard_scaling", "SELECT dim, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS sd FROM {dims} GROUP BY dim")
computed("m16_robust_scaling", lambda t: exact_quantiles(t.get("train_dims"), ["dim"], "x", [0.25, 0.5, 0.75]).selectExpr("dim", "round(q[1], 6) AS middle", "round(q[2] - q[0], 6) AS iqr"), "SELECT dim, round(median(x), 6) AS middle, round(percentile_cont(0.75) WITHIN GROUP (ORDER BY x) - percentile_cont(0.25) WITHIN GROUP (ORDER BY x), 6) AS iqr FROM train_dims GROUP BY dim", "train_dims")

# ---------------------------------------------------------------- fitted clusters

derived("bar_counts", "SELECT symbol, count(*) AS n FROM {b} GROUP BY symbol")
#: The first 70 percent of a symbol's bars, the next 15 and the last; forward returns of a part do not reach into the next.
derived("parted_windows", "SELECT w.symbol, w.hour, w._i, w.fwd, w.v, CASE WHEN 100 * (w._i + 5) < 70 * n THEN 'train' WHEN 100 * w._i >= 70 * n AND 100 * (w._i + 5) < 85 * n THEN 'val' WHEN 100 * w._i >= 85 * n THEN 'test' ELSE 'gap' END AS part FROM {windows} w JOIN {bar_counts} c ON c.symbol = w.symbol")
relation(
    "scaler",
    lambda t: t.get("parted_windows").where("part = 'train'").selectExpr("posexplode(v) AS (dim, x)").groupBy("dim").agg(F.expr("round(avg(x), 6) AS m"), F.expr("round(stddev_pop(x), 6) AS s")).groupBy().agg(F.expr("sort_array(collect_list(struct(dim, m, s))) AS scale")),
    "SELECT list(m ORDER BY dim) AS m, list(s ORDER BY dim) AS s FROM (SELECT dim, round(avg(v[dim]), 6) AS m, round(stddev_pop(v[dim]), 6) AS s FROM parted_windows, unnest(range(1, 101)) AS u(dim) WHERE part = 'train' GROUP BY dim)",
    "parted_windows",
)
#: Thousandths of a standard deviation of the training part, as whole numbers.
relation(
    "scaled_windows",
    lambda t: t.get("parted_windows").crossJoin(F.broadcast(t.get("scaler"))).selectExpr("symbol", "hour", "_i", "fwd", "part", "zip_with(v, scale, (x, y) -> cast(floor(CASE WHEN y.s > 0 THEN 1000 * (x - y.m) / y.s ELSE 0D END + 0.5D) AS bigint)) AS q"),
    "SELECT symbol, hour, _i, fwd, part, concat_ws(':', symbol, hour) AS id, md5(concat_ws(':', symbol, hour)) AS o, list_transform(list_zip(v, m, s), lambda y: floor(CASE WHEN y[3] > 0 THEN 1000 * (y[1] - y[2]) / y[3] ELSE 0 END + 0.5)) AS v FROM parted_windows CROSS JOIN scaler",
    "parted_windows",
    "scaler",
    write=True,
)
MICRO = 7
#: Macro groups by the 33rd and 67th percentile of the training part's forward return. Groups know the future, so they serve the fit alone; rows are assigned by their own features.
_LOW, _HIGH = 0.33, 0.67
_GROUPED_SQL = f"SELECT id, o, v, CASE WHEN fwd < lo THEN 0 WHEN fwd > hi THEN 2 ELSE 1 END AS grp FROM scaled_windows CROSS JOIN (SELECT round(quantile_cont(fwd, {_LOW}), 9) AS lo, round(quantile_cont(fwd, {_HIGH}), 9) AS hi FROM scaled_windows WHERE part = 'train' AND fwd IS NOT NULL) WHERE part = 'train' AND fwd IS NOT NULL"
_TRAIN_SQL = "SELECT id, o, v, 0 AS grp FROM scaled_windows WHERE part = 'train' AND fwd IS NOT NULL"


def _train(t: Tables) -> DataFrame:
    return t.get("scaled_windows").where("part = 'train' AND fwd IS NOT NULL").selectExpr("0 AS grp", "md5(concat_ws(':', symbol, hour)) AS o", "q", "fwd")


def _grouped(t: Tables) -> DataFrame:
    rows = _train(t)
    lo, hi = (round(x, 9) for x in exact_quantiles(rows, ["grp"], "fwd", [_LOW, _HIGH]).first()["q"])
    return rows.withColumn("grp", F.expr(f"CASE WHEN fwd < {lo!r}D THEN 0 WHEN fwd > {hi!r}D THEN 2 ELSE 1 END"))


def _with(expressions: list[tuple[str, str]], body: str) -> str:
    return f"WITH {', '.join(f'{n} AS MATERIALIZED ({s})' for n, s in expressions)} {body}"


_BOOK_SQL = "SELECT grp::INT AS grp, e::INT AS e, c FROM {}"
#: variant -> (clusters, numbers of a macro group, fit, its SQL)
VARIANTS = {
    **{f"flat_{k}": (k, k, lambda t, k=k: clusters.fit(_train(t), k), _with([("x", _TRAIN_SQL), *clusters.fit_sql("f", "x", k)], _BOOK_SQL.format("fb6"))) for k in (8, 20, 50)},
    **{f"bisecting_{k}": (k, k, lambda t, k=k: {0: clusters.bisected(_train(t), k)}, _with([("x", _TRAIN_SQL), *clusters.bisected_sql("h", "x", k)], _BOOK_SQL.format("hc"))) for k in (20, 50)},
    f"two_level_{3 * MICRO}": (3 * MICRO, MICRO, lambda t: clusters.fit(_grouped(t), MICRO), _with([("x", _GROUPED_SQL), *clusters.fit_sql("g", "x", MICRO)], _BOOK_SQL.format("gb6"))),
}
TWO = f"two_level_{3 * MICRO}"
for _v, (_k, _per, _fit, _sql) in VARIANTS.items():
    relation(f"book_{_v}", lambda t, f=_fit: clusters.as_table(t.spark, f(t)), _sql, "scaled_windows", write=True)
    relation(f"labels_{_v}", lambda t, v=_v, per=_per: clusters.assigned(t.get("scaled_windows"), clusters.from_table(t.get(f"book_{v}")), ["symbol", "hour", "_i", "fwd", "part"], per), clusters.assigned_sql("scaled_windows", f"book_{_v}", "symbol, hour, _i, fwd, part", _per), "scaled_windows", f"book_{_v}", write=True)
for _name, _v in (("m04_kmeans", "flat_8"), ("m04_kmeans_20", "flat_20"), ("m04_kmeans_50", "flat_50"), ("m05_bisecting", "bisecting_20"), ("m05_bisecting_50", "bisecting_50")):
    query(_name, f"SELECT symbol, hour, part, cluster FROM {{labels_{_v}}}")
query("m06_two_levels", f"SELECT symbol, hour, part, cast(floor(cluster / {MICRO}e0) AS int) AS macro, cluster FROM {{labels_{TWO}}} WHERE part = 'train'")
query("m07_nearest_centroid", f"SELECT symbol, hour, cast(floor(cluster / {MICRO}e0) AS int) AS macro, cluster % {MICRO} AS micro FROM {{labels_{TWO}}} WHERE part <> 'train'")
computed("m12_saved_model", lambda t: t.get("book_flat_8").selectExpr("grp", "entry", "size(q) AS dims", "cast(q[3] AS bigint) AS first_close", "cast(q[99] AS bigint) AS last_return", "aggregate(q, 0L, (a, x) -> a + x) AS total"), "SELECT grp, e AS entry, len(c)::INT AS dims, c[4]::BIGINT AS first_close, c[100]::BIGINT AS last_return, list_sum(c)::BIGINT AS total FROM book_flat_8", "book_flat_8")
_COMPARED = ["flat_8", "flat_20", "bisecting_20", TWO]
derived("variant_labels", " UNION ALL ".join(f"SELECT '{v}' AS variant, {VARIANTS[v][0]} AS clusters, symbol, hour, _i, fwd, part, cluster FROM {{labels_{v}}}" for v in _COMPARED))
query("m08_effective_clusters", "SELECT variant, clusters, part, count(DISTINCT cluster) AS used, round(count(DISTINCT cluster) / cast(clusters AS double), 6) AS share FROM {variant_labels} GROUP BY variant, clusters, part")
query("a44_clusters_by_part", "SELECT part, count(DISTINCT cluster) AS clusters, count(*) AS n FROM {labels_flat_20} GROUP BY part")
derived("shapes", "SELECT symbol, hour, _i, fwd, part, cluster FROM {labels_flat_8}")
query("m09_classified_windows", "SELECT symbol, hour, cluster FROM {shapes}")
#: Every third bar is classified; the bars between keep the last cluster.
relation(
    "cluster_by_bar",
    lambda t: running(t.get("b").select("symbol", "hour").join(t.get("shapes").where("_i % 3 = 0").select("symbol", "hour", "cluster"), ["symbol", "hour"], "left"), {"last_cluster": ("last", "cluster")}, ["symbol"], "hour").drop("cluster"),
    "SELECT b.symbol, b.hour, last_value(s.cluster IGNORE NULLS) OVER (PARTITION BY b.symbol ORDER BY b.hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_cluster FROM b LEFT JOIN shapes s ON s.symbol = b.symbol AND s.hour = b.hour AND s._i % 3 = 0",
    "b",
    "shapes",
)
query("m10_cluster_by_bar", "SELECT symbol, hour, last_cluster FROM {cluster_by_bar}")
_PROFILE = """count(*) AS n, avg(fwd) AS mean, stddev_pop(fwd) AS sd, avg(CASE WHEN fwd > 0.005 THEN 1e0 ELSE 0e0 END) AS p_up, avg(CASE WHEN fwd < -0.005 THEN 1e0 ELSE 0e0 END) AS p_down, avg(CASE WHEN fwd > 0 THEN 1e0 ELSE 0e0 END) AS win_rate, coalesce(avg(CASE WHEN fwd > 0 THEN fwd END), 0) AS avg_up, coalesce(avg(CASE WHEN fwd < 0 THEN fwd END), 0) AS avg_down"""
#: Old profiles are those of the training part, new ones of the validation part.
derived("profiled", "SELECT cluster, fwd, CASE WHEN part = 'train' THEN 'old' ELSE 'new' END AS part FROM {shapes} WHERE fwd IS NOT NULL AND part IN ('train', 'val')")
relation("middles", lambda t: exact_quantiles(t.get("profiled"), ["part", "cluster"], "fwd", [0.5]).selectExpr("part", "cluster", "q[0] AS middle"), "SELECT part, cluster, median(fwd) AS middle FROM profiled GROUP BY part, cluster", "profiled")
derived("raw_profiles", f"SELECT r.*, middle FROM (SELECT part, cluster, {_PROFILE} FROM {{profiled}} GROUP BY part, cluster) r JOIN {{middles}} m ON m.part = r.part AND m.cluster = r.cluster")
#: Every cluster has a profile; one of fewer than five windows has the default.
derived(
    "profiles",
    """SELECT p.part, i.cluster, coalesce(n, 0) AS n, CASE WHEN n >= 5 THEN mean ELSE 0e0 END AS mean, CASE WHEN n >= 5 THEN greatest(sd, 1e-6) ELSE 1e0 END AS sd, CASE WHEN n >= 5 THEN p_up ELSE 0.33e0 END AS p_up, CASE WHEN n >= 5 THEN p_down ELSE 0.33e0 END AS p_down, CASE WHEN n >= 5 THEN 1 - p_up - p_down ELSE 0.34e0 END AS p_neutral,
    CASE WHEN n >= 5 THEN middle ELSE 0e0 END AS middle, CASE WHEN n >= 5 THEN mean / greatest(sd, 1e-6) ELSE 0e0 END AS sharpe, CASE WHEN n >= 5 THEN win_rate ELSE 0.5e0 END AS win_rate, CASE WHEN n >= 5 THEN avg_up ELSE 0e0 END AS avg_up, CASE WHEN n >= 5 THEN avg_down ELSE 0e0 END AS avg_down
    FROM (SELECT cast(i AS int) AS cluster FROM {numbers} WHERE i < 8) i CROSS JOIN (SELECT 'old' AS part UNION ALL SELECT 'new') p LEFT JOIN {raw_profiles} r ON r.cluster = i.cluster AND r.part = p.part""",
    write=True,
)
query("a26_cluster_profiles", "SELECT part, cluster, n, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("mean", "sd", "p_up", "p_down", "p_neutral", "middle", "sharpe", "win_rate", "avg_up", "avg_down")) + " FROM {profiles}")
query("a27_actionable_clusters", "SELECT part, cluster, n, round(sharpe, 6) AS sharpe, row_number() OVER (PARTITION BY part ORDER BY abs(sharpe) DESC, cluster) AS place FROM {profiles} WHERE abs(sharpe) > 0.3 AND n >= 20")
query("m11_blended_profiles", "SELECT o.cluster, CASE WHEN coalesce(n.n, 0) < 3 THEN o.n ELSE o.n + n.n END AS n, " + ", ".join(f"round(CASE WHEN coalesce(n.n, 0) < 3 THEN o.{c} ELSE 0.85 * o.{c} + 0.15 * n.{c} END, 6) AS {c}" for c in ("mean", "sd", "p_up", "p_down", "win_rate")) + " FROM (SELECT * FROM {profiles} WHERE part = 'old') o FULL OUTER JOIN (SELECT * FROM {profiles} WHERE part = 'new') n ON n.cluster = o.cluster")
query("j05_profile_by_bar", "SELECT s.symbol, s.hour, s.cluster, round(p_up, 6) AS p_up, round(p_down, 6) AS p_down FROM {shapes} s JOIN {profiles} p ON p.part = 'old' AND p.cluster = s.cluster")
derived("predicted", "SELECT symbol, hour, 1 / (1 + exp(-coalesce(ret_zscore_20, 0) - coalesce(roc_12, 0) / 200)) AS q_up, rsi_14, adx_14, volume_ratio, atr_14 FROM {f}")
_UP, _DOWN = "(0.4 * p_up + 0.6 * q_up)", "(0.4 * p_down + 0.6 * (1 - q_up))"
query("g13_pattern_blend", f"SELECT symbol, hour, side, round(up, 6) AS up, round(down, 6) AS down FROM (SELECT s.symbol, s.hour, {_UP} AS up, {_DOWN} AS down, CASE WHEN {_UP} > {_DOWN} AND {_UP} > 0.5 AND coalesce(rsi_14, 50) <= 75 AND p_up >= 0.3 THEN 1 WHEN {_DOWN} > {_UP} AND {_DOWN} > 0.5 AND coalesce(rsi_14, 50) >= 25 AND p_down >= 0.3 THEN -1 END AS side FROM {{shapes}} s JOIN {{profiles}} p ON p.part = 'old' AND p.cluster = s.cluster JOIN {{predicted}} q ON q.symbol = s.symbol AND q.hour = s.hour WHERE p.n >= 10 AND atr_14 > 0 AND coalesce(adx_14, 20) >= 10 AND coalesce(volume_ratio, 1) >= 0.5 AND greatest(q_up, 1 - q_up) >= 0.55) WHERE side IS NOT NULL")

# ---------------------------------------------------------------- labels and sequences

query("m13_labels_with_mask", "SELECT symbol, hour, CASE WHEN fwd IS NULL THEN NULL WHEN fwd > 0.005 THEN 2 WHEN fwd < -0.005 THEN 0 ELSE 1 END AS direction, round(abs(fwd), 8) AS magnitude, fwd IS NOT NULL AS usable FROM {windows}")
_SEQ = 5
_STEP = over(_SEQ, skip=1)


def _sequences(spark: bool) -> list[dict[str, str]]:
    """The last rows of features before a bar, whose own direction is the label."""
    hot = "transform(sequence(0, 7), k -> CASE WHEN k = cluster THEN 1D ELSE 0D END)" if spark else "list_transform(range(8), lambda k: CASE WHEN k = cluster THEN 1e0 ELSE 0e0 END)"
    rows = "array(rsi_f / 100, vol_f, pct_f)" if spark else "[rsi_f / 100, vol_f, pct_f]"
    collect = "collect_list" if spark else "list"
    return [
        {"row": rows, "hot": f"CASE WHEN cluster IS NULL THEN NULL ELSE {hot} END"}, {"seq": f"{collect}(row) {_STEP}", "hots": f"{collect}(hot) {_STEP}", "held": f"count(*) {_STEP}", "hot_held": f"count(cluster) {_STEP}"},
    ]


#: Gaps take the last value before them, however far, those at the beginning the first after them, and 0 where there is none.
_FILLED = {"rsi_f": "rsi_14", "vol_f": "vol_ratio", "pct_f": "bb_pct_b"}


def _filled(t: Tables) -> DataFrame:
    rows = t.get("bars_with_cluster")
    rows = running(rows, {f"_{out}": ("last", c) for out, c in _FILLED.items()}, ["symbol"], "hour")
    rows = running(rows, {f"_b_{out}": ("last", c) for out, c in _FILLED.items()}, ["symbol"], "hour", backwards=True)
    return rows.selectExpr("symbol", "hour", "_i", "ret_1", "cluster", "fwd", *(f"coalesce(_{out}, _b_{out}, 0) AS {out}" for out in _FILLED))


_FILLED_SQL = ", ".join(f"coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY hour ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS {out}" for out, c in _FILLED.items())
derived("bars_with_cluster", "SELECT f.symbol, f.hour, f._i, f.rsi_14, f.vol_ratio, f.bb_pct_b, f.ret_1, s.cluster, s.fwd FROM {f} f LEFT JOIN {shapes} s ON s.symbol = f.symbol AND s.hour = f.hour")
relation("filled_bars", _filled, f"SELECT symbol, hour, _i, ret_1, cluster, fwd, {_FILLED_SQL} FROM bars_with_cluster", "bars_with_cluster")
relation("sequences", lambda t: framed(t.get("filled_bars"), _sequences(True), 64).where(f"held = {_SEQ}"), f"SELECT * FROM ({layers_sql('SELECT * FROM filled_bars', _sequences(False))}) WHERE held = {_SEQ}", "filled_bars", write=True)
computed("m14_sequences", lambda t: t.get("sequences").selectExpr("symbol", "hour", "size(seq) AS steps", "round(seq[0][0], 6) AS first_rsi", "round(aggregate(flatten(seq), 0D, (a, x) -> a + x), 5) AS total", "CASE WHEN ret_1 > 0 THEN 1 ELSE 0 END AS label"), "SELECT symbol, hour, len(seq)::INT AS steps, round(seq[1][1], 6) AS first_rsi, round(list_sum(flatten(seq)), 5) AS total, CASE WHEN ret_1 > 0 THEN 1 ELSE 0 END AS label FROM sequences", "sequences")
computed("m15_one_hot_sequences", lambda t: t.get("sequences").where(f"hot_held = {_SEQ}").selectExpr("symbol", "hour", "size(flatten(hots)) AS width", "cast(aggregate(flatten(hots), 0D, (a, x) -> a + x) AS int) AS ones", "array_position(hots[4], 1D) - 1 AS last_cluster", "round(fwd, 8) AS magnitude"), f"SELECT symbol, hour, len(flatten(hots))::INT AS width, list_sum(flatten(hots))::INT AS ones, (list_position(hots[5], 1e0) - 1)::BIGINT AS last_cluster, round(fwd, 8) AS magnitude FROM sequences WHERE hot_held = {_SEQ}", "sequences")

# ---------------------------------------------------------------- classification scores

#: Truth and prediction of three classes per window: by the sign of the forward return and by the profile of its shape.
derived("guesses", "SELECT s.symbol, s._i, part, cast(floor(s._i / 50e0) AS bigint) AS fold, CASE WHEN fwd > 0.005 THEN 2 WHEN fwd < -0.005 THEN 0 ELSE 1 END AS truth, CASE WHEN p_up > p_down + 0.02 THEN 2 WHEN p_down > p_up + 0.02 THEN 0 ELSE 1 END AS guess FROM (SELECT * FROM {shapes} WHERE fwd IS NOT NULL AND part IN ('val', 'test')) s JOIN (SELECT cluster AS k, p_up, p_down FROM {profiles} WHERE part = 'old') p ON p.k = s.cluster", write=True)
derived("confusion", "SELECT k.truth, k.guess, coalesce(n, 0) AS n FROM (SELECT a.i AS truth, b.i AS guess FROM {numbers} a CROSS JOIN {numbers} b WHERE a.i < 3 AND b.i < 3) k LEFT JOIN (SELECT truth, guess, count(*) AS n FROM {guesses} GROUP BY truth, guess) c ON c.truth = k.truth AND c.guess = k.guess", write=True)
query("a28_confusion_matrix", "SELECT truth, guess, n FROM {confusion}")
derived("by_class", "SELECT c.class, support, coalesce(hit / nullif(guessed, 0), 0) AS prec, coalesce(hit / nullif(support, 0), 0) AS rec FROM (SELECT truth AS class, cast(sum(n) AS double) AS support, cast(sum(CASE WHEN truth = guess THEN n ELSE 0 END) AS double) AS hit FROM {confusion} GROUP BY truth) c JOIN (SELECT guess AS class, cast(sum(n) AS double) AS guessed FROM {confusion} GROUP BY guess) g ON g.class = c.class")
query("a28_class_scores", "SELECT class, support, round(prec, 6) AS precision_, round(rec, 6) AS recall, round(CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END, 6) AS f1 FROM {by_class}")
query(
    "a28_overall_scores",
    """SELECT round(acc, 6) AS accuracy, round(balanced, 6) AS balanced_accuracy, round(macro_f1, 6) AS macro_f1, round(baseline, 6) AS majority_baseline, round((hits * total - cross_sum) / nullif(sqrt(total * total - guess_sq) * sqrt(total * total - truth_sq), 0), 6) AS mcc FROM (
      SELECT sum(CASE WHEN truth = guess THEN n ELSE 0 END) / cast(sum(n) AS double) AS acc, cast(sum(CASE WHEN truth = guess THEN n ELSE 0 END) AS double) AS hits, cast(sum(n) AS double) AS total FROM {confusion}) CROSS JOIN (
      SELECT avg(rec) AS balanced, avg(CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END) AS macro_f1, max(support) / sum(support) AS baseline FROM {by_class} WHERE support > 0) CROSS JOIN (
      SELECT sum(t.n * g.n) AS cross_sum, sum(g.n * g.n) AS guess_sq, sum(t.n * t.n) AS truth_sq FROM (SELECT truth AS class, cast(sum(n) AS double) AS n FROM {confusion} GROUP BY truth) t JOIN (SELECT guess AS class, cast(sum(n) AS double) AS n FROM {confusion} GROUP BY guess) g ON g.class = t.class)""",
)
derived("fold_scores", "SELECT fold, 'accuracy' AS metric, avg(CASE WHEN truth = guess THEN 1e0 ELSE 0e0 END) AS value FROM {guesses} GROUP BY fold UNION ALL SELECT fold, 'up_recall', avg(CASE WHEN guess = 2 THEN 1e0 ELSE 0e0 END) FROM {guesses} WHERE truth = 2 GROUP BY fold")
query("a52_prediction_folds", "SELECT metric, count(*) AS folds, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd FROM {fold_scores} GROUP BY metric")
#: Each variant's profiles come from the training part; what they say is held against the test part, beside two that learn nothing.
derived("trained", "SELECT variant, cluster, avg(CASE WHEN fwd > 0.005 THEN 1e0 ELSE 0e0 END) AS p_up, avg(CASE WHEN fwd < -0.005 THEN 1e0 ELSE 0e0 END) AS p_down FROM {variant_labels} WHERE part = 'train' AND fwd IS NOT NULL GROUP BY variant, cluster HAVING count(*) >= 5")
derived(
    "tested",
    """SELECT l.variant, CASE WHEN fwd > 0.005 THEN 2 WHEN fwd < -0.005 THEN 0 ELSE 1 END AS truth, CASE WHEN p_up > p_down + 0.02 THEN 2 WHEN p_down > p_up + 0.02 THEN 0 ELSE 1 END AS guess FROM {variant_labels} l LEFT JOIN {trained} p ON p.variant = l.variant AND p.cluster = l.cluster WHERE l.part = 'test' AND fwd IS NOT NULL
    UNION ALL SELECT b.name, CASE WHEN fwd > 0.005 THEN 2 WHEN fwd < -0.005 THEN 0 ELSE 1 END, b.guess FROM {labels_flat_8} CROSS JOIN (SELECT 'always_up' AS name, 2 AS guess UNION ALL SELECT 'always_flat', 1) b WHERE part = 'test' AND fwd IS NOT NULL""",
)
query("m18_variants_on_test", "SELECT variant, count(*) AS n, round(avg(CASE WHEN truth = guess THEN 1e0 ELSE 0e0 END), 6) AS accuracy, round(avg(CASE WHEN truth = 2 THEN CASE WHEN guess = 2 THEN 1e0 ELSE 0e0 END END), 6) AS up_recall, round(avg(CASE WHEN truth = 0 THEN CASE WHEN guess = 0 THEN 1e0 ELSE 0e0 END END), 6) AS down_recall FROM {tested} GROUP BY variant")
