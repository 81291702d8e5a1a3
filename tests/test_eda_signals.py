import numpy as np
from pyspark.sql import functions as F

from sparkinsight.functions.stats import order_statistics, quantiles
from sparkinsight.operators import eda as E
from sparkinsight.operators import signals as I


def test_numeric_summary_shape(sample_df):
    s = E.numeric_summary(sample_df)
    assert s.count() == 4 * 8  # age, salary, churn, score
    assert {r["stat"] for r in s.collect()} == set(E.SUMMARY_STATS)


def test_categorical_summary(sample_df):
    r = E.categorical_summary(sample_df).first()
    assert r["column"] == "dept" and r["unique"] == 4


def test_correlation(sample_df):
    m = E.correlation_matrix(sample_df)
    assert m.count() == 16
    diag = m.where(F.col("i") == F.col("j")).select("corr").distinct().collect()
    assert [r[0] for r in diag] == [1.0]
    assert E.top_correlations(sample_df).count() == 6


def test_constant_column_corr_is_null(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (1.0, 3.0)], "a double, b double")
    r = E.correlation_matrix(df).where("i = 0 and j = 1").first()
    assert r["corr"] is None


def test_trends_match_polyfit(spark):
    rng = np.random.default_rng(1)
    y = np.arange(300) * 0.7 + rng.normal(0, 5, 300)
    y[::7] = np.nan
    rows = [(i, None if np.isnan(v) else float(v)) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "t long, y double")
    r = E.detect_trends(df, "t", ["y"], partitions=6).first()
    s = y[~np.isnan(y)]
    slope = np.polyfit(np.arange(len(s)), s, 1)[0]
    assert abs(r["slope"] - round(slope, 4)) < 1e-4
    assert r["flagged"] == (r["pct"] > 5) and (r["message"] is not None) == r["flagged"]


def test_trend_above_two_million_rows(spark):
    df = spark.range(3_000_000).selectExpr("id AS t", "2.0 * id + 5 AS y")
    r = E.detect_trends(df, "t", ["y"], partitions=8).first()
    assert r["n"] == 3_000_000 and r["slope"] == 2.0


def test_charts_cover_all_columns(spark):
    df = spark.range(50).selectExpr(*[f"id + {k} AS c{k}" for k in range(8)], *[f"cast(id % 3 AS string) AS s{k}" for k in range(4)])
    assert E.histogram(df).select("column").distinct().count() == 8
    assert E.box_stats(df).count() == 8
    assert E.value_counts(df).select("column").distinct().count() == 4
    assert len(E.scatter_frame(df).columns) == 8


def test_trend_needs_ten_points(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(9)], "t long, y double")
    assert E.detect_trends(df, "t", ["y"]).count() == 0


def test_refined_quantiles_equal_exact(spark):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.normal(0, 1, 3000), np.full(500, 2.5), rng.exponential(3, 1000)])
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    probs = [0.1, 0.25, 0.5, 0.75, 0.99]
    exact = quantiles(df, ["x"], probs)["x"]
    refined = quantiles(df, ["x"], probs, limit=100, sketch_k=16)["x"]
    assert np.allclose(exact, refined, rtol=0, atol=1e-12)
    assert np.allclose(refined, np.quantile(vals, probs), atol=1e-9)
    ks = order_statistics(df, "x", [0, 17, 4499], limit=50)
    srt = np.sort(vals)
    assert ks == [srt[0], srt[17], srt[4499]]


def test_kpis_and_signals(sample_df, spark):
    k = I.kpis(sample_df).orderBy("kpi_no").collect()
    assert k[0]["label"] == "Total Rows" and k[0]["value"] == "200"
    assert len(k) == 3 + 2 * 4
    s = I.signals(sample_df).collect()
    assert len(s) >= 1
    quiet = spark.createDataFrame([(1.0, 5.0), (1.1, 3.0), (0.9, 4.0)], "a double, b double")
    assert [r["signal"] for r in I.signals(quiet).collect()] == [I.NO_SIGNALS]


def test_value_counts_top_k(spark):
    df = spark.createDataFrame([(str(i % 20),) for i in range(400)] + [("hot",)] * 300, "c string")
    out = E.value_counts(df, ["c"], k=15).orderBy("rank").collect()
    assert len(out) == 15 and out[0]["value"] == "hot" and out[0]["count"] == 300


def test_nan_is_missing_and_infinities_rank(spark):
    rows = [(float(i), float(i) * 2) for i in range(20)] + [(float("nan"), 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "x double, y double")
    st = {(r["column"], r["stat"]): r["value"] for r in E.numeric_summary(df).collect()}
    assert st[("x", "count")] == 20 and st[("x", "mean")] == 9.5 and st[("x", "50%")] == 9.5 and st[("x", "max")] == 19
    corr = {(r["col1"], r["col2"]): r["corr"] for r in E.correlation_matrix(df).collect()}
    assert corr[("x", "y")] == 1.0 and corr[("x", "x")] == 1.0
    wide = spark.createDataFrame([(v,) for v in [float("-inf"), -1.7e308, 1.0, 2.0, 1.7e308, float("inf"), 3.0]],
                                 "x double")
    assert quantiles(wide, ["x"], [1 / 3, 0.5, 2 / 3], limit=1, sketch_k=8, slack=0.0)["x"] == [1.0, 2.0, 3.0]


def test_kpis_and_signals_cover_all_columns(spark):
    df = spark.range(30).select(*[(F.col("id") * (i + 1)).cast("double").alias(f"c{i}") for i in range(7)])
    labels = [r["label"] for r in I.kpis(df).orderBy("kpi_no").collect()]
    assert len(labels) == 3 + 2 * 7 and labels[-1] == "Max c6"
    assert I.kpis(df, I.KPI_NUMERIC_COLUMNS, I.KPI_CAP).count() == 12
    assert I.signals(df).where("kind = 'collinear'").count() == 21
    assert I.signals(df, 3).where("kind = 'collinear'").count() == 3


def test_insight_context_counts_every_column(spark):
    df = spark.range(12).select("id", F.lit("a").alias("kind"), *[F.col("id").alias(f"c{i}") for i in range(5)])
    text = I.insight_context(df).first()["context"]
    stats = text.split("Statistics:\n")[1].split("\n")
    assert stats == [f"{c} count 12" for c in df.columns] + ["kind unique 1", "kind top a"]


def test_quantiles_stay_exact_with_poor_sketches(spark):
    """Brackets that miss their rank or hold too much are followed up until the rank is settled."""
    rng = np.random.default_rng(11)
    vals = np.concatenate([rng.normal(size=1500), np.zeros(900), [np.inf] * 3, [-np.inf] * 2, [1e300, -1e300]])
    rng.shuffle(vals)
    rows = [(float(v), None if i % 3 else float(i % 7), float("nan") if i % 2 else float(v) * 1e9, None) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(5)
    probs = [0.0, 0.001, 0.25, 0.5, 0.999, 1.0]
    exact = {c: np.sort([r[k] for r in rows if r[k] is not None and r[k] == r[k]]) for k, c in enumerate("abcd")}
    for limit, sketch_k, slack in ((20_000, 2048, 0.003), (20, 8, 0.003), (5, 200, 0.0), (100, 64, 0.02)):
        got = quantiles(df, list("abcd"), probs, limit=limit, sketch_k=sketch_k, slack=slack)
        for c, v in exact.items():
            for p, q in zip(probs, got[c]):
                if not len(v):
                    assert q is None
                    continue
                at = (len(v) - 1) * p
                lo, hi = v[int(np.floor(at))], v[int(np.ceil(at))]
                assert q == (lo if at == int(at) else (np.ceil(at) - at) * lo + (at - np.floor(at)) * hi)


def test_correlations_far_from_zero(spark):
    """Values near 1e9, pairs with few or no common rows, constants, over several tasks."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=2000)
    cols = {"a": 1e9 + x, "b": 1e9 + 0.5 * x + 0.1 * rng.normal(size=2000), "c": np.where(rng.random(2000) < 0.3, np.nan, x ** 2),
            "d": np.full(2000, 7.3), "e": np.full(2000, np.nan), "f": np.where(np.arange(2000) % 2 == 0, np.nan, 5.0),
            "g": np.where(np.arange(2000) % 2 == 0, x, np.nan)}
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in zip(*cols.values())]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(5)
    got = {(r["col1"], r["col2"]): r["corr"] for r in E.correlation_matrix(df, digits=None).collect()}
    assert len(got) == 49
    for a in cols:
        for b in cols:
            both = ~np.isnan(cols[a]) & ~np.isnan(cols[b])
            p, q = cols[a][both], cols[b][both]
            if not len(p) or p.min() == p.max() or q.min() == q.max():
                assert got[a, b] is None
            else:
                p, q = p - p.mean(), q - q.mean()
                assert abs(got[a, b] - (p @ q) / np.sqrt((p @ p) * (q @ q))) < 1e-7
