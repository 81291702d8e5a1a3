"""Edge cases: empty, all-null, one row, constant, negative mean, ties, zero IQR."""

from pyspark.sql import functions as F

from sparkinsight.operators import cleaning as C
from sparkinsight.operators import eda as E
from sparkinsight.operators import profile as V
from sparkinsight.operators import signals as I


def test_empty_frame(spark):
    df = spark.createDataFrame([], "a double, b string")
    r = V.validate(df).first()
    assert (r["n_rows"], r["missing_cells"], r["missing_pct"], r["duplicate_rows"]) == (0, 0, 0.0, 0)
    assert E.numeric_summary(df).where("stat = 'count'").first()["value"] == 0.0
    assert E.categorical_summary(df).first()["top"] == "N/A"


def test_all_null_column_is_constant_and_unknown_mode(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (3.0, None)], "a double, s string")
    assert C.fit_constant_columns(df) == ["s"]
    plan = C.fit_fill(df.withColumn("a", F.when(F.col("a") > 2, None).otherwise(F.col("a"))))
    assert plan.categorical == {"s": "Unknown"} and plan.numeric == {"a": 1.5}


def test_one_row(spark):
    df = spark.createDataFrame([(5.0, "x")], "a double, s string")
    s = {r["stat"]: r["value"] for r in E.numeric_summary(df).collect()}
    assert s["count"] == 1 and s["std"] is None and s["50%"] == 5.0
    assert [r["warning"] for r in V.validation_warnings(V.validate(df)).collect()] == \
        ["Very small dataset — model reliability may be low"]


def test_negative_mean_never_flags_variability(spark):
    df = spark.createDataFrame([(-1.0,), (-100.0,), (-3.0,), (-50.0,)], "x double")
    kinds = [r["kind"] for r in I.signals(df).collect()]
    assert "variability" not in kinds


def test_mode_ties_pick_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "s string")
    assert C.fit_fill(df).categorical == {"s": "a"}
    assert E.categorical_summary(df).first()["top"] == "a"


def test_zero_iqr_caps_minority(spark):
    df = spark.createDataFrame([(0,)] * 9 + [(1,)], "flag int")
    (b,) = C.fit_bounds(df)
    assert (b.lo, b.hi, b.n_outliers) == (0.0, 0.0, 1)
    assert C.cap_outliers(df, [b]).agg(F.max("flag")).first()[0] == 0.0


def test_constant_column_correlation_and_trend(spark):
    df = spark.createDataFrame([(i, 7.0, float(i)) for i in range(12)], "t long, c double, y double")
    m = {(r["col1"], r["col2"]): r["corr"] for r in E.correlation_matrix(df).collect()}
    assert m[("c", "c")] is None and m[("c", "y")] is None and m[("t", "y")] == 1.0
    tr = {r["column"]: r for r in E.detect_trends(df, "t", ["c", "y"]).collect()}
    assert tr["c"]["slope"] == 0.0 and tr["c"]["flagged"] is False
    assert tr["y"]["slope"] == 1.0 and tr["y"]["direction"] == "increasing"


def test_constant_non_representable_value_has_no_correlation(spark):
    df = spark.createDataFrame([(0.1, float(i)) for i in range(50)], "a double, b double")
    m = {(r["col1"], r["col2"]): r["corr"] for r in E.correlation_matrix(df).collect()}
    assert m[("a", "b")] is None and m[("a", "a")] is None and m[("b", "b")] == 1.0


def test_dotted_and_quoted_names_everywhere(spark):
    """Column names and category values with dots, spaces and backticks through clean, eda, profile, signals and features."""
    from sparkinsight.operators import cleaning as C
    from sparkinsight.operators import eda as E
    from sparkinsight.operators import models as M
    from sparkinsight.operators import profile as V
    from sparkinsight.operators import signals as I
    rows = [(float(i % 17) + 0.1 * i if i % 9 else None, ["x.1", "y 2", "z`3"][i % 3] if i % 7 else None, str(i), "k", i) for i in range(60)]
    df = spark.createDataFrame(rows, "`a.b` double, `c.d` string, `e.f` string, `g``h` string, t long")
    out, log = C.clean(df)
    assert out.columns == ["a.b", "e.f", "t", "c.d_y 2", "c.d_z`3"] and log.count() == 4
    dropped, _ = C.clean(df, C.CleanConfig(missing_strategy="drop", outlier_action="drop"))
    assert dropped.count() == 53
    assert {r["column"] for r in E.numeric_summary(out).collect()} == {"a.b", "e.f", "t"}
    assert E.correlation_matrix(out).count() == 9
    assert E.detect_trends(out.withColumnRenamed("t", "t.t"), "t.t").count() == 3
    assert {k: f.count() > 0 for k, f in E.chart_data(out).items()} == {
        "correlation_heatmap": True, "histograms": True, "box_plots": True, "scatter_matrix": True}
    assert [r["cardinality"] for r in V.profile(df).orderBy("position").collect()][1] == 3
    assert V.describe_all(df).where("`column` = 'c.d' AND stat = 'unique'").first()["num_value"] == 3
    assert I.kpis(out).where("label = 'Mean a.b'").count() == 1 and I.signals(out).count() >= 1
    f = M.prepare_features(out, "a.b", passthrough=["t"])
    assert f.names == ["e.f", "c.d_y 2_true", "c.d_z`3_true"] and f.frame.count() == 60
