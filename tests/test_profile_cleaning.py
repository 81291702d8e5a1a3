from pyspark.sql import functions as F

from sparkinsight.operators import cleaning as C
from sparkinsight.operators import profile as V


def test_validate_shape(sample_df):
    r = V.validate(sample_df).first()
    assert r["n_rows"] == 200 and r["n_columns"] == 5
    assert r["missing_cells"] == 0 and r["duplicate_rows"] == 0


def test_validate_dirty(dirty_df):
    r = V.validate(dirty_df).first()
    assert r["missing_cells"] == 2
    assert r["missing_pct"] == 9.52
    assert r["duplicate_rows"] == 0
    w = [x["warning"] for x in V.validation_warnings(V.validate(dirty_df)).collect()]
    assert w == ["Very small dataset — model reliability may be low"]


def test_duplicates_null_safe(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (1.0, None), (1.0, None), (2.0, "b")], "x double, y string")
    assert V.duplicate_count(df).first()["duplicate_rows"] == 2
    assert C.drop_duplicates(df).count() == 3


def test_profile_lists(sample_df):
    p = {r["column"]: r for r in V.profile(sample_df).collect()}
    assert p["dept"]["kind"] == "categorical" and p["dept"]["cardinality"] == 4
    assert p["age"]["kind"] == "numeric"


def test_infer_target(sample_df, spark):
    assert V.infer_target(sample_df) == "score"
    assert V.infer_target(spark.createDataFrame([(1, 2)], "Label int, x int")) == "Label"


def test_constant_columns(spark):
    df = spark.createDataFrame([(1, "x", None, 5), (2, "x", None, None)], "a int, b string, c int, d int")
    assert C.fit_constant_columns(df) == ["b", "c", "d"]


def test_impute_median_and_mode(dirty_df):
    out = C.impute(dirty_df, "auto")
    assert out.where(F.col("A").isNull() | F.col("B").isNull()).count() == 0
    row = out.where(F.col("C") == 30).first()
    assert row["A"] == 4.5 and row["B"] == "cat"


def test_impute_fallthrough_is_median(dirty_df):
    for strategy in ("none", "mode"):
        row = C.impute(dirty_df, strategy).where(F.col("C") == 30).first()
        assert row["A"] == 4.5


def test_impute_drop(dirty_df):
    assert C.impute(dirty_df, "drop").count() == 6


def test_iqr_cap(spark):
    df = spark.createDataFrame([(x,) for x in [1, 2, 3, 4, 5, 1000]], "x bigint")
    (b,) = C.fit_bounds(df)
    assert (b.q1, b.q3, b.lo, b.hi, b.n_outliers) == (2.25, 4.75, -1.5, 8.5, 1)
    capped = C.cap_outliers(df, [b])
    assert capped.agg(F.max("x")).first()[0] == 8.5


def test_zscore_bounds_and_drop_keeps_nulls(spark):
    vals = [float(i) for i in range(1, 21)] + [500.0, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    (b,) = C.fit_bounds(df, method="zscore")
    assert b.hi == 20.0 and b.n_outliers == 1
    out, _ = C.drop_outliers(df, method="iqr")
    assert out.count() == 21 and out.where(F.col("x").isNull()).count() == 1


def test_sequential_drop_uses_remaining_rows(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 3.0), (4.0, 4.0), (100.0, 5.0), (5.0, 1000.0)],
                               "a double, b double")
    out, bounds = C.drop_outliers(df)
    assert [b.n_outliers for b in bounds] == [1, 1]
    assert out.count() == 4


def test_one_hot(dirty_df):
    out = C.one_hot(dirty_df)
    assert out.columns == ["A", "C", "B_cat", "B_dog"]
    null_row = out.where(F.col("C") == 30).first()
    assert null_row["B_cat"] is False and null_row["B_dog"] is False


def test_infer_types(spark):
    df = spark.createDataFrame([("1", "2024-01-05", "x", "1.5"), ("2", "2024-02-01", "y", None)],
                               "a string, d string, s string, f string")
    assert C.fit_types(df) == {"a": "bigint", "d": "timestamp_ntz", "f": "double"}


def test_clean_pipeline(dirty_df):
    out, log = C.clean(dirty_df)
    assert out.where(F.col("A").isNull()).count() == 0
    assert out.agg(F.max("A")).first()[0] < 1000
    steps = [r["step"] for r in log.orderBy("step_no").collect()]
    assert steps[0] == "missing" and "outliers" in steps and steps[-1] == "one_hot"


def test_row_digests_tell_rows_apart(spark):
    """NULLs in other places, signed zeros, NaN, dotted names, rows repeated many times."""
    from sparkinsight.operators import profile as V
    rows = [(None, 1, 0.0, "x"), (1, None, 0.0, "x"), (None, 1, -0.0, "x"), (2, 2, float("nan"), None), (2, 2, float("nan"), None)]
    rows += [(7, 7, 1.5, "hot")] * 40 + [(i, -i, float(i), str(i)) for i in range(50, 90)]
    df = spark.createDataFrame(rows, "`a.b` int, b int, c double, d string")
    want = len(rows) - df.distinct().count()
    assert V.duplicate_count(df).first()[0] == want
    v = V.validate(df).first()
    assert (v["n_rows"], v["n_columns"], v["missing_cells"], v["duplicate_rows"]) == (len(rows), 4, 5, want)
    m = V.table_metrics(df)
    assert tuple(m.first())[:3] == (len(rows), 4, 5)
    assert "hashpartitioning" not in m._jdf.queryExecution().toString()
    empty = V.validate(df.limit(0)).first()
    assert tuple(empty) == (0, 4, 0, 0.0, 0)
    assert V.select_columns(df, ["d", "a.b"]).columns == ["d", "a.b"]
