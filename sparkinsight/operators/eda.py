"""Exploratory statistics (E1-E13): summaries, correlations, trends and chart data.

Whole-table statistics are single global aggregations (partial aggregation on
every task, one tiny final merge).  Per-column value tables use one ``groupBy``
over exploded (column, value) pairs.  Top-k per column uses ``row_number() <= k``
which Spark plans with a map-side WindowGroupLimit, so no column's full value
list ever reaches one task.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import number, quantiles
from ..schema import columns_of, dtype_name, named
from ..session import ship_package
from .profile import categorical_top

# EDA defaults.
TREND_MIN_POINTS = 10
TREND_PCT = 5.0
TOP_PAIRS = 10
HIST_BINS = 20
VALUE_COUNTS_K = 15
EPS = 1e-9
SUMMARY_STATS = ("count", "mean", "std", "min", "25%", "50%", "75%", "max")


# ------------------------------------------------------------------ E1-E3
def numeric_summary(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Long (column, stat, value) with count, mean, std, min, quartiles, max (4 dp)."""
    spark = df.sparkSession
    cols = columns_of(df, "numeric") if cols is None else cols
    rows = []
    if cols:
        m = df.agg(*[e for i, c in enumerate(cols) for e in (
            F.count(number(c)).alias(f"c{i}"), F.avg(number(c)).alias(f"a{i}"),
            F.stddev_samp(number(c)).alias(f"s{i}"), F.min(number(c)).alias(f"mn{i}"),
            F.max(number(c)).alias(f"mx{i}"))]).first()
        q = quantiles(df, cols, [0.25, 0.5, 0.75])
        for i, c in enumerate(cols):
            vals = [m[f"c{i}"], m[f"a{i}"], m[f"s{i}"], m[f"mn{i}"], *q[c], m[f"mx{i}"]]
            rows += [(i, c, s, None if v is None else float(v)) for s, v in zip(SUMMARY_STATS, vals)]
    out = spark.createDataFrame(rows, "position int, column string, stat string, value double")
    return out.select("position", "column", "stat", F.round("value", 4).alias("value"))


def categorical_summary(df: DataFrame) -> DataFrame:
    """(column, unique, top) for string and boolean columns; top is ``N/A`` when empty."""
    cols = columns_of(df, "categorical", "boolean")
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, unique bigint, top string")
    return categorical_top(df, cols).select("column", "unique", "top")


def missing_by_column(df: DataFrame) -> DataFrame:
    """(position, column, missing, dtype) plus the shape in every row."""
    aggs = [F.count_if(named(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)]
    wide = df.agg(F.count(F.lit(1)).alias("__rows"), *aggs)
    stack = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                               F.col(f"m{i}").cast("bigint").alias("missing"),
                               F.lit(dtype_name(df.schema[c].dataType)).alias("dtype"))
                      for i, c in enumerate(df.columns)])
    return wide.select(F.col("__rows").cast("bigint").alias("n_rows"),
                       F.lit(len(df.columns)).cast("bigint").alias("n_columns"), F.inline(stack))


def dtypes(df: DataFrame) -> dict[str, str]:
    return {c: dtype_name(df.schema[c].dataType) for c in df.columns}


# ------------------------------------------------------------------ E4/E5
def _merged(a: dict, b: dict) -> dict:
    """Moments of two sets of rows together: counts, means and centred (co-)moments of every pair."""
    n = a["n"] + b["n"]
    share = np.divide(a["n"] * b["n"], n, out=np.zeros_like(n), where=n > 0)
    part = np.divide(b["n"], n, out=np.zeros_like(n), where=n > 0)
    da, db = b["ma"] - a["ma"], b["mb"] - a["mb"]
    return {"n": n, "ma": a["ma"] + da * part, "mb": a["mb"] + db * part, "caa": a["caa"] + b["caa"] + da * da * share,
            "cbb": a["cbb"] + b["cbb"] + db * db * share, "cab": a["cab"] + b["cab"] + da * db * share,
            "lo": np.fmin(a["lo"], b["lo"]), "hi": np.fmax(a["hi"], b["hi"])}


def _moments(x: np.ndarray) -> dict:
    """Moments of column i over the rows where column j is present as well, for every pair (i, j)."""
    there = ~np.isnan(x)
    m = there.astype("float64")
    # near the middle of each column, so products of far-off values cannot swamp their differences
    mid = np.nanmean(np.where(there.any(axis=0), x, 0.0), axis=0)
    y = np.where(there, x - mid, 0.0)
    n = m.T @ m
    over = np.divide(1.0, n, out=np.zeros_like(n), where=n > 0)
    sa, sb = y.T @ m, m.T @ y
    lo, hi = (np.stack([f.reduce(np.where(there & there[:, [j]], x, np.nan), axis=0) for j in range(x.shape[1])], axis=1)
              for f in (np.fmin, np.fmax))
    return {"n": n, "ma": mid[:, None] + sa * over, "mb": mid[None, :] + sb * over, "caa": (y * y).T @ m - sa * sa * over,
            "cbb": m.T @ (y * y) - sb * sb * over, "cab": y.T @ y - sa * sb * over, "lo": lo, "hi": hi}


def _comoment_partials(k: int):
    """Per task: the merged pairwise-complete moments of its Arrow batches, one row per pair i <= j."""
    def run(it):
        acc = None
        for pdf in it:
            if len(pdf):
                x = pdf.to_numpy(dtype="float64")
                one = _moments(x)
                acc = one if acc is None else _merged(acc, one)
        if acc is None:
            return
        ii, jj = np.triu_indices(k)
        out = {"i": ii.astype("int32"), "j": jj.astype("int32"), **{c: acc[c][ii, jj] for c in ("n", "ma", "mb", "caa", "cbb", "cab")}}
        for c, own in (("lo", "a"), ("hi", "a")):
            out[f"{c}_{own}"], out[f"{c}_b"] = acc[c][ii, jj], acc[c][jj, ii]
        yield pd.DataFrame(out)
    return run


def correlation_matrix(df: DataFrame, cols: list[str] | None = None, digits: int | None = 4) -> DataFrame:
    """Pearson matrix in long form (i, j, col1, col2, corr), pairwise-complete, 4 dp.

    One scan: each task folds its Arrow batches into counts, means and centred co-moments
    per pair of columns (rows where both values are present) and sends k(k+1)/2 small
    rows; those are merged about the common mean.  A side whose least and largest value over
    the pair's rows are equal is constant: NULL.  Diagonal is 1 (NULL for a constant
    column); empty below two numeric columns.
    """
    cols = columns_of(df, "numeric") if cols is None else cols
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "i int, j int, col1 string, col2 string, corr double")
    ship_package(df.sparkSession)
    src = df.select(*[number(c).alias(f"c{i}") for i, c in enumerate(cols)])
    parts = src.mapInPandas(_comoment_partials(len(cols)), "i int, j int, " + ", ".join(f"{c} double" for c in (
        "n", "ma", "mb", "caa", "cbb", "cab", "lo_a", "lo_b", "hi_a", "hi_b")))
    # one row per (task, pair): the common means first, then the moments about them
    w = Window.partitionBy("i", "j")
    mean = lambda c: F.try_divide(F.sum(F.col("n") * F.col(c)).over(w), F.sum("n").over(w))
    da, db = F.col("ma") - F.col("all_a"), F.col("mb") - F.col("all_b")
    g = (parts.where(F.col("n") > 0).withColumn("all_a", mean("ma")).withColumn("all_b", mean("mb")).groupBy("i", "j").agg(
        F.sum(F.col("caa") + F.col("n") * da * da).alias("va"), F.sum(F.col("cbb") + F.col("n") * db * db).alias("vb"),
        F.sum(F.col("cab") + F.col("n") * da * db).alias("cov"), F.min("lo_a").alias("lo_a"), F.max("hi_a").alias("hi_a"),
        F.min("lo_b").alias("lo_b"), F.max("hi_b").alias("hi_b")))
    # pairs that no row has both values of are listed as well
    pairs = df.sparkSession.range(len(cols) * len(cols)).select(
        F.floor(F.col("id") / len(cols)).cast("int").alias("i"), (F.col("id") % len(cols)).cast("int").alias("j")).where("i <= j")
    g = pairs.join(F.broadcast(g), ["i", "j"], "left")  # at most one row per pair of columns
    varies = (F.col("lo_a") < F.col("hi_a")) & (F.col("lo_b") < F.col("hi_b")) & (F.col("va") > 0) & (F.col("vb") > 0)
    raw = F.col("cov") / (F.sqrt("va") * F.sqrt("vb"))
    # rounding noise beyond [-1, 1] is clamped
    r = F.when(varies, F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw))))
    r = F.round(r, digits) if digits is not None else r
    names = F.array(*[F.lit(c) for c in cols])
    half = g.select("i", "j", r.alias("corr"))
    mirror = half.where(F.col("i") != F.col("j")).select(F.col("j").alias("i"), F.col("i").alias("j"), "corr")
    return half.unionByName(mirror).select(
        "i", "j", F.element_at(names, F.col("i") + 1).alias("col1"), F.element_at(names, F.col("j") + 1).alias("col2"),
        "corr")


def top_correlations(df: DataFrame, k: int = TOP_PAIRS, cols: list[str] | None = None) -> DataFrame:
    """Pairs i<j by |corr| descending (ties keep column order), first ``k``."""
    m = correlation_matrix(df, cols).where(F.col("i") < F.col("j"))
    return (m.orderBy(F.abs("corr").desc_nulls_last(), "i", "j").limit(k)
            .select("col1", "col2", "corr"))


# ----------------------------------------------------------------------- E6
def _trend_partials(cols: list[str]):
    """Per task: ordered batches folded into (n, mean_y, centred co-moment) per column."""
    def run(it):
        from pyspark import TaskContext
        pid = TaskContext.get().partitionId()
        acc = {c: [0, 0.0, 0.0, 0.0] for c in cols}  # n, mean_x, mean_y, C
        for pdf in it:
            for c in cols:
                y = pd.to_numeric(pdf[c], errors="coerce").dropna().to_numpy(dtype="float64")
                nb = len(y)
                if nb == 0:
                    continue
                n, mx, my, cc = acc[c]
                x = np.arange(n, n + nb, dtype="float64")
                mxb, myb = x.mean(), y.mean()
                cb = float(((x - mxb) * (y - myb)).sum())
                tot = n + nb
                cc = cc + cb + (mxb - mx) * (myb - my) * n * nb / tot
                acc[c] = [tot, (n * mx + nb * mxb) / tot, (n * my + nb * myb) / tot, cc]
        rows = [(pid, c, a[0], a[2], a[3]) for c, a in acc.items() if a[0]]
        yield pd.DataFrame(rows, columns=["pid", "column", "n", "mean_y", "cxy"])
    return run


def detect_trends(df: DataFrame, order_by: str, cols: list[str] | None = None,
                  partitions: int | None = None) -> DataFrame:
    """Per numeric column: OLS slope of the non-null values against their position.

    Rows are range-partitioned and sorted on ``order_by``; each task folds its
    ordered Arrow batches into (count, mean, centred co-moment) per column, so its
    memory is one batch; partition offsets and
    the between-slice terms are merged with a tiny window over those rows, so
    no task ever sees more than its own slice.  pct = |slope| / (mean + 1e-9) * 100,
    flagged when the column has at least 10 values and pct > 5.
    """
    spark = df.sparkSession
    ship_package(spark)
    cols = [c for c in (columns_of(df, "numeric") if cols is None else cols)]
    n_parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    val_cols = [f"v{i}" for i in range(len(cols))]
    src = df.select(named(order_by).alias("__order"), *[named(c).cast("double").alias(v) for c, v in zip(cols, val_cols)])
    parts = (src.repartitionByRange(n_parts, "__order").sortWithinPartitions("__order")
             .mapInPandas(_trend_partials(val_cols),
                          "pid int, column string, n bigint, mean_y double, cxy double"))
    # one row per (task, column): offsets and totals are windows over that small table
    w = Window.partitionBy("column").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("column")
    j = (parts.withColumn("offset", F.coalesce(F.sum("n").over(w), F.lit(0)))
         .withColumn("tot_n", F.sum("n").over(whole))
         .withColumn("tot_y", F.sum(F.col("n") * F.col("mean_y")).over(whole) / F.col("tot_n")))
    mx_local = (F.col("n") - 1) / 2.0
    between = (F.col("n") * (F.col("offset") + mx_local - (F.col("tot_n") - 1) / 2.0)
               * (F.col("mean_y") - F.col("tot_y")))
    agg = j.groupBy("column").agg(F.first("tot_n").alias("n_all"), F.first("tot_y").alias("mean"),
                                  F.sum(F.col("cxy") + between).alias("cxy"))
    n_all = F.col("n_all").cast("double")  # its cube passes 64 bits from about two million rows
    sxx = n_all * (n_all * n_all - 1) / 12.0
    names = F.create_map(*[x for c, v in zip(cols, val_cols) for x in (F.lit(v), F.lit(c))])
    pos = F.create_map(*[x for i, v in enumerate(val_cols) for x in (F.lit(v), F.lit(i))])
    res = agg.where(F.col("n_all") >= TREND_MIN_POINTS).select(
        F.element_at(pos, F.col("column")).alias("position"),
        F.element_at(names, F.col("column")).alias("column"), F.col("n_all").cast("bigint").alias("n"),
        (F.col("cxy") / sxx).alias("slope"), F.col("mean"))
    res = res.withColumn("pct", F.abs("slope") / (F.col("mean") + EPS) * 100)
    flagged = F.col("pct") > TREND_PCT
    direction = F.when(F.col("slope") > 0, "increasing").otherwise("decreasing")
    return res.select(
        "position", "column", "n", F.round("slope", 4).alias("slope"), F.round("pct", 4).alias("pct"),
        flagged.alias("flagged"), F.when(flagged, direction).alias("direction"),
        F.when(flagged, F.format_string("**%s** shows a %s trend (slope=%.4f)", F.col("column"), direction,
                                        F.col("slope"))).alias("message"))


# ------------------------------------------------------------------ E7-E10
def histogram(df: DataFrame, cols: list[str] | None = None, bins: int = HIST_BINS) -> DataFrame:
    """Equal-width bins over [min, max] of each numeric column (or of ``cols``)."""
    cols = columns_of(df, "numeric") if cols is None else cols
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, bin int, lo double, hi double, count bigint")
    mm = df.agg(*[e for i, c in enumerate(cols) for e in
                  (F.min(named(c).cast("double")).alias(f"a{i}"), F.max(named(c).cast("double")).alias(f"b{i}"))]).first()
    cells = []
    for i, c in enumerate(cols):
        lo, hi = mm[f"a{i}"], mm[f"b{i}"]
        if lo is None:
            continue
        width = (hi - lo) / bins if hi > lo else 0.0
        x = named(c).cast("double")
        b = F.lit(0) if width == 0 else F.least(F.floor((x - F.lit(lo)) / F.lit(hi - lo) * bins), F.lit(bins - 1))
        cells.append(F.when(x.isNotNull(), F.struct(F.lit(i).alias("i"), b.cast("int").alias("bin"),
                                                     F.lit(lo).alias("lo0"), F.lit(width).alias("w"))))
    names = F.array(*[F.lit(c) for c in cols])
    pairs = df.select(F.explode(F.filter(F.array(*cells), lambda s: s.isNotNull())).alias("s")).select("s.*")
    g = pairs.groupBy("i", "bin", "lo0", "w").agg(F.count(F.lit(1)).alias("count"))
    return g.select(F.element_at(names, F.col("i") + 1).alias("column"), "bin",
                    F.round(F.col("lo0") + F.col("bin") * F.col("w"), 4).alias("lo"),
                    F.round(F.col("lo0") + (F.col("bin") + 1) * F.col("w"), 4).alias("hi"), "count")


def box_stats(df: DataFrame, cols: list[str] | None = None, k: float = 1.5) -> DataFrame:
    """Quartiles, whiskers (extreme values inside the 1.5 IQR fences) and outlier counts."""
    spark = df.sparkSession
    cols = columns_of(df, "numeric") if cols is None else cols
    q = quantiles(df, cols, [0.25, 0.5, 0.75])
    aggs = []
    for i, c in enumerate(cols):
        q1, _med, q3 = q[c]
        if q1 is None:
            aggs += [F.lit(None).cast("double").alias(f"l{i}"), F.lit(None).cast("double").alias(f"u{i}"),
                     F.lit(0).alias(f"o{i}")]
            continue
        lo, hi = q1 - k * (q3 - q1), q3 + k * (q3 - q1)
        x = number(c)
        aggs += [F.min(F.when(x >= lo, x)).alias(f"l{i}"), F.max(F.when(x <= hi, x)).alias(f"u{i}"),
                 F.count_if((x < lo) | (x > hi)).alias(f"o{i}")]
    row = df.agg(*aggs).first() if aggs else None
    rows = [(i, c, *q[c], row[f"l{i}"], row[f"u{i}"], int(row[f"o{i}"])) for i, c in enumerate(cols)]
    out = spark.createDataFrame(rows, "position int, column string, q1 double, median double, q3 double, "
                                      "lower_whisker double, upper_whisker double, n_outliers bigint")
    return out.select("position", "column", *[F.round(c, 4).alias(c) for c in
                                              ("q1", "median", "q3", "lower_whisker", "upper_whisker")],
                      "n_outliers")


def value_counts(df: DataFrame, cols: list[str] | None = None, k: int = VALUE_COUNTS_K) -> DataFrame:
    """Top ``k`` non-null values per column (count desc, value asc); all string columns or ``cols``."""
    cols = columns_of(df, "categorical") if cols is None else cols
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), named(c).cast("string").alias("value")) for c in cols])
    counts = (df.select(F.inline(pairs)).where(F.col("value").isNotNull())
              .groupBy("column", "value").agg(F.count(F.lit(1)).alias("count")))
    w = Window.partitionBy("column").orderBy(F.col("count").desc(), F.col("value"))
    return (counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("column", F.col("rank").cast("bigint").alias("rank"), "value", "count"))


def scatter_frame(df: DataFrame, fraction: float = 1.0, seed: int = 42, key: str | None = None,
                  cols: list[str] | None = None) -> DataFrame:
    """Points of the numeric columns, or of ``cols`` (when there are at least 3).

    ``fraction < 1`` keeps a hash-deterministic subset (``xxhash64`` of ``key``):
    independent of partitioning, so reruns and retried tasks draw the same rows.
    """
    num = columns_of(df, "numeric") if cols is None else cols
    if len(num) < 3:
        return df.select(*[named(c) for c in num]).limit(0)
    out = df.select(*[named(c) for c in num])
    if fraction < 1.0:
        buckets = 1_000_000
        h = F.pmod(F.xxhash64(named(key or num[0]), F.lit(seed)), F.lit(buckets))
        out = out.where(h < int(fraction * buckets))
    return out


def chart_data(df: DataFrame) -> dict[str, DataFrame]:
    """Lazy frames behind the standard charts."""
    num, cat = columns_of(df, "numeric"), columns_of(df, "categorical")
    frames: dict[str, DataFrame] = {}
    if len(num) >= 2:
        frames["correlation_heatmap"] = correlation_matrix(df)
    if num:
        frames["histograms"] = histogram(df)
        frames["box_plots"] = box_stats(df)
    if cat:
        frames["value_counts"] = value_counts(df)
    if len(num) >= 3:
        frames["scatter_matrix"] = scatter_frame(df)
    return frames


# ------------------------------------------------------------------ E12/E13
def eda(df: DataFrame, order_by: str) -> dict[str, DataFrame]:
    """Summary, correlation and trend frames of one input."""
    return {
        "numeric_summary": numeric_summary(df),
        "categorical_summary": categorical_summary(df),
        "missing": missing_by_column(df),
        "correlation": correlation_matrix(df),
        "top_pairs": top_correlations(df),
        "trends": detect_trends(df, order_by),
    }


def summary_context(df: DataFrame, order_by: str, limit: int | None = None) -> DataFrame:
    """Prompt frame: JSON of the summary (cut to ``limit`` chars if given), then trend lines."""
    spark = df.sparkSession
    stats: dict = {}
    for r in numeric_summary(df).collect():
        stats.setdefault(r["column"], {})[r["stat"]] = r["value"]
    cats = {r["column"]: {"unique": r["unique"], "top": r["top"]} for r in categorical_summary(df).collect()}
    miss = missing_by_column(df).collect()
    summary = {"shape": [miss[0]["n_rows"] if miss else 0, len(df.columns)], "numeric_stats": stats,
               "categorical": cats, "missing": {r["column"]: r["missing"] for r in miss}, "dtypes": dtypes(df)}
    trends = [r["message"] for r in detect_trends(df, order_by).orderBy("position").collect() if r["message"]]
    text = f"Dataset summary:\n{json.dumps(summary, default=str)[:limit]}\n\nTrends:\n" + "\n".join(trends)
    return spark.createDataFrame([(text,)], "context string")
