"""Sequence work (N3-N7): min-max scaling, lag windows, chronological split,
one-step-ahead validation and recursive forecasts.

``make_sequences`` range-partitions rows on (series, order) so a long series is
split over many tasks like any other; each slice only needs the ``n`` rows before
it, which reach it by a join.  No series is ever gathered whole in one task, and the
models of all series are fitted at once from sums of products.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import ordered_slices, row_positions
from ..session import materialize, ship_package

# Sequence defaults.
WINDOW = 10
TRAIN_FRACTION = 0.8
HORIZON = 6


@dataclass(frozen=True)
class MinMax:
    lo: float
    hi: float

    def scale(self, c):
        span = self.hi - self.lo
        return (c - F.lit(self.lo)) / F.lit(span if span else 1.0)

    def inverse(self, c):
        return c * F.lit(self.hi - self.lo) + F.lit(self.lo)


def fit_minmax(df: DataFrame, col: str) -> MinMax:
    r = df.agg(F.min(F.col(col).cast("double")).alias("a"), F.max(F.col(col).cast("double")).alias("b")).first()
    return MinMax(r["a"], r["b"])


def minmax_scale(df: DataFrame, col: str, out: str = "scaled", mm: MinMax | None = None) -> DataFrame:
    mm = mm or fit_minmax(df, col)
    return df.withColumn(out, mm.scale(F.col(col).cast("double")))


def _lag_names(n):
    return [f"x_{i}" for i in range(1, n + 1)]


def make_sequences(df: DataFrame, value: str, order_by: str, series: list[str] | None = None,
                   n: int = WINDOW, partitions: int | None = None) -> DataFrame:
    """Every length-``n`` window of each series and its next value:
    (series..., order_by, x_1 .. x_n, y) with x_1 the oldest value.

    Rows without a value are left out first.  The rows lie in range slices of (series,
    order); the ``n`` rows before a slice travel to it as rows of a join on its start, from
    as many earlier slices as they lie in.  Within a slice the windows are ``lag``s,
    and a window counts when its oldest row belongs to the same series.
    """
    series = list(series or [])
    known = (df.select(*series, order_by, F.col(value).cast("double").alias("__y"))
             .where(F.col("__y").isNotNull() & ~F.isnan("__y")))
    placed, starts = ordered_slices(known, [*series, order_by], partitions)
    # only the last n rows of a slice can stand before the start of a later one
    ends = starts.select("__slice", (F.col("__start") + F.col("__rows")).alias("__end"))
    tail = placed.join(F.broadcast(ends), "__slice").where(F.col("__at") >= F.col("__end") - n)
    reach = tail.withColumn("__start", F.explode(F.sequence(F.col("__at") + 1, F.col("__at") + n))).drop("__slice", "__end")
    halo = reach.join(F.broadcast(starts.select("__slice", "__start")), "__start").drop("__start")
    both = placed.withColumn("__own", F.lit(True)).unionByName(halo.withColumn("__own", F.lit(False)))
    w = Window.partitionBy("__slice").orderBy("__at")
    lags = [F.lag("__y", n + 1 - i).over(w).alias(f"x_{i}") for i in range(1, n + 1)]
    same = F.lag(F.lit(True), n).over(w)
    for c in series:
        same = same & F.lag(F.col(c), n).over(w).eqNullSafe(F.col(c))
    rows = both.select(*series, order_by, "__own", *lags, F.col("__y").alias("y"), same.alias("__same"))
    return rows.where(F.col("__own") & F.coalesce("__same", F.lit(False))).drop("__own", "__same")


def chronological_split(seqs: DataFrame, order_by: str, series: list[str] | None = None,
                        frac: float = TRAIN_FRACTION) -> DataFrame:
    """Adds ``is_train``: the first floor(frac * count) windows of each series.

    Exact in-series positions come from range slices plus offsets, so a long series
    (an unkeyed one is a single series) is spread over many tasks.
    """
    series = list(series or [])
    pos = row_positions(seqs, series, [order_by], out="__pos", total="__cnt")
    return pos.withColumn("is_train", F.col("__pos") < F.floor(F.col("__cnt") * frac)).drop("__pos", "__cnt")


def daily_series(lineitem: DataFrame) -> DataFrame:
    """Daily revenue per return flag: (l_returnflag, day, revenue)."""
    return (lineitem.groupBy("l_returnflag", F.to_date("l_shipdate").alias("day"))
            .agg(F.sum("l_extendedprice").alias("revenue")))


def _scaled_series(df: DataFrame, value: str, order_by: str, series: list[str]) -> tuple[DataFrame, DataFrame]:
    """The known rows with the value min-max scaled within its series, and (series..., lo, span)."""
    known = (df.select(*series, order_by, F.col(value).cast("double").alias("__v"))
             .where(F.col("__v").isNotNull() & ~F.isnan("__v")))
    ends = known.groupBy(*series).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    span = F.when(F.col("__hi") > F.col("__lo"), F.col("__hi") - F.col("__lo")).otherwise(1.0)
    ends = ends.select(*series, "__lo", span.alias("__span"))
    rows = _with_series(known, ends, series)
    return rows.select(*series, order_by, ((F.col("__v") - F.col("__lo")) / F.col("__span")).alias(value)), ends


def _with_series(rows: DataFrame, table: DataFrame, series: list[str]) -> DataFrame:
    """``rows`` with the columns of ``table`` (one row per series; a NULL key is a series of its own)."""
    if not series:
        return rows.join(F.broadcast(table))  # one row
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in series]
    extra = [F.col(f"b.{c}") for c in table.columns if c not in series]
    return rows.alias("a").join(table.alias("b"), same).select("a.*", *extra)


def _solve(n: int, keys: int):
    """Least squares from the sums of products: per row (series) the intercept and ``n`` weights."""
    def run(batches):
        for pdf in batches:
            out = []
            for sums in pdf["__sums"]:
                m = np.zeros((n + 2, n + 2))
                m[np.triu_indices(n + 2)] = np.asarray(sums, dtype="float64")
                m = m + np.triu(m, 1).T
                # the shortest solution where windows do not settle the weights
                out.append(np.linalg.lstsq(m[:n + 1, :n + 1], m[:n + 1, n + 1], rcond=1e-12)[0].tolist())
            yield pdf.iloc[:, :keys].assign(__weights=out)
    return run


def fit_lag_model(windows: DataFrame, series: list[str], n: int) -> DataFrame:
    """(series..., __weights): intercept and weights of x_1 .. x_n by least squares, one model per series.

    The normal equations are sums of products over the windows, added in tasks before the
    shuffle, so a series of any length is one row of (n+2)(n+3)/2 sums.
    """
    ship_package(windows.sparkSession)
    terms = [F.lit(1.0), *[F.col(c) for c in _lag_names(n)], F.col("y")]
    products = [F.sum(terms[i] * terms[j]) for i in range(n + 2) for j in range(i, n + 2)]
    sums = windows.groupBy(*series).agg(*[p.alias(f"__s{k}") for k, p in enumerate(products)])
    rows = sums.select(*series, F.array(*[f"__s{k}" for k in range(len(products))]).alias("__sums")).where(
        F.col("__sums")[0].isNotNull())
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in windows.select(*series).schema.fields)
    return rows.mapInPandas(_solve(n, len(series)), ", ".join(x for x in (keys, "__weights array<double>") if x))


def _predicted(weights, lags):
    """Intercept plus the weighted sum of an array of n lagged values."""
    return F.aggregate(F.zip_with(F.slice(weights, 2, F.size(lags)), lags, lambda w, x: w * x), F.get(weights, F.lit(0)),
                       lambda acc, x: acc + x)


def forecast_validation(series_df: DataFrame, value: str, order_by: str, series: list[str] | None = None,
                        n: int = WINDOW, frac: float = TRAIN_FRACTION) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One-step-ahead validation of a lag model per series on its last 20 % of windows.

    Returns (models, predictions, metrics): weights by series; (series..., order, actual,
    predicted) and rmse and r2 by series, in the original units (each series is min-max scaled
    for the fit).  Rows without a value are left out first.
    """
    series = list(series or [])
    scaled, ends = _scaled_series(series_df, value, order_by, series)
    seqs = chronological_split(make_sequences(scaled, value, order_by, series, n), order_by, series, frac)
    models = materialize(_with_series(fit_lag_model(seqs.where("is_train"), series, n), ends, series))
    test = _with_series(seqs.where(~F.col("is_train")), models, series)
    back = lambda x: x * F.col("__span") + F.col("__lo")
    pred = test.select(*series, order_by, back(F.col("y")).alias("actual"),
                       back(_predicted(F.col("__weights"), F.array(*_lag_names(n)))).alias("predicted"))
    err = F.col("actual") - F.col("predicted")
    m = pred.groupBy(*series).agg(F.avg(err * err).alias("mse"), F.sum(err * err).alias("ssr"),
                                  (F.var_pop("actual") * F.count("actual")).alias("sst"))
    metrics = m.select(*series, F.round(F.sqrt("mse"), 4).alias("rmse"),
                       F.round(1 - F.try_divide(F.col("ssr"), F.when(F.col("sst") != 0, F.col("sst"))), 4).alias("r2"))
    return models, pred, metrics


def forecast(series_df: DataFrame, value: str, order_by: str, series: list[str] | None = None,
             horizon: int = HORIZON, n: int = WINDOW, frac: float = TRAIN_FRACTION) -> DataFrame:
    """Recursive ``horizon``-step forecast per series from its lag model: (series..., step, forecast).

    Of each series only its last ``n`` values are gathered (a top-k per key); each step
    appends its own forecast to them.  Series of fewer than ``n`` values have none.
    """
    series = list(series or [])
    models, _pred, _metrics = forecast_validation(series_df, value, order_by, series, n, frac)
    scaled, _ends = _scaled_series(series_df, value, order_by, series)
    w = Window.partitionBy(*series).orderBy(F.col(order_by).desc())
    last = scaled.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n)
    listed = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("__rn")).alias("r"), F.col(value).alias("v")))), lambda s: s["v"])
    tails = last.groupBy(*series).agg(listed.alias("__last")).where(F.size("__last") == n)
    known = _with_series(tails, models, series)
    grown = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.col("__last"), lambda acc, _k: F.concat(
        acc, F.array(_predicted(F.col("__weights"), F.slice(acc, -n, n)))))
    ahead = F.transform(F.slice(grown, n + 1, horizon), lambda x: x * F.col("__span") + F.col("__lo"))
    return known.select(*series, F.posexplode(ahead).alias("step", "forecast")).withColumn("step", F.col("step") + 1)
