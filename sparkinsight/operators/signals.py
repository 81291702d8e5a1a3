"""KPIs and root-cause signals (I1-I6), each from one global aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import number
from ..schema import columns_of, named
from .eda import correlation_matrix

# KPI and signal thresholds; the short report shows 5 columns, 12 KPIs, 3 pairs.
KPI_NUMERIC_COLUMNS = 5
KPI_CAP = 12
CV_THRESHOLD = 1.0
MISSING_THRESHOLD = 20.0
COLLINEAR_THRESHOLD = 0.85
COLLINEAR_SHOWN = 3
EPS = 1e-9
NO_SIGNALS = "No strong root-cause signals detected."


def kpis(df: DataFrame, numeric_columns: int | None = None, top: int | None = None) -> DataFrame:
    """(kpi_no, label, value, delta): rows, columns, missing %, then Mean/Max of every
    numeric column.  A short report passes how many columns and rows to show."""
    num = columns_of(df, "numeric")[:numeric_columns]
    cells = sum((F.count_if(named(c).isNull()) for c in df.columns), F.lit(0))
    aggs = [F.count(F.lit(1)).alias("rows"), cells.alias("missing")]
    for i, c in enumerate(num):
        aggs += [F.avg(number(c)).alias(f"a{i}"), F.stddev_samp(number(c)).alias(f"s{i}"),
                 F.max(number(c)).alias(f"m{i}")]
    w = df.agg(*aggs)
    ncols = len(df.columns)
    pct = F.round(F.col("missing") / F.greatest(F.col("rows") * ncols, F.lit(1)) * 100, 1)
    items = [
        F.struct(F.lit("Total Rows").alias("label"), F.format_number(F.col("rows"), 0).alias("value"),
                 F.lit("").alias("delta")),
        F.struct(F.lit("Total Columns").alias("label"), F.lit(str(ncols)).alias("value"), F.lit("").alias("delta")),
        F.struct(F.lit("Missing Data %").alias("label"), F.concat(pct.cast("string"), F.lit("%")).alias("value"),
                 F.lit("").alias("delta")),
    ]
    for i, c in enumerate(num):
        items.append(F.struct(F.lit(f"Mean {c}").alias("label"),
                              F.format_string("%.2f", F.col(f"a{i}")).alias("value"),
                              F.format_string("std %.2f", F.col(f"s{i}")).alias("delta")))
        items.append(F.struct(F.lit(f"Max {c}").alias("label"),
                              F.format_string("%.2f", F.col(f"m{i}")).alias("value"), F.lit("").alias("delta")))
    items = items[:top]
    return w.select(F.posexplode(F.array(*items)).alias("pos", "k")).select(
        (F.col("pos") + 1).cast("bigint").alias("kpi_no"), "k.label", "k.value", "k.delta")


def signals(df: DataFrame, pairs: int | None = None) -> DataFrame:
    """(signal_no, kind, signal): variability and missing-data signals per numeric
    column in column order, then the collinear pairs in column order (all of them, or
    the first ``pairs``); one fallback row when nothing fires."""
    num = columns_of(df, "numeric")
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(num):
        aggs += [F.avg(number(c)).alias(f"a{i}"), F.stddev_samp(number(c)).alias(f"s{i}"),
                 F.count_if(number(c).isNull()).alias(f"n{i}")]
    w = df.agg(*aggs)
    items = []
    for i, c in enumerate(num):
        cv = F.col(f"s{i}") / (F.col(f"a{i}") + EPS)
        miss = F.col(f"n{i}") / F.col("rows") * 100
        items.append(F.when(cv > CV_THRESHOLD, F.struct(
            F.lit(i * 2).alias("o"), F.lit("variability").alias("kind"),
            F.format_string("**%s** has very high variability (CV=%.2f) — investigate outliers", F.lit(c), cv).alias("signal"))))
        items.append(F.when(miss > MISSING_THRESHOLD, F.struct(
            F.lit(i * 2 + 1).alias("o"), F.lit("missing").alias("kind"),
            F.format_string("**%s** has %.1f%% missing — data quality concern", F.lit(c), miss).alias("signal"))))
    per_col = w.select(F.explode(F.filter(F.array(*items), lambda s: s.isNotNull())).alias("s")).select("s.*") \
        if items else None
    base = 2 * len(num)
    collinear = None
    if len(num) >= 2:
        m = correlation_matrix(df, num, digits=None).where((F.col("i") < F.col("j")) & (F.abs("corr") > COLLINEAR_THRESHOLD))
        m = m if pairs is None else m.orderBy("i", "j").limit(pairs)
        collinear = m.select(
            (F.lit(base) + F.col("i") * len(num) + F.col("j")).alias("o"), F.lit("collinear").alias("kind"),
            F.format_string("**%s** and **%s** are highly correlated (%.2f) — potential multicollinearity",
                            "col1", "col2", F.abs("corr")).alias("signal"))
    frames = [f for f in (per_col, collinear) if f is not None]
    spark = df.sparkSession
    allsig = frames[0] if frames else spark.createDataFrame([], "o int, kind string, signal string")
    for f in frames[1:]:
        allsig = allsig.unionByName(f)
    fallback = spark.range(1).select(F.lit(-1).alias("o"), F.lit("none").alias("kind"),
                                     F.lit(NO_SIGNALS).alias("signal"))
    # rows grow with columns and pairs of columns, never with the table: a global window is fine here
    out = allsig.unionByName(fallback).withColumn(
        "n_real", F.sum(F.when(F.col("o") >= 0, 1).otherwise(0)).over(Window.partitionBy()))
    out = out.where((F.col("o") >= 0) | (F.col("n_real") == 0))
    return out.select(F.row_number().over(Window.orderBy("o")).cast("bigint").alias("signal_no"), "kind", "signal")


def insight_context(df: DataFrame, model_line: str | None = None, note: str | None = None, stats_limit: int | None = None,
                    kpi_columns: int | None = KPI_NUMERIC_COLUMNS, kpi_rows: int | None = KPI_CAP,
                    pairs: int | None = COLLINEAR_SHOWN) -> DataFrame:
    """Prompt frame (I6): KPI bullets, signals, the count / unique / top rows of the
    description over all columns, an optional model line and user note.  A prompt is short, so
    by default the KPIs cover the first columns and the first collinear pairs are named
    (None: all); ``stats_limit`` cuts the description to that many characters on request.
    Built from the small KPI / signal / description frames only, and without the driver."""
    from .profile import describe_all
    k = kpis(df, kpi_columns, kpi_rows).select(F.lit(0).alias("part"), F.col("kpi_no").alias("no"), F.concat(
        F.lit("- "), "label", F.lit(": "), "value", F.when(F.col("delta") != "", F.concat(F.lit(" ("), "delta", F.lit(")"))).otherwise("")).alias("line"))
    s = signals(df, pairs).select(F.lit(1).alias("part"), F.col("signal_no").alias("no"), F.concat(F.lit("- "), "signal").alias("line"))
    stats = {st: i for i, st in enumerate(("count", "unique", "top"))}
    place = {c: i for i, c in enumerate(df.columns)}
    at = lambda table, c: F.element_at(F.create_map(*[x for n, i in table.items() for x in (F.lit(n), F.lit(i))]), F.col(c))
    value = F.coalesce("str_value", F.col("num_value").cast("bigint").cast("string"))
    d = describe_all(df).where(F.col("stat").isin(*stats) & value.isNotNull()).select(
        F.lit(2).alias("part"), (at(stats, "stat") * len(place) + at(place, "column")).cast("bigint").alias("no"),
        F.concat_ws(" ", "column", "stat", value).alias("line"))
    # a few rows per column
    lines = k.unionByName(s).unionByName(d).agg(F.array_sort(F.collect_list(F.struct("part", "no", "line"))).alias("all"))
    block = lambda n: F.array_join(F.transform(F.filter("all", lambda x: x["part"] == n), lambda x: x["line"]), "\n")
    described = block(2) if stats_limit is None else F.substring(block(2), 1, stats_limit)
    tail = (f"\n\nModel: {model_line}" if model_line else "") + (f"\n\nNote: {note}" if note else "")
    return lines.select(F.concat(F.lit("KPIs:\n"), block(0), F.lit("\n\nSignals:\n"), block(1), F.lit("\n\nStatistics:\n"), described,
                                 F.lit(tail)).alias("context"))
