"""Validation, profiling and inspection.

Repeated rows are found by a grouping of row digests (partial aggregation on the map
side, so even a row repeated across a third of the table collapses before the
shuffle); rows are compared themselves only where digests repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import number, quantiles
from ..schema import columns_of, dtype_name, kind_of, named

# Warning thresholds (strict comparisons).
MISSING_PCT_WARN = 30
MIN_ROWS_WARN = 10
TARGET_NAMES = ("target", "label", "y", "class", "output")


def _digest(df: DataFrame) -> list[Column]:
    """128 bits of a row, as two numbers; equal rows (NULL equals NULL) have equal bits."""
    zero = lambda c: F.when(named(c) == 0, F.lit(0.0)).otherwise(named(c))  # noqa: E731 - 0.0 and -0.0 are one value
    vals = [zero(f.name) if f.dataType.typeName() in ("double", "float") else named(f.name) for f in df.schema.fields]
    # columns' places are mixed in, as a NULL leaves a hash as it was
    marks = [F.when(named(c).isNull(), F.lit(i + 1)).otherwise(F.lit(0)) for i, c in enumerate(df.columns)]
    return [F.xxhash64(*vals, *marks).alias("__h1"), F.xxhash64(F.lit("second"), *marks, *reversed(vals)).alias("__h2")]


def row_counts(df: DataFrame) -> DataFrame:
    """One row: n_rows, missing_cells, duplicate_rows.

    Rows are grouped by a digest, so 16 bytes of a row and two counts are shuffled; rows
    themselves are compared only where digests repeat.
    """
    nulls = sum((named(c).isNull().cast("bigint") for c in df.columns), F.lit(0).cast("bigint"))
    digests = (df.select(*_digest(df), nulls.alias("__nulls")).groupBy("__h1", "__h2")
               .agg(F.count(F.lit(1)).alias("__n"), F.sum("__nulls").alias("__nulls")))
    total = digests.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("__nulls"), F.lit(0)).alias("missing_cells"))
    again = digests.where(F.col("__n") > 1).select("__h1", "__h2")
    suspects = df.select(*[named(c) for c in df.columns], *_digest(df)).join(again, ["__h1", "__h2"], "left_semi")
    groups = suspects.groupBy(*[named(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__n"))
    repeats = groups.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_rows"))
    return total.join(F.broadcast(repeats)).select(*[F.col(c).cast("bigint").alias(c) for c in ("n_rows", "missing_cells", "duplicate_rows")])


def _missing_pct(n_columns: int) -> Column:
    cells = F.greatest(F.col("n_rows") * F.lit(n_columns), F.lit(1))
    return F.round(F.col("missing_cells") / cells * 100, 2).alias("missing_pct")


def validate(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing_cells, missing_pct (2 dp), duplicate_rows."""
    return row_counts(df).select("n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_columns"), "missing_cells",
                                 _missing_pct(len(df.columns)), "duplicate_rows")


def validation_report(df: DataFrame) -> DataFrame:
    """The whole report as (item_no, item, value): the counts of ``validate``, the memory and every column's dtype."""
    v = validate(df).join(F.broadcast(memory_estimate_mb(df)))
    heads = ["n_rows", "n_columns", "missing_cells", "missing_pct", "duplicate_rows", "memory_mb"]
    cells = [F.struct(F.lit(c).alias("item"), F.col(c).cast("string").alias("value")) for c in heads]
    cells += [F.struct(F.lit(f"dtype {f.name}").alias("item"), F.lit(dtype_name(f.dataType)).alias("value")) for f in df.schema.fields]
    return v.select(F.posexplode(F.array(*cells)).alias("p", "c")).select((F.col("p") + 1).cast("bigint").alias("item_no"), "c.*")


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row (NULL equals NULL)."""
    return row_counts(df).select("duplicate_rows")


def warning_array():
    """array<string> of the warnings that apply to a ``validate`` row (fixed order)."""
    pct = F.col("missing_pct").cast("string")
    w = F.array(
        F.when(F.col("missing_pct") > MISSING_PCT_WARN, F.concat(F.lit("High missing data: "), pct, F.lit("%"))),
        F.when(F.col("duplicate_rows") > 0,
               F.concat(F.col("duplicate_rows").cast("string"), F.lit(" duplicate rows detected"))),
        F.when(F.col("n_rows") < MIN_ROWS_WARN, F.lit("Very small dataset — model reliability may be low")),
    )
    return F.filter(w, lambda x: x.isNotNull())


def validation_warnings(report: DataFrame) -> DataFrame:
    """Warning lines from a ``validate`` row, in the fixed order."""
    return (report.select(F.posexplode(warning_array()).alias("pos", "warning"))
            .select((F.col("pos") + 1).cast("bigint").alias("warning_no"), "warning"))


def ingestion_summary(report: DataFrame, file_name: str) -> DataFrame:
    """Message lines of the ingestion answer (one row per line)."""
    warn = validation_warnings(report)
    head = report.select(F.array(
        F.lit(f"File {file_name} ingested successfully."),
        F.concat(F.lit("- Rows: "), F.col("n_rows").cast("string")),
        F.concat(F.lit("- Columns: "), F.col("n_columns").cast("string")),
        F.concat(F.lit("- Missing cells: "), F.col("missing_cells").cast("string"),
                 F.lit(" ("), F.col("missing_pct").cast("string"), F.lit("%)")),
        F.concat(F.lit("- Duplicates: "), F.col("duplicate_rows").cast("string")),
    ).alias("lines")).select(F.posexplode("lines").alias("pos", "line"))
    head = head.select((F.col("pos") + 1).cast("bigint").alias("line_no"), "line")
    warn_title = warn.where(F.col("warning_no") == 1).select(
        F.lit(6).cast("bigint").alias("line_no"), F.lit("Warnings:").alias("line"))
    warn_lines = warn.select((F.col("warning_no") + 6).cast("bigint").alias("line_no"),
                             F.concat(F.lit("- "), F.col("warning")).alias("line"))
    return head.unionByName(warn_title).unionByName(warn_lines)


def profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """Per column: kind, nulls, cardinality (distinct non-null values)."""
    cd = F.approx_count_distinct if approx else F.count_distinct
    aggs = []
    for i, c in enumerate(df.columns):
        aggs += [F.count_if(named(c).isNull()).alias(f"n{i}"), cd(named(c)).alias(f"d{i}")]
    wide = df.agg(*aggs)
    stack = F.array(*[
        F.struct(F.lit(i).cast("bigint").alias("position"), F.lit(c).alias("column"),
                 F.lit(kind_of(df.schema[c].dataType)).alias("kind"),
                 F.col(f"n{i}").cast("bigint").alias("nulls"), F.col(f"d{i}").cast("bigint").alias("cardinality"))
        for i, c in enumerate(df.columns)])
    return wide.select(F.inline(stack))


def column_sheet(df: DataFrame) -> DataFrame:
    """(Column, Type, Nulls, Unique) sheet with pandas-style dtype names."""
    p = profile(df)
    types = F.create_map(*[x for c in df.columns for x in (F.lit(c), F.lit(dtype_name(df.schema[c].dataType)))])
    return p.select(F.col("position"), F.col("column").alias("Column"),
                    F.element_at(types, F.col("column")).alias("Type"),
                    F.col("nulls").alias("Nulls"), F.col("cardinality").alias("Unique"))


def describe_all(df: DataFrame, probs=(0.25, 0.5, 0.75)) -> DataFrame:
    """``describe(include='all')`` in long form: (column, stat, num_value, str_value).

    Numeric columns: count, mean, std, min, 25%, 50%, 75%, max (exact quantiles).
    String/boolean columns: count, unique, top (most frequent, smallest on tie), freq.
    """
    spark = df.sparkSession
    num = columns_of(df, "numeric")
    cat = columns_of(df, "categorical", "boolean")
    rows: list[tuple] = []
    if num:
        m = df.agg(*[e for i, c in enumerate(num) for e in (
            F.count(number(c)).alias(f"c{i}"), F.avg(number(c)).alias(f"a{i}"),
            F.stddev_samp(number(c)).alias(f"s{i}"), F.min(number(c)).alias(f"mn{i}"),
            F.max(number(c)).alias(f"mx{i}"))]).first()
        q = quantiles(df, num, list(probs))
        for i, c in enumerate(num):
            stats = [("count", float(m[f"c{i}"])), ("mean", m[f"a{i}"]), ("std", m[f"s{i}"]), ("min", m[f"mn{i}"])]
            stats += [(f"{int(p * 100)}%", v) for p, v in zip(probs, q[c])]
            stats += [("max", m[f"mx{i}"])]
            rows += [(c, s, None if v is None else float(v), None) for s, v in stats]
    if cat:
        cat_df = categorical_top(df, cat)
        for r in cat_df.collect():  # one small row per categorical column
            rows += [(r["column"], "count", float(r["count"]), None),
                     (r["column"], "unique", float(r["unique"]), None),
                     (r["column"], "top", None, r["top"]),
                     (r["column"], "freq", None if r["freq"] is None else float(r["freq"]), None)]
    return spark.createDataFrame(rows, "column string, stat string, num_value double, str_value string")


def categorical_top(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per column: count, unique, top (most frequent non-null, smallest on tie), freq.

    One distributed ``groupBy(column index, value)`` count over an exploded
    (index, value) pair per cell; map-side partial aggregation bounds the shuffle
    by the number of distinct values, whatever the skew.
    """
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), named(c).cast("string").alias("v")) for i, c in enumerate(cols)])
    counts = (df.select(F.inline(pairs)).where(F.col("v").isNotNull())
              .groupBy("i", "v").agg(F.count(F.lit(1)).alias("n")))
    per = counts.groupBy("i").agg(
        F.sum("n").cast("bigint").alias("count"), F.count(F.lit(1)).cast("bigint").alias("unique"),
        F.min_by(F.struct(F.col("v"), F.col("n")),
                 F.struct((-F.col("n")).alias("k1"), F.col("v").alias("k2"))).alias("best"))
    names = F.array(*[F.lit(c) for c in cols])
    base = df.sparkSession.range(len(cols)).select(F.col("id").cast("int").alias("i"))
    return (base.join(per, "i", "left").select(
        F.element_at(names, F.col("i") + 1).alias("column"),
        F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
        F.coalesce("unique", F.lit(0)).cast("bigint").alias("unique"),
        F.coalesce(F.col("best.v"), F.lit("N/A")).alias("top"),
        F.col("best.n").cast("bigint").alias("freq")))


def table_metrics(df: DataFrame) -> DataFrame:
    """Header numbers: rows, columns, missing cells (V7); sums of one scan, nothing is grouped."""
    nulls = sum((named(c).isNull().cast("bigint") for c in df.columns), F.lit(0).cast("bigint"))
    n = df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(nulls), F.lit(0)).alias("missing_cells"))
    return n.select("n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_columns"), "missing_cells", _missing_pct(len(df.columns)))


def memory_estimate_mb(df: DataFrame) -> DataFrame:
    """Size of the values: UTF-8 bytes of texts, one byte a boolean, eight any other value, none for NULL
    (not the pandas figure, which counts Python objects)."""
    def size(f):
        x, kind = named(f.name), kind_of(f.dataType)
        n = F.octet_length(x.cast("string")) if kind in ("categorical", "other") else F.lit(1 if kind == "boolean" else 8)
        return F.when(x.isNotNull(), n.cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    total = sum((size(f) for f in df.schema.fields), F.lit(0).cast("bigint"))
    return df.agg(F.round(F.coalesce(F.sum(total), F.lit(0)) / 1e6, 3).alias("memory_mb"))


def preview(df: DataFrame, order_by: list[str] | str, n: int = 20) -> DataFrame:
    """First ``n`` rows in an explicit order (a top-k, planned as TakeOrderedAndProject)."""
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    return df.orderBy(*keys).limit(n)


def infer_target(df: DataFrame) -> str:
    """First column named target/label/y/class/output (any case), else the last column."""
    for c in df.columns:
        if c.lower() in TARGET_NAMES:
            return c
    return df.columns[-1]


def select_columns(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """The given columns in their order, or all of them."""
    return df if not cols else df.select(*[named(c) for c in cols])
