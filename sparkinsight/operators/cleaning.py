"""Cleaning (C1-C13): constant columns, duplicates, type inference, imputation,
outliers, one-hot encoding, and the composed pipeline with its change log.

Each learning step is split into ``fit_*`` (one aggregation, returns a few
numbers) and ``apply_*`` (a pure projection or filter), so the fitted values can
be applied to new data and every apply step stays inside whole-stage codegen.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import quantiles
from ..functions.text import INTEGER_TEXT, NUMERIC_TEXT, fits, integer_type, parse_datetime
from ..schema import columns_of, kind_of, named
from ..session import materialize

# Cleaning defaults.
IQR_FACTOR = 1.5
ZSCORE_THRESHOLD = 3.0
ONE_HOT_MAX_CARDINALITY = 15
UNKNOWN = "Unknown"


# --------------------------------------------------------------------------- C1
def fit_constant_columns(df: DataFrame) -> list[str]:
    """Columns with at most one distinct non-null value (all-null included)."""
    orderable = [c for c in df.columns if kind_of(df.schema[c].dataType) != "other"]
    if not orderable:
        return []
    row = df.agg(*[(F.min(named(c)) != F.max(named(c))).alias(f"v{i}") for i, c in enumerate(orderable)]).first()
    return [c for i, c in enumerate(orderable) if not row[f"v{i}"]]


def drop_constant_columns(df: DataFrame, constant: list[str] | None = None) -> DataFrame:
    constant = fit_constant_columns(df) if constant is None else constant
    return df.drop(*constant)


# --------------------------------------------------------------------------- C2
def drop_duplicates(df: DataFrame) -> DataFrame:
    """Full-row de-duplication (NULL equals NULL)."""
    return df.dropDuplicates()


# --------------------------------------------------------------------------- C3
def fit_types(df: DataFrame) -> dict[str, str]:
    """Target type per string column: 'bigint', 'double', 'timestamp_ntz' (all-or-nothing)."""
    cols = columns_of(df, "categorical")
    if not cols:
        return {}
    aggs = []
    for i, c in enumerate(cols):
        x = named(c)
        aggs += [F.count(x).alias(f"n{i}"),
                 F.count_if(x.rlike(NUMERIC_TEXT)).alias(f"num{i}"),
                 F.count_if(x.rlike(INTEGER_TEXT)).alias(f"int{i}"), *fits(c, i),
                 F.count_if(parse_datetime(x).isNotNull()).alias(f"dt{i}")]
    row = df.agg(*aggs).first()
    out = {}
    for i, c in enumerate(cols):
        n = row[f"n{i}"]
        if row[f"num{i}"] == n:
            whole = n > 0 and row[f"int{i}"] == n
            kind = integer_type(row, i) if whole else "double"
            if kind:
                out[c] = kind
        elif row[f"dt{i}"] == n:
            out[c] = "timestamp_ntz"
    return out


def apply_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    def conv(c):
        t = types[c]
        if t == "timestamp_ntz":
            return parse_datetime(named(c)).alias(c)
        return F.trim(named(c)).try_cast(t).alias(c)
    return df.select(*[conv(c) if c in types else named(c) for c in df.columns])


def infer_types(df: DataFrame) -> DataFrame:
    return apply_types(df, fit_types(df))


# ------------------------------------------------------------------------ C4/C5
@dataclass
class FillPlan:
    numeric: dict[str, float] = field(default_factory=dict)
    categorical: dict[str, str] = field(default_factory=dict)
    drop_subset: list[str] = field(default_factory=list)
    total_missing: int = 0


def _null_counts(df: DataFrame) -> dict[str, int]:
    row = df.agg(*[F.count_if(named(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)]).first()
    return {c: row[f"m{i}"] for i, c in enumerate(df.columns)}


def fit_fill(df: DataFrame, strategy: str = "auto") -> FillPlan:
    """Fill values: numeric median (``auto``/``median``/any unknown value), mean, or
    row drop (``drop``); string columns always take their mode (smallest on tie),
    ``Unknown`` when the column has no value.  Modes are fitted after the drop."""
    nulls = _null_counts(df)
    plan = FillPlan(total_missing=int(sum(nulls.values())))
    if not plan.total_missing:
        return plan
    num = [c for c in columns_of(df, "numeric") if nulls[c]]
    if strategy == "drop":
        plan.drop_subset = num
        df = _present(df, num)
    elif num:
        if strategy == "mean":
            row = df.agg(*[F.avg(named(c)).alias(f"f{i}") for i, c in enumerate(num)]).first()
            plan.numeric = {c: row[f"f{i}"] for i, c in enumerate(num)}
        else:
            q = quantiles(df, num, [0.5])
            plan.numeric = {c: q[c][0] for c in num}
    cat = [c for c in columns_of(df, "categorical") if nulls[c]]
    if cat:
        # distributed mode: counts per (column, value), then the best value per column
        from .profile import categorical_top
        tops = {r["column"]: (r["top"] if r["freq"] is not None else UNKNOWN)
                for r in categorical_top(df, cat).collect()}  # one row per column
        plan.categorical = {c: tops[c] for c in cat}
    return plan


def _present(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows with a value in each of the columns."""
    for c in cols:
        df = df.where(named(c).isNotNull())
    return df


def apply_fill(df: DataFrame, plan: FillPlan) -> DataFrame:
    if plan.drop_subset:
        df = _present(df, plan.drop_subset)
    out = []
    for c in df.columns:
        if c in plan.numeric and plan.numeric[c] is not None:
            out.append(F.coalesce(named(c).cast("double"), F.lit(float(plan.numeric[c]))).alias(c))
        elif c in plan.categorical:
            out.append(F.coalesce(named(c), F.lit(plan.categorical[c])).alias(c))
        else:
            out.append(named(c))
    return df.select(*out)


def impute(df: DataFrame, strategy: str = "auto") -> DataFrame:
    return apply_fill(df, fit_fill(df, strategy))


# ------------------------------------------------------------------------ C6-C9
@dataclass
class Bounds:
    column: str
    lo: float | None
    hi: float | None
    q1: float | None = None
    q3: float | None = None
    n_outliers: int = 0


def _outlier_mask(c: str, lo, hi):
    x = named(c)
    parts = []
    if lo is not None:
        parts.append(x < F.lit(lo))
    if hi is not None:
        parts.append(x > F.lit(hi))
    if not parts:
        return F.lit(False)
    m = parts[0]
    for p in parts[1:]:
        m = m | p
    return F.coalesce(m, F.lit(False))


def fit_bounds(df: DataFrame, cols: list[str] | None = None, method: str = "iqr",
               k: float = IQR_FACTOR, t: float = ZSCORE_THRESHOLD, count: bool = True) -> list[Bounds]:
    """Per numeric column: IQR fences or the z-score range (population std, |z| < t)."""
    cols = columns_of(df, "numeric") if cols is None else cols
    if not cols:
        return []
    out = []
    if method == "iqr":
        q = quantiles(df, cols, [0.25, 0.75])
        for c in cols:
            q1, q3 = q[c]
            if q1 is None:
                out.append(Bounds(c, None, None))
                continue
            iqr = q3 - q1
            out.append(Bounds(c, q1 - k * iqr, q3 + k * iqr, q1, q3))
    else:
        m = df.agg(*[e for i, c in enumerate(cols) for e in
                     (F.avg(named(c)).alias(f"a{i}"), F.stddev_pop(named(c)).alias(f"s{i}"))]).first()
        aggs = []
        for i, c in enumerate(cols):
            mu, sd = m[f"a{i}"], m[f"s{i}"]
            if mu is None or not sd:
                aggs += [F.lit(None).cast("double").alias(f"lo{i}"), F.lit(None).cast("double").alias(f"hi{i}")]
                continue
            inside = F.when(F.abs((named(c) - F.lit(mu)) / F.lit(sd)) < t, named(c).cast("double"))
            aggs += [F.min(inside).alias(f"lo{i}"), F.max(inside).alias(f"hi{i}")]
        row = df.agg(*aggs).first()
        out = [Bounds(c, row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(cols)]
    if count:
        row = df.agg(*[F.count_if(_outlier_mask(b.column, b.lo, b.hi)).alias(f"n{i}")
                       for i, b in enumerate(out)]).first()
        for i, b in enumerate(out):
            b.n_outliers = int(row[f"n{i}"])
    return out


def cap_outliers(df: DataFrame, bounds: list[Bounds]) -> DataFrame:
    """Clip flagged columns to their bounds; NULL stays NULL; others untouched."""
    by = {b.column: b for b in bounds if b.n_outliers}
    out = []
    for c in df.columns:
        if c in by:
            b, x = by[c], named(c).cast("double")
            e = x
            if b.lo is not None:
                e = F.when(x < F.lit(b.lo), F.lit(b.lo)).otherwise(e)
            if b.hi is not None:
                e = F.when(x > F.lit(b.hi), F.lit(b.hi)).otherwise(e)
            out.append(e.alias(c))
        else:
            out.append(named(c))
    return df.select(*out)


def drop_outliers(df: DataFrame, cols: list[str] | None = None, method: str = "iqr",
                  k: float = IQR_FACTOR, t: float = ZSCORE_THRESHOLD) -> tuple[DataFrame, list[Bounds]]:
    """Drop outlier rows column after column: the bounds of each column are fitted
    on the rows left by the previous ones; rows with NULL in the column stay."""
    cols = columns_of(df, "numeric") if cols is None else cols
    fitted = []
    for c in cols:
        (b,) = fit_bounds(df, [c], method, k, t)
        fitted.append(b)
        if b.n_outliers:
            df = df.where(~_outlier_mask(c, b.lo, b.hi))
    return df, fitted


def handle_outliers(df: DataFrame, method: str = "iqr", action: str = "cap",
                    k: float = IQR_FACTOR, t: float = ZSCORE_THRESHOLD) -> tuple[DataFrame, int]:
    """C8/C9/C10 dispatch; returns the frame and the number of flagged values."""
    if method == "none" or action == "none":
        return df, 0
    if action == "drop":
        df, b = drop_outliers(df, None, method, k, t)
    else:
        b = fit_bounds(df, None, method, k, t)
        if action == "cap":
            df = cap_outliers(df, b)
    return df, sum(x.n_outliers for x in b)


# -------------------------------------------------------------------------- C11
def fit_categories(df: DataFrame, max_card: int = ONE_HOT_MAX_CARDINALITY) -> dict[str, list[str]]:
    """Sorted categories of string columns with at most ``max_card`` distinct values.

    A HyperLogLog pass first rules out wide columns, so the exact set is only
    ever collected for columns whose cardinality is known to be small.
    """
    cols = columns_of(df, "categorical")
    if not cols:
        return {}
    approx = df.agg(*[F.approx_count_distinct(named(c)).alias(f"a{i}") for i, c in enumerate(cols)]).first()
    narrow = [c for i, c in enumerate(cols) if approx[f"a{i}"] <= 2 * max_card + 2]
    if not narrow:
        return {}
    row = df.agg(*[F.sort_array(F.collect_set(named(c))).alias(f"s{i}") for i, c in enumerate(narrow)]).first()
    return {c: list(row[f"s{i}"]) for i, c in enumerate(narrow) if len(row[f"s{i}"]) <= max_card}


def one_hot(df: DataFrame, categories: dict[str, list[str]] | None = None,
            drop_first: bool = True, max_card: int = ONE_HOT_MAX_CARDINALITY) -> DataFrame:
    """Boolean indicator columns ``col_value`` appended at the end; sources removed."""
    categories = fit_categories(df, max_card) if categories is None else categories
    keep = [named(c) for c in df.columns if c not in categories]
    dummies = []
    for c, values in categories.items():
        for v in (values[1:] if drop_first else values):
            dummies.append(F.coalesce(named(c) == F.lit(v), F.lit(False)).alias(f"{c}_{v}"))
    return df.select(*keep, *dummies)


# ---------------------------------------------------------------------- C12/C13
@dataclass
class CleanConfig:
    missing_strategy: str = "auto"
    outlier_method: str = "iqr"
    outlier_action: str = "cap"
    iqr_factor: float = IQR_FACTOR
    zscore_thresh: float = ZSCORE_THRESHOLD
    encode_categoricals: bool = True
    checkpoint: bool = True


def clean(df: DataFrame, cfg: CleanConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """The composed cleaning pipeline; returns (clean frame, change log frame).

    Order: constant columns, duplicates, types, missing, outliers, one-hot.
    One shuffle groups identical rows (it both removes and counts repeats) and is
    written once to the checkpoint folder; a single aggregation over it then
    decides constant columns, duplicate count, type conversions, null counts and
    column widths.  Later fits (medians, modes, IQR fences, categories) are one
    pass each over the de-duplicated table.
    """
    cfg = cfg or CleanConfig()
    spark = df.sparkSession
    log: list[tuple] = []
    cols = df.columns
    grouped = df.groupBy(*[named(c) for c in cols]).agg(F.count(F.lit(1)).alias("__n"))
    if cfg.checkpoint:
        grouped = materialize(grouped)

    kinds = {c: kind_of(df.schema[c].dataType) for c in cols}
    strs = [c for c in cols if kinds[c] == "categorical"]
    aggs = [F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("__dups"), F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(cols):
        x = named(c)
        aggs += [F.count_if(x.isNull()).alias(f"null{i}"), F.count(x).alias(f"n{i}")]
        if kinds[c] != "other":
            aggs.append((F.min(x) != F.max(x)).alias(f"v{i}"))
        if kinds[c] == "categorical":
            aggs += [*fits(c, i), F.count_if(x.rlike(NUMERIC_TEXT)).alias(f"num{i}"), F.count_if(x.rlike(INTEGER_TEXT)).alias(f"int{i}"),
                     F.count_if(parse_datetime(x).isNotNull()).alias(f"dt{i}"),
                     F.approx_count_distinct(x).alias(f"a{i}")]
    st = grouped.agg(*aggs).first()
    idx = {c: i for i, c in enumerate(cols)}

    const = [c for c in cols if kinds[c] != "other" and not st[f"v{idx[c]}"]]
    if const:
        log.append(("constant_columns", len(const), f"Dropped {len(const)} constant column(s)"))
    dups = int(st["__dups"])
    if dups:
        log.append(("duplicates", dups, f"Removed {dups} duplicate rows"))
    df = grouped.drop("__n", *const)
    kept = df.columns

    types = {}
    for c in strs:
        if c in const:
            continue
        i, n = idx[c], st[f"n{idx[c]}"]
        if st[f"num{i}"] == n:
            whole = n > 0 and st[f"int{i}"] == n
            kind = integer_type(st, i) if whole else "double"
            if kind:
                types[c] = kind
        elif st[f"dt{i}"] == n:
            types[c] = "timestamp_ntz"
    df = apply_types(df, types)
    if types:
        log.append(("types", len(types), f"Auto-converted types for {len(types)} column(s)"))

    total_missing = int(sum(st[f"null{idx[c]}"] for c in kept))
    strategy = cfg.missing_strategy
    rows_known = True
    plan = FillPlan()
    if total_missing:
        if strategy in ("drop", "mean"):
            plan = fit_fill(df, strategy)
            rows_known = strategy != "drop"
        else:
            plan = FillPlan(total_missing=total_missing)
            num = [c for c in columns_of(df, "numeric") if st[f"null{idx[c]}"]]
            if num:
                q = quantiles(df, num, [0.5])
                plan.numeric = {c: q[c][0] for c in num}
            cat = [c for c in columns_of(df, "categorical") if st[f"null{idx[c]}"]]
            if cat:
                from .profile import categorical_top
                tops = {r["column"]: (r["top"] if r["freq"] is not None else UNKNOWN)
                        for r in categorical_top(df, cat).collect()}  # one row per column
                plan.categorical = {c: tops[c] for c in cat}
        df = apply_fill(df, plan)
        log.append(("missing", total_missing, f"Imputed {total_missing} missing value(s)"))

    if cfg.outlier_method == "iqr" and cfg.outlier_action == "cap" and rows_known:
        num = columns_of(df, "numeric")
        q = quantiles(df, num, [0.25, 0.75]) if num else {}
        bounds = []
        for c in num:
            q1, q3 = q[c]
            if q1 is None:
                bounds.append(Bounds(c, None, None))
            else:
                bounds.append(Bounds(c, q1 - cfg.iqr_factor * (q3 - q1), q3 + cfg.iqr_factor * (q3 - q1), q1, q3))
        if bounds:
            row = df.agg(*[F.count_if(_outlier_mask(b.column, b.lo, b.hi)).alias(f"n{i}")
                           for i, b in enumerate(bounds)]).first()
            for i, b in enumerate(bounds):
                b.n_outliers = int(row[f"n{i}"])
        df = cap_outliers(df, bounds)
        flagged = sum(b.n_outliers for b in bounds)
    else:
        df, flagged = handle_outliers(df, cfg.outlier_method, cfg.outlier_action, cfg.iqr_factor, cfg.zscore_thresh)
    if flagged:
        log.append(("outliers", flagged, f"Outlier handling ({cfg.outlier_action}): {flagged} value(s)"))

    if cfg.encode_categoricals:
        cand = [c for c in columns_of(df, "categorical")]
        narrow = [c for c in cand if c in idx and st[f"a{idx[c]}"] + 1 <= 2 * ONE_HOT_MAX_CARDINALITY + 2]
        cats = {}
        if narrow:
            row = df.agg(*[F.sort_array(F.collect_set(named(c))).alias(f"s{i}") for i, c in enumerate(narrow)]).first()
            cats = {c: list(row[f"s{i}"]) for i, c in enumerate(narrow)
                    if len(row[f"s{i}"]) <= ONE_HOT_MAX_CARDINALITY}
        if cats:
            df = one_hot(df, cats)
            log.append(("one_hot", len(cats), f"One-hot encoded {len(cats)} categorical column(s)"))

    log_df = spark.createDataFrame(
        [(i + 1, s, n, m) for i, (s, n, m) in enumerate(log)],
        "step_no int, step string, n bigint, message string")
    return df, log_df
