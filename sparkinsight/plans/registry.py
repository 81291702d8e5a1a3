"""Query registry: one Spark query per operator family and its DuckDB oracle SQL.

Every query reads the driver tables (or frames Spark derives from them) in
full.  Floating statistics are rounded to 4 decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cleaning as C
from ..operators import profile as V
from ..session import materialize
from .fixtures import DIRTY_ORDERS_SQL, EVENTS_V2_SQL, dirty_orders, events_v2, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def with_dirty(body: str, *extra: str) -> str:
    ctes = ",\n".join([DIRTY_ORDERS_SQL, *extra])
    return f"WITH {ctes}\n{body}"


DIRTY_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority",
              "const_col", "o_size_txt", "o_date_txt", "o_rare"]


def _sum_nulls(cols) -> str:
    return " + ".join(f"CAST({c} IS NULL AS BIGINT)" for c in cols)


# ----------------------------------------------------------------- validation
@register("validate_orders", with_dirty(f"""
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST({len(DIRTY_COLS)} AS BIGINT) AS n_columns,
  CAST(sum({_sum_nulls(DIRTY_COLS)}) AS BIGINT) AS missing_cells,
  round(sum({_sum_nulls(DIRTY_COLS)}) / greatest(count(*) * {len(DIRTY_COLS)}, 1) * 100, 2) AS missing_pct,
  CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_orders)) AS BIGINT) AS duplicate_rows
FROM dirty_orders"""))
def q_validate(spark, sf):
    return V.validate(dirty_orders(spark, sf))


_DIRTY_BYTES = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN {'strlen(' + c + ')' if t else 8} ELSE 0 END" for c, t in [
    ("o_orderkey", 0), ("o_custkey", 0), ("o_orderstatus", 1), ("o_totalprice", 0), ("o_orderpriority", 1), ("const_col", 1),
    ("o_size_txt", 1), ("o_date_txt", 1), ("o_rare", 0)])
_DIRTY_DTYPES = {"o_orderkey": "int64", "o_custkey": "int64", "o_totalprice": "float64", "o_rare": "float64"}


@register("validation_report", f"WITH r AS ({ORACLE['validate_orders']}),\nd AS (" + with_dirty(
    f"SELECT round(sum({_DIRTY_BYTES}) / 1e6, 3) AS memory_mb FROM dirty_orders") + ")\n" + "\nUNION ALL\n".join(
    f"SELECT CAST({i + 1} AS BIGINT) AS item_no, '{c}' AS item, CAST({c} AS VARCHAR) AS value FROM {'d' if c == 'memory_mb' else 'r'}"
    for i, c in enumerate(["n_rows", "n_columns", "missing_cells", "missing_pct", "duplicate_rows", "memory_mb"])) + "".join(
    f"\nUNION ALL SELECT {i + 7}, 'dtype {c}', '{_DIRTY_DTYPES.get(c, 'object')}'" for i, c in enumerate(DIRTY_COLS)))
def q_validation_report(spark, sf):
    return V.validation_report(dirty_orders(spark, sf))


@register("table_metrics", with_dirty(f"""
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST({len(DIRTY_COLS)} AS BIGINT) AS n_columns,
  CAST(sum({_sum_nulls(DIRTY_COLS)}) AS BIGINT) AS missing_cells,
  round(sum({_sum_nulls(DIRTY_COLS)}) / greatest(count(*) * {len(DIRTY_COLS)}, 1) * 100, 2) AS missing_pct FROM dirty_orders"""))
def q_table_metrics(spark, sf):
    return V.table_metrics(dirty_orders(spark, sf))


@register("duplicate_count", with_dirty(
    "SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_orders)) AS BIGINT) "
    "AS duplicate_rows FROM dirty_orders"))
def q_dup(spark, sf):
    return V.duplicate_count(dirty_orders(spark, sf))


_REPORT_SQL = f"""report AS (
  SELECT count(*) AS n_rows, {len(DIRTY_COLS)} AS n_columns, sum({_sum_nulls(DIRTY_COLS)}) AS missing_cells,
    round(sum({_sum_nulls(DIRTY_COLS)}) / greatest(count(*) * {len(DIRTY_COLS)}, 1) * 100, 2) AS missing_pct,
    count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_orders)) AS duplicate_rows
  FROM dirty_orders),
warns AS (
  SELECT 1 AS k, CASE WHEN missing_pct > 30 THEN 'High missing data: ' || CAST(missing_pct AS VARCHAR) || '%' END AS w FROM report
  UNION ALL SELECT 2, CASE WHEN duplicate_rows > 0 THEN CAST(duplicate_rows AS VARCHAR) || ' duplicate rows detected' END FROM report
  UNION ALL SELECT 3, CASE WHEN n_rows < 10 THEN 'Very small dataset — model reliability may be low' END FROM report),
warnings AS (SELECT CAST(row_number() OVER (ORDER BY k) AS BIGINT) AS warning_no, w AS warning FROM warns WHERE w IS NOT NULL)"""


@register("validation_warnings", with_dirty("SELECT * FROM warnings", _REPORT_SQL))
def q_warn(spark, sf):
    return V.validation_warnings(V.validate(dirty_orders(spark, sf)))


@register("ingestion_summary", with_dirty("""
SELECT CAST(1 AS BIGINT) AS line_no, 'File orders.parquet ingested successfully.' AS line
UNION ALL SELECT 2, '- Rows: ' || CAST(n_rows AS VARCHAR) FROM report
UNION ALL SELECT 3, '- Columns: ' || CAST(n_columns AS VARCHAR) FROM report
UNION ALL SELECT 4, '- Missing cells: ' || CAST(missing_cells AS VARCHAR) || ' (' || CAST(missing_pct AS VARCHAR) || '%)' FROM report
UNION ALL SELECT 5, '- Duplicates: ' || CAST(duplicate_rows AS VARCHAR) FROM report
UNION ALL SELECT 6, 'Warnings:' FROM warnings WHERE warning_no = 1
UNION ALL SELECT warning_no + 6, '- ' || warning FROM warnings""", _REPORT_SQL))
def q_ingest(spark, sf):
    return V.ingestion_summary(V.validate(dirty_orders(spark, sf)), "orders.parquet")


def _kind_sql(c: str) -> str:
    return {"o_orderkey": "numeric", "o_custkey": "numeric", "o_totalprice": "numeric", "o_rare": "numeric"}.get(
        c, "categorical")


@register("profile_cardinality", with_dirty("\nUNION ALL\n".join(
    f"SELECT CAST({i} AS BIGINT) AS position, '{c}' AS column, '{_kind_sql(c)}' AS kind, "
    f"CAST(count_if({c} IS NULL) AS BIGINT) AS nulls, CAST(count(DISTINCT {c}) AS BIGINT) AS cardinality "
    f"FROM dirty_orders" for i, c in enumerate(DIRTY_COLS))))
def q_profile(spark, sf):
    return V.profile(dirty_orders(spark, sf))


_CUSTOMER = [("c_custkey", "int64"), ("c_name", "object"), ("c_nationkey", "int32"),
             ("c_acctbal", "float64"), ("c_mktsegment", "object")]


@register("column_sheet", "\nUNION ALL\n".join(
    f"SELECT CAST({i} AS BIGINT) AS position, '{c}' AS \"Column\", '{t}' AS \"Type\", "
    f"CAST(count_if({c} IS NULL) AS BIGINT) AS \"Nulls\", CAST(count(DISTINCT {c}) AS BIGINT) AS \"Unique\" "
    f"FROM customer" for i, (c, t) in enumerate(_CUSTOMER)))
def q_sheet(spark, sf):
    return V.column_sheet(table(spark, sf, "customer"))


def _describe_sql() -> str:
    parts = []
    for c in ["o_orderkey", "o_custkey", "o_totalprice", "o_rare"]:
        x = f"CAST({c} AS DOUBLE)"
        for stat, e in [("count", f"count({c})"), ("mean", f"avg({x})"), ("std", f"stddev_samp({x})"),
                        ("min", f"min({x})"), ("25%", f"quantile_cont({x}, 0.25)"),
                        ("50%", f"quantile_cont({x}, 0.5)"), ("75%", f"quantile_cont({x}, 0.75)"),
                        ("max", f"max({x})")]:
            parts.append(f"SELECT '{c}' AS column, '{stat}' AS stat, round(CAST({e} AS DOUBLE), 4) AS num_value, "
                         f"CAST(NULL AS VARCHAR) AS str_value FROM dirty_orders")
    for c in ["o_orderstatus", "o_orderpriority", "const_col", "o_size_txt", "o_date_txt"]:
        top = (f"(SELECT {c} AS v, count(*) AS n FROM dirty_orders WHERE {c} IS NOT NULL "
               f"GROUP BY {c} ORDER BY n DESC, v LIMIT 1)")
        parts.append(f"SELECT '{c}', 'count', CAST(count({c}) AS DOUBLE), NULL FROM dirty_orders")
        parts.append(f"SELECT '{c}', 'unique', CAST(count(DISTINCT {c}) AS DOUBLE), NULL FROM dirty_orders")
        parts.append(f"SELECT '{c}', 'top', NULL, v FROM {top}")
        parts.append(f"SELECT '{c}', 'freq', CAST(n AS DOUBLE), NULL FROM {top}")
    return with_dirty("\nUNION ALL\n".join(parts))


@register("describe_all", _describe_sql())
def q_describe(spark, sf):
    d = V.describe_all(dirty_orders(spark, sf))
    return d.select("column", "stat", F.round("num_value", 4).alias("num_value"), "str_value")


@register("preview_orders", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 20")
def q_preview(spark, sf):
    return V.preview(table(spark, sf, "orders"), "o_orderkey", 20)


# ------------------------------------------------------------------- cleaning
NO_CONST = [c for c in DIRTY_COLS if c != "const_col"]
_NO_CONST = ", ".join(NO_CONST)
_MODE_SQL = ("(SELECT {c} FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)")
_TYPED = (f"dedup AS (SELECT DISTINCT {_NO_CONST} FROM dirty_orders),\n"
          "typed AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority,\n"
          "  TRY_CAST(trim(o_size_txt) AS BIGINT) AS o_size_txt,\n"
          "  CAST(strptime(o_date_txt, '%Y-%m-%d') AS TIMESTAMP) AS o_date_txt, o_rare FROM dedup)")


@register("drop_constant", with_dirty(f"SELECT {_NO_CONST} FROM dirty_orders"))
def q_drop_constant(spark, sf):
    return C.drop_constant_columns(dirty_orders(spark, sf))


@register("drop_duplicates", with_dirty(f"SELECT DISTINCT {_NO_CONST} FROM dirty_orders"))
def q_drop_duplicates(spark, sf):
    return C.drop_duplicates(C.drop_constant_columns(dirty_orders(spark, sf)))


@register("infer_types", with_dirty("SELECT * FROM typed", _TYPED))
def q_infer_types(spark, sf):
    return C.infer_types(C.drop_duplicates(C.drop_constant_columns(dirty_orders(spark, sf))))


def _type_report_sql() -> str:
    num = r"'^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$'"
    intp = r"'^\s*[+-]?\d+\s*$'"
    parts = []
    for c in ["o_orderstatus", "o_orderpriority", "const_col", "o_size_txt", "o_date_txt"]:
        dt = (f"coalesce(try_strptime({c}, '%Y-%m-%d %H:%M:%S'), try_strptime({c}, '%Y-%m-%dT%H:%M:%S'), "
              f"try_strptime({c}, '%Y-%m-%d'))")
        parts.append(
            f"SELECT '{c}' AS column, CASE WHEN count_if(regexp_matches({c}, {num})) = count({c}) THEN "
            f"(CASE WHEN count({c}) > 0 AND count_if(regexp_matches({c}, {intp})) = count({c}) THEN 'bigint' "
            f"ELSE 'double' END) WHEN count_if({dt} IS NOT NULL) = count({c}) THEN 'timestamp_ntz' "
            f"ELSE 'string' END AS inferred_type FROM dirty_orders")
    return with_dirty("\nUNION ALL\n".join(parts))


@register("type_inference", _type_report_sql())
def q_type_report(spark, sf):
    df = dirty_orders(spark, sf)
    types = C.fit_types(df)
    rows = [(c, types.get(c, "string")) for c in df.columns if df.schema[c].dataType.typeName() == "string"]
    return spark.createDataFrame(rows, "column string, inferred_type string")


def _impute_sql(agg: str, drop: bool = False, digits: int | None = None) -> str:
    src = "kept" if drop else "dirty_orders"
    kept = ("kept AS (SELECT * FROM dirty_orders WHERE o_totalprice IS NOT NULL AND o_rare IS NOT NULL)")
    fv = (f"fv AS (SELECT {agg.format(c='o_totalprice')} AS p, {agg.format(c='o_rare')} AS r, "
          f"{_MODE_SQL.format(c='o_orderpriority', t=src)} AS m FROM {src})")
    def num(c, f):
        e = f"CAST(coalesce({c}, {f}) AS DOUBLE)"
        return f"round({e}, {digits})" if digits is not None else e
    body = (f"SELECT o_orderkey, o_custkey, o_orderstatus, {num('o_totalprice', 'p')} AS o_totalprice, "
            f"coalesce(o_orderpriority, m) AS o_orderpriority, const_col, o_size_txt, o_date_txt, "
            f"{num('o_rare', 'r')} AS o_rare FROM {src}, fv")
    return with_dirty(body, *([kept] if drop else []), fv)


@register("impute_median", _impute_sql("quantile_cont({c}, 0.5)"))
def q_impute_median(spark, sf):
    return C.impute(dirty_orders(spark, sf), "median")


def _round_fill(df):
    # a mean differs between engines in its last bits: compare it at 6 decimals
    return df.withColumn("o_totalprice", F.round("o_totalprice", 6)).withColumn("o_rare", F.round("o_rare", 6))


@register("impute_mean", _impute_sql("avg({c})", digits=6))
def q_impute_mean(spark, sf):
    return _round_fill(C.impute(dirty_orders(spark, sf), "mean"))


@register("impute_drop", _impute_sql("avg({c})", drop=True, digits=6))
def q_impute_drop(spark, sf):
    return _round_fill(C.impute(dirty_orders(spark, sf), "drop"))


@register("impute_fallthrough", _impute_sql("quantile_cont({c}, 0.5)"))
def q_impute_none(spark, sf):
    # any unknown strategy (``mode``/``none``) falls through to the median
    return C.impute(dirty_orders(spark, sf), "none")


def _bounds_frame(spark, bounds, with_quartiles=True):
    rows = [(b.column, b.q1, b.q3, b.lo, b.hi, b.n_outliers) for b in bounds]
    df = spark.createDataFrame(rows, "column string, q1 double, q3 double, lo double, hi double, n_outliers bigint")
    cols = ["column"] + (["q1", "q3"] if with_quartiles else []) + ["lo", "hi"]
    return df.select(*[F.round(c, 4).alias(c) if c != "column" else c for c in cols], "n_outliers")


def _iqr_sql(src: str, cols: list[str], k: float = 1.5) -> str:
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS column, round(q1, 4) AS q1, round(q3, 4) AS q3, round(q1 - {k} * (q3 - q1), 4) AS lo, "
            f"round(q3 + {k} * (q3 - q1), 4) AS hi, "
            f"(SELECT CAST(count_if({x} < b.q1 - {k} * (b.q3 - b.q1) OR {x} > b.q3 + {k} * (b.q3 - b.q1)) AS BIGINT) "
            f"FROM {src}) AS n_outliers "
            f"FROM (SELECT quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3 FROM {src}) b")
    return "\nUNION ALL\n".join(parts)


def _z_sql(src: str, cols: list[str], t: float = 3.0) -> tuple[str, str]:
    """(CTE text, report select) for z-score ranges."""
    ctes, sel = [], []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        ctes.append(f"z_{c} AS (SELECT min(CASE WHEN abs(({x} - m) / s) < {t} THEN {x} END) AS lo, "
                    f"max(CASE WHEN abs(({x} - m) / s) < {t} THEN {x} END) AS hi FROM {src}, "
                    f"(SELECT avg({x}) AS m, stddev_pop({x}) AS s FROM {src}) ms)")
        sel.append(f"SELECT '{c}' AS column, round(lo, 4) AS lo, round(hi, 4) AS hi, "
                   f"(SELECT CAST(count_if({x} < lo OR {x} > hi) AS BIGINT) FROM {src}) AS n_outliers FROM z_{c}")
    return ",\n".join(ctes), "\nUNION ALL\n".join(sel)


@register("iqr_bounds", _iqr_sql("events", ["event_id", "user_id", "value"]))
def q_iqr_bounds(spark, sf):
    return _bounds_frame(spark, C.fit_bounds(table(spark, sf, "events"), method="iqr"))


_ZDOC = _z_sql("documents", ["doc_id", "n_chars"])


@register("zscore_bounds", f"WITH {_ZDOC[0]}\n{_ZDOC[1]}")
def q_z_bounds(spark, sf):
    return _bounds_frame(spark, C.fit_bounds(table(spark, sf, "documents"), method="zscore"), with_quartiles=False)


@register("cap_iqr", """
WITH b AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi
           FROM (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events))
SELECT event_id, ts, user_id, event_type,
  CASE WHEN value < lo THEN lo WHEN value > hi THEN hi ELSE value END AS value, props
FROM events, b""")
def q_cap_iqr(spark, sf):
    e = table(spark, sf, "events")
    return C.cap_outliers(e, C.fit_bounds(e, method="iqr"))


@register("cap_zscore", f"""
WITH {_z_sql("documents", ["n_chars"])[0]}
SELECT doc_id, lang, source,
  CASE WHEN n_chars < lo THEN lo WHEN n_chars > hi THEN hi ELSE n_chars END AS n_chars
FROM documents, z_n_chars""")
def q_cap_z(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    b = [x for x in C.fit_bounds(d, method="zscore") if x.column == "n_chars"]
    return C.cap_outliers(d, b)


def _seq_drop_sql() -> str:
    ctes, src = [], "dirty_orders"
    for i, c in enumerate(["o_orderkey", "o_custkey", "o_totalprice", "o_rare"]):
        x = f"CAST({c} AS DOUBLE)"
        ctes.append(f"b{i} AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM "
                    f"(SELECT quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3 FROM {src}))")
        ctes.append(f"s{i} AS (SELECT {src}.* FROM {src}, b{i} WHERE NOT coalesce({x} < lo OR {x} > hi, false))")
        src = f"s{i}"
    return with_dirty(f"SELECT * FROM {src}", *ctes)


@register("drop_outliers_seq", _seq_drop_sql())
def q_drop_seq(spark, sf):
    df, _ = C.drop_outliers(dirty_orders(spark, sf), method="iqr")
    return df


_SEGMENTS = ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@register("one_hot", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, " + ", ".join(
    f"coalesce(c_mktsegment = '{v}', false) AS \"c_mktsegment_{v}\"" for v in _SEGMENTS) + " FROM customer")
def q_one_hot(spark, sf):
    return C.one_hot(table(spark, sf, "customer"))


@register("one_hot_flags", "SELECT l_orderkey, l_linenumber, "
          "coalesce(l_returnflag = 'N', false) AS l_returnflag_N, coalesce(l_returnflag = 'R', false) AS l_returnflag_R, "
          "coalesce(l_linestatus = 'O', false) AS l_linestatus_O FROM lineitem")
def q_one_hot_flags(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return C.one_hot(li)


_PRIOS = ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_CLEAN_NUM = ["o_orderkey", "o_custkey", "o_totalprice", "o_size_txt", "o_rare"]
_CLEAN_CTES = [
    _TYPED,
    "fv AS (SELECT quantile_cont(o_totalprice, 0.5) AS p, quantile_cont(o_rare, 0.5) AS r, "
    + _MODE_SQL.format(c="o_orderpriority", t="typed") + " AS m FROM typed)",
    "filled AS (SELECT o_orderkey, o_custkey, o_orderstatus, coalesce(o_totalprice, p) AS o_totalprice, "
    "coalesce(o_orderpriority, m) AS o_orderpriority, o_size_txt, o_date_txt, coalesce(o_rare, r) AS o_rare "
    "FROM typed, fv)",
    "q AS (SELECT " + ", ".join(
        f"quantile_cont(CAST({c} AS DOUBLE), 0.25) AS {c}_1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS {c}_3"
        for c in _CLEAN_NUM) + " FROM filled)",
    "bnd AS (SELECT " + ", ".join(
        f"{c}_1 - 1.5 * ({c}_3 - {c}_1) AS {c}_lo, {c}_3 + 1.5 * ({c}_3 - {c}_1) AS {c}_hi" for c in _CLEAN_NUM)
    + " FROM q)",
    "capped AS (SELECT o_orderkey, o_custkey, o_orderstatus, "
    "CASE WHEN o_totalprice < o_totalprice_lo THEN o_totalprice_lo WHEN o_totalprice > o_totalprice_hi "
    "THEN o_totalprice_hi ELSE o_totalprice END AS o_totalprice, o_orderpriority, o_size_txt, o_date_txt, "
    "CASE WHEN o_rare < o_rare_lo THEN o_rare_lo WHEN o_rare > o_rare_hi THEN o_rare_hi ELSE o_rare END AS o_rare "
    "FROM filled, bnd)",
]


@register("clean_full", with_dirty(
    "SELECT o_orderkey, o_custkey, o_totalprice, o_size_txt, o_date_txt, o_rare, "
    "coalesce(o_orderstatus = 'O', false) AS o_orderstatus_O, coalesce(o_orderstatus = 'P', false) AS o_orderstatus_P, "
    + ", ".join(f"coalesce(o_orderpriority = '{v}', false) AS \"o_orderpriority_{v}\"" for v in _PRIOS)
    + " FROM capped", *_CLEAN_CTES))
def q_clean_full(spark, sf):
    df, _log = C.clean(dirty_orders(spark, sf))
    return df


@register("change_log", with_dirty(
    "SELECT 1 AS step_no, 'constant_columns' AS step, CAST(1 AS BIGINT) AS n, 'Dropped 1 constant column(s)' AS message\n"
    "UNION ALL SELECT 2, 'duplicates', d, 'Removed ' || d || ' duplicate rows' FROM "
    "(SELECT (SELECT count(*) FROM dirty_orders) - (SELECT count(*) FROM dedup) AS d)\n"
    "UNION ALL SELECT 3, 'types', 2, 'Auto-converted types for 2 column(s)'\n"
    "UNION ALL SELECT 4, 'missing', m, 'Imputed ' || m || ' missing value(s)' FROM (SELECT sum("
    + " + ".join(f"CAST({c} IS NULL AS BIGINT)" for c in NO_CONST) + ") AS m FROM typed)\n"
    "UNION ALL SELECT 5, 'outliers', o, 'Outlier handling (cap): ' || o || ' value(s)' FROM (SELECT sum("
    + " + ".join(f"CAST(coalesce({c} < {c}_lo OR {c} > {c}_hi, false) AS BIGINT)" for c in _CLEAN_NUM)
    + ") AS o FROM filled, bnd)\n"
    "UNION ALL SELECT 6, 'one_hot', 2, 'One-hot encoded 2 categorical column(s)'", *_CLEAN_CTES))
def q_change_log(spark, sf):
    _df, log = C.clean(dirty_orders(spark, sf))
    return log


# ------------------------------------------------------------------------ EDA
from ..operators import eda as E  # noqa: E402
from ..operators import signals as I  # noqa: E402

LINEITEM_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                "l_discount", "l_tax"]


def _summary_sql(src: str, cols: list[str]) -> str:
    parts = []
    for i, c in enumerate(cols):
        x = f"CAST({c} AS DOUBLE)"
        for stat, e in [("count", f"count({c})"), ("mean", f"avg({x})"), ("std", f"stddev_samp({x})"),
                        ("min", f"min({x})"), ("25%", f"quantile_cont({x}, 0.25)"),
                        ("50%", f"quantile_cont({x}, 0.5)"), ("75%", f"quantile_cont({x}, 0.75)"),
                        ("max", f"max({x})")]:
            parts.append(f"SELECT {i} AS position, '{c}' AS column, '{stat}' AS stat, "
                         f"round(CAST({e} AS DOUBLE), 4) AS value FROM {src}")
    return "\nUNION ALL\n".join(parts)


@register("numeric_summary", _summary_sql("lineitem", LINEITEM_NUM))
def q_numeric_summary(spark, sf):
    return E.numeric_summary(table(spark, sf, "lineitem"))


@register("categorical_summary", with_dirty("\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, CAST(count(DISTINCT {c}) AS BIGINT) AS unique, "
    f"coalesce({_MODE_SQL.format(c=c, t='dirty_orders')}, 'N/A') AS top FROM dirty_orders"
    for c in ["o_orderstatus", "o_orderpriority", "const_col", "o_size_txt", "o_date_txt"])))
def q_cat_summary(spark, sf):
    return E.categorical_summary(dirty_orders(spark, sf))


_DIRTY_TYPES = {"o_orderkey": "int64", "o_custkey": "int64", "o_totalprice": "float64", "o_rare": "float64"}


@register("missing_by_column", with_dirty("\nUNION ALL\n".join(
    f"SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST({len(DIRTY_COLS)} AS BIGINT) AS n_columns, {i} AS position, "
    f"'{c}' AS column, CAST(count_if({c} IS NULL) AS BIGINT) AS missing, '{_DIRTY_TYPES.get(c, 'object')}' AS dtype "
    f"FROM dirty_orders" for i, c in enumerate(DIRTY_COLS))))
def q_missing(spark, sf):
    return E.missing_by_column(dirty_orders(spark, sf))


def _corr_sql_expr(a: str, b: str) -> str:
    return (f"covar_pop({a}, {b}) / nullif(sqrt(var_pop(CASE WHEN {b} IS NOT NULL THEN {a} END) * "
            f"var_pop(CASE WHEN {a} IS NOT NULL THEN {b} END)), 0)")


def _corr_matrix_sql(src: str, cols: list[str]) -> str:
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            e = f"CASE WHEN min({a}) <> max({a}) THEN 1.0 END" if i == j else _corr_sql_expr(a, b)
            parts.append(f"SELECT {i} AS i, {j} AS j, '{a}' AS col1, '{b}' AS col2, "
                         f"round(CAST({e} AS DOUBLE), 4) AS corr FROM {src}")
    return "\nUNION ALL\n".join(parts)


@register("corr_matrix", _corr_matrix_sql("lineitem", LINEITEM_NUM))
def q_corr(spark, sf):
    return E.correlation_matrix(table(spark, sf, "lineitem"))


EV2 = ["event_id", "user_id", "value", "v2"]


_FAR_COLS = ["event_id", "a", "b", "c", "d"]
_FAR_SQL = """far AS (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN 1e9 + value END AS a,
  CASE WHEN event_id % 5 = 0 OR event_id % 3 = 0 THEN 1e9 + 2 * value + event_id % 7 END AS b,
  CASE WHEN event_id % 5 = 0 THEN value END AS c, CASE WHEN event_id % 2 = 0 THEN 1000000007.0 ELSE 1000000007.0 END AS d FROM events)"""


@register("corr_far", f"WITH {_FAR_SQL}\n{_corr_matrix_sql('far', _FAR_COLS)}")
def q_corr_far(spark, sf):
    """Values near 1e9 with paired NULLs, a pair without common rows (a, c) and a constant."""
    k, v = F.col("event_id"), F.col("value")
    far = table(spark, sf, "events").select(
        "event_id", F.when(k % 5 != 0, v + 1e9).alias("a"), F.when((k % 5 == 0) | (k % 3 == 0), 2 * v + 1e9 + k % 7).alias("b"),
        F.when(k % 5 == 0, v).alias("c"), F.lit(1000000007.0).alias("d"))
    return E.correlation_matrix(far)


@register("top_correlations", f"WITH {EVENTS_V2_SQL}, m AS ({_corr_matrix_sql('events_v2', EV2)})\n"
          "SELECT col1, col2, corr FROM m WHERE i < j ORDER BY abs(corr) DESC NULLS LAST, i, j LIMIT 10")
def q_top_corr(spark, sf):
    return E.top_correlations(events_v2(spark, sf))


def _trend_sql(src: str, key: str, cols: list[str]) -> str:
    parts = []
    for i, c in enumerate(cols):
        parts.append(
            f"SELECT {i} AS position, '{c}' AS column, CAST(count(*) AS BIGINT) AS n, round(regr_slope(y, x), 4) AS slope, "
            f"round(abs(regr_slope(y, x)) / (avg(y) + 1e-9) * 100, 4) AS pct, "
            f"abs(regr_slope(y, x)) / (avg(y) + 1e-9) * 100 > 5 AS flagged, "
            f"CASE WHEN abs(regr_slope(y, x)) / (avg(y) + 1e-9) * 100 > 5 THEN "
            f"(CASE WHEN regr_slope(y, x) > 0 THEN 'increasing' ELSE 'decreasing' END) END AS direction, "
            f"CASE WHEN abs(regr_slope(y, x)) / (avg(y) + 1e-9) * 100 > 5 THEN printf('**%s** shows a %s trend (slope=%.4f)', "
            f"'{c}', CASE WHEN regr_slope(y, x) > 0 THEN 'increasing' ELSE 'decreasing' END, regr_slope(y, x)) END AS message "
            f"FROM (SELECT CAST({c} AS DOUBLE) AS y, row_number() OVER (ORDER BY {key}) - 1 AS x FROM {src} "
            f"WHERE {c} IS NOT NULL) HAVING count(*) >= 10")
    return "\nUNION ALL\n".join(parts)


@register("trends", _trend_sql("events", "event_id", ["event_id", "user_id", "value"]))
def q_trends(spark, sf):
    return E.detect_trends(table(spark, sf, "events"), "event_id")


@register("trends_orders", _trend_sql("orders", "o_orderkey", ["o_orderkey", "o_custkey", "o_totalprice"]))
def q_trends_orders(spark, sf):
    return E.detect_trends(table(spark, sf, "orders"), "o_orderkey")


def _hist_sql(src: str, cols: list[str], bins: int = 20) -> str:
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS column, CAST(b AS INTEGER) AS bin, round(lo + b * ((hi - lo) / {bins}), 4) AS lo, "
            f"round(lo + (b + 1) * ((hi - lo) / {bins}), 4) AS hi, CAST(count(*) AS BIGINT) AS count FROM ("
            f"SELECT CASE WHEN hi > lo THEN least(floor(({x} - lo) / (hi - lo) * {bins}), {bins - 1}) ELSE 0 END AS b, "
            f"lo, hi FROM {src}, (SELECT min({x}) AS lo, max({x}) AS hi FROM {src}) mm WHERE {c} IS NOT NULL) "
            f"GROUP BY b, lo, hi")
    return "\nUNION ALL\n".join(parts)


@register("histogram", _hist_sql("events", ["event_id", "user_id", "value"]))
def q_hist(spark, sf):
    return E.histogram(table(spark, sf, "events"))


def _box_sql(src: str, cols: list[str]) -> str:
    parts = []
    for i, c in enumerate(cols):
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT {i} AS position, '{c}' AS column, round(q1, 4) AS q1, round(med, 4) AS median, round(q3, 4) AS q3, "
            f"round(min(CASE WHEN {x} >= q1 - 1.5 * (q3 - q1) THEN {x} END), 4) AS lower_whisker, "
            f"round(max(CASE WHEN {x} <= q3 + 1.5 * (q3 - q1) THEN {x} END), 4) AS upper_whisker, "
            f"CAST(count_if({x} < q1 - 1.5 * (q3 - q1) OR {x} > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS n_outliers "
            f"FROM {src}, (SELECT quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.5) AS med, "
            f"quantile_cont({x}, 0.75) AS q3 FROM {src}) q GROUP BY q1, med, q3")
    return "\nUNION ALL\n".join(parts)


@register("box_stats", _box_sql("part", ["p_partkey", "p_size", "p_retailprice"]))
def q_box(spark, sf):
    return E.box_stats(table(spark, sf, "part"))


@register("value_counts", "SELECT \"column\", CAST(rank AS BIGINT) AS rank, value, count FROM ("
          "SELECT \"column\", value, count, row_number() OVER (PARTITION BY \"column\" ORDER BY count DESC, value) AS rank FROM ("
          "SELECT 'p_name' AS column, p_name AS value, CAST(count(*) AS BIGINT) AS count FROM part GROUP BY p_name "
          "UNION ALL SELECT 'p_brand', p_brand, CAST(count(*) AS BIGINT) FROM part GROUP BY p_brand)) WHERE rank <= 15")
def q_value_counts(spark, sf):
    return E.value_counts(table(spark, sf, "part"), cols=["p_name", "p_brand"])


@register("scatter_sample", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem")
def q_scatter(spark, sf):
    return E.scatter_frame(table(spark, sf, "lineitem"), cols=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])


@register("summary_context")
def q_summary_context(spark, sf):
    return E.summary_context(table(spark, sf, "orders"), "o_orderkey")


# ----------------------------------------------------------------- KPIs/signals
def _kpi_sql(src: str, all_cols: list[str], num: list[str]) -> str:
    nulls = " + ".join(f"CAST({c} IS NULL AS BIGINT)" for c in all_cols)
    items = [("Total Rows", "format('{:,}', count(*))", "''"),
             ("Total Columns", f"'{len(all_cols)}'", "''"),
             ("Missing Data %", f"CAST(round(sum({nulls}) / greatest(count(*) * {len(all_cols)}, 1) * 100, 1) AS VARCHAR) || '%'", "''")]
    for c in num[:5]:
        items.append((f"Mean {c}", f"printf('%.2f', avg({c}))", f"printf('std %.2f', stddev_samp({c}))"))
        items.append((f"Max {c}", f"printf('%.2f', CAST(max({c}) AS DOUBLE))", "''"))
    return "\nUNION ALL\n".join(f"SELECT CAST({k + 1} AS BIGINT) AS kpi_no, '{lab}' AS label, {v} AS value, {d} AS delta "
                                + ("" if k == 1 else f"FROM {src}") for k, (lab, v, d) in enumerate(items[:12]))


_LINEITEM_ALL = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@register("kpis", _kpi_sql("lineitem", _LINEITEM_ALL, LINEITEM_NUM))
def q_kpis(spark, sf):
    return I.kpis(table(spark, sf, "lineitem"), I.KPI_NUMERIC_COLUMNS, I.KPI_CAP)


@register("kpis_dirty", with_dirty(_kpi_sql("dirty_orders", DIRTY_COLS, ["o_orderkey", "o_custkey", "o_totalprice", "o_rare"])))
def q_kpis_dirty(spark, sf):
    return I.kpis(dirty_orders(spark, sf), I.KPI_NUMERIC_COLUMNS, I.KPI_CAP)


def _signals_sql(src: str, num: list[str]) -> str:
    parts = []
    for i, c in enumerate(num):
        cv = f"(stddev_samp({c}) / (avg({c}) + 1e-9))"
        miss = f"(count_if({c} IS NULL) / count(*) * 100)"
        parts.append(f"SELECT {2 * i} AS o, 'variability' AS kind, printf('**{c}** has very high variability (CV=%.2f) — "
                     f"investigate outliers', {cv}) AS signal FROM {src} HAVING {cv} > 1.0")
        parts.append(f"SELECT {2 * i + 1}, 'missing', printf('**{c}** has %.1f%% missing — data quality concern', {miss}) "
                     f"FROM {src} HAVING {miss} > 20")
    k = len(num)
    pairs = []
    for i in range(k):
        for j in range(i + 1, k):
            e = _corr_sql_expr(num[i], num[j])
            pairs.append(f"SELECT {2 * k + i * k + j} AS o, '{num[i]}' AS c1, '{num[j]}' AS c2, abs({e}) AS v FROM {src}")
    if pairs:
        parts.append("SELECT * FROM (SELECT o, 'collinear', printf('**%s** and **%s** are highly correlated (%.2f) — "
                     "potential multicollinearity', c1, c2, v) FROM (" + " UNION ALL ".join(pairs)
                     + ") WHERE v > 0.85 ORDER BY o LIMIT 3)")
    body = "\nUNION ALL\n".join(parts)
    return (f"s AS ({body}), f AS (SELECT * FROM s UNION ALL SELECT -1, 'none', "
            f"'No strong root-cause signals detected.' WHERE NOT EXISTS (SELECT 1 FROM s))\n"
            "SELECT CAST(row_number() OVER (ORDER BY o) AS BIGINT) AS signal_no, kind, signal FROM f")


def _signals_full(prefix_ctes: list[str], src: str, num: list[str]) -> str:
    s = _signals_sql(src, num)
    head, sel = s.split("\nSELECT CAST(row_number", 1)
    return "WITH " + ",\n".join([*prefix_ctes, head]) + "\nSELECT CAST(row_number" + sel


@register("signals", _signals_full([DIRTY_ORDERS_SQL], "dirty_orders",
                                   ["o_orderkey", "o_custkey", "o_totalprice", "o_rare"]))
def q_signals(spark, sf):
    return I.signals(dirty_orders(spark, sf), I.COLLINEAR_SHOWN)


@register("signals_collinear", _signals_full([EVENTS_V2_SQL], "events_v2", EV2))
def q_signals_coll(spark, sf):
    return I.signals(events_v2(spark, sf), I.COLLINEAR_SHOWN)


@register("signals_documents", _signals_full([], "documents", ["doc_id", "n_chars"]))
def q_signals_docs(spark, sf):
    return I.signals(table(spark, sf, "documents"), I.COLLINEAR_SHOWN)


# ------------------------------------------------------------------ documents
from ..functions.text import STRIP_PATTERN, TOKEN_SPLIT  # noqa: E402
from ..operators import documents as D  # noqa: E402
from ..operators import retrieval as RT  # noqa: E402
from ..operators import routing as RO  # noqa: E402
from ..operators import vector_index as X  # noqa: E402
from ..session import scratch_path  # noqa: E402
from ..sources.chunk_store import ChunkStore  # noqa: E402

_CHUNKS_SQL = f"""chunks AS (
  SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INTEGER) AS chunk, t AS text,
    substring(md5(full_text), 1, 8) || '_' || CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS VARCHAR) AS id
  FROM (SELECT doc_id, source, full_text, s, regexp_replace(substring(full_text, s + 1, 800), '{STRIP_PATTERN}', '', 'g') AS t
        FROM (SELECT doc_id, source, text AS full_text, unnest(range(0, length(text), 650)) AS s FROM documents))
  WHERE length(t) > 0),
store AS (SELECT id, doc_id, source, chunk, text FROM
  (SELECT *, row_number() OVER (PARTITION BY id ORDER BY doc_id DESC) AS rn FROM chunks) WHERE rn = 1)"""


def doc_chunks(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    return D.chunk_ids(D.chunk_text(docs))


def chunk_store(spark, sf):
    return D.upsert_chunks(None, doc_chunks(spark, sf).select("id", "doc_id", "source", "chunk", "text"), "doc_id")


@register("chunk_documents", f"WITH {_CHUNKS_SQL}\nSELECT doc_id, chunk, text FROM chunks")
def q_chunks(spark, sf):
    return doc_chunks(spark, sf).select("doc_id", "chunk", "text")


@register("chunk_ids", f"WITH {_CHUNKS_SQL}\nSELECT id, doc_id, chunk FROM chunks")
def q_chunk_ids(spark, sf):
    return doc_chunks(spark, sf).select("id", "doc_id", "chunk")


@register("upsert_chunks", f"WITH {_CHUNKS_SQL}\nSELECT * FROM store")
def q_upsert(spark, sf):
    return chunk_store(spark, sf)


_MERGED_SQL = _CHUNKS_SQL + """,
batches AS (SELECT *, 1 AS batch FROM chunks WHERE doc_id % 3 <> 1 UNION ALL
  SELECT id, doc_id, source, chunk, text, batch FROM (SELECT doc_id, source || ' v2' AS source, chunk, text, id, 2 AS batch FROM chunks
    WHERE doc_id % 3 <> 0)),
merged AS (SELECT id, doc_id, source, chunk, text FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY batch DESC, doc_id DESC) AS rn
  FROM batches) WHERE rn = 1)""".replace("SELECT *, 1 AS batch FROM chunks", "SELECT id, doc_id, source, chunk, text, 1 AS batch FROM chunks")


def merged_store(spark, sf):
    """Two batches of documents merged into a stored collection; a third of them is in both, changed."""
    store = ChunkStore(spark, scratch_path(spark, "chunk-store"), "id string, doc_id bigint, source string, chunk int, text string", "doc_id")
    chunks = doc_chunks(spark, sf).select("id", "doc_id", "source", "chunk", "text")
    store.merge(chunks.where(F.col("doc_id") % 3 != 1))
    store.merge(chunks.where(F.col("doc_id") % 3 != 0).withColumn("source", F.concat("source", F.lit(" v2"))))
    return store


@register("merge_chunks", f"WITH {_MERGED_SQL}\nSELECT * FROM merged")
def q_merge(spark, sf):
    return merged_store(spark, sf).read()


@register("store_versions", f"""WITH {_MERGED_SQL},
one AS (SELECT count(DISTINCT id) AS n FROM chunks WHERE doc_id % 3 <> 1)
SELECT CAST(1 AS BIGINT) AS version, CAST(n AS BIGINT) AS chunks FROM one
UNION ALL SELECT 2, CAST(count(*) AS BIGINT) FROM merged""")
def q_store_versions(spark, sf):
    """Rows of every version of the store; the first one stays readable."""
    store = merged_store(spark, sf)
    first, second = (store.read(v).agg(F.lit(v).cast("bigint").alias("version"), F.count(F.lit(1)).alias("chunks")) for v in (1, 2))
    return first.unionByName(second)


@register("collection_stats", f"WITH {_CHUNKS_SQL}\nSELECT 'documents' AS collection, CAST(count(*) AS BIGINT) AS chunks FROM store")
def q_collection(spark, sf):
    return D.collection_stats(chunk_store(spark, sf))


_CENTROID_SQL = """cells AS (SELECT label, unnest(embedding) AS v, unnest(generate_series(1, len(embedding))) AS d FROM embeddings),
cent AS (SELECT label, list(v ORDER BY d) AS q FROM (SELECT label, d, avg(v) AS v FROM cells GROUP BY label, d) GROUP BY label),
sc AS (SELECT c.label AS query_label, e.vec_id,
  list_cosine_similarity(CAST(c.q AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS sim FROM cent c, embeddings e)"""


@register("retrieve_topk", f"WITH {_CENTROID_SQL}\nSELECT query_label, CAST(rank AS BIGINT) AS rank, vec_id, "
          "round(sim, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_label "
          "ORDER BY round(sim, 10) DESC, vec_id) AS rank FROM sc) WHERE rank <= 5")
def q_retrieve(spark, sf):
    emb = table(spark, sf, "embeddings")
    return RT.retrieve_dense(RT.centroids(emb, "label").withColumnRenamed("label", "query_label"), emb,
                             k=5, query_id="query_label")


_NEIGHBOUR_SQL = """nb AS (SELECT q.vec_id AS query_id, e.vec_id,
  list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS sim
  FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 10) DESC, vec_id) AS rank FROM nb)"""


def _index_queries(emb):
    """Every twentieth vector asks the whole table."""
    return emb.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), "embedding")


@register("index_search", f"WITH {_NEIGHBOUR_SQL}\nSELECT query_id, CAST(rank AS BIGINT) AS rank, vec_id, "
          "round(sim, 4) AS score FROM top WHERE rank <= 5")
def q_index_search(spark, sf):
    """The inverted-file index with every cell read, which is exact."""
    emb = table(spark, sf, "embeddings")
    index = X.build_index(emb, scratch_path(spark, "vector-index"))
    return X.search_index(X.load_index(spark, index.path), _index_queries(emb), probes=len(index.centres))


@register("index_recall", f"WITH {_NEIGHBOUR_SQL}\nSELECT CAST(count(DISTINCT query_id) AS BIGINT) AS queries, "
          "CAST(count(*) AS BIGINT) AS neighbours, true AS recall_reached FROM top WHERE rank <= 5")
def q_index_recall(spark, sf):
    """Recall of the index at the number of cells it chose, against all exact neighbours (0.9 at least)."""
    emb = table(spark, sf, "embeddings")
    index = X.build_index(emb, scratch_path(spark, "vector-index"))
    asked = _index_queries(emb)
    told = X.recall_report(X.search_index(index, asked), RT.retrieve_dense(asked, emb), "query_id", "vec_id")
    return told.select("queries", "neighbours", (F.col("recall") >= 0.9).alias("recall_reached"))


def _tok_sql(src: str, id_col: str, text_col: str) -> str:
    return (f"SELECT {id_col}, term, count(*) AS tf FROM (SELECT {id_col}, "
            f"unnest(regexp_split_to_array(lower({text_col}), '{TOKEN_SPLIT}')) AS term FROM {src}) "
            f"WHERE length(term) > 0 GROUP BY {id_col}, term")


_TEXT_RETRIEVAL_SQL = _CHUNKS_SQL + f""",
ctf AS ({_tok_sql('store', 'id', 'text')}),
idf AS (SELECT term, ln(((SELECT count(DISTINCT id) FROM ctf) + 1) / (count(*) + 1)) AS idf FROM ctf GROUP BY term),
cw0 AS (SELECT id, term, tf * idf AS w FROM ctf JOIN idf USING (term) WHERE tf * idf <> 0),
cw AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM cw0),
questions AS (SELECT conv_id AS query_id, arg_max(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id),
qtf AS ({_tok_sql('questions', 'query_id', 'question')}),
qw0 AS (SELECT query_id, term, tf * idf AS w FROM qtf JOIN idf USING (term) WHERE tf * idf <> 0),
qw AS (SELECT query_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS weight FROM qw0),
pairs AS (SELECT query_id, id, sum(qw.weight * cw.weight) AS sim FROM qw JOIN cw USING (term) GROUP BY query_id, id),
hits AS (SELECT query_id, CAST(rank AS BIGINT) AS rank, id, round(sim, 4) AS score FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 10) DESC, id) AS rank FROM pairs) WHERE rank <= 5),
hitrows AS (SELECT h.query_id, h.rank, h.score, s.source, s.chunk, s.text FROM hits h JOIN store s USING (id))"""


def _py_float_sql(x: str) -> str:
    s = f"regexp_replace(printf('%.4f', {x}), '0+$', '')"
    return f"(CASE WHEN {s} LIKE '%.' THEN {s} || '0' ELSE {s} END)"


def text_index(spark, sf):
    """The written chunk store and its TF-IDF index, a row per chunk throughout (the store's ids are unique)."""
    store = materialize(chunk_store(spark, sf))
    ctf = materialize(RT.term_frequencies(store, "id", "text", rows=True))
    idf = materialize(RT.fit_idf(ctf, "id"))
    cw = RT.posting_rows(RT.tfidf_weights(ctf, idf, "id"), "id")
    return store, idf, cw


def text_hits(spark, sf):
    """Top-5 chunks for the latest user question of every conversation (TF-IDF cosine)."""
    store, idf, cw = text_index(spark, sf)
    questions = RO.latest_user_query(table(spark, sf, "conversations")).select(
        F.col("conv_id").alias("query_id"), F.col("query").alias("question"))
    qw = materialize(RT.tfidf_weights(RT.term_frequencies(questions, "query_id", "question"), idf, "query_id"))
    hits = materialize(RT.retrieve_sparse(qw, cw, k=5, q_id="query_id", c_id="id"))  # k rows a query
    return questions, hits, store


@register("retrieve_text", f"WITH {_TEXT_RETRIEVAL_SQL}\nSELECT * FROM hits")
def q_retrieve_text(spark, sf):
    _q, hits, _s = text_hits(spark, sf)
    return hits


def _hit_rows(spark, sf):
    questions, hits, store = text_hits(spark, sf)
    return questions, hits.join(store.select("id", "source", "chunk", "text"), "id")


_BLOCK_SQL = ("'[Source: ' || source || ' | Chunk ' || CAST(chunk AS VARCHAR) || ' | Score: ' || "
              + _py_float_sql("score") + " || ']' || chr(10) || text")
_CITE_SQL = ("'- **' || source || '** (chunk ' || CAST(chunk AS VARCHAR) || ', relevance ' || "
             + _py_float_sql("score") + " || ')'")


@register("rag_context", f"WITH {_TEXT_RETRIEVAL_SQL}\nSELECT query_id, string_agg({_BLOCK_SQL}, chr(10) || chr(10) "
          "ORDER BY rank) AS context FROM hitrows GROUP BY query_id")
def q_rag_context(spark, sf):
    _q, h = _hit_rows(spark, sf)
    return D.build_context(h)


@register("citations", f"WITH {_TEXT_RETRIEVAL_SQL}\nSELECT query_id, string_agg({_CITE_SQL}, chr(10) "
          "ORDER BY rank) AS citations FROM hitrows GROUP BY query_id")
def q_citations(spark, sf):
    _q, h = _hit_rows(spark, sf)
    return D.citations(h)


@register("prompt_frame", f"""WITH {_TEXT_RETRIEVAL_SQL},
ctx AS (SELECT query_id, string_agg({_BLOCK_SQL}, chr(10) || chr(10) ORDER BY rank) AS context,
  string_agg({_CITE_SQL}, chr(10) ORDER BY rank) AS citations FROM hitrows GROUP BY query_id)
SELECT q.query_id, q.question, coalesce(c.context, '{D.NO_DOCUMENTS}') AS context, coalesce(c.citations, '') AS citations,
  CASE WHEN c.context IS NOT NULL THEN 'Context:' || chr(10) || c.context || chr(10) || chr(10) || 'Question: ' ||
  q.question || chr(10) || chr(10) || 'Provide a detailed, well-structured answer with inline citations like [Source: filename].'
  END AS prompt
FROM questions q LEFT JOIN ctx c USING (query_id)""")
def q_prompt(spark, sf):
    q, h = _hit_rows(spark, sf)
    return D.prompt_frame(q, h)


@register("recent_history", "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER "
          "(PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 6")
def q_history(spark, sf):
    return D.recent_history(table(spark, sf, "conversations"))


@register("latest_user_query", "SELECT conv_id, arg_max(text, turn) AS query FROM conversations "
          "WHERE role = 'user' GROUP BY conv_id")
def q_latest(spark, sf):
    return RO.latest_user_query(table(spark, sf, "conversations"))


@register("explicit_query", "SELECT conv_id, CASE WHEN conv_id % 4 = 0 THEN 'clean conversation ' || conv_id ELSE arg_max(text, turn) END AS query "
          "FROM conversations WHERE role = 'user' GROUP BY conv_id")
def q_explicit_query(spark, sf):
    """Every fourth conversation asks explicitly; an empty explicit query leaves the last message."""
    conv = table(spark, sf, "conversations")
    asked = conv.select("conv_id").distinct().withColumn("query", F.when(
        F.col("conv_id") % 4 == 0, F.concat(F.lit("clean conversation "), F.col("conv_id").cast("string"))).when(F.col("conv_id") % 4 == 1, ""))
    return RO.latest_user_query(conv, explicit=asked.where(F.col("conv_id") % 4 < 2))


def _route_sql(text: str) -> str:
    scores = []
    for name, kws in RO.INTENTS:
        scores.append("(" + " + ".join(f"CAST(contains(lower({text}), '{kw}') AS INTEGER)" for kw in kws) + ")")
    best = "greatest(" + ", ".join(scores) + ")"
    cases = " ".join(f"WHEN {s} = {best} THEN '{name}'" for s, (name, _k) in zip(scores, RO.INTENTS))
    return f"CASE WHEN {best} = 0 THEN 'eda' {cases} END"


@register("route_queries", f"SELECT conv_id, turn, {_route_sql('text')} AS agent FROM conversations")
def q_route(spark, sf):
    return RO.route_queries(table(spark, sf, "conversations")).select("conv_id", "turn", "agent")


@register("page_text", "SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(12)), 1) AS INTEGER) AS page, "
          "unnest(string_split(text, chr(12))) AS text FROM documents")
def q_page_text(spark, sf):
    return D.page_text_frame(table(spark, sf, "documents"))


@register("document_text", "SELECT doc_id, string_agg(text || chr(10), '' ORDER BY page) AS text FROM ("
          "SELECT doc_id, generate_subscripts(string_split(text, chr(12)), 1) AS page, "
          "unnest(string_split(text, chr(12))) AS text FROM documents) GROUP BY doc_id")
def q_document_text(spark, sf):
    return D.document_text(D.page_text_frame(table(spark, sf, "documents")))


# ------------------------------------------------------------------ sequences
from ..operators import models as M  # noqa: E402
from ..operators import neural as NN  # noqa: E402
from ..operators import sequence as N  # noqa: E402

_LAGS = ", ".join(f"lag(value, {10 - i}) OVER w AS x_{i + 1}" for i in range(10))


@register("minmax", "SELECT event_id, value, round((value - lo) / (hi - lo), 8) AS scaled FROM events, "
          "(SELECT min(value) AS lo, max(value) AS hi FROM events) mm")
def q_minmax(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value")
    return N.minmax_scale(e, "value").withColumn("scaled", F.round("scaled", 8))


_SEQ_SQL = (f"seqs AS (SELECT user_id, event_id, {_LAGS}, value AS y, row_number() OVER w AS rn FROM events "
            "WINDOW w AS (PARTITION BY user_id ORDER BY event_id))")
_SEQ_COLS = ", ".join(f"x_{i}" for i in range(1, 11))


@register("sequences", f"WITH {_SEQ_SQL}\nSELECT user_id, event_id, {_SEQ_COLS}, y FROM seqs WHERE rn > 10")
def q_sequences(spark, sf):
    return N.make_sequences(table(spark, sf, "events"), "value", "event_id", ["user_id"], 10)


@register("chrono_split", f"WITH {_SEQ_SQL}, s AS (SELECT * FROM seqs WHERE rn > 10)\n"
          f"SELECT user_id, event_id, {_SEQ_COLS}, y, row_number() OVER (PARTITION BY user_id ORDER BY event_id) "
          "<= floor(0.8 * count(*) OVER (PARTITION BY user_id)) AS is_train FROM s")
def q_chrono(spark, sf):
    seqs = N.make_sequences(table(spark, sf, "events"), "value", "event_id", ["user_id"], 10)
    return N.chronological_split(seqs, "event_id", ["user_id"])


_GSEQ_SQL = ("gseq AS (SELECT o_orderkey, " + ", ".join(f"lag(o_totalprice, {10 - i}) OVER w AS x_{i + 1}" for i in range(10))
             + ", o_totalprice AS y, row_number() OVER w AS rn FROM orders WINDOW w AS (ORDER BY o_orderkey))")


@register("sequences_global", f"WITH {_GSEQ_SQL}\nSELECT o_orderkey, {_SEQ_COLS}, y FROM gseq WHERE rn > 10")
def q_gseq(spark, sf):
    return N.make_sequences(table(spark, sf, "orders"), "o_totalprice", "o_orderkey", None, 10)


@register("chrono_split_global", f"WITH {_GSEQ_SQL}, s AS (SELECT * FROM gseq WHERE rn > 10)\n"
          f"SELECT o_orderkey, {_SEQ_COLS}, y, row_number() OVER (ORDER BY o_orderkey) "
          "<= floor(0.8 * (SELECT count(*) FROM s)) AS is_train FROM s")
def q_gsplit(spark, sf):
    seqs = N.make_sequences(table(spark, sf, "orders"), "o_totalprice", "o_orderkey", None, 10)
    return N.chronological_split(seqs, "o_orderkey")


_NSEQ_SQL = """nv AS (SELECT user_id, event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM events),
nk AS (SELECT * FROM nv WHERE v IS NOT NULL),
seqs AS (SELECT user_id, event_id, """ + _LAGS.replace("value", "v") + """, v AS y, row_number() OVER w AS rn FROM nk
  WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"""


@register("sequences_nulls", f"WITH {_NSEQ_SQL}\nSELECT user_id, event_id, {_SEQ_COLS}, y FROM seqs WHERE rn > 10")
def q_sequences_nulls(spark, sf):
    """Windows of a column with missing values, which are left out first."""
    e = table(spark, sf, "events").withColumn("v", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    return N.make_sequences(e, "v", "event_id", ["user_id"], 10)


def _forecast_sql(n: int = 10) -> str:
    """Lag models by series: sums of products, then Gauss-Jordan elimination column by column."""
    lags = ", ".join(f"lag(v, {n - i}) OVER w AS x_{i + 1}" for i in range(n))
    terms = ["1.0", *[f"x_{i + 1}" for i in range(n)], "y"]
    rows = "[" + ", ".join("[" + ", ".join(f"sum({a} * {b})" for b in terms) + "]" for a in terms[:-1]) + "]"
    dot = " + ".join(f"m[{i + 2}][{n + 2}] * x_{i + 1}" for i in range(n))
    return f"""RECURSIVE daily AS (SELECT l_returnflag, CAST(l_shipdate AS DATE) AS day,
    CASE WHEN dayofmonth(CAST(l_shipdate AS DATE)) <> 13 THEN sum(l_extendedprice) END AS revenue FROM lineitem GROUP BY 1, 2),
known AS (SELECT * FROM daily WHERE revenue IS NOT NULL),
ends AS (SELECT l_returnflag, min(revenue) AS lo, CASE WHEN max(revenue) > min(revenue) THEN max(revenue) - min(revenue)
  ELSE 1.0 END AS span FROM known GROUP BY l_returnflag),
scaled AS (SELECT k.l_returnflag, day, (revenue - lo) / span AS v FROM known k JOIN ends USING (l_returnflag)),
wins AS (SELECT l_returnflag, day, {lags}, v AS y, row_number() OVER w AS rn FROM scaled
  WINDOW w AS (PARTITION BY l_returnflag ORDER BY day)),
cut AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY day) <= floor({N.TRAIN_FRACTION} * count(*)
  OVER (PARTITION BY l_returnflag)) AS is_train FROM wins WHERE rn > {n}),
eliminate AS (SELECT l_returnflag, 1 AS k, {rows} AS m FROM cut WHERE is_train GROUP BY l_returnflag
  UNION ALL SELECT l_returnflag, k + 1, [[CASE WHEN i = k THEN m[k][j] / m[k][k] ELSE m[i][j] - m[i][k] * m[k][j] / m[k][k] END
    FOR j IN range(1, {n + 3})] FOR i IN range(1, {n + 2})] FROM eliminate WHERE k <= {n + 1}),
models AS (SELECT l_returnflag, m FROM eliminate WHERE k = {n + 2}),
pred AS (SELECT l_returnflag, day, y * span + lo AS actual, (m[1][{n + 2}] + {dot}) * span + lo AS predicted
  FROM cut JOIN models USING (l_returnflag) JOIN ends USING (l_returnflag) WHERE NOT is_train)"""


def _daily_revenue(spark, sf):
    """Daily revenue per return flag; the thirteenth of a month is missing."""
    daily = N.daily_series(table(spark, sf, "lineitem"))
    return daily.withColumn("revenue", F.when(F.dayofmonth("day") != 13, F.col("revenue")))


def _daily_fit(spark, sf):
    return N.forecast_validation(_daily_revenue(spark, sf), "revenue", "day", ["l_returnflag"])


@register("forecast_validation", f"""WITH {_forecast_sql()}
SELECT l_returnflag, round(sqrt(avg((actual - predicted) ** 2)), 4) AS rmse,
  round(1 - sum((actual - predicted) ** 2) / (var_pop(actual) * count(actual)), 4) AS r2 FROM pred GROUP BY l_returnflag""")
def q_forecast_validation(spark, sf):
    return _daily_fit(spark, sf)[2]


@register("forecast_preview", f"WITH {_forecast_sql()}\nSELECT l_returnflag, day, round(actual, 2) AS actual, "
          "round(predicted, 2) AS predicted FROM pred")
def q_forecast_preview(spark, sf):
    return _daily_fit(spark, sf)[1].select("l_returnflag", "day", F.round("actual", 2).alias("actual"),
                                           F.round("predicted", 2).alias("predicted"))


_AHEAD_DOT = " + ".join(f"m[{i + 2}][12] * h[step + {i + 1}]" for i in range(10))


@register("forecast_horizon", f"""WITH {_forecast_sql()},
ahead AS (SELECT l_returnflag, 0 AS step, m, (SELECT list(v ORDER BY day) FROM (SELECT v, day FROM scaled s
    WHERE s.l_returnflag = models.l_returnflag ORDER BY day DESC LIMIT 10)) AS h FROM models
  UNION ALL SELECT l_returnflag, step + 1, m, list_append(h, m[1][12] + {_AHEAD_DOT}) FROM ahead WHERE step < 6)
SELECT l_returnflag, CAST(step AS INTEGER) AS step, round(h[10 + step] * span + lo, 2) AS forecast
FROM ahead JOIN ends USING (l_returnflag) WHERE step > 0""")
def q_forecast(spark, sf):
    ahead = N.forecast(_daily_revenue(spark, sf), "revenue", "day", ["l_returnflag"], horizon=6)
    return ahead.withColumn("forecast", F.round("forecast", 2))


# --------------------------------------------------------------------- models
@register("folds_contiguous", "SELECT o_orderkey, CAST(ntile(5) OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS fold "
          "FROM orders")
def q_folds_contiguous(spark, sf):
    return M.assign_folds(table(spark, sf, "orders").select("o_orderkey"), 5, order_by="o_orderkey")


_LI_DIGEST = f"md5('{M.SEED}|' || CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR))"


@register("folds_shuffled", "SELECT l_orderkey, l_linenumber, l_returnflag, CAST((row_number() OVER (ORDER BY l_returnflag, "
          f"{_LI_DIGEST}, l_orderkey, l_linenumber) - 1) % 5 AS INTEGER) AS fold FROM lineitem")
def q_folds_shuffled(spark, sf):
    return M.assign_folds(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), 5,
                          keys=["l_orderkey", "l_linenumber"], stratify="l_returnflag")


@register("fold_sizes", f"""WITH f AS ({ORACLE['folds_shuffled']})
SELECT l_returnflag, fold, CAST(count(*) AS BIGINT) AS n FROM f GROUP BY l_returnflag, fold""")
def q_fold_sizes(spark, sf):
    """Rows of each class in each fold: they differ by at most one."""
    return q_folds_shuffled(spark, sf).groupBy("l_returnflag", "fold").agg(F.count(F.lit(1)).alias("n"))


@register("split", f"SELECT l_orderkey, l_linenumber, CAST('0x' || substring({_LI_DIGEST}, 1, 8) AS BIGINT) / 4294967296.0 "
          f"< {M.TEST_FRACTION} AS is_test FROM lineitem")
def q_split(spark, sf):
    return M.train_test_split(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"),
                              ["l_orderkey", "l_linenumber"])


_LI_KIND = {"l_returnflag": True, "l_linestatus": True}


@register("detect_task", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, CAST(count(DISTINCT {c}) AS BIGINT) AS distinct, "
    f"CASE WHEN {'true' if c in _LI_KIND else 'false'} OR count(DISTINCT {c}) <= 20 THEN 'classification' "
    f"ELSE 'regression' END AS task FROM lineitem" for c in _LINEITEM_ALL))
def q_detect_task(spark, sf):
    return M.task_report(table(spark, sf, "lineitem"))


@register("label_encode", "SELECT l_orderkey, l_linenumber, l_returnflag, "
          "CAST(dense_rank() OVER (ORDER BY l_returnflag) - 1 AS DOUBLE) AS label FROM lineitem")
def q_label_encode(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    out, _labels = M.encode_label(li, "l_returnflag")
    return out


@register("label_encode_wide", "SELECT o_orderkey, clerk, CAST(dense_rank() OVER (ORDER BY c) - 1 AS DOUBLE) AS label FROM ("
          "SELECT *, coalesce(clerk, 'nan') AS c FROM (SELECT o_orderkey, CASE WHEN o_custkey % 10 <> 0 "
          "THEN 'c' || CAST(o_custkey AS VARCHAR) END AS clerk FROM orders))")
def q_label_encode_wide(spark, sf):
    """A label of thousands of classes with missing values: the codes come from a distributed dictionary."""
    clerk = F.when(F.col("o_custkey") % 10 != 0, F.concat(F.lit("c"), F.col("o_custkey").cast("string")))
    out, _labels = M.encode_label(table(spark, sf, "orders").select("o_orderkey", clerk.alias("clerk")), "clerk")
    return out


@register("label_encode_numeric", "SELECT l_orderkey, l_linenumber, q, CAST(dense_rank() OVER (ORDER BY coalesce(q, med)) - 1 AS DOUBLE) "
          "AS label FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 9 <> 0 THEN l_linenumber END AS q FROM lineitem), "
          "(SELECT quantile_cont(CASE WHEN l_orderkey % 9 <> 0 THEN l_linenumber END, 0.5) AS med FROM lineitem)")
def q_label_encode_numeric(spark, sf):
    """A numeric class: missing values take the median."""
    q = F.when(F.col("l_orderkey") % 9 != 0, F.col("l_linenumber"))
    out, _labels = M.encode_label(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", q.alias("q")), "q")
    return out


@register("category_dictionary", """
WITH v AS (SELECT DISTINCT p_brand AS value, 'p_brand' AS feature FROM part UNION SELECT DISTINCT p_type, 'p_type' FROM part
  UNION SELECT DISTINCT p_name, 'p_name' FROM part),
p AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS position FROM v WHERE value IS NOT NULL)
SELECT feature, value, CAST(position AS BIGINT) AS position FROM p""")
def q_category_dictionary(spark, sf):
    part = table(spark, sf, "part").select("p_name", "p_brand", "p_type")
    d, _sizes = M.category_dictionary(part, part.columns)
    return d.select("feature", "value", "position")


def labelled_documents(spark, sf):
    return table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars"),
                                           "doc_id")


@register("classification_metrics", """
WITH p AS (SELECT l.quality AS y, CASE WHEN d.lang = 'en' THEN 1 ELSE 0 END AS p, CAST(d.n_chars AS DOUBLE) AS s
           FROM labels l JOIN documents d USING (doc_id)),
conf AS (SELECT y, p, count(*) AS n FROM p GROUP BY y, p),
sup AS (SELECT y AS c, sum(n) AS support FROM conf GROUP BY y),
prd AS (SELECT p AS c, sum(n) AS predicted FROM conf GROUP BY p),
tp AS (SELECT y AS c, n AS tp FROM conf WHERE y = p),
per AS (SELECT c, support, coalesce(predicted, 0) AS predicted, coalesce(tp, 0) AS tp
        FROM sup LEFT JOIN prd USING (c) LEFT JOIN tp USING (c)),
m AS (SELECT sum(tp) / sum(support) AS accuracy,
        sum(CASE WHEN support + predicted > 0 THEN 2.0 * tp / (support + predicted) ELSE 0 END * support) / sum(support) AS f1
      FROM per),
g AS (SELECT s, count_if(y = 1) AS pos, count_if(y <> 1) AS neg FROM p GROUP BY s),
g2 AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below FROM g)
SELECT 'accuracy' AS metric, round(accuracy, 4) AS value FROM m
UNION ALL SELECT 'f1', round(f1, 4) FROM m
UNION ALL SELECT 'roc_auc', round(sum(pos * (neg_below + 0.5 * neg)) / (sum(pos) * sum(neg)), 4) FROM g2""")
def q_class_metrics(spark, sf):
    d = labelled_documents(spark, sf).select(F.col("quality").alias("label"),
                                             F.when(F.col("lang") == "en", 1).otherwise(0).alias("prediction"),
                                             F.col("n_chars").cast("double").alias("score"))
    return M.classification_metrics(d, score="score")


@register("regression_metrics", """
WITH r AS (SELECT sum(l_extendedprice) / sum(l_quantity) AS unit FROM lineitem),
p AS (SELECT l_extendedprice AS y, l_quantity * unit AS p FROM lineitem, r)
SELECT round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae,
  round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)), 4) AS r2 FROM p""")
def q_reg_metrics(spark, sf):
    li = table(spark, sf, "lineitem")
    unit = li.agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("u")).first()["u"]
    pred = li.select(F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * F.lit(unit)).alias("prediction"))
    return M.regression_metrics(pred)


@register("compare_classifiers")
def q_compare_cls(spark, sf):
    res, _best, _models, _feat = M.compare_models(labelled_documents(spark, sf).drop("toxic"), "quality", ["doc_id"])
    return res


def _compare_parts(spark, sf, cv_folds: int = M.FOLDS):
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
    return M.compare_models(p, "p_retailprice", ["p_partkey"], order_by="p_partkey", cv_folds=cv_folds)


@register("compare_regressors")
def q_compare_reg(spark, sf):
    res, _best, _models, _feat = _compare_parts(spark, sf)
    return res


@register("model_comparison")
def q_model_comparison(spark, sf):
    res, _best, _models, _feat = _compare_parts(spark, sf, cv_folds=0)  # shows the test scores only
    return M.comparison_frame(res)


@register("feature_importance")
def q_importance(spark, sf):
    _res, best, models, feat = _compare_parts(spark, sf, cv_folds=0)
    pairs = M.feature_importance(models[best], feat.names) if best else []
    return spark.createDataFrame([(best, n, v) for n, v in pairs], "model string, feature string, importance double")


def _mlp(spark, sf):
    return NN.train_mlp(labelled_documents(spark, sf).drop("toxic"), "quality", ["doc_id"])


@register("mlp_classifier")
def q_mlp(spark, sf):
    return _mlp(spark, sf).metrics


@register("training_history")
def q_history_loss(spark, sf):
    return _mlp(spark, sf).history


_AUC_SQL = " UNION ALL ".join(
    f"SELECT {c} AS c, sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)) AS auc FROM (SELECT *, coalesce(sum(neg) OVER "
    f"(ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT s{c} AS s, "
    f"CAST(count_if(y = {c}) AS DOUBLE) AS pos, CAST(count_if(y <> {c}) AS DOUBLE) AS neg FROM p GROUP BY s{c}))" for c in range(3))


@register("roc_auc_classes", "WITH p AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y, "
          "CAST(l_quantity AS DOUBLE) AS s0, CAST(l_discount * l_quantity AS DOUBLE) AS s1, CAST(l_tax AS DOUBLE) AS s2 FROM lineitem)\n"
          f"SELECT round(avg(auc), 4) AS roc_auc FROM ({_AUC_SQL})")
def q_roc_auc_classes(spark, sf):
    """Three classes, a score for each: the mean of the one-vs-rest areas."""
    y = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    s = F.array("l_quantity", F.col("l_discount") * F.col("l_quantity"), "l_tax").cast("array<double>")
    return M.roc_auc_macro(table(spark, sf, "lineitem").select(y.alias("y"), s.alias("s")), "y", "s", 3)


# ------------------------------------------------------------ sources/catalog
from ..sources import files as S  # noqa: E402
from ..sources.catalog import Catalog  # noqa: E402
from . import report as RP  # noqa: E402


@register("read_csv_roundtrip", "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, "
          "c_mktsegment FROM customer")
def q_csv(spark, sf):
    path = scratch_path(spark, "customer-csv")
    table(spark, sf, "customer").write.option("header", True).csv(path)
    return S.read_csv(spark, path)


@register("union_fragments", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer "
          "WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING')\n"
          "UNION ALL SELECT c_custkey, c_name, c_nationkey, NULL, c_mktsegment FROM customer "
          "WHERE c_mktsegment IN ('FURNITURE', 'HOUSEHOLD')\n"
          "UNION ALL SELECT c_custkey, NULL, NULL, c_acctbal, c_mktsegment FROM customer WHERE c_mktsegment = 'MACHINERY'")
def q_fragments(spark, sf):
    c = table(spark, sf, "customer")
    seg = F.col("c_mktsegment")
    frames = [c.where(seg.isin("AUTOMOBILE", "BUILDING")),
              c.where(seg.isin("FURNITURE", "HOUSEHOLD")).drop("c_acctbal"),
              c.where(seg == "MACHINERY").select("c_custkey", "c_acctbal", "c_mktsegment"),
              c.where(seg == "NO SUCH SEGMENT")]
    return S.union_fragments(frames).select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@register("content_hash")
def q_hash(spark, sf):
    return S.content_hash(spark, sf, "*.parquet").drop("path")


def _qa_frame(spark, sf):
    """User questions with the assistant reply that follows them (S13 input).

    The next message is found by position: exact in-conversation positions from
    range slices, then a join on (conversation, position) - a long conversation
    is never gathered in one task."""
    from ..functions.stats import row_positions
    pos = row_positions(table(spark, sf, "conversations"), ["conv_id"], ["turn"], out="pos")
    nxt = pos.select("conv_id", (F.col("pos") - 1).alias("pos"), F.col("role").alias("next_role"),
                     F.col("text").alias("next_text"))
    m = pos.join(nxt, ["conv_id", "pos"], "left")
    return m.where(F.col("role") == "user").select(
        F.col("conv_id").cast("string").alias("session_id"), F.lit(None).cast("bigint").alias("dataset_id"),
        F.col("text").alias("question"),
        F.when(F.col("next_role") == "assistant", F.col("next_text")).alias("answer"),
        RO.route(F.col("text")).alias("agent"), "conv_id", "turn")


@register("history_topk", f"""
WITH m AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text
           FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
qa AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, conv_id, turn, text AS question,
         CASE WHEN next_role = 'assistant' THEN next_text END AS answer, {_route_sql('text')} AS agent
       FROM m WHERE role = 'user'),
h AS (SELECT row_number() OVER (ORDER BY conv_id, turn) AS id, * FROM qa)
SELECT CAST(id AS BIGINT) AS id, session_id, question, answer, agent FROM
  (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id DESC) AS rn FROM h) WHERE rn <= 20""")
def q_history_topk(spark, sf):
    cat = Catalog(spark, scratch_path(spark, "catalog"))
    cat.bootstrap()
    cat.save_queries(_qa_frame(spark, sf), ["conv_id", "turn"])
    return cat.get_history().select("id", "session_id", "question", "answer", "agent")


def _catalog_sql() -> str:
    from .fixtures import TABLES
    parts = [f"SELECT CAST({i + 1} AS BIGINT) AS id, '{t}' AS name, 'parquet' AS file_type, "
             f"CAST(count(*) AS BIGINT) AS rows, CAST((SELECT count(*) FROM (DESCRIBE {t})) AS BIGINT) AS columns "
             f"FROM {t}" for i, t in enumerate(TABLES)]
    return "\nUNION ALL\n".join(parts)


@register("catalog_datasets", _catalog_sql())
def q_catalog(spark, sf):
    import os
    cat = Catalog(spark, scratch_path(spark, "catalog"))
    cat.bootstrap()
    hashes = {r["file"]: r["hash"] for r in S.content_hash(spark, sf, "*.parquet").collect()}  # one row per file
    from .fixtures import TABLES
    entries = []
    for name in TABLES:  # one small entry per driver table
        df = table(spark, sf, name)
        f = f"{name}.parquet"
        entries.append((name, "parquet", df.count(), len(df.columns), os.path.join(sf, f), hashes.get(f)))
    cat.register_datasets(entries)
    return cat.list_datasets().select("id", "name", "file_type", "rows", "columns")


def _model_runs_sql() -> str:
    base = ORACLE["classification_metrics"]
    return ("WITH cm AS (" + base + ")\n"
            "SELECT CAST(1 AS BIGINT) AS id, 'rule: lang = en' AS model_type, 'classification' AS task, "
            "'quality' AS target_column, max(CASE WHEN metric = 'accuracy' THEN value END) AS accuracy, "
            "max(CASE WHEN metric = 'f1' THEN value END) AS f1, "
            "max(CASE WHEN metric = 'roc_auc' THEN value END) AS roc_auc FROM cm")


@register("model_runs", _model_runs_sql())
def q_model_runs(spark, sf):
    cat = Catalog(spark, scratch_path(spark, "catalog"))
    cat.bootstrap()
    d = labelled_documents(spark, sf).select(F.col("quality").alias("label"),
                                             F.when(F.col("lang") == "en", 1).otherwise(0).alias("prediction"),
                                             F.col("n_chars").cast("double").alias("score"))
    m = M.classification_metrics(d, score="score").agg(F.map_from_entries(
        F.collect_list(F.struct("metric", "value"))).alias("metrics"))
    runs = m.select(F.lit(None).cast("bigint").alias("dataset_id"), F.lit("rule: lang = en").alias("model_type"),
                    F.lit("classification").alias("task"), F.lit("quality").alias("target_column"), "metrics",
                    F.create_map(F.lit("rule"), F.lit("lang = en")).alias("params"))
    cat.save_model_runs(runs)
    return cat.list_model_runs().select("id", "model_type", "task", "target_column",
                                        F.col("metrics")["accuracy"].alias("accuracy"),
                                        F.col("metrics")["f1"].alias("f1"), F.col("metrics")["roc_auc"].alias("roc_auc"))


@register("report_paragraphs", "SELECT doc_id, paragraph_no, paragraph FROM (SELECT doc_id, "
          "CAST(generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS INTEGER) AS paragraph_no, "
          f"regexp_replace(unnest(string_split(text, chr(10) || chr(10))), '{STRIP_PATTERN}', '', 'g') AS paragraph "
          "FROM documents) WHERE length(paragraph) > 0")
def q_paragraphs(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return RP.report_paragraphs(d, key="doc_id", content="text")


_CLEAN_KEPT = ["o_orderkey", "o_custkey", "o_totalprice", "o_size_txt", "o_rare"]
_REPORT_PARTS = f"""WITH rep AS ({ORACLE['validate_orders']}),
warn AS ({ORACLE['validation_warnings']}),
chg AS ({ORACLE['change_log']}),
cf AS ({ORACLE['clean_full']}),
dirty AS ({with_dirty('SELECT count(*) AS n FROM dirty_orders')}),
tr AS ({_trend_sql('cf', 'o_orderkey', _CLEAN_KEPT)}),
cm AS ({_corr_matrix_sql('cf', _CLEAN_KEPT)}),
{_signals_sql('cf', _CLEAN_KEPT)}"""
_REPORT_HEAD, _REPORT_SIGNALS = _REPORT_PARTS.split("\nSELECT CAST(row_number", 1)


@register("report_sections", _REPORT_HEAD + f""",
sig AS (SELECT CAST(row_number{_REPORT_SIGNALS})
SELECT CAST(1 AS INTEGER) AS section_no, '{RP.HEADINGS['ingestion']}' AS heading, 'File: orders.parquet  |  Rows: ' || n_rows || '  |  Columns: '
  || n_columns || '  |  Missing: ' || missing_pct || '%' || chr(10) || chr(10)
  || coalesce((SELECT string_agg(warning, chr(10) ORDER BY warning_no) FROM warn), 'No warnings.') AS content FROM rep
UNION ALL SELECT 2, '{RP.HEADINGS['cleaning']}', 'Shape before: (' || (SELECT n FROM dirty) || ', {len(DIRTY_COLS)})  →  after: ('
  || (SELECT count(*) FROM cf) || ', 12)' || chr(10) || chr(10) || 'Changes:' || chr(10)
  || (SELECT string_agg('• ' || message, chr(10) ORDER BY step_no) FROM chg)
UNION ALL SELECT 3, '{RP.HEADINGS['eda']}', 'Trends:' || chr(10)
  || coalesce((SELECT string_agg('- ' || message, chr(10) ORDER BY position) FROM tr WHERE message IS NOT NULL), 'No trends.')
  || chr(10) || chr(10) || 'Strongest correlations:' || chr(10) || coalesce((SELECT string_agg('- ' || col1 || ' / ' || col2 || ': '
  || printf('%.4f', corr), chr(10) ORDER BY abs(corr) DESC, col1, col2) FROM cm WHERE i < j AND corr IS NOT NULL), 'None.')
UNION ALL SELECT 4, '{RP.HEADINGS['insight']}', (SELECT string_agg(signal, chr(10) ORDER BY signal_no) FROM sig)""")
def q_report_sections(spark, sf):
    from .pipeline import run_pipeline
    res = run_pipeline(dirty_orders(spark, sf), {"file_name": "orders.parquet", "order_by": "o_orderkey"})
    return res["report"]


@register("report_kpis", f"SELECT kpi_no, label, value FROM ({ORACLE['kpis']}) WHERE kpi_no <= {RP.REPORT_KPIS}")
def q_report_kpis(spark, sf):
    return RP.report_kpis(I.kpis(table(spark, sf, "lineitem")))


def _insight_sql() -> str:
    """KPI lines, signal lines, then count, unique and top of every column that has them."""
    sig = _signals_full([], "lineitem", LINEITEM_NUM)
    text = [c for c in ("l_returnflag", "l_linestatus")]
    lines = [f"SELECT {i} AS no, '{c} count ' || count({c}) AS line FROM lineitem" for i, c in enumerate(_LINEITEM_ALL) if c in LINEITEM_NUM + text]
    for c in text:
        i = _LINEITEM_ALL.index(c)
        lines.append(f"SELECT {100 + i}, '{c} unique ' || count(DISTINCT {c}) FROM lineitem")
        lines.append(f"SELECT {200 + i}, '{c} top ' || v FROM (SELECT {c} AS v FROM lineitem WHERE {c} IS NOT NULL GROUP BY {c} "
                     f"ORDER BY count(*) DESC, {c} LIMIT 1)")
    return (f"WITH k AS ({ORACLE['kpis']}), g AS ({sig}), d AS ({' UNION ALL '.join(lines)})\n"
            "SELECT 'KPIs:' || chr(10) || (SELECT string_agg('- ' || label || ': ' || value || CASE WHEN delta <> '' THEN ' (' || delta || ')' "
            "ELSE '' END, chr(10) ORDER BY kpi_no) FROM k) || chr(10) || chr(10) || 'Signals:' || chr(10) || "
            "(SELECT string_agg('- ' || signal, chr(10) ORDER BY signal_no) FROM g) || chr(10) || chr(10) || 'Statistics:' || chr(10) || "
            "(SELECT string_agg(line, chr(10) ORDER BY no) FROM d) AS context")


@register("insight_context", _insight_sql())
def q_insight_context(spark, sf):
    return I.insight_context(table(spark, sf, "lineitem"))


@register("content_hash_text", "SELECT lang, substring(sha256(string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id)), 1, 12) AS hash "
          "FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def q_hash_text(spark, sf):
    """Hashes of the text written by language, each a run of files in the order of the documents."""
    folder = scratch_path(spark, "documents-lang")
    # a language that cannot be null keeps the order of the rows in Spark's writer, which sorts others anew
    docs = table(spark, sf, "documents").where("lang IS NOT NULL").select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    (docs.repartitionByRange("lang", "doc_id").sortWithinPartitions("lang", "doc_id").select("lang", "text")
     .write.partitionBy("lang").text(folder))
    return S.parts_hash(spark, folder, "lang")


@register("read_sqlite_roundtrip", "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, "
          "c_mktsegment FROM customer")
def q_sqlite(spark, sf):
    from ..sources.sqlite import read_sqlite, write_sqlite_shards
    folder = scratch_path(spark, "customer-sqlite")
    write_sqlite_shards(table(spark, sf, "customer"), folder, "customer").collect()  # one row per shard
    return read_sqlite(spark, folder, "customer")


@register("list_tables", "SELECT DISTINCT 'customer' AS name FROM customer")
def q_list_tables(spark, sf):
    from ..sources.sqlite import list_tables, write_sqlite_shards
    folder = scratch_path(spark, "customer-sqlite")
    write_sqlite_shards(table(spark, sf, "customer"), folder, "customer").collect()  # one row per shard
    return list_tables(spark, folder).distinct()


@register("read_text_roundtrip", "SELECT doc_id, text || chr(10) AS text FROM documents")
def q_text_roundtrip(spark, sf):
    folder = scratch_path(spark, "documents-text")
    # one text file per document, a newline behind each text
    S.write_text_documents(table(spark, sf, "documents"), folder, "doc_id", "text")
    docs = S.read_text_documents(spark, folder, "doc_id")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
