"""Statistics building blocks.

``quantiles`` is a fit helper that returns a few numbers per column: exact linear-interpolated quantiles (the pandas /
numpy default).  A mergeable sketch brackets every wanted rank in one scan, and a
counting scan settles it from the few values inside the bracket; brackets of very
large tables are narrowed by further sketches first, a hundredfold each time.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import named

# Quantile sketches (Spark's KLL aggregate): their size, and the share of the rows a bracket
# leaves on each side of the rank looked for (above the error of such a sketch, 0.24 %).
SKETCH_K = 2048
SKETCH_SLACK = 0.003
# Sketches of tasks are merged in this many groups first, then in one.
MERGE_GROUPS = 64
# A bracket with more values inside than this is narrowed before its values are read back.
BRACKET_LIMIT = 20_000


def _interpolate(lo_v: float, hi_v: float, pos: float) -> float:
    lower, higher = math.floor(pos), math.ceil(pos)
    if lower == higher:
        return float(lo_v)
    return (higher - pos) * lo_v + (pos - lower) * hi_v


def number(c: str) -> Column:
    """``c`` as a double with NaN as missing (pandas makes no difference between them)."""
    x = named(c).cast("double")
    return F.when(~F.isnan(x), x)


@dataclass
class Bracket:
    """Two values of a column with the ranks ``want`` between them; about ``held`` values lie strictly inside."""

    column: str
    lo: float
    hi: float
    want: list[int]
    held: float


def quantiles(df: DataFrame, cols: list[str], probs: list[float], limit: int = BRACKET_LIMIT,
              sketch_k: int = SKETCH_K, slack: float = SKETCH_SLACK) -> dict[str, list[float | None]]:
    """Exact linear quantiles of each column over its values that are not NULL or NaN.

    One scan sketches every column, which gives each wanted rank a bracket of two values;
    the next one settles the ranks (``_settle``).
    """
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in cols}
    if not cols:
        return out
    src = df.select(*[number(c).alias(f"x{i}") for i, c in enumerate(cols)])
    wide = [x for p in probs for x in (max(0.0, p - slack), min(1.0, p + slack))]
    told = _sketched(src, {f"x{i}": F.col(f"x{i}") for i in range(len(cols))}, sketch_k, wide)
    counts, ends, brackets = {}, {}, []
    for i in range(len(cols)):
        x = f"x{i}"
        n, lo, hi, q = told[x]
        counts[x], ends[x] = n, (lo, hi)
        for k, p in enumerate(probs if n else []):
            want = sorted({math.floor((n - 1) * p), math.ceil((n - 1) * p)})
            a, b = (lo if wide[2 * k] == 0.0 else q[2 * k]), (hi if wide[2 * k + 1] == 1.0 else q[2 * k + 1])
            brackets.append(Bracket(x, a, b, want, 2 * slack * n))
    found = _settle(src, brackets, counts, ends, limit, sketch_k, slack)
    for i, c in enumerate(cols):
        n = counts[f"x{i}"]
        if n:
            out[c] = [_interpolate(found[f"x{i}", math.floor((n - 1) * p)], found[f"x{i}", math.ceil((n - 1) * p)],
                                   (n - 1) * p) for p in probs]
    return out


def _sketched(src: DataFrame, values: dict, sketch_k: int, fractions: list[float]) -> dict[str, tuple]:
    """(count, min, max, values at ``fractions``) of each expression, from one scan and mergeable sketches.

    Sketches are merged per group of tasks first, so no task merges those of all tasks.
    """
    names = list(values)
    group = F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)).alias("__g")
    part = src.groupBy(group).agg(*[e for i, x in enumerate(names) for e in (
        F.count(values[x]).alias(f"n{i}"), F.min(values[x]).alias(f"lo{i}"), F.max(values[x]).alias(f"hi{i}"),
        F.kll_sketch_agg_double(values[x], F.lit(sketch_k)).alias(f"s{i}"))])
    whole = part.agg(*[e for i in range(len(names)) for e in (
        F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias(f"n{i}"), F.min(f"lo{i}").alias(f"lo{i}"), F.max(f"hi{i}").alias(f"hi{i}"),
        F.kll_merge_agg_double(F.when(F.col(f"n{i}") > 0, F.col(f"s{i}"))).alias(f"s{i}"))])
    at = F.array(*[F.lit(float(x)) for x in fractions])
    row = whole.select(*[e for i in range(len(names)) for e in (f"n{i}", f"lo{i}", f"hi{i}", F.when(
        F.col(f"n{i}") > 0, F.kll_sketch_get_quantile_double(f"s{i}", at)).alias(f"q{i}"))]).first()
    return {x: (row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"], row[f"q{i}"]) for i, x in enumerate(names)}


def _settle(src: DataFrame, brackets: list[Bracket], counts: dict, ends: dict, limit: int, sketch_k: int,
            slack: float) -> dict[tuple[str, int], float]:
    """The values at the wanted ranks of every bracket, exactly.

    A scan counts the values below a bracket and on its two ends and reads back the few
    inside.  A bracket with more than ``limit`` values inside is sketched instead and
    narrowed; one that missed a rank (a sketch may err) goes on between it and the column's end.
    """
    found: dict[tuple[str, int], float] = {}
    grid = [k / 512 for k in range(513)]
    while brackets:
        inside = [F.when((F.col(b.column) > F.lit(b.lo)) & (F.col(b.column) < F.lit(b.hi)), F.col(b.column)) for b in brackets]
        aggs = []
        for k, b in enumerate(brackets):
            x = F.col(b.column)
            aggs += [F.count_if(x < F.lit(b.lo)).alias(f"b{k}"), F.count_if(x == F.lit(b.lo)).alias(f"l{k}"),
                     F.count_if(x == F.lit(b.hi)).alias(f"h{k}")]
            if b.held <= limit:
                aggs.append(F.collect_list(inside[k]).alias(f"v{k}"))
        row = src.agg(*aggs).first()
        wide = {str(k): inside[k] for k, b in enumerate(brackets) if b.held > limit}
        told = _sketched(src, wide, sketch_k, grid) if wide else {}
        left = []
        for k, b in enumerate(brackets):
            below, at_lo, at_hi = row[f"b{k}"], row[f"l{k}"], row[f"h{k}"] if b.hi > b.lo else 0
            values = sorted(row[f"v{k}"]) if b.held <= limit else None
            n = len(values) if values is not None else told[str(k)][0]
            less, more, open_ = [], [], []
            for r in b.want:
                at = r - below - at_lo
                if r < below:
                    less.append(r)
                elif at < 0:
                    found[b.column, r] = b.lo
                elif at >= n + at_hi:
                    more.append(r)
                elif at >= n:
                    found[b.column, r] = b.hi
                elif values is not None:
                    found[b.column, r] = values[at]
                else:
                    open_.append(r)
            first, last = ends[b.column]
            if less:
                left.append(Bracket(b.column, first, b.lo, less, below))
            if more:
                left.append(Bracket(b.column, b.hi, last, more, counts[b.column] - below))
            if open_:
                _, lo, hi, q = told[str(k)]
                f, g = ((open_[0] - below - at_lo) / n - slack) * 512, ((open_[-1] - below - at_lo) / n + slack) * 512
                a, z = (lo if f <= 0 else q[math.floor(f)]), (hi if g >= 512 else q[math.ceil(g)])
                # the ends are values inside, so every round leaves fewer
                left.append(Bracket(b.column, a, z, open_, n * ((g - f + 2) / 512 + slack)))
        brackets = left
    return found


def orderable_number(df: DataFrame, col: str):
    """A double Column that orders like ``col`` (dates and timestamps as epoch numbers)."""
    from pyspark.sql import types as T
    dt = df.schema[col].dataType
    if isinstance(dt, T.DateType):
        return F.unix_date(F.col(col)).cast("double")
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(col).cast("timestamp")).cast("double")
    return F.col(col).cast("double")


def order_statistics(df: DataFrame, col: str, ranks: list[int], limit: int = BRACKET_LIMIT) -> list[float | None]:
    """Exact k-th smallest non-null values (0-based ``ranks``) of ``col`` as numbers."""
    num = df.select(orderable_number(df, col).alias("x0")).where(F.col("x0").isNotNull())
    n, lo, hi, _ = _sketched(num, {"x0": F.col("x0")}, SKETCH_K, [0.5])["x0"]
    if not n:
        return [None] * len(ranks)
    brackets = [Bracket("x0", lo, hi, [r], n) for r in sorted(set(ranks))]
    found = _settle(num, brackets, {"x0": n}, {"x0": (lo, hi)}, limit, SKETCH_K, SKETCH_SLACK)
    return [found["x0", r] for r in ranks]


def running_sum_before(df: DataFrame, order_col: str, value_col: str, out: str, partitions: int | None = None):
    """Exclusive running sum of ``value_col`` in ``order_col`` order (distinct keys).

    Range partitions sum their own prefix; a per-partition total table (one row
    per partition) supplies the offsets.  No single task sees more than its slice.
    """
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    from ..session import materialize
    # fixed slices: both the prefix pass and the totals read the same partitions
    ranged = materialize(df.repartitionByRange(parts, order_col).withColumn("__pid", F.spark_partition_id()))
    w_in = Window.partitionBy("__pid").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("__local", F.coalesce(F.sum(value_col).over(w_in), F.lit(0)))
    totals = ranged.groupBy("__pid").agg(F.sum(value_col).alias("__tot"))
    w_off = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition: a bounded table, broadcast
    offsets = totals.withColumn("__off", F.coalesce(F.sum("__tot").over(w_off), F.lit(0))).select("__pid", "__off")
    return (local.join(F.broadcast(offsets), "__pid")
            .withColumn(out, F.col("__local") + F.col("__off")).drop("__pid", "__local", "__off"))


def row_positions(df: DataFrame, keys: list[str], order_cols: list[str], out: str = "pos",
                  total: str | None = None, partitions: int | None = None) -> DataFrame:
    """0-based position of each row within its key group in ``order_cols`` order
    (and, with ``total``, the group size), without gathering a group in one task.

    Rows are range-partitioned and sorted on (keys, order), so a large group is
    spread over consecutive partitions.  A summary with one row per (partition,
    key) gives each slice its offset; the join back is on (partition, key), so a
    hot key's rows stay spread over many tasks.
    """
    from ..session import materialize
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(parts, *keys, *order_cols).sortWithinPartitions(*keys, *order_cols)
                         .withColumn("__pid", F.spark_partition_id())
                         .withColumn("__mono", F.monotonically_increasing_id()))
    stats = ranged.groupBy("__pid", *keys).agg(F.min("__mono").alias("__first"), F.count(F.lit(1)).alias("__n"))
    by_key = Window.partitionBy(*keys).orderBy("__pid")
    offs = stats.withColumn("__off", F.coalesce(
        F.sum("__n").over(by_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if total:
        offs = offs.withColumn(total, F.sum("__n").over(Window.partitionBy(*keys)))
    offs = offs.drop("__n")
    if keys:  # a NULL key is a group of its own
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ["__pid", *keys]]
        extra = [F.col(f"b.{c}") for c in offs.columns if c not in ("__pid", *keys)]
        joined = ranged.alias("a").join(offs.alias("b"), same).select("a.*", *extra)
    else:
        joined = ranged.join(F.broadcast(offs), "__pid")  # one row per partition
    return (joined
            .withColumn(out, F.col("__off") + F.col("__mono") - F.col("__first"))
            .drop("__pid", "__mono", "__first", "__off"))


def ordered_slices(df: DataFrame, order_cols: list[str], partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows in range slices with ``__slice`` and their global 0-based position ``__at``,
    and a table (``__slice``, ``__start``, ``__rows``) with one row per slice that has rows."""
    from ..session import materialize
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(parts, *order_cols).sortWithinPartitions(*order_cols)
                         .withColumn("__slice", F.spark_partition_id())
                         .withColumn("__mono", F.monotonically_increasing_id()))
    stats = ranged.groupBy("__slice").agg(F.min("__mono").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    before = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = stats.withColumn("__start", F.coalesce(F.sum("__rows").over(before), F.lit(0)))  # one row per slice
    placed = ranged.join(F.broadcast(starts.select("__slice", "__start", "__first")), "__slice")
    placed = placed.withColumn("__at", F.col("__start") + F.col("__mono") - F.col("__first")).drop("__mono", "__first", "__start")
    return placed, starts.select("__slice", "__start", "__rows")
