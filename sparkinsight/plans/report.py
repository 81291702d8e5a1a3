"""Report frames (R5-R8): ordered sections, KPI cards, paragraphs, and the writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.profile import warning_array

# Report headings and fallback text.
HEADINGS = {
    "ingestion": "Data Ingestion Summary",
    "cleaning": "Data Cleaning",
    "eda": "Exploratory Data Analysis",
    "ml": "Machine Learning Results",
    "dl": "Deep Learning Results",
    "insight": "Business Insights & Recommendations",
}
FALLBACK = ("Report", "No analysis results available yet.")
REPORT_KPIS = 6


def ingestion_section(report: DataFrame, file_name: str) -> DataFrame:
    w = F.array_join(warning_array(), "\n")
    return report.select(F.concat(
        F.lit(f"File: {file_name}  |  Rows: "), F.col("n_rows").cast("string"),
        F.lit("  |  Columns: "), F.col("n_columns").cast("string"),
        F.lit("  |  Missing: "), F.col("missing_pct").cast("string"), F.lit("%\n\n"),
        F.coalesce(F.nullif(w, F.lit("")), F.lit("No warnings."))).alias("content"))


def _shape(df: DataFrame, name: str) -> DataFrame:
    """One row: the text ``(rows, columns)``."""
    return df.agg(F.format_string(f"(%d, {len(df.columns)})", F.count(F.lit(1))).alias(name))


def _joined(frame: DataFrame, order: str, line: Column, sep: str = "\n") -> DataFrame:
    """One row ``m``: the lines of a small frame (a few rows per column) in their order; NULL without any."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line"))))
    return frame.agg(F.nullif(F.array_join(F.transform(parts, lambda s: s["line"]), sep), F.lit("")).alias("m"))


def cleaning_section(log: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    one = _joined(log, "step_no", F.concat(F.lit("• "), F.col("message")))
    one = one.join(F.broadcast(_shape(before, "b"))).join(F.broadcast(_shape(after, "a")))
    return one.select(F.concat(F.lit("Shape before: "), F.col("b"), F.lit("  →  after: "), F.col("a"), F.lit("\n\nChanges:\n"),
                               F.coalesce("m", F.lit(""))).alias("content"))


def eda_section(trends: DataFrame, pairs: DataFrame) -> DataFrame:
    """The trend messages, then the strongest correlations (stated facts; no text is generated)."""
    t = _joined(trends.where(F.col("message").isNotNull()), "position", F.concat(F.lit("- "), F.col("message")))
    p = pairs.where(F.col("corr").isNotNull()).select(
        "col1", "col2", "corr", F.struct((-F.abs("corr")).alias("k"), "col1", "col2").alias("o"))
    c = _joined(p, "o", F.concat(F.lit("- "), F.col("col1"), F.lit(" / "), F.col("col2"), F.lit(": "), F.format_string("%.4f", F.col("corr"))))
    both = t.join(F.broadcast(c.withColumnRenamed("m", "c")))
    return both.select(F.concat(F.lit("Trends:\n"), F.coalesce("m", F.lit("No trends.")), F.lit("\n\nStrongest correlations:\n"),
                                F.coalesce("c", F.lit("None."))).alias("content"))


def ml_section(results: DataFrame, task: str, best: str | None) -> DataFrame:
    told = results.where((F.col("metric") != "error") & ~F.col("metric").startswith("cv_fold_") & F.col("value").isNotNull())
    per = (told.groupBy("model").agg(F.array_join(F.transform(
               F.array_sort(F.collect_list(F.struct("metric", "value"))),
               lambda s: F.concat(s["metric"], F.lit("="), s["value"].cast("string"))), ", ").alias("m")))
    one = _joined(per, "model", F.concat(F.lit("**"), F.col("model"), F.lit("**: "), F.col("m")))
    return one.select(F.concat(F.lit(f"Task: {task}  |  Best Model: {best}\n\n"), F.coalesce("m", F.lit(""))).alias("content"))


def dl_section(metrics: DataFrame, model: str, task: str) -> DataFrame:
    """One line per metric; a metrics frame of many series gives their lines in the order of the series."""
    keys = [c for c in metrics.columns if c not in ("accuracy", "f1", "rmse", "mae", "r2")]
    cells = [F.concat(F.lit("• "), *[x for k in keys for x in (F.coalesce(F.col(k).cast("string"), F.lit("")), F.lit(" "))],
                      F.lit(f"{c}: "), F.col(c).cast("string")) for c in metrics.columns if c not in keys]
    rows = metrics.withColumn("__o", F.struct(*keys) if keys else F.lit(0)).withColumn("__m", F.concat_ws("\n", *cells))
    one = _joined(rows, "__o", F.col("__m"))
    return one.select(F.concat(F.lit(f"Model: {model}  |  Task: {task}\n\n"), F.coalesce("m", F.lit(""))).alias("content"))


def insight_section(signals: DataFrame) -> DataFrame:
    return _joined(signals, "signal_no", F.col("signal")).select(F.coalesce("m", F.lit("")).alias("content"))


def report_sections(spark: SparkSession, parts: dict[str, DataFrame]) -> DataFrame:
    """(section_no, heading, content) in the fixed order, present parts only;
    the fallback section when none is present."""
    frames = []
    for key in ["ingestion", "cleaning", "eda", "ml", "dl", "insight"]:
        if key in parts and parts[key] is not None:
            frames.append(parts[key].select(F.lit(HEADINGS[key]).alias("heading"), "content"))
    if not frames:
        return spark.createDataFrame([(1, *FALLBACK)], "section_no int, heading string, content string")
    out = None
    for i, f in enumerate(frames):
        f = f.select(F.lit(i + 1).alias("section_no"), "heading", "content")
        out = f if out is None else out.unionByName(f)
    return out


def report_kpis(kpis: DataFrame, n: int = REPORT_KPIS) -> DataFrame:
    return kpis.where(F.col("kpi_no") <= n).select("kpi_no", "label", "value")


def report_paragraphs(sections: DataFrame, key: str = "section_no", content: str = "content") -> DataFrame:
    """Split on blank lines, strip, drop empty paragraphs."""
    return (sections.select(key, F.posexplode(F.split(F.col(content), "\n\n")).alias("pos", "p"))
            .select(key, (F.col("pos") + 1).alias("paragraph_no"), strip(F.col("p")).alias("paragraph"))
            .where(F.length("paragraph") > 0))


def write_report(sections: DataFrame, path: str, title: str, kind: str = "full") -> str:
    """Markdown lines, written as one ordered text file (a report has few rows).

    ``full`` holds the sections whole, ``summary`` the first paragraph of each.
    """
    body = sections if kind == "full" else sections.withColumn("content", F.split("content", "\n\n")[0])
    lines = body.select(F.col("section_no"), F.concat(F.lit("## "), F.col("heading"), F.lit("\n\n"),
                                                     F.col("content"), F.lit("\n")).alias("value"))
    head = sections.sparkSession.createDataFrame([(0, f"# {title}\n")], "section_no int, value string")
    head.unionByName(lines).orderBy("section_no").select("value").coalesce(1).write.mode("overwrite").text(path)
    return path
