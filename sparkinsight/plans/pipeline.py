"""Step dispatch and the composed run.

A request is routed to one of eight steps (R1 -> R3).  ``run_pipeline`` runs a chain of
them over one input: cleaning feeds the later steps, a failing step becomes an ``error``
entry and the run goes on, and the report step turns what there is into sections.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cleaning, documents, eda, models, neural, profile, retrieval, sequence, signals
from ..session import materialize
from . import report as R

StepFn = Callable[[DataFrame, dict], dict]
CHAIN = ("ingestion", "cleaning", "eda", "insight")


def _ingestion(df, cfg):
    rep = profile.validate(df)
    name = cfg.get("file_name", "input")
    return {"report": rep, "warnings": profile.validation_warnings(rep), "summary": profile.ingestion_summary(rep, name),
            "section": R.ingestion_section(rep, name)}


def _cleaning(df, cfg):
    out, log = cleaning.clean(df, cleaning.CleanConfig(**cfg.get("clean", {})))
    out = materialize(out)  # every later step reads it, most of them more than once
    return {"frame": out, "log": log, "section": R.cleaning_section(log, df, out)}


def _eda(df, cfg):
    out = eda.eda(df, cfg["order_by"])
    return {**out, "section": R.eda_section(out["trends"], out["top_pairs"])}


def _target(df, cfg):
    return cfg.get("target") or profile.infer_target(df)


def _ml(df, cfg):
    target = _target(df, cfg)
    results, best, fitted, feat = models.compare_models(
        df, target, cfg["keys"], cv_folds=cfg.get("cv_folds", models.FOLDS), order_by=cfg.get("order_by"),
        catalog=cfg.get("catalog"), dataset_id=cfg.get("dataset_id"))
    return {"results": results, "best": best, "models": fitted, "features": feat,
            "section": R.ml_section(results, feat.task, best)}


def _dl(df, cfg):
    """``dl_mode`` mlp: the network on the table; forecast: the lag model of the target in ``order_by`` order."""
    target = _target(df, cfg)
    if cfg.get("dl_mode", "mlp") == "forecast":
        _models, pred, metrics = sequence.forecast_validation(df, target, cfg["order_by"], cfg.get("series"))
        return {"metrics": metrics, "predictions": pred, "section": R.dl_section(metrics, "Lag model", "time_series_forecast")}
    net = neural.train_mlp(df, target, cfg["keys"], epochs=cfg.get("epochs", neural.EPOCHS))
    wide = net.metrics
    if "metric" in wide.columns:  # (metric, value) rows of a classifier as one row
        wide = wide.groupBy().pivot("metric", ["accuracy", "f1"]).agg(F.first("value"))
    return {"metrics": wide, "history": net.history, "section": R.dl_section(wide, "MLP", net.task)}


def _rag(df, cfg):
    """Answers ``questions`` (query_id, question) from the documents (``doc_id``, ``source``, ``text``) in
    ``cfg['documents']``, or from ``df``: chunks, TF-IDF weights, exact top-k, prompt frames."""
    docs = cfg.get("documents", df).select("doc_id", "source", "text")
    chunks = documents.chunk_ids(documents.chunk_text(docs)).select("id", "doc_id", "source", "chunk", "text")
    store = documents.upsert_chunks(None, chunks, "doc_id")
    tf = retrieval.term_frequencies(store, "id", "text")
    idf = retrieval.fit_idf(tf, "id")
    questions = cfg["questions"].select("query_id", "question")
    asked = retrieval.tfidf_weights(retrieval.term_frequencies(questions, "query_id", "question"), idf, "query_id")
    hits = retrieval.retrieve_sparse(asked, retrieval.tfidf_weights(tf, idf, "id"), k=cfg.get("k", retrieval.TOP_K))
    rows = hits.join(store.select("id", "source", "chunk", "text"), "id")
    return {"hits": hits, "prompts": documents.prompt_frame(questions, rows)}


def _insight(df, cfg):
    found = signals.signals(df)
    return {"kpis": signals.kpis(df), "signals": found, "section": R.insight_section(found)}


def _report(df, cfg):
    """Sections and KPI cards of the results so far (``cfg['results']``), written where ``report_path`` says."""
    results = cfg.get("results", {})
    sections = R.report_sections(df.sparkSession, {k: v["section"] for k, v in results.items() if "section" in v})
    out = {"sections": sections, "kpis": R.report_kpis(results["insight"]["kpis"]) if "kpis" in results.get("insight", {}) else None}
    if cfg.get("report_path"):
        out["path"] = R.write_report(sections, cfg["report_path"], cfg.get("title", "Report"))
        if cfg.get("catalog") is not None:
            out["report_id"] = cfg["catalog"].record_report(cfg.get("dataset_id"), out["path"])
    return out


STEPS: dict[str, StepFn] = {
    "ingestion": _ingestion,
    "cleaning": _cleaning,
    "eda": _eda,
    "ml": _ml,
    "dl": _dl,
    "rag": _rag,
    "insight": _insight,
    "report": _report,
}


def run_step(name: str, df: DataFrame, cfg: dict | None = None) -> dict | None:
    """Run the named step; an unknown name ends the run (returns None)."""
    fn = STEPS.get(name)
    return None if fn is None else fn(df, cfg or {})


def run_pipeline(df: DataFrame, cfg: dict, steps=CHAIN) -> dict:
    """Run the steps in order, then the report over all of them; errors are recorded per step."""
    results: dict = {}
    current = df
    for name in [s for s in steps if s != "report"]:
        try:
            res = run_step(name, current, {**cfg, "results": results})
        except Exception as e:  # noqa: BLE001 - a failing step is reported, the run goes on
            results[name] = {"error": str(e)}
            continue
        if res is None:
            break
        results[name] = res
        if name == "cleaning":
            current = res["frame"]
    done = _report(df, {**cfg, "results": results})
    results["report"] = done["sections"]
    results["report_kpis"] = done["kpis"]
    return results
