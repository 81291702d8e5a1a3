"""Model comparison with ``pyspark.ml``.

Feature preparation, splits and folds are column expressions (hash-based, so a
row's split does not depend on partitioning and survives task retries); metrics
are aggregations over (label, prediction) pairs; estimators are MLlib's
distributed ones.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from contextlib import nullcontext
from dataclasses import dataclass, replace
from threading import Semaphore

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import number, quantiles, row_positions, running_sum_before
from ..schema import columns_of, kind_of, named
from ..session import materialize

# Modelling defaults.
CLASSIFICATION_MAX_DISTINCT = 20
TEST_FRACTION = 0.2
SEED = 42
FOLDS = 5
TREES = 100
BOOST_ROUNDS = 100
BOOST_DEPTH = 3
BOOST_STEP = 0.1
LOGISTIC_MAX_ITER = 1000
TREE_DEPTH = 10
TOP_FEATURES = 20
# Feature vectors up to this width are centred (and so dense) before a fit.
CENTRED_FEATURES = 1024
NULL_LABEL = "nan"
# Concurrent fold fits in cross-validation.
CV_PARALLELISM = 5
# Fits of a comparison that run side by side hold about this many rows together, but two run whatever their rows.
FIT_ROWS = 20_000_000
LEAST_FITS = 2
# Training frames are re-partitioned to about this many rows per task.
ROWS_PER_PARTITION = 200_000


# ------------------------------------------------------------------ M1/M2
def detect_task(df: DataFrame, target: str) -> str:
    if kind_of(df.schema[target].dataType) in ("categorical", "boolean"):
        return "classification"
    n = df.agg(F.count_distinct(named(target)).alias("n")).first()["n"]
    return "classification" if n <= CLASSIFICATION_MAX_DISTINCT else "regression"


def task_report(df: DataFrame) -> DataFrame:
    """(column, distinct, task) for every column taken as the target."""
    aggs = [F.count_distinct(named(c)).alias(f"d{i}") for i, c in enumerate(df.columns)]
    cells = []
    for i, c in enumerate(df.columns):
        is_text = kind_of(df.schema[c].dataType) in ("categorical", "boolean")
        task = F.when(F.lit(is_text) | (F.col(f"d{i}") <= CLASSIFICATION_MAX_DISTINCT), "classification") \
            .otherwise("regression")
        cells.append(F.struct(F.lit(c).alias("column"), F.col(f"d{i}").cast("bigint").alias("distinct"),
                              task.alias("task")))
    return df.agg(*aggs).select(F.inline(F.array(*cells)))


def label_codes(df: DataFrame, target: str) -> tuple[Column, DataFrame]:
    """(class of a row, table of ``__class`` and its code in sorted order).

    Classes of text and booleans are their text, NULL the class ``nan``; numbers are classes
    in numeric order, NULL and NaN take the median.  The table is distributed: its positions
    come from range slices, so a target of any width passes through no single task.
    """
    if kind_of(df.schema[target].dataType) == "numeric":
        plain = df.select(named(target).alias("__t"))
        med = quantiles(plain, ["__t"], [0.5])["__t"][0]
        value = F.coalesce(number(target), F.lit(0.0 if med is None else float(med)))
    else:
        value = F.coalesce(named(target).cast("string"), F.lit(NULL_LABEL))
    classes = row_positions(df.select(value.alias("__class")).distinct(), [], ["__class"], out="__code")
    return value, classes


def encode_label(df: DataFrame, target: str, out: str = "label") -> tuple[DataFrame, DataFrame]:
    """``df`` with the integer code of its class (as a double), and the table of classes (class, code)."""
    value, classes = label_codes(df, target)
    coded = df.withColumn("__class", value).join(classes, "__class").withColumn(out, F.col("__code").cast("double"))
    return coded.drop("__class", "__code"), classes.select(F.col("__class").alias("class"), F.col("__code").alias("code"))


# ------------------------------------------------------------------ M3-M5
@dataclass
class Features:
    """A training frame (``features``, ``label``, kept columns) and its table of feature names (index, name)."""

    frame: DataFrame
    dictionary: DataFrame
    size: int
    task: str
    n_classes: int = 0

    @property
    def names(self) -> list[str]:
        """Names by index; as long as a model's weights, which the driver holds as well."""
        return [r["name"] for r in self.dictionary.orderBy("index").collect()]


def category_dictionary(df: DataFrame, cols: list[str]) -> tuple[DataFrame, list[int]]:
    """(feature, value, position): the sorted distinct texts of every column, and their number by column.

    Only the numbers reach the driver; positions come from range slices.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), named(c).cast("string").alias("value")) for c in cols])
    values = df.select(F.inline(cells)).where(F.col("value").isNotNull()).distinct()
    table = row_positions(values, ["feature"], ["value"], out="position")
    sizes = {r["feature"]: r["n"] for r in table.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per column
    return table, [sizes.get(c, 0) for c in cols]


def prepare_features(df: DataFrame, target: str, passthrough: list[str] | None = None) -> Features:
    """Drop datetime columns; one-hot every string feature of any width (first category dropped);
    numeric NULLs (a numeric target too) -> median; assemble sparse ``features``; encode the label.

    Each string column is joined with its part of the dictionary (a broadcast while that is
    small), and its category's position becomes one entry of a sparse vector.
    """
    from pyspark.ml.feature import OneHotEncoder, VectorAssembler

    task = detect_task(df, target)
    keep = list(passthrough or [])
    df = df.drop(*[named(c) for c in columns_of(df, "datetime") if c not in keep])
    feats = [c for c in df.columns if c != target and c not in keep]
    text = [c for c in feats if kind_of(df.schema[c].dataType) in ("categorical", "boolean")]
    num = [c for c in feats if kind_of(df.schema[c].dataType) == "numeric"]
    fill_cols = num + ([target] if task == "regression" else [])
    med = quantiles(df, fill_cols, [0.5]) if fill_cols else {}
    filled = lambda c: F.coalesce(number(c), F.lit(float(med[c][0]) if med[c][0] is not None else 0.0))
    dictionary, sizes = category_dictionary(df, text) if text else (None, [])
    # a column of one category says nothing once its first category is dropped
    wide = [(c, n) for c, n in zip(text, sizes) if n > 1]
    if task == "regression":
        label, classes, n_classes = filled(target), None, 0
    else:
        label, classes = label_codes(df, target)
        n_classes = classes.count()
    out = df.select(*[named(c) for c in keep], *[filled(c).alias(f"__n{i}") for i, c in enumerate(num)],
                    *[named(c).cast("string").alias(f"__t{i}") for i, (c, _) in enumerate(wide)],
                    label.alias("label" if classes is None else "__class"))
    for i, (c, n) in enumerate(wide):
        part = dictionary.where(F.col("feature") == c).select(F.col("value").alias(f"__t{i}"), F.col("position").alias(f"__p{i}"))
        out = out.join(part, f"__t{i}", "left").drop(f"__t{i}")
        # the encoder drops the last place: the first category and NULL stand there, the others one place lower
        place = F.when(F.coalesce(F.col(f"__p{i}"), F.lit(0)) == 0, n - 1).otherwise(F.col(f"__p{i}") - 1)
        out = out.withColumn(f"__p{i}", place.cast("double"))
    if classes is not None:
        out = out.join(classes, "__class").withColumn("label", F.col("__code").cast("double")).drop("__class", "__code")
    inputs = [f"__n{i}" for i in range(len(num))]
    if wide:
        places, hot = [f"__p{i}" for i in range(len(wide))], [f"__h{i}" for i in range(len(wide))]
        out = _sized(out, {f"__p{i}": n for i, (_, n) in enumerate(wide)})
        out = OneHotEncoder(inputCols=places, outputCols=hot, dropLast=True).fit(out).transform(out).drop(*places)
        inputs += hot
    out = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep").transform(out).drop(*inputs)
    spark = df.sparkSession
    names = spark.createDataFrame([(i, c) for i, c in enumerate(num)], "index long, name string")
    base = len(num)
    for c, n in wide:
        names = names.unionByName(dictionary.where((F.col("feature") == c) & (F.col("position") > 0)).select(
            (F.col("position") - 1 + base).alias("index"), F.concat(F.lit(f"{c}_"), "value").alias("name")))
        base += n - 1
    return Features(out, names, base, task, n_classes)


def _sized(df: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """Columns with the number of their categories as ML metadata, so the encoder needs no pass to find it."""
    return df.select(*[named(c).alias(c, metadata={"ml_attr": {"type": "nominal", "num_vals": sizes[c]}}) if c in sizes
                       else named(c) for c in df.columns])


def key_digest(keys: list[str], seed: int = SEED) -> Column:
    """md5 of the seed and the key columns as text (NULL is empty): an order that looks random and is the same anywhere."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(named(k).cast("string"), F.lit("")) for k in keys]))


def hash_fraction(keys: list[str], seed: int = SEED) -> Column:
    """A deterministic number in [0, 1) per row from its key columns."""
    return F.conv(F.substring(key_digest(keys, seed), 1, 8), 16, 10).cast("double") / 4294967296.0


def train_test_split(df: DataFrame, keys: list[str], test_frac: float = TEST_FRACTION, seed: int = SEED) -> DataFrame:
    """Adds ``is_test`` (about ``test_frac`` of rows), independent of partitioning."""
    return df.withColumn("is_test", hash_fraction(keys, seed) < test_frac)


def assign_folds(df: DataFrame, k: int = FOLDS, keys: list[str] | None = None, order_by: str | None = None,
                 seed: int = SEED, stratify: str | None = None) -> DataFrame:
    """Adds ``fold``.  With ``order_by``: contiguous folds in that order (NULL first, ties
    by ``keys``, which should be unique), sizes as ``ntile(k)``, from range slices.
    Otherwise shuffled folds: rows in the order of ``stratify`` and an md5 of the keys are dealt
    in turn, so the folds' shares of every class differ by at most one row."""
    if order_by is None:
        order = [*([stratify] if stratify else []), "__md5", *(keys or [])]
        pos = row_positions(df.withColumn("__md5", key_digest(keys or [], seed)), [], list(dict.fromkeys(order)), out="__pos")
        return pos.withColumn("fold", (F.col("__pos") % k).cast("int")).drop("__pos", "__md5")
    # exact positions: equal or very large order keys never merge two folds
    n = df.count()
    base, extra = divmod(n, k)
    pos = row_positions(df, [], [order_by, *[c for c in keys or [] if c != order_by]], out="__pos")
    p, head = F.col("__pos"), extra * (base + 1)
    fold = F.when(p < head, F.floor(p / (base + 1))).otherwise(extra + F.floor((p - head) / max(base, 1)))
    return pos.withColumn("fold", fold.cast("int")).drop("__pos")


# ------------------------------------------------------------------ M6-M11
def classifiers(n_train: int, n_classes: int, tree_depth: int = TREE_DEPTH) -> dict:
    from pyspark.ml.classification import (GBTClassifier, LogisticRegression, OneVsRest,
                                           RandomForestClassifier)
    gbt = GBTClassifier(maxIter=BOOST_ROUNDS, maxDepth=BOOST_DEPTH, stepSize=BOOST_STEP, seed=SEED)
    return {
        "Logistic Regression": LogisticRegression(maxIter=LOGISTIC_MAX_ITER, regParam=1.0 / max(n_train, 1),
                                                  elasticNetParam=0.0, standardization=False),
        "Random Forest": RandomForestClassifier(numTrees=TREES, featureSubsetStrategy="sqrt", seed=SEED,
                                                maxDepth=tree_depth),
        "Gradient Boosting": gbt if n_classes <= 2 else OneVsRest(classifier=gbt),
    }


def regressors(tree_depth: int = TREE_DEPTH) -> dict:
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
    return {
        "Linear Regression": LinearRegression(regParam=0.0, solver="normal"),
        "Random Forest": RandomForestRegressor(numTrees=TREES, featureSubsetStrategy="all", seed=SEED,
                                               maxDepth=tree_depth),
        "Gradient Boosting": GBTRegressor(maxIter=BOOST_ROUNDS, maxDepth=BOOST_DEPTH, stepSize=BOOST_STEP, seed=SEED),
    }


def _pipeline(est, size: int):
    """Scaling, then the estimator.  Wide (sparse) features are not centred, which would fill
    every vector; with an intercept that changes no fitted model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler
    scaler = StandardScaler(inputCol="features", outputCol="__scaled", withMean=size <= CENTRED_FEATURES, withStd=True)
    est = est.copy()
    est.setFeaturesCol("__scaled")
    return Pipeline(stages=[scaler, est])


# ------------------------------------------------------------------ M12/M13
def classification_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                           score: str | None = None) -> DataFrame:
    """(metric, value) rows: accuracy, weighted f1 (zero division -> 0) and, with
    ``score``, the exact binary ROC-AUC; 4 dp.  Works from the confusion counts."""
    conf = pred.groupBy(F.col(label).alias("y"), F.col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    tp = conf.where(F.col("y") == F.col("p")).select(F.col("y").alias("c"), F.col("n").alias("tp"))
    sup = conf.groupBy(F.col("y").alias("c")).agg(F.sum("n").alias("support"))
    prd = conf.groupBy(F.col("p").alias("c")).agg(F.sum("n").alias("predicted"))
    per = sup.join(prd, "c", "left").join(tp, "c", "left").fillna(0, ["predicted", "tp"])
    f1 = F.when(F.col("support") + F.col("predicted") > 0,
                2 * F.col("tp") / (F.col("support") + F.col("predicted"))).otherwise(0.0)
    m = per.agg((F.sum("tp") / F.sum("support")).alias("accuracy"),
                (F.sum(f1 * F.col("support")) / F.sum("support")).alias("f1"))
    out = m.select(F.inline(F.array(
        F.struct(F.lit("accuracy").alias("metric"), F.round("accuracy", 4).alias("value")),
        F.struct(F.lit("f1").alias("metric"), F.round("f1", 4).alias("value")))))
    if score is not None:
        out = out.unionByName(roc_auc(pred, label, score).select(F.lit("roc_auc").alias("metric"),
                                                                 F.col("roc_auc").alias("value")))
    return out


def roc_auc(pred: DataFrame, label: str, score: str) -> DataFrame:
    """Exact binary ROC-AUC (ties count 1/2) of class 1 against the rest, 4 dp."""
    one = pred.select(F.lit(1).alias("c"), (F.col(label) == 1).alias("y"), F.col(score).cast("double").alias("s"))
    return _class_aucs(one).agg(F.round(F.first("auc"), 4).alias("roc_auc"))


def _class_aucs(rows: DataFrame) -> DataFrame:
    """(c, auc) of rows (c, y, s): counts per distinct (class, score), then one distributed
    running count of negatives over all classes; what stood before a class is taken off again.
    NULL for a class without positives or negatives."""
    g = rows.groupBy(F.struct("c", "s").alias("o")).agg(F.count_if("y").alias("pos"), F.count_if(~F.col("y")).alias("neg"))
    g = running_sum_before(g, "o", "neg", "below")
    per = g.groupBy("o.c").agg(F.sum("pos").cast("double").alias("p"), F.sum("neg").cast("double").alias("n"), F.min("below").alias("first"),
                               F.sum(F.col("pos").cast("double") * (F.col("below") + 0.5 * F.col("neg"))).alias("won"))
    return per.select("c", F.try_divide(F.col("won") - F.col("p") * F.col("first"), F.col("p") * F.col("n")).alias("auc"))


def roc_auc_macro(pred: DataFrame, label: str, scores: str, n_classes: int) -> DataFrame:
    """One row ``roc_auc`` (4 dp) from an array of class scores: of class 1 for two classes, else the plain
    mean of the one-vs-rest values, rounded once; NULL when a class has no rows or all rows."""
    of = F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda c: F.struct(
        c.alias("c"), (F.col(label) == c).alias("y"), F.get(scores, c).alias("s")))
    rows = pred.select(F.inline(F.slice(of, 2, 1) if n_classes == 2 else of))
    mean = F.when((F.count(F.lit(1)) > 0) & (F.count("auc") == F.count(F.lit(1))), F.round(F.avg("auc"), 4))
    return _class_aucs(rows).agg(mean.alias("roc_auc"))


def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: rmse, mae, r2 (4 dp)."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    m = pred.agg(F.avg((y - p) * (y - p)).alias("mse"), F.avg(F.abs(y - p)).alias("mae"),
                 F.sum((y - p) * (y - p)).alias("ssr"), (F.var_pop(y) * F.count(y)).alias("sst"))
    return m.select(F.round(F.sqrt("mse"), 4).alias("rmse"), F.round("mae", 4).alias("mae"),
                    F.round(1 - F.try_divide(F.col("ssr"), F.col("sst")), 4).alias("r2"))


# ------------------------------------------------------------------ M14-M17
def _metrics_row(task, pred, n_classes):
    if task == "classification":
        out = {r["metric"]: r["value"] for r in classification_metrics(pred).collect()}
        if n_classes >= 2 and "probability" in pred.columns:
            from pyspark.ml.functions import vector_to_array
            probs = pred.select("label", vector_to_array("probability").alias("__p"))
            out["roc_auc"] = roc_auc_macro(probs, "label", "__p", n_classes).first()["roc_auc"]
        return out
    r = regression_metrics(pred).first()
    return {"rmse": r["rmse"], "mae": r["mae"], "r2": r["r2"]}


def cross_validate(feat: Features, est, k: int = FOLDS, keys: list[str] | None = None, order_by: str | None = None,
                   folded: DataFrame | None = None, turns: Semaphore | None = None) -> list[float]:
    """Per-fold scores (accuracy or r2, 4 dp) on all rows: shuffled stratified folds for
    classification, contiguous folds in ``order_by`` order for regression.  Several estimators
    may share one ``folded`` frame and the ``turns`` in which their fits run."""
    df = fold_frame(feat, k, keys, order_by) if folded is None else folded

    def run_fold(f):
        with turns or nullcontext():
            model = _pipeline(est, feat.size).fit(df.where(F.col("fold") != f))
            pred = model.transform(df.where(F.col("fold") == f))
            m = _metrics_row(feat.task, pred, 0)  # the fold's score needs no curve
        return m["accuracy"] if feat.task == "classification" else m["r2"]

    # fold fits are independent Spark jobs: submit them concurrently (like CrossValidator's parallelism)
    with ThreadPoolExecutor(max_workers=min(k, CV_PARALLELISM)) as pool:
        return list(pool.map(run_fold, range(k)))


def fold_frame(feat: Features, k: int = FOLDS, keys: list[str] | None = None, order_by: str | None = None) -> DataFrame:
    """The frame of ``feat`` with the ``fold`` of every row, written once."""
    if feat.task == "regression" and order_by:
        df = assign_folds(feat.frame, k, keys=keys or ["__h"], order_by=order_by)
    else:
        df = assign_folds(feat.frame, k, keys=keys or ["__h"], stratify="label" if feat.task == "classification" else None)
    return materialize(df)


def fits_at_once(rows: int, fits: int) -> int:
    """How many fits run side by side: each keeps its rows in the executors' memory until it is done."""
    return max(1, min(fits, max(LEAST_FITS, FIT_ROWS // max(rows, 1))))


def compare_models(df: DataFrame, target: str, keys: list[str], cv_folds: int = FOLDS,
                   order_by: str | None = None, tree_depth: int = TREE_DEPTH, catalog=None, dataset_id: int | None = None):
    """Fit every estimator on the 80 % split, score the 20 %, cross-validate on all
    rows; a failing model becomes an ``error`` row and the others continue.
    With a ``catalog`` every model that has metrics is saved there as a run.
    Returns (results frame, best model name, fitted models, features)."""
    spark = df.sparkSession
    base = df.withColumn("__h", key_digest(keys))
    passthrough = ["__h", *[k for k in keys if k != target]]
    if order_by and order_by != target and order_by not in passthrough:
        passthrough.append(order_by)
    feat = prepare_features(base, target, passthrough=passthrough)
    split = train_test_split(feat.frame, ["__h"])
    # every fit, fold and metric re-reads this frame: cut its lineage once, sized by rows
    n_rows = base.count()
    split = materialize(split.repartition(_partitions(n_rows)))
    feat = replace(feat, frame=split)
    train, test = split.where(~F.col("is_test")), split.where(F.col("is_test"))
    n_train = train.count()
    ests = classifiers(n_train, feat.n_classes, tree_depth) if feat.task == "classification" else regressors(tree_depth)

    turns = Semaphore(fits_at_once(n_rows, len(ests) * (1 + (cv_folds or 0))))

    def fit_and_score(est):
        with turns:
            model = _pipeline(est, feat.size).fit(train)
            return model, _metrics_row(feat.task, model.transform(test), feat.n_classes)

    # the fits are independent: their Spark jobs are submitted concurrently; all estimators share one frame of folds
    with ThreadPoolExecutor(max_workers=2 * len(ests) + 1) as pool:
        folds = pool.submit(fold_frame, feat, cv_folds, ["__h"], order_by) if cv_folds else None
        fits = {name: pool.submit(fit_and_score, est) for name, est in ests.items()}
        crossed = {name: pool.submit(lambda e: cross_validate(feat, e, cv_folds, ["__h"], order_by, folds.result(), turns), est)
                   for name, est in ests.items() if cv_folds}

    def evaluated(name):
        try:
            model, m = fits[name].result()
            if cv_folds:
                cv = crossed[name].result()
                m["cv_mean"] = round(sum(cv) / len(cv), 4)
                m["cv_std"] = round(_std(cv), 4)
                for i, sc in enumerate(cv):
                    m[f"cv_fold_{i + 1}"] = sc
            return model, [(name, feat.task, metric, None if v is None else float(v), None) for metric, v in m.items()]
        except Exception as e:  # noqa: BLE001 - a failing model is reported, the others continue
            return None, [(name, feat.task, "error", None, str(e))]

    rows, models = [], {}
    for name in ests:
        model, out = evaluated(name)
        rows += out
        if model is not None:
            models[name] = model
    res = spark.createDataFrame(rows, "model string, task string, metric string, value double, error string")
    if catalog is not None:
        save_runs(catalog, res, target, dataset_id)
    key = "accuracy" if feat.task == "classification" else "r2"
    best = None
    for name in ests:
        v = [r[3] for r in rows if r[0] == name and r[2] == key]
        if v and v[0] is not None and (best is None or v[0] > best[1]):
            best = (name, v[0])
    return res, (best[0] if best else None), models, feat


def save_runs(catalog, results: DataFrame, target: str, dataset_id: int | None = None) -> None:
    """One catalog run per model with metrics (folds are left to the results frame), in the order of the names."""
    kept = results.where((F.col("metric") != "error") & ~F.col("metric").startswith("cv_fold_"))
    runs = kept.groupBy("model", "task").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value")))).alias("metrics"))
    catalog.save_model_runs(runs.orderBy("model").select(
        F.lit(dataset_id).cast("bigint").alias("dataset_id"), F.col("model").alias("model_type"), "task",
        F.lit(target).alias("target_column"), "metrics", F.create_map(F.lit("seed"), F.lit(str(SEED))).alias("params")))


def partitions_for(df: DataFrame, rows_per_partition: int = ROWS_PER_PARTITION) -> int:
    return _partitions(df.count(), rows_per_partition)


def _partitions(rows: int, rows_per_partition: int = ROWS_PER_PARTITION) -> int:
    return max(1, min(math.ceil(rows / rows_per_partition), 100_000))


def _std(xs):
    m = sum(xs) / len(xs)
    return math.sqrt(sum((x - m) ** 2 for x in xs) / len(xs)) if xs else 0.0


def feature_importance(model, names: list[str], top: int = TOP_FEATURES):
    """(feature, importance) pairs, largest first: tree importances, else mean |coef|."""
    import numpy as np
    est = model.stages[-1] if hasattr(model, "stages") else model
    if hasattr(est, "featureImportances"):
        imp = est.featureImportances.toArray()
    elif hasattr(est, "models"):  # one-vs-rest: mean over members
        imp = np.mean([m.featureImportances.toArray() if hasattr(m, "featureImportances")
                       else np.abs(m.coefficients.toArray()) for m in est.models], axis=0)
    elif hasattr(est, "coefficientMatrix"):
        imp = np.abs(est.coefficientMatrix.toArray()).mean(axis=0)
    elif hasattr(est, "coefficients"):
        imp = np.abs(est.coefficients.toArray())
    else:
        return []
    pairs = sorted(zip(names, (float(x) for x in imp)), key=lambda t: -t[1])
    return [(n, round(v, 4)) for n, v in pairs[:top]]


def comparison_frame(results: DataFrame) -> DataFrame:
    """(model, accuracy|r2) rows for models with metrics."""
    return (results.where(F.col("metric").isin("accuracy", "r2"))
            .groupBy("model").pivot("metric", ["accuracy", "r2"]).agg(F.first("value")))
