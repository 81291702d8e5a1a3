import numpy as np
from pyspark.sql import functions as F

from sparkinsight.operators import models as M
from sparkinsight.operators import sequence as N


def test_sequences_cross_partitions(spark):
    rows = [(k, t, float(k * 1000 + t)) for k in (1, 2) for t in range(37)]
    df = spark.createDataFrame(rows, "s long, t long, v double")
    for series in (["s"], None):
        seq = N.make_sequences(df if series else df.where("s = 1"), "v", "t", series, n=5, partitions=7)
        got = seq.orderBy(*(series or []), "t").collect()
        assert len(got) == (2 if series else 1) * 32
        for r in got:
            base = r["y"]
            assert [r[f"x_{i}"] for i in range(1, 6)] == [base - 5 + i for i in range(5)]


def test_chrono_split(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(100)], "t long, v double")
    seq = N.make_sequences(df, "v", "t", None, n=10)
    split = N.chronological_split(seq, "t")
    assert split.where("is_train").count() == 72
    assert split.where("is_train").agg(F.max("t")).first()[0] < split.where("not is_train").agg(F.min("t")).first()[0]


def test_contiguous_folds_like_ntile(spark):
    df = spark.createDataFrame([(i,) for i in range(12)], "k long")
    folds = [r["fold"] for r in M.assign_folds(df, 5, order_by="k").orderBy("k").collect()]
    assert folds == [0, 0, 0, 1, 1, 1, 2, 2, 3, 3, 4, 4]


def test_detect_task(sample_df):
    assert M.detect_task(sample_df, "churn") == "classification"
    assert M.detect_task(sample_df, "score") == "regression"
    assert M.detect_task(sample_df, "dept") == "classification"


def test_prepare_features(sample_df):
    f = M.prepare_features(sample_df, "churn")
    assert f.task == "classification"
    assert f.names == ["age", "salary", "score", "dept_Finance", "dept_HR", "dept_Sales"]
    assert f.frame.count() == 200


def test_split_is_deterministic(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    a = M.train_test_split(df, ["k"]).where("is_test").count()
    b = M.train_test_split(df.repartition(7), ["k"]).where("is_test").count()
    assert a == b and 300 < a < 500


def test_metrics(spark):
    pred = spark.createDataFrame([(1, 1, 0.9), (0, 0, 0.1), (1, 0, 0.4), (0, 0, 0.3)],
                                 "label int, prediction int, score double")
    m = {r["metric"]: r["value"] for r in M.classification_metrics(pred, score="score").collect()}
    assert m["accuracy"] == 0.75 and m["roc_auc"] == 1.0
    reg = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0)], "label double, prediction double")
    r = M.regression_metrics(reg).first()
    assert r["mae"] == 0.5 and r["rmse"] == round(np.sqrt(0.5), 4)


def test_compare_models_small(sample_df):
    res, best, models, feat = M.compare_models(sample_df.drop("score"), "churn", ["age", "salary"], cv_folds=2)
    metrics = {(r["model"], r["metric"]) for r in res.collect()}
    assert ("Logistic Regression", "accuracy") in metrics and best is not None
    imp = M.feature_importance(models["Random Forest"], feat.names)
    assert len(imp) == len(feat.names)


def test_row_positions_hot_key(spark):
    from sparkinsight.functions.stats import row_positions
    rows = [(1, t) for t in range(300)] + [(k, t) for k in range(2, 30) for t in range(5)]
    df = spark.createDataFrame(rows, "k long, t long")
    out = row_positions(df, ["k"], ["t"], out="pos", total="n", partitions=9).collect()
    assert all(r["pos"] == r["t"] for r in out)
    assert all(r["n"] == (300 if r["k"] == 1 else 5) for r in out)


def test_contiguous_folds_exact_on_ties_and_wide_keys(spark):
    from collections import Counter
    wide = spark.createDataFrame([(2 ** 53 + i,) for i in range(10)], "k long")
    folds = [r["fold"] for r in M.assign_folds(wide, 5, order_by="k").orderBy("k").collect()]
    assert folds == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]
    tied = spark.createDataFrame([(i, i % 3 if i else None) for i in range(32)], "id long, k long")
    got = M.assign_folds(tied, 5, keys=["id"], order_by="k").collect()
    assert Counter(r["fold"] for r in got) == {0: 7, 1: 7, 2: 6, 3: 6, 4: 6}
    assert [r["fold"] for r in got if r["k"] is None] == [0]
    cut = N.chronological_split(wide, "k").where("is_train")
    assert cut.count() == 8


def test_multiclass_auc_is_the_mean_over_classes(spark):
    rows = [(0, [0.8, 0.1, 0.1]), (0, [0.4, 0.5, 0.1]), (1, [0.3, 0.6, 0.1]), (1, [0.5, 0.3, 0.2]), (2, [0.1, 0.2, 0.7]),
            (2, [0.2, 0.4, 0.4])]
    df = spark.createDataFrame(rows, "label int, p array<double>")

    def auc(c):
        pos = [p[c] for y, p in rows if y == c]
        neg = [p[c] for y, p in rows if y != c]
        return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))

    want = sum(auc(c) for c in range(3)) / 3
    assert M.roc_auc_macro(df, "label", "p", 3).first()[0] == round(want, 4)
    assert M.roc_auc_macro(df.where("label < 2"), "label", "p", 3).first()[0] is None
    assert M.roc_auc_macro(df.where("label < 2"), "label", "p", 2).first()[0] == 0.75


def test_windows_reach_over_short_slices_and_leave_nulls_out(spark):
    """Slices of a few rows, shorter than the window, NULL and NaN values, NULL keys and equal-looking keys."""
    import math
    import random
    rng = random.Random(3)
    rows = []
    for key in (("a", "b\x1fc"), ("a\x1fb", "c"), (None, "c"), ("z", None)):
        for t in range(23):
            rows.append((*key, t, None if rng.random() < 0.2 else (math.nan if rng.random() < 0.1 else rng.random())))
    df = spark.createDataFrame(rows, "s string, u string, t long, v double")
    want = []
    for key in {r[:2] for r in rows}:
        kept = sorted((t, v) for s, u, t, v in rows if (s, u) == key and v is not None and v == v)
        want += [(*key, kept[i][0], *[v for _, v in kept[i - 4:i + 1]]) for i in range(4, len(kept))]
    for parts in (1, 5, 60):
        got = N.make_sequences(df, "v", "t", ["s", "u"], n=4, partitions=parts).collect()
        assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)
    assert N.make_sequences(df.where("t < 3"), "v", "t", ["s", "u"], n=4).count() == 0


def test_lag_model_by_series(spark):
    """Two series that follow their own rule exactly, one with gaps, and one too short to forecast."""
    rows = []
    for s, step in (("up", 2.0), ("down", -3.0)):
        rows += [(s, t, 10 + step * t) for t in range(40)]
    rows += [("up", 100 + k, None) for k in range(3)] + [("short", t, 1.0) for t in range(3)]
    df = spark.createDataFrame(rows, "s string, t long, v double")
    models, pred, metrics = N.forecast_validation(df, "v", "t", ["s"], n=3)
    assert {r["s"] for r in metrics.collect()} == {"up", "down"}
    assert all(r["rmse"] < 1e-6 and r["r2"] == 1.0 for r in metrics.collect())
    assert all(abs(r["actual"] - r["predicted"]) < 1e-6 for r in pred.collect())
    ahead = {(r["s"], r["step"]): r["forecast"] for r in N.forecast(df, "v", "t", ["s"], horizon=4, n=3).collect()}
    assert len(ahead) == 8
    for k in range(4):
        assert abs(ahead["up", k + 1] - (10 + 2 * (40 + k))) < 1e-5 and abs(ahead["down", k + 1] - (10 - 3 * (40 + k))) < 1e-5
    alone = N.forecast(df.where("s = 'up'").drop("s"), "v", "t", None, horizon=2, n=3).orderBy("step").collect()
    assert abs(alone[1]["forecast"] - 92) < 1e-5


def test_stratified_folds_are_exact(spark):
    from collections import Counter
    df = spark.createDataFrame([(i, "big" if i % 3 else f"c{i % 4}") for i in range(500)] + [(900 + i, None) for i in range(7)], "id long, y string")
    folds = M.assign_folds(df, 5, keys=["id"], stratify="y").collect()
    per = Counter((r["y"], r["fold"]) for r in folds)
    for y in {r["y"] for r in folds}:
        sizes = [per[y, f] for f in range(5)]
        assert max(sizes) - min(sizes) <= 1
    total = Counter(r["fold"] for r in folds)
    assert max(total.values()) - min(total.values()) <= 1
    again = {r["id"]: r["fold"] for r in M.assign_folds(df.repartition(9), 5, keys=["id"], stratify="y").collect()}
    assert again == {r["id"]: r["fold"] for r in folds}


def test_label_codes_of_any_width(spark):
    df = spark.createDataFrame([(f"v{i % 700:04d}" if i % 50 else None,) for i in range(3000)], "y string")
    out, classes = M.encode_label(df, "y")
    order = sorted({f"v{i % 700:04d}" if i % 50 else "nan" for i in range(3000)})
    assert {r["class"]: r["code"] for r in classes.collect()} == {v: i for i, v in enumerate(order)}
    assert all(r["label"] == order.index(r["y"] or "nan") for r in out.collect())
    num = spark.createDataFrame([(1.0,), (10.0,), (2.0,), (None,), (float("nan"),), (2.0,)], "y double")
    assert sorted(r["label"] for r in M.encode_label(num, "y")[0].collect()) == [0.0, 1.0, 1.0, 1.0, 1.0, 2.0]


def test_features_of_a_wide_column_train(spark):
    """A text column of 5,000 categories, dotted and odd names, NULLs, a constant column and a date."""
    rows = [(i, f"c{i % 5000:05d}" if i % 11 else None, float(i % 5000) if i % 7 else None, "only", ["x.1", "y`2", "z"][i % 3], i % 2 == 0, int(i % 5000 >= 2500))
            for i in range(15_000)]
    df = spark.createDataFrame(rows, "id long, `a.b` string, `n.v` double, k string, `q``r` string, flag boolean, target int")
    f = M.prepare_features(df.drop("n.v"), "target", passthrough=["id"])
    assert f.task == "classification" and f.n_classes == 2
    names = f.names
    wide = len({r[1] for r in rows} - {None})
    assert len(names) == f.size == (wide - 1) + 2 + 1
    assert names[0] == "a.b_c00001" and "q`r_y`2" in names and names[-1] == "flag_true"
    row = f.frame.where("id = 3").first()
    assert row["features"].numNonzeros() == len([n for n in names if n in ("a.b_c00003",)])
    from pyspark.ml.classification import LogisticRegression
    model = M._pipeline(LogisticRegression(maxIter=30, regParam=1e-4), f.size).fit(f.frame)
    pred = model.transform(f.frame)
    assert pred.where("prediction = label").count() > 0.9 * 15_000
    both = M.prepare_features(df, "n.v", passthrough=["id"])
    assert both.task == "regression" and both.frame.where("label IS NULL").count() == 0


def test_comparison_saves_its_runs(spark, sample_df):
    from sparkinsight.session import scratch_path
    from sparkinsight.sources.catalog import Catalog
    cat = Catalog(spark, scratch_path(spark, "catalog"))
    cat.bootstrap()
    res, _best, _models, _feat = M.compare_models(sample_df.drop("score"), "churn", ["age", "salary"], cv_folds=0, catalog=cat, dataset_id=7)
    runs = {r["model_type"]: r for r in cat.list_model_runs(7).collect()}
    told = {(r["model"], r["metric"]): r["value"] for r in res.collect()}
    assert set(runs) == {m for m, _ in told}
    for m, r in runs.items():
        assert r["task"] == "classification" and r["target_column"] == "churn"
        assert r["metrics"] == {k: v for (name, k), v in told.items() if name == m}


def test_network_gradient():
    from sparkinsight.operators import neural as NN
    rng = np.random.default_rng(1)
    x = rng.normal(size=(9, 4))
    for task, out, y in (("classification", 3, rng.integers(0, 3, 9).astype(float)), ("regression", 1, rng.normal(size=9))):
        net = NN.Network.start([4, 6, 5, out], task, seed=2)
        _, grad = net.gradient(x, y)
        v = net.flat()
        for k in range(0, len(v), 5):
            step = np.zeros_like(v)
            step[k] = 1e-6
            up, down = (net.unflat(v + d).gradient(x, y)[0] for d in (step, -step))
            assert abs((up - down) / 2e-6 - grad[k]) < 1e-4


def test_network_learns_and_tells_its_losses(spark):
    from sparkinsight.operators import neural as NN
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=400), rng.normal(size=400)
    df = spark.createDataFrame([(i, float(p), float(q), "in" if p * p + q * q < 1.2 else "out") for i, (p, q) in enumerate(zip(a, b))],
                               "id long, a double, b double, y string")
    got = NN.train_mlp(df, "y", ["id"], hidden=(16, 8), epochs=40, rate=0.03)
    hist = got.history.orderBy("epoch").collect()
    assert [r["epoch"] for r in hist] == list(range(1, 41))
    assert hist[-1]["train_loss"] < 0.4 * hist[0]["train_loss"] and hist[-1]["val_loss"] < 0.5 * hist[0]["val_loss"]
    assert {r["metric"]: r["value"] for r in got.metrics.collect()}["accuracy"] > 0.9
    # one epoch over many tasks is the epoch over one
    net = NN.Network.start([2, 3, 2], "classification")
    rows = spark.createDataFrame([([float(p), float(q)], float(p > q), i % 5 == 0) for i, (p, q) in enumerate(zip(a, b))], "x array<double>, y double, is_test boolean")
    one, many = NN.epoch_sums(rows.coalesce(1), net), NN.epoch_sums(rows.repartition(90), net)
    assert abs(one[0] - many[0]) < 1e-9 and abs(one[1] - many[1]) < 1e-9 and np.allclose(one[2], many[2])
    lin = spark.createDataFrame([(i, float(p), float(3 * p + 100)) for i, p in enumerate(a)], "id long, a double, y double")
    reg = NN.train_mlp(lin, "y", ["id"], hidden=(16,), epochs=60, rate=0.03)
    assert reg.task == "regression" and reg.metrics.first()["r2"] > 0.9


def test_fits_that_run_at_once_hold_bounded_rows(spark, sample_df, monkeypatch):
    """One frame of folds for all estimators; fits side by side as their rows allow, at most two of many rows."""
    import threading

    assert [M.fits_at_once(n, 18) for n in (0, 4_000, 1_200_000, 7_200_000, 10**12)] == [18, 18, 16, 2, 2]
    assert M.fits_at_once(10, 1) == 1
    monkeypatch.setattr(M, "FIT_ROWS", 1)
    frames, now, most, lock, pipeline, folded = [], set(), [0], threading.Lock(), M._pipeline, M.fold_frame

    class Watched:
        def __init__(self, inner):
            self.inner = inner

        def fit(self, df):
            with lock:
                now.add(id(self))
                most[0] = max(most[0], len(now))
            try:
                return self.inner.fit(df)
            finally:
                with lock:
                    now.discard(id(self))

    monkeypatch.setattr(M, "_pipeline", lambda est, size: Watched(pipeline(est, size)))
    monkeypatch.setattr(M, "fold_frame", lambda *a, **b: frames.append(1) or folded(*a, **b))
    monkeypatch.setattr(M, "regressors", lambda depth: {n: e for n, e in REGRESSORS(depth).items() if n == "Linear Regression"} | {"Broken": object()})
    res, best, models, _feat = M.compare_models(sample_df, "score", ["age", "salary"], cv_folds=3, order_by="age")
    rows = [(r["model"], r["metric"]) for r in res.collect()]
    assert rows == [("Linear Regression", m) for m in ("rmse", "mae", "r2", "cv_mean", "cv_std", "cv_fold_1", "cv_fold_2", "cv_fold_3")] + [("Broken", "error")]
    assert best == "Linear Regression" and list(models) == [best] and len(frames) == 1 and most[0] == 2


REGRESSORS = M.regressors
