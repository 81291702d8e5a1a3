"""Multilayer perceptron over DataFrames (N1, N2), trained on all rows at once.

The rows stay where they are: an epoch is one pass in which every task sends the sum of
its rows' gradients and losses, on the training and on the validation rows.  The driver
holds the weights only and steps by Adam; the learning rate falls when the validation loss
stays on a plateau.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship_package
from .models import SEED, classification_metrics, key_digest, partitions_for, prepare_features, regression_metrics, train_test_split

# Network and training defaults.
HIDDEN = (128, 64, 32)
EPOCHS = 50
LEARNING_RATE = 1e-3
WEIGHT_DECAY = 1e-4
PLATEAU_FACTOR = 0.1
PLATEAU_PATIENCE = 5
# Adam's moving averages.
BETA = (0.9, 0.999)
# Task results are added in this many groups before they go to the driver.
GROUPS = 64
# Rows of a matrix product inside a task.
BATCH = 8192


@dataclass
class Network:
    """Weights and biases by layer; ReLU between layers."""

    weights: list[np.ndarray]
    biases: list[np.ndarray]
    task: str

    @classmethod
    def start(cls, sizes: list[int], task: str, seed: int = SEED) -> "Network":
        rng = np.random.default_rng(seed)
        return cls([rng.normal(0, math.sqrt(2 / max(a, 1)), (a, b)) for a, b in zip(sizes, sizes[1:])],
                   [np.zeros(b) for b in sizes[1:]], task)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (*self.weights, *self.biases)])

    def unflat(self, v: np.ndarray) -> "Network":
        out, at = [], 0
        for x in (*self.weights, *self.biases):
            out.append(v[at:at + x.size].reshape(x.shape))
            at += x.size
        return Network(out[:len(self.weights)], out[len(self.weights):], self.task)

    def layers(self, x: np.ndarray) -> list[np.ndarray]:
        """The input, the outputs of the hidden layers, and the last layer before its loss."""
        out = [x]
        for k, (w, b) in enumerate(zip(self.weights, self.biases)):
            z = out[-1] @ w + b
            out.append(z if k == len(self.weights) - 1 else np.maximum(z, 0))
        return out

    def losses(self, last: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Loss of each row (cross entropy or squared error) and its slope at the last layer."""
        if self.task == "classification":
            z = last - last.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            at = (np.arange(len(y)), y.astype(int))
            slope = p.copy()
            slope[at] -= 1
            return -np.log(np.maximum(p[at], 1e-300)), slope
        err = last[:, 0] - y
        return err * err, 2 * err[:, None]

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        """Summed loss of the rows and the sum of its gradients, as one vector."""
        out = self.layers(x)
        loss, slope = self.losses(out[-1], y)
        dw, db = [], []
        for k in range(len(self.weights) - 1, -1, -1):
            dw.append(out[k].T @ slope)
            db.append(slope.sum(axis=0))
            slope = (slope @ self.weights[k].T) * (out[k] > 0)
        return float(loss.sum()), np.concatenate([g.ravel() for g in (*dw[::-1], *db[::-1])])

    def predict(self, x: np.ndarray) -> np.ndarray:
        last = self.layers(x)[-1]
        return last.argmax(axis=1).astype(float) if self.task == "classification" else last[:, 0]


@dataclass
class TrainedNetwork:
    network: Network
    metrics: DataFrame
    history: DataFrame
    task: str


_SUMS = "g int, n_train long, train double, n_val long, val double, grad array<double>"


def _pass(shared):
    """The summed losses and gradient of a task's rows (columns: x array, y, is_test)."""
    def run(it):
        from pyspark import TaskContext
        net = shared.value
        grad, n, loss = np.zeros(net.flat().size), [0, 0], [0.0, 0.0]
        for pdf in it:
            for s in range(0, len(pdf), BATCH):
                part = pdf.iloc[s:s + BATCH]
                x, y, test = np.stack(part["x"].to_numpy()), part["y"].to_numpy(), part["is_test"].to_numpy().astype(bool)
                if (~test).any():
                    more, g = net.gradient(x[~test], y[~test])
                    grad += g
                    loss[0] += more
                if test.any():
                    loss[1] += float(net.losses(net.layers(x[test])[-1], y[test])[0].sum())
                n[0] += int((~test).sum())
                n[1] += int(test.sum())
        yield pd.DataFrame({"g": [TaskContext.get().partitionId() % GROUPS], "n_train": [n[0]], "train": [loss[0]],
                            "n_val": [n[1]], "val": [loss[1]], "grad": [grad]})
    return run


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    out = pdf[["g", "n_train", "train", "n_val", "val"]].sum().to_frame().T
    return out.assign(g=pdf["g"].iloc[0], grad=[np.sum(np.stack(pdf["grad"].to_numpy()), axis=0)])


def epoch_sums(rows: DataFrame, net: Network) -> tuple[float, float, np.ndarray]:
    """(mean training loss, mean validation loss, mean training gradient) over all rows, in one job."""
    shared = rows.sparkSession.sparkContext.broadcast(net)
    parts = rows.mapInPandas(_pass(shared), _SUMS)
    if rows.rdd.getNumPartitions() > GROUPS:
        parts = parts.groupBy("g").applyInPandas(_added, _SUMS)
    got = parts.collect()  # at most GROUPS vectors as long as the weights
    shared.unpersist()
    n, m = sum(r["n_train"] for r in got), sum(r["n_val"] for r in got)
    grad = np.sum([r["grad"] for r in got], axis=0) if got else np.zeros(net.flat().size)
    return (sum(r["train"] for r in got) / max(n, 1), sum(r["val"] for r in got) / m if m else float("nan"), grad / max(n, 1))


def fit_network(rows: DataFrame, net: Network, epochs: int = EPOCHS, rate: float = LEARNING_RATE) -> tuple[Network, list[tuple]]:
    """(trained network, [(epoch, training loss, validation loss)]): the training loss is that before an
    epoch's step, the validation loss that after it (found in the next pass over the rows)."""
    v = net.flat()
    first, second = np.zeros_like(v), np.zeros_like(v)
    history, best, waited = [], math.inf, 0
    train, _, grad = epoch_sums(rows, net)
    for epoch in range(1, epochs + 1):
        grad = grad + WEIGHT_DECAY * v
        first = BETA[0] * first + (1 - BETA[0]) * grad
        second = BETA[1] * second + (1 - BETA[1]) * grad * grad
        v = v - rate * (first / (1 - BETA[0] ** epoch)) / (np.sqrt(second / (1 - BETA[1] ** epoch)) + 1e-8)
        net = net.unflat(v)
        before = train
        train, val, grad = epoch_sums(rows, net)
        history.append((epoch, before, val))
        waited = 0 if val < best * (1 - 1e-4) else waited + 1
        best = min(best, val)
        if waited > PLATEAU_PATIENCE:
            rate, waited = rate * PLATEAU_FACTOR, 0
    return net, history


def train_mlp(df: DataFrame, target: str, keys: list[str], hidden=HIDDEN, epochs: int = EPOCHS, rate: float = LEARNING_RATE) -> TrainedNetwork:
    """Multilayer perceptron on scaled features (scaler fitted on all rows), 80/20 split by the keys.

    Classification or regression by the target (``detect_task``).  A regression target is
    standardised for the fit; losses are in those units, metrics in the original ones.
    """
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import vector_to_array

    spark = df.sparkSession
    ship_package(spark)
    base = df.withColumn("__h", key_digest(keys))
    feat = prepare_features(base, target, passthrough=["__h", *[k for k in keys if k != target]])
    fr = materialize(feat.frame.repartition(partitions_for(base)))
    scaled = StandardScaler(inputCol="features", outputCol="__scaled", withMean=True, withStd=True).fit(fr).transform(fr)
    mean, spread = 0.0, 1.0
    if feat.task == "regression":
        m = fr.agg(F.avg("label").alias("m"), F.stddev_pop("label").alias("s")).first()
        mean, spread = m["m"] or 0.0, m["s"] or 1.0
    rows = materialize(train_test_split(scaled, ["__h"]).select(
        vector_to_array("__scaled").alias("x"), ((F.col("label") - mean) / spread).alias("y"), "is_test"))
    net = Network.start([feat.size, *hidden, max(feat.n_classes, 2) if feat.task == "classification" else 1], feat.task)
    net, history = fit_network(rows, net, epochs, rate)
    shared = spark.sparkContext.broadcast(net)

    def predict(it):
        for pdf in it:
            if len(pdf):
                yield pd.DataFrame({"label": pdf["y"] * spread + mean, "prediction": shared.value.predict(np.stack(pdf["x"].to_numpy())) * spread + mean})

    pred = rows.where("is_test").mapInPandas(predict, "label double, prediction double")
    metrics = classification_metrics(pred) if feat.task == "classification" else regression_metrics(pred)
    told = spark.createDataFrame([(e, round(a, 6), round(b, 6)) for e, a, b in history], "epoch int, train_loss double, val_loss double")
    return TrainedNetwork(net, metrics, told, feat.task)
