"""Kernel margin model against a linear one on rings, its features against the kernel."""

from __future__ import annotations

import math
import random

import numpy as np
from duelframe.plans.kernel import KernelMargin, KernelMarginModel, fourier, pair_probabilities
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler


def rings(n, seed):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        k, a = r.randrange(3), r.random() * 2 * math.pi
        rows.append(((k + 1 + r.gauss(0, 0.12)) * math.cos(a), (k + 1 + r.gauss(0, 0.12)) * math.sin(a), k))
    return rows


def test_features_give_the_kernel():
    r = np.random.default_rng(3)
    x = r.normal(size=(40, 4))
    w, b = fourier(4, 20_000, 0.3, 7)
    z = np.sqrt(2 / 20_000) * np.cos(x @ w + b)
    exact = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(z @ z.T - exact).max() < 0.05


def test_rings_beat_the_linear_model(spark, tmp_path):
    schema = "a double, b double, label int"
    train, test = spark.createDataFrame(rings(900, 1), schema).repartition(4), spark.createDataFrame(rings(300, 2), schema)
    front = VectorAssembler(inputCols=["a", "b"], outputCol="features")

    def accuracy(model):
        rows = model.transform(test).select("label", "prediction").collect()
        return np.mean([r["label"] == r["prediction"] for r in rows])

    kernel = Pipeline(stages=[front, KernelMargin(dimensions=128, iterations=30)]).fit(train)
    linear = Pipeline(stages=[front, LogisticRegression(maxIter=50)]).fit(train)
    assert accuracy(kernel) > 0.93 > accuracy(linear) + 0.3
    out = kernel.transform(test).select("label", "probability").collect()
    assert all(abs(sum(r["probability"]) - 1) < 1e-9 for r in out)
    assert np.mean([r["probability"][r["label"]] for r in out]) > 0.6
    kernel.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m")).transform(test).select("probability").collect()
    assert again == [r for r in kernel.transform(test).select("probability").collect()]


def test_classes_without_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(float(k), 1.0, k % 2) for k in range(40)], "a double, b double, label int")
    pipe = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features"), KernelMargin(dimensions=16, iterations=5)])
    p = [r["probability"] for r in pipe.fit(df).transform(df).select("probability").collect()]
    assert all(x[2] < 0.01 for x in p)
    empty = pipe.fit(df.limit(0)).transform(df.limit(1)).first()["probability"]
    assert np.allclose(empty, 1 / 3)
    assert np.allclose(pair_probabilities(np.zeros((2, 3)), [], 3), 1 / 3) and KernelMarginModel()
