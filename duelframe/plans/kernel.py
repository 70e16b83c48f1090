"""Kernel margin model: random Fourier features, a margin per class pair, fitted probabilities.

The RBF kernel is replaced by its seeded random features, so training is linear in
rows: z(x) = sqrt(2 / D) cos(W x + b) with rows of W from N(0, 2 gamma) gives
E[z(x) z(y)] = exp(-gamma |x - y|^2). Each pair of classes gets a weighted linear
margin (balanced class weights, penalty 1 / (C n)), and its probability is a
logistic fitted on scores of rows that the margin hasn't seen. The probability of a
class is the mean of its pairs' probabilities, normalised.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasSeed, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

# Fixed values that must equal the reference's.
PENALTY = 10.0

DIMENSIONS = 256
HELD = 5  # every fifth row, by hash, sets the probabilities


def fourier(n_inputs: int, dimensions: int, gamma: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.normal(0.0, np.sqrt(2 * gamma), (n_inputs, dimensions)), rng.uniform(0, 2 * np.pi, dimensions)


def fourier_features(x: Column, n_inputs: int, dimensions: int, gamma: float, seed: int) -> Column:
    """array<double> of random features of an array column; the weights are made again from the seed in every task."""

    @F.arrow_udf("array<double>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w, b = fourier(n_inputs, dimensions, gamma, seed)
        for rows in batches:
            values = np.asarray(rows.flatten()).reshape(len(rows), -1) if len(rows) else np.empty((0, n_inputs))
            z = np.sqrt(2 / dimensions) * np.cos(values @ w + b)
            yield pa.ListArray.from_arrays(np.arange(0, z.size + 1, dimensions, dtype=np.int32), z.ravel())

    return of(x)


class KernelMargin(Estimator, HasFeaturesCol, HasLabelCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Features must be scaled. gamma is 1 / (inputs x variance of all inputs together), as the reference's "scale"."""

    dimensions = Param(Params._dummy(), "dimensions", "random features", TypeConverters.toInt)
    penalty = Param(Params._dummy(), "penalty", "C", TypeConverters.toFloat)
    classes = Param(Params._dummy(), "classes", "number of classes", TypeConverters.toInt)
    iterations = Param(Params._dummy(), "iterations", "of each margin", TypeConverters.toInt)

    @keyword_only
    def __init__(self, featuresCol="features", labelCol="label", dimensions=DIMENSIONS, penalty=PENALTY, classes=3, iterations=50, seed=42):
        super().__init__()
        self._setDefault(dimensions=DIMENSIONS, penalty=PENALTY, classes=3, iterations=50, seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> KernelMarginModel:
        get = self.getOrDefault
        x = vector_to_array(F.col(self.getFeaturesCol()))
        rows = dataset.select(x.alias("x"), F.col(self.getLabelCol()).cast("int").alias("label"))
        total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
        square = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
        s = rows.agg(F.max(F.size("x")).alias("d"), F.count(F.lit(1)).alias("n"), F.sum(total).alias("s"), F.sum(square).alias("q")).first()
        if not s["n"]:
            return KernelMarginModel.of({"inputs": 0, "gamma": 1.0, "pairs": []}, self)
        cells = s["n"] * s["d"]
        variance = s["q"] / cells - (s["s"] / cells) ** 2
        gamma = 1.0 / (s["d"] * variance) if variance > 1e-12 else 1.0
        z = rows.select("label", (F.pmod(F.xxhash64("x", "label"), F.lit(HELD)) == 0).alias("held"),
                        array_to_vector(fourier_features(F.col("x"), s["d"], get(self.dimensions), gamma, self.getSeed())).alias("z"))
        z = stored(z)
        sizes = {(r["label"], r["held"]): r["n"] for r in z.groupBy("label", "held").agg(F.count(F.lit(1)).alias("n")).collect()}
        pairs = []
        for one, two in itertools.combinations(range(get(self.classes)), 2):
            n = {k: sizes.get((k, False), 0) for k in (one, two)}
            if not all(n.values()):
                pairs.append({"one": one, "two": two, "weights": None, "slope": 0.0, "offset": 0.0 if not sum(n.values()) else (9.0 if n[two] else -9.0)})
                continue
            own = z.where(F.col("label").isin(one, two)).select(
                "z", "held", (F.col("label") == two).cast("double").alias("y"),
                F.when(F.col("label") == one, sum(n.values()) / (2 * n[one])).otherwise(sum(n.values()) / (2 * n[two])).alias("w"))
            svc = LinearSVC(featuresCol="z", labelCol="y", weightCol="w", standardization=False, maxIter=get(self.iterations),
                            regParam=1.0 / (get(self.penalty) * sum(n.values())))
            margin = svc.fit(own.where(~F.col("held")))
            weights = [*margin.coefficients.toArray().tolist(), margin.intercept]
            score = margin.transform(own.where("held")).select("y", vector_to_array("rawPrediction")[1].alias("m"))
            fitted = LogisticRegression(featuresCol="f", labelCol="y", regParam=1e-3).fit(VectorAssembler(inputCols=["m"], outputCol="f").transform(score)) \
                if sizes.get((one, True)) and sizes.get((two, True)) else None
            slope, offset = (float(fitted.coefficients[0]), float(fitted.intercept)) if fitted else (1.0, 0.0)
            pairs.append({"one": one, "two": two, "weights": weights, "slope": slope, "offset": offset})
        return KernelMarginModel.of({"inputs": s["d"], "gamma": gamma, "pairs": pairs}, self)


def pair_probabilities(z: np.ndarray, pairs: list[dict], n_classes: int) -> np.ndarray:
    """Class probabilities from the pairs' fitted logistics."""
    out = np.zeros((len(z), n_classes))
    for p in pairs:
        m = z @ np.array(p["weights"][:-1]) + p["weights"][-1] if p["weights"] else np.zeros(len(z))
        two = 1 / (1 + np.exp(-np.clip(p["slope"] * m + p["offset"], -30, 30)))
        out[:, p["two"]] += two
        out[:, p["one"]] += 1 - two
    total = out.sum(1, keepdims=True)
    return np.where(total > 0, out / np.where(total > 0, total, 1), 1 / n_classes)


class KernelMarginModel(Model, HasFeaturesCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``probability`` (array) and ``prediction`` (double)."""

    fitted = Param(Params._dummy(), "fitted", "JSON of the model", TypeConverters.toString)

    @keyword_only
    def __init__(self, featuresCol="features", fitted="{}"):
        super().__init__()
        self._set(**self._input_kwargs)

    @classmethod
    def of(cls, found: dict, stage: KernelMargin) -> KernelMarginModel:
        found = found | {"dimensions": stage.getOrDefault(stage.dimensions), "classes": stage.getOrDefault(stage.classes), "seed": stage.getSeed()}
        return cls(featuresCol=stage.getFeaturesCol(), fitted=json.dumps(found))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        m = json.loads(self.getOrDefault(self.fitted))

        @F.arrow_udf("array<double>")
        def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            w, b = fourier(m["inputs"], m["dimensions"], m["gamma"], m["seed"])
            for rows in batches:
                n = len(rows)
                values = np.asarray(rows.flatten()).reshape(n, -1) if n else np.empty((0, m["inputs"]))
                z = np.sqrt(2 / m["dimensions"]) * np.cos(values @ w + b) if m["inputs"] else np.zeros((n, m["dimensions"]))
                p = pair_probabilities(z, m["pairs"], m["classes"])
                yield pa.ListArray.from_arrays(np.arange(0, p.size + 1, m["classes"], dtype=np.int32), p.ravel())

        out = dataset.withColumn("probability", of(vector_to_array(F.col(self.getFeaturesCol()))))
        return out.withColumn("prediction", F.array_position("probability", F.array_max("probability")).cast("double") - 1)
