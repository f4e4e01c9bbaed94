"""Multi-class perceptron over binary features: classification, training, averaging."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import few, gather

#: Most labels whose scores are columns.
COLUMNS = 64


class Perceptron:
    """Labels in byte order and weights by feature; training keeps the sums that averaging needs."""

    def __init__(self, labels: Iterable[str], weights: Iterable[tuple] = ()) -> None:
        self.labels = sorted(set(labels), key=str.encode)
        self.at = {y: i for i, y in enumerate(self.labels)}
        self.weights: dict[str, dict[int, float]] = {}
        self.sums: dict[str, dict[int, float]] = {}
        self.samples = 0
        for feature, label, weight in weights:
            self.weights.setdefault(feature, {})[self.at[label]] = float(weight)

    @classmethod
    def load(cls, weights: DataFrame) -> Perceptron:
        """From a table ``feature, label, weight``."""
        rows = gather(weights.select("feature", "label", "weight"))
        return cls({r[1] for r in rows}, rows)

    def scores(self, features: Iterable[str]) -> list[float]:
        out = [0.0] * len(self.labels)
        weights = self.weights
        for f in features:
            own = weights.get(f)
            if own:
                for y, w in own.items():
                    out[y] += w
        return out

    def classify(self, features: Iterable[str]) -> int:
        """The label of the largest score, the first of equals."""
        s = self.scores(features)
        return s.index(max(s))

    def update(self, features: Iterable[str], y: int, value: float) -> None:
        for f in features:
            own, total = self.weights.setdefault(f, {}), self.sums.setdefault(f, {})
            own[y] = own.get(y, 0.0) + value
            total[y] = total.get(y, 0.0) + self.samples * value

    def learn(self, features: list[str], y: int) -> bool:
        """One step: where the prediction is wrong, its weights go down and those of ``y`` up."""
        predicted = self.classify(features)
        if predicted != y:
            self.update(features, y, 1.0)
            self.update(features, predicted, -1.0)
        return predicted == y

    def average(self) -> None:
        """Replace each weight by its mean over the samples seen."""
        if self.samples:
            for f, total in self.sums.items():
                for y, v in total.items():
                    self.weights[f][y] -= v / self.samples
        self.sums = {}

    def rows(self) -> list[tuple[str, str, float]]:
        return [(f, self.labels[y], w) for f, own in self.weights.items() for y, w in sorted(own.items())]


def classify(samples: DataFrame, weights: DataFrame, keys: tuple) -> DataFrame:
    """``keys, label, score`` of rows ``keys, feature``, by joins and sums, for weight tables of any size.

    A sample without a known feature gets the first label, as one does of whose keys one is null.  Ties go to the label
    that comes first in byte order.  With few labels the scores are columns, so there is one shuffle of a row a sample.
    """
    labels = weights.select("label").distinct()
    names = [r[0] for r in labels.limit(COLUMNS + 1).collect()]
    if 0 < len(names) <= COLUMNS and None not in names:
        told = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
        rows = samples.join(few(weights), "feature", "left").select(*keys, "label", F.when(told, F.col("weight")).alias("weight"))
        wide = rows.groupBy(*keys).agg(*[F.sum(F.when(F.col("label") == y, F.col("weight"))).alias(f"__{i}") for i, y in enumerate(names)])
        each = [F.struct((F.lit(0.0) - F.coalesce(F.col(f"__{i}"), F.lit(0.0))).alias("s"), F.lit(y).cast("binary").alias("b"), F.lit(y).alias("label")) for i, y in enumerate(names)]
        best = wide.select(*keys, F.array_min(F.array(*each)).alias("m"))
        return best.select(*keys, F.col("m.label").alias("label"), (F.lit(0.0) - F.col("m.s")).alias("score"))
    summed = samples.join(few(weights), "feature").groupBy(*keys, "label").agg(F.sum("weight").alias("score"))
    all_ = samples.select(*keys).distinct().crossJoin(F.broadcast(labels))  # label sets are small
    scored = all_.join(summed, [*keys, "label"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    best = scored.groupBy(*keys).agg(F.min(F.struct((F.lit(0.0) - F.col("score")).alias("s"), F.col("label").cast("binary").alias("b"), "label")).alias("m"))
    return best.select(*keys, F.col("m.label").alias("label"), (F.lit(0.0) - F.col("m.s")).alias("score"))


def average(updates: DataFrame, samples: int) -> DataFrame:
    """``feature, label, weight``: averaged weights from updates ``feature, label, value, at``."""
    total = F.sum("value").cast("double") - F.sum(F.col("value") * F.col("at")).cast("double") / F.lit(float(samples))
    return updates.groupBy("feature", "label").agg(total.alias("weight"))


def mean_rows(models: list[list[tuple]]) -> list[tuple[str, str, float]]:
    """Mixture of models of shards: the mean of each weight, absent ones counting 0."""
    total: dict[tuple[str, str], float] = {}
    for rows in models:
        for feature, label, weight in rows:
            total[feature, label] = total.get((feature, label), 0.0) + weight
    return [(f, y, float(np.round(w / len(models), 12))) for (f, y), w in sorted(total.items())]
