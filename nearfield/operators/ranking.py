"""Learning to rank: feature sets, feature logging, rescoring, training."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.session import cut_lineage

FEATURES = "featureset string, ord int, name string"


class FeatureSets:
    """Named, ordered feature lists in a small table at ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def reset(self) -> None:
        self.spark.createDataFrame([], FEATURES).write.mode("overwrite").parquet(self.path)

    def create(self, name: str, features: list[str]) -> None:
        rows = [(name, i, feature) for i, feature in enumerate(features)]
        self.spark.createDataFrame(rows, FEATURES).coalesce(1).write.mode("append").parquet(self.path)

    def names(self, name: str) -> list[str]:
        rows = self.spark.read.schema(FEATURES).parquet(self.path).where(F.col("featureset") == name).orderBy("ord").collect()
        if not rows:
            raise KeyError(f"unable to find feature set {name}")
        return [row["name"] for row in rows]


def log_columns(hits: DataFrame, values: dict[str, Column], names: list[str], size: int = 1000) -> DataFrame:
    """Hits with ``ltr_features`` from columns that stand beside them: one value per name in order, 0.0 where there is none."""
    row = F.array(*[F.coalesce(values[n].cast("double"), F.lit(0.0)) if n in values else F.lit(0.0) for n in names])
    return hits.where(F.col("rank") <= size).withColumn("ltr_features", row)


def log_features(hits: DataFrame, features: DataFrame, names: list[str], ids: DataFrame | None = None, size: int = 1000) -> DataFrame:
    """Hits with ``ltr_features``: one value per name in order, 0.0 where there is none.

    ``features`` is ``(query_id, id, feature, value)``. ``ids`` is the set of
    documents that count: hits outside it are left out before ranks are counted,
    so ``hits`` must reach deep enough, or come from a search with the same ids.
    """
    kept = hits
    if ids is not None:
        order = Window.partitionBy("query_id").orderBy("rank", "id")
        kept = kept.join(ids.select("id"), "id", "left_semi").withColumn("rank", F.row_number().over(order).cast("long"))
    kept = kept.where(F.col("rank") <= size)
    wanted = features.where(F.col("feature").isin(names))
    values = [F.max(F.when(F.col("feature") == n, F.col("value").cast("double"))).alias(f"_f{i}") for i, n in enumerate(names)]
    wide = wanted.groupBy("query_id", "id").agg(*values)
    row = F.array(*[F.coalesce(F.col(f"_f{i}"), F.lit(0.0)) for i in range(len(names))])
    joined = kept.join(wide, ["query_id", "id"], "left").withColumn("ltr_features", row)
    return joined.drop(*[f"_f{i}" for i in range(len(names))])


def rescore(hits: DataFrame, names: list[str], weights: dict[str, float], window: int = 1000, digits: int | None = None) -> DataFrame:
    """Add a linear model to the score of the first ``window`` hits; the others follow in their old order.

    ``hits`` carries ``ltr_features`` in the order of ``names``.
    """
    model = F.lit(0.0)
    for i, name in enumerate(names):
        if name in weights:
            model = model + F.col("ltr_features")[i] * F.lit(float(weights[name]))
    return rescore_by(hits, model, window, digits)


def rescore_by(hits: DataFrame, model, window: int = 1000, digits: int | None = None) -> DataFrame:
    """The same with any column as the model's score."""
    inside = F.col("rank") <= window
    total = F.when(inside, F.col("_score") + model).otherwise(F.col("_score"))
    scored = hits.withColumn("first_rank", F.col("rank")).withColumn(
        "_score", total if digits is None else F.round(total, digits)
    )
    order = Window.partitionBy("query_id").orderBy(
        (F.col("first_rank") <= window).desc(),
        F.when(F.col("first_rank") <= window, F.col("_score")).desc(),
        F.when(F.col("first_rank") > window, F.col("first_rank")).asc(),
        F.col("id").asc(),
    )
    return scored.withColumn("rank", F.row_number().over(order).cast("long"))


def train_ranker(rows: DataFrame, label: str, features: str = "ltr_features", kind: str = "linear", seed: int = 57895447):
    """Fit a model on logged features; ``model.transform`` adds ``prediction``. Save it with
    ``model.write().overwrite()``, which replaces a model of the same name."""
    from pyspark.ml import Pipeline
    from pyspark.ml.regression import GBTRegressor, LinearRegression

    fit = (
        LinearRegression(featuresCol="features", labelCol=label, regParam=0.01, solver="normal")
        if kind == "linear"
        else GBTRegressor(featuresCol="features", labelCol=label, maxIter=20, seed=seed)
    )
    return Pipeline(stages=[fit]).fit(as_vectors(rows, features))


def as_vectors(rows: DataFrame, features: str = "ltr_features") -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return rows.withColumn("features", array_to_vector(F.col(features)))


def train_pairwise(
    rows: DataFrame, label: str = "label", features: str = "ltr_features", steps: int = 50, rate: float = 0.1, window: int = 1000
) -> np.ndarray:
    """Weights of a linear model that puts better hits before worse ones: pairwise logistic loss, ``steps`` steps of gradient descent.

    A pair is two hits of a query of which the first has the higher label; the loss
    is the mean of log(1 + exp(-w (x - y))) over all pairs. Lists of hits hold
    ``window`` hits at most, or the training fails; a step reads them where they
    lie, sums the gradients of its pairs per task, and only these sums reach the
    driver. Rows without label or features count for nothing. No pairs, no weights: zeros.
    """
    known = rows.where(F.col(label).isNotNull() & F.col(features).isNotNull())
    lists = known.groupBy("query_id").agg(F.collect_list(F.struct(F.col(label).cast("double").alias("y"), F.col(features).alias("x"))).alias("hits"))
    lists = cut_lineage(lists)
    sizes = lists.agg(F.max(F.size("hits")).alias("longest"), F.max(F.size(F.col("hits")[0]["x"])).alias("width")).first()
    if sizes["longest"] is None:
        return np.zeros(0)
    if sizes["longest"] > window:
        raise ValueError(f"a list of {sizes['longest']} hits; at most {window} are compared with each other")
    weights = np.zeros(sizes["width"])

    def gradients(batches: Iterator[pd.DataFrame], weights: np.ndarray) -> Iterator[pd.DataFrame]:
        total, pairs = np.zeros(len(weights)), 0
        for batch in batches:
            for hits in batch["hits"]:
                y = np.array([h["y"] for h in hits])
                x = np.array([h["x"] for h in hits], dtype=float)
                order = np.argsort(y, kind="stable")
                y, x = y[order], x[order]
                score = x @ weights
                for i in range(len(y)):
                    worse = np.searchsorted(y, y[i], side="left")  # all before are worse
                    if worse:
                        pull = 1.0 / (1.0 + np.exp(score[i] - score[:worse]))
                        total += pull.sum() * x[i] - pull @ x[:worse]
                        pairs += worse
        yield pd.DataFrame({"pull": [total.tolist()], "pairs": [pairs]})

    for _ in range(steps):
        parts = lists.mapInPandas(lambda batches, w=weights: gradients(batches, w), "pull array<double>, pairs long")
        sums = parts.agg(F.sum("pairs").alias("pairs"), *(F.sum(F.col("pull")[i]).alias(f"g{i}") for i in range(len(weights)))).first()
        if not sums["pairs"]:
            break
        weights = weights + rate * np.array([sums[f"g{i}"] for i in range(len(weights))]) / sums["pairs"]
    return weights


class Models:
    """Linear models by name; a model that is put again replaces the one there was."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def put(self, name: str, features: list[str], weights: np.ndarray) -> None:
        rows = [(i, feature, float(w)) for i, (feature, w) in enumerate(zip(features, weights))]
        self.spark.createDataFrame(rows, "ord int, feature string, weight double").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{name}")

    def get(self, name: str) -> DataFrame:
        """``(ord, feature, weight)``; a model that is not there is an error."""
        return self.spark.read.schema("ord int, feature string, weight double").parquet(f"{self.path}/{name}")

    def weights(self, name: str) -> dict[str, float]:
        return {row["feature"]: row["weight"] for row in self.get(name).collect()}
