"""Models over feature matrices: principal components with outlier tests, and regularised linear regression."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import percentiles
from .matrix import folds


def curve_vectors(curves: DataFrame, quantity: str = "discharge_capacity", x: str = "voltage", cycles: tuple[int, ...] = tuple(range(10, 101, 10))) -> DataFrame:
    """Discharge curves of the chosen cycles as vectors for Components: run_id, cycle_index, embedding (quantity in the order of x).

    The curves of a run have a common grid. Nulls stay nulls; a step_type column, if there is one, tells discharges.
    """
    rows = curves.where(F.col("cycle_index").isin(*cycles))
    if "step_type" in curves.columns:
        rows = rows.where("step_type = 'discharge'")
    points = F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col(quantity).cast("double").alias("y"))))
    return rows.groupBy("run_id", "cycle_index").agg(F.transform(points, lambda p: p["y"]).alias("embedding"))


class Components:
    """A fitted scaler and PCA, and the least number of components that explain enough."""

    def __init__(self, train: DataFrame, column: str = "embedding", n: int = 15, explain: float = 0.9):
        rows = train.select(array_to_vector(F.col(column).cast("array<double>")).alias("raw"))
        self.column, self.n_rows = column, rows.count()
        self.model: PipelineModel = Pipeline(stages=[StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True), PCA(k=n, inputCol="scaled", outputCol="components")]).fit(rows)
        shares = self.model.stages[1].explainedVariance.toArray()
        total, self.least = 0.0, n
        for i, s in enumerate(shares):
            total += s
            if total > explain:
                self.least = i + 1
                break
        # Standard deviations are to divide by n, not n - 1.
        self.fix = math.sqrt(self.n_rows / (self.n_rows - 1)) if self.n_rows > 1 else 1.0
        self.loadings = self.model.stages[1].pc.toArray()[:, : self.least]
        fitted = self.embed(train)
        bounds = percentiles(fitted, {str(i): F.col("z")[i] for i in range(self.least)}, [0.05, 0.95])
        self.low, self.high = ([bounds[str(i)][k] for i in range(self.least)] for k in (0, 1))
        self.most_error = 1.5 * fitted.agg(F.max("error")).first()[0]

    def embed(self, df: DataFrame) -> DataFrame:
        """Adds z (components) and error (mean absolute error of the standardised row rebuilt from them)."""
        rows = self.model.transform(df.withColumn("raw", array_to_vector(F.col(self.column).cast("array<double>"))))
        scaled = F.transform(vector_to_array("scaled"), lambda x: x * self.fix)
        z = F.transform(F.slice(vector_to_array("components"), 1, self.least), lambda x: x * self.fix)
        rows = rows.withColumns({"scaled": scaled, "z": z})
        loadings = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in self.loadings])
        rebuilt = F.transform(loadings, lambda row: F.aggregate(F.zip_with(row, F.col("z"), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x))
        off = F.zip_with("scaled", rebuilt, lambda a, b: F.abs(a - b))
        return rows.withColumn("error", F.aggregate(off, F.lit(0.0), lambda a, x: a + x) / F.size(off)).drop("raw", "scaled", "components")

    def outliers(self, df: DataFrame) -> DataFrame:
        """Adds outside (a component beyond the 5th to 95th percentile of training) and unlike (an error over 1.5 times its largest)."""
        out = F.lit(False)
        for i in range(self.least):
            out = out | ~F.col("z")[i].between(self.low[i], self.high[i])
        return self.embed(df).withColumns({"outside": out, "unlike": F.col("error") > self.most_error})


def train_linear(matrix: DataFrame, features: list[str], target: str, kind: str = "elastic", alphas: list[float] | None = None, ratios: list[float] | None = None, n_folds: int = 5, seed: int = 0):
    """A cross-validated linear model on standardised features: (model, errors on the training rows).

    kind: elastic, lasso or ridge. Folds come from a seeded hash of run_id.
    """
    ratios = {"lasso": [1.0], "ridge": [0.0]}.get(kind, ratios or [0.1, 0.5, 0.9, 1.0])
    rows = folds(matrix.where(F.col(f"`{target}`").isNotNull()), n_folds, seed).withColumn("label", F.col(f"`{target}`").cast("double"))
    names = {c: f"f{i}" for i, c in enumerate(features)}
    rows = rows.select("run_id", "fold", "label", *[F.col(f"`{c}`").cast("double").alias(n) for c, n in names.items()])
    line = LinearRegression(featuresCol="scaled", labelCol="label", standardization=False)
    stages = Pipeline(stages=[VectorAssembler(inputCols=list(names.values()), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True), line])
    grid = ParamGridBuilder().addGrid(line.regParam, alphas or [0.001, 0.01, 0.1, 1.0]).addGrid(line.elasticNetParam, ratios).build()
    model = CrossValidator(estimator=stages, estimatorParamMaps=grid, evaluator=RegressionEvaluator(metricName="rmse"), numFolds=n_folds, foldCol="fold").fit(rows).bestModel
    return model, names, score(model.transform(rows))


def predict_linear(model: PipelineModel, names: dict[str, str], matrix: DataFrame) -> DataFrame:
    """run_id and prediction; a feature that the model needs and the matrix lacks is an error, others are ignored."""
    missing = [c for c in names if c not in matrix.columns]
    if missing:
        raise ValueError(f"features are missing: {missing}")
    return model.transform(matrix.select("run_id", *[F.col(f"`{c}`").cast("double").alias(n) for c, n in names.items()])).select("run_id", "prediction")


def score(predicted: DataFrame) -> dict[str, float]:
    """rmse, mae, r2 and the largest error of predictions (label, prediction)."""
    d = F.col("prediction") - F.col("label")
    r = predicted.agg(F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), F.max(F.abs(d)).alias("max_error"), F.sum(d * d).alias("rss"), (F.var_pop("label") * F.count("label")).alias("tss")).first()
    return {"rmse": r["rmse"], "mae": r["mae"], "r2": 1 - r["rss"] / r["tss"] if r["tss"] else float("nan"), "max_error": r["max_error"]}
