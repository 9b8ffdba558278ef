"""From structured tables to feature matrices, models and predictions, for a whole library of runs.

A featurizer is a function of a folder's tables and its parameters that gives one row for each run_id. Own
ones are named package.module.function. Matrices, models and predictions are written with a JSON file of
what made them beside them.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diagnostic_features, features, grams, hppc, life, matrix, models


class Structured:
    """The structured tables of a folder, read when asked for; one that is missing is an error that says what to run first."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self, name: str) -> DataFrame:
        try:
            return self.spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            raise ValueError(f"{self.path} has no table {name}: structure the runs{' with diagnostic cycles' if 'diagnostic' in name else ''} first") from e

    @property
    def summary(self) -> DataFrame:
        return self.table("summary")

    @property
    def diagnostic_summary(self) -> DataFrame:
        return self.table("diagnostic_summary")

    @property
    def diagnostic_curves(self) -> DataFrame:
        return self.table("diagnostic_curves")

    def side(self, step_type: str) -> DataFrame:
        return self.table("curves").where(F.col("step_type") == step_type)


#: The featurizers by name, each with its default parameters.
FEATURIZERS: dict[str, tuple[Callable[..., DataFrame], dict]] = {
    # Charge curves are over their capacity, so only discharges differ in it.
    "cycle_statistics": (lambda t, **p: features.cycle_statistics(t.side("discharge"), t.side("charge").drop("charge_capacity"), **p), {"early": 10, "late": 100}),
    "delta_q": (lambda t, **p: features.delta_q(t.summary, t.side("discharge"), **p), {"mid": 91, "final": 100, "n_nominal": 40}),
    "trajectory": (lambda t, **p: features.trajectory(t.summary, **p), {"highest": 0.98, "lowest": 0.78, "step": 0.03}),
    "cycle_life": (lambda t, **p: features.cycle_life_feature(t.summary, **p), {"threshold": 0.8}),
    "capacities": (lambda t, **p: life.capacities_at(t.summary, **p), {"positions": [20, 40, 60, 80, 100]}),
    "summary_differences": (lambda t, **p: features.summary_differences(t.diagnostic_summary, **p), {"pos": [0, 1]}),
    "diagnostic_statistics": (lambda t, **p: diagnostic_features.diagnostic_statistics(t.diagnostic_curves, t.diagnostic_summary, **p), {"capacity": 4.84, "cycle_type": "rpt_0.2C", "pos": [0, 1]}),
    "diagnostic_properties": (lambda t, **p: diagnostic_features.diagnostic_properties(t.summary, t.diagnostic_summary, **p), {"metric": "discharge_energy", "cycle_type": "rpt_1C", "threshold": 0.8, "extrapolate": True}),
    "electrodes": (lambda t, **p: diagnostic_features.electrode_features(t.diagnostic_curves, **p), {}),
    "hppc": (lambda t, **p: hppc.hppc_features(t.diagnostic_curves.where("cycle_type = 'hppc'"), **p), {"capacity": 4.84, "position": 1, "soc_window": 8}),
}


#: Names for several featurizers at once.
ALL = {"all_features": ("hppc", "delta_q", "diagnostic_statistics", "cycle_statistics"), "all_targets": ("trajectory", "diagnostic_properties")}


def featurizer(name: str) -> tuple[Callable[..., DataFrame], dict]:
    """The featurizer of that name, or the function at the dotted path; its defaults are its attribute ``defaults``."""
    if name in FEATURIZERS:
        return FEATURIZERS[name]
    module, _, function = name.rpartition(".")
    if not module:
        raise ValueError(f"{name!r} is neither a featurizer ({', '.join(FEATURIZERS)}) nor package.module.function")
    f = getattr(importlib.import_module(module), function)
    return f, dict(getattr(f, "defaults", {}))


def _write_json(spark: SparkSession, what: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(what, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def featurize(spark: SparkSession, path: str, out: str, wanted: dict[str, dict | None]) -> DataFrame:
    """wanted: featurizer -> parameters (over its defaults). Writes out/matrix and out/matrix_metadata; returns the matrix.

    all_features and all_targets stand for those in ALL, with their defaults where they are not named too.
    """
    tables, parts = Structured(spark, path), []
    wanted = {n: wanted.get(n) for name in wanted for n in ALL.get(name, (name,))}
    for name, given in wanted.items():
        f, defaults = featurizer(name)
        p = {**defaults, **(given or {})}
        parts.append((f(tables, **p), name.rpartition(".")[2], p))
    matrix.feature_matrix(parts).write.mode("overwrite").parquet(f"{out}/matrix")
    _write_json(spark, {"structured": path, "featurizers": [{"name": n, "parameters": p} for _, n, p in parts]}, f"{out}/matrix_metadata")
    return spark.read.parquet(f"{out}/matrix")


def train(spark: SparkSession, x: str, y: str, out: str, target: str | list[str], kind: str = "elastic", column_share: float = 0.75, row_share: float = 0.75, impute: str = "median", drop_hash: bool = True, **how) -> dict:
    """A linear model of column target of the matrix y on the clean matrix x: writes out/model and out/model_metadata; returns its errors.

    Runs are joined by run_id, so both matrices may have runs that the other lacks. drop_hash: features are
    named without the hash of their parameters, so that a model fits matrices of other parameters. Several
    targets (kind elastic only) share their features; their model is in the metadata, and errors are by target.
    """
    left, right = spark.read.parquet(x), spark.read.parquet(y)
    if drop_hash:
        left, right = matrix.without_hash(left), matrix.without_hash(right)
    targets = [target] if isinstance(target, str) else list(target)
    missing = [t for t in targets if t not in right.columns]
    if missing:
        raise ValueError(f"{', '.join(map(repr, missing))} is not a column of {y}: {right.columns}")
    if len(targets) > 1 and kind != "elastic":
        raise ValueError(f"a model of kind {kind} has one target")
    clean = matrix.clean(left, column_share, row_share, impute)
    rows = clean.join(right.select("run_id", *[F.col(f"`{t}`").alias(f"_target{i}") for i, t in enumerate(targets)]), "run_id")
    names = [c for c in clean.columns if c != "run_id"]
    about = {"target": target, "kind": kind, "x": x, "y": y, "drop_hash": drop_hash}
    if len(targets) > 1:
        fitted, found = grams.train_targets(rows, names, [f"_target{i}" for i in range(len(targets))], **how)
        fitted.targets = targets
        errors = {t: found[f"_target{i}"] for i, t in enumerate(targets)}
        about |= {"features": names, "model": fitted.to_dict()}
    else:
        model, columns, errors = models.train_linear(rows, names, "_target0", kind, **how)
        model.write().overwrite().save(f"{out}/model")
        about["features"] = columns
    _write_json(spark, {**about, "errors": errors}, f"{out}/model_metadata")
    return errors


def predict(spark: SparkSession, x: str, model: str, out: str) -> DataFrame:
    """Predictions for the runs of matrix x that have all features of the model: writes and returns run_id, target, prediction."""
    about = _read_json(spark, f"{model}/model_metadata")
    rows = spark.read.parquet(x)
    rows = matrix.without_hash(rows) if about["drop_hash"] else rows
    whole = F.lit(True)
    for c in about["features"]:
        if c in rows.columns:
            whole = whole & F.col(f"`{c}`").isNotNull()
    if "model" in about:
        found = grams.TargetsModel(**about["model"]).predict(rows.where(whole))
        pairs = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"`prediction::{t}`").alias("prediction")) for t in about["target"]]))
        found.select("run_id", pairs.alias("p")).select("run_id", "p.*").write.mode("overwrite").parquet(out)
        return spark.read.parquet(out)
    found = models.predict_linear(PipelineModel.load(f"{model}/model"), about["features"], rows.where(whole))
    found.select("run_id", F.lit(about["target"]).alias("target"), "prediction").write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)
