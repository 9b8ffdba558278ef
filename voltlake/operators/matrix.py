"""Feature matrices: runs by features, and their cleaning."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.quantiles import percentiles


def feature_name(feature: str, featurizer: str, parameters: dict) -> str:
    """feature::featurizer::sha256 of its parameters."""
    return f"{feature}::{featurizer}::{hashlib.sha256(json.dumps(parameters, sort_keys=True).encode()).hexdigest()}"


def without_hash(df: DataFrame) -> DataFrame:
    """Renames a::B::hash to a::B."""
    return df.toDF(*["::".join(c.split("::")[:2]) for c in df.columns])


def feature_matrix(parts: list[tuple[DataFrame, str, dict]]) -> DataFrame:
    """The features of all parts (frame with run_id, featurizer, parameters) in one row for each run.

    Parts become long rows and are pivoted at once, so any number of featurizers takes one shuffle. A
    featurizer twice with the same parameters is an error.
    """
    names = [(featurizer, json.dumps(p, sort_keys=True)) for _, featurizer, p in parts]
    if len(set(names)) < len(names):
        raise ValueError("a featurizer is given twice with the same parameters")
    long, columns = None, []
    for df, featurizer, p in parts:
        own = [c for c in df.columns if c != "run_id"]
        named = [feature_name(c, featurizer, p) for c in own]
        columns += named
        pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"`{c}`").cast("double").alias("value")) for c, n in zip(own, named)])
        one = df.select("run_id", F.explode(pairs).alias("f")).select("run_id", "f.*")
        long = one if long is None else long.unionByName(one)
    return long.groupBy("run_id").pivot("feature", columns).agg(F.first("value"))


def clean(matrix: DataFrame, column_share: float = 0.75, row_share: float = 0.75, impute: str = "median") -> DataFrame:
    """Infinite to null; columns then rows with too few values go; the rest is filled by exact median or mean (or 'none')."""
    features = [f.name for f in matrix.schema if f.name != "run_id" and isinstance(f.dataType, (T.DoubleType, T.FloatType, T.LongType, T.IntegerType))]
    q = lambda c: F.col(f"`{c}`")
    finite = matrix.select("run_id", *[F.when(F.abs(q(c).cast("double")) < float("inf"), q(c).cast("double")).alias(c) for c in features])
    counts = finite.agg(F.count("*").alias("_n"), *[F.count(q(c)).alias(c) for c in features]).first()
    kept = [c for c in features if counts[c] >= column_share * counts["_n"]]
    have = sum((q(c).isNotNull().cast("int") for c in kept), F.lit(0))
    rows = finite.select("run_id", *[q(c) for c in kept]).where(have >= row_share * len(kept))
    if impute == "none" or not kept:
        return rows
    if impute == "median":
        fill = {c: v[0] for c, v in percentiles(rows, {c: q(c) for c in kept}, [0.5]).items()}
    elif impute == "mean":
        fill = rows.agg(*[F.avg(q(c)).alias(c) for c in kept]).first()
    else:
        raise ValueError(f"{impute!r} is not median, mean or none")
    return rows.select("run_id", *[F.coalesce(q(c), F.lit(fill[c]).cast("double")).alias(c) for c in kept])


def folds(rows: DataFrame, n: int, seed: int = 0, group: str | None = None) -> DataFrame:
    """Adds fold (0 to n-1): rows, or whole groups, in the order of a seeded hash, dealt out in turn."""
    from pyspark.sql import Window as W

    key = group or "run_id"
    keys = rows.select(key).distinct().withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    # Keys are ranked within hash buckets, so that no task orders all of them; sizes of folds differ by the number of buckets at most.
    ranked = keys.withColumn("fold", (F.row_number().over(W.partitionBy(F.substring("_h", 1, 2)).orderBy("_h")) + F.conv(F.substring("_h", 1, 2), 16, 10).cast("int")) % n)
    return rows.join(ranked.select(key, F.col("fold").cast("int")), key)


def drop_excluded_groups(rows: DataFrame, flags: list[str], group: str, least_share: float = 0.5) -> DataFrame:
    """Rows for which all flags hold, without groups of which less than least_share is left."""
    from pyspark.sql import Window as W

    ok = F.lit(True)
    for f in flags:
        ok = ok & F.coalesce(F.col(f), F.lit(False))
    share = F.avg(ok.cast("double")).over(W.partitionBy(group))
    return rows.withColumn("_share", share).where(ok & (F.col("_share") >= least_share)).drop("_share")
