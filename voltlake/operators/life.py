"""Life of cells from their cycle summaries: cycle life, capacities at cycles, cycles to capacities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_position(summary: DataFrame) -> DataFrame:
    """Adds position: the place of a cycle among its run's, from 0."""
    return summary.withColumn("position", F.row_number().over(W.partitionBy("run_id").orderBy("cycle_index")) - 1)


def thresholds(highest: float = 0.98, lowest: float = 0.78, step: float = 0.03) -> list[float]:
    out, i = [], 0
    while highest - i * step > lowest + 1e-9:
        out.append(round(highest - i * step, 2))
        i += 1
    return out


def cycle_life(summary: DataFrame, at: list[float] = [0.8], n_cutoff: int = 40, default_capacity: float = 1.1) -> DataFrame:  # noqa: B006
    """For each run and threshold: position and cycle_index of the first cycle below threshold times the nominal capacity.

    Nominal is the median of the first n_cutoff cycles of a run that has more, else default_capacity. A run
    whose last cycle is still above the threshold gets its number of cycles plus 1, and no cycle_index.
    """
    rows = with_position(summary.select("run_id", "cycle_index", "discharge_capacity"))
    run = W.partitionBy("run_id")
    nominal = F.median(F.when(F.col("position") < n_cutoff, F.col("discharge_capacity"))).over(run)
    rows = rows.withColumns(
        {
            "n": F.count("*").over(run),
            "last": F.max_by("discharge_capacity", "position").over(run),
            "nominal": nominal,
        }
    ).withColumn("nominal", F.when(F.col("n") > n_cutoff, F.col("nominal")).otherwise(default_capacity))
    each = rows.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in at])))
    below = F.col("discharge_capacity") < F.col("threshold") * F.col("nominal")
    ended = F.col("last") / F.col("nominal") <= F.col("threshold")
    first = F.min(F.when(below, F.col("position")))
    found = each.groupBy("run_id", "threshold").agg(F.first("n").alias("n"), F.bool_or(ended).alias("ended"), first.alias("position"), F.min(F.when(below, F.col("cycle_index"))).alias("cycle_index"))
    return found.select("run_id", "threshold", F.when(F.col("ended"), F.col("position")).otherwise(F.col("n") + 1).cast("long").alias("cycle_life"), F.when(F.col("ended"), F.col("cycle_index")).alias("cycle_index"))


def capacities_at(summary: DataFrame, positions: list[int]) -> DataFrame:
    """The discharge capacity at each position, 0 where a run has no such cycle: a column cycle_<position> each."""
    rows = with_position(summary.select("run_id", "cycle_index", "discharge_capacity"))
    return rows.groupBy("run_id").agg(*[F.coalesce(F.max(F.when(F.col("position") == p, F.col("discharge_capacity"))), F.lit(0.0)).alias(f"cycle_{p}") for p in positions])


def cycles_to(summary: DataFrame, at: list[float] | None = None, **how) -> DataFrame:
    """Cycle life at every threshold, a column capacity_<threshold> each."""
    at = at or thresholds()
    long = cycle_life(summary, at, **how)
    return long.groupBy("run_id").agg(*[F.max(F.when(F.col("threshold") == t, F.col("cycle_life"))).alias(f"capacity_{t}") for t in at])
