"""Drive-cycle waveforms: power from velocity, and run-length encoded steps for a tester."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import gradient

#: Metres per second of each unit, and the vehicle of the power model (SI units).
UNITS = {"mph": 1600.0 / 3600.0, "kmph": 1000.0 / 3600.0, "mps": 1.0}
VEHICLE = {"mass": 1500.0, "rolling": 0.01, "gravity": 9.8, "air": 1.225, "drag": 0.34, "area": 1.75}


def power_from_velocity(trace: DataFrame, unit: str = "mph") -> DataFrame:
    """trace (wave_id, time, velocity) as wave_id, time, power in W; charging is positive."""
    v = VEHICLE
    rows = trace.select("wave_id", "time", (F.col("velocity") * UNITS[unit]).alias("v"))
    w = W.partitionBy("wave_id").orderBy("time")
    force = v["mass"] * gradient("v", "time", w) + v["rolling"] * v["mass"] * v["gravity"] + 0.5 * v["air"] * v["drag"] * v["area"] * F.col("v") * F.col("v")
    return rows.select("wave_id", "time", (-force * F.col("v")).alias("power"))


def waveform_steps(trace: DataFrame, quantity: str = "power", mode: str = "P", scale: float = 1.0, charge: dict | None = None, discharge: dict | None = None, report: tuple[str, float] = ("T", 3.0), current_range: str = "A") -> DataFrame:
    """trace (wave_id, time, quantity) as tester steps: equal neighbours become one step with a duration in samples.

    Values are scaled to ``scale`` at the peak. charge, discharge: limit_mode, limit_value, end_mode,
    operation, end_mode_value of steps of either sign (0 counts as discharge).
    """
    limits = {"limit_mode": "V", "limit_value": 4.2, "end_mode": "V", "operation": ">=", "end_mode_value": 4.2}
    charge = limits | (charge or {})
    discharge = limits | {"limit_value": 2.7, "operation": "<=", "end_mode_value": 2.7} | (discharge or {})
    w = W.partitionBy("wave_id").orderBy("time")
    rows = trace.withColumn("x", F.col(quantity) / F.max(F.abs(F.col(quantity))).over(W.partitionBy("wave_id")) * scale)
    rows = rows.withColumn("_new", F.coalesce((F.col("x") != F.lag("x").over(w)).cast("int"), F.lit(0))).withColumn("step", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    steps = rows.groupBy("wave_id", "step").agg(F.count("*").alias("duration"), F.min_by("x", "time").alias("x"))
    down = F.col("x") <= 0
    pick = lambda k: F.when(down, F.lit(discharge[k])).otherwise(F.lit(charge[k])).alias(k)
    control = F.when((F.col("x") == 0) & (F.lit(mode) == "P"), "I").otherwise(mode)
    return steps.select(
        "wave_id",
        "step",
        F.when(down, "D").otherwise("C").alias("state"),
        control.alias("control_mode"),
        F.bround(F.abs("x"), 5).alias("value"),
        pick("limit_mode"),
        pick("limit_value"),
        "duration",
        pick("end_mode"),
        pick("operation"),
        pick("end_mode_value"),
        F.lit(report[0]).alias("report_mode"),
        F.lit(report[1]).alias("report_value"),
        F.lit(current_range).alias("range"),
    )


def splice(first: DataFrame, second: DataFrame, counters: tuple[str, ...] = ("data_point", "cycle_index", "test_time"), order: str = "data_point") -> DataFrame:
    """The rows of two parts of each run, one after the other; counters that restart in the second go on from the first's last value."""
    ends = first.groupBy("run_id").agg(*[F.max_by(c, order).alias(f"_end_{c}") for c in counters])
    starts = second.groupBy("run_id").agg(*[F.min_by(c, order).alias(f"_start_{c}") for c in counters])
    moved = second.join(ends.join(starts, "run_id"), "run_id", "left")
    shift = {c: F.when(F.col(f"_start_{c}") < F.col(f"_end_{c}"), F.col(c) + F.col(f"_end_{c}")).otherwise(F.col(c)) for c in counters}
    return first.withColumn("part", F.lit(1)).unionByName(moved.withColumns(shift).select(*second.columns).withColumn("part", F.lit(2)))
