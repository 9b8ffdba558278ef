"""Summaries of cycles: one row per run and cycle.

Raw samples are keyed by run_id, cycle_index, step_index and data_point; data_point orders a run. All
windows of a summary share one partitioning, by run and cycle, so that one shuffle serves them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CYCLE = ("run_id", "cycle_index")
CAPACITIES = ("charge_capacity", "discharge_capacity", "charge_energy", "discharge_energy")


def by_cycle() -> W:
    return W.partitionBy(*CYCLE).orderBy("data_point")


def _clean_ratio(top: str, bottom: str) -> Column:
    """top / bottom; null where that is not finite."""
    return F.try_divide(F.col(top), F.col(bottom))


def _seconds(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def running(x: str, over) -> Column:
    """Cumulative sum that leaves nulls where they are."""
    return F.when(F.col(x).isNotNull(), F.sum(x).over(over.rowsBetween(W.unboundedPreceding, 0)))


def longest_pause(threshold: float = 3600.0) -> Column:
    """Aggregate of samples with the column gap (seconds since the last): the longest gap above threshold, else 0."""
    return F.when(F.max("gap") > threshold, F.max("gap")).otherwise(0.0)


def with_gaps(raw: DataFrame) -> DataFrame:
    """Adds gap (seconds), minutes and temperature of the last sample of the cycle; needs date_time (timestamp)."""
    w = by_cycle()
    return raw.withColumns(
        {
            "gap": _seconds(F.col("date_time"), F.lag("date_time").over(w)),
            "last_temperature": F.lag("temperature").over(w),
        }
    )


def cycle_aggregates(raw: DataFrame, full_charge: float) -> DataFrame:
    """All aggregates of a cycle in one pass: maxima, last resistance, temperatures, times, integral, pause."""
    rows = with_gaps(raw)
    order = F.col("data_point")
    heat = (F.col("temperature") + F.col("last_temperature")) / 2 * F.col("gap") / 60
    reached = F.min_by("date_time", F.when(F.col("charge_capacity") >= full_charge, order))
    return rows.groupBy(*CYCLE).agg(
        *[F.max(c).alias(c) for c in CAPACITIES],
        F.max_by("internal_resistance", F.when(F.col("internal_resistance").isNotNull(), order)).alias("dc_internal_resistance"),
        F.max("temperature").alias("temperature_maximum"),
        F.avg("temperature").alias("temperature_average"),
        F.min("temperature").alias("temperature_minimum"),
        F.min_by("date_time", order).alias("date_time"),
        F.round(_seconds(reached, F.min_by("date_time", order)), 2).alias("charge_duration"),
        F.when(F.count_if(F.col("temperature").isNull()) == 0, F.coalesce(F.sum(heat), F.lit(0.0))).alias("time_temperature_integrated"),
        longest_pause().alias("paused"),
        F.min("voltage").alias("voltage_minimum"),
        F.max("voltage").alias("voltage_maximum"),
    )


def _segment(raw: DataFrame, charging: Column, dt_tol: float = 1.0, dv_tol: float = 1e-5, di_tol: float = 1e-4) -> DataFrame:
    """The samples of each cycle's charge with from_time, where its constant-voltage segment begins."""
    w = by_cycle()
    part = W.partitionBy(*CYCLE)
    dt = F.lead("test_time").over(w) - F.col("test_time")
    dv, di = (F.abs(F.try_divide(F.lead(c).over(w) - F.col(c), dt)) for c in ("voltage", "current"))
    no = F.lit(False)
    rows = raw.where(charging).withColumns({"rn": F.row_number().over(w) - 1, "n": F.count("*").over(part)})
    rows = rows.withColumn("moves", F.coalesce(dt < dt_tol, no) | F.coalesce(dv > dv_tol, no) | F.coalesce(di < di_tol, no))
    i = F.coalesce(F.min(F.when(~F.col("moves") & (F.col("rn") < F.col("n") - 1), F.col("rn"))).over(part), F.col("n") - 1)
    rows = rows.withColumn("i", i)
    start = F.when(F.col("i") == 0, F.col("n") - 1).otherwise(F.col("i") - 1)
    return rows.withColumn("from_time", F.max(F.when(F.col("rn") == start, F.col("test_time"))).over(part))


def constant_voltage(raw: DataFrame, charging: Column, **tolerances) -> DataFrame:
    """The constant-voltage segment of each cycle's charge: CV_time, CV_current and CV_capacity.

    The segment begins one sample before the first whose next is at least dt_tol later, moves by at most
    dv_tol volts and at least di_tol amperes a second; without one, at the second last sample; if it is
    the very first sample, at the last one.
    """
    rows = _segment(raw, charging, **tolerances)
    ends = lambda c: F.max_by(c, "rn") - F.min_by(c, "rn")
    return (
        rows.where("test_time >= from_time")
        .groupBy(*CYCLE)
        .agg(ends("test_time").alias("CV_time"), F.max_by("current", "rn").alias("CV_current"), ends("charge_capacity").alias("CV_capacity"))
    )


def constant_voltage_onset(raw: DataFrame, charging: Column, **tolerances) -> DataFrame:
    """run_id, cycle_index and onset: the share of the cycle's time that is over when its constant-voltage segment begins."""
    begins = _segment(raw, charging, **tolerances).groupBy(*CYCLE).agg(F.max("from_time").alias("from_time"))
    spans = raw.groupBy(*CYCLE).agg(F.min("test_time").alias("t0"), F.max("test_time").alias("t1"))
    return spans.join(begins, list(CYCLE)).select(*CYCLE, F.try_divide(F.col("from_time") - F.col("t0"), F.col("t1") - F.col("t0")).alias("onset"))


def summarize_cycles(
    raw: DataFrame,
    diagnostic: DataFrame | None = None,
    exclude: DataFrame | None = None,
    nominal_capacity: float = 1.1,
    full_fast_charge: float = 0.8,
    complete_ratio: float = 0.97,
    complete_vmin: float = 3.3,
    complete_vmax: float = 3.3,
    error_threshold: float = 1e6,
) -> DataFrame:
    """The regular cycles of each run, with throughputs; an incomplete last cycle is left out.

    diagnostic, exclude: (run_id, cycle_index) of cycles that are not regular or not wanted. The last
    cycle stays if its samples go below complete_vmin and above complete_vmax and it discharges more than
    complete_ratio of its charge, or if it is the only one.
    """
    found = cycle_aggregates(raw, nominal_capacity * full_fast_charge).join(constant_voltage(raw, F.col("current") > 0), list(CYCLE), "left")
    last_raw = W.partitionBy("run_id")
    found = found.withColumn("last_raw", F.max("cycle_index").over(last_raw))
    for cycles in (diagnostic, exclude):
        if cycles is not None:
            found = found.join(cycles.select(*CYCLE).distinct(), list(CYCLE), "left_anti")
    found = found.withColumn("energy_efficiency", _clean_ratio("discharge_energy", "charge_energy"))
    found = found.withColumns({c: F.when(F.abs(F.col(c)) <= error_threshold, F.col(c)) for c in ("charge_energy", "discharge_energy")})
    order = W.partitionBy("run_id").orderBy("cycle_index")
    found = found.withColumns({"charge_throughput": running("charge_capacity", order), "energy_throughput": running("charge_energy", order)})
    run = W.partitionBy("run_id")
    complete = (
        (F.max_by("voltage_minimum", "cycle_index").over(run) < complete_vmin)
        & (F.max_by("voltage_maximum", "cycle_index").over(run) > complete_vmax)
        & (F.col("discharge_capacity") > complete_ratio * F.col("charge_capacity"))
    )
    found = found.withColumn("keep", (F.col("cycle_index") < F.max("cycle_index").over(run)) | (F.count("*").over(run) == 1) | F.coalesce(complete, F.lit(False)))
    return found.where("keep").drop("keep", "last_raw", "voltage_minimum", "voltage_maximum")


def summarize_diagnostic(raw: DataFrame, diagnostic: DataFrame, full_charge: float = 0.88) -> DataFrame:
    """The diagnostic cycles (run_id, cycle_index, cycle_type), with coulombic efficiency; none is left out."""
    rows = raw.join(diagnostic.select(*CYCLE, "cycle_type"), list(CYCLE))
    first_step = W.partitionBy(*CYCLE)
    charge = rows.withColumn("first_step", F.min("step_index").over(first_step))
    cv = constant_voltage(charge, F.col("step_index") == F.col("first_step"))
    found = cycle_aggregates(rows, full_charge).join(cv, list(CYCLE), "left").join(diagnostic.select(*CYCLE, "cycle_type"), list(CYCLE))
    found = found.withColumns({"energy_efficiency": _clean_ratio("discharge_energy", "charge_energy"), "coulombic_efficiency": _clean_ratio("discharge_capacity", "charge_capacity")})
    return found.drop("dc_internal_resistance", "voltage_minimum", "voltage_maximum")
