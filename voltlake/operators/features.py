"""Feature vectors of runs, one row each, computed for the whole fleet at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import log_abs, summary_columns
from .cycles import constant_voltage_onset
from .life import cycle_life, thresholds, with_position


def curve_difference(curves: DataFrame, x: str, quantity: str, early: int, late: int) -> DataFrame:
    """quantity at cycle late minus cycle early on the common grid of x: run_id, x, diff. One aggregate, no self-join."""
    at = lambda c: F.max(F.when(F.col("cycle_index") == c, F.col(quantity)))
    rows = curves.where(F.col("cycle_index").isin(early, late)).groupBy("run_id", x).agg(at(late).alias("late"), at(early).alias("early"))
    return rows.select("run_id", F.col(x).alias("x"), (F.col("late") - F.col("early")).alias("diff")).where("diff is not null")


def difference_statistics(curves: dict[str, tuple[DataFrame, str, str]], early: int, late: int, digits: int | None = None) -> DataFrame:
    """Summary statistics (as log10 of their size) of the differences of several curves.

    curves: prefix -> (curves, axis, quantity); the result has a column <prefix>_<statistic> each.
    """
    out = None
    for prefix, (frame, x, quantity) in curves.items():
        one = curve_difference(frame, x, quantity, early, late).groupBy("run_id").agg(*summary_columns(F.col("diff"), prefix, True, digits))
        out = one if out is None else out.join(one, "run_id", "full")
    return out


def cycle_statistics(discharge: DataFrame, charge: DataFrame, early: int = 10, late: int = 100, x_discharge: str = "voltage", x_charge: str = "voltage", digits: int | None = None) -> DataFrame:
    """Statistics of capacity and energy curves of a late against an early cycle."""
    parts = {}
    for what in ("capacity", "energy"):
        if f"charge_{what}" in charge.columns:
            parts[f"charging_{what}"] = (charge, x_charge, f"charge_{what}")
        if f"discharge_{what}" in discharge.columns:
            parts[f"discharging_{what}"] = (discharge, x_discharge, f"discharge_{what}")
    return difference_statistics(parts, early, late, digits)


def delta_q(summary: DataFrame, discharge: DataFrame, mid: int = 91, final: int = 100, n_nominal: int = 40, digits: int | None = None) -> DataFrame:
    """Early-life features of fast charging: capacities, their trend, temperatures, resistance and the change of the discharge curve.

    Cycles of the summary are counted by place, those of curves by cycle_index, both from 0.
    """
    f, m = final - 1, mid - 1
    rows = with_position(summary)
    q, pos = F.col("discharge_capacity"), F.col("position")
    at = lambda c, p: F.max(F.when(pos == p, F.col(c)))
    between = lambda lo, hi: pos.between(lo, hi)
    trend = lambda lo, hi: (F.regr_slope(F.when(between(lo, hi), q), pos.cast("double")), F.regr_intercept(F.when(between(lo, hi), q), pos.cast("double")))
    slope, intercept = trend(1, f)
    slope9, intercept9 = trend(m, f)
    ir = F.nullif(F.col("dc_internal_resistance"), F.lit(0.0))
    features = {
        "discharge_capacity_cycle_2": at("discharge_capacity", 1),
        "max_discharge_capacity_difference": F.max(F.when(pos <= f, q)) - at("discharge_capacity", 1),
        "discharge_capacity_cycle_100": at("discharge_capacity", f),
        "integrated_time_temperature_cycles_1:100": F.coalesce(F.sum(F.when(pos <= f, F.col("time_temperature_integrated"))), F.lit(0.0)),
        "charge_time_cycles_1:5": F.avg(F.when(between(1, 5), F.col("charge_duration"))),
        "max_temperature_cycles_1:100": F.max(F.when(between(1, f), F.col("temperature_maximum"))),
        "min_temperature_cycles_1:100": F.min(F.when(between(1, f), F.col("temperature_minimum"))),
        "slope_discharge_capacity_cycle_number_2:100": slope,
        "intercept_discharge_capacity_cycle_number_2:100": intercept,
        "slope_discharge_capacity_cycle_number_91:100": slope9,
        "intercept_discharge_capacity_cycle_number_91:100": intercept9,
        "min_internal_resistance_cycles_2:100": F.min(F.when(between(1, f), ir)),
        "internal_resistance_cycle_2": at("dc_internal_resistance", 1),
        "internal_resistance_difference_cycles_2:100": at("dc_internal_resistance", f) - at("dc_internal_resistance", 1),
        "nominal_capacity_by_median": F.median(F.when(pos < n_nominal, q)),
    }
    d = F.col("diff")
    shape = {
        "min": F.min(d),
        "mean": F.avg(d),
        "variance": F.var_pop(d),
        "skew": F.skewness(d),
        "kurtosis": F.kurtosis(d),
        "first": F.min_by("diff", "x"),
    }
    tidy = lambda c: c if digits is None else F.round(F.nanvl(c, F.lit(None).cast("double")), digits)
    curve = curve_difference(discharge, "voltage", "discharge_capacity", 9, f)
    curve = curve.groupBy("run_id").agg(*[tidy(log_abs(c)).alias(f"abs_{k}_discharge_capacity_difference_cycles_2:100") for k, c in shape.items()])
    # Runs of fewer than ``final`` cycles have no such features.
    enough = rows.groupBy("run_id").agg(F.count("*").alias("_n"), *[tidy(c).alias(k) for k, c in features.items()]).where(F.col("_n") > f).drop("_n")
    return enough.join(curve, "run_id", "left")


def trajectory(summary: DataFrame, highest: float = 0.98, lowest: float = 0.78, step: float = 0.03, **how) -> DataFrame:
    """Cycles to each capacity threshold, a column each."""
    from .life import cycles_to

    return cycles_to(summary, thresholds(highest, lowest, step), **how)


def summary_differences(diagnostic: DataFrame, metrics: tuple[str, ...] = ("discharge_capacity", "discharge_energy", "charge_capacity", "charge_energy"), types: tuple[str, ...] = ("rpt_0.2C", "rpt_1C", "rpt_2C"), pos: tuple[int, int] = (0, 1)) -> DataFrame:
    """Relative change of each metric between two diagnostics of each type."""
    rows = diagnostic.withColumn("nth", F.row_number().over(W.partitionBy("run_id", "cycle_type").orderBy("cycle_index")) - 1)
    at = lambda t, p, c: F.max(F.when((F.col("cycle_type") == t) & (F.col("nth") == p), F.col(c)))
    columns = [F.try_divide(at(t, pos[1], c) - at(t, pos[0], c), at(t, pos[0], c)).alias(f"diag_sum_diff_{pos[0]}_{pos[1]}_{t}{c}") for t in types for c in metrics]
    return rows.groupBy("run_id").agg(*columns)


def _ends(left: DataFrame, end_of_life: float) -> DataFrame:
    """What is left at the end of each run, whether that is below end_of_life, and the cycle up to which it counts (cutoff)."""
    order = W.partitionBy("run_id").orderBy("cycle_index")
    filled = left.withColumn("filled", F.last("fractional_metric", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    filled = filled.withColumn("_before", F.lag("filled").over(order))
    ends = filled.groupBy("run_id").agg(
        F.max_by("filled", "cycle_index").alias("_last"),
        F.max_by("_before", "cycle_index").alias("_before"),
        F.min(F.when(F.col("fractional_metric") < end_of_life, F.col("cycle_index"))).alias("below_at"),
        F.max("cycle_index").alias("last_at"),
    )
    value = F.when(F.col("_last") > 1, F.coalesce("_before", "_last")).otherwise(F.col("_last"))
    ends = ends.withColumn("fractional_capacity_at_EOT", value).drop("_last", "_before")
    ends = ends.withColumn("is_below_fractional_capacity_at_EOT", F.col("fractional_capacity_at_EOT") < end_of_life)
    ends = ends.withColumn("cutoff", F.when(F.col("is_below_fractional_capacity_at_EOT"), F.col("below_at")).otherwise(F.col("last_at")))
    return ends


def not_early_cv(rows: DataFrame, charging: Column, parameters: DataFrame, left: DataFrame | None = None, end_of_life: float = 0.8, early: float = 0.3) -> DataFrame:
    """run_id and is_not_early_CV: no cycle's constant-voltage segment begins before the share ``early`` of its time.

    Only runs whose first charge current is above the second can fail. parameters: run_id,
    charge_constant_current_1 and _2. left (as in exclusion_criteria) ends the cycles at the run's end of life.
    """
    onset = constant_voltage_onset(rows, charging)
    if left is not None:
        onset = onset.join(_ends(left, end_of_life).select("run_id", "cutoff"), "run_id").where("cycle_index <= cutoff")
    found = onset.groupBy("run_id").agg(F.bool_or(F.coalesce(F.col("onset") < early, F.lit(False))).alias("_early"))
    faster = F.col("charge_constant_current_1") > F.col("charge_constant_current_2")
    out = parameters.select("run_id", faster.alias("_faster")).join(found, "run_id")
    return out.select("run_id", (~(F.coalesce("_faster", F.lit(False)) & F.col("_early"))).alias("is_not_early_CV"))


def exclusion_criteria(
    summary: DataFrame,
    left: DataFrame,
    capacity: float,
    n: int = 100,
    throughput_cutoff: float = 95.0,
    end_of_life: float = 0.8,
    full_cycles_cutoff: float = 100.0,
    early: DataFrame | None = None,
) -> DataFrame:
    """Whether a run is fit for training, and why.

    left: run_id, cycle_index, fractional_metric of one kind of diagnostic; the last value counts, or the
    one before it where the last is above 1. early: run_id, is_not_early_CV
    (of not_early_cv) where that is judged. to_include is true if all criteria are.
    """
    rows = with_position(summary)
    nth = rows.where(F.col("position") == n).select("run_id", F.coalesce("charge_throughput", F.lit(0.0)).alias("first_n_cycles_throughput"))
    order = W.partitionBy("run_id").orderBy("cycle_index")
    ends = _ends(left, end_of_life)
    spent = rows.withColumn("spent", F.last("charge_throughput", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    at_end = spent.join(ends.select("run_id", "cutoff"), "run_id").where("cycle_index <= cutoff").groupBy("run_id").agg((F.max_by("spent", "cycle_index") / capacity).alias("equivalent_full_cycles_at_EOL"))
    out = ends.join(nth, "run_id", "left").join(at_end, "run_id", "left")
    out = out.withColumns(
        {
            "is_above_first_n_cycles_throughput": F.coalesce(F.col("first_n_cycles_throughput") > throughput_cutoff, F.lit(False)),
            "is_above_equivalent_full_cycles_at_EOL": F.coalesce(F.col("equivalent_full_cycles_at_EOL") > full_cycles_cutoff, F.lit(False)),
        }
    )
    if early is not None:
        out = out.join(early, "run_id", "left")
    flags = [c for c in out.columns if c.startswith("is_")]
    fit = F.lit(True)
    for c in flags:
        fit = fit & F.coalesce(F.col(c), F.lit(False))
    return out.withColumn("to_include", fit).drop("below_at", "last_at", "cutoff")


def raw_curves(curves: DataFrame, types: list[str], positions: tuple[int, ...] = (0, 1), metrics: tuple[str, ...] = ("capacity", "dQdV", "test_time")) -> DataFrame:
    """Diagnostic curves as ordered arrays, in long form: run_id, channel, values.

    A capacity or energy is the smaller of the charged amount and what is left of it on discharge, with
    gaps filled forward then back; times count from the start of the step; missing others are 0.
    """
    rows = curves.where(F.col("cycle_type").isin(types))
    rows = rows.withColumns(
        {
            "pos": F.dense_rank().over(W.partitionBy("run_id", "cycle_type").orderBy("cycle_index")) - 1,
            "step": F.dense_rank().over(W.partitionBy("run_id", "cycle_index").orderBy("step_type")) - 1,
        }
    ).where(F.col("pos").isin(*positions))
    part = W.partitionBy("run_id", "cycle_index", "step_index")
    order = part.orderBy("step_index_counter", "test_time")
    zero = F.lit(0.0)
    parts = []
    for m in metrics:
        if m in ("capacity", "energy"):
            raw = F.least(F.col(f"charge_{m}"), F.max(f"charge_{m}").over(part) - F.col(f"discharge_{m}"))
            one = rows.withColumn("raw", raw)
            forward = F.last("raw", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
            back = F.first("raw", ignorenulls=True).over(order.rowsBetween(0, W.unboundedFollowing))
            one = one.withColumn("v", F.coalesce(forward, back))
        elif m == "test_time":
            one = rows.withColumn("v", F.coalesce(F.col(m) - F.min(m).over(part), zero))
        elif m == "dQdV":
            one = rows.withColumn("v", F.coalesce(F.col("charge_dQdV") + F.col("discharge_dQdV"), zero))
        else:
            one = rows.withColumn("v", F.col(m).cast("double"))
        name = F.format_string(f"diag_cycle_%d_%s_{m}_step_%d", "pos", "cycle_type", "step")
        parts.append(one.select("run_id", name.alias("channel"), "step_index_counter", "test_time", "v"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    values = F.transform(F.array_sort(F.collect_list(F.struct("step_index_counter", "test_time", "v"))), lambda s: s["v"])
    return out.groupBy("run_id", "channel").agg(values.alias("values"))


def charging_protocol(runs: DataFrame, parameters: DataFrame, columns: tuple[str, ...] = ("charge_constant_current_1", "charge_percent_limit_1", "charge_constant_current_2", "charge_cutoff_voltage", "charge_constant_voltage_time", "charge_rest_time")) -> DataFrame:
    """Protocol parameters of each run (run_id, project_name, seq_num), null where there are none."""
    return runs.join(parameters.select("project_name", "seq_num", *columns), ["project_name", "seq_num"], "left").select("run_id", *columns)


def cycle_life_feature(summary: DataFrame, threshold: float = 0.8, **how) -> DataFrame:
    return cycle_life(summary, [threshold], **how).select("run_id", "cycle_life")
