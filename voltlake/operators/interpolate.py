"""Resampling of curves onto regular grids, with unions and windows only.

For each resampled column: a grid point that hits a sample takes that sample's value (of several, the
first's; if that is null, the last that is not); between samples the value is linear between the nearest
non-null neighbours; before the first it is null, after the last it stays at it. Each column has its own
nulls and so its own neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .steps import STEP, classify_steps, waveform_steps, with_step_counter, with_step_order


def grid(bounds: DataFrame, keys: list[str], n: int | None, x: str) -> DataFrame:
    """n points (or as many as the column n of bounds says) from lo to hi for each row of bounds (keys, lo, hi): lo + i * ((hi - lo) / (n - 1)), and hi itself."""
    i, n = F.col("_i"), F.col("n") if n is None else F.lit(n)
    point = F.when(i == n - 1, F.col("hi")).otherwise(F.col("lo") + i * ((F.col("hi") - F.col("lo")) / (n - 1)))
    bounds = bounds.where("lo is not null and hi is not null").withColumn("n", n)
    return bounds.select(*keys, "lo", "hi", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("_i")).select(*keys, point.alias(x)).distinct()


def interpolate(samples: DataFrame, bounds: DataFrame, keys: list[str], x: str, columns: list[str], n: int | None = None) -> DataFrame:
    """samples (keys, data_point, x, columns) at the grid of each row of bounds (keys, lo, hi): keys, x, columns."""
    samples = samples.where(F.col(x).isNotNull()).repartition(*keys)
    order = F.col("data_point")
    known = {c: F.when(F.col(c).isNotNull(), order) for c in columns}
    points = samples.groupBy(*keys, x).agg(
        *[
            F.struct(F.max(x).alias("x"), F.coalesce(F.min_by(c, order), F.max_by(c, known[c])).alias("hit"), F.max_by(c, known[c]).alias("before"), F.min_by(c, known[c]).alias("after")).alias(c)
            for c in columns
        ]
    )
    points = points.withColumns({c: F.when(F.col(c)["before"].isNotNull(), F.col(c)) for c in columns}).withColumn("_grid", F.lit(0))
    wanted = grid(bounds, keys, n, x).withColumn("_grid", F.lit(1))
    rows = points.unionByName(wanted, allowMissingColumns=True)
    # What follows is looked up in descending order: a frame to the end of the curve would be read anew for every row.
    w, back = W.partitionBy(*keys).orderBy(x, "_grid"), W.partitionBy(*keys).orderBy(F.desc(x), F.desc("_grid"))
    left, right = (o.rowsBetween(W.unboundedPreceding, -1) for o in (w, back))
    sides = {}
    for c in columns:
        sides[f"_l_{c}"] = F.last(c, ignorenulls=True).over(left)
        sides[f"_r_{c}"] = F.last(c, ignorenulls=True).over(right)
    rows = rows.withColumns(sides).where("_grid = 1")

    def value(c: str) -> Column:
        before, after = F.col(f"_l_{c}"), F.col(f"_r_{c}")
        slope = (F.col(x) - before["x"]) / (after["x"] - before["x"])
        between = before["before"] + (after["after"] - before["before"]) * slope
        return F.when(before["x"] == F.col(x), before["hit"]).when(after.isNull(), before["before"]).otherwise(between).alias(c)

    return rows.select(*keys, x, *map(value, columns))


def interpolate_steps(
    raw: DataFrame,
    charge: bool,
    axis: str = "voltage",
    v_range: tuple[float, float] | None = None,
    resolution: int = 1000,
    columns: tuple[str, ...] = ("current", "charge_capacity", "discharge_capacity", "temperature"),
    cycles: DataFrame | None = None,
) -> DataFrame:
    """The charge (or discharge) steps of all cycles on a grid of ``axis``: a curve for each step of two or more samples.

    The grid spans v_range on the voltage axis, the run's whole range on a capacity axis, and the step's
    own range on test_time. cycles: (run_id, cycle_index) to keep.
    """
    if axis not in ("voltage", "charge_capacity", "discharge_capacity", "test_time"):
        raise ValueError(f"no grid is defined on {axis}")
    if axis == "voltage" and v_range is None:
        v_range = (2.8, 3.5)
    steps = classify_steps(raw).where((F.col("is_charge") == charge) & (F.col("n_points") > 1)).select(*STEP)
    if cycles is not None:
        steps = steps.join(cycles.select("run_id", "cycle_index").distinct(), ["run_id", "cycle_index"], "left_semi")
    if axis == "voltage":
        bounds = steps.withColumns({"lo": F.lit(float(v_range[0])), "hi": F.lit(float(v_range[1]))})
    elif axis == "test_time":
        bounds = raw.groupBy(*STEP).agg(F.min(axis).alias("lo"), F.max(axis).alias("hi")).join(steps, list(STEP), "left_semi")
    else:
        bounds = steps.join(raw.groupBy("run_id").agg(F.min(axis).alias("lo"), F.max(axis).alias("hi")), "run_id")
    columns = [c for c in columns if c != axis]
    out = interpolate(raw.join(steps, list(STEP), "left_semi"), bounds, list(STEP), axis, columns, resolution)
    return out.withColumn("step_type", F.lit("charge" if charge else "discharge"))


def interpolate_cycles(raw: DataFrame, v_range: tuple | None = None, resolution: int = 1000, charge_axis: str = "charge_capacity", discharge_axis: str = "voltage", cycles: DataFrame | None = None) -> DataFrame:
    """Discharge and charge curves of the cycles, in long form with columns axis and x.

    A run with a waveform step in one direction has that direction on the time axis. Steps are told apart
    once, and all are resampled in one pass: a step's axis is its x. v_range: two numbers, or two columns of
    raw that are the same in all rows of a run.
    """
    if v_range is None:
        v_range = (2.8, 3.5)
    steps = classify_steps(raw)
    axis = F.when(F.col("is_charge"), F.lit(charge_axis)).otherwise(F.lit(discharge_axis))
    if "_wf_chg_cap" in raw.columns:
        waves = waveform_steps(raw).where("is_waveform").join(steps, list(STEP)).select("run_id", "is_charge", F.lit(True).alias("_wave")).distinct()
        steps, axis = steps.join(waves, ["run_id", "is_charge"], "left"), F.when(F.col("_wave"), F.lit("test_time")).otherwise(axis)
    steps = steps.where("n_points > 1").select(*STEP, F.when(F.col("is_charge"), "charge").otherwise("discharge").alias("step_type"), axis.alias("axis"))
    if cycles is not None:
        steps = steps.join(cycles.select("run_id", "cycle_index").distinct(), ["run_id", "cycle_index"], "left_semi")
    axes = sorted({charge_axis, discharge_axis} | ({"test_time"} if "_wf_chg_cap" in raw.columns else set()))
    of_axis = lambda choose: F.coalesce(*[F.when(F.col("axis") == a, choose(a)) for a in axes])
    rows = raw.join(steps, list(STEP)).withColumn("_x", of_axis(F.col))
    capacities = [a for a in axes if a in ("charge_capacity", "discharge_capacity")]
    volts = [F.min(v if isinstance(v, Column) else F.lit(float(v))).alias(f"_v{k}") for k, v in enumerate(v_range)]
    bounds = rows.groupBy(*STEP, "axis").agg(F.min("_x").alias("_x0"), F.max("_x").alias("_x1"), *volts)
    if capacities:
        bounds = bounds.join(raw.groupBy("run_id").agg(*[f(a).alias(f"{a}_{k}") for a in capacities for f, k in ((F.min, 0), (F.max, 1))]), "run_id")
    end = lambda k: lambda a: F.col(f"_v{k}") if a == "voltage" else F.col(f"_x{k}") if a == "test_time" else F.col(f"{a}_{k}")
    bounds = bounds.select(*STEP, of_axis(end(0)).alias("lo"), of_axis(end(1)).alias("hi"))
    columns = ["current", "charge_capacity", "discharge_capacity", "temperature"]
    out = interpolate(rows, bounds, list(STEP), "_x", columns, resolution).join(steps, list(STEP))
    own = [F.when(F.col("axis") == c, F.col("_x")).otherwise(F.col(c) if c in columns else F.lit(None)).alias(c) if c in axes else F.col(c) for c in dict.fromkeys([*axes, *columns])]
    return out.select(*STEP, *own, "step_type", "axis")


def interpolate_diagnostic(raw: DataFrame, diagnostic: DataFrame, time_resolution: int = 1000, voltage_resolution: int = 1000, v_delta_min: float = 0.001, dv_fallback: tuple[float, float] | None = None) -> DataFrame:
    """Curves of every step occurrence of the diagnostic cycles (run_id, cycle_index, cycle_type).

    A step that moves by less than v_delta_min volts is on the time axis, others on voltage: over their own
    range in hppc cycles, over dv_fallback (else their own range) in the rest. Occurrences that give fewer
    than two points are left out. Adds dQ/dV of both capacities along the curve.
    """
    keys = ["run_id", "cycle_index", "step_index", "step_index_counter"]
    rows = with_step_order(with_step_counter(raw.join(diagnostic.select("run_id", "cycle_index", "cycle_type"), ["run_id", "cycle_index"])))
    span = rows.groupBy(*keys, "cycle_type", "step_type").agg(
        F.min("voltage").alias("v0"), F.max("voltage").alias("v1"), F.min("test_time").alias("t0"), F.max("test_time").alias("t1")
    )
    flat = (F.col("v1") - F.col("v0")) < v_delta_min
    span = span.withColumn("_axis", F.when(flat, "test_time").when(~flat, "voltage")).where("_axis is not null")
    timed = F.col("_axis") == "test_time"
    lo, hi = F.col("v0"), F.col("v1")
    if dv_fallback:
        lo, hi = (F.when(F.col("cycle_type") == "hppc", v).otherwise(F.lit(float(f))) for v, f in ((lo, dv_fallback[0]), (hi, dv_fallback[1])))
    bounds = span.select(*keys, F.when(timed, F.col("t0")).otherwise(lo).alias("lo"), F.when(timed, F.col("t1")).otherwise(hi).alias("hi"), F.when(timed, time_resolution).otherwise(voltage_resolution).alias("n"))
    columns = ["voltage", "current", "test_time", "charge_capacity", "discharge_capacity", "charge_energy", "discharge_energy", "internal_resistance", "temperature"]
    # Each occurrence has one axis, so that all are resampled in one pass.
    rows = rows.join(span.select(*keys, "_axis"), keys).withColumn("_x", F.when(timed, F.col("test_time")).otherwise(F.col("voltage")))
    out = interpolate(rows, bounds, keys, "_x", columns).join(span.select(*keys, "cycle_type", "step_type", "_axis"), keys)
    out = out.withColumns({"test_time": F.when(timed, F.col("_x")).otherwise(F.col("test_time")), "voltage": F.when(timed, F.col("voltage")).otherwise(F.col("_x"))})
    w = W.partitionBy(*keys).orderBy("_x")
    for c in ("charge", "discharge"):
        rise = F.col(f"{c}_capacity") - F.lag(f"{c}_capacity").over(w)
        out = out.withColumn(f"{c}_dQdV", F.try_divide(rise, F.col("voltage") - F.lag("voltage").over(w)))
    return out.withColumn("_n", F.count("*").over(W.partitionBy(*keys))).where("_n > 1").drop("_n", "_x", "_axis")
