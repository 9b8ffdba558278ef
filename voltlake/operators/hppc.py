"""Pulse tests (HPPC): which step is which, resistances, rest voltages and diffusion slopes.

curves: diagnostic curves of the hppc cycles with run_id, cycle_index, step_index, step_index_counter,
test_time, voltage, current. A diagnostic's position counts the hppc cycles of its run, from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import kurtosis_unbiased
from .splines import v_diff

CYCLE = ("run_id", "cycle_index")
OCCURRENCE = (*CYCLE, "step_index", "step_index_counter")


def with_position(curves: DataFrame) -> DataFrame:
    return curves.withColumn("position", F.dense_rank().over(W.partitionBy("run_id").orderBy("cycle_index")) - 1)


def with_roles(curves: DataFrame, capacity: float, pulse_time: float = 120, pulse_rate: float = 0.5, long_rest: float = 600, soc_change: float = 0.05) -> DataFrame:
    """Adds role, that of the row's step in its hppc cycle (null where no rule fits), by windows in one order: curves
    that are dealt out by run_id stay where they are. Rows without a run, cycle or step are left out."""
    # The limits of the rules (seconds, rate, share of capacity), above, and the rounding of rates to two places.
    order = ("step_index", "step_index_counter", "test_time")
    cycle = W.partitionBy(*CYCLE).orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    occurrence, step = W.partitionBy(*OCCURRENCE).orderBy("test_time"), W.partitionBy(*CYCLE, "step_index")
    whole = occurrence.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = curves.where(" and ".join(f"{c} is not null" for c in (*CYCLE, "step_index"))).withColumn("_end", F.max("test_time").over(cycle))
    rows = rows.withColumns({"_i": F.row_number().over(occurrence), "_span": F.max("test_time").over(whole) - F.min("test_time").over(whole)})
    rows = rows.withColumn("_each", F.when(F.col("_i") == 1, F.col("_span")))
    rows = rows.withColumns(
        {
            "_m": F.bround(F.median("current").over(step) / capacity, 2),
            "_mean": F.bround(F.avg("current").over(step) / capacity, 2),
            "_left": F.col("_end") - F.max("test_time").over(step),
            "_d": F.bround(F.median("_each").over(step), 0),
            "_recurring": F.sum((F.col("_i") == 1).cast("int")).over(step) > 1,
        }
    )
    m, d = F.col("_m"), F.col("_d")
    role = (
        F.when((m == 0) & (d > long_rest), "hppc_long_rest")
        .when((m == 0) & (d > 0), "hppc_short_rest")
        .when(m == 0, F.lit(None).cast("string"))
        .when((m <= -pulse_rate) & (d < pulse_time), "hppc_discharge_pulse")
        .when((m >= pulse_rate) & (d < pulse_time), "hppc_charge_pulse")
        .when((m < 0) & (F.col("_left") == 0) & ~F.col("_recurring"), "hppc_final_discharge")
        .when((F.col("_mean") == m) & (m < 0) & (F.abs(F.col("_mean") * d / 3600) > soc_change), "hppc_discharge_to_next_soc")
        .when((m > 0) & (d > pulse_time), "hppc_charge_to_soc")
    )
    return rows.select(*[c for c in curves.columns if c != "role"], role.alias("role"))


def step_roles(curves: DataFrame, capacity: float, **limits: float) -> DataFrame:
    """The role of every step of an hppc cycle: run_id, cycle_index, step_index, role (null where no rule fits). limits: those of with_roles."""
    return with_roles(curves, capacity, **limits).select(*CYCLE, "step_index", "role").distinct()


def rpt_roles(curves: DataFrame, capacity: float) -> DataFrame:
    """The role of every step of rpt and reset cycles (curves with cycle_type): run_id, cycle_index, step_index, role.

    A step charges or discharges by the sign of its median rate, to two places; null where that is 0.
    """
    rates = curves.where(F.col("cycle_type").rlike("^(rpt_|reset)")).groupBy(*CYCLE, "step_index", "cycle_type").agg(F.bround(F.median("current") / capacity, 2).alias("median"))
    side = F.when(F.col("median") > 0, "_charge").when(F.col("median") < 0, "_discharge")
    return rates.select(*CYCLE, "step_index", F.concat("cycle_type", side).alias("role"))


def _windows(rows: DataFrame) -> DataFrame:
    rows = with_position(rows.where(F.col("current").isNotNull())).where("role is not null")
    return rows.withColumn("window", F.dense_rank().over(W.partitionBy(*CYCLE, "step_index").orderBy("step_index_counter")) - 1)


def windows_of(curves: DataFrame, roles: DataFrame) -> DataFrame:
    """Adds role, position, and window: the number of a step's occurrence in its cycle, from 0 (a state of charge).

    The roles are joined by a shuffle: what is known of their size before they are made is no reason to broadcast them.
    """
    keys = [*CYCLE, "step_index"]
    return _windows(curves.join(roles.select(*keys, "role").hint("merge"), keys, "left").where(" and ".join(f"{c} is not null" for c in CYCLE)))


def windows_by_rules(curves: DataFrame, capacity: float, **limits: float) -> DataFrame:
    """windows_of with the roles that the rules of with_roles give, without a join."""
    return _windows(with_roles(curves, capacity, **limits))


WINDOW = ("run_id", "position", "window")


def _placed(rows: DataFrame, n_windows: int) -> DataFrame:
    """Rows of the first windows with their place in the part of their role: back (from the end, from 1), since (seconds from its start), n, v0 (its least voltage)."""
    order = W.partitionBy(*WINDOW, "role").orderBy(F.desc("test_time"))
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return rows.where(F.col("window") < n_windows).withColumns(
        {"back": F.row_number().over(order), "since": F.col("test_time") - F.min("test_time").over(whole), "n": F.count(F.lit(1)).over(whole), "v0": F.min("voltage").over(whole)}
    )


def _resistance_columns() -> tuple[list[Column], list[Column]]:
    """Aggregates of _placed, and the resistances of them."""

    def last(role: str, upto: float | None, column: str):
        here = F.col("role") == role
        if upto is not None:
            here = here & (F.col("since") <= upto)
        return F.max_by(column, F.when(here, F.col("test_time")))

    found, out = {}, []
    for side, pulse, rest in (("c", "hppc_charge_pulse", "hppc_short_rest"), ("d", "hppc_discharge_pulse", "hppc_long_rest")):
        found[f"v_{side}"] = last(rest, None, "voltage")
        found[f"i_{side}"] = F.avg(F.when((F.col("role") == rest) & (F.col("back") <= 5), F.col("current")))
        for name, upto in (("0s", 0.001), ("3s", 3.0), ("end", None)):
            found[f"v_{side}_{name}"] = last(pulse, upto, "voltage")
            found[f"i_{side}_{name}"] = last(pulse, upto, "current")
            out.append(F.try_divide(F.col(f"v_{side}_{name}") - F.col(f"v_{side}"), F.col(f"i_{side}_{name}") - F.col(f"i_{side}")).alias(f"r_{side}_{name}"))
    return [v.alias(k) for k, v in found.items()], out


def resistances(rows: DataFrame, n_windows: int = 9) -> DataFrame:
    """Pulse resistances of windows_of: run_id, position, window, and r_c_0s, r_c_3s, r_c_end, r_d_0s, r_d_3s, r_d_end.

    (V - V_rest) / (I - I_rest) at up to 1 ms, up to 3 s and the end of a pulse; at rest the last voltage and
    the mean of the last five currents. A charge pulse follows the short rest, a discharge pulse the long one.
    """
    found, out = _resistance_columns()
    return _placed(rows, n_windows).groupBy(*WINDOW).agg(*found).select(*WINDOW, *out)


RESISTANCES = ("r_c_0s", "r_c_3s", "r_c_end", "r_d_0s", "r_d_3s", "r_d_end")


def _at(position: int, window: int, column: str) -> Column:
    return F.max(F.when((F.col("position") == position) & (F.col("window") == window), F.col(column)))


def _resistance_changes(position: int, n_windows: int) -> list[Column]:
    return [F.try_divide(_at(position, w, c) - _at(0, w, c), _at(0, w, c)).alias(f"{c}_{w}0") for c in RESISTANCES for w in range(n_windows)]


def resistance_change(found: DataFrame, position: int, n_windows: int = 9) -> DataFrame:
    """Relative change of each resistance at each window from the first diagnostic, a column <name>_<window>0 each."""
    return found.groupBy("run_id").agg(*_resistance_changes(position, n_windows))


def _rest_statistics(x: Column, digits: int | None) -> list[Column]:
    stats = {"var": F.var_pop(x), "min": F.min(x), "mean": F.avg(x), "skew": F.skewness(x), "kurtosis": kurtosis_unbiased(x), "sum": F.sum(F.abs(x)), "sum_square": F.sum(x * x)}
    return [(v if digits is None else F.round(v, digits)).alias(f"{k}_ocv") for k, v in stats.items()]


def rest_voltage_change(rows: DataFrame, position: int, n_windows: int = 9, digits: int | None = None) -> DataFrame:
    """Statistics of the change of the tenth last rest voltage of each window between the first diagnostic and a later one."""
    rest = rows.where((F.col("role") == "hppc_long_rest") & (F.col("window") < n_windows))
    rest = rest.withColumn("back", F.row_number().over(W.partitionBy("run_id", "position", "window").orderBy(F.desc("test_time")))).where("back = 10")
    at = lambda p: F.max(F.when(F.col("position") == p, F.col("voltage")))
    d = rest.groupBy("run_id", "window").agg((at(0) - at(position)).alias("d")).where("d is not null")
    return d.groupBy("run_id").agg(*_rest_statistics(F.col("d"), digits))


def _late() -> Column:
    return (F.col("role") == "hppc_short_rest") & (F.col("n") - F.col("back") + 1 > F.bround(2 * F.col("n") / 3, 0))


def _slope(rows: DataFrame) -> tuple[DataFrame, Column]:
    """_placed with the time of each window's discharge pulse, and the aggregate of the slope of diffusion."""
    pulse = F.when(F.col("role") == "hppc_discharge_pulse", F.col("test_time"))
    window = W.partitionBy(*WINDOW)
    rows = rows.withColumn("t_pulse", F.max(pulse).over(window) - F.min(pulse).over(window))
    late = _late()
    x = F.sqrt(F.col("since") + F.col("t_pulse")) - F.sqrt("since")
    return rows, F.regr_slope(F.when(late, F.col("voltage") - F.col("v0")), F.when(late, x))


def diffusion(rows: DataFrame, n_windows: int = 9) -> DataFrame:
    """Slope of the rest voltage against sqrt(t + t_pulse) - sqrt(t) over the last third of the short rest: run_id, position, window, slope."""
    pulse = F.col("role") == "hppc_discharge_pulse"
    rows, slope = _slope(_placed(rows.where((F.col("window") > 0) & (pulse | (F.col("role") == "hppc_short_rest"))), n_windows))
    # A window has a row if it has a pulse and a last third.
    there = [F.max(x.cast("int")) for x in (pulse, _late())]
    return rows.groupBy(*WINDOW).agg(slope.alias("slope"), (there[0] + there[1]).alias("_n")).where("_n = 2").drop("_n")


def _diffusion_changes(position: int, n_windows: int) -> list[Column]:
    return [F.try_divide(_at(position, w, "slope") - _at(0, w, "slope"), _at(0, w, "slope")).alias(f"D_{w}") for w in range(1, n_windows)]


def diffusion_change(found: DataFrame, position: int, n_windows: int = 9) -> DataFrame:
    return found.groupBy("run_id").agg(*_diffusion_changes(position, n_windows))


def pulse_changes(rows: DataFrame, position: int, n_windows: int = 9, digits: int | None = None) -> DataFrame:
    """resistance_change, rest_voltage_change and diffusion_change of windows_of in one pass over its rows, a row a run."""
    rows, slope = _slope(_placed(rows, n_windows))
    found, out = _resistance_columns()
    rest = F.max(F.when((F.col("role") == "hppc_long_rest") & (F.col("back") == 10), F.col("voltage")))
    each = rows.groupBy(*WINDOW).agg(*found, rest.alias("rest"), slope.alias("slope")).select(*WINDOW, *out, "rest", "slope")
    changes = [*_resistance_changes(position, n_windows), *_diffusion_changes(position, n_windows)]
    runs = each.groupBy("run_id").agg(*changes, F.array(*[_at(0, w, "rest") - _at(position, w, "rest") for w in range(n_windows)]).alias("_d"))
    kept = [c for c in runs.columns if c not in ("run_id", "_d")]
    runs = runs.select("run_id", *kept, F.explode("_d").alias("_d")).groupBy("run_id").agg(*[F.first(c).alias(c) for c in kept], *_rest_statistics(F.col("_d"), digits))
    order = [c for c in runs.columns if not c.startswith("D_")] + [c for c in kept if c.startswith("D_")]
    return runs.select(*order)


def hppc_features(curves: DataFrame, capacity: float, position: int = 1, digits: int | None = None, soc_window: int | None = None) -> DataFrame:
    """Resistance, rest voltage and diffusion features of each run, from diagnostic curves of its hppc cycles.

    soc_window: also the change of voltage over capacity (splines.v_diff) in that window; needs discharge_capacity.
    """
    rows = windows_by_rules(curves, capacity)
    out = pulse_changes(rows, position, digits=digits)
    if soc_window is not None:
        part = v_diff(rows.where(F.col("window") == soc_window), position, digits).drop("window")
        out = out.join(part.hint("merge"), "run_id", "full")
    return out
