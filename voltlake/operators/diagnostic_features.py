"""Features and targets of runs from their diagnostics: changes of curves, cycles to thresholds, electrode losses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import summary_columns
from . import diagnostics, hppc, matching
from .features import summary_differences

#: The curves of a diagnostic in their order: quantity, side and name in the features.
CURVES = (
    ("charge_capacity", "charge", "charging_capacity"),
    ("discharge_capacity", "discharge", "discharging_capacity"),
    ("charge_energy", "charge", "charging_energy"),
    ("discharge_energy", "discharge", "discharging_energy"),
    ("charge_dQdV", "charge", "charging_dQdV"),
    ("discharge_dQdV", "discharge", "discharging_dQdV"),
)


def diagnostic_statistics(curves: DataFrame, summary: DataFrame, capacity: float, cycle_type: str = "rpt_0.2C", pos: tuple[int, int] = (0, 1), digits: int | None = None) -> DataFrame:
    """Statistics (log10 of their size) of the changes of six curves between two diagnostics of a type, and the
    relative changes of their summaries: a row for each run that has both.

    curves: diagnostic_curves; summary: diagnostic_summary. Curves of one side are compared point by point
    in the order of their grids; points that either lacks are left out. Cycles of misnumbered final
    diagnostics are left out first.
    """
    rows = diagnostics.without_stray_finals(curves).where(F.col("cycle_type") == cycle_type)
    roles = hppc.rpt_roles(rows, capacity).where("role is not null")
    rows = rows.join(roles, ["run_id", "cycle_index", "step_index"])
    rows = rows.withColumn("_nth", F.dense_rank().over(W.partitionBy("run_id").orderBy("cycle_index")) - 1).where(F.col("_nth").isin(*pos))
    place = F.row_number().over(W.partitionBy("run_id", "_nth", "role").orderBy("step_index", "step_index_counter", "voltage", "test_time"))
    at = lambda c, p: F.max(F.when(F.col("_nth") == p, F.col(c)))
    quantities = [c for c, _, _ in CURVES]
    paired = rows.withColumn("_place", place).groupBy("run_id", "role", "_place").agg(*[(at(c, pos[1]) - at(c, pos[0])).alias(c) for c in quantities])
    of_side = lambda c, side: F.when(F.col("role") == f"{cycle_type}_{side}", F.col(c))
    found = paired.groupBy("run_id").agg(*[s for c, side, name in CURVES for s in summary_columns(of_side(c, side), name, True, digits)])
    both = rows.groupBy("run_id").agg(F.count_distinct("_nth").alias("_n")).where(F.col("_n") == len(set(pos))).select("run_id")
    changes = summary_differences(summary, pos=pos)
    return found.join(both, "run_id").join(changes, "run_id", "left")


def diagnostic_properties(
    summary: DataFrame,
    diagnostic: DataFrame,
    metric: str = "discharge_energy",
    cycle_type: str = "rpt_1C",
    axes: tuple[str, ...] = ("normalized_regular_throughput", "cycle_index"),
    threshold: float = 0.8,
    extrapolate: bool = True,
    filter_kinks: float | None = None,
    n: int = 1000,
) -> DataFrame:
    """How far a run gets, on each of axes, until a metric of its diagnostics falls to a threshold.

    Columns: run_id, initial_regular_throughput, <cycle_type><metric><threshold>_<axis> and, with the normalised
    throughput, the same in real_regular_throughput. Only diagnostics of the type and metric count. A run
    without a positive value on an axis is left out.
    """
    points = diagnostics.fraction_left_nx(summary, diagnostic.where(F.col("cycle_type") == cycle_type), metric)
    prefix = f"{cycle_type}{metric}{threshold}_"
    out = points.groupBy("run_id").agg(F.min_by("initial_regular_throughput", "cycle_index").alias("initial_regular_throughput"))
    for axis in axes:
        rows = points.select("run_id", "cycle_index", F.col(axis).cast("double").alias("_x"), "fractional_metric")
        found = diagnostics.threshold_crossing(rows, "_x", threshold=threshold, extrapolate=extrapolate, n=n, filter_kinks=filter_kinks)
        out = out.join(found.where("crossing > 0").select("run_id", F.col("crossing").alias(prefix + axis)), "run_id")
    if "normalized_regular_throughput" in axes:
        real = F.col(f"`{prefix}normalized_regular_throughput`") * F.col("initial_regular_throughput")
        out = out.withColumn(f"{prefix}real_regular_throughput", real)
    return out


def electrode_losses(fits: DataFrame) -> DataFrame:
    """fits (match_electrodes) with the losses since a run's first fit: lli_loss (of the positive's first capacity, percent), lam_pe and lam_ne (percent)."""
    w = W.partitionBy("run_id").orderBy("cycle_index").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first = lambda c: F.first(c, ignorenulls=True).over(w)
    share = lambda c: (1 - F.try_divide(F.col(c), first(c))) * 100
    return fits.withColumns({"lli_loss": F.try_divide(F.col("lli") - first("lli"), first("q_pe")) * 100, "lam_pe": share("q_pe"), "lam_ne": share("q_ne")})


def electrode_features(curves: DataFrame, pe: list, ne: list, bounds: dict, cycle_type: str = "rpt_0.2C", step_type: int = 0, least_capacity: float = 0.0, positions: int = 2, **how) -> DataFrame:
    """Fitted electrodes of the first diagnostics of a type: a row for each run, diag_<k>_<parameter> for k below positions.

    curves: diagnostic_curves, of which one step type (0 charges) of cycles that reach more than least_capacity counts. how:
    parameters of match_electrodes. What a run has no diagnostic for is null.
    """
    side = "charge_capacity" if step_type == 0 else "discharge_capacity"
    rows = curves.where((F.col("cycle_type") == cycle_type) & (F.col("step_type") == step_type))
    most = F.max(side).over(W.partitionBy("run_id", "cycle_index"))
    rows = rows.withColumn("_most", most).where(F.col("_most") > least_capacity)
    nth = F.dense_rank().over(W.partitionBy("run_id").orderBy("cycle_index")) - 1
    rows = rows.withColumn("_nth", nth).where(F.col("_nth") < positions)
    fits = electrode_losses(matching.match_electrodes(rows.select("run_id", "cycle_index", F.col(side).alias("q"), "voltage"), pe, ne, bounds, **how))
    place = F.row_number().over(W.partitionBy("run_id").orderBy("cycle_index")) - 1
    names = [c for c in fits.columns if c not in ("run_id", "cycle_index", "generations")]
    fits = fits.withColumn("_nth", place)
    return fits.groupBy("run_id").agg(*[F.max(F.when(F.col("_nth") == k, F.col(c))).alias(f"diag_{k}_{c}") for k in range(positions) for c in names])
