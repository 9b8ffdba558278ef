"""Diagnostic cycles: which they are, and how much of a quantity a cell has left at each."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .interpolate import interpolate


def from_step_numbers(raw: DataFrame, criteria: dict[str, tuple[str, Iterable[Iterable[int]]]]) -> DataFrame:
    """Diagnostic cycles by the steps they have: run_id, cycle_index, cycle_type.

    criteria: type -> (rule, patterns). 'contains' matches a cycle that has all steps of a pattern, 'exact'
    one that has no other steps besides; one matching pattern is enough. A cycle of two types is an error.
    """
    steps = raw.groupBy("run_id", "cycle_index").agg(F.collect_set("step_index").alias("steps"))
    kinds = []
    for kind, (rule, patterns) in criteria.items():
        if rule not in ("contains", "exact"):
            raise ValueError(f"{rule!r} is not a rule for matching steps")
        hit = F.lit(False)
        for p in patterns:
            p = sorted(set(p))
            here = F.size(F.array_except(F.array(*[F.lit(x) for x in p]).cast("array<int>"), F.col("steps").cast("array<int>"))) == 0
            hit = hit | (here if rule == "contains" else here & (F.size("steps") == len(p)))
        kinds.append(F.when(hit, F.lit(kind)))
    found = steps.withColumn("kinds", F.array_compact(F.array(*kinds)))
    one = F.when(F.size("kinds") > 1, F.raise_error(F.concat(F.lit("cycle "), F.col("cycle_index").cast("string"), F.lit(" is of several types: "), F.array_join("kinds", ", ")))).otherwise(F.col("kinds")[0])
    return found.where(F.size("kinds") > 0).select("run_id", "cycle_index", one.alias("cycle_type"))


#: The cycles of a diagnostic, in order.
HPPC_RPT = ("reset", "hppc", "rpt_0.2C", "rpt_1C", "rpt_2C")


def from_patterns(raw: DataFrame, runs: DataFrame, types: tuple[str, ...] = HPPC_RPT) -> DataFrame:
    """The diagnostic cycles of each run by the steps of its first two diagnostics: run_id, cycle_index, cycle_type.

    runs: run_id and diagnostic_start_cycle (the regular cycles before the second diagnostic; the first
    starts at cycle 1). A diagnostic starts wherever a cycle has the same set of steps as the first cycle of
    one of the two, and, among the last cycles, where the numbers of steps of as many cycles are the same
    (a final diagnostic). One array of step sets is kept for each run.
    """
    n = len(types)
    sets = raw.groupBy("run_id", "cycle_index").agg(F.array_sort(F.collect_set("step_index")).alias("steps"))
    w = W.partitionBy("run_id").orderBy("cycle_index")
    # Cycles that a run does not have count 0 steps.
    near = F.collect_list(F.struct(F.col("cycle_index").alias("c"), F.size("steps").alias("n"))).over(w.rangeBetween(0, n - 1))
    rows = sets.withColumn("_near", near)
    rows = rows.withColumn("sizes", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.aggregate("_near", F.lit(None).cast("int"), lambda a, s: F.when(s["c"] == F.col("cycle_index") + i, s["n"]).otherwise(a)), F.lit(0)))).drop("_near")
    rows = rows.join(runs.select("run_id", (F.col("diagnostic_start_cycle") + 1 + n).alias("_second")), "run_id")
    run = W.partitionBy("run_id")
    at = lambda c, here: F.max(F.when(here, F.col(c))).over(run)
    first, second = F.col("cycle_index") == 1, F.col("cycle_index") == F.col("_second")
    rows = rows.withColumns({"s0": at("steps", first), "s1": at("steps", second), "n0": at("sizes", first), "n1": at("sizes", second), "last": F.max("cycle_index").over(run)})
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    final = (F.col("cycle_index") >= F.col("last") - n - 1) & (same("sizes", "n0") | same("sizes", "n1"))
    starts = rows.where(same("steps", "s0") | same("steps", "s1") | final)
    marked = starts.select("run_id", F.col("cycle_index").alias("_start"), F.posexplode(F.array(*map(F.lit, types))).alias("_i", "cycle_type")).withColumn("cycle_index", F.col("_start") + F.col("_i"))
    # Where starts overlap the later one counts; only cycles that there are.
    marked = marked.groupBy("run_id", "cycle_index").agg(F.max_by("cycle_type", "_start").alias("cycle_type"))
    return marked.join(sets.select("run_id", "cycle_index"), ["run_id", "cycle_index"], "left_semi")


def without_stray_finals(curves: DataFrame, late: float = 1e6, early_cycle: int = 6) -> DataFrame:
    """Leaves out points after ``late`` seconds in cycles before early_cycle (a final diagnostic misnumbered), and step occurrences without any time."""
    kept = curves.where(~((F.col("test_time") > late) & (F.col("cycle_index") < early_cycle)) | F.col("test_time").isNull() | F.col("cycle_index").isNull())
    has = F.count("test_time").over(W.partitionBy("run_id", "cycle_index", "step_index", "step_index_counter")) > 0
    return kept.withColumn("_has", has).where("_has").drop("_has")


def fraction_left(diagnostic: DataFrame, metric: str = "discharge_energy", cycle_type: str = "rpt_0.2C", after_cycle: int = 100) -> DataFrame:
    """metric of the diagnostics of one type after a cycle, relative to the first diagnostic of that type."""
    rows = diagnostic.where(F.col("cycle_type") == cycle_type)
    first = F.min_by(metric, "cycle_index").over(W.partitionBy("run_id"))
    return rows.withColumn("fractional_metric", F.try_divide(F.col(metric), first)).where(F.col("cycle_index") > after_cycle).select("run_id", "cycle_index", "fractional_metric")


def fraction_left_nx(summary: DataFrame, diagnostic: DataFrame, metric: str = "discharge_energy", cycle_types: list[str] | None = None) -> DataFrame:
    """What is left of metric at each diagnostic, and the throughput before it in units of the initial one.

    The initial throughput is that of the regular cycles up to the first gap in their numbers. Instead of
    a range join, both kinds of cycles are put in one order and running maxima are read off.
    """
    quantity = "discharge_energy" if "energy" in metric else "discharge_capacity"
    order = W.partitionBy("run_id").orderBy("cycle_index")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    regular = summary.where("cycle_index <> 0").join(diagnostic.select("run_id", "cycle_index").distinct(), ["run_id", "cycle_index"], "left_anti")
    regular = regular.select("run_id", "cycle_index", F.sum(quantity).over(upto).alias("regular"), (F.col("cycle_index") - F.lag("cycle_index").over(order) > 1).alias("gap"))
    gap_at = F.min(F.when(F.col("gap"), F.col("cycle_index"))).over(W.partitionBy("run_id"))
    initial = regular.withColumn("gap_at", gap_at).where("cycle_index < gap_at").groupBy("run_id").agg(F.max_by("regular", "cycle_index").alias("initial_regular_throughput"))
    marks = diagnostic.select(
        "run_id",
        "cycle_index",
        "cycle_type",
        "date_time",
        F.sum(quantity).over(upto).alias("diagnostic"),
        F.try_divide(F.col(metric), F.first(metric).over(upto)).alias("fractional_metric"),
    )
    rows = regular.select("run_id", "cycle_index", "regular").unionByName(marks, allowMissingColumns=True)
    before = order.rangeBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({"r": F.max("regular").over(before), "d": F.max("diagnostic").over(before), "last_regular": F.max(F.when(F.col("regular").isNotNull(), F.col("cycle_index"))).over(W.partitionBy("run_id"))})
    rows = rows.where("cycle_type is not null and cycle_index <= last_regular").join(initial, "run_id")
    if cycle_types is not None:
        rows = rows.where(F.col("cycle_type").isin(cycle_types))
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("initial_regular_throughput")), F.lit(0.0))
    return rows.select(
        "run_id",
        "cycle_index",
        "cycle_type",
        "fractional_metric",
        "initial_regular_throughput",
        share("r").alias("normalized_regular_throughput"),
        share("d").alias("normalized_diagnostic_throughput"),
        F.unix_seconds("date_time").alias("epoch_time"),
    )


def threshold_crossing(points: DataFrame, x: str, y: str = "fractional_metric", threshold: float = 0.8, extrapolate: bool = True, n: int = 1000, filter_kinks: float | None = None) -> DataFrame:
    """Where y comes closest to threshold on a grid of n values of x: run_id, crossing.

    points: run_id, cycle_index, x, y. A run that never gets down to the threshold is continued linearly
    from its last two points to 0.1 below the threshold, or left out without extrapolate. filter_kinks: cut
    a run at its first cycle whose second difference of y is below this.
    """
    w = W.partitionBy("run_id").orderBy("cycle_index")
    rows = points.select("run_id", "cycle_index", F.col(x).alias("x"), F.col(y).alias("y"))
    if filter_kinks is not None:
        rows = rows.withColumn("d", F.col("y") - F.lag("y").over(w)).withColumn("dd", F.col("d") - F.lag("d").over(w))
        cut = F.min(F.when(F.col("dd") < filter_kinks, F.col("cycle_index"))).over(W.partitionBy("run_id"))
        rows = rows.withColumn("cut", cut).where("cut is null or cycle_index < cut")
    ends = rows.groupBy("run_id").agg(F.min("y").alias("y_min"), F.min("x").alias("lo"), F.max("x").alias("x_max"), F.sort_array(F.collect_list(F.struct("cycle_index", "x", "y")), False).alias("all"))
    last, prior = F.col("all")[0], F.get(F.col("all"), F.lit(1))
    slope = F.try_divide(last["y"] - prior["y"], last["x"] - prior["x"])
    beyond = F.col("y_min") > threshold
    reach = prior["x"] + F.try_divide((threshold - 0.1 - prior["y"]) * (last["x"] - prior["x"]), last["y"] - prior["y"])
    ends = ends.select("run_id", "lo", F.when(beyond, reach).otherwise(F.col("x_max")).alias("hi"), beyond.alias("beyond"), last["x"].alias("x1"), last["y"].alias("y1"), slope.alias("slope"))
    if not extrapolate:
        ends = ends.where(~F.col("beyond"))
    found = interpolate(rows.withColumnRenamed("cycle_index", "data_point"), ends, ["run_id"], "x", ["y"], n).join(ends, "run_id")
    value = F.when(F.col("beyond") & (F.col("x") > F.col("x1")), F.col("y1") + (F.col("x") - F.col("x1")) * F.col("slope")).otherwise(F.col("y"))
    return found.withColumn("off", F.abs(value - threshold)).where("off is not null").groupBy("run_id").agg(F.min_by("x", F.struct("off", "x")).alias("crossing"))
