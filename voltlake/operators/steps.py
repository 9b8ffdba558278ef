"""Steps within cycles: occurrences, order, direction, and vendor accumulators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STEP = ("run_id", "cycle_index", "step_index")


def with_step_counter(raw: DataFrame) -> DataFrame:
    """Adds step_index_counter: the number of the contiguous run of a step within its cycle, from 1 (gaps and islands)."""
    w = W.partitionBy("run_id", "cycle_index").orderBy("data_point")
    new = F.when(F.col("step_index").eqNullSafe(F.lag("step_index").over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return raw.withColumn("_new", new).withColumn("step_index_counter", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def with_step_order(raw: DataFrame) -> DataFrame:
    """Adds step_type: the place of a step among its cycle's steps by first appearance, from 0."""
    first = F.min("data_point").over(W.partitionBy(*STEP))
    return raw.withColumn("_first", first).withColumn("step_type", F.dense_rank().over(W.partitionBy("run_id", "cycle_index").orderBy("_first")) - 1).drop("_first")


def classify_steps(raw: DataFrame, indeterminate_is_charge: bool = True, jump: float = 0.99) -> DataFrame:
    """Whether each step charges: run_id, cycle_index, step_index, is_charge, determined.

    The mean increments of charge and discharge capacity are compared; an increment of over ``jump`` of
    the step's whole range is left out. Without a decision the step counts as indeterminate_is_charge.
    """
    w = W.partitionBy(*STEP).orderBy("data_point")
    part = W.partitionBy(*STEP)
    rows = raw.select(*STEP, "data_point", "charge_capacity", "discharge_capacity")
    for c, d in (("charge_capacity", "chg"), ("discharge_capacity", "dchg")):
        rows = rows.withColumns({f"{d}_diff": F.col(c) - F.lag(c).over(w), f"{d}_range": F.max(c).over(part) - F.min(c).over(part)})
    means = [F.avg(F.when(~F.coalesce(F.try_divide(F.col(f"{d}_diff"), F.col(f"{d}_range")) > jump, F.lit(False)), F.col(f"{d}_diff"))).alias(d) for d in ("chg", "dchg")]
    found = rows.groupBy(*STEP).agg(*means, F.count("*").alias("n_points"))
    chg, dchg = F.col("chg"), F.col("dchg")
    decided = (
        F.when(chg.isNull() & dchg.isNull(), F.lit(None).cast("boolean"))
        .when(chg.isNull(), ~(dchg > 0))
        .when(dchg.isNull(), chg > 0)
        .when((chg > dchg) & (chg > 0), True)
        .when((chg < dchg) & (dchg > 0), False)
    )
    # With only the discharge mean known, a step that does not discharge counts as charge; and the other way round.
    return found.select(*STEP, F.coalesce(decided, F.lit(indeterminate_is_charge)).alias("is_charge"), decided.isNotNull().alias("determined"), "n_points")


def waveform_steps(raw: DataFrame) -> DataFrame:
    """Steps driven by a waveform: run_id, cycle_index, step_index, is_waveform (false without the vendor's waveform columns)."""
    marks = [c for c in ("_wf_chg_cap", "_wf_dis_cap") if c in raw.columns]
    found = F.bool_or(F.coalesce(*map(F.col, marks)).isNotNull()) if marks else F.lit(False)
    return raw.groupBy(*STEP).agg(found.alias("is_waveform"))


def accumulate(raw: DataFrame, quantity: str, state: str, waveform: str | None = None, out: str = "total", least: int = 128, most: int = 255) -> DataFrame:
    """Adds out: a quantity that the tester resets at each step, made non-decreasing through the steps of a cycle.

    Only rows whose _state is ``state`` count, others are 0; where the waveform column has a value it
    counts instead. A step ends where _ending_status is between least and most and step_index changes in
    the next row; the value there is carried to the rows after it, until the row that starts a later
    segment lies in another cycle than the row before it.
    """
    w = W.partitionBy("run_id").orderBy("data_point")
    value = F.when(F.col("_state") == state, F.col(quantity)).otherwise(F.lit(0.0))
    if waveform:
        value = F.coalesce(F.col(waveform), value)
    ends = F.col("_ending_status").between(least, most) & F.coalesce(F.col("step_index") != F.lead("step_index").over(w), F.lit(False))
    rows = raw.withColumns({"_value": value, "_end": F.coalesce(ends, F.lit(False)).cast("int"), "_rn": F.row_number().over(w)})
    before = w.rowsBetween(W.unboundedPreceding, -1)
    # The segment of a row: how many ends precede it. The very first row stands outside of the first segment.
    rows = rows.withColumn("_seg", F.coalesce(F.sum("_end").over(before), F.lit(0)))
    cycle_changed = F.coalesce(F.lag("cycle_index").over(w) != F.col("cycle_index"), F.lit(False))
    starts = F.coalesce(F.lag("_end").over(w) == 1, F.lit(False)) | (F.col("_rn") == 2)
    closed = F.max("_end").over(W.partitionBy("run_id", "_seg")) == 1
    rows = rows.withColumn("_reset", (starts & cycle_changed & closed).cast("int")).withColumn("_era", F.sum("_reset").over(w.rowsBetween(W.unboundedPreceding, 0)))
    carried = F.coalesce(F.sum(F.when(F.col("_end") == 1, F.col("_value"))).over(W.partitionBy("run_id", "_era").orderBy("data_point").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return rows.withColumn(out, F.col("_value") + carried).drop("_value", "_end", "_rn", "_seg", "_reset", "_era")


def cycles_from_rules(raw: DataFrame, rules: DataFrame, on_start: int = 0, on_loop: int = 0, loop: str | None = None) -> DataFrame:
    """Adds cycle_index from transitions of the sequence number: rules are (source, target, advance).

    Counting starts at 1 + on_start. A change of the loop column advances by on_loop; else a change of
    sequence advances by its rule, if any.
    """
    w = W.partitionBy("run_id").orderBy("data_point")
    rows = raw.withColumn("_from", F.lag("sequence").over(w))
    rows = rows.join(rules.select(F.col("source").alias("_from"), F.col("target").alias("sequence"), "advance"), ["_from", "sequence"], "left")
    step = F.when(F.col("_from").isNull() | (F.col("_from") == F.col("sequence")), 0).otherwise(F.coalesce("advance", F.lit(0)))
    if loop:
        before = F.lag(loop).over(w)
        step = F.when(F.coalesce(before != F.col(loop), F.lit(False)), on_loop).otherwise(step)
    return rows.withColumn("_step", step).withColumn("cycle_index", 1 + on_start + F.sum("_step").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_from", "_step", "advance")
