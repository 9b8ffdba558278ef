"""Cycle numbers of runs that a tester writes as several files, by rules, and the rules from tables of steps.

A run consists of techniques, one file each. A technique's rules tell by how much the cycle advances when it
starts, when it loops, and when one sequence follows another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The fields of a rule file.
RULE_FILE = (
    "tech_num int, tech_does_loop boolean, adv_cycle_on_start int, adv_cycle_on_tech_loop int, "
    "adv_cycle_seq_transitions array<struct<source: int, target: int, adv_cycle_count: int>>"
)
MEASURED, ADVANCE, OPEN, CLOSE = "measured", "advance", "loop_open", "loop_close"


def read_rules(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rule files (JSON) as file, technique, loops, on_start, on_loop and transitions (source, target, advance); a file that is none has null columns."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", RULE_FILE).alias("r"))
    transitions = F.transform("r.adv_cycle_seq_transitions", lambda t: F.struct(t["source"].alias("source"), t["target"].alias("target"), t["adv_cycle_count"].alias("advance")))
    return whole.select(
        "file",
        F.col("r.tech_num").alias("technique"),
        F.col("r.tech_does_loop").alias("loops"),
        F.coalesce("r.adv_cycle_on_start", F.lit(0)).alias("on_start"),
        F.coalesce("r.adv_cycle_on_tech_loop", F.lit(0)).alias("on_loop"),
        transitions.alias("transitions"),
    )


def cycles_across_files(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds cycle_index (from 1) to rows (run_id, technique, data_point, sequence, loop), counted through the techniques of a run in order.

    rules: technique, on_start, on_loop, transitions (array of source, target, advance; of equal ones the
    last counts), and run_id if runs differ. A change of loop advances by on_loop, else a change of
    sequence by its transition, if it has one; the first row of a technique by neither. A technique without
    rules advances nothing. Rows are counted within their technique; only one sum for each technique is
    added up over a run.
    """
    keys = ["run_id", "technique"] if "run_id" in rules.columns else ["technique"]
    known = rules.select(*keys, "on_start", "on_loop", "transitions")
    name = lambda a, b: F.concat_ws(">", a.cast("string"), b.cast("string"))
    pairs = F.transform("transitions", lambda t: F.struct(name(t["source"], t["target"]).alias("k"), t["advance"].alias("v")))
    # Of equal keys the last is kept: from the end, those that are not yet there.
    last = F.aggregate(F.reverse(pairs), F.array().cast("array<struct<k: string, v: int>>"), lambda a, p: F.when(F.exists(a, lambda x: x["k"] == p["k"]), a).otherwise(F.array_append(a, F.struct(p["k"].alias("k"), p["v"].cast("int").alias("v")))))
    known = known.withColumn("_advance", F.map_from_entries(last)).drop("transitions")
    joined = rows.join(known, keys, "left")
    w = W.partitionBy("run_id", "technique").orderBy("data_point")
    before, looped = F.lag("sequence").over(w), F.lag("loop").over(w)
    joined = joined.withColumns({"_from": before, "_looped": F.coalesce(looped != F.col("loop"), F.lit(False))})
    by_rule = F.coalesce(F.try_element_at("_advance", name(F.col("_from"), F.col("sequence"))), F.lit(0))
    step = F.when(F.col("_looped"), F.coalesce("on_loop", F.lit(0))).when(F.col("_from") != F.col("sequence"), by_rule).otherwise(0)
    joined = joined.withColumn("_step", step)
    sums = joined.groupBy("run_id", "technique").agg(F.sum("_step").alias("_sum"), F.coalesce(F.max("on_start"), F.lit(0)).alias("_start"))
    order = W.partitionBy("run_id").orderBy("technique")
    upto, earlier = order.rowsBetween(W.unboundedPreceding, 0), order.rowsBetween(W.unboundedPreceding, -1)
    bases = sums.select("run_id", "technique", (1 + F.sum("_start").over(upto) + F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).alias("_base"))
    inside = F.sum("_step").over(w.rowsBetween(W.unboundedPreceding, 0))
    out = joined.join(bases, ["run_id", "technique"]).withColumn("cycle_index", (F.col("_base") + inside).cast("long"))
    return out.select(*[c for c in rows.columns if c != "cycle_index"], "cycle_index")


def rules_from_steps(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules of techniques from tables of their steps: (protocol, technique, on_start, on_loop, transitions) and its problems.

    steps: protocol, technique, step (numbered through a technique), kind (measured, advance, loop_open or
    loop_close) and, if a step became several sequences, first_sequence and last_sequence. Between two
    measured steps the cycle advances by the advance steps between them; when a loop closes, by those after its
    last measured step and before its first one. What is left after the last measured step advances when
    the technique loops, and with what comes before the next one's first when that starts. Transitions that
    advance nothing have no rule. Loops of one technique do not nest.

    Problems (protocol, technique, step, problem) are loops that do not match and loops that advance, but
    have one measured step or none; such loops make no transition.
    """
    has = set(steps.columns)
    rows = steps.withColumns({c: F.col(c) if c in has else F.col("step") for c in ("first_sequence", "last_sequence")})
    keys = ["protocol", "technique"]
    w = W.partitionBy(*keys).orderBy("step")
    upto, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    is_kind = lambda k: F.col("kind") == k
    rows = rows.withColumn("a", F.sum(is_kind(ADVANCE).cast("int")).over(upto))
    here = F.struct("step", "a", "first_sequence", "last_sequence")
    rows = rows.withColumns(
        {
            "prev": F.last(F.when(is_kind(MEASURED), here), ignorenulls=True).over(before),
            "opened": F.last(F.when(is_kind(OPEN) | is_kind(CLOSE), F.struct("step", "a", "kind")), ignorenulls=True).over(before),
        }
    )
    # The first measured step after the last loop was opened.
    rows = rows.withColumn("_era", F.sum(is_kind(OPEN).cast("int")).over(upto))
    era = W.partitionBy(*keys, "_era").orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("head", F.first(F.when(is_kind(MEASURED) & (F.col("_era") > 0), here), ignorenulls=True).over(era))
    straight = rows.where(is_kind(MEASURED) & F.col("prev").isNotNull()).select(*keys, F.col("prev.last_sequence").alias("source"), F.col("first_sequence").alias("target"), (F.col("a") - F.col("prev.a")).alias("advance"))
    closing = rows.where(is_kind(CLOSE) & (F.col("opened.kind") == OPEN))
    closing = closing.withColumn("inside", F.col("prev.step") > F.col("opened.step")).withColumn(
        "advance", F.when(F.col("inside"), F.col("a") - F.col("prev.a") + F.col("head.a") - F.col("opened.a")).otherwise(F.col("a") - F.col("opened.a"))
    )
    many = F.coalesce(F.col("inside") & (F.col("head.step") < F.col("prev.step")), F.lit(False))
    back = closing.where(many).select(*keys, F.col("prev.last_sequence").alias("source"), F.col("head.first_sequence").alias("target"), "advance")
    # Loops come after straight ways, and count where both go from one sequence to the same other.
    every = straight.withColumn("_i", F.lit(0)).unionByName(back.withColumn("_i", F.lit(1))).where("advance > 0")
    pairs = every.groupBy(*keys, "source", "target").agg(F.max_by("advance", "_i").alias("advance"))
    pairs = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("source", "target", "advance"))).alias("transitions"))
    ends = rows.groupBy(*keys).agg(
        F.max("a").alias("_all"),
        F.min(F.when(is_kind(MEASURED), F.struct("step", "a")))["a"].alias("_first"),
        F.max(F.when(is_kind(MEASURED), F.struct("step", "a")))["a"].alias("_last"),
    )
    rest = F.col("_all") - F.coalesce("_last", F.lit(0))
    carried = F.coalesce(F.lag(rest).over(W.partitionBy("protocol").orderBy("technique")), F.lit(0))
    techniques = ends.select(*keys, (carried + F.coalesce("_first", F.lit(0))).alias("on_start"), rest.alias("on_loop"))
    kind = "array<struct<source: int, target: int, advance: int>>"
    rules = techniques.join(pairs.hint("merge"), keys, "left").withColumn("transitions", F.coalesce(F.col("transitions").cast(kind), F.array().cast(kind)))
    open_now = F.coalesce(F.col("opened.kind") == OPEN, F.lit(False))
    alone = closing.where(~many & (F.col("advance") > 0)).select(*keys, "step", F.when(F.col("inside"), "the loop advances, but has one measured step").otherwise("the loop advances, but has no measured step").alias("problem"))
    wrong = rows.select(*keys, "step", F.when(is_kind(CLOSE) & ~open_now, "the loop was not opened").when(is_kind(OPEN) & open_now, "the loop before was not closed").alias("problem")).where("problem is not null")
    return rules, alone.unionByName(wrong)
