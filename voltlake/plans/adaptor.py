"""The test tables as raw cycler samples, so that every operator can run on them and be checked.

Amounts are scaled by powers of two: sums of them are then exact in doubles, in any order, and both
engines give the same bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STEPS = ("click", "error", "purchase", "signup", "view")


def raw_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as samples: a run for each user, six cycles of five days, a step for each event type."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("date_time"), "user_id", "event_type", "value")
    run, cycle = W.partitionBy("run_id").orderBy("date_time", "event_id"), W.partitionBy("run_id", "cycle_index").orderBy("data_point").rowsBetween(W.unboundedPreceding, 0)
    cents = F.round(F.col("value") * 100).cast("long")
    charging = F.col("event_type").isin("click", "signup", "view")
    rows = e.withColumns({"run_id": F.col("user_id"), "cents": cents, "sign": F.when(charging, 1).otherwise(-1)})
    rows = rows.withColumns(
        {
            "data_point": F.row_number().over(run),
            "cycle_index": F.floor((F.dayofmonth("date_time") - 1) / 5).cast("int"),
            "step_index": F.array_position(F.array(*map(F.lit, STEPS)), F.col("event_type")).cast("int") - 1,
            "test_time": F.floor((F.unix_micros("date_time") - F.min(F.unix_micros("date_time")).over(W.partitionBy("run_id"))) * 1024 / 1000000) / 1024.0,
            "voltage": 2.0 + F.col("cents") / F.lit(32768.0),
            "current": F.col("sign") * F.col("cents") / F.lit(4096.0),
            "temperature": F.when(F.col("event_id") % 97 != 0, (20 + F.col("event_id") % 15).cast("double")),
            "internal_resistance": F.when(F.col("event_id") % 89 != 0, F.col("cents") / F.lit(1048576.0)),
        }
    )
    amount = {"capacity": F.col("cents") / F.lit(65536.0), "energy": F.col("cents") * (65536 + F.col("cents")) / F.lit(4294967296.0)}
    totals = {f"{side}_{what}": F.sum(F.when(F.col("sign") == sign, x).otherwise(0.0)).over(cycle) for what, x in amount.items() for side, sign in (("charge", 1), ("discharge", -1))}
    return rows.withColumns(totals).select(
        "run_id", "data_point", "cycle_index", "step_index", "test_time", "date_time", "current", "voltage", *totals, "internal_resistance", "temperature", "event_id"
    )


#: The same view for DuckDB, as the first tables of a query.
RAW_SQL = """
raw0 as (
  select event_id, ts as date_time, user_id as run_id, event_type, cast(round(value * 100) as bigint) as cents,
         case when event_type in ('click', 'signup', 'view') then 1 else -1 end as sign,
         row_number() over (partition by user_id order by ts, event_id) as data_point,
         cast(floor((day(ts) - 1) / 5) as integer) as cycle_index,
         cast(list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) as integer) - 1 as step_index,
         floor(cast((epoch_us(ts) - min(epoch_us(ts)) over (partition by user_id)) * 1024 as double) / 1000000) / 1024.0::double as test_time
  from events),
raw as (
  select run_id, data_point, cycle_index, step_index, test_time, date_time,
         sign * cents / 4096.0::double as current, 2.0::double + cents / 32768.0::double as voltage,
         sum(case when sign = 1 then cents / 65536.0::double else 0.0::double end) over w as charge_capacity,
         sum(case when sign = -1 then cents / 65536.0::double else 0.0::double end) over w as discharge_capacity,
         sum(case when sign = 1 then cents * (65536 + cents) / 4294967296.0::double else 0.0::double end) over w as charge_energy,
         sum(case when sign = -1 then cents * (65536 + cents) / 4294967296.0::double else 0.0::double end) over w as discharge_energy,
         case when event_id % 89 <> 0 then cents / 1048576.0::double end as internal_resistance,
         case when event_id % 97 <> 0 then cast(20 + event_id % 15 as double) end as temperature, event_id
  from raw0
  window w as (partition by run_id, cycle_index order by data_point rows unbounded preceding))
"""


def life_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as cycle summaries of long lives: a run for every five users (who have some 150 cycles, as early-life features need), a cycle for every four hours in which they have events."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
    cycle = F.floor((F.unix_micros("ts") - F.lit(1704067200000000)) / 14400000000).cast("int")
    rows = e.groupBy(F.floor(F.col("user_id") / 5).cast("long").alias("run_id"), cycle.alias("cycle_index")).agg(F.min("ts").alias("date_time"), (F.sum(F.round(F.col("value") * 100).cast("long")) % 64).alias("s"))
    s, c, q = F.col("s"), F.col("cycle_index"), F.col("discharge_capacity")
    rows = rows.withColumn("discharge_capacity", 1.125 - c / F.lit(512.0) - s / F.lit(4096.0))
    rows = rows.withColumns(
        {
            "charge_capacity": q + F.lit(1 / 64),
            "discharge_energy": 3 * q - s / F.lit(2048.0),
            "charge_energy": 3 * q + F.lit(0.125),
            "dc_internal_resistance": F.when(s % 11 != 0, (16 + s % 7) / F.lit(1024.0)).otherwise(0.0),
            "temperature_maximum": (30 + s % 9).cast("double"),
            "temperature_minimum": (20 + s % 5).cast("double"),
            "time_temperature_integrated": F.when(s % 13 != 0, s * 2.0),
            "charge_duration": 600.0 + s,
        }
    )
    upto = W.partitionBy("run_id").orderBy("cycle_index").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("charge_throughput", F.sum("charge_capacity").over(upto)).drop("s")


def life_diagnostics(summary: DataFrame) -> DataFrame:
    """For the test tables: of every 30 cycles the first three are diagnostics."""
    k = F.col("cycle_index") % 30
    kinds = F.when(k == 0, "reset").when(k == 1, "rpt_0.2C").when(k == 2, "rpt_1C")
    return summary.withColumn("cycle_type", kinds).where("cycle_type is not null")


def life_curves(summary: DataFrame) -> DataFrame:
    """Curves of 21 voltages for every cycle of the summaries."""
    i = F.col("i")
    rows = summary.select("run_id", "cycle_index", "discharge_capacity", "charge_capacity", "discharge_energy", "charge_energy", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("i"))
    shape = i * i * (1 + F.col("cycle_index") % 4) / F.lit(1024.0)
    return rows.select("run_id", "cycle_index", (2.5 + i / F.lit(16.0)).alias("voltage"), *[(F.col(c) * shape).alias(c) for c in ("discharge_capacity", "charge_capacity", "discharge_energy", "charge_energy")])


LIFE_SQL = """
life0 as (
  select user_id // 5 as run_id, cast(floor((epoch_us(ts) - 1704067200000000) / 14400000000) as integer) as cycle_index, min(ts) as date_time,
         cast(sum(cast(round(value * 100) as bigint)) % 64 as bigint) as s from events group by 1, 2),
life1 as (select *, 1.125::double - cycle_index / 512.0::double - s / 4096.0::double as discharge_capacity from life0),
life as (
  select run_id, cycle_index, date_time, discharge_capacity, discharge_capacity + 0.015625::double as charge_capacity,
         3 * discharge_capacity - s / 2048.0::double as discharge_energy, 3 * discharge_capacity + 0.125::double as charge_energy,
         case when s % 11 <> 0 then (16 + s % 7) / 1024.0::double else 0.0::double end as dc_internal_resistance,
         cast(30 + s % 9 as double) as temperature_maximum, cast(20 + s % 5 as double) as temperature_minimum,
         case when s % 13 <> 0 then s * 2.0::double end as time_temperature_integrated, 600.0::double + s as charge_duration,
         sum(discharge_capacity + 0.015625::double) over (partition by run_id order by cycle_index rows unbounded preceding) as charge_throughput,
         row_number() over (partition by run_id order by cycle_index) - 1 as position
  from life1),
ldiag as (select *, case cycle_index % 30 when 0 then 'reset' when 1 then 'rpt_0.2C' else 'rpt_1C' end as cycle_type from life where cycle_index % 30 < 3),
lcurves as (
  select run_id, cycle_index, 2.5::double + i / 16.0::double as voltage, discharge_capacity * k as discharge_capacity, charge_capacity * k as charge_capacity,
         discharge_energy * k as discharge_energy, charge_energy * k as charge_energy
  from (select life.*, i, i * i * (1 + cycle_index % 4) / 1024.0::double as k from life, generate_series(0, 20) t(i)))
"""


#: How many rows a task makes, about. Fixed value.
ROWS_A_TASK = 250_000


def dealt(rows: DataFrame, key: str, n: int, each: int) -> DataFrame:
    """n rows, of which ``each`` are made of one, dealt out by key: tasks grow in number and not in size, and what is
    computed by key stays where it is. Without a number Spark would take one task for them, as keys alone are small."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n * each // ROWS_A_TASK)), key)


def user_runs(spark: SparkSession, sf_dir: str, each: int) -> DataFrame:
    """The users as run_id, dealt out for ``each`` rows of one."""
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("run_id"))
    return dealt(users.distinct(), "run_id", users.agg(F.approx_count_distinct("run_id")).first()[0], each)


def hppc_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pulse tests for every user: two diagnostics of nine windows of rest, discharge, rest and charge."""
    runs = user_runs(spark, sf_dir, 2 * 9 * 4 * 12)
    axis = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    rows = runs.select("run_id", axis(2, "p")).select("*", axis(9, "w")).select("*", axis(4, "s")).select("*", axis(12, "k"))
    p, w, s, k, r = (F.col(c) for c in ("p", "w", "s", "k", "run_id"))
    r = r % 20
    dip = F.when(s == 1, -(r + 1 + k) * (2 + p) / F.lit(512.0)).when(s == 3, (r + 1 + k) * (4 + p) / F.lit(2048.0)).when(s == 2, k / F.lit(1024.0)).otherwise(-k / F.lit(4096.0))
    return rows.select(
        "run_id",
        (p * 30).alias("cycle_index"),
        (s + 1).alias("step_index"),
        (w * 4 + s + 1).alias("step_index_counter"),
        (p * 1000000 + (w * 4 + s) * 2048 + F.when(s == 0, k * 128).otherwise(k * 2)).cast("double").alias("test_time"),
        (3.5 - w / F.lit(16.0) - p / F.lit(64.0) + dip).alias("voltage"),
        F.when(s == 1, -2.0).when(s == 3, 1.5).otherwise(0.0).alias("current"),
    )


HPPC_SQL = """
hp as (
  select run_id, p, w, s, k, 3.5::double - w / 16.0::double - p / 64.0::double + case s when 1 then -(run_id % 20 + 1 + k) * (2 + p) / 512.0::double
         when 3 then (run_id % 20 + 1 + k) * (4 + p) / 2048.0::double when 2 then k / 1024.0::double else -k / 4096.0::double end as v
  from (select distinct user_id as run_id from events), generate_series(0, 1) a(p), generate_series(0, 8) b(w), generate_series(0, 3) c(s), generate_series(0, 11) d(k))
"""


def soc_discharges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discharges between states of charge, with their roles: two tests of three windows of 33 points for every user; voltages are cubic in capacity."""
    runs = user_runs(spark, sf_dir, 2 * 3 * 33)
    rows = runs.select("run_id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("position")).select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("window")).select("*", F.explode(F.sequence(F.lit(0), F.lit(32))).alias("k"))
    r, p, k = F.col("run_id") % 23, F.col("position"), F.col("k")
    q = F.col("window") + (k * F.lit(1.0) - 4 * p) / F.lit(32.0)
    x = F.col("discharge_capacity")
    dip = p * (k * k / F.lit(9973.0) + r / F.lit(997.0) * F.when(k % 3 == 0, 1).otherwise(-1))
    return rows.withColumn("discharge_capacity", q).select("run_id", "position", "window", F.lit("hppc_discharge_to_next_soc").alias("role"), k.cast("double").alias("test_time"), "discharge_capacity", (F.lit(4.1) - x / 7 + r * x * x / 911 - x * x * x / 301 - dip).alias("voltage"))


SOC_SQL = """
sp as (select run_id, w, k, w + (k - 4) / 32.0::double as q, k * k / 9973.0::double + (run_id % 23) / 997.0::double * case when k % 3 = 0 then 1 else -1 end as d
       from (select distinct user_id as run_id from events), generate_series(0, 2) a(w), generate_series(0, 32) b(k))
"""


def electrode_curves(spark: SparkSession, sf_dir: str, each: int = 101) -> DataFrame:
    """Aligned potentials of both electrodes of a cell for every user, on 101 states of charge; each electrode ends somewhere. each: how many rows come of a cell."""
    runs = user_runs(spark, sf_dir, each)
    rows = runs.select("run_id", F.explode(F.sequence(F.lit(0), F.lit(100))).alias("s"))
    s, r = F.col("s"), F.col("run_id") % 11
    return rows.select("run_id", (s - 5.0).alias("soc"), F.when(s <= 95 - r, 3.5 + s * s / 11003.0).alias("pe"), F.when(s >= 3 + r, 0.9 - s / 119.0).alias("ne"))


ELECTRODE_SQL = """
ec as (select run_id, s - 5.0::double as soc, case when s <= 95 - run_id % 11 then 3.5::double + s * s / 11003.0::double end as pe, case when s >= 3 + run_id % 11 then 0.9::double - s / 119.0::double end as ne
       from (select distinct user_id as run_id from events), generate_series(0, 100) t(s))
"""
