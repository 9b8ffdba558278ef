"""The named queries of the cycler operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import cycle_rules, cycles, diagnostics, features, grams, halfcell, hppc, interpolate, life, matching, matrix, models, protocols, smooth, splines, steps, validate, waveform
from ..sources import vendors
from ..streaming import pauses
from .adaptor import dealt, electrode_curves, hppc_curves, life_curves, life_diagnostics, life_summary, raw_samples, soc_discharges, user_runs

QUERIES = {}
#: A cell is searched for some milliseconds; it counts as this many rows when cells are dealt out. Fixed value.
CELL_WORK = 2500


def query(f):
    QUERIES[f.__name__] = f
    return f


def diagnostic_cycles(raw: DataFrame) -> DataFrame:
    """For the test tables: cycle 0 of every run is a reset and cycle 3 an hppc."""
    kinds = F.when(F.col("cycle_index") == 0, "reset").when(F.col("cycle_index") == 3, "hppc")
    return raw.select("run_id", "cycle_index", kinds.alias("cycle_type")).where("cycle_type is not null").distinct()


def _text_time(df: DataFrame) -> DataFrame:
    return df.withColumn("date_time", F.date_format("date_time", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query
def raw_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_time(raw_samples(spark, sf_dir))


@query
def cycle_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_samples(spark, sf_dir)
    return _text_time(cycles.summarize_cycles(raw, diagnostic_cycles(raw), complete_vmin=2.1, complete_vmax=2.5, complete_ratio=0.1))


@query
def diagnostic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_samples(spark, sf_dir)
    return _text_time(cycles.summarize_diagnostic(raw, diagnostic_cycles(raw)))


@query
def step_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = steps.with_step_order(steps.with_step_counter(raw_samples(spark, sf_dir)))
    return raw.select("run_id", "data_point", "cycle_index", "step_index", "step_index_counter", "step_type")


@query
def step_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps.classify_steps(raw_samples(spark, sf_dir))


@query
def reset_accumulator(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_samples(spark, sf_dir).withColumns(
        {"_capacity": F.abs("current"), "_state": F.when(F.col("current") > 0, "C").otherwise("D"), "_ending_status": F.when(F.col("event_id") % 3 == 0, 129).otherwise(1)}
    )
    return steps.accumulate(raw, "_capacity", "C").select("run_id", "data_point", "cycle_index", "total")


@query
def rule_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_samples(spark, sf_dir).select("run_id", "data_point", F.col("step_index").alias("sequence"), F.col("cycle_index").alias("loop"))
    rules = spark.createDataFrame([(s, t, (s + 2 * t) % 3) for s in range(5) for t in range(5) if s != t], "source int, target int, advance int")
    return steps.cycles_from_rules(raw, rules, on_start=1, on_loop=2, loop="loop").select("run_id", "data_point", "sequence", "cycle_index")


@query
def discharge_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolate.interpolate_steps(raw_samples(spark, sf_dir), False, "voltage", (2.0, 3.5), 13)


@query
def cycle_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolate.interpolate_cycles(raw_samples(spark, sf_dir), (2.0, 3.5), 9)


@query
def diagnostic_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_samples(spark, sf_dir)
    return interpolate.interpolate_diagnostic(raw, diagnostic_cycles(raw), 7, 7, v_delta_min=0.002)


@query
def diagnostic_from_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.from_step_numbers(raw_samples(spark, sf_dir), {"hppc": ("contains", [(0, 1, 2, 3, 4)]), "rpt": ("exact", [(0, 3), (1, 2, 4)])})


@query
def validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {
        "charge_capacity": {"max": 1.5, "min": 0.0, "type": "float"},
        "cycle_index": {"min": 0, "max_at_least": 1, "type": "integer"},
        "temperature": {"max": 34.0, "min": 20.0, "type": "float"},
        "test_time": {"type": "float", "monotonic": "increasing"},
        "voltage": {"max": 3.25, "min": 2.0, "min_is_below": 2.002, "type": "float"},
    }
    return validate.validate(raw_samples(spark, sf_dir), rules)


@query
def cell_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    return life.cycle_life(life_summary(spark, sf_dir), [0.98, 0.9, 0.8, 0.7], n_cutoff=40)


@query
def capacity_at_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return life.capacities_at(life_summary(spark, sf_dir), [20, 60, 100, 140, 180])


@query
def cycles_to_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.trajectory(life_summary(spark, sf_dir))


@query
def fraction_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.fraction_left(life_diagnostics(life_summary(spark, sf_dir)), "discharge_energy", "rpt_0.2C", 60)


@query
def fraction_remaining_nx(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = life_summary(spark, sf_dir)
    return diagnostics.fraction_left_nx(summary, life_diagnostics(summary))


@query
def threshold_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = life_summary(spark, sf_dir)
    left = diagnostics.fraction_left_nx(summary, life_diagnostics(summary), cycle_types=["rpt_0.2C"])
    return diagnostics.threshold_crossing(left, "normalized_regular_throughput", threshold=0.85, n=101).select("run_id", F.round("crossing", 6).alias("crossing"))


@query
def delta_q_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = life_summary(spark, sf_dir)
    return features.delta_q(summary, life_curves(summary), digits=6)


@query
def cycle_statistic_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    curves = life_curves(life_summary(spark, sf_dir))
    return features.cycle_statistics(curves, curves, 10, 100, digits=6)


@query
def diagnostic_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.summary_differences(life_diagnostics(life_summary(spark, sf_dir)), types=("reset", "rpt_0.2C", "rpt_1C"))


@query
def exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = life_summary(spark, sf_dir)
    left = diagnostics.fraction_left_nx(summary, life_diagnostics(summary), cycle_types=["rpt_0.2C"])
    return features.exclusion_criteria(summary, left, 1.0, n=80, throughput_cutoff=75.0, end_of_life=0.8, full_cycles_cutoff=110.0)


def _two_featurizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = life_summary(spark, sf_dir)
    ends = life.capacities_at(summary, [20, 160])
    return matrix.feature_matrix([(ends, "Capacities", {"at": [20, 160]}), (life.cycles_to(summary, [0.9, 0.8]), "Trajectory", {"t": [0.9, 0.8]})])


@query
def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.without_hash(_two_featurizers(spark, sf_dir))


@query
def clean_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = life_summary(spark, sf_dir).select((F.col("run_id") * 1000 + F.col("cycle_index")).alias("run_id"), F.try_divide(F.lit(1.0), F.col("dc_internal_resistance")).alias("g"), "time_temperature_integrated", "charge_duration")
    return matrix.clean(rows, 0.5, 0.6, "median")


@query
def grouped_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.folds(life_summary(spark, sf_dir).select("run_id", "cycle_index"), 5, seed=3, group="run_id")


@query
def pulse_resistances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hppc.resistances(hppc.windows_by_rules(hppc_curves(spark, sf_dir), 2.0))


@query
def rpt_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_samples(spark, sf_dir)
    return hppc.rpt_roles(raw.join(diagnostic_cycles(raw), ["run_id", "cycle_index"]), 2.0)


@query
def pulse_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hppc.windows_by_rules(hppc_curves(spark, sf_dir), 2.0)
    found = hppc.pulse_changes(rows, 1, digits=6)
    return found.select("run_id", *[f"{c}_{w}0" for c in hppc.RESISTANCES for w in range(3)], *[c for c in found.columns if c.endswith("_ocv")])


@query
def diffusion_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hppc.diffusion(hppc.windows_by_rules(hppc_curves(spark, sf_dir), 2.0))
    return found.select("run_id", "position", "window", F.round("slope", 6).alias("slope"))


@query
def drive_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    trace = raw_samples(spark, sf_dir).select(F.col("run_id").alias("wave_id"), F.col("test_time").alias("time"), (F.abs("current") * 8).alias("velocity"))
    return waveform.power_from_velocity(trace).select("wave_id", "time", F.round("power", 4).alias("power"))


@query
def tester_waveform(spark: SparkSession, sf_dir: str) -> DataFrame:
    trace = raw_samples(spark, sf_dir).select(F.col("run_id").alias("wave_id"), F.col("data_point").alias("time"), (F.floor(F.col("current")) * (F.col("step_index") != 1).cast("int")).cast("double").alias("power"))
    return waveform.waveform_steps(trace).select("wave_id", "step", "state", "control_mode", "value", "limit_value", "duration", "operation")


@query
def spliced_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_samples(spark, sf_dir).select("run_id", "data_point", "cycle_index", "test_time")
    second = raw.where("cycle_index >= 3").withColumns({"data_point": F.row_number().over(Window.partitionBy("run_id").orderBy("data_point")), "cycle_index": F.col("cycle_index") - 3})
    return waveform.splice(raw.where("cycle_index < 3"), second)


@query
def test_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pauses.sessions(raw_samples(spark, sf_dir), "6 hours")
    return found.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("started", "ended")})


@query
def live_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pauses.live_summary(raw_samples(spark, sf_dir)).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


@query
def component_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    fitted = models.Components(rows.where("vec_id % 5 <> 0"))
    return fitted.outliers(rows).select("vec_id", F.round("error", 6).alias("error"), "outside", "unlike")


@query
def linear_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = life_summary(spark, sf_dir).select((F.col("run_id") * 1000 + F.col("cycle_index")).alias("run_id"), "charge_duration", "temperature_maximum", F.col("cycle_index").alias("age"), F.col("discharge_capacity").alias("q"))
    model, names, _ = models.train_linear(rows, ["charge_duration", "temperature_maximum", "age"], "q", alphas=[0.0001, 0.01], ratios=[0.5], n_folds=3)
    return models.predict_linear(model, names, rows).withColumn("prediction", F.round("prediction", 6))


@query
def electrode_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cell for every user, made from known electrodes and fitted back: its true and its fitted parameters."""
    pe = [(i / 50, 3.4 + 0.9 * (1 - i / 50) ** 0.5) for i in range(51)][::-1]
    pe = [(1 - q, v) for q, v in pe]
    ne = [(i / 50, 0.6 * (1 - i / 50) ** 2 + 0.05) for i in range(51)]
    runs = user_runs(spark, sf_dir, CELL_WORK)
    k, m = F.col("run_id") % 8, F.col("run_id") % 5
    truth = runs.select("run_id", F.lit(0).alias("cycle_index"), (k / 40.0).alias("lli"), (1.3 + m / 20.0).alias("q_pe"), (1.2 + k / 100.0).alias("q_ne"), F.explode(F.sequence(F.lit(1), F.lit(40))).alias("i"))
    cells = truth.withColumn("q", F.col("i") / 40.0)
    cells = cells.withColumn("voltage", halfcell.emulate(pe, ne, F.col("q"), F.col("lli"), F.col("q_pe"), F.col("q_ne")))
    fitted = halfcell.fit_electrodes(cells, pe, ne, {"lli": (0.0, 0.3), "q_pe": (1.2, 1.6), "q_ne": (1.1, 1.5)})
    known = truth.select("run_id", *[F.col(p).alias(f"true_{p}") for p in halfcell.PARAMETERS]).distinct()
    return fitted.select("run_id", "cycle_index", *[F.round(p, 3).alias(p) for p in halfcell.PARAMETERS], F.round("error", 4).alias("error")).join(known.hint("merge"), "run_id")


@query
def protocol_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    size = F.col("p_size")
    parameters = part.select(
        F.col("p_partkey").alias("seq_num"),
        (size / 16.0).alias("charge_constant_current_1"),
        (20 + size).alias("charge_percent_limit_1"),
        (size / 32.0).alias("charge_constant_current_2"),
        (3.5 + size / 64.0).alias("charge_cutoff_voltage"),
        (size % 30).alias("charge_constant_voltage_time"),
        (size % 7).alias("charge_rest_time"),
        (size / 8.0).alias("discharge_constant_current_1"),
        (2.5 + size / 128.0).alias("discharge_cutoff_voltage"),
        (size % 11).alias("discharge_rest_time"),
        F.lit(4.5).alias("capacity_nominal"),
    )
    return protocols.regular_cycle(parameters).drop("end_value").join(protocols.first_rest(parameters), "seq_num")


@query
def smoothed_voltage(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_samples(spark, sf_dir).select("run_id", "data_point", "voltage")
    return smooth.ewma(raw, ["run_id"], "data_point", "voltage", "smooth", alpha=0.6).select("run_id", "data_point", F.round("smooth", 9).alias("smooth"))


@query
def smooth_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    knots = life_summary(spark, sf_dir).select("run_id", F.col("cycle_index").cast("double").alias("cycle"), "discharge_capacity")
    bounds = knots.groupBy("run_id").agg(F.min("cycle").alias("lo"), F.max("cycle").alias("hi"))
    return smooth.monotone_cubic(knots, bounds, ["run_id"], "cycle", "discharge_capacity", 65).select("run_id", F.round("cycle", 6).alias("cycle"), F.round("discharge_capacity", 8).alias("discharge_capacity"))


@query
def excluded_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries without the diagnostic cycles and without those that are marked as not wanted."""
    raw = raw_samples(spark, sf_dir)
    unwanted = raw.where("cycle_index = 2").select("run_id", "cycle_index")
    return _text_time(cycles.summarize_cycles(raw, diagnostic_cycles(raw), unwanted, complete_vmin=2.1, complete_vmax=2.5, complete_ratio=0.1))


@query
def stray_finals(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = steps.with_step_counter(raw_samples(spark, sf_dir)).withColumn("test_time", F.when(F.col("event_id") % 3 > 0, F.col("test_time")))
    return diagnostics.without_stray_finals(raw, 1e6, 4).select("run_id", "data_point", "cycle_index", "step_index", "step_index_counter", "test_time")


@query
def waveform_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps.waveform_steps(raw_samples(spark, sf_dir).withColumn("_wf_chg_cap", F.when(F.col("event_id") % 50 == 0, F.col("charge_capacity"))))


@query
def protocol_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("run_id")).distinct().select("run_id", F.lit("P").alias("project_name"), F.col("run_id").alias("seq_num"))
    part = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_size % 4 <> 0")
    parameters = part.select(F.lit("P").alias("project_name"), F.col("p_partkey").alias("seq_num"), (F.col("p_size") / 16.0).alias("charge_constant_current_1"), (3.5 + F.col("p_size") / 64.0).alias("charge_cutoff_voltage"))
    return features.charging_protocol(runs, parameters, ("charge_constant_current_1", "charge_cutoff_voltage"))


@query
def structuring_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capacity and voltage range of runs of five projects, by the parameters of their projects."""
    name = lambda k: F.concat(F.lit("P"), (F.col(k) % 5).cast("string"))
    runs = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(name("user_id"), F.lit("_"), F.col("user_id").cast("string"), F.lit("_x.csv")).alias("run_id")).distinct()
    part = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_size % 4 <> 0")
    size = F.col("p_size")
    parameters = part.select(name("p_partkey").alias("project_name"), F.col("p_partkey").cast("int").alias("seq_num"), (size / 16.0).alias("capacity_nominal"), (2.5 + size / 128.0).alias("discharge_cutoff_voltage"), (3.5 + size / 64.0).alias("charge_cutoff_voltage"))
    return vendors.structuring_parameters(runs, parameters).select("run_id", "nominal_capacity", "v_min", "v_max")


@query
def diagnostic_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnostics of two cycles, found by the steps of the first two; steps are thinned out so that cycles differ."""
    raw = raw_samples(spark, sf_dir).where((F.col("step_index") + F.col("run_id")) % 4 != F.col("cycle_index") % 3)
    return diagnostics.from_patterns(raw, raw.select("run_id", F.lit(1).alias("diagnostic_start_cycle")).distinct(), ("reset", "hppc"))


@query
def diagnostic_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw diagnostic curves as channels, a row for each value."""
    raw = steps.with_step_order(steps.with_step_counter(raw_samples(spark, sf_dir)))
    rows = raw.join(diagnostic_cycles(raw), ["run_id", "cycle_index"])
    found = features.raw_curves(rows, ["reset", "hppc"], (0,), ("capacity", "test_time"))
    return found.select("run_id", "channel", F.posexplode("values").alias("place", "value"))


@query
def hppc_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hppc.hppc_features(hppc_curves(spark, sf_dir), 2.0, 1, digits=6)
    return found.select(*[F.round(c, 6).alias(c) if c.startswith("D_") else F.col(c) for c in found.columns])


@query
def voltage_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splines.v_diff(soc_discharges(spark, sf_dir), 1, digits=6)


@query
def curve_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discharge curves of three cycles as vectors of 21 values, a column each."""
    found = models.curve_vectors(life_curves(life_summary(spark, sf_dir)), cycles=(10, 55, 100))
    return found.select("run_id", "cycle_index", *[F.col("embedding")[i].alias(f"v{i}") for i in range(21)])


@query
def electrode_voltages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = halfcell.halfcell_voltages(electrode_curves(spark, sf_dir), ["run_id"])
    return found.select(*[F.round(c, 9).alias(c) if c != "run_id" else F.col(c) for c in found.columns])


@query
def diagnostic_protocols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reset, pulse and rate test steps of every part, as if its size set the parameters."""
    size = F.col("p_size")
    rates = {"reset_cycle_current": 16, "reset_cycle_cutoff_current": 64, "HPPC_baseline_constant_current": 32, "diagnostic_cutoff_current": 128, "HPPC_pulse_current_1": 8, "HPPC_pulse_current_2": 4, "RPT_charge_constant_current": 16, "RPT_discharge_constant_current_1": 64, "RPT_discharge_constant_current_2": 32, "RPT_discharge_constant_current_3": 8}
    times = {"HPPC_rest_time": 1, "HPPC_pulse_duration_1": 2, "HPPC_pulse_rest_time": 3, "HPPC_pulse_duration_2": 4}
    volts = {"diagnostic_charge_cutoff_voltage": 4.25, "diagnostic_discharge_cutoff_voltage": 2.75, "HPPC_pulse_cutoff_voltage": 4.5}
    parameters = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.col("p_partkey").alias("seq_num"), F.lit(4.5).alias("capacity_nominal"), F.lit(10).alias("HPPC_interval"), *[(size / float(k)).alias(n) for n, k in rates.items()], *[(size * k).alias(n) for n, k in times.items()], *[F.lit(v).alias(n) for n, v in volts.items()]
    )
    return protocols.diagnostic_blocks(parameters).select("seq_num", "block", "step", "kind", "mode", "value", "limit", F.split("ends", "[=;]")[0].alias("end_type"), F.split("ends", "[=;]")[1].alias("end_value"))


@query
def early_constant_voltage(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_samples(spark, sf_dir)
    parameters = raw.select("run_id").distinct().select("run_id", (F.col("run_id") % 3).cast("double").alias("charge_constant_current_1"), F.lit(1.0).alias("charge_constant_current_2"))
    return features.not_early_cv(raw, F.col("current") > 0, parameters)


@query
def imposed_degradation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Electrode curves of a cell for every user after losses that its number tells, on 1001 points."""
    curves, r = electrode_curves(spark, sf_dir, 1001 + 2 * 101), F.col("run_id")
    losses = curves.select("run_id").distinct().select("run_id", (r % 5 / F.lit(2.0)).alias("lli"), (r % 7).cast("double").alias("lam_pe"), (r % 9 * 1.5).alias("lam_ne"))
    found = matching.impose_degradation(curves, losses, ["run_id"])
    return found.select("run_id", *[F.round(c, 6).alias(c) for c in ("soc", "pe", "ne")])


@query
def gram_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of products of four columns of all cycles, a matrix for each of five groups of runs; column -1 is 1."""
    rows = life_summary(spark, sf_dir).select((F.col("run_id") % 5).cast("int").alias("fold"), "discharge_capacity", "charge_duration", "temperature_maximum", "time_temperature_integrated")
    return grams.gram_cells(rows, rows.columns[1:], "fold")


@query
def cycles_across_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycle numbers of every run, as if it were written as three files with rules of their own."""
    raw = raw_samples(spark, sf_dir)
    rows = raw.select("run_id", F.least(F.floor(F.col("data_point") / 20), F.lit(2)).cast("int").alias("technique"), "data_point", F.col("step_index").alias("sequence"), F.col("cycle_index").alias("loop"))
    pairs = lambda t: F.array(*[F.struct(F.lit(a).alias("source"), F.lit(b).alias("target"), F.lit((a + 2 * b + t) % 3).alias("advance")) for a in range(5) for b in range(5) if a != b])
    rules = None
    for t in range(3):
        one = spark.range(1).select(F.lit(t).alias("technique"), F.lit(t % 2).alias("on_start"), F.lit(2 - t).alias("on_loop"), pairs(t).alias("transitions"))
        rules = one if rules is None else rules.unionByName(one)
    return cycle_rules.cycles_across_files(rows, rules).select("run_id", "technique", "data_point", "cycle_index")


@query
def rules_of_step_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of two techniques of ten steps for every part: a loop from the third to the eighth, advances where its size tells."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("protocol"), "p_size")
    part = dealt(part, "protocol", part.count(), 2 * 10)
    rows = part.select("protocol", "p_size", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("technique")).select("*", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("step"))
    kind = F.when(F.col("step") == 3, "loop_open").when(F.col("step") == 8, "loop_close").when(F.col("p_size") * F.col("step") % (2 + F.col("technique")) == 0, "advance").otherwise("measured")
    rules, _ = cycle_rules.rules_from_steps(rows.select("protocol", "technique", "step", kind.alias("kind")))
    listed = F.transform("transitions", lambda t: F.concat(t["source"], F.lit(">"), t["target"], F.lit(":"), t["advance"]))
    return rules.select("protocol", "technique", F.col("on_start").cast("long").alias("on_start"), F.col("on_loop").cast("long").alias("on_loop"), F.array_join(listed, " ").alias("transitions"))
