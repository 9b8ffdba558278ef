"""Behaviour that the queries over the test tables do not reach."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from voltlake.functions.stats import SUMMARY, summary_columns
from voltlake.operators import cycles, diagnostics, features, hppc, interpolate, life, matrix, models, steps, validate, waveform
from voltlake.streaming import pauses

RAW = "run_id string, cycle_index int, step_index int, data_point int, test_time double, date_time timestamp, current double, voltage double, charge_capacity double, discharge_capacity double, charge_energy double, discharge_energy double, internal_resistance double, temperature double"


def raw(spark, rows):
    return spark.createDataFrame(rows, "run_id string, cycle_index int, step_index int, data_point int, test_time double, current double, voltage double, charge_capacity double, discharge_capacity double").withColumns(
        {"date_time": F.timestamp_seconds("test_time"), "charge_energy": F.col("charge_capacity") * 3, "discharge_energy": F.col("discharge_capacity") * 3, "internal_resistance": F.lit(0.1), "temperature": F.lit(25.0)}
    )


def test_interpolation_rules(spark):
    nan = None
    rows = [(0, 1.0, nan, 5.0), (1, 2.0, 10.0, 6.0), (2, 2.0, 11.0, nan), (3, 4.0, nan, 7.0), (4, 5.0, 20.0, nan)]
    samples = spark.createDataFrame([("r", *r) for r in rows], "run_id string, data_point int, x double, y double, z double")
    bounds = spark.createDataFrame([("r", 0.0, 6.0)], "run_id string, lo double, hi double")
    got = {r.x: (r.y, r.z) for r in interpolate.interpolate(samples, bounds, ["run_id"], "x", ["y", "z"], 7).collect()}
    third = 11 + (20 - 11) * (1 / 3)
    assert got[0.0] == (None, None) and got[1.0] == (None, 5.0) and got[2.0] == (10.0, 6.0)
    assert math.isclose(got[3.0][0], third) and got[3.0][1] == 6.5 and got[5.0] == (20.0, 7.0) and got[6.0] == (20.0, 7.0)


def test_interpolation_axis_error(spark):
    with pytest.raises(ValueError, match="current"):
        interpolate.interpolate_steps(raw(spark, []), True, "current")


def test_constant_voltage_segment(spark):
    rows = [("r", 0, 1, i, 10.0 * i, c, v, i / 10, 0.0) for i, (c, v) in enumerate([(1.0, 3.0), (1.0, 3.5), (1.0, 4.2), (0.9, 4.2), (0.5, 4.2), (0.1, 4.2)])]
    got = cycles.constant_voltage(raw(spark, rows), F.col("current") > 0).first()
    # The first flat step begins at sample 2, so the segment begins at sample 1.
    assert (got.CV_time, got.CV_current) == (40.0, 0.1) and math.isclose(got.CV_capacity, 0.4)
    one = cycles.constant_voltage(raw(spark, rows[:1]), F.col("current") > 0).first()
    assert (one.CV_time, one.CV_capacity) == (0.0, 0.0)


def test_pause_threshold_and_null_integral(spark):
    rows = raw(spark, [("r", 0, 1, i, t, 1.0, 3.0, 0.1, 0.0) for i, t in enumerate((0.0, 3600.0, 7201.0))])
    got = cycles.cycle_aggregates(rows, 0.88).first()
    assert got.paused == 3601.0 and math.isclose(got.time_temperature_integrated, 25 * 7201 / 60)
    assert cycles.cycle_aggregates(rows.withColumn("temperature", F.when(F.col("data_point") > 0, 25.0)), 0.88).first().time_temperature_integrated is None


def test_incomplete_last_cycle(spark):
    def cycle(i, q):
        return [("r", i, 1, 2 * i, 20.0 * i, 1.0, 3.0, 1.0, 0.0), ("r", i, 2, 2 * i + 1, 20.0 * i + 10, -1.0, 3.6, 1.0, q)]

    assert cycles.summarize_cycles(raw(spark, cycle(0, 1.0) + cycle(1, 0.5))).count() == 1
    assert cycles.summarize_cycles(raw(spark, cycle(0, 1.0) + cycle(1, 0.99))).count() == 2
    assert cycles.summarize_cycles(raw(spark, cycle(0, 0.1))).count() == 1


def test_step_direction_defaults(spark):
    flat = raw(spark, [("r", 0, 1, i, float(i), 0.0, 3.0, 0.5, 0.5) for i in range(3)])
    assert steps.classify_steps(flat).first().is_charge and not steps.classify_steps(flat, False).first().is_charge
    jump = raw(spark, [("r", 0, 1, i, float(i), 0.0, 3.0, c, d) for i, (c, d) in enumerate([(5.0, 0.0), (0.0, 0.1), (0.0, 0.2), (9.9, 0.3)])])
    assert not steps.classify_steps(jump).first().is_charge


def test_waveform_flag(spark):
    rows = raw(spark, [("r", 0, 1, 0, 0.0, 0.0, 3.0, 0.5, 0.5)])
    assert not steps.waveform_steps(rows).first().is_waveform
    assert steps.waveform_steps(rows.withColumn("_wf_chg_cap", F.lit(0.1))).first().is_waveform


def test_validation_messages(spark):
    rows = raw(spark, [("a", 0, 1, 5, 0.0, 1.0, 3.0, 0.5, 0.5), ("a", 0, 1, 6, 9.0, 1.0, 3.9, 2.5, 0.5), ("b", 1, 1, 0, 5.0, 1.0, 3.0, 0.5, 0.5), ("b", 1, 1, 1, 4.0, 1.0, 3.0, 0.5, -1.0), ("c", 2, 1, 0, 0.0, 1.0, 3.0, 0.5, 0.5)])
    rules = {"charge_capacity": {"max": 2.0}, "discharge_capacity": {"min": 0.0}, "test_time": {"monotonic": "increasing"}, "cycle_index": {"max_at_least": 2, "type": "integer"}}
    got = {r.run_id: r.reason for r in validate.validate(rows, rules).collect()}
    assert got == {"a": "charge_capacity is higher than allowed max 2.0 at index 1: value=2.5", "b": "discharge_capacity is lower than allowed min 0.0 at index 1:value=-1.0", "c": ""}
    assert "monotonically" in validate.validate(rows.where("run_id = 'b'"), {"test_time": {"monotonic": "increasing"}}).first().reason
    assert validate.validate(rows, {"run_id": {"type": "float"}}).first().reason == "Column run_id: not float type"
    assert validate.validate(rows.withColumn("cycle_index", F.lit(0.5)), {"cycle_index": {"type": "integer"}}).first().reason.startswith("Column cycle_index: not integer type at index 0")


def test_diagnostic_overlap_is_an_error(spark):
    rows = raw(spark, [("r", 0, s, s, 0.0, 0.0, 3.0, 0.5, 0.5) for s in (1, 2)])
    assert diagnostics.from_step_numbers(rows, {"a": ("contains", [(1,)])}).first().cycle_type == "a"
    with pytest.raises(Exception, match="several types"):
        diagnostics.from_step_numbers(rows, {"a": ("contains", [(1,)]), "b": ("exact", [(2, 1)])}).collect()
    with pytest.raises(ValueError, match="odd"):
        diagnostics.from_step_numbers(rows, {"a": ("odd", [(1,)])})


def test_stray_finals(spark):
    df = spark.createDataFrame([("r", 2, 1, 1, 2e6), ("r", 9, 1, 1, 2e6), ("r", 9, 2, 1, None)], "run_id string, cycle_index int, step_index int, step_index_counter int, test_time double")
    assert [(r.cycle_index, r.step_index) for r in diagnostics.without_stray_finals(df).collect()] == [(9, 1)]


def test_thresholds():
    assert life.thresholds() == [0.98, 0.95, 0.92, 0.89, 0.86, 0.83, 0.8]


def test_statistics(spark):
    x = [0.5, 1.5, 2.0, 4.0, 8.0]
    df = spark.createDataFrame([(v,) for v in x], "d double")
    got = df.agg(*summary_columns(F.col("d"), "p", log=False)).first()
    a = np.array(x)
    m = [((a - a.mean()) ** k).mean() for k in range(5)]
    n, g2 = len(a), m[4] / m[2] ** 2 - 3
    want = [m[2], 0.5, a.mean(), m[3] / m[2] ** 1.5, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6) + 3, a.sum(), (a**2).sum()]
    assert all(math.isclose(got[f"p_{s}"], w) for s, w in zip(SUMMARY, want))


def test_matrix_names_and_collisions(spark):
    df = spark.createDataFrame([("r", 1.0)], "run_id string, a double")
    m = matrix.feature_matrix([(df, "F", {"x": 1}), (df, "F", {"x": 2})])
    assert len(m.columns) == 3 and m.columns[1].startswith("a::F::")
    with pytest.raises(ValueError, match="twice"):
        matrix.feature_matrix([(df, "F", {}), (df, "F", {})])


def test_exclusion_falls_back_above_one(spark):
    """Where the last fraction is above 1, the one before it counts."""
    summary = spark.createDataFrame([(r, i, float(i)) for r in (1, 2) for i in range(12)], "run_id long, cycle_index int, charge_throughput double")
    left = spark.createDataFrame([(1, 0, 1.0), (1, 5, 0.7), (1, 9, 1.2), (2, 0, 1.0), (2, 5, 0.9), (2, 9, None)], "run_id long, cycle_index int, fractional_metric double")
    got = {r.run_id: r for r in features.exclusion_criteria(summary, left, 1.0, n=5, throughput_cutoff=2.0, full_cycles_cutoff=3.0).collect()}
    assert got[1].fractional_capacity_at_EOT == 0.7 and got[1].is_below_fractional_capacity_at_EOT and got[1].to_include
    assert got[2].fractional_capacity_at_EOT == 0.9 and not got[2].to_include


def test_group_folds_and_exclusion(spark):
    rows = spark.createDataFrame([(f"r{i}", f"g{i % 7}", i % 7 != 3 or i > 60) for i in range(70)], "run_id string, g string, is_ok boolean")
    got = matrix.folds(rows, 3, 1, "g").groupBy("g").agg(F.count_distinct("fold").alias("n")).collect()
    assert all(r.n == 1 for r in got)
    kept = {r.g for r in matrix.drop_excluded_groups(rows, ["is_ok"], "g").collect()}
    assert kept == {f"g{i}" for i in range(7)} - {"g3"}


def test_linear_model_recovers(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 3))
    y = x @ [2.0, -1.0, 0.0] + 5
    df = spark.createDataFrame([(f"r{i}", *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "run_id string, a double, `b::F` double, c double, y double")
    for kind in ("elastic", "lasso", "ridge"):
        model, names, errors = models.train_linear(df, ["a", "b::F", "c"], "y", kind, [1e-4, 1.0], [0.5], 3)
        assert errors["rmse"] < 0.01 and errors["r2"] > 0.999
    with pytest.raises(ValueError, match="missing"):
        models.predict_linear(model, names, df.drop("c"))


def test_power(spark):
    trace = spark.createDataFrame([("w", float(t), v) for t, v in enumerate((0.0, 10.0, 10.0, 0.0))], "wave_id string, time double, velocity double")
    got = [r.power for r in waveform.power_from_velocity(trace, "mps").orderBy("time").collect()]
    still = 0.01 * 1500 * 9.8
    drag = 0.5 * 1.225 * 0.34 * 1.75 * 100
    assert got[0] == 0 and math.isclose(got[1], -(1500 * 5 + still + drag) * 10)


def test_roles(spark):
    rows = []
    t = 0.0
    for w in range(2):
        for s, (current, length) in enumerate([(0.0, 3600), (-4.0, 30), (0.0, 40), (3.0, 10), (-1.0, 900)]):
            rows += [("r", 0, s, w * 5 + s, t + length * k / 4, 3.5, current) for k in range(5)]
            t += length + 1
    rows += [("r", 0, 9, 99, t + k, 3.0, -1.0) for k in range(5)]
    df = spark.createDataFrame(rows, "run_id string, cycle_index int, step_index int, step_index_counter int, test_time double, voltage double, current double")
    got = {r.step_index: r.role for r in hppc.step_roles(df, 4.0).collect()}
    assert got == {0: "hppc_long_rest", 1: "hppc_discharge_pulse", 2: "hppc_short_rest", 3: "hppc_charge_pulse", 4: "hppc_discharge_to_next_soc", 9: "hppc_final_discharge"}


def test_raw_curves(spark):
    rows = [("r", 5, "rpt_1C", s, 1, s, float(t), q, d, 0.1, None) for s in (0, 1) for t, (q, d) in enumerate([(None, 0.0), (0.5, 0.0), (1.0, 0.6)])]
    df = spark.createDataFrame(rows, "run_id string, cycle_index int, cycle_type string, step_index int, step_index_counter int, step_type int, test_time double, charge_capacity double, discharge_capacity double, charge_dQdV double, discharge_dQdV double")
    got = {r.channel: r["values"] for r in features.raw_curves(df, ["rpt_1C"], (0,)).collect()}
    assert got["diag_cycle_0_rpt_1C_capacity_step_0"] == [1.0, 0.5, 0.4] and got["diag_cycle_0_rpt_1C_dQdV_step_1"] == [0.0, 0.0, 0.0] and got["diag_cycle_0_rpt_1C_test_time_step_1"] == [0.0, 1.0, 2.0]


def test_streamed_sessions(spark, tmp_path):
    schema = T.StructType([T.StructField("run_id", T.StringType()), T.StructField("date_time", T.TimestampType())])
    rows = spark.createDataFrame([("r", t) for t in (0, 600, 9000, 9600, 400_000)], "run_id string, s long").select("run_id", F.timestamp_seconds("s").alias("date_time"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = {(r.started, r.samples) for r in pauses.sessions(rows).collect()}
    stream = pauses.sessions(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), lateness="1 hour")
    q = stream.writeStream.outputMode("append").format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    streamed = {(r.started, r.samples) for r in spark.sql("select * from sessions").collect()}
    assert len(batch) == 3 and len(streamed) == 2 and streamed < batch


def test_protocol_durations(spark):
    from voltlake.operators import protocols

    row = spark.createDataFrame([(7, 3.6, 30.0, 1.0, 4.2, 30.0, 5.0, 2.0, 2.7, 15.0, 4.84)], "seq_num int, charge_constant_current_1 double, charge_percent_limit_1 double, charge_constant_current_2 double, charge_cutoff_voltage double, charge_constant_voltage_time double, charge_rest_time double, discharge_constant_current_1 double, discharge_cutoff_voltage double, discharge_rest_time double, capacity_nominal double")
    got = {r.step: (r.value, r.end_value) for r in protocols.regular_cycle(row).collect()}
    assert got == {1: (17.424, "00:05:00"), 2: (4.84, "4.2"), 3: (4.2, "00:30:00"), 4: (None, "00:05:00"), 5: (9.68, "2.7"), 6: (None, "00:15:00")}
    assert protocols.first_rest(row).first().rest == "04:24:00"


def test_project_rules():
    assert validate.rules_of("FastCharge", "arbin") is validate.LFP_RULES and validate.rules_of("Unknown", "maccor") is validate.RULES["maccor-lfp"]
    assert validate.rules_of("Iris", "arbin")["charge_capacity"]["max"] == 100.0


def test_ewma(spark):
    import pandas as pd
    from voltlake.operators import smooth

    x = [1.0, 4.0, 2.0, 8.0, 5.0, 7.0]
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate(x)], "run_id string, i int, x double")
    for how in ({"alpha": 0.3}, {"com": 0.1}, {"alpha": 1.0}):
        got = [r.m for r in smooth.ewma(df, ["run_id"], "i", "x", "m", **how).orderBy("i").collect()]
        assert np.allclose(got, pd.Series(x).ewm(**how).mean())


def test_monotone_cubic(spark):
    from voltlake.operators import smooth

    knots = spark.createDataFrame([("r", float(i), v) for i, v in enumerate((0.0, 0.0, 1.0, 3.0, 3.0, 2.0))], "run_id string, x double, y double")
    bounds = spark.createDataFrame([("r", -1.0, 6.0)], "run_id string, lo double, hi double")
    got = {round(r.x, 6): r.y for r in smooth.monotone_cubic(knots, bounds, ["run_id"], "x", "y", 29).collect()}
    assert got[-1.0] is None and got[6.0] is None and [got[float(i)] for i in range(6)] == [0, 0, 1, 3, 3, 2]
    inside = [got[i / 4] for i in range(21)]
    assert all(b >= a for a, b in zip(inside[:13], inside[1:13])) and got[0.5] == 0 and got[3.5] == 3
    # Slopes 0 and 4/3 at the ends of the piece from 1 to 2, by hand at its middle.
    assert math.isclose(got[1.5], 0.5 * 0 + 0.125 * 1 * 0 + 0.5 * 1 - 0.125 * (2 / (1 / 1 + 1 / 2)))


def test_splines(spark):
    from voltlake.operators import splines

    x = np.sort(np.random.default_rng(3).random(40)) * 4
    at = np.linspace(x[0] - 0.2, x[-1] + 0.2, 101)
    for degree in (2, 3):
        p = np.polynomial.Polynomial(np.arange(1, degree + 2) / 3)
        assert np.allclose(splines.spline(x, p(x), at, degree), p(at), atol=1e-9)
        assert np.allclose(splines.spline(x, np.sin(x), x, degree), np.sin(x))
        assert np.isnan(splines.spline(x[:degree], x[:degree], at, degree)).all()
    # Against the whole system: values, equal third derivatives beside the second and the last but one point.
    y, h = np.cos(3 * x[:9]), np.diff(x[:9])
    a = np.zeros((9, 9))
    b = np.zeros(9)
    for i in range(1, 8):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    a[0, :3] = -1 / h[0], 1 / h[0] + 1 / h[1], -1 / h[1]
    a[8, 6:] = -1 / h[6], 1 / h[6] + 1 / h[7], -1 / h[7]
    m = np.linalg.solve(a, b)
    mids = (x[:8] + x[1:9]) / 2
    want = (y[:-1] + y[1:]) / 2 - (m[:-1] + m[1:]) * h**2 / 16
    assert np.allclose(splines.spline(x[:9], y, mids), want)
    rows = [("a", float(v), float(v**3)) for v in (0, 1, 2, 3, 4)] + [("a", 4.0, 64.0), ("a", None, 1.0), ("b", 1.0, 1.0)]
    got = splines.interpolate_spline(spark.createDataFrame(rows, "run_id string, x double, y double"), ["run_id"], "x", "y", 9).collect()
    a = sorted((r.x, r.y) for r in got if r.run_id == "a")
    assert len(a) == 9 and all(math.isclose(v, k**3, abs_tol=1e-9) for k, v in a) and all(r.y is None or r.y != r.y for r in got if r.run_id == "b")


def test_blends(spark):
    from voltlake.operators import halfcell

    grid = [i / 50 for i in range(51)]
    pe = [(q, 3.4 + 0.9 * q**0.5) for q in grid]
    first = [(q, 0.6 * (1 - q) ** 2 + 0.05) for q in grid]
    second = [(q, 0.65 - 0.6 * q) for q in grid]
    alone = np.array(halfcell.blend(first, second, 0.0)).T
    assert np.allclose(np.interp(grid, *alone), [v for _, v in first], atol=1e-3)
    mixed = halfcell.blend(first, second, 0.3, 201)
    v = 0.35
    share = 0.7 * (1 - ((v - 0.05) / 0.6) ** 0.5) + 0.3 * (0.65 - v) / 0.6
    assert math.isclose(np.interp(share, *np.array(mixed).T), v, abs_tol=2e-3)
    cells = spark.range(1, 41).select(F.lit("r").alias("run_id"), F.lit(0).alias("cycle_index"), (F.col("id") / 40.0).alias("q"))
    cells = cells.withColumn("voltage", halfcell.emulate(pe, mixed, F.col("q"), F.lit(0.1), F.lit(1.4), F.lit(1.2)))
    bounds = {"lli": (0.0, 0.2), "q_pe": (1.3, 1.5), "q_ne": (1.1, 1.3), "x_ne_2": (0.0, 0.6)}
    got = halfcell.fit_electrodes(cells, pe, first, bounds, rounds=4, n=5, ne_2=second).first()
    assert got.error < 0.005 and abs(got.x_ne_2 - 0.3) < 0.1 and abs(got.q_ne - 1.2) < 0.03


def own_featurizer(tables, cycle):
    return tables.summary.where(F.col("cycle_index") == cycle).select("run_id", F.col("discharge_capacity").alias("q"), F.col("charge_duration").alias("c"))


own_featurizer.defaults = {"cycle": 0}


def test_features_models_and_predictions(spark, tmp_path):
    from voltlake.plans import learn, structure

    rows = spark.range(40).select(F.format_string("r%d", "id").alias("run_id"), F.explode(F.sequence(F.lit(0), F.lit(60))).alias("cycle_index"), (F.col("id") / 400.0).alias("k"))
    summary = rows.select("run_id", F.col("cycle_index").cast("int").alias("cycle_index"), (1.0 - F.col("k") - F.col("cycle_index") * (0.002 + F.col("k") / 20)).alias("discharge_capacity"), (600 + 500 * F.col("k")).alias("charge_duration"))
    summary.write.parquet(str(tmp_path / "s" / "summary"))
    place = lambda name: str(tmp_path / name)
    x = learn.featurize(spark, place("s"), place("x"), {f"{__name__}.own_featurizer": {"cycle": 1}, "capacities": {"positions": [5, 10]}})
    assert x.count() == 40 and {c.rpartition("::")[0] for c in x.columns} == {"", "q::own_featurizer", "c::own_featurizer", "cycle_5::capacities", "cycle_10::capacities"}
    learn.featurize(spark, place("s"), place("y"), {"cycle_life": None})
    errors = learn.train(spark, place("x/matrix"), place("y/matrix"), place("m"), "cycle_life::cycle_life", alphas=[0.001], ratios=[0.5], n_folds=3)
    assert errors["r2"] > 0.8
    structure.main(["predict", place("x/matrix"), place("m"), place("p")])
    got = spark.read.parquet(place("p"))
    assert got.count() == 40 and got.where("prediction is null or target <> 'cycle_life::cycle_life'").count() == 0
    with pytest.raises(ValueError, match="no table diagnostic_summary"):
        learn.featurize(spark, place("s"), place("z"), {"summary_differences": None})
    with pytest.raises(ValueError, match="neither a featurizer"):
        learn.featurizer("odd")
    with pytest.raises(ValueError, match="not a column"):
        learn.train(spark, place("x/matrix"), place("y/matrix"), place("n"), "odd")


def test_curve_vectors_in_components(spark):
    rows = spark.range(30).select(F.format_string("r%d", "id").alias("run_id"), F.lit(10).alias("cycle_index"), F.lit("discharge").alias("step_type"), F.col("id").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(8))).alias("i"))
    curves = rows.select("run_id", "cycle_index", "step_type", (F.col("i") / 8.0).alias("voltage"), ((F.col("k") % 7) * F.col("i") + F.col("k") * F.col("i") * F.col("i") + F.sin(F.col("k") * 9 + F.col("i")) / 50).alias("discharge_capacity"))
    vectors = models.curve_vectors(curves)
    assert {len(r.embedding) for r in vectors.collect()} == {9}
    fitted = models.Components(vectors, n=4, explain=0.99)
    assert fitted.least <= 2 and fitted.embed(vectors).agg(F.max("error")).first()[0] < 0.2


def test_percentiles_by_brackets(spark):
    from voltlake.functions.quantiles import percentiles

    rng = np.random.default_rng(5)
    x, y = rng.normal(size=5001), rng.integers(0, 4, 5001).astype(float)
    rows = spark.createDataFrame([(float(a), float(b) if i % 3 else None, None) for i, (a, b) in enumerate(zip(x, y))], "x double, y double, z double")
    columns, shares = {c: F.col(c) for c in "xyz"}, [0.0, 0.05, 0.5, 0.95, 1.0]
    want = {"x": np.percentile(x, [100 * s for s in shares]), "y": np.percentile(y[[i for i in range(5001) if i % 3]], [100 * s for s in shares])}
    for limit in (0, 100_000):
        got = percentiles(rows, columns, shares, one_task=limit, accuracy=200)
        assert np.allclose(got["x"], want["x"], atol=1e-12) and np.allclose(got["y"], want["y"]) and got["z"] == [None] * 5


def test_pulse_features_with_voltage_differences(spark):
    rows = []
    for p in (0, 30):
        t = 0.0
        for w in range(2):
            for s, (current, length) in enumerate([(0.0, 3600), (-4.0, 30), (0.0, 40), (3.0, 10), (-1.0, 900)]):
                n = 12
                rows += [("r", p, s, w * 5 + s, t + length * k / n, 3.5 - w / 10 + current / 50 - (0.01 * k if s == 4 else 0) - p / 3000, current, w + k / n * (s == 4)) for k in range(n)]
                t += length + 1
    df = spark.createDataFrame(rows, "run_id string, cycle_index int, step_index int, step_index_counter int, test_time double, voltage double, current double, discharge_capacity double")
    got = hppc.hppc_features(df, 4.0, 1, soc_window=1).first()
    assert math.isclose(got.mean_v_diff, 0.01, abs_tol=1e-9) and math.isclose(got.sum_v_diff, 0.1, abs_tol=1e-9) and got.var_v_diff < 1e-12 and "mean_ocv" in got.asDict()
