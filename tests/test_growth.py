"""What the plans of queries over made curves may not hold, and steps that took more than linear time, against plain versions."""

from pyspark.sql import functions as F
from voltlake.operators import hppc
from voltlake.plans import adaptor, catalog


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_slopes_are_not_broadcast(spark, small_tables):
    assert "Broadcast" not in plan(catalog.diffusion_slopes(spark, small_tables))


def test_roles_by_rules_are_those_joined(spark, small_tables):
    curves = adaptor.hppc_curves(spark, small_tables)
    # A step without a counter, a run without a number and a current that is missing.
    odd = curves.withColumns(
        {
            "current": F.when(F.hash("run_id", "test_time") % 50 != 0, F.col("current")),
            "step_index_counter": F.when(F.col("step_index_counter") != 7, F.col("step_index_counter")),
            "run_id": F.when(F.col("run_id") % 7 != 6, F.col("run_id")),
        }
    )
    joined, ruled = hppc.windows_of(odd, hppc.step_roles(odd, 2.0)), hppc.windows_by_rules(odd, 2.0)
    columns = sorted(joined.columns)
    assert sorted(ruled.columns) == columns and ruled.count() == joined.count() > 0
    assert ruled.select(columns).exceptAll(joined.select(columns)).isEmpty()
    assert "Broadcast" not in plan(joined)


def test_a_rest_of_one_sample_has_no_slope(spark):
    rows = [(1, 0, 1, "hppc_discharge_pulse", 10.0 + k, 3.0, -1.0) for k in range(3)] + [(1, 0, 1, "hppc_short_rest", 20.0, 3.1, 0.0)]
    df = spark.createDataFrame(rows, "run_id long, position int, window int, role string, test_time double, voltage double, current double")
    assert hppc.diffusion(df).isEmpty()


def test_pulse_features_are_one_pass(spark, small_tables):
    """Curves are made once, nothing is broadcast, and the pass gives what its parts give."""
    once = plan(adaptor.hppc_curves(spark, small_tables)).count("Generate explode")
    found = plan(catalog.hppc_features(spark, small_tables))
    assert "Broadcast" not in found and found.count("Generate explode") == once + 1  # and one of nine rest voltages a run
    rows = hppc.windows_by_rules(adaptor.hppc_curves(spark, small_tables).where((F.col("run_id") % 3 > 0) | (F.col("cycle_index") == 0)), 2.0).where((F.col("run_id") % 5 > 0) | (F.col("role") != "hppc_long_rest"))
    got = hppc.pulse_changes(rows, 1, digits=6)
    want = hppc.resistance_change(hppc.resistances(rows), 1)
    for part in (hppc.rest_voltage_change(rows, 1, digits=6), hppc.diffusion_change(hppc.diffusion(rows), 1)):
        want = want.join(part, "run_id", "full")
    assert got.columns == want.columns and got.count() == want.count()
    near = [F.round(c, 9).alias(c) for c in want.columns]
    assert got.select(near).exceptAll(want.select(near)).isEmpty()


def test_pulse_tests_are_dealt_out_by_users(spark, small_tables, monkeypatch):
    """A task makes the curves of a bounded number of users and finds their features, too; only users are shuffled."""
    monkeypatch.setattr(adaptor, "ROWS_A_TASK", 400)
    n = spark.read.parquet(f"{small_tables}/events.parquet").select("user_id").distinct().count()
    found = plan(catalog.hppc_features(spark, small_tables))
    assert f"{-(-n * 2 * 9 * 4 * 12 // 400)}), REPARTITION_BY_NUM" in found and found.count("Exchange ") <= 2


def test_pulse_features_are_not_broadcast(spark, small_tables):
    assert "Broadcast" not in plan(catalog.pulse_features(spark, small_tables))


def test_resistances_move_no_rows(spark, small_tables):
    """Only users are shuffled: to be made distinct, and to be dealt out."""
    found = plan(catalog.pulse_resistances(spark, small_tables))
    assert "Broadcast" not in found and found.count("Exchange ") <= 2


def test_no_frame_is_read_anew_for_every_row(spark, small_tables):
    """A frame that ends with its curve takes quadratic time."""
    found = plan(catalog.imposed_degradation(spark, small_tables))
    assert "unboundedfollowing" not in found and "Broadcast" not in found


def test_electrodes_are_read_once_for_their_own_parameters(spark, monkeypatch):
    """A round has some thousand candidates of a cell; their electrodes have some hundred different curves."""
    import numpy as np
    import pandas as pd
    from voltlake.operators import halfcell

    pe, ne = [(i / 50, 3.4 + 0.9 * (i / 50) ** 0.5) for i in range(51)], [(i / 50, 0.6 * (1 - i / 50) ** 2 + 0.05) for i in range(51)]
    kept, asked, interp = [], [], np.interp
    monkeypatch.setattr(type(spark.range(1)), "mapInPandas", lambda self, f, schema: kept.append(f) or spark.createDataFrame([], schema))
    cells = spark.createDataFrame([], "run_id long, cycle_index int, q double, voltage double")
    halfcell.fit_electrodes(cells, pe, ne, {"lli": (0.0, 0.3), "q_pe": (1.2, 1.6), "q_ne": (1.1, 1.5)})
    monkeypatch.setattr(np, "interp", lambda x, *more, **ends: asked.append(np.size(x)) or interp(x, *more, **ends))
    q = np.arange(1, 41) / 40
    points = [{"q": x, "voltage": y} for x, y in zip(q, interp((q + 0.1) / 1.4, *zip(*pe)) - interp(q / 1.25, *zip(*ne)))]
    got = next(kept[0](iter([pd.DataFrame({"cell": ["a"], "points": [points]})])))
    assert abs(got.lli[0] - 0.1) < 0.02 and abs(got.q_pe[0] - 1.4) < 0.02 and abs(got.q_ne[0] - 1.25) < 0.02
    assert sum(asked) < 5 * 400 * len(q)


def test_curves_of_a_batch_are_solved_at_once(spark, monkeypatch):
    """Groups that batches cut, equal capacities, missing values and runs without a number, against a curve at a time."""
    import numpy as np
    from voltlake.operators import splines

    r = np.random.default_rng(4)
    rows = []
    for run in (None, *range(40)):
        for window in range(2):
            for position in range(2):
                n = int(r.integers(0, 30))
                q = np.sort(r.choice(np.arange(100), n)) / 16.0
                rows += [(run, window, "hppc_discharge_to_next_soc", position, float(k), float(q[k]) if r.random() > 0.05 else None, float(r.normal()) if r.random() > 0.05 else None) for k in range(n)]
    df = spark.createDataFrame(rows, "run_id long, window int, role string, position int, test_time double, discharge_capacity double, voltage double")
    want = []
    for key in sorted({x[:2] for x in rows}, key=repr):
        own = [x for x in rows if x[:2] == key and x[5] is not None and x[6] is not None]
        first = dict(sorted((q, v) for q, v in {x[5]: x[6] for x in own if x[3] == 0}.items()))
        later = [x for x in own if x[3] == 1 and first and min(first) < x[5] < max(first)]
        d = splines.spline(np.array([*first]), np.array([*first.values()]), np.array([x[5] for x in later])) - np.array([x[6] for x in later])
        want += [(*map(repr, key), round(float(x), 6)) for x in d if np.isfinite(x)]
    calls = []
    monkeypatch.setattr("pyspark.sql.GroupedData.applyInPandas", lambda *a: calls.append(1))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = sorted((repr(x.run_id), repr(x.window), round(x.d, 6)) for x in splines.voltage_differences(df, 1).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert not calls and got == sorted(want) and len(got) > 100


def test_step_tables_are_dealt_out_by_their_size(spark, small_tables, monkeypatch):
    """A task makes rows of a bounded number of parts, however many there are, and no side of a join is broadcast."""
    monkeypatch.setattr(adaptor, "ROWS_A_TASK", 400)
    n = spark.read.parquet(f"{small_tables}/part.parquet").count()
    found = plan(catalog.rules_of_step_tables(spark, small_tables))
    assert f"{-(-n * 20 // 400)}), REPARTITION_BY_NUM" in found and "Broadcast" not in found
