"""Features of diagnostics against numpy, and both groups of featurizers from tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from voltlake.functions.stats import SUMMARY
from voltlake.operators import diagnostic_features as df_
from voltlake.plans import learn

CURVE = "run_id string, cycle_index int, cycle_type string, step_index int, step_index_counter int, step_type int, voltage double, test_time double, current double, charge_capacity double, discharge_capacity double, charge_energy double, discharge_energy double, charge_dQdV double, discharge_dQdV double"


def curve_rows(run, cycle, k, n=30):
    """A charge and a discharge of an rpt cycle, the later the less."""
    out = []
    for step, side in ((1, 1.0), (2, -1.0)):
        for i in range(n):
            v = 3.0 + i / n
            q = (1 - 0.05 * k) * (i / n) ** (1 + 0.1 * k)
            c, d = (q, 0.0) if side > 0 else (1.0, q)
            gap = None if (k, step, i) == (1, 1, 3) else c
            out.append((run, cycle, "rpt_0.2C", step, 1, 0 if side > 0 else 1, v, 1e3 * cycle + 10.0 * i, side, gap, d, 3 * c, 3 * d, 0.1 * i + k, 0.2 * i - k * k))
    return out


def test_diagnostic_statistics(spark):
    rows = [r for k, cycle in enumerate((2, 40, 80)) for r in curve_rows("a", cycle, k)] + curve_rows("once", 2, 0)
    curves = spark.createDataFrame(rows, CURVE)
    summary = spark.createDataFrame([("a", c, "rpt_0.2C", 1.0 - k / 10, 3.0, 1.1, 3.3) for k, c in enumerate((2, 40, 80))], "run_id string, cycle_index int, cycle_type string, discharge_capacity double, discharge_energy double, charge_capacity double, charge_energy double")
    got = df_.diagnostic_statistics(curves, summary, 1.0, pos=(0, 2)).collect()
    assert [r.run_id for r in got] == ["a"]
    a, b = (np.array([r for r in curve_rows("a", c, k)], dtype=object) for k, c in ((0, 2), (2, 80)))
    for quantity, side, name in df_.CURVES:
        col = CURVE.split(", ").index(f"{quantity} double")
        step = 1 if side == "charge" else 2
        d = np.array([y[col] - x[col] for x, y in zip(a, b) if x[3] == step and x[col] is not None and y[col] is not None], float)
        m = d - d.mean()
        want = {"var": d.var(), "min": d.min(), "mean": d.mean(), "skew": (m**3).mean() / d.std() ** 3 if d.std() > 1e-12 else None, "sum": np.abs(d).sum(), "sum_square": (d * d).sum()}
        for s in SUMMARY:
            if s in want and want[s] is not None and abs(want[s]) > 1e-9:
                assert math.isclose(got[0][f"{name}_{s}"], np.log10(abs(want[s])), abs_tol=1e-6)
    assert math.isclose(got[0]["diag_sum_diff_0_2_rpt_0.2Cdischarge_capacity"], -0.2)
    assert len([c for c in got[0].asDict() if c != "run_id"]) == 54


def life(spark):
    rows, diag = [], []
    for run, rate in (("a", 0.002), ("b", 0.004), ("slow", 0.0005)):
        for c in range(1, 151):
            q = 1.0 - rate * c
            rows.append((run, c, q, 3 * q, q, 3 * q))
            if c % 30 == 0:
                diag.append((run, c, "rpt_1C", q, 3 * q, q, 3 * q))
    summary = spark.createDataFrame(rows, "run_id string, cycle_index int, discharge_capacity double, discharge_energy double, charge_capacity double, charge_energy double")
    diagnostic = spark.createDataFrame(diag, "run_id string, cycle_index int, cycle_type string, discharge_capacity double, discharge_energy double, charge_capacity double, charge_energy double")
    return summary, diagnostic.withColumn("date_time", F.timestamp_seconds(F.col("cycle_index") * 1000))


def test_diagnostic_properties(spark):
    summary, diagnostic = life(spark)
    got = {r.run_id: r for r in df_.diagnostic_properties(summary, diagnostic, n=2001).collect()}
    name = "rpt_1Cdischarge_energy0.8_"
    # The first diagnostic is at cycle 30; from there a straight line falls to 0.8 of its value.
    for run, rate in (("a", 0.002), ("b", 0.004), ("slow", 0.0005)):
        start = 1.0 - 30 * rate
        want = (1.0 - 0.8 * start) / rate
        assert abs(got[run][name + "cycle_index"] - want) < 0.01 * want
        assert math.isclose(got[run][name + "real_regular_throughput"], got[run][name + "normalized_regular_throughput"] * got[run].initial_regular_throughput)
    few = df_.diagnostic_properties(summary, diagnostic, n=500, extrapolate=False).collect()
    assert "slow" not in {r.run_id for r in few} and len(few) >= 1


def test_electrode_losses(spark):
    fits = spark.createDataFrame([("a", 5, 0.1, 2.0, 2.2, 0.01, 9), ("a", 50, 0.2, 1.8, 2.2, 0.01, 9), ("n", 1, None, None, None, None, 0)], "run_id string, cycle_index int, lli double, q_pe double, q_ne double, error double, generations int")
    got = {(r.run_id, r.cycle_index): r for r in df_.electrode_losses(fits).collect()}
    assert np.allclose([got["a", 50].lli_loss, got["a", 50].lam_pe, got["a", 50].lam_ne], [5, 10, 0]) and got["a", 5].lam_pe == 0 and got["n", 1].lam_pe is None


def test_electrode_features(spark):
    grid = np.linspace(0, 1, 81)
    pe, ne = [(float(x), 3.4 + 0.9 * float(x) ** 0.5) for x in grid], [(float(x), 0.7 * (1 - float(x)) ** 3 + 0.08) for x in grid]
    rows = []
    for cycle, (lli, q_pe, q_ne) in {3: (0.1, 2.3, 2.4), 60: (0.2, 2.2, 2.3), 90: (0.3, 2.0, 2.1)}.items():
        for q in np.linspace(0, min(q_pe - lli, q_ne), 120):
            v = np.interp((q + lli) / q_pe, *np.array(pe).T) - np.interp(q / q_ne, *np.array(ne).T)
            rows.append(("a", cycle, "rpt_0.2C", 1, 1, 0, float(v), float(q), 1.0, float(q), 0.0, 0.0, 0.0, 0.0, 0.0))
    bounds = {"lli": (0.0, 0.5), "q_pe": (1.9, 2.6), "q_ne": (1.9, 2.6)}
    (got,) = df_.electrode_features(spark.createDataFrame(rows, CURVE), pe, ne, bounds, kind="dVdQ", limits=(2.9, 4.1), n=151, least_q=0.2, per_parameter=6, generations=30).collect()
    assert abs(got.diag_0_q_pe - 2.3) < 0.15 and abs(got.diag_1_q_pe - 2.2) < 0.15 and got.diag_0_lam_pe == 0 and got.diag_1_error < 0.1 and "diag_2_lli" not in got


def test_groups_of_featurizers(spark, tmp_path):
    summary, diagnostic = life(spark)
    summary.write.parquet(str(tmp_path / "s" / "summary"))
    diagnostic.write.parquet(str(tmp_path / "s" / "diagnostic_summary"))
    got = learn.featurize(spark, str(tmp_path / "s"), str(tmp_path / "y"), {"all_targets": None, "trajectory": {"highest": 0.95, "lowest": 0.85, "step": 0.05}})
    named = {c.split("::")[1] for c in got.columns if "::" in c}
    assert named == {"trajectory", "diagnostic_properties"} and got.count() == 3
    assert sum("trajectory" in c for c in got.columns) == 2
    with pytest.raises(ValueError, match="diagnostic_curves|curves"):
        learn.featurize(spark, str(tmp_path / "s"), str(tmp_path / "x"), {"all_features": None})
