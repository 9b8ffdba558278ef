"""Fast-charge waves: known figures, equal durations, and the monotone cubic against the Spark one."""

import numpy as np
from pyspark.sql import functions as F
from voltlake.operators import charge_waves, smooth, waveform

SCHEMA = "wave_id string, rates array<double>, mesh array<double>, final_rate double, soc_initial double, soc_final double, min_rate double, max_rate double"


def one(rates, mesh, lowest=0.2, highest=3.0):
    a = lambda x: np.array([x], float)
    return charge_waves.Waves(a(rates), a(mesh), a(rates[-1]), a(mesh[0]), a(mesh[-1]), a(lowest), a(highest))


def test_known_figures():
    w = one([0.5, 2.5, 2.0, 0.2], [0.05, 0.25, 0.65, 0.8])
    steps, plain = w.stepwise()[0], w.smooth(np.zeros(1))[0]
    assert np.allclose([steps.mean(), np.median(steps), steps.max(), steps.min()], [1.8648, 2.5, 2.5, 0.25], atol=1e-6)
    assert np.allclose([plain.mean(), np.median(plain), plain.max(), plain.min()], [1.631819, 1.991661, 2.5, 0.2], atol=1e-6)
    t = w.seconds(w.stepwise())[0]
    assert np.allclose([t.mean(), np.median(t)], [1552.953655, 1701.081081], atol=1e-5) and round(t.max(), 3) == 2296.358
    t = w.seconds(w.smooth(np.zeros(1)))[0]
    assert np.allclose([t.mean(), np.median(t)], [1503.457129, 1644.678275], atol=1e-5) and round(t.max(), 3) == 2539.486
    offset, miss = w.offsets()
    assert abs(miss[0]) < 1e-3 and offset[0] > 0 and w.smooth(offset).max() <= 3.0


def test_waves_last_as_long_as_their_steps(spark):
    r = np.random.default_rng(2)
    rows = []
    for i in range(300):
        k = int(r.integers(3, 6))
        mesh = np.sort(r.uniform(0.05, 0.85, k))
        mesh = np.linspace(0.05, 0.8, k) * 0.6 + mesh * 0.4
        rows.append((f"w{i}", [*r.uniform(0.8, 2.4, k - 1).tolist(), 0.6], mesh.tolist(), 0.6, float(mesh[0]), float(mesh[-1]), 0.2, 3.0))
    bad = [("short", [1.0, 0.5], [0.1, 0.5], 0.5, 0.1, 0.5, 0.2, 3.0), ("none", None, [0.1, 0.5, 0.6], 0.5, 0.1, 0.6, 0.2, 3.0), ("down", [1.0, 1.0, 0.5], [0.1, 0.6, 0.5], 0.5, 0.1, 0.5, 0.2, 3.0), ("null", [1.0, 1.0, 0.5], [0.1, 0.3, 0.5], None, 0.1, 0.5, 0.2, 3.0), (None, [1.0, 1.5, 0.5], [0.1, 0.3, 0.5], 0.5, 0.1, 0.5, 0.2, 3.0)]
    df = spark.createDataFrame(rows + bad, SCHEMA)
    waves = charge_waves.charge_waves(df)
    got = {x.wave_id: x for x in waves.collect()}
    assert len(got) == 305 and not any(got[b].matched for b in ("short", "none", "down", "null")) and got["null"].smooth == []
    fits = [x for x in got.values() if x.matched]
    assert len(fits) > 270 and all(abs(x.miss) < 1.0 and len(x.smooth) == len(x.stepwise) and max(x.smooth) <= 3.0 and min(x.smooth) >= 0.2 for x in fits)
    # Each form charges the whole range of its mesh.
    for wave, rates, mesh, *_ in rows[:50]:
        if got[wave].matched:
            assert abs(sum(got[wave].smooth) / 3600 - (mesh[-1] - mesh[0])) < 0.01 and abs(sum(got[wave].stepwise) / 3600 - (mesh[-1] - mesh[0])) < 0.01
    trace = charge_waves.seconds_of(waves).where("wave_id = 'w0'")
    steps = waveform.waveform_steps(trace, "rate", "I", scale=2.0)
    assert steps.agg(F.sum("duration")).first()[0] == len(got["w0"].smooth)
    assert charge_waves.charge_waves(df.limit(0)).count() == 0


def test_monotone_cubic_as_in_spark(spark):
    r = np.random.default_rng(4)
    x, y = np.cumsum(r.uniform(0.1, 1, (5, 7)), axis=1), r.normal(size=(5, 7)).round(1)
    at = np.linspace(x[:, 0], x[:, -1], 40, axis=1)
    knots = spark.createDataFrame([(k, float(a), float(b)) for k in range(5) for a, b in zip(x[k], y[k])], "run_id int, x double, y double")
    bounds = knots.groupBy("run_id").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    got = smooth.monotone_cubic(knots, bounds, ["run_id"], "x", "y", 40).orderBy("run_id", "x").collect()
    assert np.allclose([z.y for z in got], charge_waves.monotone_values(x, y, at).ravel())
    assert (charge_waves.monotone_values(x, y, np.array([[-1.0], [99], [-5], [99], [99]])) == 0).all()
