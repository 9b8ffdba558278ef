"""Distances between curves, the evolutionary search and imposed losses, against plain versions."""

import numpy as np
import pytest
from voltlake.operators import halfcell, matching


def all_pairs(a, b):
    both = np.concatenate((a, b))
    scale = both.std(axis=0, ddof=1)
    scale[scale == 0] = 1
    return np.sqrt((((a[:, None] - b[None]) / scale) ** 2).sum(2)).min(1)


def test_nearest_distances():
    r = np.random.default_rng(0)
    for n, m in ((1, 1), (3, 200), (200, 3), (150, 170)):
        for a, b in ((r.normal(size=(n, 2)), r.normal(size=(m, 2))), (r.integers(0, 4, (n, 2)) * 1.0, r.integers(0, 4, (m, 2)) * 1.0), (np.ones((n, 2)), r.normal(size=(m, 2)) * [0, 1])):
            if len(a) + len(b) > 2:
                assert np.allclose(matching.nearest_distances(a, b), all_pairs(a, b))
    q = np.linspace(0, 3, 1001)
    a, b = np.column_stack((q, np.sqrt(q))), np.column_stack((q + 0.2, np.sqrt(q) + 0.1 * np.sin(9 * q)))
    assert np.allclose(matching.nearest_distances(a, b), all_pairs(a, b))


def test_smoothing():
    y = np.random.default_rng(1).normal(size=40)
    want = [np.average(y[: i + 1], weights=matching.DECAY ** np.arange(i, -1, -1)) for i in range(40)]
    assert np.allclose(matching.smoothed(y), want, rtol=1e-12, atol=1e-12)


def test_search_finds_the_deeper_of_two_basins():
    """A shallow basin around a point of a coarse grid, and a deep one between its points."""
    truth = np.array([0.6875, 0.3125, 0.4375])

    def f(x):
        return min(0.2 + 3 * ((x - 0.25) ** 2).sum(), 2 * float(np.linalg.norm(x - truth)))

    best, error, generations = matching.evolve(f, np.zeros(3), np.ones(3), seed=1, generations=300)
    assert np.abs(best - truth).max() < 1e-3 and error < 0.02 and 0 < generations <= 300
    again = matching.evolve(f, np.zeros(3), np.ones(3), seed=1, generations=300)
    assert (again[0] == best).all()
    # Rounds of a refined grid end in the wide one.
    center, spread = np.full(3, 0.5), 1.0
    for _ in range(8):
        grid = np.stack(np.meshgrid(*[np.linspace(-0.5, 0.5, 9) * spread + c for c in center]), -1).reshape(-1, 3).clip(0, 1)
        center, spread = grid[np.argmin([f(x) for x in grid])], spread * 0.35
    assert f(center) >= 0.2
    fixed, error, _ = matching.evolve(f, truth, truth)
    assert (fixed == truth).all() and error == 0
    partly, _, _ = matching.evolve(f, np.array([truth[0], 0, 0]), np.array([truth[0], 1, 1]), generations=300)
    assert partly[0] == truth[0] and np.abs(partly - truth).max() < 1e-3


GRID = np.linspace(0, 1, 101)
PE = [(float(x), 3.4 + 0.9 * float(x) ** 0.5 + 0.05 * float(np.tanh(20 * (x - 0.4)))) for x in GRID]
NE = [(float(x), 0.7 * (1 - float(x)) ** 3 + 0.08 + 0.06 * float(1 - np.tanh(15 * (x - 0.5)))) for x in GRID]
LIMITS = (3.0, 4.1)


def measured(lli, q_pe, q_ne, ne=NE, n=160):
    lo, hi = max(-lli, 0), min(q_pe - lli, q_ne)
    q = np.linspace(lo, hi, n)
    return q + 0.77, np.interp((q + lli) / q_pe, *np.array(PE).T) - np.interp(q / q_ne, *np.array(ne).T)


@pytest.mark.parametrize("kind", ["V-Q", "dQdV", "dVdQ"])
def test_match_electrodes(spark, kind):
    truth = {"a": (0.12, 2.31, 2.47), "b": (0.31, 2.10, 2.05)}
    rows = [(k, 7, float(q), float(v)) for k, t in truth.items() for q, v in zip(*measured(*t))] + [("none", 1, 1.0, None), ("few", 1, 1.0, 3.5), ("out", 1, 1.0, 9.0), ("out", 1, 2.0, 9.5)]
    cells = spark.createDataFrame(rows, "run_id string, cycle_index int, q double, voltage double")
    bounds = {"lli": (0.0, 0.6), "q_pe": (1.8, 2.8), "q_ne": (1.8, 2.8)}
    got = {r.run_id: r for r in matching.match_electrodes(cells, PE, NE, bounds, kind, LIMITS, n=401, least_q=0.2, per_parameter=10, generations=80).collect()}
    pe, ne = np.array(PE).T, np.array(NE).T
    for k, t in truth.items():
        # Voltage over capacity alone tells capacities less sharply than its derivatives do; no kind may end worse than the truth.
        seen = matching.representation(matching._regridded(*measured(*t), LIMITS, 401), kind, LIMITS, 0.2)
        true_error = matching.curve_error(seen, matching.emulated(np.array(t), pe, lambda s: ne, LIMITS, 401), kind, LIMITS, 0.2)
        assert got[k].error <= true_error + 1e-3 and got[k].cycle_index == 7
        assert np.abs(np.subtract((got[k].lli, got[k].q_pe, got[k].q_ne), t)).max() < (0.1 if kind == "V-Q" else 0.06)
    assert got["few"].lli is None and got["out"].error is None and "none" not in got
    with pytest.raises(ValueError, match="dVdX"):
        matching.match_electrodes(cells, PE, NE, bounds, "dVdX")


def test_match_a_blend(spark):
    other = [(float(x), 0.6 - 0.55 * float(x)) for x in GRID]
    mixed = halfcell.blend(NE, other, 0.25, 201)
    rows = [("r", 0, float(q), float(v)) for q, v in zip(*measured(0.1, 2.3, 2.4, mixed))]
    bounds = {"lli": (0.1, 0.1), "q_pe": (2.3, 2.3), "q_ne": (2.2, 2.6), "x_ne_2": (0.0, 0.6)}
    got = matching.match_electrodes(spark.createDataFrame(rows, "run_id string, cycle_index int, q double, voltage double"), PE, NE, bounds, "V-Q", LIMITS, n=401, ne_2=other, per_parameter=10, generations=60).first()
    # Share and capacity of the negative make up for each other in part; the fit may not be worse than the truth.
    seen = matching._regridded(*measured(0.1, 2.3, 2.4, mixed), LIMITS, 401)
    whole = np.array(mixed).T
    true_error = matching.curve_error(seen, matching.emulated(np.array([0.1, 2.3, 2.4, 0.25]), np.array(PE).T, lambda s: whole, LIMITS, 401), "V-Q", LIMITS, 0.5)
    assert got.error <= true_error + 1e-3
    assert abs(got.x_ne_2 - 0.25) < 0.05 and abs(got.q_ne - 2.4) < 0.1 and (got.lli, got.q_pe) == (0.1, 2.3)


def test_curve_without_overlap():
    pe, ne = np.array(PE).T, np.array(NE).T
    assert matching.emulated(np.array([5.0, 2.0, 2.0]), pe, lambda s: ne, LIMITS, 50) is None
    assert matching.curve_error(np.zeros((5, 2)), None, "V-Q", LIMITS, 0.5) == matching.NO_CURVE


def test_impose_degradation(spark):
    soc = np.arange(-5.0, 96.0)
    pe = np.where(soc <= 90, 3.5 + (soc + 5) ** 2 / 11003, np.nan)
    ne = np.where(soc >= 2, 0.9 - (soc + 5) / 119, np.nan)
    rows = [(k, float(s), None if np.isnan(p) else float(p), None if np.isnan(m) else float(m)) for k in ("a", "b", "gone") for s, p, m in zip(soc, pe if k != "gone" else pe * np.nan, ne)]
    losses = {"a": (3.0, 10.0, 7.0), "b": (0.0, 0.0, 0.0), "gone": (1.0, 1.0, 1.0)}
    curves = spark.createDataFrame(rows, "run_id string, soc double, pe double, ne double")
    df = matching.impose_degradation(curves, spark.createDataFrame([(k, *v) for k, v in losses.items()], "run_id string, lli double, lam_pe double, lam_ne double"), ["run_id"], n=301)
    got = df.orderBy("run_id", "soc").collect()
    assert {r.run_id for r in got} == {"a", "b"} and len(got) == 602
    for k in ("a", "b"):
        lli, lam_pe, lam_ne = losses[k]
        gap = pe - ne
        x_pe = soc * (1 - lam_pe / 100) + lam_pe * soc[np.nanargmin(np.abs(gap - 4.2))] / 100
        x_ne = soc * (1 - lam_ne / 100) + lam_ne * soc[np.nanargmin(gap)] / 100 + lli
        grid = np.linspace(min(x_pe[0], x_ne[0]), max(x_pe[-1], x_ne[-1]), 301)
        own = [r for r in got if r.run_id == k]
        assert np.allclose([r.soc for r in own], grid)
        for name, x, y in (("pe", x_pe, pe), ("ne", x_ne, ne)):
            known = ~np.isnan(y)
            want = np.interp(grid, x[known], y[known], left=np.nan, right=np.nan)
            have = np.array([np.nan if r[name] is None else r[name] for r in own])
            edge = np.isclose(grid, x[known][0]) | np.isclose(grid, x[known][-1])
            assert np.allclose(have[~edge], want[~edge], equal_nan=True)
    # Without losses the curves are as they were.
    same = {round(r.soc, 6): r.pe for r in got if r.run_id == "b"}
    assert same[-5.0] == 3.5


def test_losses_are_seen_at_the_ends(spark):
    """A loss of inventory alone shifts the negative electrode, and the cell's ends with it."""
    soc = np.arange(0.0, 101.0)
    rows = [("r", float(s), float(3.0 + s / 80), float(0.5 - s / 400)) for s in soc]
    curves = spark.createDataFrame(rows, "run_id string, soc double, pe double, ne double")
    losses = spark.createDataFrame([("r", 10.0, 0.0, 0.0)], "run_id string, lli double, lam_pe double, lam_ne double")
    out = matching.impose_degradation(curves, losses, ["run_id"], n=111).orderBy("soc").collect()
    assert out[0].ne is None and out[10].ne == 0.5 and out[-1].pe is None and len(out) == 111
    ends = halfcell.halfcell_voltages(spark.createDataFrame(out), ["run_id"], upper=4.0, lower=2.7).first()
    assert ends.li_mass == 90.0
