"""Matching of half-cell curves to measured cells by the distance between curves, with a seeded evolutionary search.

A cell's curve is one row; a task evolves one population of parameters for each of its cells. The error of
a candidate is how far the points of the measured curve are from the nearest point of the emulated one, in
capacity and voltage, or in one of the two derivatives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .halfcell import PARAMETERS, blend
from .interpolate import interpolate

#: What the error of a candidate is that has no curve within the voltage limits. Fixed value.
NO_CURVE = 100.0
#: Smoothing of derivatives: each older value counts by this much of the next. Fixed value (a centre of mass of 0.1).
DECAY = 0.1 / 1.1


def nearest_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distance of each point of a (n x 2) to the nearest of b (m x 2), coordinates divided by their deviation over both.

    Points of b are sorted by their first coordinate and visited from the nearest on outwards, until that coordinate
    alone is farther than the best distance: neighbours on a curve, not all pairs.
    """
    both = np.concatenate((a, b))
    scale = both.std(axis=0, ddof=1)
    scale = np.where(scale > 0, scale, 1.0)
    a, b = a / scale, b / scale
    b = b[np.argsort(b[:, 0], kind="stable")]
    best = np.full(len(a), np.inf)
    start = np.searchsorted(b[:, 0], a[:, 0])
    for step in (1, -1):
        at = start if step > 0 else start - 1
        open_ = np.arange(len(a))
        while len(open_):
            open_ = open_[(at[open_] >= 0) & (at[open_] < len(b))]
            gap = np.abs(b[at[open_], 0] - a[open_, 0])
            open_ = open_[gap < best[open_]]
            i = at[open_]
            best[open_] = np.minimum(best[open_], np.hypot(b[i, 0] - a[open_, 0], b[i, 1] - a[open_, 1]))
            at = at + step
    return best


def smoothed(y: np.ndarray) -> np.ndarray:
    """The mean of each value and all before it, weighted by powers of DECAY."""
    total, weight, w = y.astype(float).copy(), np.ones(len(y)), 1.0
    for i in range(1, min(len(y), 18)):  # beyond, weights are below the precision of numbers
        w *= DECAY
        total[i:] += w * y[:-i]
        weight[i:] += w
    return total / weight


def _regridded(q: np.ndarray, v: np.ndarray, limits: tuple[float, float], n: int) -> np.ndarray | None:
    """A curve (n x 2: capacity, voltage) within the voltage limits, from where its voltage is least, on an even grid of capacity."""
    inside = np.isfinite(v) & (v >= limits[0]) & (v <= limits[1])
    q, v = q[inside], v[inside]
    if len(q) < 2:
        return None
    q = q - q[np.argmin(v)]
    grid = np.linspace(q[0], q[-1], n)
    return np.column_stack((grid, np.interp(grid, q, v)))


def representation(curve: np.ndarray, kind: str, limits: tuple[float, float], least_q: float) -> np.ndarray:
    """The points of a curve (capacity, voltage) that are compared: V-Q itself, dQdV over an even grid of voltage, or dVdQ beyond least_q."""
    q, v = curve.T
    if kind == "V-Q":
        return curve
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = np.gradient(q, v) if kind == "dQdV" else np.gradient(v, q)
    y = smoothed(slope)
    if kind == "dVdQ":
        out = np.column_stack((q, y))
        return out[np.isfinite(y) & (q > least_q)]
    order = np.argsort(v, kind="stable")
    grid = np.linspace(*limits, len(v))
    grid = grid[(grid >= v.min()) & (grid <= v.max())]
    y = np.interp(grid, v[order], y[order])
    return np.column_stack((grid, y))[np.isfinite(y)]


def emulated(c: np.ndarray, pe: np.ndarray, ne: Callable[[float], np.ndarray], limits: tuple[float, float], n: int) -> np.ndarray | None:
    """The curve of a cell of parameters c (lost inventory, both capacities and, maybe, the second material's share)."""
    lli, q_pe, q_ne = c[:3]
    minus = ne(c[3] if len(c) > 3 else 0.0)
    lo = max(pe[0, 0] * q_pe - lli, minus[0, 0] * q_ne)
    hi = min(pe[0, -1] * q_pe - lli, minus[0, -1] * q_ne)
    if not hi > lo:
        return None
    q = np.linspace(lo, hi, n)
    return _regridded(q, np.interp((q + lli) / q_pe, *pe) - np.interp(q / q_ne, *minus), limits, n)


def curve_error(real: np.ndarray, candidate: np.ndarray | None, kind: str, limits: tuple[float, float], least_q: float) -> float:
    """The mean distance of the measured points to the nearest emulated ones."""
    if candidate is None:
        return NO_CURVE
    b = representation(candidate, kind, limits, least_q)
    if len(b) < 2 or len(real) < 2:
        return NO_CURVE
    return float(nearest_distances(real, b).mean())


def evolve(f: Callable[[np.ndarray], float], low: np.ndarray, high: np.ndarray, seed: int = 1, per_parameter: int = 15, generations: int = 1000, mutation: float = 0.5, crossing: float = 0.7, tol: float = 1e-3) -> tuple[np.ndarray, float, int]:
    """(best, its error, generations): differential evolution from a Latin hypercube, then a local search that shrinks.

    Every generation each member is crossed with the best one moved by the difference of two others, and
    replaced if that is no worse. It ends when the errors' deviation is within tol of their mean.
    Parameters whose bounds are equal are fixed.
    """
    r = np.random.default_rng(seed)
    free = np.flatnonzero(high > low)
    if not len(free):
        return low.copy(), f(low), 0
    m, d = max(5, per_parameter * len(free)), len(free)
    span = (high - low)[free]
    strata = (np.array([r.permutation(m) for _ in range(d)]).T + r.random((m, d))) / m

    def whole(x: np.ndarray) -> np.ndarray:
        out = low.copy()
        out[free] = low[free] + x * span
        return out

    x = strata
    errors = np.array([f(whole(row)) for row in x])
    done = 0
    for done in range(1, generations + 1):
        best = x[np.argmin(errors)]
        others = np.array([r.choice(m - 1, 2, replace=False) for _ in range(m)])
        others += others >= np.arange(m)[:, None]
        trial = best + mutation * (x[others[:, 0]] - x[others[:, 1]])
        cross = r.random((m, d)) < crossing
        cross[np.arange(m), r.integers(d, size=m)] = True
        trial = np.where(cross, trial, x)
        outside = (trial < 0) | (trial > 1)
        trial[outside] = r.random(outside.sum())
        tried = np.array([f(whole(row)) for row in trial])
        better = tried <= errors
        x, errors = np.where(better[:, None], trial, x), np.where(better, tried, errors)
        if errors.std() <= tol * abs(errors.mean()):
            break
    best, error, step = x[np.argmin(errors)].copy(), errors.min(), 0.01
    while step > 1e-5:
        moved = False
        for i in range(d):
            for sign in (1, -1):
                trial = best.copy()
                trial[i] = np.clip(trial[i] + sign * step, 0, 1)
                e = f(whole(trial))
                if e < error:
                    best, error, moved = trial, e, True
        step = step if moved else step / 2
    return whole(best), float(error), done


def match_electrodes(
    cells: DataFrame,
    pe: list[tuple[float, float]],
    ne: list[tuple[float, float]],
    bounds: dict[str, tuple[float, float]],
    kind: str = "V-Q",
    limits: tuple[float, float] = (2.7, 4.2),
    n: int = 1001,
    least_q: float = 0.5,
    ne_2: list[tuple[float, float]] | None = None,
    seed: int = 1,
    **search,
) -> DataFrame:
    """cells (run_id, cycle_index, q, voltage) as run_id, cycle_index, lli, q_pe, q_ne (with ne_2: x_ne_2), error and generations.

    kind: V-Q, dQdV or dVdQ, in which curves are compared within the voltage limits on grids of n points.
    pe, ne, ne_2: reference curves by share of capacity. search: parameters of evolve. Points with a null are
    left out; a cell of fewer than two points within the limits has null parameters. Every cell's search has
    the same seed, so its result depends on nothing else.
    """
    if kind not in ("V-Q", "dQdV", "dVdQ"):
        raise ValueError(f"{kind!r} is not V-Q, dQdV or dVdQ")
    names = PARAMETERS + (("x_ne_2",) if ne_2 is not None else ())
    low, high = (np.array([bounds[p][i] for p in names], float) for i in (0, 1))
    plus, first = (np.array(sorted(c), float).T for c in (pe, ne))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blends: dict[float, np.ndarray] = {}

        def minus(share: float) -> np.ndarray:
            if ne_2 is None:
                return first
            key = round(share, 6)
            if key not in blends:
                if len(blends) > 2000:
                    blends.clear()
                blends[key] = np.array(sorted(blend(ne, ne_2, key, 201)), float).T
            return blends[key]

        for pdf in batches:
            rows = []
            for points in pdf["points"]:
                q, v = np.array(sorted((p["q"], p["voltage"]) for p in points), float).T
                real = _regridded(q, v, limits, n)
                if real is None:
                    rows.append((*[None] * len(names), None, 0))
                    continue
                seen = representation(real, kind, limits, least_q)
                best, error, done = evolve(lambda c: curve_error(seen, emulated(c, plus, minus, limits, n), kind, limits, least_q), low, high, seed, **search)
                rows.append((*best.tolist(), error, done))
            yield pd.concat([pdf[["cell"]], pd.DataFrame(rows, columns=[*names, "error", "generations"], index=pdf.index)], axis=1)

    cell = F.to_json(F.struct("run_id", "cycle_index"), {"ignoreNullFields": "false"}).alias("cell")
    points = cells.where("q is not null and voltage is not null").groupBy("run_id", "cycle_index").agg(F.collect_list(F.struct("q", "voltage")).alias("points"))
    schema = cells.select("run_id", "cycle_index").schema.simpleString()
    found = points.select(cell, "points").mapInPandas(fit, "cell string, " + ", ".join(f"{p} double" for p in names) + ", error double, generations int")
    return found.select(F.from_json("cell", schema).alias("c"), *names, "error", "generations").select("c.*", *names, "error", "generations")


def impose_degradation(curves: DataFrame, losses: DataFrame, keys: list[str], upper: float = 4.2, n: int = 1001) -> DataFrame:
    """Electrode curves after losses: keys, soc, pe, ne, on n even points from the first to the last state of charge of either electrode.

    curves: keys, soc, pe, ne (potentials on one grid, null where an electrode does not reach). losses: keys,
    lli (shifts the negative electrode), lam_pe and lam_ne (percent by which an electrode shrinks). The
    positive shrinks towards where the cell is nearest to its upper voltage, the negative towards where the cell's voltage
    is least; of equal points the one of lower soc counts. Between points potentials are linear, beyond an
    electrode's ends null. A curve without a point that both electrodes reach has none.
    """
    gap = F.col("pe") - F.col("ne")
    near = lambda off: F.min(F.when(gap.isNotNull(), F.struct(off.alias("off"), F.col("soc").alias("soc"))))["soc"]
    fixed = curves.groupBy(*keys).agg(near(F.abs(gap - upper)).alias("_top"), near(gap).alias("_bottom"))
    rows = curves.join(fixed.where("_top is not null").join(losses.select(*keys, "lli", "lam_pe", "lam_ne").hint("merge"), keys).hint("merge"), keys)
    shrunk = lambda share, at: F.col("soc") * (1 - F.col(share) / 100) + F.col(share) * F.col(at) / 100
    rows = rows.withColumns({"soc_pe": shrunk("lam_pe", "_top"), "soc_ne": shrunk("lam_ne", "_bottom") + F.col("lli")})
    ends = rows.groupBy(*keys).agg(F.least(F.min("soc_pe"), F.min("soc_ne")).alias("lo"), F.greatest(F.max("soc_pe"), F.max("soc_ne")).alias("hi"))
    # Points of both electrodes are one set of samples, in which each has nulls where the other has points: one pass for both.
    points = None
    for e, other in (("pe", "ne"), ("ne", "pe")):
        one = rows.where(F.col(e).isNotNull()).select(*keys, F.col("soc").alias("data_point"), F.col(f"soc_{e}").alias("soc"), e, F.lit(None).cast("double").alias(other))
        points = one if points is None else points.unionByName(one)
    last = points.groupBy(*keys).agg(*[F.max(F.when(F.col(e).isNotNull(), F.col("soc"))).alias(f"_last_{e}") for e in ("pe", "ne")])
    found = interpolate(points, ends, keys, "soc", ["pe", "ne"], n).join(last.hint("merge"), keys)
    return found.select(*keys, "soc", *[F.when(F.col("soc") <= F.col(f"_last_{e}"), F.col(e)).alias(e) for e in ("pe", "ne")])
