"""Half-cell fits: how far a cell's electrodes have slipped and shrunk, by a search that Spark spreads over cells.

A full-cell curve is the positive electrode's potential minus the negative's, each over its own scaled and
shifted capacity. A cell's curve is one row; a task computes the errors of all candidates of a cell at
once, and draws a finer grid around the best few, round by round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARAMETERS = ("lli", "q_pe", "q_ne")


def potential(curve: list[tuple[float, float]], q: Column) -> Column:
    """Linear interpolation of a reference curve (capacity share, potential), null outside of it."""
    lo, hi, n = curve[0][0], curve[-1][0], len(curve)
    step = (hi - lo) / (n - 1)
    values = F.array(*[F.lit(float(v)) for _, v in curve])
    at = (q - lo) / step
    i = F.least(F.floor(at), F.lit(n - 2)).cast("int")
    left, right = F.get(values, i), F.get(values, i + 1)
    return F.when(q.between(lo, hi), left + (right - left) * (at - i))


def emulate(pe: list, ne: list, q: Column, lli: Column, q_pe: Column, q_ne: Column) -> Column:
    """Cell voltage at discharged-to-charged capacity q (Ah): the positive gives up what the negative takes, less the lost inventory."""
    return potential(pe, (q + lli) / q_pe) - potential(ne, q / q_ne)


def blend(first: list[tuple[float, float]], second: list[tuple[float, float]], share: float, n: int = 1001) -> list[tuple[float, float]]:
    """The reference curve of an electrode of two materials, the second holding ``share`` of it, on an even grid of 0 to 1.

    At each potential the shares of capacity are averaged; beyond a curve's end its last piece goes on. The
    average is a line between the potentials at which either curve bends, so its inverse is exact there.
    What lies within 0 to 1 is read off at n even steps, and stretched so that it ends at 1.
    """
    a, b = (np.array(sorted(c, key=lambda p: p[1]), float) for c in (first, second))
    bends = np.union1d(a[:, 1], b[:, 1])
    q = (1 - share) * _extended(bends, a[:, 1], a[:, 0]) + share * _extended(bends, b[:, 1], b[:, 0])
    order = np.argsort(q, kind="stable")
    at = np.linspace(max(q.min(), 0.0), min(q.max(), 1.0), n)
    return list(zip((at / at[-1]).tolist(), np.interp(at, q[order], bends[order]).tolist()))


def _extended(at: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    i = np.clip(np.searchsorted(x, at) - 1, 0, len(x) - 2)
    return y[i] + (at - x[i]) * (y[i + 1] - y[i]) / (x[i + 1] - x[i])


def halfcell_voltages(curves: DataFrame, keys: list[str], upper: float = 4.2, lower: float = 2.7) -> DataFrame:
    """Where the electrodes of each cell stand at the cell's upper and lower voltage.

    curves: keys, soc, pe, ne (aligned potentials, null where an electrode does not reach). Returns keys,
    <electrode>_<end>_voltage and _soc (percent of that electrode's own span), <electrode>_mass (its span),
    soc_upper, soc_lower and li_mass (the span of both). Of equally near points the one of lower soc counts.
    """
    gap, soc = F.col("pe") - F.col("ne"), F.col("soc")
    near = lambda v: F.min(F.when(gap.isNotNull(), F.struct(F.abs(gap - v).alias("off"), soc.alias("soc"), F.col("pe").alias("pe"), F.col("ne").alias("ne"))))
    spans = {e: (F.min(F.when(F.col(e).isNotNull(), soc)), F.max(F.when(F.col(e).isNotNull(), soc))) for e in ("pe", "ne")}
    found = curves.groupBy(*keys).agg(
        near(upper).alias("upper"),
        near(lower).alias("lower"),
        (F.max(F.when(gap.isNotNull(), soc)) - F.min(F.when(gap.isNotNull(), soc))).alias("li_mass"),
        *[s.alias(f"{e}_{i}") for e, ends in spans.items() for i, s in enumerate(ends)],
    )
    out = []
    for e in ("pe", "ne"):
        lo, span = F.col(f"{e}_0"), F.col(f"{e}_1") - F.col(f"{e}_0")
        for end in ("upper", "lower"):
            out += [F.col(end)[e].alias(f"{e}_{end}_voltage"), (F.try_divide(F.col(end)["soc"] - lo, span) * 100).alias(f"{e}_{end}_soc")]
        out.append(span.alias(f"{e}_mass"))
    return found.select(*keys, *out, F.col("upper.soc").alias("soc_upper"), F.col("lower.soc").alias("soc_lower"), "li_mass")


def fit_electrodes(
    cells: DataFrame, pe: list[tuple[float, float]], ne: list[tuple[float, float]], bounds: dict[str, tuple[float, float]], rounds: int = 5, n: int = 9, keep: int = 3, ne_2: list[tuple[float, float]] | None = None
) -> DataFrame:
    """cells (run_id, cycle_index, q, voltage) as run_id, cycle_index, lli, q_pe, q_ne, error (root mean square, V).

    pe, ne: reference curves on even grids of 0 to 1. bounds: of each parameter. Each round spreads n values
    of each parameter around the ``keep`` best candidates of a cell and shrinks the spread to 0.35. A
    candidate that leaves points undefined pays 1 V for each. Points with a null are left out. With ne_2
    the negative electrode is a blend, and its share x_ne_2 (in bounds too) is fitted with the others.
    """
    names = PARAMETERS + (("x_ne_2",) if ne_2 is not None else ())
    low, high = (np.array([bounds[p][i] for p in names], float) for i in (0, 1))
    offsets = np.arange(n) / (n - 1) - 0.5
    curves = [np.array(c, float).T for c in (pe, ne)]

    def minus(q: np.ndarray, q_ne: np.ndarray, share: float | None) -> np.ndarray:
        curve = np.array(blend(ne, ne_2, share, 201)).T if share is not None else curves[1]
        return np.interp(q / q_ne[:, None], *curve, left=np.nan, right=np.nan)

    def errors(axes: list[np.ndarray], q: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Of all combinations of the axes' values. An electrode is read once for each of its own parameters' values."""
        lli, q_pe, q_ne = axes[:3]
        plus = np.interp((q + lli[:, None, None]) / q_pe[:, None], *curves[0], left=np.nan, right=np.nan)
        less = np.stack([minus(q, q_ne, share) for share in (axes[3] if ne_2 is not None else [None])], axis=1)
        off = plus[:, :, None, None] - less
        off -= v
        off *= off
        off[np.isnan(off)] = 1.0
        return np.sqrt(off.mean(axis=-1)).ravel()

    def combinations(axes: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        places = np.unravel_index(at, [len(x) for x in axes])
        return np.stack([x[i] for x, i in zip(axes, places)], axis=1)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for points in pdf["points"]:
                q, v = np.array([(p["q"], p["voltage"]) for p in points]).T
                best, spread = ((low + high) / 2)[None, :], high - low
                off = errors([*best.T], q, v)
                for _ in range(rounds):
                    tried, found = [best], [off]
                    for centre in best:
                        axes = [np.unique(np.clip(c + offsets * s, lo, hi)) for c, s, lo, hi in zip(centre, spread, low, high)]
                        own = errors(axes, q, v)
                        # Candidates that are equally good as the last of the best stay in; no two of one centre are the same.
                        at = np.flatnonzero(own <= np.partition(own, min(keep, len(own)) - 1)[min(keep, len(own)) - 1])
                        tried.append(combinations(axes, at))
                        found.append(own[at])
                    candidates, first = np.unique(np.concatenate(tried), axis=0, return_index=True)
                    off = np.concatenate(found)[first]
                    order = np.argsort(off, kind="stable")[:keep]
                    best, off, spread = candidates[order], off[order], spread * 0.35
                rows.append((*best[0], off[0]))
            yield pd.concat([pdf[["cell"]], pd.DataFrame(rows, columns=[*names, "error"], index=pdf.index)], axis=1)

    cell = F.to_json(F.struct("run_id", "cycle_index"), {"ignoreNullFields": "false"}).alias("cell")
    points = cells.where("q is not null and voltage is not null").groupBy("run_id", "cycle_index").agg(F.collect_list(F.struct("q", "voltage")).alias("points"))
    schema = cells.select("run_id", "cycle_index").schema.simpleString()
    found = points.select(cell, "points").mapInPandas(fit, "cell string, " + ", ".join(f"{p} double" for p in names) + ", error double")
    return found.select(F.from_json("cell", schema).alias("c"), *names, "error").select("c.*", *names, "error")
