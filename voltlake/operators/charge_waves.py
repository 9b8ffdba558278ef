"""Fast-charge waveforms: smooth charging currents that take as long as given steps, for all parameter rows of a table at once.

A task makes the waves of all rows of a batch as arrays: rates over an even grid of states of charge, and one
bisection in which every wave's inner rates are shifted until its smooth form ends with its steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points of the grid of states of charge. Fixed value.
POINTS = 1000
#: Waves computed at once in a task.
TOGETHER = 256


def monotone_slopes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes at the knots of every row (waves x knots) that keep monotone runs monotone."""
    h, s = np.diff(x), np.diff(y) / np.diff(x)
    d = np.zeros_like(y)
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = 2 * h[:, 1:] + h[:, :-1], h[:, 1:] + 2 * h[:, :-1]
        inner = (a + b) / (a / s[:, :-1] + b / s[:, 1:])
    d[:, 1:-1] = np.where(s[:, :-1] * s[:, 1:] > 0, inner, 0.0)

    def end(ha: np.ndarray, sa: np.ndarray, hb: np.ndarray, sb: np.ndarray) -> np.ndarray:
        e = ((2 * ha + hb) * sa - ha * sb) / (ha + hb)
        e = np.where(np.sign(e) != np.sign(sa), 0.0, e)
        return np.where((np.sign(sa) != np.sign(sb)) & (np.abs(e) > 3 * np.abs(sa)), 3 * sa, e)

    d[:, 0] = end(h[:, 0], s[:, 0], h[:, 1], s[:, 1])
    d[:, -1] = end(h[:, -1], s[:, -1], h[:, -2], s[:, -2])
    return d


def monotone_values(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The monotone cubic through the knots of every row at that row's places; 0 outside."""
    d = monotone_slopes(x, y)
    i = np.clip((at[:, :, None] >= x[:, None, :]).sum(axis=2) - 1, 0, x.shape[1] - 2)
    left, right = np.take_along_axis(x, i, 1), np.take_along_axis(x, i + 1, 1)
    g = right - left
    t = (at - left) / g
    y0, y1, d0, d1 = (np.take_along_axis(v, j, 1) for v, j in ((y, i), (y, i + 1), (d, i), (d, i + 1)))
    out = (1 + 2 * t) * (1 - t) ** 2 * y0 + t * (1 - t) ** 2 * g * d0 + t**2 * (3 - 2 * t) * y1 + t**2 * (t - 1) * g * d1
    return np.where((at < x[:, :1]) | (at > x[:, -1:]), 0.0, out)


def _half(x: np.ndarray) -> np.ndarray:
    """0 below 0, 1 above, a half at 0."""
    return np.heaviside(x, 0.5)


class Waves:
    """Waves of equally many steps: rates and mesh (waves x steps + 1), final, soc_initial, soc_final, lowest, highest (waves)."""

    def __init__(self, rates: np.ndarray, mesh: np.ndarray, final: np.ndarray, start: np.ndarray, end: np.ndarray, lowest: np.ndarray, highest: np.ndarray):
        self.rates, self.mesh, self.final, self.end = rates, mesh, final[:, None], end[:, None]
        self.start, self.lowest, self.highest = start[:, None], lowest[:, None], highest[:, None]
        self.soc = np.linspace(start, end, POINTS, axis=1)

    def stepwise(self) -> np.ndarray:
        """The rate at each state of charge, constant between the mesh's points and half of each side's on them."""
        out = self.final * _half(self.soc - self.mesh[:, -1:]) * _half(self.end - self.soc)
        for i in range(self.mesh.shape[1] - 1):
            out += self.rates[:, i : i + 1] * _half(self.soc - self.mesh[:, i : i + 1]) * _half(self.mesh[:, i + 1 : i + 2] - self.soc)
        return out

    def smooth(self, offset: np.ndarray) -> np.ndarray:
        """The rate at each state of charge through the middle of each step, all but the first and last shifted by offset."""
        rates = self.rates.copy()
        rates[:, 1:-1] += offset[:, None]
        middle = np.concatenate(((self.mesh[:, :-1] + self.mesh[:, 1:]) / 2, self.mesh[:, -1:]), axis=1)
        x = np.concatenate((self.start, middle, self.end * 1.01), axis=1)
        first = rates[:, :1]
        knots = lambda low: np.clip(np.concatenate((low, rates, rates[:, -1:]), axis=1), self.lowest, self.highest)
        # The wave starts as far above its first rate as it would be below it where the first step ends.
        over = 2 * first - monotone_values(x, knots(first), self.mesh[:, 1:2])
        return monotone_values(x, knots(np.minimum(self.highest, np.maximum(over, first))), self.soc)

    def seconds(self, rates: np.ndarray) -> np.ndarray:
        """The time at which each state of charge is reached; infinite after a rate of 0."""
        with np.errstate(divide="ignore"):
            return np.cumsum(np.gradient(self.soc, axis=1) / rates, axis=1) * 3600

    def offsets(self, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
        """The offset of each wave at which its smooth form takes as long as its steps, and by how many seconds it misses.

        More rate is less time, so the offset lies between those that clip all rates at either limit.
        """
        want = self.seconds(self.stepwise())[:, -1]
        span = (self.highest - self.lowest)[:, 0] + np.abs(self.rates).max(axis=1)
        low, high = -span, span
        for _ in range(rounds):
            middle = (low + high) / 2
            slow = self.seconds(self.smooth(middle))[:, -1] > want
            low, high = np.where(slow, middle, low), np.where(slow, high, middle)
        found = (low + high) / 2
        return found, self.seconds(self.smooth(found))[:, -1] - want


def _rows(ids: list, waves: Waves) -> Iterator[tuple]:
    offset, off = waves.offsets()
    steps, smooth = waves.stepwise(), waves.smooth(offset)
    t_steps, t_smooth = waves.seconds(steps), waves.seconds(smooth)
    for k, wave in enumerate(ids):
        ends = [np.round(t[k, -1]) if np.isfinite(t[k, -1]) else -1.0 for t in (t_smooth, t_steps)]
        same = bool(ends[0] == ends[1] and ends[0] > 0)
        at = np.arange(int(ends[0])) if same else np.zeros(0)
        yield wave, same, float(offset[k]), float(off[k]) if np.isfinite(off[k]) else None, np.interp(at, t_smooth[k], smooth[k]).tolist(), np.interp(at, t_steps[k], steps[k]).tolist()


def charge_waves(parameters: DataFrame) -> DataFrame:
    """Waves of parameters (wave_id, rates, mesh, final_rate, soc_initial, soc_final, min_rate, max_rate): wave_id, matched, offset, miss, smooth, stepwise.

    rates and mesh have the same length, three or more: rates[i] is the rate from mesh[i] to mesh[i + 1], the last one
    that of the smooth wave at its end. smooth and stepwise are the rates at every second. matched: do both forms take the same
    number of seconds (else both are empty); offset: by how much the inner rates were shifted, miss: by how
    many seconds the smooth form is still longer. Rows with a null, with lengths that differ or a mesh that
    does not ascend are not matched.
    """
    names = ["final_rate", "soc_initial", "soc_final", "min_rate", "max_rate"]
    rows = parameters.select(F.to_json(F.struct("wave_id"), {"ignoreNullFields": "false"}).alias("wave"), *[F.col(c).cast("array<double>").alias(c) for c in ("rates", "mesh")], *[F.col(c).cast("double").alias(c) for c in names])

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["wave", "matched", "offset", "miss", "smooth", "stepwise"]
        for pdf in batches:
            groups: dict[int, list] = {}
            bad = []
            for r in pdf.itertuples(index=False):
                mesh, rates = (np.array(v, float) if v is not None else np.zeros(0) for v in (r.mesh, r.rates))
                numbers = [getattr(r, c) for c in names]
                good = len(mesh) == len(rates) >= 3 and (np.diff(mesh) > 0).all() and np.isfinite(rates).all() and np.isfinite(numbers).all() and mesh[0] + mesh[1] > 2 * r.soc_initial and mesh[-1] < 1.01 * r.soc_final
                (groups.setdefault(len(mesh), []) if good else bad).append((r.wave, rates, mesh, numbers))
            if bad:
                yield pd.DataFrame([(b[0], False, None, None, [], []) for b in bad], columns=columns)
            for own in groups.values():
                for i in range(0, len(own), TOGETHER):
                    ids, rates, mesh, numbers = zip(*own[i : i + TOGETHER])
                    yield pd.DataFrame(list(_rows(list(ids), Waves(np.array(rates), np.array(mesh), *np.array(numbers).T))), columns=columns)

    found = rows.mapInPandas(make, "wave string, matched boolean, offset double, miss double, smooth array<double>, stepwise array<double>")
    schema = parameters.select("wave_id").schema.simpleString()
    return found.select(F.from_json("wave", schema)["wave_id"].alias("wave_id"), "matched", "offset", "miss", "smooth", "stepwise")


def seconds_of(waves: DataFrame, form: str = "smooth") -> DataFrame:
    """The rates of matched waves by second: wave_id, time, rate; what waveform.waveform_steps writes for a tester."""
    return waves.where("matched").select("wave_id", F.posexplode(form).alias("time", "rate"))
