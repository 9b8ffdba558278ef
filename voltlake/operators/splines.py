"""Interpolating splines of degree 2 and 3, a curve at a time, and what is computed with them.

A spline's coefficients depend on all points of its curve at once, so they are solved in numpy (a curve is one step of
one run, some thousand points): interpolate_spline takes one curve a group, voltage_differences all curves of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import SUMMARY, summary_columns


def _basis(t: np.ndarray, curve: np.ndarray, first: np.ndarray, at: np.ndarray, degree: int) -> np.ndarray:
    """For each point the values of the degree + 1 basis functions of its curve that are not 0 there. t: knots, a row a curve."""
    values = np.ones((len(at), 1))
    for d in range(1, degree + 1):
        nxt = np.zeros((len(at), d + 1))
        for i in range(d):
            lo, hi = t[curve, first - d + 1 + i], t[curve, first + 1 + i]
            part = values[:, i] / (hi - lo)
            nxt[:, i] += part * (hi - at)
            nxt[:, i + 1] += part * (at - lo)
        values = nxt
    return values


def splines(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, at: np.ndarray, wanted: np.ndarray, degree: int = 3) -> np.ndarray:
    """The splines through curves that stand one after another in (x, y), ``sizes`` points each, x strictly ascending in a curve,
    at the points ``at``, ``wanted`` for each curve; their end pieces go on outside of x.

    Knots are the points themselves but for the second and the last but one (degree 3), or the middles
    between them but for the outer two (degree 2). NaN with fewer than degree + 1 points. All curves are solved at
    once, point by point; a shorter curve goes on as ones on the diagonal.
    """
    out = np.full(len(at), np.nan)
    have = np.flatnonzero(sizes > degree)
    if not len(have):
        return out
    number = np.full(len(sizes), -1)
    number[have] = np.arange(len(have))
    of_x, of_at = number[np.repeat(np.arange(len(sizes)), sizes)], number[np.repeat(np.arange(len(sizes)), wanted)]
    x, y, of_x = x[of_x >= 0].astype(float), y[of_x >= 0].astype(float), of_x[of_x >= 0]
    asked = of_at >= 0
    at, of_at = at[asked].astype(float), of_at[asked]
    sizes, wanted = sizes[have], wanted[have]
    m, n = len(have), int(sizes.max())
    x0, at0 = np.cumsum(sizes) - sizes, np.cumsum(wanted) - wanted
    t = np.full((m, n + degree + 1), np.inf)
    first_x, first_at = np.empty(len(x), int), np.empty(len(at), int)
    for k, (lo, size, la, w) in enumerate(zip(x0, sizes, at0, wanted)):
        own = x[lo : lo + size]
        t[k, : degree + 1], t[k, size : size + degree + 1] = own[0], own[-1]
        t[k, degree + 1 : size] = own[2:-2] if degree == 3 else (own[2:-1] + own[1:-2]) / 2
        knots = t[k, : size + degree + 1]
        for first, points, start in ((first_x, own, lo), (first_at, at[la : la + w], la)):
            first[start : start + len(points)] = np.clip(np.searchsorted(knots, points, side="right") - 1, degree, size - 1)
    # The matrices are banded and totally positive: elimination needs no exchange of rows.
    row = np.arange(len(x)) - x0[of_x]
    band, c = np.zeros((m, n, 2 * degree + 1)), np.zeros((m, n))
    band[:, :, degree] = 1.0
    band[of_x, row, degree] = 0.0
    values = _basis(t, of_x, first_x, x, degree)
    for k in range(degree + 1):
        band[of_x, row, first_x - degree + k - row + degree] = values[:, k]
    c[of_x, row] = y
    with np.errstate(invalid="ignore"):
        for i in range(n):
            for j in range(i + 1, min(i + degree + 1, n)):
                f = band[:, j, i - j + degree] / band[:, i, degree]
                band[:, j, i - j + degree : i - j + 2 * degree + 1] -= f[:, None] * band[:, i, degree:]
                c[:, j] -= np.where(f != 0, f * c[:, i], 0.0)
        for i in range(n - 1, -1, -1):
            for k in range(min(degree, n - 1 - i), 0, -1):
                f = band[:, i, degree + k]
                c[:, i] -= np.where(f != 0, f * c[:, i + k], 0.0)
            c[:, i] /= band[:, i, degree]
    values = _basis(t, of_at, first_at, at, degree)
    out[asked] = (values * c[of_at[:, None], first_at[:, None] - degree + np.arange(degree + 1)]).sum(1)
    return out


def spline(x: np.ndarray, y: np.ndarray, at: np.ndarray, degree: int = 3) -> np.ndarray:
    """splines of one curve."""
    return splines(x, y, np.array([len(x)]), at, np.array([len(at)]), degree)


def _clean(x: pd.Series, y: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Points in ascending x; of equal x the last counts, nulls are left out."""
    have = x.notna() & y.notna()
    points = pd.DataFrame({"x": x[have].astype(float), "y": y[have].astype(float)}).drop_duplicates("x", keep="last").sort_values("x")
    return points["x"].to_numpy(), points["y"].to_numpy()


def interpolate_spline(knots: DataFrame, keys: list[str], x: str, y: str, n: int, degree: int = 3) -> DataFrame:
    """knots (keys, x, y) at n even steps over the range of x, by splines: keys, x, y. Null with fewer than degree + 1 knots."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in knots.select(*keys).schema) + f", `{x}` double, `{y}` double"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        px, py = _clean(pdf[x], pdf[y])
        at = np.linspace(px[0], px[-1], n) if len(px) else np.zeros(0)
        return pd.DataFrame({k: pdf[k].iloc[0] for k in keys} | {x: at, y: spline(px, py, at, degree)}, columns=[*keys, x, y])

    return knots.select(*keys, x, y).groupBy(*keys).applyInPandas(one, schema)


def voltage_differences(rows: DataFrame, position: int, most_capacity: float = 8.0) -> DataFrame:
    """How much lower the voltage of a later pulse test is than the first one's, at equal discharged capacity, in the
    discharges between states of charge: run_id, window, d.

    rows: hppc.windows_of with discharge_capacity. The first test's voltage is a cubic spline over capacity;
    samples of the later test strictly inside of its range count. Samples of the first test from
    most_capacity on (a final discharge of the same number) are left out.
    """
    q = F.col("discharge_capacity")
    rows = rows.where((F.col("role") == "hppc_discharge_to_next_soc") & q.isNotNull() & F.col("position").isin(0, position))
    rows = rows.where((F.col("position") != 0) | (q < most_capacity)).select("run_id", "window", "position", "test_time", q.alias("q"), F.col("voltage").alias("v"))

    def found(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of whole groups, one after another: key, d."""
        key = pdf["key"].to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(key))))
        q, v, p = pdf["q"].to_numpy(float), pdf["v"].to_numpy(float), pdf["position"].to_numpy()
        have = ~np.isnan(q) & ~np.isnan(v)
        first = np.flatnonzero((p == 0) & have)
        # In ascending q; of equal ones the last counts.
        first = first[np.lexsort((q[first], group[first]))]
        g, x = group[first], q[first]
        last = np.append((g[1:] != g[:-1]) | (x[1:] != x[:-1]), True)[: len(first)]
        g, x, y = g[last], x[last], v[first][last]
        sizes = np.bincount(g, minlength=len(starts))
        low, high = np.full(len(starts), np.inf), np.full(len(starts), -np.inf)
        np.minimum.at(low, g, x)
        np.maximum.at(high, g, x)
        later = np.flatnonzero((p == position) & have & (q > low[group]) & (q < high[group]))
        d = splines(x, y, sizes, q[later], np.bincount(group[later], minlength=len(starts))) - v[later]
        fine = np.isfinite(d)
        ends = np.cumsum(np.bincount(group[later][fine], minlength=len(starts)))
        return pd.DataFrame({"key": key[starts], "d": np.split(d[fine], ends[:-1])})

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Batches cut where a group ends; its rows stand together."""
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat((held, pdf), ignore_index=True)
            key = pdf["key"].to_numpy()
            other = np.flatnonzero(key != key[-1]) if len(key) else key
            cut = other[-1] + 1 if len(other) else 0
            held = pdf.iloc[cut:]
            if cut:
                yield found(pdf.iloc[:cut])
        if held is not None and len(held):
            yield found(held)

    # Rows come in the order of their curves, in batches of bounded size, and all curves of a batch are solved at once.
    schema = rows.select("run_id", "window").schema.simpleString()
    keyed = rows.select(F.to_json(F.struct("run_id", "window"), {"ignoreNullFields": "false"}).alias("key"), "position", "test_time", "q", "v")
    sorted_ = keyed.repartition("key").sortWithinPartitions("key", F.asc_nulls_last("test_time")).select("key", "position", "q", "v")
    return sorted_.mapInPandas(whole, "key string, d array<double>").select(F.from_json("key", schema).alias("k"), F.explode("d").alias("d")).select("k.*", "d")


def v_diff(rows: DataFrame, position: int, digits: int | None = None, most_capacity: float = 8.0) -> DataFrame:
    """Statistics of voltage_differences for each run and window: run_id, window, <statistic>_v_diff. A window whose variance is above 1 is left out."""
    found = voltage_differences(rows, position, most_capacity).groupBy("run_id", "window").agg(F.var_pop("d").alias("_v"), *summary_columns(F.col("d"), "v", False, digits)).where("_v <= 1").drop("_v")
    return found.select("run_id", "window", *[F.col(f"v_{s}").alias(f"{s}_v_diff") for s in SUMMARY])
