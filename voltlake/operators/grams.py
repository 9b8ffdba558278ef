"""Linear models of several targets at once, from Gram matrices that Spark sums up in one pass.

Rows enter only through X'X, X'Y and Y'Y of each fold, of which each task makes its own and an aggregate the
sum; a training set is all folds less one. What reaches the driver is of the size of (features + targets)^2
for each fold, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .matrix import folds


def gram_cells(rows: DataFrame, columns: list[str], by: str) -> DataFrame:
    """by, i, j, total: for every value of ``by``, the sum of columns[i] * columns[j] over its rows (i <= j; column -1 is 1).

    Rows with a null in a column are left out. Sums are made in each task before they are shuffled.
    """
    width = len(columns) + 1
    upper = np.triu_indices(width)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for pdf in batches:
            x = np.concatenate((np.ones((len(pdf), 1)), pdf.iloc[:, 1:].to_numpy(float)), axis=1)
            for value, at in pdf.groupby(by, dropna=False).indices.items():
                sums[value] = sums.get(value, 0.0) + x[at].T @ x[at]
        for value, g in sums.items():
            yield pd.DataFrame({by: value, "i": upper[0] - 1, "j": upper[1] - 1, "total": g[upper]})

    kind = dict(rows.dtypes)[by]
    whole = rows.select(by, *[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).dropna(subset=[f"c{i}" for i in range(len(columns))])
    cells = whole.mapInPandas(partial, f"{by} {kind}, i int, j int, total double")
    return cells.groupBy(by, "i", "j").agg(F.sum("total").alias("total"))


@dataclass
class Gram:
    """Sums over rows with a column of ones first, then the features, then the targets."""

    g: np.ndarray
    n_features: int

    def __sub__(self, other: Gram) -> Gram:
        return Gram(self.g - other.g, self.n_features)

    @property
    def n(self) -> float:
        return self.g[0, 0]

    def means(self) -> np.ndarray:
        return self.g[0, 1:] / self.n

    def centred(self) -> tuple[np.ndarray, np.ndarray]:
        """X'X and X'Y of the columns less their means."""
        m, p = self.means(), self.n_features
        c = self.g[1:, 1:] - self.n * np.outer(m, m)
        return c[:p, :p], c[:p, p:]

    def squares(self, w: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The sum of squared errors of each target for predictions X w + b."""
        full = np.concatenate((b[None, :], w, -np.eye(len(b))))
        return np.einsum("it,ij,jt->t", full, self.g, full)


def group_lasso(xx: np.ndarray, xy: np.ndarray, n: float, alpha: float, ratio: float, start: np.ndarray | None = None, tol: float = 1e-8, max_iter: int = 5000) -> np.ndarray:
    """Coefficients w (features x targets) that minimise |Y - X w|^2 / 2n + alpha * (ratio * sum of row norms + (1 - ratio) / 2 * |w|^2).

    Block coordinate descent: a row of w, all targets of a feature, at a time. With one target it is the elastic net.
    """
    w = np.zeros_like(xy) if start is None else start.copy()
    size = np.diag(xx)
    for _ in range(max_iter):
        most = 0.0
        for j in np.flatnonzero(size > 1e-12 * size.max(initial=0.0)):
            r = xy[j] - xx[j] @ w + size[j] * w[j]
            norm = np.linalg.norm(r)
            new = np.zeros_like(r) if norm <= n * alpha * ratio else (1 - n * alpha * ratio / norm) * r / (size[j] + n * alpha * (1 - ratio))
            most = max(most, np.abs(new - w[j]).max())
            w[j] = new
        if most <= tol * max(1e-12, np.abs(w).max()):
            break
    return w


def path(gram: Gram, alphas: list[float], ratio: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """(w, b) for each of alphas (from large to small, each from the last one's solution)."""
    (xx, xy), m, p, w, out = gram.centred(), gram.means(), gram.n_features, None, []
    for a in alphas:
        w = group_lasso(xx, xy, gram.n, a, ratio, w)
        out.append((w, m[p:] - m[:p] @ w))
    return out


@dataclass
class TargetsModel:
    """A linear model of standardised features for several targets."""

    features: list[str]
    targets: list[str]
    means: list[float]
    scales: list[float]
    coefficients: list[list[float]]
    intercepts: list[float]
    alpha: float
    ratio: float

    def to_dict(self) -> dict:
        return asdict(self)

    def predict(self, matrix: DataFrame) -> DataFrame:
        """run_id and a column prediction::<target> for each target; null where a feature is null. A feature that the matrix lacks is an error."""
        missing = [c for c in self.features if c not in matrix.columns]
        if missing:
            raise ValueError(f"features are missing: {missing}")
        x = F.array(*[(F.col(f"`{c}`").cast("double") - m) / s for c, m, s in zip(self.features, self.means, self.scales)])
        rows = matrix.select("run_id", x.alias("_x"))

        def of(t: int):
            w = F.array(*[F.lit(float(row[t])) for row in self.coefficients])
            return F.aggregate(F.zip_with("_x", w, lambda a, b: a * b), F.lit(float(self.intercepts[t])), lambda a, v: a + v)

        return rows.select("run_id", *[of(t).alias(f"prediction::{name}") for t, name in enumerate(self.targets)])


def train_targets(
    matrix: DataFrame, features: list[str], targets: list[str], alphas: list[float] | None = None, ratios: list[float] | None = None, n_folds: int = 5, seed: int = 0, n_alphas: int = 100, eps: float = 1e-3
) -> tuple[TargetsModel, dict[str, dict[str, float]]]:
    """A cross-validated group-lasso (multi-task elastic net) model: (model, errors of each target on the training rows).

    A feature is used for all targets or for none. Rows without a target or feature are left out; at least
    two must be left. alphas: None for n_alphas from the least at which all coefficients are 0 down to eps
    times that. alpha and ratio are those of least mean squared error over folds, then targets; of equal
    ones the larger alpha of the earlier ratio. Folds come from a seeded hash of run_id.
    """
    if not targets or not features:
        raise ValueError("features and targets must be named")
    ratios = ratios or [0.1, 0.5, 0.7, 0.9, 0.95, 1.0]
    columns = [*features, *targets]
    rows = matrix.select("run_id", *[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).dropna()
    names = [f"c{i}" for i in range(len(columns))]
    moments = rows.agg(F.count("*").alias("n"), *[f(c).alias(f"{k}_{c}") for c in names for f, k in ((F.avg, "m"), (F.stddev_pop, "s"))]).first()
    if moments["n"] < max(2, n_folds):
        raise ValueError(f"{moments['n']} rows are too few")
    p = len(features)
    means = np.array([moments[f"m_{c}"] for c in names])
    scales = np.array([moments[f"s_{c}"] or 1.0 for c in names[:p]] + [1.0] * len(targets))
    # Sums are of values less their means, so that large ones cancel nothing; features are divided by their deviations.
    scaled = folds(rows, n_folds, seed).select("fold", *[((F.col(c) - F.lit(float(m))) / F.lit(float(s))).alias(c) for c, m, s in zip(names, means, scales)])
    width = len(columns) + 1
    parts = [np.zeros((width, width)) for _ in range(n_folds)]
    for r in gram_cells(scaled, names, "fold").collect():  # (features + targets)^2 / 2 cells a fold
        parts[r["fold"]][r["i"] + 1, r["j"] + 1] = parts[r["fold"]][r["j"] + 1, r["i"] + 1] = r["total"]
    parts = [Gram(g, p) for g in parts if g[0, 0] > 0]
    total = Gram(sum(x.g for x in parts), p)
    best = None
    for ratio in ratios:
        most = np.linalg.norm(total.centred()[1], axis=1).max() / (total.n * max(ratio, 1e-3))
        tried = sorted(alphas, reverse=True) if alphas else list(np.geomspace(max(most, 1e-12), max(most, 1e-12) * eps, n_alphas))
        errors = [[part.squares(w, b).mean() / part.n for w, b in path(total - part, tried, ratio)] for part in parts]
        mean = np.mean(errors, axis=0)
        k = int(np.argmin(mean))
        if best is None or mean[k] < best[0]:
            best = (mean[k], tried[: k + 1], ratio)
    _, tried, ratio = best
    w, b = path(total, tried, ratio)[-1]
    model = TargetsModel(list(features), list(targets), means[:p].tolist(), scales[:p].tolist(), w.tolist(), (b + means[p:]).tolist(), float(tried[-1]), float(ratio))
    rss, spread = total.squares(w, b), np.diag(total.g)[1 + p :] - total.n * total.means()[p:] ** 2
    errors = {t: {"rmse": float(np.sqrt(max(s, 0.0) / total.n)), "r2": float(1 - s / v) if v > 0 else float("nan")} for t, s, v in zip(targets, rss, spread)}
    return model, errors
