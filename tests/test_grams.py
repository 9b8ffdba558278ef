"""Models of several targets from Gram matrices, against numpy over all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from voltlake.operators import grams, matrix, models
from voltlake.plans import learn


def data(n=90, seed=0, scale=1.0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 6)) * [1, 10, 0.1, 3, 1, 1] + [0, 1e4 * scale, 5, -2, 0, 0]
    x[:, 5] = 7.0  # a column without spread
    w = np.array([[1.0, -2.0], [0.3, 0.1], [5.0, 0.0], [0, 0], [0, 0], [0, 0]])
    y = x @ w + r.normal(size=(n, 2)) * 0.3 + [3, -1]
    return x, y


def frame(spark, x, y):
    rows = [(f"r{i}", *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "run_id string, " + ", ".join(f"`x{i}` double" for i in range(x.shape[1])) + ", `t.a` double, tb double").repartition(3)


X, T = [f"x{i}" for i in range(6)], ["t.a", "tb"]


def objective(x, y, w, b, alpha, ratio):
    return ((y - x @ w - b) ** 2).sum() / (2 * len(x)) + alpha * (ratio * np.linalg.norm(w, axis=1).sum() + (1 - ratio) / 2 * (w**2).sum())


def slow_fit(x, y, alpha, ratio, steps=60_000):
    """Proximal gradient steps over the rows themselves."""
    xc, yc = x - x.mean(0), y - y.mean(0)
    rate = len(x) / np.linalg.eigvalsh(xc.T @ xc)[-1]
    w = np.zeros((x.shape[1], y.shape[1]))
    for _ in range(steps):
        v = w - rate * (xc.T @ (xc @ w - yc) / len(x) + alpha * (1 - ratio) * w)
        norm = np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        new = np.maximum(0, 1 - rate * alpha * ratio / norm) * v
        if np.abs(new - w).max() < 1e-12:
            break
        w = new
    return w, y.mean(0) - x.mean(0) @ w


def standard(x):
    s = x.std(0)
    return (x - x.mean(0)) / np.where(s > 1e-9, s, 1.0)


def test_gram_cells(spark):
    x, y = data(40)
    df = frame(spark, x, y).withColumn("fold", F.length("run_id") % 2).withColumn("x1", F.when(F.col("run_id") != "r7", F.col("x1")))
    got = {(r.fold, r.i, r.j): r.total for r in grams.gram_cells(df, [*X, *T], "fold").collect()}
    for fold in (0, 1):
        own = [i for i in range(40) if len(f"r{i}") % 2 == fold and i != 7]
        z = np.concatenate((np.ones((len(own), 1)), x[own], y[own]), axis=1)
        assert all(np.isclose(got[fold, i, j], (z[:, i + 1] * z[:, j + 1]).sum()) for i in range(-1, 8) for j in range(i, 8))


@pytest.mark.parametrize("alpha, ratio", [(0.05, 0.5), (0.5, 1.0), (0.01, 0.0)])
def test_group_lasso(alpha, ratio):
    x, y = data(60, 2)
    x = standard(x)
    g = grams.Gram((z := np.concatenate((np.ones((60, 1)), x, y), axis=1)).T @ z, 6)
    ((w, b),) = grams.path(g, [alpha], ratio)
    w2, b2 = slow_fit(x, y, alpha, ratio)
    assert np.allclose(w, w2, atol=1e-6) and np.allclose(b, b2, atol=1e-6)
    assert objective(x, y, w, b, alpha, ratio) <= objective(x, y, w2, b2, alpha, ratio) + 1e-9
    assert np.allclose(g.squares(w, b), ((y - x @ w - b) ** 2).sum(0))


def test_train_targets(spark):
    x, y = data(80, 4)
    df = frame(spark, x, y)
    alphas, ratios = [1.0, 0.1, 0.01], [0.5, 1.0]
    model, errors = grams.train_targets(df, X, T, alphas, ratios, n_folds=4, seed=3)
    fold = {r.run_id: r.fold for r in matrix.folds(df, 4, 3).collect()}
    f, z = np.array([fold[f"r{i}"] for i in range(80)]), standard(x)
    # The same choice over the rows themselves.
    best = None
    for ratio in ratios:
        for a in alphas:
            off = []
            for k in range(4):
                w, b = slow_fit(z[f != k], y[f != k], a, ratio)
                off.append(((y - z @ w - b)[f == k] ** 2).mean())
            if best is None or np.mean(off) < best[0] - 1e-12:
                best = (np.mean(off), a, ratio)
    assert (model.alpha, model.ratio) == best[1:]
    w, b = slow_fit(z, y, model.alpha, model.ratio)
    assert np.allclose(model.coefficients, w, atol=1e-5) and errors["t.a"]["r2"] > 0.9
    got = {r.run_id: (r["prediction::t.a"], r["prediction::tb"]) for r in model.predict(df).collect()}
    assert np.allclose([got[f"r{i}"] for i in range(80)], z @ w + b, atol=1e-4)
    # A feature is used for all targets or for none.
    assert all((np.array(row) == 0).all() or (np.array(row) != 0).all() for row in model.coefficients)
    with pytest.raises(ValueError, match="missing"):
        model.predict(df.drop("x2"))
    with pytest.raises(ValueError, match="too few"):
        grams.train_targets(df.limit(1), X, T)


def test_large_means_lose_nothing(spark):
    x, y = data(50, 5, scale=1e4)
    model, errors = grams.train_targets(frame(spark, x, y), X, T, [0.001], [1.0], n_folds=3)
    w, _ = slow_fit(standard(x), y, 0.001, 1.0)
    assert np.allclose(model.coefficients, w, atol=1e-4) and errors["tb"]["rmse"] < 1.0


def test_one_target_as_the_other_models(spark):
    """Spark's elastic net, the same objective for one target."""
    x, y = data(70, 6)
    df = frame(spark, x, y)
    ours, _ = grams.train_targets(df, X[:5], ["tb"], [0.05], [0.5], n_folds=3)
    model, names, _ = models.train_linear(df, X[:5], "tb", "elastic", [0.05], [0.5], 3)
    a = {r.run_id: r["prediction::tb"] for r in ours.predict(df).collect()}
    b = {r.run_id: r.prediction for r in models.predict_linear(model, names, df).collect()}
    # Spark divides by the deviation of n - 1 rows, and scales the label.
    assert np.corrcoef([a[k] for k in a], [b[k] for k in a])[0, 1] > 0.999


def test_from_matrices(spark, tmp_path):
    x, y = data(60, 7)
    df = frame(spark, x, y)
    place = lambda name: str(tmp_path / name)
    df.select("run_id", *[F.col(c).alias(f"{c}::f::ab12") for c in X[:5]]).write.parquet(place("x"))
    df.select("run_id", F.col("`t.a`").alias("ta::g::cd34"), F.col("tb").alias("tb::g::cd34")).write.parquet(place("y"))
    errors = learn.train(spark, place("x"), place("y"), place("m"), ["ta::g", "tb::g"], alphas=[0.01], ratios=[0.9], n_folds=3)
    assert set(errors) == {"ta::g", "tb::g"} and errors["tb::g"]["r2"] > 0.9
    got = {(r.run_id, r.target): r.prediction for r in learn.predict(spark, place("x"), place("m"), place("p")).collect()}
    assert len(got) == 120 and np.corrcoef([got[f"r{i}", "tb::g"] for i in range(60)], y[:, 1])[0, 1] > 0.95
    with pytest.raises(ValueError, match="one target"):
        learn.train(spark, place("x"), place("y"), place("m"), ["ta::g", "tb::g"], kind="ridge")
