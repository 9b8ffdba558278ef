"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A score is w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j. The pairwise part is computed in linear
time from the identity 0.5 * sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS, BINS, RANK = 1024, 8, 8
_UPPER, _DIGIT, _OTHER = (re.compile(p) for p in ("[A-ZÀ-Þ]", "[0-9]", "[^\\w\\s]"))


def words_and_structure(text: str, n_chars: float | None) -> tuple[np.ndarray, list[float]]:
    """Unit vector of hashed words and the structure statistics and metadata of one whole text."""
    raw = text.encode()
    words = raw.split()
    counts = Counter(words)
    x = np.zeros(WORDS, np.float32)
    if words:
        where = np.fromiter((zlib.crc32(w) % WORDS for w in counts), dtype=np.int64, count=len(counts))
        x = np.sqrt(np.bincount(where, weights=np.fromiter(counts.values(), dtype=np.float64, count=len(counts)), minlength=WORDS)).astype(np.float32)
        x /= np.sqrt(len(words))
    n, chars = max(len(words), 1), max(len(text), 1)
    lines = text.split("\n")
    upper, digit, other = (sum(1 for _ in p.finditer(text)) / chars for p in (_UPPER, _DIGIT, _OTHER))
    return x, [
        float(np.log1p(len(words))),
        float(np.log1p(len(text) if n_chars is None or n_chars != n_chars else n_chars)),
        (chars - text.count(" ")) / n,
        upper,
        digit,
        other,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        len(set(lines)) / len(lines),
        float(np.log1p(len(text) / len(lines))),
        len(zlib.compress(raw, 1)) / max(len(raw), 1),
    ]


STATS = 11
SIZE = WORDS + STATS * (BINS + 1)


def encode(words: np.ndarray, stats: np.ndarray, scale: dict) -> np.ndarray:
    """Rows of the machine's input: words, standardised statistics, and their bins (edges learnt in training)."""
    z = np.clip((stats - scale["mean"]) / scale["std"], -5, 5) / 5
    bins = np.zeros((len(stats), STATS, BINS), np.float32)
    for j in range(STATS):
        at = np.searchsorted(scale["edges"][j], stats[:, j], side="right")
        bins[np.arange(len(stats)), j, at] = 1
    return np.hstack([words, z.astype(np.float32), bins.reshape(len(stats), -1)])


def score(model: dict, x: np.ndarray) -> np.ndarray:
    pairs = 0.5 * ((x @ model["v"]) ** 2 - (x**2) @ (model["v"] ** 2)).sum(axis=1)
    return 1 / (1 + np.exp(-np.clip(model["w0"] + x @ model["w"] + pairs, -30, 30)))


def fit(words: np.ndarray, stats: np.ndarray, y: np.ndarray, epochs: int = 30, batch: int = 128, rate: float = 0.02, decay: float = 1e-3) -> dict:
    """Minibatch Adam on the logistic loss."""
    scale = {"mean": stats.mean(axis=0), "std": stats.std(axis=0) + 1e-6, "edges": [np.unique(np.quantile(stats[:, j], np.arange(1, BINS) / BINS)) for j in range(STATS)]}
    x, rng = encode(words, stats, scale), np.random.default_rng(11)
    prior = np.clip(y.mean(), 0.01, 0.99)
    p = {"w0": np.array([np.log(prior / (1 - prior))], np.float32), "w": np.zeros(SIZE, np.float32), "v": rng.normal(0, 0.02, (SIZE, RANK)).astype(np.float32)}
    m, s, t = {k: 0.0 for k in p}, {k: 0.0 for k in p}, 0
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            xb, yb = x[order[at : at + batch]], y[order[at : at + batch]]
            e = ((score(p, xb) - yb) / len(xb)).astype(np.float32)
            xv = xb @ p["v"]
            grads = {"w0": e.sum(keepdims=True), "w": xb.T @ e + decay * p["w"] / 10, "v": xb.T @ (e[:, None] * xv) - ((xb**2).T @ e)[:, None] * p["v"] + decay * p["v"]}
            t += 1
            for k, g in grads.items():
                m[k], s[k] = 0.9 * m[k] + 0.1 * g, 0.999 * s[k] + 0.001 * g**2
                p[k] = (p[k] - step * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return p | {"scale": scale}


def _featurise(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    made = [words_and_structure(t, c) for t, c in zip(pdf["text"], pdf["n_chars"])]
    return np.array([m[0] for m in made], np.float32).reshape(-1, WORDS), np.array([m[1] for m in made], np.float64).reshape(-1, STATS)


def quality_scorer(docs: DataFrame, labels: DataFrame, max_train_rows: int = 6000):
    """A function (text, n_chars) -> score column, learnt from labels (doc_id, quality 0/1) of docs.

    About ``max_train_rows`` labels (chosen by a hash of doc_id, never more than twice that) are learnt
    from; they are few enough to be broadcast to their documents.
    """
    spark = docs.sparkSession
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("double").alias("quality"))
    share = max_train_rows / max(marks.count(), 1)
    if share < 1:
        marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    marks = marks.limit(2 * max_train_rows)
    rows = docs.select("doc_id", *inputs(docs)).join(F.broadcast(marks), "doc_id").select("text", "n_chars", "quality")

    def sampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words, stats = _featurise(pdf)
            yield pd.DataFrame({"quality": pdf["quality"], "x": [w.astype("<f2").tobytes() for w in words], "s": [r.astype("<f8").tobytes() for r in stats]})

    sample = rows.mapInPandas(sampled, "quality double, x binary, s binary").limit(2 * max_train_rows).toPandas().sort_values(["quality", "x", "s"])
    y = sample["quality"].to_numpy()
    model: dict | float = float(y[0]) if len(y) else 1.0
    if len(set(y)) > 1:
        words = np.frombuffer(b"".join(sample["x"]), dtype="<f2").reshape(-1, WORDS).astype(np.float32)
        model = fit(words, np.frombuffer(b"".join(sample["s"]), dtype="<f8").reshape(-1, STATS), y)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(text: pd.Series, n_chars: pd.Series) -> pd.Series:
        now, out = shared.value, []
        for at in range(0, len(text), 500):
            part = pd.DataFrame({"text": text.iloc[at : at + 500], "n_chars": n_chars.iloc[at : at + 500]})
            if isinstance(now, float):
                out.append(np.full(len(part), now))
            else:
                words, stats = _featurise(part)
                out.append(score(now, encode(words, stats, now["scale"])).astype(float))
        return pd.Series(np.concatenate(out) if out else [], dtype="float64")

    return scored


def inputs(docs: DataFrame) -> list[Column]:
    """The columns that a scorer takes, as text and n_chars."""
    chars = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return [F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), chars.alias("n_chars")]


def classify_quality(docs: DataFrame, labels: DataFrame, max_train_rows: int = 6000, threshold: float = 0.3) -> DataFrame:
    """Scores docs (doc_id, text, n_chars if there), learning from labels (doc_id, quality 0/1); see quality_scorer.

    Returns a row per document: doc_id, score (0 to 1, higher is likelier label 1) and predicted (1 if
    score >= threshold). Every whole text is scored.

    Null text counts as empty and is scored too; null n_chars is taken from the text. Labels of null
    quality or null doc_id are not learnt from; with none left, or one class alone, every score is that
    class's (1.0 if nothing is labelled). Several labels of one doc_id, or rows of one doc_id, are learnt
    from each; a null doc_id is returned as null and has no label. Texts of any length are read whole.
    Repeated rows are scored alike. An empty table gives no rows. Other columns are ignored.
    """
    scorer = quality_scorer(docs, labels, max_train_rows)
    scored = docs.select("doc_id", *inputs(docs)).select("doc_id", scorer("text", "n_chars").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
