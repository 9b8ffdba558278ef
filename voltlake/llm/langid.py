"""Language identification by error-correcting output codes.

Every language has a codeword; for each bit a binary logistic classifier over hashed character 1- to
3-grams says which half of the languages a text belongs to. Decoding takes the codeword of least loss,
each bit weighted by how well it was learnt; a small lead over the second codeword marks the text as
ambiguous.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMS = 4096


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def features(text: str) -> np.ndarray | None:
    """Unit vector of root counts of hashed letter n-grams of the whole text; None without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _letters()[codes]
    if not letter.any():
        return None
    c = np.where(letter, codes, 32).astype(np.uint32)
    keep = np.concatenate(([True], ~((c[1:] == 32) & (c[:-1] == 32))))
    c = np.concatenate(([32], c[keep], [32])).astype(np.uint32)
    two = c[:-1] * np.uint32(0x9E3779B1) + c[1:]
    three = two[:-1] * np.uint32(0x85EBCA6B) + c[2:]
    counts = np.zeros(DIMS, dtype=np.int64)
    for salt, h in enumerate((c * np.uint32(0x27D4EB2F), two, three)):
        h = (h ^ np.uint32(salt * 0x5BD1E995 & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35)
        counts += np.bincount((h >> np.uint32(20)).astype(np.int64), minlength=DIMS)
    x = np.sqrt(counts.astype(np.float32))
    return x / np.sqrt(float(counts.sum()))


def codewords(k: int) -> np.ndarray:
    """k rows of +-1: all splits of up to five languages in two; beyond, a fixed random code of good distance."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 5:
        bits = [b for b in itertools.product((1, -1), repeat=k - 1) if -1 in b]
        return np.array([(1, *b) for b in bits]).T
    length, rng, best = int(np.ceil(10 * np.log2(k))), np.random.default_rng(7), None
    for _ in range(50):
        m = rng.choice((-1, 1), size=(k, length))
        m = m[:, np.abs(m.sum(axis=0)) < k]
        d = min(int((m[i] != m[j]).sum()) for i in range(k) for j in range(i))
        if best is None or d > best[0]:
            best = (d, m)
    return best[1]


def fit(x: np.ndarray, y: np.ndarray, steps: int = 80, rate: float = 0.05) -> dict:
    """Bit classifiers for rows x and their language names y (Adam on the logistic loss of all bits at once)."""
    langs = sorted(set(y))
    code = codewords(len(langs))
    target = code[np.searchsorted(langs, y)]
    w, b = np.zeros((DIMS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    m, v = [0.0, 0.0], [0.0, 0.0]
    # Languages count alike however many rows they have.
    names, counts = np.unique(y, return_counts=True)
    row_weight = (len(y) / len(names) / counts)[np.searchsorted(names, y)][:, None]
    for t in range(1, steps + 1):
        f = x @ w + b
        g = (-target / (1 + np.exp(target * f)) * row_weight / max(len(x), 1)).astype(np.float32)
        for i, (p, grad) in enumerate(((w, x.T @ g + 1e-5 * w), (b, g.sum(axis=0)))):
            m[i], v[i] = 0.9 * m[i] + 0.1 * grad, 0.999 * v[i] + 0.001 * grad**2
            p -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8) * 10
    right = ((x @ w + b) * target > 0).mean(axis=0) if len(x) else np.ones(code.shape[1])
    return {"langs": langs, "code": code, "w": w, "b": b, "bit_weight": np.maximum(2 * right - 1, 0.01)}


def decode(model: dict, x: np.ndarray, ambiguous_below: float) -> tuple[str, float, bool]:
    f = x @ model["w"] + model["b"]
    loss = (np.log1p(np.exp(-np.clip(model["code"] * f, -30, 30))) * model["bit_weight"]).sum(axis=1)
    p = np.exp(loss.min() - loss)
    p /= p.sum()
    order = np.argsort(-p, kind="stable")
    lead = p[order[0]] - (p[order[1]] if len(p) > 1 else 0.0)
    return str(model["langs"][order[0]]), float(p[order[0]]), bool(lead < ambiguous_below)


def equal_share(sizes: list[int], total: int) -> float:
    """What each of the groups may have at most so that all have ``total`` together."""
    share = float(total)
    for i, n in enumerate(sorted(sizes)):
        share = total / (len(sizes) - i)
        if n >= share:
            break
        total -= n
    else:
        share = float(max(sizes, default=0))
    return share


def identify_language(docs: DataFrame, labelled: DataFrame, max_train_rows: int = 4000, ambiguous_below: float = 0.2) -> DataFrame:
    """Predicts the language of docs (doc_id, text), learning from labelled (text, lang).

    About ``max_train_rows`` labelled texts (never more than twice that) are learnt from: the same number
    of each language, or all it has, chosen by a hash, equal ones once, and at least one of each. Counts of
    languages cover all labelled rows, predictions all docs and whole texts.

    Returns a row per document: doc_id, lang_pred, score (0 to 1) and ambiguous. Null text, or text
    without a letter: 'und', 0.0, true; so are all rows when nothing is labelled. Labelled rows of null
    text or lang, or without letters, are not learnt from. A null doc_id is returned as null. A text of any
    length is read whole. Repeated rows are treated alike. An empty table gives no rows; other columns are
    ignored.
    """
    spark = docs.sparkSession
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    # Texts of hash 0 to 2^30 - 1, equal ones once; the smallest hash of a language is always in.
    rows = rows.where(F.col("text").rlike(r"\p{L}")).withColumn("h", F.pmod(F.xxhash64("text"), F.lit(1 << 30)))
    sizes = rows.groupBy("lang", F.xxhash64("text").alias("t")).agg(F.min("h").alias("h")).groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least")).collect()
    quota = equal_share([r["n"] for r in sizes], max_train_rows)
    upto = [(r["lang"], max(r["least"], int(min(1.0, quota / r["n"]) * (1 << 30)) - 1)) for r in sizes]
    upto = spark.createDataFrame(upto, "lang string, upto long")
    rows = rows.join(F.broadcast(upto), "lang").where(F.col("h") <= F.col("upto")).select("text", "lang").distinct()

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [features(t) for t in pdf["text"]]
            yield pd.DataFrame({"lang": pdf["lang"], "x": [m.astype("<f2").tobytes() if m is not None else None for m in made]}).dropna()

    sample = rows.mapInPandas(vectors, "lang string, x binary").limit(2 * max_train_rows).toPandas()
    model = None
    if len(sample):
        sample = sample.sort_values(["lang", "x"])
        x = np.frombuffer(b"".join(sample["x"]), dtype="<f2").reshape(-1, DIMS).astype(np.float32)
        model = fit(x, sample["lang"].to_numpy(dtype=str))
    shared = spark.sparkContext.broadcast(model)
    base = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))  # ids as text: pandas would round them beside a null

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                x = features(text) if text and shared.value else None
                out.append(("und", 0.0, True) if x is None else decode(shared.value, x, ambiguous_below))
            found = pd.DataFrame(out, columns=["lang_pred", "score", "ambiguous"])
            yield found.assign(doc_id=pdf["doc_id"].to_numpy())[["doc_id", "lang_pred", "score", "ambiguous"]]

    found = base.mapInPandas(predict, "doc_id string, lang_pred string, score double, ambiguous boolean")
    return found.withColumn("doc_id", F.col("doc_id").cast(dict(docs.dtypes)["doc_id"]))
