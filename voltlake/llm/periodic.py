"""Periodic runs of words: maximal stretches that repeat with a period, found at all lags.

The word ids of a text are compared with themselves shifted by every lag up to n / least_exp; true
stretches that are long enough are runs. A stretch of m >= (least_exp - 1) * q equal words at lag q covers
as many neighbouring points of a grid of spacing q, so a lag is first compared on that grid only, many
lags in one array; only around points that pass are all words compared. This leaves out no run and takes
n / 1 + n / 2 + ... = O(n log n) comparisons instead of n * n / least_exp. Long texts are dealt out to
tasks by ranges of lags.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved
from .textvec import chunks, word_hashes

RUNS = "array<struct<start: long, length: long, period: long>>"
#: Grid points compared at once.
CELLS = 1 << 16


def _smallest(w: np.ndarray, start: int, end: int, q: int) -> int:
    """The smallest divisor of q that is a period of w[start:end], which has period q and at least 2 * q words."""
    left, p = q, 2
    while left > 1:
        if p * p > left:
            p = left
        while left % p == 0:
            left //= p
            while q % p == 0 and (w[start : end - q // p] == w[start + q // p : end]).all():
                q //= p
        p += 1
    return q


def find_runs(w: np.ndarray, least_exp: int = 4, least_len: int = 6, lags: tuple[int, int] | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of w whose period is in range(*lags) (default: all), by start, then period."""
    n = len(w)
    lo, hi = lags or (1, n)
    hi = min(hi, n // least_exp + 1)
    found: list[tuple[int, int, int]] = []
    known: dict[int, list[tuple[int, int]]] = {}  # stretches by their smallest period: lags that it divides need no second look there
    while lo < hi:
        points = (n - 1) // lo + 1
        q = np.arange(lo, min(hi, 2 * lo, lo + max(1, CELLS // points)))
        lo += len(q)
        at = q[:, None] * np.arange(points)
        grid = w[np.minimum(at, n - 1)]
        same = (grid[:, 1:] == grid[:, :-1]) & (at[:, 1:] < n)
        hit = same.copy()
        for i in range(1, least_exp - 1):
            hit[:, :-i] &= same[:, i:]
            hit[:, -i:] = False
        for i in np.flatnonzero(hit.any(axis=1)):
            lag = int(q[i])
            x = np.flatnonzero(hit[i])
            new = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1] + 1)))
            seen = [k for p, k in known.items() if lag % p == 0]
            for a, b in zip(x[new], x[np.append(new[1:], len(x)) - 1] + least_exp - 2):
                first, last = int(a) * lag, int(b) * lag
                if any((j := bisect_right(k, (first, n))) and last + lag < k[j - 1][1] for k in seen):
                    continue
                left, right = max(0, first - lag + 1), min(n - lag, last + lag)
                differs = np.flatnonzero(w[left:right] != w[left + lag : right + lag]) + left
                bounds = np.concatenate(([left - 1], differs, [right]))
                for j in np.flatnonzero(np.diff(bounds) - 1 >= max((least_exp - 1) * lag, least_len - lag, 1)):
                    s, e = int(bounds[j]) + 1, int(bounds[j + 1]) + lag
                    p = _smallest(w, s, e, lag)
                    if p == lag:
                        found.append((s, e - s, lag))
                    insort(known.setdefault(p, []), (s, e))
    return sorted(set(found), key=lambda r: (r[0], r[2]))


def planted_order(doc_id: str | None, n: int) -> np.ndarray | None:
    """The order of the words of a text into which a repetition is planted: one in ten by crc32(doc_id); None: as they are."""
    if doc_id is None or not n or (h := zlib.crc32(doc_id.encode())) % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def _scan(texts: list[str], ids: list, order: Callable | None, lags: list[tuple[int, int] | None], least_exp: int, least_len: int):
    """The words (bytes) of each text in order, and its runs."""
    for start, end in chunks(texts):
        raw = [t.encode() if t else b"" for t in texts[start:end]]
        h, doc, _ = word_hashes(raw)
        n = np.bincount(doc, minlength=len(raw))
        at = np.cumsum(n) - n
        for i, r in enumerate(raw):
            words, w = r.split(), h[at[i] : at[i] + n[i]]  # bytes are split at the same six characters
            take = order(ids[start + i], len(words)) if order else None
            if take is not None:
                words, w = [words[j] for j in take], w[take]
            runs = find_runs(w, least_exp, least_len, lags[start + i])
            if runs:  # hashes may collide, numbers of different words don't
                number: dict[bytes, int] = {}
                runs = find_runs(np.array([number.setdefault(x, len(number)) for x in words]), least_exp, least_len, lags[start + i])
            yield words, runs


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words without those that any run contains after its first period."""
    if runs:
        edge = np.zeros(len(words) + 1, np.int64)
        for s, m, p in runs:
            edge[s + p] += 1
            edge[s + m] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
    return b" ".join(words).decode()


def periodic_runs(docs: DataFrame, least_exp: int = 4, least_len: int = 6, order: Callable | None = None, lags_a_task: int = 1 << 16) -> DataFrame:
    """Adds to docs (doc_id, text): n_words, runs (array of start, length, period by start and period) and collapsed.

    A run is a stretch of words ([^\\x20\\x09-\\x0D]+) of smallest period q, of at least least_exp * q and
    least_len words, that no neighbouring word extends. collapsed: the words, joined by one space, without
    those that any run contains after its first q words. order: from doc_id (as text) and number of words
    to the order in which words are taken (None: as they are). Texts that may have more than lags_a_task
    lags are dealt out to tasks by ranges of so many; the result is the same.

    Null or empty text, or text without words: 0 words, no runs, an empty collapsed text. Rows of null or equal
    doc_id are rows of their own. Own columns of these three names are replaced. An empty table gives no rows.
    """
    own = ("n_words", "runs", "collapsed")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    rows = rows.select("doc", F.col("doc")["doc_id"].cast("string").alias("key"), F.coalesce(F.col("doc")["text"].cast("string"), F.lit("")).alias("text"))
    # A text of m characters has (m + 1) / 2 words at most.
    most_lags = F.floor((F.length("text") + 1) / (2 * least_exp)).cast("long")

    @F.pandas_udf(f"n_words long, runs {RUNS}, collapsed string")
    def whole(key: pd.Series, text: pd.Series) -> pd.DataFrame:
        out = [(len(w), r, _collapsed(w, r)) for w, r in _scan(text.tolist(), key.tolist(), order, [None] * len(text), least_exp, least_len)]
        return pd.DataFrame(out, columns=list(own))

    @F.pandas_udf(RUNS)
    def part(key: pd.Series, text: pd.Series, lo: pd.Series) -> pd.Series:
        lags = [(int(x), int(x) + lags_a_task) for x in lo]
        return pd.Series([r for _, r in _scan(text.tolist(), key.tolist(), order, lags, least_exp, least_len)])

    @F.pandas_udf("n_words long, collapsed string")
    def rest(key: pd.Series, text: pd.Series, runs: pd.Series) -> pd.DataFrame:
        out = []
        for k, t, found in zip(key, text, runs):
            words = t.encode().split()
            take = order(k, len(words)) if order else None
            words = words if take is None else [words[j] for j in take]
            out.append((len(words), _collapsed(words, [(r["start"], r["length"], r["period"]) for r in found])))
        return pd.DataFrame(out, columns=["n_words", "collapsed"])

    def result(df: DataFrame, n: Column, runs: Column, text: Column) -> DataFrame:
        return df.select(*[F.col("doc")[c].alias(c) for c in docs.columns if c not in own], n.alias("n_words"), runs.alias("runs"), text.alias("collapsed"))

    short = rows.where(most_lags <= lags_a_task).withColumn("found", whole("key", "text"))
    long = saved(rows.where(most_lags > lags_a_task).withColumn("row", F.monotonically_increasing_id()), "long-texts")
    dealt = long.select("row", "key", "text", F.explode(F.sequence(F.lit(1), most_lags, F.lit(lags_a_task))).alias("lo"))
    dealt = dealt.repartition("row", "lo").select("row", F.explode(part("key", "text", "lo")).alias("run"))
    merged = dealt.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("run.start", "run.period", "run.length"))).alias("runs"))
    merged = merged.select("row", F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))).alias("runs"))
    long = long.join(merged, "row", "left").withColumn("runs", F.coalesce("runs", F.array().cast(RUNS)))
    long = long.withColumn("found", rest("key", "text", "runs"))
    found = F.col("found")
    return result(short, found["n_words"], found["runs"], found["collapsed"]).unionByName(result(long, found["n_words"], F.col("runs"), found["collapsed"]))


def best_run(runs: Column) -> Column:
    """The run of greatest length / period (compared exactly; ties: smallest start, then period); null if there is none."""
    better = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    return F.when(F.size(runs) > 0, F.reduce(F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0))), runs[0], lambda a, b: F.when(better(a, b), b).otherwise(a)))
