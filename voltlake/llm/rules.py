"""Quality rules with verdicts by host.

Documents fail rules on their own text. Failures are counted by host, the host's rate of each rule is
shrunk towards an empirical beta prior (its mean that of all hosts, its weight from their spread beyond
chance), so that a host of few documents is not judged by chance. A host whose shrunk rate stands out from that prior is rejected, and the verdict
is joined back to its documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, saved, small

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
RULES = ("short", "repetitive", "symbols")


def repeat_words(words: list) -> int:
    """Words covered by 3-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    known: dict = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=n)
    if len(known) == n:
        return 0
    k = len(known)
    pair = ids[:-1] * k + ids[1:]
    if k > 1 << 20:
        pair, k = np.unique(pair, return_inverse=True)[1], n
    _, which, counts = np.unique(pair[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
    twice = counts[which] > 1
    covered = np.zeros(n, dtype=bool)
    for i in range(3):
        covered[i : n - 2 + i] |= twice
    return int(covered.sum())


def text_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words)


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = pd.DataFrame([text_counts(t) for t in pdf["text"]], columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"], index=pdf.index)
        yield pd.concat([pdf[["row", "doc_id", "host"]], found.astype("int64")], axis=1)


#: A prior counts as at least and at most so many documents: 2 are those of a uniform one.
LEAST_WEIGHT, MOST_WEIGHT = 2.0, 100.0


def prior_weight(hosts: int, docs: int, squares: float, fails: int, squared_fails: float) -> tuple[float, bool]:
    """The documents that a beta prior of the hosts' rates counts as, and whether rates differ at all.

    squares: the sum of n^2 over hosts; squared_fails: that of (failures of a host)^2 / n. Hosts are
    weighed by their documents, and what rates of n documents differ by chance is taken off the spread, so
    hosts of one page, whose rates are 0 or 1, do not pass for hosts that differ.
    """
    p = fails / docs if docs else 0.0
    between = squared_fails - docs * p * p
    if hosts < 2 or not 0 < p < 1 or between <= 1e-9 * docs:
        return MOST_WEIGHT, False
    free = docs - squares / docs - (hosts - 1)
    share = (between - p * (1 - p) * (hosts - 1)) / (p * (1 - p) * free) if free > 0 else 0.0
    return (min(max(1 / share - 1, LEAST_WEIGHT), MOST_WEIGHT) if share > 0 else MOST_WEIGHT), True


def host_rules(docs: DataFrame, host: str = "source", least_words: int = 50, most_repeated: int = 50, most_symbols: int = 50, limit: float = 0.5, deviations: float = 3.0, salts: int = 16) -> DataFrame:
    """Counts and verdicts for docs (doc_id, text and the column named by ``host``).

    A document is short below least_words words, repetitive if over most_repeated per cent of its words
    lie in repeated 3-word windows, and heavy in symbols if it has over most_symbols of them per 100
    words. base_failed: short or repetitive. A host is rejected if its shrunk rate of any rule is over
    limit, or more than ``deviations`` standard deviations of the prior above the prior's mean.

    Returns a row per document: doc_id, host, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, host_rejected and kept.

    Null text counts as no words. Documents of null host form one host; a null doc_id is returned as null.
    With a single host, or hosts whose rates are all equal, the prior has no spread and limit alone
    decides. Texts of any length are read whole. Repeated rows count each. An empty table gives no rows;
    other columns are ignored. More rejected hosts than may be broadcast are joined in ``salts`` parts each.
    """
    # Ids as text: pandas would round integers beside a null.
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("string").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    counts = rows.mapInPandas(_counts, "row long, doc_id string, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    counts = saved(counts.withColumn("doc_id", F.col("doc_id").cast(kind)), "counts")
    fails = {
        "short": F.col("n_words") < least_words,
        "repetitive": 100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"),
        "symbols": 100 * F.col("n_symbols") > most_symbols * F.col("n_words"),
    }
    hosts = counts.groupBy("host").agg(F.count("*").alias("n"), *[F.count_if(fails[r]).alias(r) for r in RULES])
    n, x = F.col("n"), F.col
    sums = hosts.agg(F.count("*").alias("k"), F.sum(n).alias("all"), F.sum(n * n / F.lit(1.0)).alias("squares"), *[e.alias(f"{r}_{c}") for r in RULES for c, e in (("mean", F.avg(x(r) / n)), ("sum", F.sum(r)), ("square", F.sum(x(r) * x(r) / n)))])
    row, over = sums.first(), []
    for r in RULES:
        mean = row[f"{r}_mean"] or 0.0
        weight, spread = prior_weight(row["k"], row["all"] or 0, row["squares"] or 0.0, row[f"{r}_sum"] or 0, row[f"{r}_square"] or 0.0)
        most = min(limit, mean + deviations * math.sqrt(mean * (1 - mean) / (weight + 1))) if spread else limit
        over.append((F.col(r) + mean * weight) / (F.col("n") + weight) > most)
    bad = over[0]
    for x in over[1:]:
        bad = bad | x
    # Rejected hosts alone are joined back, by a null-safe text key.
    key = F.coalesce(F.concat(F.lit("="), F.col("host")), F.lit("null"))
    rejected = saved(hosts.where(bad).select(key.alias("_host"), F.lit(True).alias("_bad")), "rejected")
    n = rejected.count()
    if 128 * n > BROADCAST_BYTES:  # a host may hold a large share of all rows
        part, each = F.pmod(F.xxhash64("row"), F.lit(salts)), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
    else:
        part = each = F.lit(0).cast("long")
    return (
        counts.withColumn("_host", key)
        .withColumn("_part", part)
        .join(small(rejected.withColumn("_part", each), n, 128), ["_host", "_part"], "left")
        .withColumn("base_failed", fails["short"] | fails["repetitive"])
        .withColumn("host_rejected", F.coalesce("_bad", F.lit(False)))
        .withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
        .drop("_host", "_part", "_bad", "row")
    )
