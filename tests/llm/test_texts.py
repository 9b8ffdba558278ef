"""Fill-in-middle and periodic runs against plain versions, with nulls, ties, long texts and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from voltlake.llm import queries
from voltlake.llm.middle import fill_in_middle, restored
from voltlake.llm.periodic import best_run, find_runs, periodic_runs, planted_order

EDGES = [
    (1, None),
    (2, ""),
    (3, "\n\n\n"),
    (4, "one line"),
    (5, "a\r\nb c\x85d\n\U0001f600é\n\tlast"),
    (6, "holds <S> mark\nx"),
    (7, "x\n" * 5000),
    (8, "ab " * 300000 + "\nend"),
    (None, "no id\nat all\n"),
    (9, "tie\ntie\n"),
    (9, "tie\ntie\n"),
]


def plain_middle(doc_id, text, seed=7, rate=100, suffix_first=50):
    """(n, form, prefix, middle characters, output)"""
    t, units = text or "", re.findall(r"[^\n]*\n|[^\n]+", text or "")
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not t or re.search("<P>|<S>|<M>", t) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, t
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < suffix_first else "psm"
    return len(units), form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


@pytest.mark.parametrize("rate, suffix_first", [(100, 50), (40, 0), (0, 50)])
def test_middle(spark, rate, suffix_first):
    rows = EDGES + [(i, "line %d\n" % i * (i % 7) + "tail" * (i % 2)) for i in range(20, 80)]
    docs = spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, cut string")
    out = fill_in_middle(docs, rate=rate, suffix_first=suffix_first)
    got = out.withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=str) == sorted(((d, *plain_middle(d, t, 7, rate, suffix_first)) for d, t in rows), key=str)
    assert all(r.back == (r.text or "") and r.cut == "own" for r in got)


def plain_runs(w, least_exp=4, least_len=6):
    """Every stretch of every period, from the definition."""
    out = []
    for q in range(1, len(w) // least_exp + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least_len, least_exp * q) and not any(all(w[k] == w[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def texts_with_runs(n, seed):
    r = random.Random(seed)
    for _ in range(n):
        w = [r.choice("abcd") for _ in range(r.randrange(12))]
        for _ in range(r.randrange(5)):
            unit = [r.choice("abc") for _ in range(r.randrange(1, 7))]
            w += (unit * 12)[: r.randrange(1, 6 * len(unit) + 2)] + [r.choice("abcde") for _ in range(r.randrange(4))]
        yield w


def test_find_runs():
    for least_exp, least_len in ((4, 6), (2, 2), (3, 10)):
        for w in [*texts_with_runs(150, 3), ["a"] * 40, list("ab") * 30, ((list("aab") * 5 + ["c"]) * 5)]:
            ids = np.unique(w, return_inverse=True)[1] if w else np.zeros(0, np.int64)
            assert find_runs(ids, least_exp, least_len) == plain_runs(w, least_exp, least_len)
            parts = [x for lo in range(1, 40, 3) for x in find_runs(ids, least_exp, least_len, (lo, lo + 3))]
            assert sorted(parts, key=lambda r: (r[0], r[2])) == plain_runs(w, least_exp, least_len)


def test_long_repetition_takes_few_comparisons():
    assert find_runs(np.zeros(1_000_000, np.int64)) == [(0, 1_000_000, 1)]
    w = np.tile(np.arange(1000), 300)
    assert find_runs(w) == [(0, 300_000, 1000)]


def plain_collapse(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    return n, runs, " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize("lags_a_task", [1 << 16, 3])
def test_periodic(spark, lags_a_task):
    r = random.Random(8)
    rows = [(i, r.choice((" ", "\n", " \t"))[0].join(w)) for i, w in enumerate(texts_with_runs(150, 9))]
    rows += [(1, None), (2, ""), (3, " \n"), (None, "x " * 9), (4, "tie " * 6), (4, "tie " * 6), (5, "a b   é é é é é é\x00")]
    docs = spark.createDataFrame([(*x, "own") for x in rows], "doc_id long, text string, runs string").withColumn("lo", F.lit("own"))
    out = periodic_runs(docs, order=planted_order, lags_a_task=lags_a_task).collect()
    got = sorted(((x.doc_id, x.n_words, [tuple(y) for y in x.runs], x.collapsed) for x in out), key=str)
    assert got == sorted(((d, *plain_collapse(d, t)) for d, t in rows), key=str)
    assert all(x.lo == "own" for x in out)
    assert periodic_runs(docs.limit(0)).count() == 0


def test_best_run(spark):
    runs = [[], [(0, 8, 2), (9, 12, 3), (30, 4, 1)], [(0, 9, 2), (5, 9, 2)], [(0, 10, 3), (1, 7, 2)]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(runs)], "i int, runs array<struct<start: long, length: long, period: long>>")
    got = [tuple(x.best) if x.best else None for x in df.withColumn("best", best_run(F.col("runs"))).orderBy("i").collect()]
    assert got == [None, (0, 8, 2), (0, 9, 2), (1, 7, 2)]


def test_periodic_query(spark, small_tables):
    docs = spark.read.parquet(f"{small_tables}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.QUERIES["op13_periodic_runs"](spark, small_tables).collect()}
    assert len(got) == len(docs)
    for d in sorted(docs, key=lambda d: len(d.text or ""))[:150]:
        n, runs, text = plain_collapse(d.doc_id, d.text)
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None,) * 3)
        listed = "".join("%d,%d,%d\n" % x for x in runs)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want = (len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(listed), sha(text))
        g = got[d.doc_id]
        assert (g.n_runs, g.start, g.length, g.period, g.exponent_milli, g.runs_sha256, g.collapsed_sha256) == want


def _ids(docs, **how):
    from voltlake.llm.pii import find_personal_data

    found = find_personal_data(docs, **how).select("doc_id", "spans").collect()
    return {(r.doc_id, s.start, s.end) for r in found for s in r.spans if s.kind == "id"}


def test_patterns_find_identifiers_that_are_held_back(spark):
    """With a tenth of the labelled runs as seeds, the graph finds at least nine tenths of the others, and nothing else."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    everything = _ids(docs, rounds=0)
    seeds, found = _ids(docs, rounds=0, seed_share=0.1), _ids(docs, seed_share=0.1)
    held_back = everything - seeds
    assert len(seeds) < 0.25 * len(everything) and len(held_back) > 100
    assert len(held_back & found) >= 0.9 * len(held_back) and len(found - everything) <= 0.02 * len(found)


def test_pattern_beside_other_shapes_is_not_trusted(spark):
    """A pattern that also stands before words, or before tokens unlike the known ones, finds nothing."""
    good = [(i, f"said one. secret is u{i}@mail.org so") for i in range(12)] + [(50, "said one. secret is v7@mail.org so"), (51, "said one. secret is abc7@localhost so")]
    mixed = [(100 + i, f"he wrote to w{i}@mail.org then") for i in range(6)] + [(150 + i, f"he wrote to {i} times") for i in range(8)] + [(170, "he wrote to q9@localhost then")]
    docs = spark.createDataFrame(good + mixed, "doc_id long, text string")
    assert _ids(docs) == {(51, 20, 34)} and _ids(docs.limit(0)) == set()


def test_long_tokens_take_linear_time(spark):
    import time

    from voltlake.llm.pii import find_personal_data

    took = []
    for n in (100_000, 400_000):
        texts = [(1, "a@b" + ".c" * n), (2, "x" * n + " 1"), (3, "k7=" + "ab1." * n), (4, "a7" * n + "." * 9 + "é"), (5, ("z9/" * n)[:n] + "=")]
        docs = spark.createDataFrame(texts, "doc_id long, text string")
        start = time.time()
        got = {r.doc_id: r.n_email for r in find_personal_data(docs, rounds=0).collect()}
        took.append(time.time() - start)
        assert got == {1: 1, 2: 0, 3: 0, 4: 0, 5: 0}
    assert took[1] < 8 * took[0] + 10


def test_prior_without_the_noise_of_small_hosts(spark):
    """10,000 hosts of one page each, one in twenty of which fails, and a large host of which three in ten do."""
    from voltlake.llm.rules import MOST_WEIGHT, host_rules, prior_weight

    good, bad = " ".join(f"w{i}" for i in range(60)), "too short"
    rows = [(i, f"h{i}", bad if i % 20 == 0 else good) for i in range(10_000)] + [(20_000 + i, "large", bad if i % 10 < 3 else good) for i in range(500)] + [(30_000 + i, "fair", bad if i % 20 == 0 else good) for i in range(500)]
    out = host_rules(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    assert {r.host for r in out.where("host_rejected").select("host").distinct().collect()} == {"large"}
    kept = out.where("kept").groupBy().count().first()[0]
    assert kept == sum(t == good and h != "large" for _, h, t in rows)
    # Rates of a known beta distribution: its weight is found again.
    r = np.random.default_rng(0)
    n = r.integers(1, 60, 20_000)
    x = r.binomial(n, r.beta(0.8, 7.2, len(n)))
    weight, spread = prior_weight(len(n), int(n.sum()), float((n * n).sum()), int(x.sum()), float((x * x / n).sum()))
    assert spread and 6.5 < weight < 9.5
    assert prior_weight(1, 10, 100.0, 3, 0.9) == (MOST_WEIGHT, False) and prior_weight(5, 50, 500.0, 0, 0.0) == (MOST_WEIGHT, False) and prior_weight(0, 0, 0.0, 0, 0.0) == (MOST_WEIGHT, False)
