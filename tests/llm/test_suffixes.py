"""Repeated byte strings against a plain count of all substrings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from voltlake.llm import queries
from voltlake.llm.suffixes import _blocks, drop_repeated_strings


def plain(texts, least):
    """Spans and kept bytes of each text."""
    raw = [(t or "").encode() for t in texts]
    count = Counter(r[i : i + least] for r in raw for i in range(len(r) - least + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - least + 1):
            if count[r[i : i + least]] > 1:
                gone[i : i + least] = True
        edge = np.flatnonzero(np.diff(np.concatenate(([False], gone)).astype(int)))
        out.append(([tuple(x) for x in edge.reshape(-1, 2).tolist()], bytes(b for b, g in zip(r, gone) if not g)))
    return out


def check(spark, rows, least, **how):
    docs = spark.createDataFrame([(i, t, "own") for i, t in enumerate(rows)], "doc_id long, text string, spans string").withColumnRenamed("spans", "key")
    got = drop_repeated_strings(docs, least, **how).orderBy("doc_id").collect()
    want = plain(rows, least)
    assert [([(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in got] == want
    assert all(r.key == "own" and r.n_bytes == len((t or "").encode()) for r, t in zip(got, rows))
    return want


def copied_texts(n, seed, letters, longest):
    """Texts that share passages of all lengths, with edits, at all places."""
    r = random.Random(seed)
    some = lambda m: "".join(r.choice(letters) for _ in range(m))
    passages = [some(r.randrange(10, longest)) for _ in range(6)]
    out = []
    for _ in range(n):
        t = some(r.randrange(longest))
        for _ in range(r.randrange(4)):
            p = r.choice(passages)
            a, b = sorted((r.randrange(len(p) + 1), r.randrange(len(p) + 1)))
            t += p[a:b] + some(r.randrange(30))
        out.append(t)
    return out


@pytest.mark.parametrize("blocks", [(4,), (7, 3), ()])
def test_short_threshold(spark, blocks):
    texts = copied_texts(70, 1, "abé \n", 120) + ["a" * 90, "a" * 30, "ab" * 50, None, "", "short", "x" * 23, "y" * 24]
    want = check(spark, texts + texts[:3], 24, anchor=8, blocks=blocks)
    assert sum(bool(s) for s, _ in want) > 20


def test_production_threshold(spark):
    texts = copied_texts(60, 2, "abcdefgh é\U0001f600", 900)
    passage = "".join(random.Random(3).choice("klmnopq ") for _ in range(260))
    texts += [f"{i}" * 40 + passage[i : i + 199 + i % 3] + f"{i}z" * 30 for i in range(20)]
    want = check(spark, texts, 200)
    assert sum(bool(s) for s, _ in want) > 10




def test_long_text(spark):
    r = random.Random(5)
    text = "".join(r.choice("abcdefghij") for _ in range(600_000))
    # A string across the pieces in which texts are ranked, one far behind, and one with itself.
    texts = [text, "#" * 50 + text[262_000:262_400] + "!" * 50, text[:10] + "?" + text[500_100:500_299], text[99:100] + text[300_000:300_250] * 2]
    want = check(spark, texts, 200)
    assert [s for s, _ in want][0] == [(262_000, 262_400), (300_000, 300_250)] and not want[2][0]


def test_empty_and_bad_parameters(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert drop_repeated_strings(docs).count() == 0
    for bad in ({"anchor": 4}, {"anchor": 200}, {"blocks": (1,)}, {"blocks": (199,)}):
        with pytest.raises(ValueError):
            drop_repeated_strings(docs, **bad)


def test_blocks_hold_every_window_once():
    texts = [t.encode() for t in copied_texts(40, 6, "ab", 400)]
    seen = Counter()
    for b in _blocks(texts, 40, 16, True):
        assert (b["anchor"] >= b["at"] + b["n"] - 1).all() and (b["anchor"] + 16 <= b["at"] + 40).all()
        for row, at, n in zip(b["row"], b["at"], b["n"]):
            seen.update((row, p) for p in range(at, at + n))
    assert seen == Counter((i, p) for i, t in enumerate(texts) for p in range(len(t) - 39))


def test_query(spark, small_tables):
    docs = pd.read_parquet(f"{small_tables}/documents.parquet").sort_values("doc_id")
    got = queries.QUERIES["op11_repeated_strings"](spark, small_tables).toPandas().sort_values("doc_id")
    want = plain(docs.text, 200)
    assert got.n_spans.tolist() == [len(s) for s, _ in want] and got.n_removed.tolist() == [sum(b - a for a, b in s) for s, _ in want]
    assert got.kept_sha256.tolist() == [hashlib.sha256(k).hexdigest() for _, k in want] and (got.n_removed > 0).sum() > 10
