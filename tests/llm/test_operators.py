"""Every operator against a brute-force version, an exact round trip or held-out accuracy."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from voltlake.llm import html, jaccard, linededup, lists, packing, queries, rules, textvec
from voltlake.llm.decontam import WuManber, _block_hashes, decontaminate, words_of
from voltlake.llm.langid import codewords, equal_share, identify_language
from voltlake.llm.pii import find_personal_data, joined_spans
from voltlake.llm.quality import score
from voltlake.llm.textvec import word_hashes


@pytest.fixture(scope="module")
def table(small_tables):
    return pd.read_parquet(f"{small_tables}/documents.parquet")


def near_copies(n=60, seed=5):
    """Texts with exact copies, edited copies of several strengths, shared passages, and short sets."""
    r = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    base = [" ".join(r.choice(words) for _ in range(r.randrange(3, 90))) for _ in range(8)]
    passage = " ".join(r.choice(words) for _ in range(40))
    out = []
    for i in range(n):
        w = r.choice(base).split()
        for _ in range(r.choice((0, 0, 1, 1, 2, 3, 6))):
            w[r.randrange(len(w))] = r.choice(words)
        if r.random() < 0.2:
            w += passage.split()
        out.append((i, " ".join(w) + r.choice(("", "", "\n" + passage[:60]))))
    return out


def test_pack_round_trip(spark, small_tables):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{small_tables}/documents.parquet").select("doc_id", "source", "text").where("doc_id < 120")
    extra = spark.createDataFrame([(1000, "x", "a <|endoftext|> b"), (1001, "x", "é  \U0001f600 don't  stop   ")], "doc_id long, source string, text string")
    docs = docs.unionByName(extra)
    pieces = packing.pack(docs, queries.tokenizer_path(), window=256, packet_tokens=64, rows_a_block=20, rounds_a_bin=4).toPandas()
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    for doc in docs.collect():
        own = pieces[pieces.doc_id == doc.doc_id].sort_values("start")
        ids = np.concatenate([np.frombuffer(x, "<u4") for x in own.ids])
        assert ids.tolist() == tokenizer.encode(doc.text, add_special_tokens=False).ids + [1]
        assert (own.start == own.length.cumsum() - own.length).all() and (own.doc_tokens == len(ids)).all()
    by = pieces.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (pieces.sort_values(["sequence_id", "offset"]).offset == by.length.cumsum() - pieces.sort_values(["sequence_id", "offset"]).length).all()
    sizes = by.length.sum()
    assert all(x == 256 or x & (x - 1) == 0 for x in sizes) and (sizes != 256).sum() <= 8


def test_pack_keeps_proportions(spark):
    rows = [(i, "ab"[i % 4 == 0], "word " * 50) for i in range(400)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, source string, text string"), queries.tokenizer_path(), 512, 64, {"a": 0.5, "b": 0.5}, rounds_a_bin=8).toPandas()
    share = pieces.assign(a=pieces.length * (pieces.source == "a")).groupby("sequence_id")[["a", "length"]].sum()
    half = share.iloc[: len(share) // 3]  # while both queues last
    assert ((half.a / half.length - 0.5).abs() < 0.3).all()
    total = half.sum()
    assert abs(total.a / total.length - 0.5) < 0.05


def sequential_round_robin(queues, quanta):
    """Deficit round-robin one packet at a time: queues of packets (row, start, length), in order of their names."""
    left = {k: list(v) for k, v in queues.items()}
    deficit, out = dict.fromkeys(left, 0.0), []
    while any(left.values()):
        for k in sorted(left):
            deficit[k] += quanta[k]
            while left[k] and left[k][0][2] <= deficit[k] + 1e-9:
                deficit[k] -= left[k][0][2]
                out.append(left[k].pop(0))
    return out


def test_pack_by_sequential_round_robin(spark):
    """The closed form serves the packets of every queue in the order in which a sequential scheduler does."""
    r = random.Random(6)
    rows = [(i, "abc"[i % 3], "word " * r.randrange(1, 60)) for i in range(90)]
    targets, window, packet = {"a": 0.5, "b": 0.25, "c": 0.25}, 256, 16
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3), queries.tokenizer_path(), window, packet, targets, rounds_a_bin=4, rows_a_block=7).toPandas()
    pieces = pieces.sort_values(["sequence_id", "offset"])
    order = {x: [d for d, q in zip(pieces.doc_id, pieces.source) if q == x] for x in "abc"}
    size = dict(zip(pieces.doc_id, pieces.doc_tokens))
    queues = {f"={x}": [(d, s, min(packet, size[d] - s)) for d in dict.fromkeys(order[x]) for s in range(0, size[d], packet)] for x in "abc"}
    want = sequential_round_robin(queues, {f"={k}": v * window for k, v in targets.items()})
    tokens = [(d, s + i) for d, s, n in want for i in range(n)]
    got = [(d, s + i) for d, s, n in zip(pieces.doc_id, pieces.start, pieces.length) for i in range(n)]
    assert got and got == tokens


PAGE = """<html><head><title>No</title><style>p{}</style></head><body class="page"><nav><a href=x>Menu</a></nav>
<div class="cookie-notice">We use cookies on this site and you should accept all of them now please.</div>
<main><h1>Big &amp; small</h1><p>The quick fox is on the <b>hill</b> and it was  seen
by the dogs of the village.</p><aside>See also the other article of the week, it is the best of them all.</aside>
<p>Short one.<p>A last paragraph that is long enough to be an article of its own, with words of the language.</p>
<section id="comments"><p>I am the first to comment here and this is what I think of it all.</p></section></main>
<footer>&copy; us</footer></body>"""


def test_html():
    assert html.main_text(PAGE) == (
        "Big & small\n\nThe quick fox is on the hill and it was seen by the dogs of the village.\n\nShort one.\n\n"
        "A last paragraph that is long enough to be an article of its own, with words of the language."
    )
    assert html.second_pass([None, True, None, None, False, None], False) == [True, True, True, False, False, False]
    links = "<div>" + "<a href=x>the news of the day and more</a> " * 6 + "</div><div>" + "it was the best of times and it was the worst of times " * 4 + "</div>"
    assert html.main_text(links).startswith("it was the best")
    assert html.main_text("<article><p>one two</p><script>if (a < b) {}</script>&lt;b&gt;") == "one two\n\n<b>"


def test_rules_by_brute_force(table):
    for text in [*table.text[:60], "a b c a b c a b c", "x y\n \nx y\nx y", "a b c"]:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(zip(words, words[1:], words[2:]))
        covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
        seen, dup = set(), 0
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        assert rules.text_counts(text) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))


def test_host_verdicts(spark):
    bad, good = "spam spam spam spam " * 30, " ".join(f"w{i}" for i in range(80))
    rows = [(i, "bad", bad if i % 10 else good) for i in range(100)] + [(1000 + i, f"h{i % 20}", good) for i in range(400)] + [(5000, "tiny", bad)]
    got = {r.doc_id: r for r in rules.host_rules(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert got[0].host_rejected and not got[0].base_failed and not got[0].kept
    assert got[1000].kept and got[5000].base_failed and not got[5000].host_rejected


def test_host_query_rejects_a_host(spark, tmp_path):
    """Of 20 hosts one fails far more often than the others, though less than half of the time; its good documents go."""
    short, good = "too short", " ".join(f"w{i}" for i in range(80))
    rows = [(h * 100 + i, f"h{h}", short if i % 100 < (30 if h == 7 else 3 + h % 3) else good) for h in range(20) for i in range(100)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op5_host_rules(spark, str(tmp_path)).collect()
    assert all(r.kept == (not r.base_failed and r.doc_id // 100 != 7) for r in got) and sum(not r.base_failed and not r.kept for r in got) == 70


def brute_hits(text, items, window=10):
    words, hit, found = words_of(text), set(), set()
    for item, t in items:
        w = words_of(t)
        m = min(len(w), window)
        pats = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if m else set()
        for i in range(len(words) - m + 1 if m else 0):
            if tuple(words[i : i + m]) in pats:
                hit |= set(range(i, i + m))
                found.add(item)
    return len(hit), sorted(found)


@pytest.mark.parametrize("chunk", [1, 1 << 20])
def test_decontaminate_by_brute_force(spark, chunk):
    r = random.Random(1)
    items = [(str(i), " ".join(r.choice("abcdef") for _ in range(r.choice((1, 2, 5, 9, 10, 11, 25))))) for i in range(12)]
    docs = [(i, " ".join(r.choice("abcdefgh") for _ in range(60)) + " " + r.choice(items)[1].upper()) for i in range(40)]
    got = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"), chunk_bytes=chunk).collect()
    for row in got:
        assert (row.n_hit, row["items"]) == brute_hits(dict(docs)[row.doc_id], items)


def test_wu_manber_skips():
    w = WuManber([("1", "a b c d e f g h i j k l"), ("2", "x y")])
    short, long = w.groups
    h = lambda t: long.shift[long.slot(_block_hashes(word_hashes([t])[0], 3))].tolist()
    assert (short.m, short.block, long.m, long.block) == (2, 2, 10, 3) and len(long.starts) == 3
    assert h("j k l") == [0] and h("a b c") == [7] and h("q r s") == [8]
    texts = [b"x x a b c d e f g h i j k y", b"", b"a b", b"x x y"]
    assert w.scan(texts, *word_hashes(texts)[:2]) == {0: ([(2, 12), (3, 13)], {"1"}), 3: ([(1, 3)], {"2"})}
    assert WuManber([]).scan(texts, *word_hashes(texts)[:2]) == {}


def test_wu_manber_tables_are_small():
    """About ten bytes for each byte of the benchmark."""
    import pickle

    r = random.Random(4)
    text = " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9))) for _ in range(50_000))
    assert len(pickle.dumps(WuManber([("1", text)]))) < 12 * len(text)


def shingles(text, k=5):
    w = [x.translate({i: i + 32 for i in range(65, 91)}) for x in re.findall(r"[^\x20\x09-\x0D]+", text)]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(docs):
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("boundary", [None, 0, 12, 10**6])
def test_near_duplicates_by_brute_force(spark, monkeypatch, boundary):
    docs = [(i - 5, t) for i, t in near_copies()]
    if boundary is not None:
        monkeypatch.setattr(jaccard, "choose_boundary", lambda sets: boundary)
    got = jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(docs)


def test_large_groups_by_brute_force(spark):
    """Groups of near copies, of which some are similar to few others or to none, and a passage that all share."""
    r = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    passage = " ".join(r.choice(words) for _ in range(60))
    docs = []
    for _ in range(3):
        base = [r.choice(words) for _ in range(120)]
        for _ in range(60):
            w = list(base)
            for _ in range(r.choice((0, 1, 2, 3, 4, 5, 6))):
                w[r.randrange(len(w))] = r.choice(words)
            docs.append((len(docs), " ".join(w)))
    docs += [(1000 + i, passage + " " + " ".join(r.choice(words) for _ in range(r.choice((5, 10, 15, 20))))) for i in range(60)]
    got = jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(6)).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute_components(docs)


def test_near_duplicates_of_odd_keys(spark):
    """Null doc_ids beside large ones, and one doc_id with several texts."""
    big = 2**53 + 1
    text = [" ".join(f"w{i}" for i in range(a, a + 40)) for a in (0, 100, 200)]
    rows = [(None, text[0]), (big, text[0]), (big + 2, text[0] + " x"), (None, text[2]), (7, text[1]), (8, text[2]), (9, text[1]), (9, text[2]), (9, "a b")]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    want = [(None, 36, big), (big, 36, big), (big + 2, 37, big), (None, 36, 7), (7, 36, 7), (8, 36, 7), (9, 36, 7), (9, 36, 7), (9, 1, 7)]
    assert sorted(map(str, got)) == sorted(f"Row(doc_id={a}, n_shingles={b}, component_id={c})" for a, b, c in want)


def test_chain_of_links(spark):
    """Each text is similar to the next alone; the ends are not similar, yet connected."""
    words = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(words[i * 8 : i * 8 + 100])) for i in range(20)]
    got = jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0} and {i: c for i, (_, c) in brute_components(docs).items()} == {r.doc_id: r.component_id for r in got}


def test_boundary_follows_cost(spark):
    rows = spark.createDataFrame([(5, 3.0, 50.0), (10, 10.0, 20.0), (50, 300.0, 40.0)], "n long, cost_light double, cost_heavy double")
    assert jaccard.choose_boundary(rows) == 10


def test_shared_tokens_by_brute_force(spark):
    r = random.Random(3)
    sets = {i: sorted({r.randrange(300) for _ in range(20)}) for i in range(50)}
    df = spark.createDataFrame(list(sets.items()), "doc_id long, s array<long>").repartition(5)

    def hashes(pdf):
        for i, s in zip(pdf.doc_id, pdf.s):
            yield textvec.mix(np.array(s, np.uint64)), np.full(len(s), i)

    count = Counter(x for s in sets.values() for x in s)
    want = {i: sum(count[x] > 1 for x in s) for i, s in sets.items()}
    for size in (30, 10**6):
        got = {r.doc_id: r.m for r in lists.shared_tokens(df, hashes, 1000, a_task=size).collect()}
        assert got == {i: m for i, m in want.items() if m}


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (20, 21), (5, 4), (6, 6)], "u long, v long")
    from voltlake.llm.common import saved

    got = {r.id: r.label for r in lists.components(edges, saved).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7, 9: 7, 20: 20, 21: 20}


def brute_lines(docs, least=1):
    lines = [(i, j, frozenset(re.findall(r"[^\x20\x09-\x0D]+", x))) for i, t in sorted(docs) for j, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if len(x[2]) >= least]
    return {(i, j) for k, (i, j, s) in enumerate(lines) if any(100 * len(s & o) >= 75 * len(s | o) for _, _, o in lines[:k])}


@pytest.mark.parametrize("hot", [2, 2000])
def test_line_dedup_by_brute_force(spark, hot):
    r = random.Random(8)
    docs = []
    for i, (_, t) in enumerate(near_copies(40, 9)):
        w = t.split()
        docs.append((i - 5, "\n".join(" ".join(w[k : k + r.choice((4, 8, 12))]) for k in range(0, len(w), 12)) + "\n"))
    gone = brute_lines(docs)
    got = linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), hot=hot).collect()
    assert gone and {r.doc_id: r.text for r in got} == {i: "\n".join(x for j, x in enumerate(t.split("\n")) if (i, j) not in gone) for i, t in docs}


@pytest.mark.parametrize("hot", [2, 2000])
def test_line_dedup_keeps_repeated_rows(spark, hot):
    """Rows of equal doc_id and text are one document: no copy of a line is earlier than itself."""
    first, second, near = "a b c d e f g h", "k l m n o p q r", "a b c d e f g z"
    docs = [(1, f"{first}\n{second}")] * 3 + [(2, f"{near}\nnew words are in this line")] * 2 + [(3, first)]
    got = linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(2), hot=hot).collect()
    assert sorted((r.doc_id, r.text, r.n_removed) for r in got) == [(1, f"{first}\n{second}", 0)] * 3 + [(2, "new words are in this line", 1)] * 2 + [(3, "", 1)]


@pytest.mark.parametrize(("hot", "most"), [(2000, 10**6), (20, 3), (2, 0)])
def test_line_dedup_of_split_lists(spark, monkeypatch, hot, most):
    """Lists are split by second tokens from 3 lines on, some lines are too large to have seconds, and few classes of equal lines are told."""
    largest = linededup._largest
    monkeypatch.setattr(linededup, "_largest", lambda copies, _: largest(copies, most))
    r, words, lines = random.Random(3), [f"w{i}" for i in range(200)], []
    for _ in range(420):
        if lines and r.random() < 0.6:
            w = list(r.choice(lines))
            for _ in range(r.randrange(2 + len(w) // 5)):
                w[r.randrange(len(w))] = r.choice(words)
        else:
            w = [r.choice(words) for _ in range(r.choice((2, 3, 5, 8, 12, 40)))] if r.random() < 0.9 else [f"v{r.randrange(400)}" for _ in range(r.choice((200, 250, 300, 400)))]
        lines.append(w)
    docs = [(i, "\n".join(" ".join(w) for w in lines[7 * i : 7 * i + 7])) for i in range(60)]
    gone = brute_lines(docs)
    got = linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), hot=hot, long=2).collect()
    assert gone and {r.doc_id: r.text for r in got} == {i: "\n".join(x for j, x in enumerate(t.split("\n")) if (i, j) not in gone) for i, t in docs}


def test_line_dedup_compares_few_lines_of_long_lists(spark, monkeypatch):
    """12,000 lines of 16 of 400 words: lists are long, but of lines that share a second token as well there are few."""
    compared = spark.sparkContext.accumulator(0)

    def counted(of, size):
        def f(*args):
            compared.add(size(*args))
            return of(*args)

        return f

    monkeypatch.setattr(lists, "similar", counted(lists.similar, lambda pairs, share: len(pairs[0])))
    monkeypatch.setattr(lists, "_similar_at", counted(lists._similar_at, lambda e, i, j, share: len(i)))
    r, words = random.Random(5), [f"w{i}" for i in range(400)]
    texts = [" ".join(r.sample(words, 16)) for _ in range(12_000)]
    near = [" ".join([f"new{i}", *t.split()[1:]]) for i, t in enumerate(texts[:300])]
    docs = [(i, "\n".join(t)) for i, t in enumerate([*(texts[k : k + 10] for k in range(0, len(texts), 10)), near])]
    got = {r.doc_id: r.n_removed for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), long=64).collect()}
    assert got[len(docs) - 1] == len(near) and sum(got.values()) == len(near)
    assert 0 < compared.value < 200 * len(texts)


def test_word_hashes():
    texts = ["A b\n\nc  b", None, "", "  b c ", "x y z w v"]
    h, doc, line = textvec.word_hashes(texts, lower=True)
    words = [(i, j, w) for i, t in enumerate(texts) for j, x in enumerate((t or "").split("\n")) for w in re.findall(r"[^\x20\x09-\x0D]+", x.lower())]
    assert list(zip(doc, line)) == [w[:2] for w in words]
    names = defaultdict(set)
    for (_, _, w), x in zip(words, h):
        names[w].add(int(x))
    assert all(len(v) == 1 for v in names.values()) and len({next(iter(v)) for v in names.values()}) == len(names)
    s, d = textvec.shingle_hashes(h, doc, len(texts), 5)
    assert d.tolist() == [0, 3, 4]


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for kind, regex in BASE.items():
        for m in re.finditer(regex, text):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(x - 9 if x > 9 else x for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))))
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 13 <= len(digits) <= 19 and total % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_personal_data_by_brute_force(spark):
    r = random.Random(2)
    parts = ["a@b.c", "_d@e.f", "x..y@z-1.co.uk.", "@", "1.2.3.4", ".5.6.7.8", "256.1.1.1", "001.02.255.0", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+49", "+1+1", " ", "\n", "é", "\U0001f600", "9", "99 ", "-", "."]
    texts = [(i, "".join(r.choice(parts) for _ in range(r.randrange(1, 14)))) for i in range(400)]
    got = find_personal_data(spark.createDataFrame(texts, "doc_id long, text string")).select("doc_id", joined_spans("base").alias("s"))
    assert {x.doc_id: x.s for x in got.collect()} == {i: brute_spans(t) for i, t in texts}


def test_personal_data_is_discovered(spark):
    cue = [(i, f"please write to my address u{i}@mail.org at once") for i in range(8)]
    odd = [(100, "please write to my address agent@localhost now"), (101, "the of agent5 is here")]
    noise = [(200 + i, f"the of v{i}@mail.org and the of nothing") for i in range(8)]
    got = {r.doc_id: r.s for r in find_personal_data(spark.createDataFrame(cue + odd + noise, "doc_id long, text string"), confidence=0.75).select("doc_id", joined_spans("spans").alias("s")).collect()}
    assert got[100] == "id:27:42" and got[101] == "" and got[0].startswith("email:27:")


def test_personal_data_of_later_rounds(spark):
    """A context of two seeds is supported by a token that the first round found, and finds another."""
    first = [(i, f"write to my address u{i}@mail.org at once") for i in range(20)] + [(50, "write to my address agent7@localhost now")]
    second = [(100 + i, f"you reach via u{i % 2}@mail.org again") for i in range(40)] + [(200, "you reach via agent7@localhost again"), (201, "you reach via other8@localhost again")]
    found = find_personal_data(spark.createDataFrame(first + second, "doc_id long, text string"))
    got = {r.doc_id: r.s for r in found.select("doc_id", joined_spans("spans").alias("s")).collect()}
    assert got[50] == "id:20:36" and got[200] == "id:14:30" and got[201] == "id:14:30"


def test_labelled_seeds_and_contexts_after(spark):
    """Values that a name is set to are seeds; short ones are found by the contexts that the seeds make, before and after."""
    r = random.Random(5)
    key = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n - 1)) + "7"
    texts = [(i, f'w{i}x said. token = "{key(40)}" y{i}z on.') for i in range(12)] + [(50, 'the last token = "ab12" was short')]
    texts += [(100 + i, f"q{i}q p{i}p u{i}@mail.org signed for it") for i in range(12)] + [(150, "qq pp agent7@localhost signed for it")]
    texts += [(200, "total = 12 and the key: none at all"), (201, "api_key=Zx9" + key(30) + ", then")]
    got = {x.doc_id: x for x in find_personal_data(spark.createDataFrame(texts, "doc_id long, text string")).withColumn("s", joined_spans("spans")).collect()}
    at = texts[0][1].index('"') + 1
    assert got[0].s == f"id:{at}:{at + 40}" and got[0].n_id == 1 and got[50].s == "id:18:22" and got[150].s == "id:6:22"
    assert got[200].s == "" and got[201].s == "id:0:41" and got[100].s.startswith("email:")


def test_personal_data_takes_linear_time(spark):
    """Running sums and overlaps of thousands of matches in one text."""
    text = " ".join(f"u{i}@mail.org and {i}" for i in range(9000))
    row = find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).withColumn("s", joined_spans("base")).first()
    assert row.n_email == 9000 and row.s == brute_spans(text)


def test_personal_data_is_native(spark):
    df = find_personal_data(spark.createDataFrame([(1, "a@b.c")], "doc_id long, text string"))
    assert "Python" not in df._jdf.queryExecution().toString()


def test_codewords():
    assert codewords(4).shape == (4, 7)
    for k in (2, 3, 4, 5, 9, 30):
        m = codewords(k)
        assert len({tuple(x) for x in m.tolist()}) == k and (np.abs(m.sum(axis=0)) < k).all()


def test_rare_language_is_learnt(spark):
    """A language of one row in 900 is learnt from, whatever the share of its rows; a text in many rows counts once."""
    r = random.Random(1)
    common = [(" ".join("".join(r.choice("abcdef") for _ in range(5)) for _ in range(6)), "xx") for _ in range(600)] + [("abc def abc", "xx")] * 300
    rows = spark.createDataFrame([*common, ("\u0436\u0448\u0449 \u0448\u0449\u0436", "yy")], "text string, lang string")
    docs = spark.createDataFrame([(1, "\u0448\u0449\u0436 \u0436\u0448\u0449"), (2, "abcde fabcd")], "doc_id long, text string")
    got = {x.doc_id: x.lang_pred for x in identify_language(docs, rows, max_train_rows=20).collect()}
    assert got == {1: "yy", 2: "xx"}
    assert equal_share([1, 900], 20) == 19 and equal_share([3, 4], 20) == 4 and equal_share([50, 50], 20) == 10


def test_text_after_the_last_tag():
    text = lambda page: [b[0] for b in html.blocks_of(page)]
    assert text("<p>one</p>when a < b the <3 rest stays") == ["one", "when a < b the <3 rest stays"]
    assert text("no tag, 1 < 2 holds") == ["no tag, 1 < 2 holds"] and text("<p>one</p>two <a href='x") == ["one", "two"]
    assert text("<p>one</p><script>if (a < b") == ["one"] and text("<p>one</p><!-- a > b < c") == ["one"]


def test_decoding_by_brute_force():
    """The codeword of least weighted loss, one bit at a time."""
    import math

    from voltlake.llm import langid

    r = random.Random(3)
    texts = [("".join(r.choice(x) for _ in range(40)), x) for x in ("abc ", "bcd ", "xyz ") for _ in range(30)]
    model = langid.fit(np.array([langid.features(t) for t, _ in texts]), np.array([x for _, x in texts]))
    for t, _ in texts[::7]:
        x = langid.features(t)
        losses = []
        for word in model["code"]:
            f = [sum(float(a) * float(b) for a, b in zip(x, model["w"][:, k])) + float(model["b"][k]) for k in range(len(word))]
            losses.append(sum(math.log1p(math.exp(-max(-30, min(30, c * v)))) * w for c, v, w in zip(word, f, model["bit_weight"])))
        p = [math.exp(min(losses) - v) for v in losses]
        best = min(range(len(losses)), key=losses.__getitem__)
        lang, score_, ambiguous = langid.decode(model, x, 0.2)
        assert lang == model["langs"][best] and abs(score_ - p[best] / sum(p)) < 1e-3
        assert ambiguous == (p[best] / sum(p) - sorted(p)[-2] / sum(p) < 0.2)


def test_quality_scores_by_plain_loop(spark):
    """A score is the machine's value with every pair of inputs multiplied out."""
    import math

    from voltlake.llm import quality

    texts = ["the cat sat on the mat and slept " * k for k in (1, 2, 3)] + ["BUY!!! $$$ NOW 123 " * k for k in (1, 2, 3)]
    made = [quality.words_and_structure(t, len(t)) for t in texts]
    words, stats = np.array([m[0] for m in made]), np.array([m[1] for m in made])
    model = quality.fit(words, stats, np.array([1.0] * 3 + [0.0] * 3), epochs=5)
    x = quality.encode(words, stats, model["scale"])
    for row, got in zip(x, quality.score(model, x)):
        on = [i for i in range(len(row)) if row[i]]
        value = float(model["w0"][0]) + sum(float(model["w"][i]) * float(row[i]) for i in on)
        value += sum(float(model["v"][i].astype(float) @ model["v"][j]) * float(row[i]) * float(row[j]) for i in on for j in on if j < i)
        assert abs(got - 1 / (1 + math.exp(-value))) < 1e-4


LAYOUTS = {
    '<body><div class="page no-sidebar"><p>{a}</p></div></body>': True,
    '<article class="post has-share-links"><p>{a}</p></article>': True,
    '<div class="sidebar-layout"><main><p>{a}</p></main></div>': True,
    '<div class="left-sidebar"><p>{a}</p></div><main><p>{b}</p></main>': False,
    '<div id="site-footer"><p>{a}</p></div><article><p>{b}</p></article>': False,
    '<section class="comments"><article class="comment"><p>{a}</p></article></section><article><p>{b}</p></article>': False,
    '<article><p>{b}</p><p><a href="x">{a}</a></p><p>{b}</p></article>': True,
    '<article><p>{b}</p><ul><li><a href="x">{a}</a></li></ul></article>': False,
    '<article><p>{b}</p><div role="search">{a}</div></article>': False,
    '<main id="content"><div class="with-ads"><p>{a}</p></div></main>': True,
    '<div><nav><p>{a}</p></nav><p>{b}</p></div>': False,
    '<article><header><p>{a}</p></header><p>{b}</p></article>': False,
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_html_layouts(layout):
    a, b = ("the %s of the house is on the hill and it was seen by all of the people who are there in the morning" % x for x in ("roof", "door"))
    assert (a in html.main_text(layout.format(a=a, b=b))) == LAYOUTS[layout]
    assert "{b}" not in layout or b in html.main_text(layout.format(a=a, b=b))


def test_second_pass_by_brute_force():
    r = random.Random(1)
    for _ in range(300):
        labels = [r.choice((True, False, None, None)) for _ in range(r.randrange(1, 9))]
        default, want = r.random() < 0.5, []
        for i, x in enumerate(labels):
            near = sorted((abs(i - j), y) for j, y in enumerate(labels) if y is not None)
            least = {y for d, y in near if d == near[0][0]}
            # Of two nearest neighbours on either side that disagree, neither decides.
            sides = [next((y for y in side if y is not None), None) for side in (labels[i::-1], labels[i:])]
            want.append(x if x is not None else least.pop() if len(least) == 1 and sides != [None, None] else default)
        assert html.second_pass(labels, default) == want


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    p = {"w0": np.array([0.1]), "w": rng.normal(size=6), "v": rng.normal(size=(6, 3))}
    x = rng.normal(size=(4, 6))
    slow = [p["w0"][0] + r @ p["w"] + sum(p["v"][i] @ p["v"][j] * r[i] * r[j] for i in range(6) for j in range(i)) for r in x]
    assert np.allclose(score(p, x), 1 / (1 + np.exp(-np.array(slow))))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = pd.read_parquet(f"{sf}/documents.parquet").set_index("doc_id")
    lang = queries.op8_language_id(spark, sf).toPandas()
    out = lang[lang.held_out]
    assert {i for i in out.doc_id} == {i for i in docs.index if zlib.crc32(str(i).encode()) % 5 == 0}
    assert (out.lang_pred.to_numpy() == docs.lang.reindex(out.doc_id).to_numpy()).mean() > 0.97
    quality = queries.op4_quality(spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    out = quality[quality.held_out]
    good, bad = out[out.quality == 1].score, out[out.quality == 0].score
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.95 and (out[out.quality == 1].predicted == 1).mean() > 0.95
