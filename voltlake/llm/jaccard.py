"""N-gram Jaccard join by the size-aware heavy-light method.

Documents are sets of word shingles. Small (light) sets meet through the enumerated 2-subsets of their
prefixes, large (heavy) sets by scanning the inverted lists of their prefix tokens; light sets close in
size to the heavy ones are in those lists too. The boundary is the size at which enumerating all smaller
sets plus scanning for all larger ones costs least; to deal out an entry costs as much as to scan several
pairs. Every candidate pair is verified on the full sets.

A pair of similarity t shares at least a = ceil(t * n) tokens with a set of n, so with tokens in one
common order the first n - a + k tokens of both share k of them: k = 1 for lists, k = 2 for subsets.

What is asked for is connection, not all pairs. Exact copies are one class. In the first round a set is
compared with the leaders of few of its lists only, chosen by hash: of a list's sets the one whose prefix is the most
frequent in the corpus, so that all lists of a group of near copies name the same one. The links found
are contracted to components. The second round takes from every list the pairs of components that still
meet in it, and compares the sets of the smaller one with those of the larger in blocks of bounded size,
until one pair links them. So no group of copies is expanded into all its pairs, and no link between
components is missed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved, small, trimmed
from .lists import components, count_table, distinct_sorted, least_overlap, rarity, runs_of, shared_tokens, sum_by, tokens
from .textvec import chunks, mix, shingle_hashes, word_hashes

_SALT = np.uint64(0x51ED270B9F2C4A3D)
#: Pairs that are scanned in the time in which one entry is dealt out, sorted and sent.
ENTRY_COST = 32


def _shingles(texts: list, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for start, end in chunks(texts):
        h, doc, _ = word_hashes(texts[start:end], lower=True)
        yield start, end, *shingle_hashes(h, doc, end - start, k)


def _sets(texts: list, classes: np.ndarray | None, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For every chunk of texts: its start, distinct tokens (plain hashes without classes), the text of each, set sizes and their first positions."""
    for start, end, h, doc in _shingles(texts, k):
        t, doc = distinct_sorted(h if classes is None else tokens(h, classes), doc)
        n = np.bincount(doc, minlength=end - start)
        yield start, t, doc, n, np.cumsum(n) - n


def entries(pdf: pd.DataFrame, boundary: int, share: tuple[int, int], some: int = 0) -> Iterator[dict[str, np.ndarray]]:
    """The lists each set (doc_id, n, prefix) is in. The position of a 2-subset is that of its later token, less one.

    some: only the lists of so many tokens of each prefix, those of least hash among the tokens counted twice.
    """
    once = rarity(np.array([1]))[0]

    def order(t: np.ndarray) -> np.ndarray:
        return np.where(t >> np.uint64(56) <= once, ~np.uint64(0), mix(t ^ _SALT))

    n, a = pdf["n"].to_numpy(), pdf["doc_id"].to_numpy()
    out = []
    for size in np.unique(n[n <= boundary]):
        rows = np.flatnonzero(n == size)
        prefix = np.frombuffer(b"".join(pdf["prefix"].iloc[rows]), np.uint64).reshape(len(rows), -1)
        if some:
            prefix = np.sort(np.take_along_axis(prefix, np.argsort(order(prefix), axis=1)[:, :some], axis=1), axis=1)
        i, j = np.triu_indices(prefix.shape[1], 1)
        keys = mix(prefix[:, i] * np.uint64(0x9E3779B97F4A7C15) + prefix[:, j])
        out.append((keys.ravel(), np.repeat(a[rows], len(i)), np.full(keys.size, size), np.tile(j - 1, len(rows))))
    # Lists of tokens hold the heavy sets, and the light ones that are large enough to be similar to one.
    rows = np.flatnonzero((n > boundary) | (n * share[1] >= share[0] * (boundary + 1)))
    if len(rows):
        one = n[rows] - least_overlap(n[rows], share) + 1
        keys = np.concatenate([np.frombuffer(pdf["prefix"].iloc[r], np.uint64)[:p] for r, p in zip(rows, one)])
        row, pos = np.repeat(rows, one), np.arange(len(keys)) - np.repeat(np.cumsum(one) - one, one)
        if some:
            use = np.lexsort((order(keys), row))[pos < some]
            keys, row, pos = keys[use], row[use], pos[use]
        out.append((mix(keys ^ _SALT), a[row], n[row], pos))
    if out:
        yield dict(zip(("key", "a", "n", "pos"), (np.concatenate(x) for x in zip(*out))))


def choose_boundary(sets: DataFrame) -> int:
    """The size up to which sets are light: least cost of enumeration below plus scanning above."""
    by_size = sets.groupBy("n").agg(F.sum("cost_light").alias("light"), F.sum("cost_heavy").alias("heavy"))
    upto, above = W.orderBy("n").rowsBetween(W.unboundedPreceding, 0), W.orderBy("n").rowsBetween(1, W.unboundedFollowing)
    cost = by_size.select("n", "heavy", (F.sum("light").over(upto) + F.coalesce(F.sum("heavy").over(above), F.lit(0.0))).alias("cost"))
    best = cost.agg(F.min_by("n", "cost").alias("n"), F.min("cost").alias("cost"), F.sum("heavy").alias("all_heavy")).first()
    return int(best["n"]) if best["n"] is not None and best["cost"] < best["all_heavy"] else 0


#: The columns of a list's entry, packed: key within its bucket, document or label, size of the set, position of the token.
ENTRY = (("key", "<u4"), ("a", "<i8"), ("n", "<i4"), ("pos", "<i4"))
_DEALT = "bucket long, size long, entries binary, pairs binary"


def _pack(e: dict[str, np.ndarray], at: np.ndarray) -> bytes:
    return b"".join(e[c][at].astype(k).tobytes() for c, k in ENTRY)


def _unpack(sizes: pd.Series, raws: pd.Series) -> dict[str, np.ndarray]:
    parts: dict[str, list[np.ndarray]] = {c: [] for c, _ in ENTRY}
    for size, raw in zip(sizes, raws):
        at = 0
        for c, k in ENTRY:
            width = np.dtype(k).itemsize * size
            parts[c].append(np.frombuffer(raw[at : at + width], k))
            at += width
    return {c: np.concatenate(v or [np.zeros(0, k)]) for (c, k), v in zip(ENTRY, parts.values())}


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _near_sizes(n1: np.ndarray, n2: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    return (n1 * share[1] >= n2 * share[0]) & (n2 * share[1] >= n1 * share[0])


def _can_link(e: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """Length and positional filter of the entry pairs (i, j)."""
    n1, n2 = e["n"][i].astype(np.int64), e["n"][j].astype(np.int64)
    least = -(-share[0] * (n1 + n2) // (share[0] + share[1]))
    return _near_sizes(n1, n2, share) & (np.minimum(n1 - e["pos"][i], n2 - e["pos"][j]) >= least)


def _stars(e: dict[str, np.ndarray], share: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (leader, member) of the lists of entries sorted by list and then from the leader on, and the leaders' entries."""
    first, run = runs_of(e["key"])
    lead = first[run]
    use = np.flatnonzero((e["a"][lead] != e["a"]) & _near_sizes(e["n"][lead].astype(np.int64), e["n"].astype(np.int64), share))
    return _distinct(np.stack((e["a"][lead[use]], e["a"][use]))), first


def _distinct(pairs: np.ndarray) -> np.ndarray:
    pairs = pairs[:, np.lexsort(pairs[::-1])]
    return pairs[:, np.append(True, (pairs[:, 1:] != pairs[:, :-1]).any(axis=0))[: pairs.shape[1]]]


def _expanded(e: dict[str, np.ndarray], run: np.ndarray, use: np.ndarray, share: tuple[int, int], names: np.ndarray, step: int = 250_000) -> np.ndarray:
    """Distinct pairs of names that meet in the lists marked use and pass the filters; entries are sorted by list and size.

    The smaller set is looked for at its first n - ceil(2t / (1 + t) n) + 1 positions.
    """
    n = e["n"].astype(np.int64)
    ids, who = np.unique(names, return_inverse=True)
    shorter = np.flatnonzero(use[run] & (e["pos"] < n + (-2 * share[0] * n // (share[0] + share[1])) + 1))
    scale = np.int64(1) << 31
    upto = np.searchsorted(run * scale + n, run[shorter] * scale + n[shorter] * share[1] // share[0], side="right")
    count, codes, size, at = upto - shorter - 1, [np.zeros(0, np.int64)], 0, 0
    ends = np.cumsum(count)
    while at < len(shorter):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + step, side="right")))
        c = count[at:stop]
        i = np.repeat(shorter[at:stop], c)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
        keep = (who[i] != who[j]) & _can_link(e, i, j, share)
        x, y = who[i[keep]], who[j[keep]]
        codes.append(np.minimum(x, y) * len(ids) + np.maximum(x, y))
        size += len(x)
        if size > 1_000_000:
            codes = [np.unique(np.concatenate(codes))]
            size = len(codes[0]) // 2
        at = stop
    codes = np.unique(np.concatenate(codes))
    return np.stack((ids[codes // max(len(ids), 1)], ids[codes % max(len(ids), 1)]))


def _folded(entries_of: Callable, deal: Callable, a_task: int) -> Callable:
    """A mapInPandas function that deals out the entries of a task, about a_task at a time."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for pdf in batches:
            for e in entries_of(pdf):
                held.append(e)
                size += len(e["key"])
                if size >= a_task:
                    yield deal({c: np.concatenate([h[c] for h in held]) for c in held[0]})
                    held, size = [], 0
        if held:
            yield deal({c: np.concatenate([h[c] for h in held]) for c in held[0]})

    return lambda batches: trimmed(fold(batches))


def _rows(e: dict[str, np.ndarray], chosen: np.ndarray, pairs: np.ndarray, buckets: int) -> pd.DataFrame:
    """One row for each bucket: the chosen entries, and the pairs found."""
    parts = []
    for of in (_bucket(e["key"][chosen], buckets), (mix(pairs[0].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)):
        order = np.argsort(of, kind="stable")
        parts.append((order, np.searchsorted(of[order], np.arange(buckets + 1))))
    rows = []
    for x in range(buckets):
        mine, found = (order[cuts[x] : cuts[x + 1]] for order, cuts in parts)
        if len(mine) or len(found):
            rows.append((x, len(mine), _pack(e, chosen[mine]), np.ascontiguousarray(pairs[:, found]).astype("<i8").tobytes()))
    return pd.DataFrame(rows, columns=["bucket", "size", "entries", "pairs"])


def first_round(sets: DataFrame, entries_of: Callable, buckets: int, share: tuple[int, int], a_task: int = 300_000) -> DataFrame:
    """Candidates (x, y) of sets (doc_id, n, prefix, central): each set x with the leaders y of three of its lists.

    A list is led by its most central set (then the smallest id). A task folds its part of a list before
    it deals it out, so that a list of any length sends one entry a task.
    """

    def ranked(pdf: pd.DataFrame) -> Iterator[dict[str, np.ndarray]]:
        where = pdf["doc_id"].to_numpy()
        order = np.argsort(where, kind="stable")
        central = pdf["central"].to_numpy()[order]
        for e in entries_of(pdf, 3):
            yield e | {"pos": -central[np.searchsorted(where[order], e["a"])]}  # in the place of a position: the rank

    def led(e: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        order = np.lexsort((e["a"], e["pos"], e["key"]))
        e = {c: v[order] for c, v in e.items()}
        return e, *_stars(e, share)

    def deal(e: dict[str, np.ndarray]) -> pd.DataFrame:
        e, pairs, leads = led(e)
        return _rows(e, leads, pairs, buckets)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        _, pairs, _ = led(_unpack(pdf["size"], pdf["entries"]))
        y, x = _distinct(np.concatenate([pairs, *(np.frombuffer(p, "<i8").reshape(2, -1) for p in pdf["pairs"] if p)], axis=1))
        return pd.DataFrame({"x": x, "y": y})

    dealt = sets.mapInPandas(_folded(ranked, deal, a_task), _DEALT)
    return dealt.groupBy("bucket").applyInPandas(lambda pdf: pd.concat(trimmed([merge(pdf)])), "x long, y long").distinct()


def meetings(sets: DataFrame, entries_of: Callable, buckets: int, share: tuple[int, int], a_task: int = 300_000) -> DataFrame:
    """Pairs of labels (x, y) of which sets (doc_id, n, prefix, label) meet in a list and pass the filters.

    Sets of one label and size in a list are told by the earliest position, so a group of any size sends
    few entries a task.
    """

    def labelled(pdf: pd.DataFrame) -> Iterator[dict[str, np.ndarray]]:
        where = pdf["doc_id"].to_numpy()
        order = np.argsort(where, kind="stable")
        label = pdf["label"].to_numpy()[order]
        for e in entries_of(pdf):
            yield e | {"a": label[np.searchsorted(where[order], e["a"])]}

    def least_positions(e: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        order = np.lexsort((e["pos"], e["a"], e["n"], e["key"]))
        e = {c: v[order] for c, v in e.items()}
        new = np.append(True, (e["key"][1:] != e["key"][:-1]) | (e["n"][1:] != e["n"][:-1]) | (e["a"][1:] != e["a"][:-1]))[: len(order)]
        return {c: v[new] for c, v in e.items()}

    def deal(e: dict[str, np.ndarray]) -> pd.DataFrame:
        e = least_positions(e)
        return _rows(e, np.arange(len(e["key"])), np.zeros((2, 0), np.int64), buckets)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        e = least_positions(_unpack(pdf["size"], pdf["entries"]))
        first, run = runs_of(e["key"])
        several = np.bincount(run[e["a"] != e["a"][first[run]]], minlength=len(first)) > 0
        x, y = _expanded(e, run, several, share, e["a"])
        return pd.DataFrame({"x": x, "y": y})

    dealt = sets.mapInPandas(_folded(labelled, deal, a_task), _DEALT)
    return dealt.groupBy("bucket").applyInPandas(lambda pdf: pd.concat(trimmed([merge(pdf)])), "x long, y long").distinct()


def _linked_in_block(member: list[np.ndarray], visitor: list[np.ndarray], labels: np.ndarray, share: tuple[int, int]) -> set[int]:
    """Which labels of the visitors have a set that is similar to a member. The sets of the smaller side are looked for one by one."""
    turned = len(member) < len(visitor)
    few, many = (member, visitor) if turned else (visitor, member)
    n = np.array([len(s) for s in many])
    p = n - least_overlap(n, share) + 1
    owner = np.repeat(np.arange(len(many)), p)
    pos = np.arange(len(owner)) - np.repeat(np.cumsum(p) - p, p)
    token = np.concatenate([s[:k] for s, k in zip(many, p)])
    order = np.argsort(token, kind="stable")
    token, owner, pos = token[order], owner[order], pos[order]
    done: set[int] = set()
    for k, s in enumerate(few):
        if not turned and labels[k] in done:
            continue
        m = len(s)
        first = s[: m + (-share[0] * m // share[1]) + 1]
        lo, hi = np.searchsorted(token, first), np.searchsorted(token, first, side="right")
        count = hi - lo
        at = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        least = -(-share[0] * (m + n[owner[at]]) // (share[0] + share[1]))
        fits = _near_sizes(np.int64(m), n[owner[at]], share) & (np.minimum(m - np.repeat(np.arange(len(first)), count), n[owner[at]] - pos[at]) >= least)
        found = np.unique(owner[at[fits]])
        if turned and done:
            found = found[[labels[i] not in done for i in found]]
        for start in range(0, len(found), 64):
            some = found[start : start + 64]
            every = np.concatenate([many[i] for i in some])
            place = np.minimum(np.searchsorted(s, every), m - 1)
            common = np.add.reduceat((s[place] == every).astype(np.int64), np.cumsum(n[some]) - n[some])
            good = some[common * share[1] >= (m + n[some] - common) * share[0]]
            if turned:
                done.update(labels[good].tolist())
            elif len(good):
                done.add(int(labels[k]))
                break
    return done


def links(visits: DataFrame, sets: DataFrame, share: tuple[int, int], a_side: int = 512, a_block: int = 2_000) -> DataFrame:
    """Links (u, v) between labels: visits (x, y, size of y) whose sets (doc_id, set, label) have a similar pair.

    The sets of y are dealt into parts of about a_side, those of all its visitors too; every pair of parts
    meets once, in a block of bounded size with others.
    """
    inner = visits.select("x", "y", F.ceil(F.col("size") / a_side).alias("parts"))
    guests = saved(sets.select("doc_id", F.col("label").alias("x")).join(inner, "x"), "guests")
    hosts = guests.groupBy("y").agg(F.ceil(F.count("*") / a_side).alias("turns"), F.first("parts").alias("parts"))
    part = lambda of: F.pmod(F.xxhash64("doc_id"), F.col(of))
    each = lambda upto: F.explode(F.sequence(F.lit(0).cast("long"), F.col(upto) - 1))
    coming = guests.join(hosts.select("y", "turns"), "y").select(F.lit(True).alias("guest"), "doc_id", "x", "y", part("turns").alias("turn"), each("parts").alias("part"))
    staying = sets.select("doc_id", F.col("label").alias("y")).join(hosts, "y").select(F.lit(False).alias("guest"), "doc_id", F.col("y").alias("x"), "y", each("turns").alias("turn"), part("parts").alias("part"))
    rows = saved(coming.unionByName(staying), "rows")
    blocks = max(12, math.ceil(rows.count() / a_block))
    whole = rows.join(sets.select("doc_id", "set"), "doc_id").withColumn("block", F.pmod(F.xxhash64("y", "part", "turn"), F.lit(blocks)))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (y, _, _), one in pdf.groupby(["y", "part", "turn"], sort=False):
            guest = one["guest"].to_numpy()
            tokens = [np.frombuffer(s, np.uint64) for s in one["set"]]
            if guest.any() and not guest.all():
                labels = one["x"].to_numpy()[guest]
                found = _linked_in_block([t for t, g in zip(tokens, guest) if not g], [t for t, g in zip(tokens, guest) if g], labels, share)
                out += [(x, y) for x in found]
        return pd.DataFrame(out, columns=["u", "v"], dtype=np.int64)

    return whole.groupBy("block").applyInPandas(lambda pdf: pd.concat(trimmed([compare(pdf)])), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, share: tuple[int, int] = (75, 100)) -> DataFrame:
    """Components of docs (doc_id: an integer, text) under Jaccard similarity >= share[0] / share[1] of their sets.

    Words are runs of [^\\x20\\x09-\\x0D] with A-Z in lower case; a set has the distinct windows of k words,
    or the whole sequence of a text of fewer words. Sets are kept as 56-bit hashes.

    Returns a row per document: doc_id, n_shingles and component_id (the smallest doc_id reachable).

    Null, empty or blank text: an empty set, linked with nothing. Repeated rows are copies of each other;
    rows that share a doc_id are one document, linked with whatever one of its texts is linked with. Rows
    of null doc_id are compared with nothing: they have the component of their exact copies, or null. A
    text of any length is one set. An empty table gives no rows. Other columns are ignored.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, t, _, n, at in _sets(batch["text"].to_pylist(), None, k):
                digests = [sum_by(x, at, n).view(np.int64) for x in (mix(t), mix(t ^ _SALT))]
                part = batch.slice(start, len(n))
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["mark"], *map(pa.array, (n, *digests))], names=["doc_id", "mark", "n", "d1", "d2"])

    base = base.withColumn("mark", F.xxhash64("text"))
    sizes = saved(base.mapInArrow(lambda b: trimmed(describe(b)), "doc_id long, mark long, n long, d1 long, d2 long"), "sizes")
    copies = saved(sizes.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep")), "copies")
    named = sizes.where("doc_id is not null").join(copies, ["d1", "d2", "n"], "left")
    # One document of every class of equal sets; sets of one or two tokens are similar to none but their equals.
    others = saved(named.where("n < 3 or doc_id <> rep").select("doc_id", "mark").distinct(), "others")
    single = base.where("doc_id is not null").join(small(others, others.count(), 24), ["doc_id", "mark"], "left_anti").select("doc_id", "text")
    # The classes of one document with several texts are linked.
    reps = named.where("n > 0").select("doc_id", "rep")
    same = reps.groupBy("doc_id").agg(F.min("rep").alias("v"), F.max("rep").alias("w")).where("v <> w").select("doc_id", "v")
    same = reps.join(same, "doc_id").where("rep <> v").select(F.col("rep").alias("u"), "v")

    def owned(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ids = pdf["doc_id"].to_numpy()
        for start, t, doc, _, _ in _sets(pdf["text"].tolist(), None, k):
            yield t, ids[start + doc]

    # A set of n tokens that shares fewer than ceil(t * n) of them with all others together is similar to none.
    n_tokens = copies.agg(F.sum("n")).first()[0] or 0
    close = shared_tokens(single, owned, n_tokens).join(copies.select(F.col("rep").alias("doc_id"), "n"), "doc_id")
    close = saved(close.where(F.col("m") * share[1] >= F.col("n") * share[0]).select("doc_id").distinct(), "close")
    near = single.join(small(close, close.count(), 16), "doc_id", "left_semi")

    def all_hashes(pdf: pd.DataFrame) -> Iterator[np.ndarray]:
        for _, _, h, _ in _shingles(pdf["text"].tolist(), k):
            yield h

    counts = count_table(near.select("text"), all_hashes)
    shared = base.sparkSession.sparkContext.broadcast(rarity(counts))

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start, t, doc, n, at in _sets(pdf["text"].tolist(), shared.value, k):
                need = least_overlap(n, share)
                one, two = np.minimum(n - need + 1, n), np.minimum(n - need + 2, n)
                place = np.arange(len(t)) - np.repeat(at, n)
                # The expected length of a token's list, by its class.
                length = 1.0 + 2.0 ** ((t >> np.uint64(56)).astype(np.float64) / 8)
                yield pd.DataFrame(
                    {
                        "doc_id": pdf["doc_id"].iloc[start : start + len(n)].to_numpy(),
                        "n": n,
                        "prefix": [t[i : i + p].tobytes() for i, p in zip(at, two)],
                        "set": [t[i : i + m].tobytes() for i, m in zip(at, n)],
                        # How frequent the prefix is: of near copies, it is highest for the text that they were made from.
                        "central": np.bincount(doc, weights=((t >> np.uint64(56)) << np.uint64(8)) * (place < one[doc]), minlength=len(n)).astype(np.int64) // np.maximum(one, 1),
                        "cost_light": ENTRY_COST * two * (two - 1) / 2.0,
                        "cost_heavy": np.bincount(doc, weights=(ENTRY_COST + length) * (place < one[doc]), minlength=len(n)),
                    }
                )

    firsts = saved(near.mapInPandas(lambda b: trimmed(summarise(b)), "doc_id long, n long, prefix binary, set binary, central long, cost_light double, cost_heavy double").where("n > 2"), "firsts")
    boundary = choose_boundary(firsts)
    p = F.col("n") - F.ceil(F.col("n") * share[0] / share[1]) + 1
    n_keys = firsts.agg(F.sum(p + F.when(F.col("n") <= boundary, p * (p + 1) / 2).otherwise(0))).first()[0] or 0
    buckets = max(12, math.ceil(n_keys / 300_000))

    def entries_of(pdf: pd.DataFrame, some: int = 0) -> Iterator[dict[str, np.ndarray]]:
        n = pdf["n"].to_numpy()
        p = n - least_overlap(n, share) + 1
        made = np.cumsum(np.where(n <= boundary, p + p * (p + 1) // 2, p)) // 50_000
        for at in np.flatnonzero(np.diff(made, prepend=-1)):
            yield from entries(pdf[made == made[at]], boundary, share, some)

    pairs = first_round(firsts.select("doc_id", "n", "prefix", "central"), entries_of, buckets, share)
    pairs = saved(pairs.withColumn("size", F.lit(1)), "visits")
    near_links = saved(links(pairs, firsts.select("doc_id", "set", F.col("doc_id").alias("label")), share).union(same), "links")
    labels = components(near_links, saved)
    # What is still in different components is compared wherever it meets.
    sizes_of = labels.groupBy("label").agg(F.count("*").cast("int").alias("size"))
    known = saved(labels.join(sizes_of, "label").select(F.col("id").alias("doc_id"), "label", "size"), "known")
    grouped = firsts.join(small(known, known.count(), 32), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id")).withColumn("size", F.coalesce("size", F.lit(1)))
    met = saved(meetings(grouped.select("doc_id", "n", "prefix", "label"), entries_of, buckets, share), "met")
    of = grouped.select("label", "size").distinct()
    met = met.join(of.toDF("x", "size_x"), "x").join(of.toDF("y", "size_y"), "y")
    swap = (F.col("size_x") > F.col("size_y")) | ((F.col("size_x") == F.col("size_y")) & (F.col("x") > F.col("y")))
    visits = met.select(F.when(swap, F.col("y")).otherwise(F.col("x")).alias("x"), F.when(swap, F.col("x")).otherwise(F.col("y")).alias("y"), F.greatest("size_x", "size_y").alias("size"))
    late = saved(links(saved(visits, "visits"), grouped.select("doc_id", "set", "label"), share), "links")
    joined = components(late, saved).select(F.col("id").alias("label"), F.col("label").alias("last"))
    labels = labels.join(joined, "label", "full").select(F.coalesce("id", "label").alias("id"), F.coalesce("last", "label").alias("label"))
    labels = saved(labels, "labels")

    rows = sizes.join(copies, ["d1", "d2", "n"], "left")
    labels = labels.select(F.col("id").alias("rep"), "label")
    component = F.coalesce("label", "rep", "doc_id")
    return rows.join(small(labels, labels.count(), 24), "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
