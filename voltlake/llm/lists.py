"""Inverted lists of set tokens, rarest first: what the set-similarity operators share.

Tokens are 64-bit numbers whose upper byte is their rarity class, so their natural order is from rare to
frequent, the same in every task. Rarity comes from a table of hashed counts over all data whose size is
a parameter: it orders tokens, it never decides a result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, trimmed
from .textvec import mix

SLOTS_LOG2 = 20


def pack_counts(table: np.ndarray) -> bytes:
    return pa.compress(np.minimum(table, 2**32 - 1).astype("<u4").tobytes(), codec="zstd", asbytes=True)


def unpack_counts(raw: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, decompressed_size=4 << SLOTS_LOG2, codec="zstd", asbytes=True), "<u4").astype(np.int64)


class Counts:
    """Counts of hashes in 2^SLOTS_LOG2 slots within a task; hashes are gathered so that few passes over the table are made."""

    def __init__(self) -> None:
        self.table, self.held, self.size = np.zeros(1 << SLOTS_LOG2, np.int64), [], 0

    def add(self, h: np.ndarray) -> None:
        self.held.append((h >> np.uint64(64 - SLOTS_LOG2)).astype(np.int64))
        self.size += len(h)
        if self.size >= 1 << 21:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self.table += np.bincount(np.concatenate(self.held), minlength=len(self.table))
        self.held, self.size = [], 0

    def packed(self) -> bytes:
        self.flush()
        return pack_counts(self.table)


def summed(tables: DataFrame, fan: int = 16) -> np.ndarray:
    """The sum of the packed tables in the only column (t) of a frame, ``fan`` of them at a time, in a tree."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << SLOTS_LOG2, np.int64)
        for pdf in batches:
            for t in pdf["t"]:
                total += unpack_counts(t)
        yield pd.DataFrame({"t": [pack_counts(total)]})

    left = max(2, tables.count())
    while left > 1:
        left = math.ceil(left / fan)
        tables = tables.repartition(left).mapInPandas(lambda b: trimmed(add(b)), "t binary")
    found = tables.collect()
    return unpack_counts(found[0][0]) if found else np.zeros(1 << SLOTS_LOG2, np.int64)


def count_table(df: DataFrame, hashes: Callable[[pd.DataFrame], Iterator[np.ndarray]]) -> np.ndarray:
    """Counts of hashes in slots, over all rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = Counts()
        for pdf in batches:
            for h in hashes(pdf):
                counts.add(h)
        yield pd.DataFrame({"t": [counts.packed()]})

    return summed(saved(df.mapInPandas(lambda b: trimmed(count(b)), "t binary"), "counts"))


def rarity(counts: np.ndarray) -> np.ndarray:
    """A class of 0 to 255 for each slot: the logarithm of its count."""
    return np.minimum(np.round(8 * np.log2(1 + counts)), 255).astype(np.uint8)


def tokens(h: np.ndarray, classes: np.ndarray) -> np.ndarray:
    return (classes[(h >> np.uint64(64 - SLOTS_LOG2)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8))


def distinct_sorted(t: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens of every group, ascending; group must be ascending already."""
    if not len(t):
        return t, group
    order = None
    if group[-1] < 1 << 20:
        key = (group.astype(np.uint64) << np.uint64(44)) | (t >> np.uint64(20))
        order = np.argsort(key)
        key = key[order]
        if ((key[1:] == key[:-1]) & (t[order[1:]] != t[order[:-1]])).any():
            order = None  # different tokens of equal upper bits
    if order is None:
        order = np.lexsort((t, group))
    t, group = t[order], group[order]
    new = np.concatenate(([True], (t[1:] != t[:-1]) | (group[1:] != group[:-1])))
    return t[new], group[new]


def sum_by(x: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of the n values of x from each position at on."""
    total = np.concatenate((np.zeros(1, x.dtype), np.cumsum(x, dtype=x.dtype)))
    return total[at + n] - total[at]


def least_overlap(n: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """ceil(t * n): what a set of n tokens has in common at least with any set of Jaccard similarity t = share[0] / share[1]."""
    a, b = share
    return -(-a * n // b)


#: The columns of an entry of a list: key, document, place, size, position of the token, bitmap, number of its seconds.
ENTRY = (("key", "<u4"), ("a", "<i8"), ("b", "<i8"), ("n", "<i4"), ("pos", "<i4"), ("x", "<u8"), ("y", "<u8"), ("m", "u1"))
#: m of the entries of frequent tokens in sets of more than MOST tokens, which have no seconds.
TOO_LARGE = 255
MOST = 192
PAIR = "a1 long, b1 long, a2 long, b2 long, more int, rest binary"


def similar(pairs: np.ndarray | tuple, share: tuple[int, int]) -> np.ndarray:
    """Which of the entry pairs (size, position, bitmap of both) the filters leave."""
    n1, p1, x1, y1, n2, p2, x2, y2 = pairs
    both = n1.astype(np.int64) + n2
    least = -(-share[0] * both // (share[0] + share[1]))
    keep = (n1 * share[1] >= n2 * share[0]) & (n2 * share[1] >= n1 * share[0]) & (np.minimum(n1 - p1, n2 - p2) >= least)
    odd = np.bitwise_count(x1 ^ x2).astype(np.int64) + np.bitwise_count(y1 ^ y2)
    return keep & ((both - odd) // 2 >= least)


def _similar_at(e: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """Which entry pairs (i, j) the filters leave."""
    return similar((*(e[c][i] for c in ("n", "pos", "x", "y")), *(e[c][j] for c in ("n", "pos", "x", "y"))), share) & (i != j)


class _Pairs:
    """Distinct pairs (earlier, later) of the lines of a block, as numbers."""

    def __init__(self, e: dict[str, np.ndarray]):
        order = np.lexsort((e["b"], e["a"]))
        a, b = e["a"][order], e["b"][order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, bool)
        self.line = np.empty(len(a), np.int64)
        self.line[order] = np.cumsum(new) - 1
        at = order[new]
        self.a, self.b, self.x, self.y = (e[c][at] for c in ("a", "b", "x", "y"))
        self.codes, self.size = [], 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        i, j = self.line[i], self.line[j]
        other = i != j  # repeated rows give a line several entries; none is earlier than itself
        i, j = i[other], j[other]
        self.codes.append(np.minimum(i, j) * len(self.a) + np.maximum(i, j))
        self.size += len(i)
        if self.size > 1_000_000:
            self.codes = [np.unique(np.concatenate(self.codes))]
            self.size = len(self.codes[0]) // 2

    def named(self, codes: np.ndarray) -> np.ndarray:
        i, j = codes // len(self.a), codes % len(self.a)
        return np.array([self.a[i], self.b[i], self.a[j], self.b[j]])

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The likeliest earlier line of each later one (fewest odd bits), whether there are others, and those."""
        codes = np.unique(np.concatenate(self.codes)) if self.codes else np.zeros(0, np.int64)
        if not len(codes):
            return np.zeros((4, 0), np.int64), codes, np.zeros((4, 0), np.int64)
        i, j = codes // len(self.a), codes % len(self.a)
        odd = np.bitwise_count(self.x[i] ^ self.x[j]).astype(np.int64) + np.bitwise_count(self.y[i] ^ self.y[j])
        codes, j = (v[np.lexsort((i, odd, j))] for v in (codes, j))
        first = np.concatenate(([True], j[1:] != j[:-1]))
        size = np.diff(np.append(np.flatnonzero(first), len(j)))
        return self.named(codes[first]), (size > 1).astype(np.int64), self.named(codes[~first])


def _leads(e: dict[str, np.ndarray], run: np.ndarray, first: np.ndarray, share: tuple[int, int], warm: np.ndarray) -> np.ndarray:
    """For each list the entry that others are compared with, of those at a position where smaller sets are looked for.

    In the lists marked warm it is the one whose bitmap is nearest to the majority of the list's: the text
    that copies were made from rather than one of the copies.
    """
    n = e["n"].astype(np.int64)
    near = np.flatnonzero(e["pos"] < n + (-2 * share[0] * n // (share[0] + share[1])) + 1)
    lead = first.copy()
    lists, at = np.unique(run[near], return_index=True)
    lead[lists] = near[at]
    ends = np.append(first[1:], len(run))
    for i in np.flatnonzero(warm):
        x, y = e["x"][first[i] : ends[i]], e["y"][first[i] : ends[i]]
        own = near[np.searchsorted(near, first[i]) : np.searchsorted(near, ends[i])]
        if len(own) and x.any():
            bits = np.unpackbits(np.stack((x, y), axis=1).view(np.uint8), axis=1)
            usual = bits.mean(axis=0) > 0.5
            lead[i] = own[np.argmin((bits[own - first[i]] != usual).sum(axis=1))]
    return lead


def runs_of(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First position of every run of equal keys, and the run of each position."""
    head = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
    return np.flatnonzero(head), np.cumsum(head) - 1


def ragged(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions of all ranges, given the start and the size of each."""
    size = size.astype(np.int64)
    return np.repeat(at - (np.cumsum(size) - size), size) + np.arange(size.sum())


def packed_entries(e: dict[str, np.ndarray]) -> bytes:
    """The ENTRY columns byte by byte of each number (the upper ones hardly differ), for Spark to compress."""
    return b"".join(np.ascontiguousarray(np.ascontiguousarray(e[c].astype(k)).view(np.uint8).reshape(-1, np.dtype(k).itemsize).T).tobytes() for c, k in ENTRY)


def unpacked_entries(rows: Iterator[tuple[int, bytes]]) -> dict[str, np.ndarray]:
    parts: dict[str, list[np.ndarray]] = {c: [np.zeros(0, k)] for c, k in ENTRY}
    for size, raw in rows:
        at = 0
        for c, k in ENTRY:
            width = np.dtype(k).itemsize
            parts[c].append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, width * size, at).reshape(width, size).T).view(k).ravel())
            at += width * size
    return {c: np.concatenate(v) for c, v in parts.items()}


def frequent(long: int) -> int:
    """The least class of rarity that a token of more than ``long`` sets may have."""
    return int(rarity(np.array([long + 1]))[0])


def seconds_of(use: np.ndarray, frequent: np.ndarray, n: np.ndarray, p: np.ndarray, pos: np.ndarray, at: np.ndarray, spread: np.ndarray, share: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """m of each entry, and the seconds of all: 16 bits of the tokens after the entry's own, up to the one after its prefix of p.

    use: whether seconds are wanted at all. If the first common token of two sets is the entry's, the
    second one is among them: at positions i of n tokens at most n - i - 1 can follow. With half of the
    tokens in common or less, sets may share a single one; there are no seconds then.
    """
    if not use or 2 * share[0] <= share[1]:
        return np.zeros(len(n), np.uint8), np.zeros(0, np.uint16)
    m = np.where(frequent, np.where(n <= MOST, p - pos, TOO_LARGE), 0)
    few = np.where(m < TOO_LARGE, m, 0)
    return m.astype(np.uint8), (spread[ragged(at + pos + 1, few)] & np.uint64(0xFFFF)).astype(np.uint16)


def candidate_pairs(sets: DataFrame, entries_of: Callable[[pd.DataFrame], Iterator[dict[str, np.ndarray]]], n_entries: int, share: tuple[int, int], hot: int, long: int = 512, a_bucket: int = 300_000, a_task: int = 300_000) -> DataFrame:
    """Pairs (PAIR) of sets that meet in a list and pass the filters.

    entries_of gives the ENTRY columns of sets (keys of 64 bits) and their ``seconds``. A pair is looked for from its smaller set,
    in the lists of the first n - ceil(2t / (1 + t) n) + 1 positions of that set. Given are
    the likeliest for each later set (by a, b; more = 1 if it has others), and the others packed in rows of
    more = -1.

    Lists grow with the input, and their pairs with its square. So in a list of more than ``long`` sets
    two sets meet only if they share a second token, one of the next few of both: the list is split into
    those of the seconds, which are shorter by the share of sets that a token is in. Sets of more than
    MOST tokens have no seconds (there would be half the square of their prefix); pairs with one of them
    are looked for in the list itself.

    Lists of more than ``hot`` sets that are no shorter for being split, or have a list of a second (or of sets
    near or above MOST tokens) with more than ``hot`` of them, are not expanded: their sets are paired with one of them, and
    the keys are told in rows of more = -2 (b1, in bucket a2 of b2). A task folds lists of more than ``hot`` before it deals them out, so that a list of
    any length sends one entry a task.
    """
    buckets = max(12, math.ceil(n_entries / a_bucket))

    def deal(held: list[dict[str, np.ndarray]]) -> Iterator[pd.DataFrame]:
        e = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
        seconds = e.pop("seconds")
        few = np.where(e["m"] < TOO_LARGE, e["m"], 0).astype(np.int64)
        e["at"] = np.cumsum(few) - few
        order = np.argsort(e["key"])
        e = {c: v[order] for c, v in e.items()}
        first, run = runs_of(e["key"])
        length = np.diff(np.append(first, len(run)))
        warm = length[run] > hot
        pairs, keys = b"", b""
        send = ~warm
        if warm.any():
            lead = _leads(e, run, first, share, length > hot)
            send[lead[length > hot]] = True
            at = np.flatnonzero(warm)
            at = at[_similar_at(e, lead[run[at]], at, share)]
            found = _Pairs(e)
            found.add(lead[run[at]], at)
            pairs = np.ascontiguousarray(found.named(np.unique(np.concatenate(found.codes)))).astype("<i8").tobytes()
            keys = e["key"][first[length > hot]].view(np.int64).astype("<i8")
        home = int(e["a"][0]) % buckets
        bucket = ((e["key"] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        chosen = np.flatnonzero(send)
        # Within a bucket in the order of the sets, whose numbers are alike then.
        chosen = chosen[np.argsort(bucket[chosen] * len(order) + order[chosen])]
        cuts = np.searchsorted(bucket[chosen], np.arange(buckets + 1))
        e = {c: v[chosen] for c, v in e.items()}
        few = np.where(e["m"] < TOO_LARGE, e["m"], 0)
        seconds = seconds[ragged(e["at"], few)]
        second_cuts = np.concatenate(([0], np.cumsum(few, dtype=np.int64)))[cuts]
        rows = []
        for x in range(buckets):
            mine = slice(cuts[x], cuts[x + 1])
            size = int(cuts[x + 1] - cuts[x])
            here = keys[(keys.view(np.uint64) >> np.uint64(32)) % np.uint64(buckets) == x].tobytes() if len(keys) else b""
            if size or here:
                rows.append((x, size, packed_entries({c: e[c][mine] for c, _ in ENTRY}), seconds[second_cuts[x] : second_cuts[x + 1]].astype("<u2").tobytes(), here, b""))
        if pairs:
            rows.append((home, 0, b"", b"", b"", pairs))
        yield pd.DataFrame(rows, columns=["bucket", "size", "entries", "seconds", "hot", "pairs"])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for pdf in batches:
            for e in entries_of(pdf):
                if len(e["key"]):
                    held.append(e)
                    size += len(e["key"])
                if size >= a_task:
                    yield from deal(held)
                    held, size = [], 0
        if held:
            yield from deal(held)

    def compared(e: dict[str, np.ndarray], found: _Pairs, shorter: np.ndarray, start: np.ndarray, upto: np.ndarray, other: np.ndarray, pos: np.ndarray, base: np.ndarray) -> None:
        """Adds the pairs of each row ``shorter`` with those from start to upto; rows stand for the entries ``other``, with tokens at ``pos``, after ``base`` common ones."""
        count = np.maximum(upto - start, 0)
        shorter, start, count = shorter[count > 0], start[count > 0], count[count > 0]
        ends, begin = np.cumsum(count), 0
        while begin < len(shorter):
            stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + 250_000, side="right")))
            c = count[begin:stop]
            i, j = np.repeat(shorter[begin:stop], c), ragged(start[begin:stop], c)
            one, two = other[i], other[j]
            keep = similar((e["n"][one], pos[i] - base, e["x"][one], e["y"][one], e["n"][two], pos[j] - base, e["x"][two], e["y"][two]), share) & (one != two)
            found.add(one[keep], two[keep])
            begin = stop

    def probes(n: np.ndarray) -> np.ndarray:
        """The size of the prefix from which a set looks for larger ones."""
        return n + (-2 * share[0] * n // (share[0] + share[1])) + 1

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        e = unpacked_entries(zip(pdf["size"], pdf["entries"]))
        seconds = np.frombuffer(b"".join(pdf["seconds"]), "<u2")
        few = np.where(e["m"] < TOO_LARGE, e["m"], 0).astype(np.int64)
        e["at"] = np.cumsum(few) - few
        # Sorted by size within a list. Few tokens share a key; those with and without seconds don't share a list.
        key = (e["key"].astype(np.uint64) << np.uint64(1)) | (e["m"] > 0)
        order = np.argsort((key << np.uint64(31)) | e["n"].astype(np.uint64))
        e, key = {c: v[order] for c, v in e.items()}, key[order]
        first, run = runs_of(key)
        ends = np.append(first[1:], len(run))
        length = ends - first
        n = e["n"].astype(np.int64)
        scale = np.int64(1) << 31
        begins = lambda least: np.searchsorted(run * scale + n, np.arange(len(first)) * scale + least)
        told = np.isin(e["key"][first], np.frombuffer(b"".join(pdf["hot"]), "<i8").view(np.uint64).astype(np.uint32))
        split = (e["m"][first] > 0) & (length > long) & ~told if len(first) else np.zeros(0, bool)
        # Pairs with a set that has no seconds: of one that may be as small as the share allows.
        warm = told | (length > hot) & (~split | (ends - begins(-(-share[0] * MOST // share[1])) > hot))
        split &= ~warm
        found, keys = _Pairs(e), []
        some = np.flatnonzero(split[run] & (e["m"] < TOO_LARGE))
        made = np.cumsum(e["m"][some].astype(np.int64))
        begin = 0
        while begin < len(some):  # whole lists, of some 500,000 seconds
            stop = int(np.searchsorted(made, (made[begin - 1] if begin else 0) + 500_000, side="right"))
            stop = int(np.searchsorted(run[some], run[some[min(max(stop, begin + 1), len(some)) - 1]], side="right"))
            mine = some[begin:stop]
            begin = stop
            m = e["m"][mine].astype(np.int64)
            owner, pos = np.repeat(mine, m), ragged(e["pos"][mine].astype(np.int64) + 1, m)
            code = (run[owner] << 16) | seconds[ragged(e["at"][mine], m)]
            order = np.argsort((code << 8) | n[owner])
            owner, pos, code = owner[order], pos[order], code[order]
            head, sub = runs_of(code)
            size = np.diff(np.append(head, len(code)))
            # Sets that are alike share many tokens: their list is not split if that makes no fewer pairs.
            cost = np.bincount(run[owner[head]], size.astype(float) ** 2, len(first))
            most = np.zeros(len(first), np.int64)
            np.maximum.at(most, run[owner[head]], size)
            whole = split & ((cost >= length.astype(float) ** 2) | (most > hot) & (length > hot))
            split &= ~whole
            warm |= whole & (length > hot)
            sized = sub << 8 | n[owner]
            look = np.flatnonzero((size[sub] > 1) & split[run[owner]] & (e["pos"][owner] < probes(n[owner])) & (pos <= probes(n[owner])))
            upto = np.searchsorted(sized, (sub[look] << 8) + np.minimum(n[owner[look]] * share[1] // share[0], 255), side="right")
            compared(e, found, look, look + 1, upto, owner, pos, np.int64(1))
        if warm.any():
            lead, at = _leads(e, run, first, share, warm), np.flatnonzero(warm[run])
            at = at[_similar_at(e, lead[run[at]], at, share)]
            found.add(lead[run[at]], at)
            keys = [(0, int(k), int(pdf["bucket"].iloc[0]), buckets, -2, None) for k in e["key"][first[warm]]]
        # The shorter line first, up to the size that t allows; in lists that were split only those without seconds.
        shorter = np.flatnonzero(~warm[run] & (e["pos"] < probes(n)))
        upto = np.searchsorted(run * scale + n, run[shorter] * scale + n[shorter] * share[1] // share[0], side="right")
        start = np.maximum(shorter + 1, np.where(split, begins(MOST + 1), 0)[run[shorter]])
        compared(e, found, shorter, start, upto, np.arange(len(run)), e["pos"].astype(np.int64), np.int64(0))
        best, more, rest = found.best()
        stars = [np.frombuffer(p, "<i8").reshape(4, -1) for p in pdf["pairs"] if p]
        if stars:
            stars = np.concatenate(stars, axis=1)
            best, more = np.concatenate((best, stars), axis=1), np.concatenate((more, np.zeros(stars.shape[1], np.int64)))
        rows = pd.DataFrame(best.T, columns=["a1", "b1", "a2", "b2"]).assign(more=more, rest=None)
        if rest.shape[1]:
            keys.append((0, 0, 0, 0, -1, np.ascontiguousarray(rest).tobytes()))
        return pd.concat([rows, pd.DataFrame(keys, columns=rows.columns)]) if keys else rows

    dealt = sets.mapInPandas(lambda b: trimmed(fold(b)), "bucket long, size long, entries binary, seconds binary, hot binary, pairs binary")
    return dealt.groupBy("bucket").applyInPandas(lambda pdf: pd.concat(trimmed([merge(pdf)])), PAIR)


def components(edges: DataFrame, save: Callable[[DataFrame, str], DataFrame], rounds: int = 60) -> DataFrame:
    """Smallest id reachable from each id on edges (u, v): columns id, label. Labels spread along edges and jump to their own labels."""
    both = save(edges.select("u", "v").union(edges.select("v", "u").toDF("u", "v")).where("u <> v").distinct(), "edges")
    labels = save(both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.col("id")).alias("label")), "labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("id").alias("v"), F.col("label").alias("near")), "v").groupBy(F.col("u").alias("id")).agg(F.min("near").alias("near"))
        moved = labels.join(near, "id").select("id", F.least("label", "near").alias("new"), "label")
        jump = moved.select(F.col("id").alias("new"), F.col("new").alias("jump"))
        moved = save(moved.join(jump, "new", "left").select("id", F.least("new", F.coalesce("jump", "new")).alias("label"), F.col("label").alias("old")), "labels")
        changed = moved.where("label < old").limit(1).count()
        labels = moved.select("id", "label")
        if not changed:
            return labels
    raise RuntimeError("components did not settle")


def shared_tokens(sets: DataFrame, hashes: Callable[[pd.DataFrame], Iterator[tuple[np.ndarray, np.ndarray]]], n_tokens: int, a_bucket: int = 300_000, a_task: int = 500_000) -> DataFrame:
    """How many tokens of each set (doc_id: long) are in another set too: doc_id, m. Sets without any are left out.

    hashes gives the distinct token hashes of chunks of sets and the doc_id of each. A task sends every
    hash once, as 32 bits within its bucket; a hash that it has met twice itself is credited on the spot
    and sent without an owner, so a token in any number of sets sends one entry a task. Two hashes that
    share those bits can only raise m, by one in several thousand tokens at any size of the input.
    """
    buckets = max(12, math.ceil(n_tokens / a_bucket))
    parts = max(12, buckets // 4)

    def deal(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pd.DataFrame]:
        h = np.concatenate([x[0] for x in held])
        ids, owner = np.unique(np.concatenate([x[1] for x in held]), return_inverse=True)
        order = np.argsort(h)
        h, owner = h[order], owner[order]
        edge = h[1:] == h[:-1]
        again = np.concatenate(([False], edge)) | np.concatenate((edge, [False]))
        lead = again & np.concatenate(([True], ~edge))
        own = np.bincount(owner[again], minlength=len(ids))
        bucket = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        low = h.astype(np.uint32)
        out = []
        named = np.flatnonzero(~again)
        named = named[np.argsort(bucket[named] * len(ids) + owner[named])]
        free = np.flatnonzero(lead)
        free = free[np.argsort(bucket[free], kind="stable")]
        cuts, free_cuts = np.searchsorted(bucket[named], np.arange(buckets + 1)), np.searchsorted(bucket[free], np.arange(buckets + 1))
        for x in range(buckets):
            mine, loose = named[cuts[x] : cuts[x + 1]], free[free_cuts[x] : free_cuts[x + 1]]
            if len(mine) or len(loose):
                who, count = np.unique(owner[mine], return_counts=True)
                out.append((x, low[mine].tobytes(), ids[who].astype(np.int64).tobytes(), count.astype(np.uint32).tobytes(), low[loose].tobytes(), b"", b""))
        some = np.flatnonzero(own)
        if len(some):
            out.append((int(ids[some[0]]) % buckets, b"", b"", b"", b"", ids[some].astype(np.int64).tobytes(), own[some].astype(np.uint32).tobytes()))
        yield pd.DataFrame(out, columns=["bucket", "hashes", "ids", "counts", "free", "done", "done_counts"])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for pdf in batches:
            for h, ids in hashes(pdf):
                if len(h):
                    held.append((h, ids))
                    size += len(h)
                if size >= a_task:
                    yield from deal(held)
                    held, size = [], 0
        if held:
            yield from deal(held)

    def added(ids: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, where = np.unique(ids, return_inverse=True)
        return ids.astype(np.int64), np.bincount(where, weights=weight, minlength=len(ids)).astype(np.int64)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        def all_of(column: str, kind: type) -> np.ndarray:
            return np.frombuffer(b"".join(pdf[column]), kind)

        h, owner = all_of("hashes", np.uint32), np.repeat(all_of("ids", np.int64), all_of("counts", np.uint32))
        free = all_of("free", np.uint32)
        _, which, count = np.unique(np.concatenate((h, free)), return_inverse=True, return_counts=True)
        found = owner[count[which[: len(h)]] > 1]
        ids = np.concatenate((found, all_of("done", np.int64)))
        weight = np.concatenate((np.ones(len(found), np.int64), all_of("done_counts", np.uint32).astype(np.int64)))
        ids, count = added(ids, weight)
        part = (mix(ids.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        rows = [(x, ids[mine].tobytes(), count[mine].tobytes()) for x in range(parts) if len(mine := order[cuts[x] : cuts[x + 1]])]
        return pd.DataFrame(rows, columns=["part", "ids", "counts"])

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, count = added(np.frombuffer(b"".join(pdf["ids"]), np.int64), np.frombuffer(b"".join(pdf["counts"]), np.int64))
        return pd.DataFrame({"doc_id": ids, "m": count})

    dealt = sets.mapInPandas(lambda b: trimmed(fold(b)), "bucket long, hashes binary, ids binary, counts binary, free binary, done binary, done_counts binary")
    # The counts of a bucket go on in packed parts, so that a set takes no row of its own for each bucket.
    counted = dealt.groupBy("bucket").applyInPandas(lambda pdf: pd.concat(trimmed([merge(pdf)])), "part long, ids binary, counts binary")
    return counted.groupBy("part").applyInPandas(total, "doc_id long, m long")
