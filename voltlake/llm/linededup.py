"""Line dedup by an exact set-similarity join over the lines of all documents.

A line is the set of its words, ordered from rare to frequent. Of two lines of similarity t the shorter
has a token among its first n - ceil(2t / (1 + t) n) + 1 that is among the first n - ceil(t n) + 1 of the
longer (prefix filter); sizes must be within t of each other (length filter); after a common token at
positions i and j at most min(n1 - i, n2 - j) tokens can be shared (positional filter), and no more than
half of what both sizes leave after the odd bits of two bitmaps of the sets. What is left is verified on
the full sets. A line that is similar to an earlier line, by (doc_id, place), is removed. Sets so small
that only an equal one is similar (of one or two words) are in no list.

Equal lines are joined by a hash aggregate first. The lists of the tokens are dealt out in blocks of
columns and joined with numpy; in long lists only lines that share a second token are compared. One match removes a line, so in each block a line is first verified
against the likeliest of its earlier candidates; only if that fails are the others. A list that grows
beyond ``hot`` lines is not expanded: its lines are compared with one of them, then those left with the
earliest of them, until a round removes few; only what is still left is compared with all earlier lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, saved, small, trimmed
from .lists import Counts, candidate_pairs, distinct_sorted, frequent, least_overlap, rarity, seconds_of, sum_by, summed, tokens
from .textvec import chunks, mix, word_hashes

_SALT = np.uint64(0x51ED270B9F2C4A3D)
#: Without the class of rarity.
_LOW = np.uint64((1 << 56) - 1)
#: A class of equal lines: a hash of the set, and the first line.
CLASS = [("d", "<u8"), ("a", "<i8"), ("b", "<i8")]
#: A line's place: 24 bits of its text's hash (parts rows of one doc_id), then its number.
LINE_BITS = 32
#: Numbers of 64 bits in the larger bitmaps, for lists that were not expanded.
WIDE = 8


def _odd_by(x: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, x.dtype), np.bitwise_xor.accumulate(x)))
    return total[at + n] ^ total[at]


def _lines(pdf: pd.DataFrame, classes: np.ndarray | None, only: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
    """For every chunk of texts: row and place of each line with words, its tokens (ascending), sizes and first positions.

    classes: of rarity; without, tokens are plain hashes. only: just the lines whose numbers are in the column places.
    """
    texts, mark = pdf["text"].tolist(), pdf["mark"].to_numpy()
    for start, end in chunks(texts):
        h, doc, line = word_hashes(texts[start:end])
        if not len(h):
            continue
        new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (line[1:] != line[:-1])))
        group = np.cumsum(new) - 1
        row, place = doc[new] + start, (mark[doc[new] + start] << LINE_BITS) | line[new]
        if only:
            listed = pdf["places"].iloc[start:end]
            named = np.repeat(np.arange(start, end), [len(p) for p in listed]) << LINE_BITS | np.concatenate(list(listed)).astype(np.int64)
            chosen = np.isin(row << LINE_BITS | line[new], named)
            h, group = h[chosen[group]], (np.cumsum(chosen) - 1)[group[chosen[group]]]
            row, place = row[chosen], place[chosen]
            if not len(h):
                continue
        t, group = distinct_sorted(h if classes is None else tokens(h, classes), group)
        n = np.bincount(group, minlength=len(row))
        yield row, place, t, n, np.cumsum(n) - n


def _sums(t: np.ndarray, at: np.ndarray, n: np.ndarray, salt: np.uint64 = np.uint64(0)) -> np.ndarray:
    """A hash of each set, from 56 bits of its tokens."""
    return sum_by(mix(t ^ salt), at, n)


def _entries(pdf: pd.DataFrame, classes: np.ndarray, share: tuple[int, int], known: np.ndarray, wide: bool = False, least: int = 0) -> Iterator[dict[str, np.ndarray]]:
    """The entries of the prefix tokens of all lines but the later ones of the classes in known; keys still have 64 bits.

    wide: with larger bitmaps too, and without seconds; the others have them if the token's class is ``least`` or more.
    """
    for row, place, t, n, at in _lines(pdf, classes):
        if len(known):
            d = _sums(t & _LOW, at, n)
            first = known[np.minimum(np.searchsorted(known["d"], d), len(known) - 1)]
            fresh = (first["d"] != d) | (first["a"] == pdf["doc_id"].to_numpy()[row]) & (first["b"] == place)
            if not fresh.any():
                continue
            t, row, place, n = t[np.repeat(fresh, n)], row[fresh], place[fresh], n[fresh]
            at = np.cumsum(n) - n
        spread = mix(t ^ _SALT)
        bit = np.uint64(1) << (spread >> np.uint64(58))
        half = (spread >> np.uint64(57)) & np.uint64(1) == 1
        x, y = _odd_by(np.where(half, bit, np.uint64(0)), at, n), _odd_by(np.where(half, np.uint64(0), bit), at, n)
        part = (spread >> np.uint64(48)) & np.uint64(WIDE - 1)
        more = {f"w{i}": _odd_by(np.where(part == i, bit, np.uint64(0)), at, n) for i in range(WIDE if wide else 0)}
        use = np.flatnonzero((least_overlap(n, share) < n) | (n * share[1] // share[0] > n))
        p = n[use] - least_overlap(n[use], share) + 1
        pos = np.arange(p.sum()) - np.repeat(np.cumsum(p) - p, p)
        line = np.repeat(use, p)
        m, seconds = seconds_of(not wide, t[at[line] + pos] >> np.uint64(56) >= np.uint64(least), n[line], np.repeat(p, p), pos, at[line], spread, share)
        yield {"m": m, "seconds": seconds, "key": mix(t[at[line] + pos]), "a": pdf["doc_id"].to_numpy()[row[line]], "b": place[line], "n": n[line], "pos": pos, "x": x[line], "y": y[line]} | {c: v[line] for c, v in more.items()}


def _largest(copies: DataFrame, most: int) -> np.ndarray:
    """The classes of more than one line, sorted by hash; of more than ``most`` those of the most lines."""
    several = copies.where("size > 1")
    sizes = sorted(several.groupBy(F.least("size", F.lit(1 << 10)).alias("size")).count().collect(), reverse=True)
    least, total = 1 << 11, 0
    for size, count in sizes:
        total += count
        if total > most:
            break
        least = size

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"t": [np.rec.fromarrays([pdf["d1"].to_numpy(np.int64).view(np.uint64), pdf["a"], pdf["b"]], dtype=CLASS).tobytes()]})

    rows = several.where(F.least("size", F.lit(1 << 10)) >= least).select("d1", "a", "b").mapInPandas(packed, "t binary").collect() if least <= 1 << 10 else []
    found = np.frombuffer(b"".join(r.t for r in rows), CLASS)
    return found[np.argsort(found["d"])]


def similar_lines(docs: DataFrame, share: tuple[int, int] = (75, 100), hot: int = 2000, long: int = 512, rounds: int = 8, few_left: int = 50, classes_bytes: int = BROADCAST_BYTES // 2) -> DataFrame:
    """The lines to remove from docs (doc_id: long, text, mark): doc_id, mark and lines (their numbers, from 0)."""

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = Counts()
        for pdf in batches:
            for row, place, t, n, at in _lines(pdf, None):
                counts.add(t)
                low = t >> np.uint64(8)
                d1, d2 = _sums(low, at, n).view(np.int64), _sums(low, at, n, _SALT).view(np.int64)
                yield pd.DataFrame({"a": pdf["doc_id"].to_numpy()[row], "b": place, "n": n, "d1": d1, "d2": d2, "t": None})
        yield pd.DataFrame({"a": [0], "b": [0], "n": [0], "d1": [0], "d2": [0], "t": [counts.packed()]})

    described = saved(docs.mapInPandas(lambda b: trimmed(describe(b)), "a long, b long, n long, d1 long, d2 long, t binary"), "lines")
    lines = described.where("t is null").drop("t")
    # A word counts once a line here, in equal lines too.
    shared = docs.sparkSession.sparkContext.broadcast(rarity(summed(described.where("t is not null").select("t"))))
    copies = saved(lines.groupBy("d1", "d2").agg(F.min(F.struct("a", "b")).alias("first"), F.max("n").alias("n"), F.count("*").alias("size")).select("d1", "d2", "first.*", "n", "size"), "firsts")
    n_entries = copies.agg(F.sum(F.col("n") - F.ceil(F.col("n") * share[0] / share[1]) + 1)).first()[0] or 0
    firsts = copies.select("d1", "d2", F.col("a").alias("a0"), F.col("b").alias("b0"))
    low = F.col("b").bitwiseAND(F.lit((1 << LINE_BITS) - 1))
    by_doc = lambda df: df.groupBy(F.col("a").alias("_a"), F.shiftright("b", LINE_BITS).alias("_mark")).agg(F.collect_list(low).alias("places"))

    def with_places(places: DataFrame) -> DataFrame:
        size = places.agg(F.count("*"), F.sum(F.size("places"))).first()
        places = small(places, 1, 64 * size[0] + 8 * (size[1] or 0))
        return docs.join(places, (docs["doc_id"] == places["_a"]) & (docs["mark"] == places["_mark"])).select("doc_id", "text", "mark", "places")

    lines = saved(lines.join(firsts, ["d1", "d2"]).select("a", "b", "a0", "b0"), "classes")
    # Of equal lines only the first need be in the lists. The largest classes are told to all tasks; where others of
    # an equal set come up, they are compared like any lines, which changes no result: what is similar to one is
    # similar to the first.
    known = docs.sparkSession.sparkContext.broadcast(_largest(copies, classes_bytes // np.dtype(CLASS).itemsize))
    least_class = frequent(long)
    found = saved(candidate_pairs(docs, lambda pdf: _entries(pdf, shared.value, share, known.value, least=least_class), int(n_entries), share, hot, long), "pairs")
    ids = ["a1", "b1", "a2", "b2"]
    pairs, packed, keys = found.where("more >= 0"), found.where("more = -1"), found.where("more = -2")

    def sets_of(named: DataFrame) -> DataFrame:
        chosen = with_places(saved(by_doc(named), "met"))

        def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for row, place, t, n, at in _lines(pdf, None, only=True):
                    yield pd.DataFrame({"a": pdf["doc_id"].to_numpy()[row], "b": place, "set": [t[i : i + m].view(np.int64) for i, m in zip(at, n)]})

        return saved(chosen.mapInPandas(lambda b: trimmed(whole(b)), "a long, b long, set array<long>"), "sets")

    def matched(pairs: DataFrame, full: DataFrame | None = None) -> DataFrame:
        if full is None:
            full = sets_of(pairs.select(F.col("a1").alias("a"), F.col("b1").alias("b")).union(pairs.select("a2", "b2")).distinct())
        compared = pairs.join(full.toDF("a1", "b1", "s1"), ["a1", "b1"]).join(full.toDF("a2", "b2", "s2"), ["a2", "b2"])
        compared = compared.select("a2", "b2", (F.size("s1") + F.size("s2")).alias("both"), F.size(F.array_intersect("s1", "s2")).alias("common"))
        return compared.where(F.col("common") * share[1] >= (F.col("both") - F.col("common")) * share[0]).select(F.col("a2").alias("a"), F.col("b2").alias("b")).distinct()

    best = pairs.select(*ids).distinct()
    gone = saved(matched(best), "gone")
    # Lines that did not match their likeliest candidate but have others.
    open_lines = saved(pairs.where("more = 1").select(F.col("a2").alias("a"), F.col("b2").alias("b")).distinct().join(gone, ["a", "b"], "left_anti"), "open")
    n_open = open_lines.count()
    if n_open:
        few = 16 * n_open <= BROADCAST_BYTES
        named = docs.sparkSession.sparkContext.broadcast(np.sort(np.ascontiguousarray(open_lines.toPandas().to_numpy(np.int64)).view([("a", np.int64), ("b", np.int64)]).ravel()) if few else None)

        def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for raw in pdf["rest"]:
                    rest = np.frombuffer(raw, np.int64).reshape(4, -1)
                    if named.value is not None:
                        later = np.ascontiguousarray(rest[2:].T).view([("a", np.int64), ("b", np.int64)]).ravel()
                        rest = rest[:, named.value[np.minimum(np.searchsorted(named.value, later), len(named.value) - 1)] == later]
                    yield pd.DataFrame(rest.T, columns=ids)

        others = packed.select("rest").mapInPandas(unpack, "a1 long, b1 long, a2 long, b2 long")
        if not few:
            others = others.join(open_lines.toDF("a2", "b2"), ["a2", "b2"], "left_semi").select(*ids)
        others = saved(others.distinct().join(best, ids, "left_anti"), "pairs")
        gone = saved(gone.union(matched(others)).distinct(), "gone")
    n_hot = keys.count()
    if n_hot:

        def hot_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for e in _entries(pdf, shared.value, share, known.value, wide=True):
                    low = e["key"].astype(np.uint32).astype(np.int64)
                    use = np.flatnonzero(np.isin(low, wanted.value)) if wanted.value is not None else np.arange(len(low))
                    bucket = ((e["key"][use] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                    yield pd.DataFrame({"bucket": bucket, "low": low[use]} | {c: e[c][use].astype(np.int64) for c in ("a", "b", "n", "pos")} | {c: e[c][use].view(np.int64) for c in bits})

        bits = [f"w{i}" for i in range(WIDE)]
        buckets = keys.first()["b2"]
        wanted = docs.sparkSession.sparkContext.broadcast(np.sort(keys.select("b1").toPandas()["b1"].to_numpy(np.int64)) if 8 * n_hot <= BROADCAST_BYTES else None)
        named = small(keys.select(F.col("b1").alias("low"), F.col("a2").alias("bucket")), n_hot, 24)
        rows = docs.mapInPandas(lambda b: trimmed(hot_rows(b)), "bucket long, low long, a long, b long, n long, pos long, " + ", ".join(f"{c} long" for c in bits))
        rows = saved(rows.join(named, ["bucket", "low"], "left_semi"), "hot")
        full = sets_of(rows.select("a", "b").distinct())
        cols = ["a", "b", "n", "pos", *bits]
        both = F.col("n1") + F.col("n2")
        least = F.ceil(both * share[0] / (share[0] + share[1]))
        odd = sum((F.bit_count(F.col(f"{c}1").bitwiseXOR(F.col(f"{c}2"))) for c in bits), F.lit(0))
        fits = (F.col("n1") * share[1] >= F.col("n2") * share[0]) & (F.col("n2") * share[1] >= F.col("n1") * share[0])
        fits = fits & (F.least(F.col("n1") - F.col("pos1"), F.col("n2") - F.col("pos2")) >= least) & ((both - odd) / 2 >= least)
        fits = fits & ((F.col("a1") < F.col("a2")) | ((F.col("a1") == F.col("a2")) & (F.col("b1") < F.col("b2"))))

        def candidates(earlier: DataFrame) -> DataFrame:
            later = rows.join(gone, ["a", "b"], "left_anti").select("bucket", "low", *[F.col(c).alias(f"{c}2") for c in cols])
            earlier = earlier.select("bucket", "low", *[F.col(c).alias(f"{c}1") for c in cols])
            return saved(later.join(earlier, ["bucket", "low"]).where(fits).select(*ids).distinct(), "pairs")

        # A list may hold several groups: the earliest line that is left in it leads one group after the other.
        for _ in range(rounds):
            leads = rows.join(gone, ["a", "b"], "left_anti").groupBy("bucket", "low").agg(F.min(F.struct(*cols)).alias("lead")).select("bucket", "low", "lead.*")
            more = saved(matched(candidates(leads), full), "gone")
            n_more = more.count()
            gone = saved(gone.union(more).distinct(), "gone")
            if n_more < few_left:
                break
        gone = saved(gone.union(matched(candidates(rows), full)).distinct(), "gone")

    marked = small(gone.select(F.col("a").alias("a0"), F.col("b").alias("b0"), F.lit(True).alias("gone")), gone.count(), 32)
    removed = lines.join(marked, ["a0", "b0"], "left").where("gone or a <> a0 or b <> b0")
    return by_doc(removed).select(F.col("_a").alias("doc_id"), F.col("_mark").alias("mark"), F.array_distinct("places").alias("lines"))


def _without(text: str, gone: str) -> Column:
    """The lines of a text but those whose numbers (from 0, distinct) are in gone, in time linear in both."""
    lines = F.split(text, "\n", -1)
    # Numbers in order, with ends on both sides: what lies between two neighbours stays.
    bounds = lambda size: F.concat(F.array(F.lit(-1).cast("long")), F.array_sort(gone), F.array(size.cast("long")))
    between = lambda all_, at: F.zip_with(F.slice(at, F.lit(1), F.size(at) - 1), F.slice(at, F.lit(2), F.size(at) - 1), lambda a, b: F.slice(all_, (a + 2).cast("int"), (b - a - 1).cast("int")))
    one = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    return one(lines, lambda all_: one(bounds(F.size(all_)), lambda at: F.flatten(between(all_, at))))


def dedup_lines(docs: DataFrame, share: tuple[int, int] = (75, 100), hot: int = 2000, long: int = 512) -> DataFrame:
    """Removes from docs (doc_id: an integer, text) every line whose words are similar to an earlier line's.

    Similar: Jaccard similarity of the sets of words ([^\\x20\\x09-\\x0D]+) >= share[0] / share[1]. Earlier: of
    a smaller doc_id, or higher up in the same document. Lines without words are neither compared nor
    removed, all others are, however short or long. Words are kept as 56-bit hashes.

    Returns docs' rows: doc_id, text (without those lines), n_lines and n_removed, and docs' other columns.

    Null text stays null, with 0 lines. Rows of null doc_id come out as they are, and no line is compared
    with theirs. docs' other columns may have any names (own n_lines and n_removed are replaced). Rows of the same doc_id and text are one document to each other
    and come out alike; rows of one doc_id with different texts are parted by a hash of the text, which
    also orders them. An empty table gives no rows.
    """
    kind = dict(docs.dtypes)["doc_id"]
    mark = F.pmod(F.xxhash64("text"), F.lit(1 << 24))
    base = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("mark", mark)
    removed = saved(similar_lines(base, share, hot, long), "removed")
    size = removed.agg(F.count("*"), F.sum(F.size("lines"))).first()
    removed = small(removed, 1, 48 * size[0] + 8 * (size[1] or 0))
    # docs' own columns travel in a struct, so that none of them clashes with a name used here.
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    rows = rows.select("doc", F.col("doc")["doc_id"].cast("long").alias("doc_id"), F.col("doc")["text"].cast("string").alias("text"))
    joined = rows.withColumn("mark", mark).join(removed, ["doc_id", "mark"], "left")
    # Lines to keep are the runs between those that go, so that a text is cut at its removed lines only, in one pass over both.
    kept = F.array_join(_without("text", "lines"), "\n")
    text = F.when(F.col("lines").isNull(), F.col("text")).otherwise(kept)
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    n_lines = F.coalesce(breaks + 1, F.lit(0)).cast("long")
    others = [F.col("doc")[c].alias(c) for c in docs.columns if c not in ("doc_id", "text", "n_lines", "n_removed")]
    return joined.select(F.col("doc_id").cast(kind).alias("doc_id"), text.alias("text"), n_lines.alias("n_lines"), F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_removed"), *others)
