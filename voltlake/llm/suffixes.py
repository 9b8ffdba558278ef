"""Removal of byte strings that occur more than once in a corpus, by distributed prefix doubling.

A start of a string of ``least`` bytes has a rank among all starts. Ranks of 8 bytes are given at once; ranks of
twice as many bytes are those of pairs (rank at p, rank at p + h), at offsets h = 8, 16, 32, ... A rank is a
64-bit name that equal strings share in every task, so pairs are named where the text is, and only what must
be compared is moved. Names have no order among strings: instead of sorting all pairs (rank, rank at the offset),
which would move some 16 bytes for each byte of text and round, Spark counts equal names by hash aggregates.
Starts whose rank is unique leave, the rest are ranked again with more bytes, until the threshold is passed.

Starts are not moved one by one. All windows of ``least`` bytes whose first smallest rank of ``anchor`` bytes stands
at the same place form a block of neighbouring starts (at most least - anchor + 1). All of them contain the
block's core (its last start to its first end) and lie in its hull (its first start to its last end):
* a core that occurs once: no start of the block is repeated, and the block leaves;
* a hull that occurs again: every start is repeated, and the block is settled;
* otherwise the block is cut into smaller ones, aligned at the anchor, whose cores are longer, for the next round.
In the last round a block is one start, whose core and hull are the string itself. Of settled blocks whose core still
occurs in open ones, one for each hull stays in the rounds, for the open ones to meet.

Nothing is broadcast or gathered: the joins are the same shuffles at every size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, trimmed
from .textvec import mix

_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Starts ranked at once in a task; longer texts are ranked in pieces that overlap.
PIECE = 1 << 18
FIRST_ROWS = "core long, hull long, key long, at int, n int, anchor int, times int"
SMALLER_ROWS = "core long, hull long, key long, of int, at int, n int"


def _pair(x: np.ndarray, offset: int) -> np.ndarray:
    """Names of the pairs (name at p, name at p + offset)."""
    y = x * _P
    y[: len(y) - offset] += x[offset:]
    return mix(y)


def _power(size: int) -> int:
    return 1 << (size.bit_length() - 1)


def _ranks(buf: bytes, sizes: set[int]) -> dict[int, np.ndarray]:
    """Names of the strings of each of sizes (8 bytes at least) at every place, by doubling; past the end they are of no use."""
    x = mix(np.ndarray((len(buf),), "<u8", buffer=buf + b"\0" * 8, strides=(1,)) * _P)
    at, powers = 8, {8: x}
    while 2 * at <= max(sizes):
        x, at = _pair(x, at), 2 * at
        powers[at] = x
    return {s: powers[s] if s in powers else _pair(powers[_power(s)], s - _power(s)) for s in sizes}


def _hulls(rank: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Names of the hulls of blocks, by the ranks of their first and last windows, which overlap."""
    return mix(rank[first] * _P + rank[last] * _Q + (last - first).astype(np.uint64))


def _smallest(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each width neighbours, from every place on."""
    n = len(x)
    rows = np.full(-(-n // width) * width + width, np.iinfo(np.uint64).max, np.uint64)
    rows[:n] = x
    rows = rows.reshape(-1, width)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : n + width - 1])


def _places(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n[i] places from at[i] on, for all i."""
    return np.arange(n.sum()) + np.repeat(at - (np.cumsum(n) - n), n)


def _pieces(texts: list[bytes], least: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Pieces of the texts that have windows, about PIECE bytes at a time: bytes, row and offset in its text of each."""
    held, row, off, size = [], [], [], 0
    for i, t in enumerate(texts):
        for o in range(0, len(t) - least + 1, PIECE):
            piece = t[o : o + PIECE + least - 1]
            held.append(piece)
            row.append(i)
            off.append(o)
            size += len(piece)
            if size >= PIECE:
                yield held, np.array(row), np.array(off)
                held, row, off, size = [], [], [], 0
    if held:
        yield held, np.array(row), np.array(off)


def _blocks(texts: list[bytes], least: int, anchor: int, with_hulls: bool) -> Iterator[dict[str, np.ndarray]]:
    """The first round's blocks: row, core, hull, first start (at), number of starts (n) and place of the anchor."""
    for held, row, off in _pieces(texts, least):
        size = np.array([len(h) for h in held])
        begin = np.cumsum(size) - size
        ranks = _ranks(b"".join(held), {anchor, least} if with_hulls else {anchor})
        core = ranks[anchor]
        # The upper half of the rank, then the place: equal halves are told apart by what comes first.
        first = _smallest((core & np.uint64(0xFFFFFFFF << 32)) | np.arange(len(core), dtype=np.uint64), least - anchor + 1)
        p = _places(begin, size - least + 1)
        a = (first[p] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1))))
        last = np.append(new[1:], len(p)) - 1
        s, e, a = p[new], p[last], a[new]
        piece = np.searchsorted(begin, s, side="right") - 1
        shift = off[piece] - begin[piece]
        yield {"row": row[piece], "core": core[a], "at": s + shift, "n": e - s + 1, "anchor": a + shift} | ({"hull": _hulls(ranks[least], s, e)} if with_hulls else {})


def _distinct(pdf: pd.DataFrame) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Different texts of a batch: keys, bytes, and how often each occurs in it."""
    key, first, times = np.unique(pdf["key"].to_numpy(), return_index=True, return_counts=True)
    return key, [t.encode() for t in pdf["text"].iloc[first]], times


def _first_cores(texts: DataFrame, least: int, anchor: int) -> DataFrame:
    """(core, times) of the first round, summed within pieces."""

    def cores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            _, raw, times = _distinct(pdf)
            for b in _blocks(raw, least, anchor, False):
                core, inverse = np.unique(b["core"], return_inverse=True)
                yield pd.DataFrame({"core": core.view(np.int64), "times": np.bincount(inverse, times[b["row"]]).astype(np.int64)})

    return texts.mapInPandas(lambda b: trimmed(cores(b)), "core long, times long")


def _first_rows(texts: DataFrame, least: int, anchor: int) -> DataFrame:
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            key, raw, times = _distinct(pdf)
            for b in _blocks(raw, least, anchor, True):
                row, core, hull = b["row"], b["core"].view(np.int64), b["hull"].view(np.int64)
                yield pd.DataFrame({"core": core, "hull": hull, "key": key[row], "at": b["at"], "n": b["n"], "anchor": b["anchor"], "times": times[row]})

    return texts.mapInPandas(lambda b: trimmed(rows(b)), FIRST_ROWS)


def _smaller_rows(opened: DataFrame, least: int, block: int) -> DataFrame:
    """Blocks of at most block starts of opened (key, at, n, anchor, raw: bytes of the hull; parts: ranges of starts (at, n) to cut, null: all)."""
    inner = least - block + 1

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 1000):
                part = pdf.iloc[lo : lo + 1000]
                raw = part["raw"].tolist()
                size = np.array([len(r) for r in raw])
                begin = np.cumsum(size) - size
                ranks = _ranks(b"".join(raw), {inner, least})
                at, n = part["at"].to_numpy(np.int64), part["n"].to_numpy(np.int64)
                who = np.arange(len(part))
                if part["parts"].iloc[0] is not None:
                    ranges = [(i, r["at"], r["n"]) for i, rs in enumerate(part["parts"]) for r in rs]
                    who, start, n = np.array(ranges, np.int64).T
                    start = begin[who] + start - at[who]
                else:
                    start = begin
                p, who = _places(start, n), np.repeat(who, n)
                a = (begin + part["anchor"].to_numpy(np.int64) - at)[who]
                j = (a - p) // block
                new = np.flatnonzero(np.concatenate(([True], (j[1:] != j[:-1]) | (p[1:] != p[:-1] + 1))))
                last = np.append(new[1:], len(p)) - 1
                s, e, who, a, j = p[new], p[last], who[new], a[new], j[new]
                core = mix(ranks[inner][a - block * j] + j.astype(np.uint64)) if block > 1 else ranks[least][s]
                shift = at[who] - begin[who]
                yield pd.DataFrame({"core": core.view(np.int64), "hull": _hulls(ranks[least], s, e).view(np.int64), "key": part["key"].to_numpy()[who], "of": at[who], "at": s + shift, "n": e - s + 1})

    return opened.mapInPandas(lambda b: trimmed(rows(b)), SMALLER_ROWS)


def _met(rows: DataFrame, cores: DataFrame) -> DataFrame:
    """rows whose core occurs more than once, with its count. cores: core and times."""
    return rows.join(cores.groupBy("core").agg(F.sum("times").alias("cores")).where("cores > 1"), "core")


def _settled(met: DataFrame, times: Column, keep: list[str]) -> DataFrame:
    """Blocks with ``shared`` (every start is repeated) and ``open`` (to be cut); both for those that open ones may have to meet."""
    met = saved(met, "met")
    place = F.xxhash64("key", "at")
    hulls = met.groupBy("core", "hull").agg(F.sum(times).alias("hulls"), F.min(place).alias("one")).where("hulls > 1")
    both = met.join(hulls, ["core", "hull"], "left")
    shared = F.col("hulls").isNotNull()
    stays = ~shared | ((F.col("cores") > F.col("hulls")) & (place == F.col("one")))
    return saved(both.select(*keep, shared.alias("shared"), stays.alias("open")), "settled")


def repeated_starts(texts: DataFrame, least: int, anchor: int, blocks: tuple[int, ...]) -> DataFrame:
    """(key, at, n) of blocks of starts of strings of least bytes that start anywhere else; texts has key (long, of the text) and text."""
    settled = _settled(_met(_first_rows(texts, least, anchor), _first_cores(texts, least, anchor)), F.col("times"), ["key", "at", "n", "anchor"])
    found = settled.where("shared").select("key", "at", "n")
    wanted = settled.where("open").groupBy("key").agg(F.collect_set(F.struct("at", "n", "anchor")).alias("parts"))
    chosen = texts.join(wanted, "key").select("key", "text", "parts")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done = set()  # copies of a text in one task are cut once
        for pdf in batches:
            for key, text, parts in zip(pdf["key"], pdf["text"], pdf["parts"]):
                if key not in done:
                    done.add(key)
                    raw = text.encode()
                    yield pd.DataFrame([(key, p["at"], p["n"], p["anchor"], raw[p["at"] : p["at"] + p["n"] + least - 1]) for p in parts], columns=["key", "at", "n", "anchor", "raw"])

    opened = saved(chosen.mapInPandas(lambda b: trimmed(cut(b)), "key long, at int, n int, anchor int, raw binary"), "opened")
    named = opened.withColumn("parts", F.lit(None).cast("array<struct<at: int, n: int>>"))
    for block in (*blocks, 1):
        rows = _smaller_rows(named, least, block)
        met = _met(rows, rows.select("core", F.lit(1).alias("times")))
        if block == 1:  # a block is its core
            return found.union(met.select("key", "at", "n"))
        settled = _settled(met, F.lit(1), ["key", "of", "at", "n"])
        found = found.union(settled.where("shared").select("key", "at", "n"))
        wanted = settled.where("open").groupBy("key", F.col("of").alias("at")).agg(F.collect_set(F.struct("at", "n")).alias("parts"))
        named = opened.join(wanted, ["key", "at"]).select("key", "at", "n", "anchor", "raw", "parts")


def drop_repeated_strings(docs: DataFrame, least: int = 200, anchor: int = 64, blocks: tuple[int, ...] = (8,)) -> DataFrame:
    """Adds to docs (text): n_bytes, spans (removed runs of bytes, start and end) and kept (the other bytes, binary).

    A byte goes if a string of least bytes (UTF-8) that covers it also starts anywhere else, in the same text or
    another row's; strings are judged as they are in docs, and none crosses texts. anchor (8 at least, below
    least) and blocks (starts of a block in the rounds after the first) change costs, not results.

    Strings are equal if their 64-bit names are, and texts if their 64-bit hashes are. Null text is empty; texts
    of fewer than least bytes stay whole. Equal rows are copies of each other, whatever their doc_id, so both lose all they
    have in common. kept may start or end within a character. Own columns of these three names are replaced.
    An empty table gives no rows.
    """
    if not 8 <= anchor < least or any(not 1 < b <= least - 8 for b in blocks):
        raise ValueError("anchor must be from 8 to least - 1, blocks from 2 to least - 8")
    own = ("n_bytes", "spans", "kept")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    rows = rows.select("doc", F.coalesce(F.col("doc")["text"].cast("string"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    texts = rows.where(F.octet_length("text") >= least).select("key", "text")
    found = repeated_starts(texts, least, anchor, blocks).groupBy("key").agg(F.collect_set(F.struct("at", "n")).alias("starts"))

    @F.pandas_udf("array<struct<start: long, end: long>>")
    def merge(starts: pd.Series) -> pd.Series:
        out = []
        for parts in starts:
            at = np.array([(p["at"], p["at"] + p["n"] + least - 1) for p in parts], np.int64)
            at = at[np.argsort(at[:, 0], kind="stable")]
            end = np.maximum.accumulate(at[:, 1])
            new = np.concatenate(([True], at[1:, 0] > end[:-1]))
            out.append([{"start": int(s), "end": int(e)} for s, e in zip(at[new, 0], end[np.append(np.flatnonzero(new)[1:], len(at)) - 1])])
        return pd.Series(out)

    @F.pandas_udf("binary")
    def without(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, cuts in zip(text, spans):
            if t is None:
                out.append(None)
                continue
            raw, parts, at = t.encode(), [], 0
            for c in cuts:
                parts.append(raw[at : c["start"]])
                at = c["end"]
            out.append(b"".join([*parts, raw[at:]]))
        return pd.Series(out)

    spans = saved(found.select(F.col("key").alias("_key"), merge("starts").alias("spans")), "spans")
    rows = rows.join(spans, F.col("key") == F.col("_key"), "left")
    cut = F.col("spans").isNotNull() & (F.octet_length("text") >= least)
    rows = rows.withColumn("kept", without(F.when(cut, F.col("text")), F.when(cut, F.col("spans"))))
    return rows.select(
        *[F.col("doc")[c].alias(c) for c in docs.columns if c not in own],
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.when(cut, F.col("spans")).otherwise(F.array().cast("array<struct<start: long, end: long>>")).alias("spans"),
        F.coalesce("kept", F.col("text").cast("binary")).alias("kept"),
    )
