"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the benchmark's word windows. For every pattern length a shift table says how far the
scan may jump after a block of ``block`` words: a block that ends no pattern moves the window on by
several words at once. Where the shift is 0 the bucket of the block's hash holds the few patterns that
end with it, and only those are compared with the text byte by byte. The tables are arrays, about ten
bytes for each byte of the benchmark.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .textvec import chunks, mix, word_hashes

#: A-Z become a-z; bytes outside 0-9, a-z and 0x80-0xFF part words (as code points: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+).
_WORDS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def plain(text: str | None) -> bytes:
    """The words of a text in lower case, parted by spaces."""
    return text.encode().translate(_WORDS) if text else b""


def words_of(text: str | None) -> list[bytes]:
    return plain(text).split()


class _Group:
    """Patterns of m words: where each starts, the shift of every block hash, and buckets by the last block's hash."""

    def __init__(self, m: int, block: int, h: np.ndarray, starts: np.ndarray):
        self.m, self.block = m, min(block, m)
        blocks = _block_hashes(h, self.block)
        self.bits = max(10, int(np.ceil(np.log2(8 * len(starts)))))
        self.shift = np.full(1 << self.bits, m - self.block + 1, np.uint8 if m < 256 else np.int64)
        for j in range(m - self.block + 1):  # the block that ends m - block - j words before the pattern does
            np.minimum.at(self.shift, self.slot(blocks[starts + j]), m - self.block - j)
        last = blocks[starts + m - self.block]
        order = np.argsort(last, kind="stable")
        self.last, self.starts = last[order], starts[order]

    def slot(self, blocks: np.ndarray) -> np.ndarray:
        return (blocks >> np.uint64(64 - self.bits)).astype(np.int64)


def _block_hashes(h: np.ndarray, block: int) -> np.ndarray:
    """A hash for every ``block`` words in a row."""
    n = max(len(h) - block + 1, 0)
    out = np.zeros(n, np.uint64)
    for i in range(block):
        out = (out + h[i : i + n]) * np.uint64(0xC2B2AE3D27D4EB4F)
    return mix(out)


class WuManber:
    """Tables for one bounded set of items; each window of ``window`` words of an item is a pattern."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = 10, block: int = 3):
        texts = [(i, w) for i, w in sorted((i, words_of(t)) for i, t in items) if w]
        self.names, self.words = [i for i, _ in texts], b" ".join(x for _, w in texts for x in w) + b" "
        n = np.array([len(w) for _, w in texts], np.int64)
        size = np.array([len(x) + 1 for _, w in texts for x in w], np.int64)
        self.at = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))  # where each word starts
        self.item = np.repeat(np.arange(len(n)), n)
        h, first = word_hashes([self.words])[0], np.cumsum(n) - n
        self.groups = []
        for m in np.unique(np.minimum(n, window)).tolist():
            own = np.minimum(n, window) == m
            starts = np.concatenate([np.arange(a, a + k - m + 1) for a, k in zip(first[own], n[own])])
            self.groups.append(_Group(m, block, h, starts))

    def scan(self, texts: list[bytes], h: np.ndarray, doc: np.ndarray) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
        """For each of the plain texts with an occurrence: the spans of words (end exclusive), and the items they belong to.

        h, doc: the hashes of all words, and the text of each.
        """
        out: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
        size = np.bincount(doc, minlength=len(texts))
        at = np.cumsum(size) - size
        for g in self.groups:
            blocks = _block_hashes(h, g.block)
            steps = g.shift[g.slot(blocks)]
            # A text none of whose blocks ends a pattern is skipped as a whole.
            for d in np.unique(doc[np.flatnonzero(steps == 0)]).tolist():
                words, own = texts[d].split(), blocks[at[d] :]
                jump, end, n = steps[at[d] : at[d] + size[d]].tolist(), g.m, int(size[d])
                while end <= n:
                    step = jump[end - g.block]
                    if not step:
                        last = own[end - g.block]
                        span, found = (end - g.m, end), self._compared(g, last, b" ".join(words[end - g.m : end]) + b" ")
                        if found:
                            spans, items = out.setdefault(d, ([], set()))
                            spans.append(span)
                            items |= found
                        step = 1
                    end += step
        return out

    def _compared(self, g: _Group, last: np.uint64, text: bytes) -> set[str]:
        """The items of the patterns in a block's bucket that equal the text."""
        found = set()
        for k in range(int(np.searchsorted(g.last, last)), int(np.searchsorted(g.last, last, side="right"))):
            start = g.starts[k]
            if self.words[self.at[start] : self.at[start + g.m]] == text:
                found.add(self.names[self.item[start]])
        return found


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


FOUND = "n_words long, hits array<struct<`from`: long, `to`: long>>, n_hit long, items array<string>"
#: Chunks of the benchmark whose tables a task may hold at once.
MOST_CHUNKS = 8


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text"))


def n_chunks(benchmark: DataFrame, chunk_bytes: int) -> int:
    return max(1, math.ceil((_items(benchmark).agg(F.sum(F.octet_length("text"))).first()[0] or 0) / chunk_bytes))


def searcher(benchmark: DataFrame, window: int = 10, block: int = 3, chunk_bytes: int = 2 << 20, only: tuple[int, int, int] | None = None):
    """A function text -> struct column (n_words, hits, n_hit, items) for the windows of benchmark (item_id, text).

    The benchmark is dealt by item into chunks of about ``chunk_bytes`` of text, and each chunk's tables are
    broadcast on their own. More than MOST_CHUNKS are refused; hit_texts() and decontaminate() then search in passes.
    only: (first chunk, last chunk + 1, number of chunks) to search for.
    """
    items = _items(benchmark)
    parts = only[2] if only else n_chunks(benchmark, chunk_bytes)
    some = range(*only[:2]) if only else range(parts)
    if len(some) > MOST_CHUNKS:
        raise ValueError(f"the benchmark has {len(some)} chunks of {chunk_bytes} bytes; search them in passes")
    tables = []
    for c in some:
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == c).collect()
        tables.append(benchmark.sparkSession.sparkContext.broadcast(WuManber([tuple(r) for r in rows], window, block)))

    @F.pandas_udf(FOUND)
    def search(text: pd.Series) -> pd.DataFrame:
        rows, texts = [], [plain(t) for t in text]
        for start, end in chunks(texts):
            some = texts[start:end]
            h, doc, _ = word_hashes(some)
            size = np.bincount(doc, minlength=len(some))
            found = [table.value.scan(some, h, doc) for table in tables]
            for d in range(len(some)):
                hits = [f[d] for f in found if d in f]
                merged = _merged([x for spans, _ in hits for x in spans])
                rows.append((int(size[d]), [{"from": a, "to": b} for a, b in merged], sum(b - a for a, b in merged), sorted({x for _, items in hits for x in items})))
        return pd.DataFrame(rows, columns=["n_words", "hits", "n_hit", "items"])

    return search


def _passes(benchmark: DataFrame, chunk_bytes: int) -> list[tuple[int, int, int]]:
    parts = n_chunks(benchmark, chunk_bytes)
    return [(c, min(c + MOST_CHUNKS, parts), parts) for c in range(0, parts, MOST_CHUNKS)]


def hit_texts(texts: DataFrame, benchmark: DataFrame, window: int = 10, block: int = 3, chunk_bytes: int = 2 << 20) -> DataFrame:
    """What the benchmark hits in texts (text), in as many passes as it takes: mark (xxhash64 of the text), hits and items, a row a pass."""
    out = None
    for one in _passes(benchmark, chunk_bytes):
        found = texts.select(F.xxhash64("text").alias("mark"), searcher(benchmark, window, block, chunk_bytes, one)("text").alias("f"))
        found = saved(found.where("f.n_hit > 0").select("mark", "f.hits", "f.items").dropDuplicates(["mark"]), "hits")
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, block: int = 3, chunk_bytes: int = 2 << 20) -> DataFrame:
    """Finds benchmark (item_id, text) windows of ``window`` words in docs (doc_id, text).

    Returns a row per document: doc_id, n_words, hits (spans of words in any occurrence of a window, end
    exclusive, merged), n_hit (words in them) and items (distinct item_ids as strings, sorted).

    A benchmark of up to MOST_CHUNKS chunks is searched for in one pass without any shuffle. A larger one
    takes a pass for every MOST_CHUNKS chunks, whose results are joined by a hash of the text.

    An item of fewer than ``window`` words is one window; an item or text that is null or without words
    matches nothing. A null item_id counts as the empty id; a null doc_id is returned as null. Repeated
    rows are treated each on its own. Texts of any length are searched whole. An empty table gives no
    rows, an empty benchmark no hits. Other columns are ignored.
    """
    base = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    passes = _passes(benchmark, chunk_bytes)
    if len(passes) == 1:
        return base.select("doc_id", searcher(benchmark, window, block, chunk_bytes, passes[0])("text").alias("found")).select("doc_id", "found.*")
    rows = base.withColumn("mark", F.xxhash64("text"))
    hits = hit_texts(base, benchmark, window, block, chunk_bytes)
    whole = hits.groupBy("mark").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("h"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # Spans in order are merged where they touch.
    step = lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["to"] >= x["from"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["from"].alias("from"), F.greatest(F.element_at(acc, -1)["to"], x["to"]).alias("to"))))).otherwise(F.array_append(acc, x))
    none = F.array().cast("array<struct<`from`: long, `to`: long>>")
    whole = whole.select("mark", F.aggregate("h", none, step).alias("hits"), "items")
    n_words = searcher(benchmark.limit(0), window, block, chunk_bytes, (0, 1, 1))
    out = rows.select("doc_id", "mark", n_words("text")["n_words"].alias("n_words")).join(whole, "mark", "left")
    hits = F.coalesce("hits", none)
    return out.select("doc_id", "n_words", hits.alias("hits"), F.aggregate(hits, F.lit(0).cast("long"), lambda a, x: a + x["to"] - x["from"]).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
