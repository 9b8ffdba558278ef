"""Mixture-controlled packing by deficit round-robin.

Every source is a queue of documents, cut into packets of at most ``packet_tokens``. In each round a
source's deficit grows by its quantum (its target share of one window) and it sends packets while the
deficit covers them; what is left is carried to the next round, so over windows and partitions the
served tokens follow the target proportions to within one packet per source. While all queues are
backlogged the round in which a packet leaves has a closed form, ``ceil(tokens of the queue up to its
end / quantum)``. That makes the schedule a sort by (round, source, position) and two prefix sums
instead of a sequential scan: a hot source is spread over hash blocks, and a bin of rounds holds about
the same number of tokens whatever the skew of the sources.
"""

from __future__ import annotations

import functools
import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved, trimmed, with_prefix

#: The word pattern of byte-level BPE tokenizers (fixed values).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_chars() -> dict[str, int]:
    """The printable character that byte-level BPE files use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.cache
def encoder(path: str):
    """A function text -> uint32 ids for the tokenizer file at path.

    A plain byte-level BPE file whose merges are in the order of their ids is run by tiktoken, which
    gives the same ids several times faster; any other file by ``tokenizers`` itself.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, merges = spec["model"].get("vocab"), spec["model"].get("merges")
    pre = spec.get("pre_tokenizer") or {}
    made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in merges or []]
    ordered = made and all(x in vocab for x in made) and all(vocab[a] < vocab[b] for a, b in zip(made, made[1:]))
    if spec["model"].get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and spec.get("normalizer") is None and ordered:
        import tiktoken

        chars = _byte_chars()
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(chars[c] for c in word): i for word, i in vocab.items() if word not in special}
        fast = tiktoken.Encoding("file", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=special)
        every = set(special)
        return lambda text: fast.encode_to_numpy(text, allowed_special=every, disallowed_special=())
    slow = Tokenizer.from_file(path)
    return lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def _tokenize(batches: Iterator[pd.DataFrame], path: str, end_id: int) -> Iterator[pd.DataFrame]:
    encode = encoder(path)
    for pdf in batches:
        for at in range(0, len(pdf), 1000):
            part = pdf.iloc[at : at + 1000]
            n, out = [], []
            for text in part["_text"]:
                ids = np.append(encode(text).astype(np.uint32), np.uint32(end_id)) if text else np.array([end_id], dtype=np.uint32)
                n.append(len(ids))
                kind = b"\2" if ids.max() < 1 << 16 else b"\4"
                raw = ids.astype("<u2" if kind == b"\2" else "<u4").tobytes()
                out.append(kind + pa.compress(raw, codec="zstd", asbytes=True))
            yield part.drop(columns="_text").assign(n=n, _ids=out)


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for at in range(0, len(pdf), 500):
            part = pdf.iloc[at : at + 500]
            rows = []
            for doc_id, source, n, packed, pieces in zip(part["doc_id"], part["source"], part["n"], part["_ids"], part["pieces"]):
                wide = packed[0]
                raw = pa.decompress(packed[1:], decompressed_size=n * wide, codec="zstd", asbytes=True)
                ids = np.frombuffer(raw, dtype=f"<u{wide}").astype("<u4")
                rows += [(doc_id, source, p["start"], p["length"], n, p["sequence_id"], p["offset"], ids[p["start"] : p["start"] + p["length"]].tobytes()) for p in pieces]
            yield pd.DataFrame(rows, columns=["doc_id", "source", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    window: int = 2048,
    packet_tokens: int = 512,
    targets: dict[str, float] | None = None,
    end_id: int = 1,
    rows_a_block: int = 5_000,
    rounds_a_bin: int = 256,
) -> DataFrame:
    """Packs docs (doc_id, text, source) into sequences of ``window`` tokens.

    targets: wanted share of each source; sources not named, and all by default, get their share of the
    corpus. A queue that runs dry leaves its share to the others. Documents may be cut anywhere.

    Returns a row per piece: doc_id, source, start (ids of its document before it), length, doc_tokens,
    sequence_id, offset (in the sequence) and ids (little-endian unsigned 32-bit). All sequences are full
    but the rest at the very end, which is dealt into sequences whose lengths are powers of two, so
    nothing is padded.

    Null or empty text: the end id alone. Null source: a queue of its own. Null doc_id: packed like any
    other. Repeated rows and doc_ids are packed once a row. A text of any length is cut into packets. An
    empty table gives no rows. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("string").alias("doc_id"),  # as text: pandas would round integers beside a null
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"),
    )
    kind = dict(docs.dtypes)["doc_id"]
    tokens = saved(
        rows.mapInPandas(lambda b: trimmed(_tokenize(b, tokenizer_path, end_id)), "row long, doc_id string, source string, n long, _ids binary"),
        "tokens",
    )
    n_rows, total = tokens.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    blocks = max(16, math.ceil(n_rows / rows_a_block))

    queue = F.when(F.col("source").isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col("source")))
    mixed = F.xxhash64(F.col("doc_id"), F.lit("order"))
    counts = tokens.select("row", queue.alias("queue"), mixed.alias("mixed"), "n").withColumn("block", F.floor(F.pmod(F.col("mixed") / 2.0**64 + 0.5, F.lit(1.0)) * blocks))
    of_block = counts.groupBy("queue", "block").agg(F.sum("n").alias("block_n"))
    queues = of_block.groupBy("queue").agg(F.sum("block_n").alias("queue_n"))
    natural = F.col("queue_n") / F.lit(float(max(total, 1)))
    share = natural
    if targets:
        whole = float(sum(targets.values()))
        wanted = F.create_map(*[x for k, v in targets.items() for x in (F.lit(f"={k}"), F.lit(v / whole))])
        share = F.coalesce(F.try_element_at(wanted, F.col("queue")), natural)
    queues = queues.select("queue", F.greatest(share * window, F.lit(1e-6)).alias("quantum"))
    of_block = with_prefix(of_block, "block", "block_n", "block_at", within=("queue",)).join(queues, "queue").select("queue", "block", "block_at", "quantum")

    in_block = W.partitionBy("queue", "block").orderBy("mixed", "row").rowsBetween(W.unboundedPreceding, 0)
    served = counts.withColumn("upto", F.sum("n").over(in_block)).join(of_block, ["queue", "block"])
    packets = (
        served.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / packet_tokens))))
        .withColumn("start", F.col("i") * packet_tokens)
        .withColumn("length", F.least(F.lit(packet_tokens), F.col("n") - F.col("start")))
        .withColumn("end", F.col("block_at") + F.col("upto") - F.col("n") + F.col("start") + F.col("length"))
        .withColumn("round", F.ceil(F.col("end") / F.col("quantum")))
        .select("row", "queue", "start", "length", "end", "round", F.floor(F.col("round") / rounds_a_bin).alias("bin"))
    )
    order = W.partitionBy("bin").orderBy("round", "queue", "end")
    joined = (F.lag("row").over(order) == F.col("row")) & (F.lag("queue").over(order) == F.col("queue"))
    runs = (
        packets.withColumn("new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1))
        .withColumn("in_bin", F.sum("length").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("length"))
        .withColumn("run", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy("bin", "run")
        .agg(F.first("row").alias("row"), F.min("start").alias("start"), F.sum("length").alias("length"), F.min("in_bin").alias("in_bin"))
    )
    bins = with_prefix(packets.groupBy("bin").agg(F.sum("length").alias("bin_n")), "bin", "bin_n", "bin_at").select("bin", "bin_at")

    last, rest, segments, lo = total // window, total % window, [], 0
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            segments.append(F.struct(F.lit(last + len(segments)).cast("long").alias("seq"), F.lit(lo).cast("long").alias("lo"), F.lit(1 << bit).cast("long").alias("size")))
            lo += 1 << bit
    whole_window = F.array(F.struct(F.col("w").alias("seq"), F.lit(0).cast("long").alias("lo"), F.lit(window).cast("long").alias("size")))
    cut_at = F.when(F.col("w") < last, whole_window).otherwise(F.array(*segments)) if segments else whole_window
    pieces = (
        runs.join(bins, "bin")
        .withColumn("at", F.col("bin_at") + F.col("in_bin"))
        .withColumn("w", F.explode(F.sequence(F.floor(F.col("at") / window), F.floor((F.col("at") + F.col("length") - 1) / window))))
        .withColumn("seg", F.explode(cut_at))
        .withColumn("base", F.col("w") * window + F.col("seg.lo"))
        .withColumn("from", F.greatest(F.col("at"), F.col("base")))
        .withColumn("to", F.least(F.col("at") + F.col("length"), F.col("base") + F.col("seg.size")))
        .where(F.col("to") > F.col("from"))
        .select(
            "row",
            F.struct(
                (F.col("start") + F.col("from") - F.col("at")).alias("start"),
                (F.col("to") - F.col("from")).alias("length"),
                F.col("seg.seq").alias("sequence_id"),
                (F.col("from") - F.col("base")).alias("offset"),
            ).alias("piece"),
        )
        .groupBy("row")
        .agg(F.collect_list("piece").alias("pieces"))
    )
    return (
        tokens.join(pieces, "row")
        .select("doc_id", "source", "n", "_ids", "pieces")
        .mapInPandas(lambda b: trimmed(_cut(b)), "doc_id string, source string, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
        .withColumn("doc_id", F.col("doc_id").cast(kind))
    )
