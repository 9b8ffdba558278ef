"""The pipeline against a chain of plain versions of its stages, and its stages on rows with nulls."""

import re

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from test_operators import brute_components, brute_hits, brute_lines
from voltlake.llm import queries
from voltlake.llm.common import held_out
from voltlake.llm.quality import classify_quality


def test_chain(spark, small_tables):
    from tokenizers import Tokenizer

    read = lambda name: spark.read.parquet(f"{small_tables}/{name}.parquet")
    # Scores are tested for themselves; what follows from them is done here one document after the other.
    scored = classify_quality(read("documents"), read("labels").where(~held_out(F.col("doc_id")))).collect()
    good = {r.doc_id for r in scored if r.score >= 0.3}
    docs = [(r.doc_id, r.text or "") for r in read("documents").collect() if r.doc_id in good]
    gone = brute_lines(docs)
    short = []
    for i, t in docs:
        left = "\n".join(x for j, x in enumerate(t.split("\n")) if (i, j) not in gone)
        if left == t or re.search(r"[^\x20\x09-\x0D]", left):
            short.append((i, left))
    component = brute_components(short)
    alone = [(i, t) for i, t in short if component[i][1] == i]
    items = [(str(r.item_id), r.text or "") for r in read("benchmark").collect()]
    clean = [(i, t) for i, t in alone if not brute_hits(t, items)[0]]
    assert len(docs) >= len(short) >= len(alone) > len(clean) > 50 and gone
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    want = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in clean}
    pieces = corpus_pipeline.run(spark, small_tables).toPandas().sort_values(["doc_id", "start"])
    got = {i: np.concatenate([np.frombuffer(x, "<u4") for x in own.ids]).tolist() for i, own in pieces.groupby("doc_id")}
    assert got == want
    sizes = pieces.groupby("sequence_id").length.sum()
    assert (sizes <= 2048).all() and (sizes[sizes < 2048].map(lambda n: n & (n - 1)) == 0).all()


def test_stages_on_null_ids(spark, small_tables):
    """Rows of null doc_id, null text and equal rows go through the stages that do not join on ids alike."""
    line = "these are the words of a line that is in the texts of more than one row of the table"
    body = lambda k: "\n".join(f"line {j} of the text {k} has a word w{k}x{j} and the other v{j}y{k} of its own" for j in range(12))
    rows = [(None, f"{body(1)}\n{line}"), (None, f"{body(1)}\n{line}"), (1, f"{body(2)}\n{line}"), (2, f"{body(3)}\n{line}"), (2, f"{body(3)}\n{line}"), (3, None), (4, ""), (5, " \n ")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.keep_quality(spark, docs, small_tables).collect()
    assert {tuple(r) for r in kept} <= {tuple(r) for r in docs.collect()} and all(sum(r.text == t for r in kept) in (0, 2) for t in (rows[0][1], rows[3][1]))
    lines = corpus_pipeline.drop_repeated_lines(spark, docs, small_tables).collect()
    assert len(lines) == 8 and sorted((str(r.doc_id), line in (r.text or "")) for r in lines if r.text and "line" in r.text) == [("1", True), ("2", False), ("2", False), ("None", True), ("None", True)]
    assert all(r.n_chars == len(r.text or "") for r in lines)
    packed = corpus_pipeline.pack_sequences(spark, docs, small_tables).groupBy("doc_id").agg(F.sum("length").alias("n"), F.count("*").alias("k"), F.max("doc_tokens").alias("t")).collect()
    by = {r.doc_id: r for r in packed}
    assert (by[3].n, by[4].n) == (1, 1) and by[None].n == 2 * by[None].t and by[2].n == 2 * by[2].t
