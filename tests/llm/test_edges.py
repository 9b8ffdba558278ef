"""Nulls, empty tables, repeated rows, clashing columns, long texts: every operator and stage has a defined result."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from voltlake.llm import queries
from voltlake.llm.decontam import decontaminate
from voltlake.llm.html import extract_text
from voltlake.llm.jaccard import near_duplicates
from voltlake.llm.langid import identify_language
from voltlake.llm.linededup import dedup_lines
from voltlake.llm.packing import pack
from voltlake.llm.pii import find_personal_data
from voltlake.llm.quality import classify_quality
from voltlake.llm.rules import host_rules
from voltlake.llm.urls import temporal_url_filter

LONG = "lorem ipsum dolor sit amet " * 20_000
ROWS = [
    (1, "one two three four five six seven\nshort", "en", "a", 40),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \n\t ", "en", None, 4),
    (5, "one two three four five six seven\nshort", "en", "a", 40),
    (5, "one two three four five six seven\nshort", "en", "a", 40),
    (6, LONG, "la", "b", len(LONG)),
    (7, "a" * 100_000, "la", "b", 100_000),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("_id", "_mark", "_lines", "lines", "doc", "row", "n", "score", "host", "key", "label", "queue", "mark", "n_lines", "found", "spans", "a", "b")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.withColumns({c: F.lit(f"clash {c}") for c in CLASH})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=((1, 1, 0), (3, 0, 0), (6, 1, 0), (7, None, 0), (None, 1, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def benchmark(spark):
    return spark.createDataFrame([(1, "two three four"), (2, None), (3, ""), (None, "ipsum dolor"), (1, "two three four")], "item_id long, text string")


def test_pack(spark, docs, none):
    rows = pack(docs, queries.tokenizer_path()).collect()
    assert sum(r.length for r in rows) == sum({(r.doc_id, r.doc_tokens): r.doc_tokens for r in rows}.values()) + next(r.doc_tokens for r in rows if r.doc_id == 5)
    by = {r.doc_id: r for r in rows}
    assert [by[i].doc_tokens for i in (2, 3)] == [1, 1] and by[2].ids == (1).to_bytes(4, "little")
    assert pack(none, queries.tokenizer_path()).count() == 0


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<p>" + "the cat is on the mat and " * 9), (3, "u", "x < y"), (4, "u", "<" * 50_000)], "page_id long, url string, html string")
    got = {(r.page_id, len(r.text)) for r in extract_text(pages.withColumn("text", F.lit("clash"))).collect()}
    assert {(1, 0), (2, 0)} <= got and any(p == 3 and n > 100 for p, n in got)
    assert extract_text(pages.limit(0)).count() == 0


def test_urls(spark):
    caps = spark.createDataFrame([(1, "http://a.example.com/x", "2024-01-05"), (2, None, "2024-01-05"), (3, "no url", "2024-01-05"), (4, "http://a.example.com/", None), (1, "http://a.example.com/x", "2024-01-05")], "page_id long, url string, fetched string")
    entries = spark.createDataFrame([("example.com", "block", "2024-01-05"), ("example.com", "allow", "2024-01-05"), (None, "block", "2024-01-01"), ("a.example.com", "odd", "2024-01-01"), ("example.com", "remove", "2024-01-06")], "pattern string, action string, listed string")
    got = sorted((r.page_id, r.verdict) for r in temporal_url_filter(caps.withColumn("host", F.lit(1)), entries).collect())
    assert got == [(1, "block"), (1, "block"), (2, "none"), (3, "none"), (4, "none")]
    shuffled = temporal_url_filter(caps, entries, most_bytes=0, a_part=1)
    assert sorted((r.page_id, r.verdict) for r in shuffled.collect()) == got
    assert {r.verdict for r in temporal_url_filter(caps, entries.limit(0)).collect()} == {"none"}
    assert temporal_url_filter(caps.limit(0), entries).count() == 0


def test_quality(spark, docs, none):
    rows = classify_quality(docs, labels(spark)).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in classify_quality(docs, labels(spark).limit(0)).collect()} == {1.0}
    assert {r.score for r in classify_quality(docs, labels(spark, [(1, 0, 0)])).collect()} == {0.0}
    assert classify_quality(none, labels(spark)).count() == 0


def test_rules(docs, none):
    by = {r.doc_id: r for r in host_rules(docs).collect()}
    assert by[2].n_words == 0 and by[2].base_failed and by[7].n_words == 1 and by[6].n_repeat_words == 100_000
    assert host_rules(none).count() == 0


def test_decontaminate(spark, docs, none):
    by = {r.doc_id: r for r in decontaminate(docs, benchmark(spark)).collect()}
    assert by[1]["items"] == ["1"] and by[1].n_hit == 3 and by[6]["items"] == [""] and by[2].n_words == 0
    assert all(r.n_hit == 0 for r in decontaminate(docs, benchmark(spark).limit(0)).collect())
    assert decontaminate(none, benchmark(spark)).count() == 0


def test_near_duplicates(docs, none):
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs).collect())
    assert got == [(1, 4, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, 4, 1), (5, 4, 1), (6, 5, 6), (7, 1, 7)]
    assert near_duplicates(none).count() == 0


def test_ids_beside_nulls(spark):
    """2^53 + 1 is no float: a null id in the same batch must not change it."""
    ids = [2**53 + 1, None, 2**53 + 3, -(2**62) - 1]
    text = "the cat is on the mat and the dog is at the door of the old house"
    rows = spark.createDataFrame([(i, text, "en", "a", 9) for i in ids], SCHEMA).coalesce(1)
    pages = rows.select(F.col("doc_id").alias("page_id"), F.lit("http://a.b/c").alias("url"), F.concat(F.lit("<p>"), "text").alias("html"), F.lit("2024-01-05").alias("fetched"))
    entries = spark.createDataFrame([("a.b", "block", "2024-01-01")], "pattern string, action string, listed string")
    made = [pack(rows, queries.tokenizer_path()), classify_quality(rows, labels(spark)), host_rules(rows), decontaminate(rows, benchmark(spark)), near_duplicates(rows), identify_language(rows, rows), dedup_lines(rows), find_personal_data(rows)]
    for df in (*made, *(f.withColumnRenamed("page_id", "doc_id") for f in (extract_text(pages), temporal_url_filter(pages, entries)))):
        assert {r.doc_id for r in df.collect()} == set(ids)


def test_language(docs, none):
    by = {r.doc_id: r for r in identify_language(docs, docs).collect()}
    assert by[2].lang_pred == by[3].lang_pred == by[4].lang_pred == "und" and by[6].lang_pred == "la"
    assert {r.lang_pred for r in identify_language(docs, none).collect()} == {"und"}
    assert identify_language(none, docs).count() == 0


def test_lines(docs, none):
    by = {r.doc_id: r for r in dedup_lines(docs).collect()}
    assert by[5].text == "" and by[5].n_removed == 2 and by[1].n_removed == 0 and by[2].text is None and by[5]["row"] == "clash row"
    assert dedup_lines(none).count() == 0


def test_personal_data(docs, none):
    rows = find_personal_data(docs).collect()
    assert len(rows) == len(ROWS) and all(r.base == [] for r in rows)
    assert find_personal_data(none).count() == 0


@pytest.mark.parametrize("chunk", [10, 1 << 20])
def test_decontamination_stage_judges_rows(spark, tmp_path, monkeypatch, chunk):
    """A contaminated row goes and a clean one stays, with equal or null doc_ids, in one pass or several."""
    items = [(i, " ".join(f"b{i}w{k}" for k in range(12))) for i in range(12)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    monkeypatch.setattr(corpus_pipeline, "CHUNK", chunk)
    rows = [(5, "clean", "x"), (5, items[3][1], "y"), (None, items[4][1], "z"), (None, None, "n"), (6, "say " + items[7][1].upper(), "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string")
    got = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()
    assert sorted(r.mark for r in got) == ["n", "x"]


def test_near_duplicate_stage_keeps_one_row(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text + " b"), (5, text + " a"), (3, "other words"), (None, text), (None, text), (7, text), (3, "other words")]
    got = corpus_pipeline.keep_one_of_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(5, text + " a"), (3, "other words"), (None, text), (None, text)], key=str)


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, docs, none, tmp_path, k):
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    benchmark(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    name, stage = corpus_pipeline.STAGES[k]
    for frame in (docs, none):
        frame.write.mode("overwrite").parquet(f"{tmp_path}/in")
        read = spark.read.schema(frame.schema).parquet(f"{tmp_path}/in")
        out = stage(spark, read, str(tmp_path))
        rows = out.collect()
        if frame is none:
            assert rows == []
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == read.columns
