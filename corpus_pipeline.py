"""The corpus pipeline: documents that pass all filters, packed into training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlake.llm.common import held_out, saved, small
from voltlake.llm.decontam import MOST_CHUNKS, hit_texts, n_chunks, searcher
from voltlake.llm.jaccard import near_duplicates
from voltlake.llm.linededup import dedup_lines
from voltlake.llm.packing import pack
from voltlake.llm.quality import inputs, quality_scorer
from voltlake.llm.queries import table, tokenizer_path


#: Bytes of benchmark text in one table of the search.
CHUNK = 2 << 20


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Null and empty texts are scored as empty ones; a null doc_id is as good as any, and equal rows stay or
    go together. Texts are read whole. An empty table gives none.
    """
    scorer = quality_scorer(docs, table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))
    return docs.where(scorer(*inputs(docs)) >= 0.3)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that are similar to earlier ones; those of which no word is left go.

    Documents that lose no line stay as they are, without words too, and so do null texts (their n_chars
    also) and rows of null doc_id. n_chars of the others is counted again. Equal rows come out alike.
    """
    out = dedup_lines(docs).where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", chars).select(*docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of every group of near duplicates.

    Of rows that share a doc_id the one of least text stays. Rows of null doc_id, which are in no group, stay.
    """
    near = saved(near_duplicates(docs), "near")
    others = near.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(small(others, others.count(), 16), "doc_id", "left_anti")
    repeated = near.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    n = repeated.count()
    if n:  # rows that share a doc_id are one document
        repeated = small(repeated, n, 16)
        one = kept.select(F.struct("*").alias("row")).join(repeated, F.col("row.doc_id") == F.col("doc_id"), "left_semi")
        one = one.groupBy(F.col("row.doc_id").alias("_id")).agg(F.min_by("row", F.struct("row.text", F.xxhash64("row"))).alias("row")).select("row.*")
        kept = kept.join(repeated, "doc_id", "left_anti").unionByName(one)
    return kept.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text holds no window of the benchmark, whatever their doc_id, however many chunks the benchmark has."""
    benchmark = table(spark, sf_dir, "benchmark")
    if n_chunks(benchmark, CHUNK) <= MOST_CHUNKS:
        return docs.where(searcher(benchmark, chunk_bytes=CHUNK)(F.col("text").cast("string"))["n_hit"] == 0)
    hit = saved(hit_texts(docs.select(F.col("text").cast("string").alias("text")), benchmark, chunk_bytes=CHUNK).select("mark").distinct(), "hit")
    hit = small(hit, hit.count(), 16)
    return docs.join(hit, F.xxhash64(docs["text"].cast("string")) == hit["mark"], "left_anti")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens.

    Null and empty texts are one piece, of the end mark alone; rows of null or equal doc_id are documents of their own.
    """
    return pack(docs, tokenizer_path()).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: The stages learn models, tokenize and follow links; SQL can't express that. tests/llm/test_pipeline.py does the chain one document after the other (scores are taken from the classifier, which has tests of its own).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs, name.replace(" ", "-"))
    return docs
