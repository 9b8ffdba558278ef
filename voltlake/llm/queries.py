"""The opN_ queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    pieces = pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify_quality

    scored = classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rules import host_rules

    return host_rules(table(spark, sf_dir, "documents")).drop("host", "host_rejected")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import decontaminate

    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify_language

    docs = table(spark, sf_dir, "documents")
    found = identify_language(docs, docs.where(~held_out(F.col("doc_id"))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract_text

    return extract_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


#: The dated list of op3: fixed entries, and three for about half of the hosts seen (dates from a hash of the host).
FIXED_ENTRIES = [
    ("example.org", "block", "2024-03-01"),
    ("example.org", "remove", "2024-04-15"),
    ("example.net", "allow", "2024-02-01"),
    ("example.com", "block", "2024-06-01"),
    ("example.com", "allow", "2024-06-20"),
    ("example.com", "remove", "2024-09-01"),
]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import temporal_url_filter

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    captures = pages.withColumn("fetched", day(F.col("page_id") % 366))
    hosts = pages.select(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1).alias("pattern")).where("pattern <> ''").distinct()
    digit = lambda i: F.conv(F.substring(F.md5("pattern"), i, 2), 16, 10).cast("int")
    steps = F.array(*[F.struct(F.lit(a).alias("action"), day(d).alias("listed")) for a, d in (("block", digit(1)), ("remove", digit(1) + 30), ("block", digit(1) + 30 + digit(3)))])
    listed = hosts.where(digit(5) % 2 == 0).select("pattern", F.explode(steps).alias("e")).select("pattern", "e.action", "e.listed")
    paths = hosts.where(digit(7) % 4 == 0).select(F.concat("pattern", F.lit("/en")).alias("pattern"), F.lit("allow").alias("action"), day(digit(1) + 10).alias("listed"))
    fixed = spark.createDataFrame(FIXED_ENTRIES, "pattern string, action string, listed string").withColumn("listed", F.col("listed").cast("date"))
    found = temporal_url_filter(captures, listed.unionByName(paths).unionByName(fixed))
    return found.select("page_id", "url", "host", F.date_format("fetched", "yyyy-MM-dd").alias("fetched"), "verdict", "pattern", F.date_format("listed", "yyyy-MM-dd").alias("listed"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, find_personal_data, joined_spans

    # A quarter of the labelled runs are seeds; patterns have to find the rest.
    found = find_personal_data(table(spark, sf_dir, "documents"), seed_share=0.25)
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(joined_spans("base"), 256).alias("base_sha256"), joined_spans("spans").alias("spans"), "n_id", F.size("spans").cast("long").alias("n_spans"))


def op11_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import drop_repeated_strings

    out = drop_repeated_strings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.reduce("spans", F.lit(0).cast("long"), lambda x, s: x + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .middle import fill_in_middle, restored

    out = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic import best_run, periodic_runs, planted_order

    out = periodic_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), order=planted_order)
    listed = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    out = out.withColumn("best", best_run(F.col("runs")))
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col("best")[c].alias(c) for c in ("start", "length", "period")],
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(listed, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_packing": op1_packing,
    "op2_main_text": op2_main_text,
    "op3_url_filter": op3_url_filter,
    "op4_quality": op4_quality,
    "op5_host_rules": op5_host_rules,
    "op6_decontaminate": op6_decontaminate,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_language_id": op8_language_id,
    "op9_line_dedup": op9_line_dedup,
    "op10_personal_data": op10_personal_data,
    "op11_repeated_strings": op11_repeated_strings,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_periodic_runs": op13_periodic_runs,
}
