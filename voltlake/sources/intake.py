"""Files on their way in: an inventory with digests and problems, so that one bad file stops no other.

Every file is read once, into a table of texts by format; readers work on that table. What is wrong with a
file is a text in its column problem, what is wrong with a row in the reader's column error.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vendors
from .text import base_name, decoded


@dataclass(frozen=True)
class Format:
    """A file format: its name, how a file's name tells it (null: it is not told), its reader of a table (file, text), its encoding."""

    name: str
    pattern: str | None
    read: Callable[[SparkSession, DataFrame], DataFrame]
    encoding: str = "UTF-8"


def _built_in() -> dict[str, Format]:
    patterns = dict(vendors.PATTERNS)
    readers = {
        "arbin": vendors.read_arbin,
        "maccor": vendors.read_maccor,
        "archive": vendors.read_archive,
        "biologic": vendors.read_biologic,
        "neware": vendors.read_neware,
        "novonix": lambda spark, files: vendors.read_novonix(spark, files, strict=False),
    }
    return {k: Format(k, patterns.get(k), r, "ISO-8859-1" if k == "neware" else "UTF-8") for k, r in readers.items()}


FORMATS: dict[str, Format] = _built_in()


def register(fmt: Format) -> None:
    """Adds a format, or replaces the one of its name; its pattern is tried after those that there are."""
    FORMATS[fmt.name] = fmt


def _format_of(name: Column) -> Column:
    """The format that a file's name tells; built-in patterns first, in their order."""
    own = [F.when(name.rlike(f"^(?:{f.pattern})"), f.name) for f in FORMATS.values() if f.pattern and f.name not in dict(vendors.PATTERNS)]
    return F.coalesce(vendors.detect(name), *own)


def _with_empty(spark: SparkSession, found: DataFrame) -> DataFrame:
    """found (of format binaryFile) with the empty files, which Spark lists, but gives no row.

    Only names are compared, of the listing that Spark's driver holds anyway.
    """
    listed = spark.createDataFrame(pd.DataFrame({"path": [re.sub("^file:/+", "file:/", unquote(p)) for p in found.inputFiles()]}, dtype=str), "path string")
    empty = listed.join(found.select("path"), "path", "left_anti")
    return found.unionByName(empty.select("path", F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content")), allowMissingColumns=True)


def take_in(spark: SparkSession, path: str | list[str], out: str, kind: str | None = None) -> DataFrame:
    """Writes all files under path as a table of one row each, by format; returns that table.

    Columns: file, run_id (the file's name), raw_md5, bytes, modified, text, problem (null if it can be read)
    and format. kind: the format of all files; else each file's name tells it. Of several files of one name
    the first by path is read. Unreadable files are left to Spark's setting ignoreCorruptFiles.
    """
    found = _with_empty(spark, spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))
    rows = found.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), "content", F.md5("content").alias("raw_md5"))
    name = base_name()
    rows = rows.withColumns({"run_id": name, "format": F.lit(kind) if kind else _format_of(name)})
    latin = [f.name for f in FORMATS.values() if f.encoding == "ISO-8859-1"]
    is_latin = F.coalesce(F.col("format").isin(*latin), F.lit(False)) | ((F.col("format") == "biologic") & name.endswith(".txt"))
    text = F.when(is_latin, decoded(F.col("content"), "ISO-8859-1")).otherwise(decoded(F.col("content"), "UTF-8"))
    known = F.col("format").isin(*FORMATS)
    rows = rows.withColumn("text", F.when(known, text)).withColumn(
        "problem",
        F.when(F.col("format").isNull(), "no known format by its name")
        .when(~known, F.concat(F.lit("no reader for format "), "format"))
        .when(F.col("bytes") == 0, "the file is empty")
        .when(F.col("text").isNull(), "its bytes are no UTF-8 text"),
    )
    rows.drop("content").withColumn("format", F.coalesce("format", F.lit("unknown"))).write.mode("overwrite").partitionBy("format").parquet(out)
    return _checked(spark, out)


def _checked(spark: SparkSession, path: str) -> DataFrame:
    """The table of files; a file whose name another has, too, has a problem."""
    table = spark.read.parquet(path).withColumn("format", F.col("format").cast("string"))
    first = table.where("problem is null").groupBy("run_id").agg(F.min("file").alias("_first"))
    again = F.when(F.col("file") != F.col("_first"), F.concat(F.lit("another file of this name: "), "_first"))
    return table.join(first, "run_id", "left").withColumn("problem", F.coalesce("problem", again)).drop("_first")


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """What is known of the files of a table that take_in has written, without their texts."""
    return _checked(spark, path).drop("text")


def read_all(spark: SparkSession, files: DataFrame) -> DataFrame:
    """The samples of all files without a problem, in one canonical table with the columns error and format."""
    out = None
    for name in sorted(r["format"] for r in files.where("problem is null").select("format").distinct().collect()):
        one = FORMATS[name].read(spark, files.where((F.col("format") == name) & F.col("problem").isNull()).select("file", "text"))
        if "error" not in one.columns:
            one = one.withColumn("error", F.lit(None).cast("string"))
        one = one.withColumn("format", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no file can be read: {[tuple(r) for r in files.select('run_id', 'problem').limit(5).collect()]}")
    return out


def run_problems(samples: DataFrame, files: DataFrame, bad_share: float = 0.0) -> DataFrame:
    """run_id, n_rows, n_bad and error of every file: its problem, or its first bad row if more than bad_share of its rows are bad, or that it has no rows."""
    order = F.struct(F.regexp_extract("error", r"^line (\d+):", 1).try_cast("long"), "error")
    counted = samples.groupBy("run_id").agg(F.count("*").alias("n_rows"), F.count("error").alias("n_bad"), F.min_by("error", F.when(F.col("error").isNotNull(), order)).alias("_first"))
    rows = files.select("file", "run_id", "problem").join(counted, "run_id", "left")
    rows = rows.withColumns({"n_rows": F.when(F.col("problem").isNull(), F.coalesce("n_rows", F.lit(0))), "n_bad": F.when(F.col("problem").isNull(), F.coalesce("n_bad", F.lit(0)))})
    bad = F.when(F.col("n_bad") > bad_share * F.col("n_rows"), F.concat(F.col("n_bad").cast("string"), F.lit(" bad rows: "), "_first"))
    error = F.coalesce("problem", F.when(F.col("n_rows") == 0, "no header or no rows"), bad)
    return rows.select("file", "run_id", "n_rows", "n_bad", error.alias("error"))
