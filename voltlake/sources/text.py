"""Delimited vendor files as rows of named fields: a header is found in each file, so files may differ."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, path: str | list[str] | DataFrame, encoding: str = "UTF-8", glob: str | None = None) -> DataFrame:
    """Every file as one row: file, text. Null text: its bytes are not of that encoding.

    path may also be such a table, whose texts are decoded already (see ``intake``); glob selects by name.
    """
    if isinstance(path, DataFrame):
        kept = path.where(base_name().rlike("^" + glob.replace(".", r"\.").replace("*", ".*") + "$")) if glob else path
        return kept.select("file", "text")
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(F.col("path").alias("file"), decoded(F.col("content"), encoding).alias("text"))


def decoded(content: Column, encoding: str) -> Column:
    """Bytes as text; null if they are not of that encoding."""
    if encoding == "UTF-8":
        return F.try_validate_utf8(content.cast("string"))
    return F.decode(content, encoding)


def lines(spark: SparkSession, path: str | list[str] | DataFrame, encoding: str = "UTF-8", glob: str | None = None) -> DataFrame:
    """Every line of every file: file, line_no (from 0), line. A file is one row until it is split."""
    return files(spark, path, encoding, glob).select("file", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line"))


def base_name(file: str = "file") -> Column:
    return F.element_at(F.split(F.col(file), "/"), -1)


def records(whole: DataFrame, header: Callable[[Column, Column], Column], separator: str, lower: bool = False) -> DataFrame:
    """The lines after the first one of each file for which header(line, its number) holds, as a map from column name to text.

    whole: file, text. A file is split once. Empty lines, and files without a header, give nothing; missing
    fields are null.
    """
    split = whole.select("file", F.split("text", r"\r?\n").alias("all"))
    is_head = F.transform("all", lambda line, i: F.coalesce(header(line, i), F.lit(False)))
    # array_position counts from 1, and is 0 without a header.
    found = split.withColumn("at", F.array_position(is_head, F.lit(True)).cast("int")).where("at > 0")
    name = F.trim(F.lower(F.get("all", F.col("at") - 1)) if lower else F.get("all", F.col("at") - 1))
    found = found.withColumn("names", F.transform(F.split(name, separator), lambda c: F.trim(c)))
    body = found.select("file", "names", F.col("at"), F.posexplode(F.slice("all", F.col("at") + 1, F.size("all"))).alias("_i", "line"))
    body = body.where(F.trim("line") != "").withColumn("line_no", F.col("_i") + F.col("at"))
    values = F.split("line", separator)
    n = F.size("names")
    padded = F.slice(F.concat(values, F.array_repeat(F.lit(None).cast("string"), n)), F.lit(1), n)
    # Of columns with one name the first counts.
    first = F.filter(F.arrays_zip(F.col("names").alias("k"), padded.alias("v"), F.sequence(F.lit(1), n).alias("i")), lambda e: (F.array_position("names", e["k"]) == e["i"]) & (e["k"] != ""))
    pairs = F.map_from_arrays(F.transform(first, lambda e: e["k"]), F.transform(first, lambda e: e["v"]))
    return body.select("file", "line_no", pairs.alias("fields"))


def canonical(rows: DataFrame, columns: dict[str, tuple[str, str] | tuple[str, str, float]], nulls: tuple[str, ...] = ("", "N/A", "-", "NaN", "nan")) -> DataFrame:
    """The fields of records under canonical names: columns maps vendor name -> (name, type[, scale]).

    What cannot be cast is null, and is told in the column error (the first such field; null if there is none).
    """
    names, kinds = F.array(*map(F.lit, columns)), F.array(*[F.lit(spec[1]) for spec in columns.values()])
    clean = lambda name: F.trim(F.replace(F.element_at("fields", name), F.lit("\t"), F.lit("")))
    texts = rows.select("file", "line_no", F.transform(names, lambda name: F.when(~clean(name).isin(*nulls), clean(name))).alias("_texts"))
    values, bad = [], []
    for i, (name, kind, *scale) in enumerate(columns.values()):
        raw = F.get("_texts", F.lit(i))
        value = raw if kind == "string" else raw.try_cast("double") if kind in ("double", "float") else raw.try_cast("double").try_cast(kind)
        values.append((value * F.lit(scale[0]) if scale else value).cast(kind).alias(name))
        if kind != "string":
            bad.append(F.when(raw.isNotNull() & F.col(f"`{name}`").isNull(), F.lit(i)))
    found = texts.select("file", "line_no", "_texts", *values).withColumn("_bad", F.coalesce(*bad, F.lit(None).cast("int")))
    told = F.concat(F.lit("line "), F.col("line_no") + 1, F.lit(": "), F.get(names, F.col("_bad")), F.lit(" is no "), F.get(kinds, F.col("_bad")), F.lit(": "), F.substring(F.get("_texts", F.col("_bad")), 1, 40))
    return found.withColumn("error", told).drop("_texts", "_bad")
