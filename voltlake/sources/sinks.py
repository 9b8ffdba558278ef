"""Sinks: tables by run, column-list JSON, status reports, waveforms."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, by: str | None = None, mode: str = "overwrite") -> None:
    """Parquet; by: a column of few values to partition by. Runs are many and small, so run_id is clustered, not partitioned."""
    # Rows are dealt by a hash: ranges would have to run the plan once more to find their bounds. Large runs may be split over files.
    clustered = df.hint("rebalance", F.col("run_id")).sortWithinPartitions("run_id") if by is None and "run_id" in df.columns else df
    writer = clustered.write.mode(mode)
    (writer.partitionBy(by) if by else writer).parquet(path)


def column_lists(df: DataFrame, order: str) -> DataFrame:
    """One JSON document for each run: a list for each column, in the order of the column ``order``."""
    columns = [c for c in df.columns if c != "run_id"]
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *columns)))
    lists = F.struct(*[_field("rows", c) for c in columns])
    return df.groupBy("run_id").agg(rows.alias("rows")).select("run_id", F.to_json(lists, {"ignoreNullFields": "false"}).alias("json"))


def _field(rows: str, column: str):
    return F.transform(F.col(rows), lambda r: r[column]).alias(column)


def from_column_lists(docs: DataFrame, fields: dict[str, str]) -> DataFrame:
    """The rows of column-list documents (run_id, json): fields maps column -> type."""
    parsed = F.from_json("json", ", ".join(f"`{c}` array<{t}>" for c, t in fields.items()))
    zipped = docs.select("run_id", parsed.alias("d")).select("run_id", F.explode(F.arrays_zip(*[F.col("d").getField(c).alias(c) for c in fields])).alias("r"))
    return zipped.select("run_id", *[F.col("r").getField(c).alias(c) for c in fields])


def clear_table(spark: SparkSession, path: str) -> None:
    """Leaves an empty table of the same columns where there is a table."""
    try:
        schema = spark.read.parquet(path).schema
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


#: Columns of a status file.
STATUS = "run_id string, file string, format string, raw_md5 string, bytes long, modified timestamp, n_rows long, n_bad long, error string, schema string, valid boolean, reason string, structured boolean, finished timestamp, seconds double, tags array<string>, structuring_parameters string"


def status_report(files: DataFrame, problems: DataFrame, validation: DataFrame, structured: DataFrame | None, seconds: float | None = None, tags: tuple[str, ...] = ()) -> DataFrame:
    """One row for each file: its digest, size and time, why it could not be read, whether it was valid and why not, whether it was structured.

    files: file, run_id and what is known of each; problems: file, n_rows, n_bad, error; validation: run_id,
    valid, reason, schema; structured: a table with the runs that were structured (None: none was). seconds:
    of the whole job, as files are structured together.
    """
    rows = files.join(problems.drop("run_id"), "file", "left")
    # A file that is not read has the name of another, maybe.
    read = F.col("error").isNull()
    rows = rows.join(validation, "run_id", "left").withColumns({c: F.when(read, F.col(c)) for c in ("valid", "reason", "schema")})
    if structured is None:
        rows = rows.withColumn("structured", F.lit(False))
    else:
        done = structured.select("run_id").distinct().withColumn("structured", F.lit(True))
        rows = rows.join(done, "run_id", "left").withColumn("structured", F.coalesce("structured", F.lit(False)) & read)
    rows = rows.withColumn("valid", F.coalesce("valid", F.lit(False)))
    tagged = F.array(*map(F.lit, tags)) if tags else F.array().cast("array<string>")
    return rows.withColumns({"finished": F.current_timestamp(), "seconds": F.lit(seconds).cast("double"), "tags": tagged})


def counts_by_outcome(report: DataFrame) -> DataFrame:
    return report.groupBy("valid", "structured").agg(F.count("*").alias("files"))


def write_tester_files(heads: DataFrame, rows: DataFrame, columns: dict[str, str], path: str, order: str = "data_point") -> None:
    """Tab-separated files with a first line of metadata and a header, one for each run (folders run_id=...).

    heads: run_id, line. rows: run_id and the columns (canonical name -> the file's), written in the order of
    ``order``; nulls are empty. With waveform.splice this joins the files of a run that was split in two.
    """
    value = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    body = rows.select("run_id", F.lit(2).alias("_part"), F.col(order).cast("double").alias("_order"), value.alias("line"))
    top = heads.select("run_id", F.lit(0).alias("_part"), F.lit(0.0).alias("_order"), "line")
    names = heads.select("run_id", F.lit(1).alias("_part"), F.lit(0.0).alias("_order"), F.lit("\t".join(columns.values())).alias("line"))
    parts = top.unionByName(names).unionByName(body).repartition("run_id").sortWithinPartitions("run_id", "_part", "_order")
    parts.select("run_id", F.col("line").alias("value")).write.mode("overwrite").partitionBy("run_id").text(path)


def write_waveform(steps: DataFrame, path: str) -> None:
    """Waveform steps as headerless tab-separated files, one for each wave_id (folders wave_id=...), or one file without such a column."""
    if "wave_id" in steps.columns:
        steps.repartition("wave_id").sortWithinPartitions("wave_id", "step").write.mode("overwrite").partitionBy("wave_id").option("sep", "\t").option("header", "false").csv(path)
    else:
        steps.coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", "false").csv(path)
