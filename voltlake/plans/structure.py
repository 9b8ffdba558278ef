"""The plan from raw samples to structured tables, and a thin command line over it."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cycles, diagnostics, interpolate, validate
from ..sources import intake, sinks, vendors
from ..sources.text import base_name, records
from . import learn

#: Tables that structuring makes; those that a run does not make are left empty.
TABLES = ("curves", "summary", "diagnostic_cycles", "diagnostic_curves", "diagnostic_summary")


def load(spark: SparkSession, path: str, out: str, kind: str | None = None) -> tuple[DataFrame, DataFrame]:
    """All files under path: their inventory (out/files) and their samples in one canonical table; kind: their format, else told by each file's name."""
    files = intake.take_in(spark, path, f"{out}/files", kind)
    return files, intake.read_all(spark, files)


def structure(
    raw: DataFrame,
    diagnostic: DataFrame | None = None,
    v_range: tuple | None = None,
    resolution: int = 1000,
    diagnostic_resolution: int = 500,
    nominal_capacity: float | Column = 1.1,
    full_fast_charge: float = 0.8,
    exclude: DataFrame | None = None,
    charge_axis: str = "charge_capacity",
    discharge_axis: str = "voltage",
) -> dict[str, DataFrame]:
    """The structured tables of all runs, lazily: curves, summary and, with diagnostic cycles, diagnostic_curves and diagnostic_summary.

    v_range and nominal_capacity: numbers, or columns of raw that are the same in all rows of a run.
    """
    keys = ["run_id", "cycle_index"]
    regular = raw.select(*keys).distinct()
    out = {}
    for gone in (diagnostic, exclude):
        if gone is not None:
            regular = regular.join(gone.select(*keys), keys, "left_anti")
    out["curves"] = interpolate.interpolate_cycles(raw, v_range, resolution, charge_axis, discharge_axis, cycles=regular)
    out["summary"] = cycles.summarize_cycles(raw, diagnostic, exclude, nominal_capacity, full_fast_charge)
    if diagnostic is not None:
        out["diagnostic_curves"] = interpolate.interpolate_diagnostic(raw, diagnostic, diagnostic_resolution, diagnostic_resolution)
        out["diagnostic_summary"] = cycles.summarize_diagnostic(raw, diagnostic, nominal_capacity * full_fast_charge)
    return out


def run(spark: SparkSession, path: str, out: str, kind: str | None = None, rules: dict | str | None = None, **how) -> DataFrame:
    """Reads, validates, structures and writes all files under path; returns the status, one row a file.

    A file that cannot be read, and a run that fails validation, is reported and not structured; the others
    are. Parameters as in restructure.
    """
    files, samples = load(spark, path, out, kind)
    # The files are decoded once; everything below reads the canonical table.
    sinks.write_table(samples, f"{out}/raw")
    return restructure(spark, out, rules, **how)


def _written(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def restructure(
    spark: SparkSession,
    out: str,
    rules: dict | str | None = None,
    parameters: DataFrame | None = None,
    bad_share: float = 0.0,
    validation_only: bool = False,
    tags: tuple[str, ...] = (),
    **how,
) -> DataFrame:
    """Validates and structures the raw table of a folder again, with other parameters; its structured tables are replaced.

    rules: of validation, 'auto' for those of each file's project and format, None for none. parameters: of
    protocols by project_name and seq_num; a run's own nominal capacity, its project's voltage range and its
    diagnostic cycles follow from them (over those in how). A run with more than bad_share bad rows is an error;
    bad rows are in no table but raw. validation_only: no table but the status is made.
    """
    began = time.time()
    samples, files = spark.read.parquet(f"{out}/raw"), intake.inventory(spark, f"{out}/files")
    problems = _written(spark, intake.run_problems(samples, files, bad_share), f"{out}/problems")
    raw = samples.where("error is null").drop("error").join(problems.where("error is null").select("run_id"), "run_id", "left_semi")
    if rules == "auto":
        report = validate.validate_by_project(raw)
    else:
        report = validate.validate(raw, rules or {}).withColumn("schema", F.lit("given" if rules else None).cast("string"))
    report = _written(spark, report, f"{out}/report")
    valid = raw.join(report.where("valid").select("run_id"), "run_id", "left_semi")
    settings, made = None, {}
    if parameters is not None:
        settings = vendors.structuring_parameters(report.where("valid").select("run_id"), parameters, how.get("nominal_capacity", 1.1))
        lo, hi = how.get("v_range") or (2.8, 3.5)
        settings = settings.withColumns({"v_min": F.coalesce("v_min", F.lit(lo)), "v_max": F.coalesce("v_max", F.lit(hi))})
        settings = _written(spark, settings, f"{out}/settings")
        own = {f"_{c}": c for c in ("nominal_capacity", "v_min", "v_max")}
        valid = valid.join(settings.select("run_id", *[F.col(c).cast("double").alias(n) for n, c in own.items()]), "run_id")
        how |= {"nominal_capacity": F.col("_nominal_capacity"), "v_range": (F.col("_v_min"), F.col("_v_max"))}
        if {"diagnostic_type", "diagnostic_start_cycle"} <= set(settings.columns) and "diagnostic" not in how:
            runs = settings.where("diagnostic_type = 'HPPC+RPT' and diagnostic_start_cycle is not null").select("run_id", "diagnostic_start_cycle")
            if runs.take(1):
                how["diagnostic"] = diagnostics.from_patterns(valid, runs)
    if not validation_only:
        if how.get("diagnostic") is not None:
            made["diagnostic_cycles"] = how["diagnostic"] = _written(spark, how["diagnostic"].select("run_id", "cycle_index", "cycle_type"), f"{out}/diagnostic_cycles")
        for name, table in structure(valid, **how).items():
            sinks.write_table(table, f"{out}/{name}")
            made[name] = table
        for name in TABLES:
            if name not in made:
                sinks.clear_table(spark, f"{out}/{name}")
    done = spark.read.parquet(f"{out}/summary") if "summary" in made else None
    status = sinks.status_report(files.drop("problem"), problems, report, done, time.time() - began, tags)
    if settings is not None:
        used = [c for c in settings.columns if c not in ("run_id", "project_name", "seq_num")]
        status = status.join(settings.select("run_id", F.to_json(F.struct(*used)).alias("structuring_parameters")), "run_id", "left")
    status.write.mode("overwrite").json(f"{out}/status")
    return status


def read_rules(spark: SparkSession, text: str | None) -> dict | str | None:
    """'auto', nothing, or the JSON file of rules of that path."""
    if text in (None, "auto"):
        return text
    return json.loads("\n".join(r[0] for r in spark.read.text(text, wholetext=True).collect()))


def read_parameters(spark: SparkSession, path: str) -> DataFrame:
    """Protocol parameters of all CSV files in a folder, named <project>_parameters*.csv, with their project_name and seq_num.

    Columns may differ from file to file; a file without a column project_name has its name's.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path)
    whole = found.select(F.col("path").alias("file"), F.col("content").cast("string").alias("text"))
    rows = records(whole, lambda line, i: i == 0, ",")
    project = F.regexp_extract(base_name(), r"^(.*?)_parameters", 1)
    fields = F.transform_values("fields", lambda k, v: F.nullif(F.trim(v), F.lit("")))
    rows = rows.select(fields.alias("f"), project.alias("_project"))
    get = lambda name: F.try_element_at("f", F.lit(name))
    numbers = ("capacity_nominal", "discharge_cutoff_voltage", "charge_cutoff_voltage")
    texts = ("diagnostic_type", "diagnostic_parameter_set")
    whole_numbers = ("diagnostic_start_cycle", "diagnostic_interval")
    return rows.select(
        F.coalesce(get("project_name"), "_project").alias("project_name"),
        get("seq_num").try_cast("double").cast("int").alias("seq_num"),
        *[get(c).try_cast("double").alias(c) for c in numbers],
        *[get(c).alias(c) for c in texts],
        *[get(c).try_cast("double").cast("int").alias(c) for c in whole_numbers],
    )


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="voltlake", description="Structure cycler files, make features of them, fit and use models, or inspect a table.")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("structure")
    s.add_argument("path")
    s.add_argument("out")
    s.add_argument("--format", choices=sorted(intake.FORMATS))
    s.add_argument("--resolution", type=int, default=1000)
    s.add_argument("--diagnostic-resolution", type=int, default=500)
    s.add_argument("--nominal-capacity", type=float, default=1.1)
    s.add_argument("--full-fast-charge", type=float, default=0.8)
    s.add_argument("--v-range", type=float, nargs=2, metavar=("LOW", "HIGH"))
    s.add_argument("--charge-axis", default="charge_capacity")
    s.add_argument("--discharge-axis", default="voltage")
    s.add_argument("--rules", metavar="auto|FILE", help="rules of validation: of each file's project and format, or of a JSON file")
    s.add_argument("--parameters", metavar="FOLDER", help="protocol parameters, from which capacities, voltages and diagnostic cycles follow")
    s.add_argument("--bad-share", type=float, default=0.0, help="the share of bad rows that a file may have")
    s.add_argument("--validation-only", action="store_true")
    s.add_argument("--halt-on-error", action="store_true", help="end with an error if a file was not structured; the others are")
    s.add_argument("--tag", dest="tags", action="append", default=[])
    i = sub.add_parser("inspect")
    i.add_argument("path")
    f = sub.add_parser("featurize")
    f.add_argument("path")
    f.add_argument("out")
    f.add_argument("--with", dest="wanted", action="append", required=True, metavar="NAME[={JSON}]", help="a featurizer, or package.module.function, with parameters")
    t = sub.add_parser("train")
    t.add_argument("x")
    t.add_argument("y")
    t.add_argument("out")
    t.add_argument("--target", action="append", required=True, help="several targets share their features")
    t.add_argument("--kind", choices=("elastic", "lasso", "ridge"), default="elastic")
    r = sub.add_parser("predict")
    r.add_argument("x")
    r.add_argument("model")
    r.add_argument("out")
    a = p.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "structure":
        how = {k: getattr(a, k) for k in ("resolution", "diagnostic_resolution", "nominal_capacity", "full_fast_charge", "charge_axis", "discharge_axis", "bad_share", "validation_only")}
        parameters = read_parameters(spark, a.parameters) if a.parameters else None
        run(spark, a.path, a.out, a.format, read_rules(spark, a.rules), parameters=parameters, v_range=tuple(a.v_range) if a.v_range else None, tags=tuple(a.tags), **how)
        status = spark.read.schema(sinks.STATUS).json(f"{a.out}/status").withColumn("why", F.coalesce("error", "reason"))
        sinks.counts_by_outcome(status).show()
        failed = status.where("not valid" if a.validation_only else "not structured")
        failed.select("run_id", "why").show(truncate=120)
        if a.halt_on_error and failed.take(1):
            raise SystemExit("some files were not structured")
    elif a.command == "featurize":
        named = dict(w.partition("=")[::2] for w in a.wanted)
        learn.featurize(spark, a.path, a.out, {k: json.loads(v) if v else None for k, v in named.items()}).show()
    elif a.command == "train":
        print(json.dumps(learn.train(spark, a.x, a.y, a.out, a.target[0] if len(a.target) == 1 else a.target, a.kind)))
    elif a.command == "predict":
        learn.predict(spark, a.x, a.model, a.out).show()
    else:
        df = spark.read.parquet(a.path)
        df.printSchema()
        df.show()


if __name__ == "__main__":
    main()
