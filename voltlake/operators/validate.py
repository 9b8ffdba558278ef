"""Declarative validation of raw tables: one pass of aggregates for all rules of all columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _cell(capacity: float, v_max: float, v_min: float = 0.0, t_max: float = 80.0, t_min: float = 20.0) -> dict[str, dict]:
    amount = {"max": capacity, "min": 0.0, "type": "float"}
    return {
        "charge_capacity": amount,
        "cycle_index": {"min": 0, "max_at_least": 1, "type": "integer"},
        "discharge_capacity": amount,
        "temperature": {"max": t_max, "min": t_min, "type": "float"},
        "test_time": {"type": "float"},
        "voltage": {"max": v_max, "min": v_min, "type": "float"},
    }


#: The rules of each supported kind of cell, per column in the order they are checked.
LFP_RULES = _cell(2.0, 3.8)
RULES = {
    "arbin-lfp": LFP_RULES,
    "arbin-18650-2170": _cell(6.0, 5.0, 2.0, 500.0, 0.0),
    "arbin-nmc-phev": _cell(100.0, 5.0, 0.0, 500.0, 0.0),
    "novonix": _cell(2.0, 5.0),
    "maccor-2170": {
        "data_point": {"type": "integer"},
        "cycle_index": {"min": 0, "min_is_below": 2, "max_at_least": 1, "type": "integer", "monotonic": "increasing"},
        "_state": {"type": "string"},
        "voltage": {"max": 5.0, "min": 0, "type": "float"},
        "current": {"max": 15.0, "min": -15.0, "min_is_below": 0.0, "type": "float"},
        "test_time": {"min": 0.0, "type": "float"},
        "step_time": {"min": 0.0, "type": "float"},
    },
    "maccor-lfp": {"data_point": {"type": "integer"}, "_state": {"type": "string"}, "voltage": {"max": 4.4, "min": 0.0, "type": "float"}},
}
#: The rules of a project's files, by vendor.
PROJECTS = {
    "Iris": {"arbin": "arbin-nmc-phev"},
    "xIris": {"arbin": "arbin-nmc-phev"},
    "PreDiag": {"maccor": "maccor-2170"},
    "PredictionDiagnostics": {"maccor": "maccor-2170"},
    "FastCharge": {"arbin": "arbin-lfp"},
    "ClosedLoopOED": {"arbin": "arbin-lfp"},
    "Talos": {"arbin": "arbin-18650-2170", "maccor": "maccor-2170"},
    "PriorLAMVal": {"arbin": "arbin-18650-2170"},
    "LAMVal": {"arbin": "arbin-18650-2170"},
}


#: The rules of a vendor's files in other projects.
DEFAULTS = {"arbin": "arbin-lfp", "maccor": "maccor-lfp", "novonix": "novonix"}


def rules_of(project: str, vendor: str) -> dict[str, dict]:
    """The rules of a project's files of one vendor; the vendor's default where the project has none."""
    return RULES[PROJECTS.get(project, {}).get(vendor, DEFAULTS.get(vendor, vendor))]


def validate_by_project(raw: DataFrame) -> DataFrame:
    """validate with each run's own rules, by the project of its name and its column format; adds schema, the name of those rules.

    Runs of formats without rules are valid, with a null schema. Rule sets are few (RULES), so each that is
    needed takes one pass over its own runs.
    """
    project = F.split(F.element_at(F.split("run_id", r"\."), 1), "_")[0]
    own = F.create_map(*[F.lit(x) for p, kinds in PROJECTS.items() for kind, name in kinds.items() for x in (f"{p}|{kind}", name)])
    usual = F.create_map(*[F.lit(x) for pair in DEFAULTS.items() for x in pair])
    schema = F.coalesce(F.try_element_at(own, F.concat_ws("|", project, F.col("format"))), F.try_element_at(usual, F.col("format")))
    rows = raw.withColumn("_schema", schema)
    out = None
    for name in [None, *sorted(r[0] for r in rows.select("_schema").where("_schema is not null").distinct().collect())]:
        part = rows.where(F.col("_schema").eqNullSafe(F.lit(name))).drop("_schema")
        one = validate(part, RULES[name] if name else {}).withColumn("schema", F.lit(name).cast("string"))
        out = one if out is None else out.unionByName(one)
    return out


def validate(raw: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """For every run: valid, and the message of the first rule that fails, in the order of rules.

    Rules of a column: type (integer, float, numeric, string), max, min, max_at_least (the maximum must
    reach it), min_is_below (the minimum must not be above it), monotonic 'increasing'. Nulls pass all
    rules but the integer type. The index in a message is the row of the run, from 0.
    """
    at = F.row_number().over(W.partitionBy("run_id").orderBy("data_point")) - 1
    lags = {f"_d_{c}": F.col(c) - F.lag(c).over(W.partitionBy("run_id").orderBy("data_point")) for c, r in rules.items() if r.get("monotonic") == "increasing" and c in raw.columns}
    rows = raw.withColumns({"_at": at, **lags})
    aggregates, checks = [], []

    def first(name: str, bad: Column, value: Column) -> Column:
        aggregates.append(F.min(F.when(bad, F.struct(F.col("_at").alias("at"), value.alias("value")))).alias(name))
        return F.col(name)

    for c, r in rules.items():
        if c not in raw.columns:
            checks.append((F.lit(True), F.lit(f"Column {c}: missing")))
            continue
        x, kind = F.col(c), raw.schema[c].dataType
        if "type" in r:
            numeric = isinstance(kind, T.NumericType)
            wrong = {"float": not isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)), "numeric": not numeric, "string": not isinstance(kind, T.StringType)}
            if r["type"] == "integer":
                if numeric:
                    f = first(f"_{c}_type", x.isNull() | (x != F.rint(x.cast("double"))), x.cast("double"))
                    checks.append((f.isNotNull(), F.format_string(f"Column {c}: not integer type at index %d: value=%s", f["at"], f["value"].cast("string"))))
                else:
                    checks.append((F.lit(True), F.lit(f"Column {c}: not integer type")))
            elif wrong[r["type"]]:
                checks.append((F.lit(True), F.lit(f"Column {c}: not {r['type']} type")))
        if "max" in r:
            f = first(f"_{c}_max", x > r["max"], x)
            checks.append((f.isNotNull(), F.format_string(f"{c} is higher than allowed max {r['max']} at index %d: value=%s", f["at"], f["value"].cast("string"))))
        if "min" in r:
            f = first(f"_{c}_min", x < r["min"], x)
            checks.append((f.isNotNull(), F.format_string(f"{c} is lower than allowed min {r['min']} at index %d:value=%s", f["at"], f["value"].cast("string"))))
        for rule, fails, text in (("max_at_least", lambda a, b: a < b, "needs to reach at least"), ("min_is_below", lambda a, b: a > b, "needs to reach under")):
            if rule in r:
                name = f"_{c}_{rule}"
                aggregates.append((F.max(x) if rule == "max_at_least" else F.min(x)).alias(name))
                aggregates.append(F.min_by(x, F.when(x.isNotNull(), F.col("_at"))).alias(f"{name}_0"))
                # The message of min_is_below names the max_at_least limit, as users of these messages expect.
                checks.append((fails(F.col(name), r[rule]), F.format_string(f"{c} {text} {r.get('max_at_least')} for processing, instead found:value=%s", F.col(f"{name}_0").cast("string"))))
        if r.get("monotonic") == "increasing":
            name = f"_{c}_falls"
            aggregates.append(F.bool_or(F.coalesce(F.col(f"_d_{c}") < 0, F.lit(False))).alias(name))
            checks.append((F.col(name), F.lit(f"{c} needs to be monotonically increasing for processing")))
    reason = F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), text) for bad, text in checks], F.lit("")) if checks else F.lit("")
    aggregates = aggregates or [F.count("*").alias("_n")]
    return rows.groupBy("run_id").agg(*aggregates).select("run_id", reason.alias("reason")).select("run_id", (F.col("reason") == "").alias("valid"), "reason")
