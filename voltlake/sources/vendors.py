"""Readers of cycler files: any number of files of one vendor as one canonical table keyed by run_id (the file's name)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.steps import accumulate
from .text import base_name, canonical, files, lines, records

# Vendor column -> canonical name, type and scale.
ARBIN = {
    "data_point": ("data_point", "int"),
    "test_time": ("test_time", "double"),
    "datetime": ("epoch", "double"),
    "step_time": ("step_time", "float"),
    "step_index": ("step_index", "smallint"),
    "cycle_index": ("cycle_index", "int"),
    "current": ("current", "float"),
    "voltage": ("voltage", "float"),
    "charge_capacity": ("charge_capacity", "double"),
    "discharge_capacity": ("discharge_capacity", "double"),
    "charge_energy": ("charge_energy", "double"),
    "discharge_energy": ("discharge_energy", "double"),
    "dv/dt": ("_dv/dt", "float"),
    "internal_resistance": ("internal_resistance", "float"),
    "temperature": ("temperature", "float"),
}
MACCOR = {
    "rec#": ("data_point", "int"),
    "cyc#": ("cycle_index", "int"),
    "step": ("step_index", "smallint"),
    "test (sec)": ("test_time", "double"),
    "step (sec)": ("step_time", "float"),
    "amp-hr": ("_capacity", "double"),
    "watt-hr": ("_energy", "double"),
    "amps": ("current", "float"),
    "volts": ("voltage", "float"),
    "state": ("_state", "string"),
    "es": ("_ending_status", "int"),
    "dpt time": ("date_time_text", "string"),
    "acimp/ohms": ("ac_impedence", "float"),
    "dcir/ohms": ("internal_resistance", "float"),
    "wf chg cap": ("_wf_chg_cap", "float"),
    "wf dis cap": ("_wf_dis_cap", "float"),
    "wf chg e": ("_wf_chg_e", "float"),
    "wf dis e": ("_wf_dis_e", "float"),
    "range": ("_range", "smallint"),
}
ARCHIVE = {
    "test_time (s)": ("test_time", "double"),
    "cycle_index": ("cycle_index", "int"),
    "current (a)": ("current", "float"),
    "voltage (v)": ("voltage", "float"),
    "charge_capacity (ah)": ("charge_capacity", "double"),
    "discharge_capacity (ah)": ("discharge_capacity", "double"),
    "charge_energy (wh)": ("charge_energy", "double"),
    "discharge_energy (wh)": ("discharge_energy", "double"),
    "cell_temperature (c)": ("temperature", "float"),
    "date_time": ("date_time_text", "string"),
}
BIOLOGIC = {
    "cycle_index": ("cycle_index", "int"),
    "cycle number": ("cycle_number", "int"),
    "Ns": ("step_index", "int"),
    "Loop": ("loop", "int"),
    "Ecell/V": ("voltage", "double"),
    "I/mA": ("current", "double", 0.001),
    "Q discharge/mA.h": ("discharge_capacity", "double", 0.001),
    "Q charge/mA.h": ("charge_capacity", "double", 0.001),
    "Energy charge/W.h": ("charge_energy", "double"),
    "Energy discharge/W.h": ("discharge_energy", "double"),
    "time/s": ("date_time_text", "string"),
}
NOVONIX = {
    "Date and Time": ("date_time_text", "string"),
    "Cycle Number": ("cycle_index", "int"),
    "Step Type": ("step_index", "int"),
    "Run Time (h)": ("test_time", "double"),
    "Step Time (h)": ("step_time", "double"),
    "Current (A)": ("current", "double"),
    "Potential (V)": ("voltage", "double"),
    "Capacity (Ah)": ("capacity", "double"),
    "Energy (Wh)": ("energy", "double"),
    "Temperature (°C)": ("temperature", "double"),
    "Circuit Temperature (°C)": ("circuit_temperature", "double"),
    "Step Number": ("step_num", "int"),
    "Step position": ("step_position", "int"),
}
NOVONIX_STEPS = {0: "rest", 1: "cc_charge", 2: "cc_discharge", 7: "cccv_charge", 8: "cv_hold_charge", 9: "cccv_discharge", 10: "cv_hold_discharge"}
NOVONIX_CHARGES = ("cc_charge", "cccv_charge", "cv_hold_charge")
NEWARE = {
    "Record ID": ("data_point", "int"),
    "Realtime": ("date_time_text", "string"),
    "Time(h:min:s.ms)": ("step_time_text", "string"),
    "Current(mA)": ("current", "double", 0.001),
    "Voltage(V)": ("voltage", "double"),
    "Capacitance_Chg(mAh)": ("charge_capacity", "double", 0.001),
    "Capacitance_DChg(mAh)": ("discharge_capacity", "double", 0.001),
    "Engy_Chg(mWh)": ("charge_energy", "double", 0.001),
    "Engy_DChg(mWh)": ("discharge_energy", "double", 0.001),
    "Temperature(C)": ("temperature", "double"),
}
#: File name patterns of the formats, in the order they are tried.
PATTERNS = (
    ("arbin", r".*CH.*\.csv"),
    ("maccor", r".*\d{5,6}.*\d{3}$"),
    ("indigo", r".*\.h5"),
    ("biologic", r"^(?!.*(_CH)).*_C.*\.(txt|csv)"),
    ("neware", r".*neware.*\.csv"),
    ("archive", r".*_timeseries\.csv"),
)


def detect(name: Column) -> Column:
    """The format that a file's name tells; null if none."""
    found = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS):
        found = F.when(name.rlike(f"^(?:{pattern})"), kind).otherwise(found)
    return found


def listing(spark: SparkSession, path: str) -> DataFrame:
    """The files under path with their format: file, name, format."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"))
    return files.select("file", base_name().alias("name"), detect(base_name()).alias("format"))


def vendor_time(text: Column) -> Column:
    """A local time of the testing laboratory (US Pacific) as a UTC timestamp; a time that is missing is midnight."""
    form = "M/d/yyyy HH:mm:ss"
    return F.to_utc_timestamp(F.coalesce(F.try_to_timestamp(text, F.lit(form)), F.try_to_timestamp(F.concat(text, F.lit(" 00:00:00")), F.lit(form))), "America/Los_Angeles")


def _first_line(line: Column, i: Column) -> Column:
    return i == 0


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("run_id", base_name()).drop("file")


def _imputed(df: DataFrame) -> DataFrame:
    for c in ("temperature", "internal_resistance"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("float"))
    return df


def read_arbin(spark: SparkSession, path: str | list[str] | DataFrame) -> DataFrame:
    rows = canonical(records(files(spark, path), _first_line, ",", lower=True), ARBIN)
    return _imputed(_keyed(rows.withColumn("date_time", F.timestamp_micros((F.col("epoch") * 1e6).cast("long"))).drop("epoch", "line_no")))


def read_arbin_metadata(spark: SparkSession, path: str | list[str] | DataFrame) -> DataFrame:
    """The first row of each metadata file as run_id (without its suffix) and a map."""
    rows = records(files(spark, path), _first_line, ",", lower=True).where("line_no = 1")
    return _keyed(rows.select("file", F.col("fields").alias("metadata"))).withColumn("run_id", F.regexp_replace("run_id", r"_Metadata\.csv$", ".csv"))


#: The fields of a Maccor file's first line, in order.
MACCOR_FIELDS = ("Today's Date", "Date of Test:", "Filename:", "Procedure:", "Comment/Barcode:")


def read_maccor_metadata(spark: SparkSession, path: str | list[str] | DataFrame) -> DataFrame:
    first = lines(spark, path).where("line_no = 0")
    pattern = "".join(rf"{f}(.*?)" for f in MACCOR_FIELDS[:-1]) + rf"{MACCOR_FIELDS[-1]}(.*)$"
    parts = {n: F.trim(F.regexp_replace(F.regexp_extract("line", pattern, i + 1), r"\t", "")).alias(n) for i, n in enumerate(("_today_datetime", "start_datetime", "filename", "protocol", "barcode"))}
    return _keyed(first.select("file", *parts.values(), F.regexp_extract(base_name(), r"\.(\d{3})$", 1).try_cast("int").alias("channel_id")))


def read_maccor(spark: SparkSession, path: str | list[str] | DataFrame) -> DataFrame:
    """Maccor tables, with capacities and energies summed over the steps of a cycle."""
    raw = _keyed(canonical(records(files(spark, path), lambda line, i: F.lower(line).startswith("rec#"), "\t", lower=True), MACCOR)).drop("line_no")
    raw = raw.withColumn("date_time", vendor_time(F.col("date_time_text"))).drop("date_time_text")
    for side, state, wave in (("charge", "C", "chg"), ("discharge", "D", "dis")):
        raw = accumulate(raw, "_capacity", state, f"_wf_{wave}_cap", f"{side}_capacity")
        raw = accumulate(raw, "_energy", state, f"_wf_{wave}_e", f"{side}_energy")
    return _imputed(raw)


def read_archive(spark: SparkSession, path: str | list[str] | DataFrame, rest: float = 1e-6) -> DataFrame:
    """Battery Archive tables; steps 1, 2, 3 are rest, charge, discharge by the current, and times count within each."""
    rows = _keyed(canonical(records(files(spark, path), _first_line, ",", lower=True), ARCHIVE)).withColumnRenamed("line_no", "data_point")
    rows = rows.withColumn("step_index", F.when(F.abs("current") < rest, 1).when(F.col("current") > 0, 2).otherwise(3))
    w = W.partitionBy("run_id").orderBy("data_point")
    change = F.coalesce((F.col("step_index") != F.lag("step_index").over(w)).cast("int"), F.lit(0))
    rows = rows.withColumn("_change", change).withColumn("_island", F.sum("_change").over(w.rowsBetween(W.unboundedPreceding, 0)))
    start = F.min_by("test_time", "data_point").over(W.partitionBy("run_id", "_island"))
    return _imputed(rows.withColumn("step_time", F.col("test_time") - start).withColumn("date_time", F.try_to_timestamp("date_time_text")).drop("_change", "_island", "date_time_text"))


def read_biologic(spark: SparkSession, path: str | list[str] | DataFrame, search: int = 200) -> DataFrame:
    """BioLogic exports: ';' in .csv (UTF-8), tabs in .txt (Latin-1); the header is the first line with Ecell/V within ``search`` lines."""
    parts = []
    for glob, separator, encoding in (("*.csv", ";", "UTF-8"), ("*.txt", "\t", "ISO-8859-1")):
        head = lambda line, i: F.contains(line, F.lit("Ecell/V")) & ~F.contains(line, F.lit("Variables")) & (i < search)
        parts.append(canonical(records(files(spark, path, encoding, glob), head, separator), BIOLOGIC))
    rows = _keyed(parts[0].unionByName(parts[1])).withColumnRenamed("line_no", "data_point")
    seconds = F.col("date_time_text").try_cast("double")
    rows = rows.withColumns({"cycle_index": F.coalesce("cycle_index", "cycle_number"), "test_time": seconds, "date_time": F.coalesce(F.try_to_timestamp("date_time_text", F.lit("MM/dd/yyyy HH:mm:ss.SSSS")), F.try_to_timestamp("date_time_text", F.lit("MM/dd/yyyy HH:mm:ss")))})
    return _imputed(rows.drop("cycle_number", "date_time_text"))


def _shown(line: Column) -> Column:
    """A Latin-1 line as its bytes are written in ASCII: backslash and tab escaped, other bytes beyond as \\xNN."""
    text = F.replace(F.replace(line, F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t"))
    odd = lambda c: F.concat(F.lit("\\x"), F.lpad(F.lower(F.hex(F.ascii(c))), 2, "0"))
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.when(F.ascii(c) > 126, odd(c)).otherwise(c)), "")


def read_biologic_metadata(spark: SparkSession, path: str | list[str] | DataFrame) -> DataFrame:
    """run_id, channel_id, barcode and protocol (md5 of its text, in hex) of BioLogic settings files.

    A channel A1 is 11. The protocol is the text from the line of its cycle definition (which is counted
    twice, as in existing digests) to the first empty line or the end; what a file lacks is null.
    """
    rows = lines(spark, path, "ISO-8859-1")
    key, last = F.element_at(F.split(F.trim("line"), " : "), 1), F.element_at(F.split(F.trim("line"), " : "), -1)
    rows = rows.withColumns({"begins": F.when(F.contains(key, F.lit("Cycle Definition")), F.col("line_no")), "key": key, "last": last, "shown": _shown(F.col("line"))})
    start = F.min("begins").over(W.partitionBy("file"))
    rows = rows.withColumn("start", start)
    rows = rows.withColumn("end", F.min(F.when((F.col("line") == "") & (F.col("line_no") > F.col("start")), F.col("line_no"))).over(W.partitionBy("file")))
    inside = (F.col("line_no") >= F.col("start")) & (F.col("end").isNull() | (F.col("line_no") < F.col("end")))
    text = F.concat("shown", F.lit("\n"))
    text = F.when(F.col("begins").isNotNull(), F.concat(text, text)).otherwise(text)
    text = F.transform(F.array_sort(F.collect_list(F.when(inside, F.struct("line_no", text.alias("t"))))), lambda s: s["t"])
    channel = F.split(F.element_at(F.split(F.trim("line"), " : "), 2), " ")[0]
    number = F.concat((F.ascii(channel) - 64).cast("string"), F.substring(channel, 2, 9)).try_cast("int")
    first = lambda value, here: F.max_by(value, F.when(here, -F.col("line_no")))
    found = rows.groupBy("file").agg(
        first(number, F.col("key") == "Run on channel").alias("channel_id"),
        first(F.col("last"), F.contains(F.col("key"), F.lit("Comments"))).alias("barcode"),
        F.when(F.max("start").isNotNull(), F.md5(F.array_join(text, ""))).alias("protocol"),
    )
    return _keyed(found)


def read_novonix(spark: SparkSession, path: str | list[str] | DataFrame, strict: bool = True) -> DataFrame:
    """Novonix exports: amounts are split by the kind of step, and discharge counts down from the cycle's maximum.

    A step code that is not known is an error: of the query if strict, else of its row (column error).
    """
    rows = _keyed(canonical(records(files(spark, path), lambda line, i: F.contains(line, F.lit("Cycle Number")), ","), NOVONIX)).withColumnRenamed("line_no", "data_point")
    names = F.create_map(*[F.lit(x) for pair in NOVONIX_STEPS.items() for x in pair])
    name, unknown = F.try_element_at(names, F.col("step_index")), F.concat(F.lit("unknown step "), F.coalesce(F.col("step_index").cast("string"), F.lit("null")))
    if strict:
        name = F.coalesce(name, F.raise_error(unknown).cast("string"))
    rows = rows.withColumns({"step_type_name": name, "error": F.coalesce("error", F.when(name.isNull(), unknown))})
    charges = F.col("step_type_name").isin(*NOVONIX_CHARGES)
    cycle = W.partitionBy("run_id", "cycle_index")
    rows = rows.withColumn("step_type", F.when(charges, "charge").otherwise("discharge"))
    for what in ("capacity", "energy"):
        # A cycle without any charge is turned around its highest capacity, for energy too.
        top = F.coalesce(F.max(F.when(charges, F.col(what))).over(cycle), F.when(F.bool_and(~charges).over(cycle), F.max("capacity").over(cycle)))
        rows = rows.withColumn(f"_top_{what}", top)
    for what in ("capacity", "energy"):
        value = F.when(F.col("step_type_name") == "rest", F.col(what)).otherwise(F.col(f"_top_{what}") - F.col(what))
        rows = rows.withColumns({f"charge_{what}": F.when(charges, F.col(what)), f"discharge_{what}": F.when(~charges, value)})
    times = [F.try_to_timestamp("date_time_text", F.lit(f)) for f in ("yyyy-MM-dd h:mm:ss a", "M/d/yyyy h:mm:ss a")]
    return _imputed(rows.withColumn("date_time", F.coalesce(*times)).drop("_top_capacity", "_top_energy", "date_time_text"))


def read_novonix_metadata(spark: SparkSession, path: str | list[str] | DataFrame) -> DataFrame:
    """Channel, cell and barcode from the summary section of each file."""
    rows = lines(spark, path)
    ends = rows.groupBy("file").agg(F.min(F.when(F.contains(F.col("line"), F.lit("[End Summary]")), F.col("line_no"))).alias("end"))
    inside = rows.join(ends, "file").where("line_no < end")
    last = F.trim(F.element_at(F.split("line", ":"), -1))
    pick = lambda phrase: F.min(F.when(F.contains(F.col("line"), F.lit(phrase)), F.nullif(last, F.lit(""))))
    return _keyed(inside.groupBy("file").agg(pick("Channel").alias("channel"), pick("Cell").alias("cell"), pick("Serial Number").alias("barcode")))


def clock_seconds(text: Column) -> Column:
    """h:m:s(.ms) as seconds."""
    p = F.split(text, ":")
    return p[0].try_cast("double") * 3600 + p[1].try_cast("double") * 60 + p[2].try_cast("double")


def read_neware(spark: SparkSession, path: str | list[str] | DataFrame) -> DataFrame:
    """Neware exports, in which rows of cycles, steps and records are interleaved.

    A record takes cycle and step of the last rows above it, and the step's resistance, else the nearest
    record's.
    """
    rows = lines(spark, path, "ISO-8859-1").where("trim(line) <> ''")
    kind = F.when(F.col("line").startswith(",,"), "record").when(F.col("line").startswith(","), "step").otherwise("cycle")
    fields = F.split("line", ",")
    rows = rows.withColumns({"kind": kind, "values": F.transform(fields, lambda x: F.trim(F.regexp_replace(x, r'["\t]', "")))})
    heads = rows.where("line_no <= 2").groupBy("file").agg(
        F.max_by("values", F.when(F.col("kind") == "step", F.col("line_no"))).alias("step_names"), F.max_by("values", F.when(F.col("kind") == "record", F.col("line_no"))).alias("names")
    )
    rows = rows.where("line_no > 2").join(heads, "file")
    upto = W.partitionBy("file").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    at = F.array_position("step_names", "DCIR(O)").cast("int")
    resistance = F.when(at > 0, F.get("values", at - 1).try_cast("double"))
    rows = rows.withColumns(
        {
            "cycle_index": F.last(F.when(F.col("kind") == "cycle", F.col("values")[0].try_cast("int")), True).over(upto),
            "step_index": F.last(F.when(F.col("kind") == "step", F.col("values")[1].try_cast("int")), True).over(upto),
            "_step_line": F.last(F.when(F.col("kind") == "step", F.struct(resistance.alias("r"))), True).over(upto),
        }
    ).where("kind = 'record'")
    n = F.least(F.size("names"), F.size("values"))
    entries = F.filter(F.arrays_zip(F.slice("names", F.lit(1), n).alias("k"), F.slice("values", F.lit(1), n).alias("v"), F.sequence(F.lit(1), n).alias("i")), lambda e: (e["k"] != "") & (F.array_position("names", e["k"]) == e["i"]))
    rows = rows.withColumn("fields", F.map_from_arrays(F.transform(entries, lambda e: e["k"]), F.transform(entries, lambda e: e["v"])))
    out = canonical(rows, NEWARE).join(rows.select("file", "line_no", "cycle_index", "step_index", F.col("_step_line.r").alias("_r")), ["file", "line_no"])
    w = W.partitionBy("file").orderBy("line_no")
    before, after = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    out = out.withColumns({"internal_resistance": F.coalesce(F.last("_r", True).over(before), F.first("_r", True).over(after)), "step_time": clock_seconds(F.col("step_time_text"))})
    out = out.withColumn("_rise", F.greatest(F.coalesce(F.col("step_time") - F.lag("step_time").over(w), F.lit(0.0)), F.lit(0.0)))
    out = out.withColumns({"test_time": F.sum("_rise").over(before), "date_time": F.coalesce(vendor_time(F.col("date_time_text")), F.try_to_timestamp("date_time_text"))})
    return _imputed(_keyed(out.drop("_r", "_rise", "step_time_text", "date_time_text", "line_no")))


def read_impedance(spark: SparkSession, path: str | list[str] | DataFrame, glob: str = "*.EDA*") -> DataFrame:
    """Maccor impedance spectra: run_id, point, and the columns of the table that follows ten lines of settings."""
    rows = files(spark, path, "ISO-8859-1", glob)
    names = {"Freq(Hz)": ("frequency", "double"), "Polar(V)": ("polarisation", "double"), "time(sec)": ("time", "double"), "Z'(a)": ("z_real", "double"), "Z''(b)": ("z_imag", "double"), "Phase_Angle": ("phase", "double"), "Z-Mag": ("z_magnitude", "double"), "C(F)": ("capacitance", "double"), "Status": ("status", "string")}
    out = canonical(records(rows, lambda line, i: F.contains(line, F.lit("Freq(Hz)")), "\t"), names)
    return _keyed(out.withColumn("point", F.row_number().over(W.partitionBy("file").orderBy("line_no")) - 1).drop("line_no"))


def project_and_number(name: Column) -> tuple[Column, Column]:
    """The project and sequence number that a run's file name starts with."""
    parts = F.split(F.element_at(F.split(name, r"\."), 1), "_")
    return parts[0], F.get(parts, F.lit(1)).try_cast("int")


def with_parameters(runs: DataFrame, parameters: DataFrame, diagnostics: DataFrame | None = None) -> DataFrame:
    """Runs (run_id: a file name) with the protocol parameters of their project and number, and the voltages of their diagnostics.

    parameters: project_name, seq_num, ...; diagnostics: diagnostic_type, diagnostic_parameter_set and the
    cutoff voltages. Without them the range is 2.7 to 4.2 V.
    """
    project, number = project_and_number(F.col("run_id"))
    out = runs.withColumns({"project_name": project, "seq_num": number}).join(parameters, ["project_name", "seq_num"], "left")
    if diagnostics is not None:
        out = out.join(diagnostics.select("diagnostic_type", "diagnostic_parameter_set", F.col("diagnostic_discharge_cutoff_voltage").alias("_lo"), F.col("diagnostic_charge_cutoff_voltage").alias("_hi")), ["diagnostic_type", "diagnostic_parameter_set"], "left")
        out = out.withColumns({"v_min": F.coalesce("_lo", F.lit(2.7)), "v_max": F.coalesce("_hi", F.lit(4.2))}).drop("_lo", "_hi")
    return out


def structuring_parameters(runs: DataFrame, parameters: DataFrame, nominal_capacity: float = 1.1) -> DataFrame:
    """Adds to runs (run_id: a file name) what their structuring needs: nominal_capacity, v_min, v_max, and the diagnostic's columns.

    parameters: project_name, seq_num, and of capacity_nominal, discharge_cutoff_voltage, charge_cutoff_voltage,
    diagnostic_type, diagnostic_parameter_set, diagnostic_start_cycle and diagnostic_interval those that there
    are. The voltage range is that of the whole project. A run without parameters has the default capacity
    and a null range.
    """
    have = set(parameters.columns)
    project, number = project_and_number(F.col("run_id"))
    own = [c for c in ("capacity_nominal", "diagnostic_type", "diagnostic_parameter_set", "diagnostic_start_cycle", "diagnostic_interval") if c in have]
    rows = runs.withColumns({"project_name": project, "seq_num": number}).join(parameters.select("project_name", "seq_num", *own, F.lit(True).alias("_known")), ["project_name", "seq_num"], "left")
    if {"discharge_cutoff_voltage", "charge_cutoff_voltage"} <= have:
        spans = parameters.groupBy("project_name").agg(F.min("discharge_cutoff_voltage").alias("v_min"), F.max("charge_cutoff_voltage").alias("v_max"))
        rows = rows.join(spans, "project_name", "left").withColumns({c: F.when(F.col("_known"), F.col(c)) for c in ("v_min", "v_max")})
    else:
        rows = rows.withColumns({c: F.lit(None).cast("double") for c in ("v_min", "v_max")})
    capacity = F.coalesce(F.col("capacity_nominal"), F.lit(nominal_capacity)) if "capacity_nominal" in have else F.lit(nominal_capacity)
    return rows.withColumn("nominal_capacity", capacity).drop("capacity_nominal", "_known")
