"""Test protocols as tables: the steps that a row of parameters stands for.

Vendors' procedure documents are not made here; a row for each step with its mode, value and end is what
they are filled from, for a whole table of parameters at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duration(seconds: Column) -> Column:
    """HH:MM:SS of whole seconds, modulo a day."""
    s = F.bround(seconds, 0).cast("long") % 86400
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def _step(number: int, kind: str, mode: str, value: Column, end: str, until: Column) -> Column:
    return F.struct(F.lit(number).alias("step"), F.lit(kind).alias("kind"), F.lit(mode).alias("mode"), value.cast("double").alias("value"), F.lit(end).alias("end_type"), until.cast("string").alias("end_value"))


def regular_cycle(parameters: DataFrame) -> DataFrame:
    """parameters (seq_num and the columns below) as the steps of a regular cycle: seq_num, step, kind, mode, value, end_type, end_value.

    Two charge currents (the first up to a percentage, the second up to a voltage), a hold and a rest;
    then a discharge down to a voltage and a rest. Currents are rates times the nominal capacity.
    """
    c = F.col
    steps = F.array(
        _step(1, "Charge", "Current", F.bround(c("charge_constant_current_1") * c("capacity_nominal"), 3), "StepTime", duration(3600 * c("charge_percent_limit_1") / 100 / c("charge_constant_current_1"))),
        _step(2, "Charge", "Current", F.bround(c("charge_constant_current_2") * c("capacity_nominal"), 3), "Voltage", F.bround(c("charge_cutoff_voltage"), 3)),
        _step(3, "Charge", "Voltage", c("charge_cutoff_voltage"), "StepTime", duration(60 * c("charge_constant_voltage_time"))),
        _step(4, "Rest", "", F.lit(None), "StepTime", duration(60 * c("charge_rest_time"))),
        _step(5, "Dischrge", "Current", F.bround(c("discharge_constant_current_1") * c("capacity_nominal"), 3), "Voltage", F.bround(c("discharge_cutoff_voltage"), 3)),
        _step(6, "Rest", "", F.lit(None), "StepTime", duration(60 * c("discharge_rest_time"))),
    )
    return parameters.select("seq_num", F.explode(steps).alias("s")).select("seq_num", "s.*")


def first_rest(parameters: DataFrame) -> DataFrame:
    """The rest before the first cycle: three hours and 12 minutes for each place in a cabinet of 96."""
    return parameters.select("seq_num", duration(3 * 3600 + 720 * (F.col("seq_num") % 96)).alias("rest"))


def diagnostic_blocks(parameters: DataFrame) -> DataFrame:
    """The steps of a diagnostic with parameters: seq_num, block, step, kind, mode, value, limit, ends.

    block: reset, hppc or rpt. step: its place in the block, from 0 (places between are fixed steps without
    parameters). Currents are rates times capacity_nominal, to three places (a reset's to four); limit is
    the voltage of a charge, or the current of a hold. ends: type=value, the first that is met.
    """
    c = F.col
    amps = lambda name, places=3: F.bround(c("capacity_nominal") * c(name), places)
    volts = lambda name: F.bround(c(name), 3)
    high, low, base = volts("diagnostic_charge_cutoff_voltage"), volts("diagnostic_discharge_cutoff_voltage"), amps("HPPC_baseline_constant_current")
    end_current = ("Current", amps("diagnostic_cutoff_current"))
    nothing = F.lit(None).cast("double")

    def step(block: str, place: int, kind: str, mode: str, value: Column, limit: Column, *ends: tuple[str, Column]) -> Column:
        told = F.concat_ws(";", *[F.concat(F.lit(f"{name}="), v.cast("string")) for name, v in ends])
        return F.struct(F.lit(block).alias("block"), F.lit(place).alias("step"), F.lit(kind).alias("kind"), F.lit(mode).alias("mode"), value.alias("value"), limit.alias("limit"), told.alias("ends"))

    rest = lambda name, unit: ("StepTime", duration(unit * c(name)))
    interval = 3600 * (c("HPPC_interval") / 100) / c("HPPC_baseline_constant_current") - 1
    charge = ("rpt", "Charge", "Current", amps("RPT_charge_constant_current"), high, end_current)
    steps = [
        step("reset", 0, "Charge", "Current", amps("reset_cycle_current", 4), high, ("Current", amps("reset_cycle_cutoff_current", 4))),
        step("reset", 1, "Dischrge", "Current", amps("reset_cycle_current", 4), nothing, ("Voltage", low)),
        step("hppc", 0, "Charge", "Current", base, high, end_current),
        step("hppc", 2, "Rest", "", nothing, nothing, rest("HPPC_rest_time", 60)),
        step("hppc", 3, "Dischrge", "Current", amps("HPPC_pulse_current_1"), nothing, rest("HPPC_pulse_duration_1", 1), ("Voltage", low)),
        step("hppc", 4, "Rest", "", nothing, nothing, rest("HPPC_pulse_rest_time", 1)),
        step("hppc", 5, "Charge", "Current", amps("HPPC_pulse_current_2"), nothing, rest("HPPC_pulse_duration_2", 1), ("Voltage", volts("HPPC_pulse_cutoff_voltage"))),
        step("hppc", 6, "Dischrge", "Current", base, nothing, ("StepTime", duration(interval)), ("Voltage", low)),
        step("hppc", 8, "Dischrge", "Voltage", low, base, end_current),
    ]
    for i in range(3):
        steps.append(step(charge[0], 3 * i, *charge[1:]))
        steps.append(step("rpt", 3 * i + 1, "Dischrge", "Current", amps(f"RPT_discharge_constant_current_{i + 1}"), nothing, ("Voltage", low)))
    return parameters.select("seq_num", F.explode(F.array(*steps)).alias("s")).select("seq_num", "s.*")
