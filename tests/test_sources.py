"""Readers on files made here in each vendor's format."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F
from voltlake.plans import structure
from voltlake.sources import sinks, vendors

ARBIN = """Data_Point,Test_Time,DateTime,Step_Time,Step_Index,Cycle_Index,Current,Voltage,Charge_Capacity,Discharge_Capacity,Charge_Energy,Discharge_Energy,dV/dt,Internal_Resistance
0,10.5,1494645243.4715,10.5,1,0,0.0,3.30,0.0,0.0,0.0,0.0,0.0,0.016
1,20.5,1494645253.4715,20.5,2,0,1.1,3.40,0.5,0.0,1.7,0.0,0.0,
2,30.5,1494649863.4715,30.5,3,0,-1.1,3.20,0.5,0.4,1.7,1.3,0.0,0.017
"""
MACCOR_HEAD = "Today's Date 10/10/2019  Date of Test:\t10/09/2019\t Filename:\tC:\\x\\Pre_000151.052 Procedure: Pre_000151.000\tComment/Barcode: 00001E"
MACCOR_NAMES = "Rec#\tCyc#\tStep\tTest (Sec)\tStep (Sec)\tAmp-hr\tWatt-hr\tAmps\tVolts\tState\tES\tDPt Time\tACImp/Ohms\tDCIR/Ohms\tWF Chg Cap\tWF Dis Cap\tWF Chg E\tWF Dis E\tRange"


def maccor_row(rec, cyc, step, amp, state, es, time="10/21/2019 23:59:59"):
    return f"{rec}\t{cyc}\t{step}\t{rec}.0\t1.0\t{amp}\t{amp * 3}\t1.0\t3.5\t{state}\t{es}\t{time}\t0\t0\tN/A\tN/A\tN/A\tN/A\t1"


def write(path, name, text, encoding="utf-8"):
    (path / name).write_bytes(text.encode(encoding))
    return str(path / name)


def test_arbin(spark, tmp_path):
    p = write(tmp_path, "A_CH1.csv", ARBIN)
    rows = vendors.read_arbin(spark, p).orderBy("data_point").collect()
    assert [r.step_index for r in rows] == [1, 2, 3] and rows[1].internal_resistance is None and rows[0].temperature is None
    assert rows[0].run_id == "A_CH1.csv" and abs(rows[0].date_time.timestamp() - 1494645243.4715) < 1e-3
    write(tmp_path, "A_CH1_Metadata.csv", "test_id,item_id\n7,EL1\n")
    (m,) = vendors.read_arbin_metadata(spark, str(tmp_path / "A_CH1_Metadata.csv")).collect()
    assert m.run_id == "A_CH1.csv" and m.metadata["item_id"] == "EL1"


def test_maccor(spark, tmp_path):
    body = [maccor_row(1, 1, 1, 0.0, "C", 1), maccor_row(2, 1, 1, 0.5, "C", 129), maccor_row(3, 1, 2, 0.2, "C", 1), maccor_row(4, 1, 2, 0.3, "C", 129), maccor_row(5, 1, 3, 0.7, "D", 129, "10/22/2019"), maccor_row(6, 2, 1, 0.1, "C", 129), maccor_row(7, 2, 2, 0.0, "C", 1)]
    p = write(tmp_path, "Pre_000151_00001E.052", "\r\n".join([MACCOR_HEAD, MACCOR_NAMES, *body]))
    rows = vendors.read_maccor(spark, p).orderBy("data_point").collect()
    assert [round(r.charge_capacity, 6) for r in rows] == [0.0, 0.5, 0.7, 0.8, 0.8, 0.1, 0.1]
    assert [round(r.discharge_capacity, 6) for r in rows] == [0, 0, 0, 0, 0.7, 0.0, 0.0]
    assert rows[0].date_time == dt.datetime(2019, 10, 22, 6, 59, 59) and rows[4].date_time == dt.datetime(2019, 10, 22, 7)
    (m,) = vendors.read_maccor_metadata(spark, p).collect()
    assert (m.barcode, m.protocol, m.channel_id, m.start_datetime) == ("00001E", "Pre_000151.000", 52, "10/09/2019")


def test_archive(spark, tmp_path):
    text = "Date_Time,Test_Time (s),Cycle_Index,Current (A),Voltage (V),Charge_Capacity (Ah),Discharge_Capacity (Ah),Charge_Energy (Wh),Discharge_Energy (Wh),Environment_Temperature (C),Cell_Temperature (C)\n"
    text += "".join(f"2019-01-01 00:00:{i:02d},{i},1,{c},3.5,0,0,0,0,25,26\n" for i, c in enumerate((0, 1, 1, -1, -1, 0, 1)))
    rows = vendors.read_archive(spark, write(tmp_path, "x_timeseries.csv", text)).orderBy("data_point").collect()
    assert [(r.step_index, r.step_time) for r in rows] == [(1, 0), (2, 0), (2, 1), (3, 0), (3, 1), (1, 0), (2, 0)]


def test_biologic(spark, tmp_path):
    head = "EC-Lab\nVariables Ecell/V\n"
    write(tmp_path, "b_CA1.csv", head + "Ns;cycle number;Ecell/V;I/mA;Q discharge/mA.h;Q charge/mA.h;Energy charge/W.h;Energy discharge/W.h;time/s;junk\n1;2;3.5;1000;0;500;1.5;0;12.5;x\n")
    write(tmp_path, "c_CA2.txt", head + "Ns\tEcell/V\tI/mA\tcycle number\n4\t3.1\t-500\t9\n", "latin-1")
    rows = {r.run_id: r for r in vendors.read_biologic(spark, str(tmp_path)).collect()}
    assert (rows["b_CA1.csv"].current, rows["b_CA1.csv"].charge_capacity, rows["b_CA1.csv"].cycle_index) == (1.0, 0.5, 2)
    assert (rows["c_CA2.txt"].current, rows["c_CA2.txt"].step_index, rows["c_CA2.txt"].cycle_index) == (-0.5, 4, 9)


NOVONIX = """[Summary]
Channel: 12
Cell: c
Serial Number: S9
[End Summary]
Date and Time,Cycle Number,Step Type,Run Time (h),Step Time (h),Current (A),Potential (V),Capacity (Ah),Energy (Wh),Temperature (°C),Circuit Temperature (°C),Step Number,Step position
"""


def test_novonix(spark, tmp_path):
    rows = ["2021-01-05 3:04:05 PM,0,1,0,0,1,4,2.0,8,25,26,0,0", "1/5/2021 4:04:05 PM,0,2,1,0,-1,3,1.5,6,25,26,1,0", "x,0,0,1,0,0,3,0.5,2,25,26,2,0", "x,1,2,1,0,-1,3,1.0,4,25,26,1,0"]
    p = write(tmp_path, "n_CH.csv", NOVONIX + "\n".join(rows))
    got = vendors.read_novonix(spark, p).orderBy("data_point").collect()
    assert [(r.charge_capacity, r.discharge_capacity) for r in got] == [(2.0, None), (None, 0.5), (None, 0.5), (None, 0.0)]
    assert got[3].discharge_energy == -3.0 and got[0].date_time == dt.datetime(2021, 1, 5, 15, 4, 5) and got[1].date_time.hour == 16
    (m,) = vendors.read_novonix_metadata(spark, p).collect()
    assert (m.channel, m.cell, m.barcode) == ("12", "c", "S9")
    bad = write(tmp_path, "bad.csv", NOVONIX + rows[0].replace(",0,1,0", ",0,5,0", 1))
    with pytest.raises(Exception, match="unknown step 5"):
        vendors.read_novonix(spark, bad).collect()


def test_neware(spark, tmp_path):
    text = "Cycle ID,x\n,Step ID,Name,DCIR(O)\n,,Record ID,Time(h:min:s.ms),Voltage(V),Current(mA),Temperature(C),Capacitance_Chg(mAh),Capacitance_DChg(mAh),Engy_Chg(mWh),Engy_DChg(mWh),Realtime\n"
    text += '1,a\n,"1",CC,-\n,,1,0:00:00.000,3.0,1000,25,10,0,30,0,2020-01-01 00:00:00\n,,2,0:00:10.000,3.1,1000,25,20,0,60,0,2020-01-01 00:00:10\n,"2",CD,0.05\n,,3,0:00:00.000,3.2,-1000,25,20,0,60,0,2020-01-01 00:00:11\n2,b\n,"3",CC,-\n,,4,0:00:05.500,3.2,-1000,25,20,0,60,0,2020-01-01 00:00:16\n'
    got = vendors.read_neware(spark, write(tmp_path, "neware.csv", text, "latin-1")).orderBy("data_point").collect()
    assert [(r.cycle_index, r.step_index) for r in got] == [(1, 1), (1, 1), (1, 2), (2, 3)]
    assert [r.test_time for r in got] == [0, 10, 10, 15.5] and [r.internal_resistance for r in got] == [0.05] * 4 and got[0].charge_capacity == 0.01


def test_impedance(spark, tmp_path):
    text = "\n".join(["head"] * 9) + "\nFreq(Hz)\tZ'(a)\tZ''(b)\n1000\t0.02\t-0.01\n500\t0.03\t-0.02\n"
    got = vendors.read_impedance(spark, write(tmp_path, "x.EDA0001.041", text)).orderBy("point").collect()
    assert [(r.frequency, r.z_real, r.z_imag) for r in got] == [(1000, 0.02, -0.01), (500, 0.03, -0.02)]


def test_detect(spark):
    names = ["2017_CH33.csv", "xTESLADIAG_000019_CH70.070", "a.h5", "test_CA1.txt", "neware_test.csv", "SNL_18650_timeseries.csv", "what.bin"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.k for r in df.select(vendors.detect(F.col("n")).alias("k")).collect()] == ["arbin", "maccor", "indigo", "biologic", "neware", "archive", None]


def test_parameters(spark):
    runs = spark.createDataFrame([("Pre_000151_x.052",), ("Other_1.csv",)], "run_id string")
    params = spark.createDataFrame([("Pre", 151, 1.5, "HPPC", "A")], "project_name string, seq_num int, charge_constant_current_1 double, diagnostic_type string, diagnostic_parameter_set string")
    diag = spark.createDataFrame([("HPPC", "A", 2.5, 4.4)], "diagnostic_type string, diagnostic_parameter_set string, diagnostic_discharge_cutoff_voltage double, diagnostic_charge_cutoff_voltage double")
    got = {r.run_id: (r.charge_constant_current_1, r.v_min, r.v_max) for r in vendors.with_parameters(runs, params, diag).collect()}
    assert got == {"Pre_000151_x.052": (1.5, 2.5, 4.4), "Other_1.csv": (None, 2.7, 4.2)}


def test_structure_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        write(tmp_path / "in", f"R{i}_CH1.csv", ARBIN)
    write(tmp_path / "in", "bad_CH2.csv", ARBIN.replace("3.40", "9.40"))
    status = structure.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), rules={"voltage": {"max": 5.0}}, resolution=5)
    got = {r.run_id: (r.valid, r.structured) for r in status.collect()}
    assert got == {"R0_CH1.csv": (True, True), "R1_CH1.csv": (True, True), "R2_CH1.csv": (True, True), "bad_CH2.csv": (False, False)}
    summary = spark.read.parquet(str(tmp_path / "out" / "summary"))
    assert summary.count() == 3 and summary.first().paused > 4000
    docs = sinks.column_lists(summary.select("run_id", "cycle_index", "charge_capacity"), "cycle_index")
    back = sinks.from_column_lists(docs, {"cycle_index": "int", "charge_capacity": "double"})
    assert sorted(map(tuple, back.collect())) == sorted((r.run_id, r.cycle_index, r.charge_capacity) for r in summary.collect())


def test_biologic_metadata(spark, tmp_path):
    import hashlib

    lines = ["EC-LAB SETTING FILE", "Run on channel : B12 (SN 0419)", "Comments : cell\xb07", "Cycle Definition : Charge\talternance", "Ns\t0", "I \\ mA\xb2", "", "Comments : later"]
    (tmp_path / "t_C.mps").write_bytes("\r\n".join(lines).encode("latin-1") + b"\r\n")
    (tmp_path / "u_C.mps").write_bytes(b"Run on channel : A1 (SN 1)\r\nCycle Definition : x\r\ny\r\n")
    got = {r.run_id: r for r in vendors.read_biologic_metadata(spark, str(tmp_path)).collect()}
    shown = [repr(x.encode("latin-1"))[2:-1] for x in lines[3:6]]
    text = "\n".join([shown[0], *shown]) + "\n"
    assert (got["t_C.mps"].channel_id, got["t_C.mps"].barcode, got["t_C.mps"].protocol) == (212, "cell\xb07", hashlib.md5(text.encode()).hexdigest())
    assert (got["u_C.mps"].channel_id, got["u_C.mps"].barcode, got["u_C.mps"].protocol) == (11, None, hashlib.md5(b"Cycle Definition : x\nCycle Definition : x\ny\n").hexdigest())


def test_tester_files_of_spliced_runs(spark, tmp_path):
    from voltlake.operators import waveform
    from voltlake.sources import sinks

    columns = {"data_point": "Rec#", "cycle_index": "Cyc#", "test_time": "Test (Sec)", "voltage": "Volts"}
    schema = "run_id string, data_point int, cycle_index int, test_time double, voltage double"
    first = spark.createDataFrame([("a", 1, 0, 0.5, 3.0), ("a", 2, 1, 9.0, None), ("b", 1, 0, 0.0, 3.5)], schema)
    second = spark.createDataFrame([("a", 1, 0, 1.0, 3.2), ("a", 2, 0, 2.0, 3.3)], schema)
    heads = spark.createDataFrame([("a", "Today's Date\t1/1/2020"), ("b", "x")], "run_id string, line string")
    sinks.write_tester_files(heads, waveform.splice(first, second), columns, str(tmp_path / "out"))
    text = [f.read_text().splitlines() for f in (tmp_path / "out" / "run_id=a").glob("part-*")]
    assert text == [["Today's Date\t1/1/2020", "Rec#\tCyc#\tTest (Sec)\tVolts", "1\t0\t0.5\t3.0", "2\t1\t9.0\t", "3\t1\t10.0\t3.2", "4\t1\t11.0\t3.3"]]
    rows = sorted((r.data_point, r.voltage) for r in vendors.read_maccor(spark, str(tmp_path / "out" / "run_id=a")).collect())
    assert [r[0] for r in rows] == [1, 2, 3, 4] and rows[1][1] is None


def cycle_rows(cycles, steps):
    """Arbin rows of cycles, each with the numbers of steps that steps(cycle) tells."""
    out, n = [], 0
    for c in cycles:
        for s in steps(c):
            for k in range(4):
                i, v = (1.0, 3.0 + 0.2 * k) if s % 2 else (-1.0, 3.7 - 0.2 * k)
                q = 0.25 * (k + 1)
                out.append(f"{n},{n * 10.0},{1494645243 + n * 10},{k * 10.0},{s},{c},{i},{v:.2f},{q if i > 0 else 1.0},{q if i < 0 else 0.0},{q * 3},{q * 3},0.0,0.016")
                n += 1
    return ARBIN.splitlines()[0] + "\n" + "\n".join(out) + "\n"


def fleet(path):
    """Good files, and one of each kind of bad one."""
    (path / "in" / "deeper").mkdir(parents=True)
    diagnosed = cycle_rows(range(0, 20), lambda c: (1, 2, 3, 4) if c in (1, 9) else (5, 6, 7, 8, 9, 10) if c in (2, 10) else (1, 2) if c > 2 else (1, 4))
    write(path / "in", "FastCharge_000001_CH1.csv", cycle_rows(range(3), lambda c: (1, 2)))
    write(path / "in", "PreDiag_000002_CH2.csv", diagnosed)
    write(path / "in", "FastCharge_000003_CH3.csv", cycle_rows(range(3), lambda c: (1, 2)).replace(",3.20,", ",9.20,"))
    write(path / "in", "FastCharge_000004_CH4.csv", cycle_rows(range(3), lambda c: (1, 2)).replace(",3.20,", ",3.2O,", 1))
    write(path / "in", "FastCharge_000005_CH5.csv", "")
    write(path / "in", "FastCharge_000006_CH6.csv", "no such header\n")
    (path / "in" / "FastCharge_000007_CH7.csv").write_bytes(b"\xff\xfe\x00bad")
    write(path / "in", "notes.bin", "x")
    write(path / "in", "cell.h5", "x")
    write(path / "in" / "deeper", "FastCharge_000001_CH1.csv", cycle_rows(range(2), lambda c: (1, 2)))
    (path / "p").mkdir()
    write(path / "p", "PreDiag_parameters v1.csv", "seq_num,capacity_nominal,discharge_cutoff_voltage,charge_cutoff_voltage,diagnostic_type,diagnostic_parameter_set,diagnostic_start_cycle,diagnostic_interval\n2,2.5,3.1,3.7,HPPC+RPT,Tesla21700,3,8\n9,1.0,3.0,3.8,,,,\n")
    write(path / "p", "FastCharge_parameters.csv", "project_name,seq_num,capacity_nominal\nFastCharge,1,1.5\n")


def test_bad_files_stop_no_other(spark, tmp_path):
    fleet(tmp_path)
    place = lambda name: str(tmp_path / name)
    status = structure.run(spark, place("in"), place("out"), rules="auto", resolution=5, tags=("a", "b"))
    got = {r.file.split("/in/")[1]: r for r in status.collect()}
    why = {k: r.error or r.reason for k, r in got.items()}
    assert len(got) == 10
    assert [k for k, r in sorted(got.items()) if r.structured] == ["FastCharge_000001_CH1.csv", "PreDiag_000002_CH2.csv"]
    assert why["FastCharge_000003_CH3.csv"].startswith("voltage is higher than allowed max 3.8 at index 1")
    assert why["FastCharge_000004_CH4.csv"] == "1 bad rows: line 3: voltage is no float: 3.2O" and got["FastCharge_000004_CH4.csv"].n_bad == 1
    assert why["FastCharge_000005_CH5.csv"] == "the file is empty" and why["FastCharge_000006_CH6.csv"] == "no header or no rows"
    assert why["FastCharge_000007_CH7.csv"] == "its bytes are no UTF-8 text"
    assert why["notes.bin"] == "no known format by its name" and why["cell.h5"] == "no reader for format indigo"
    assert why["deeper/FastCharge_000001_CH1.csv"].startswith("another file of this name") and not got["deeper/FastCharge_000001_CH1.csv"].valid
    one = got["FastCharge_000001_CH1.csv"]
    assert one.raw_md5 == hashlib.md5((tmp_path / "in" / "FastCharge_000001_CH1.csv").read_bytes()).hexdigest()
    assert (one.schema, one.valid, one.error, one.n_rows, one.tags) == ("arbin-lfp", True, None, 24, ["a", "b"]) and one.seconds > 0
    # A share of bad rows may be allowed; they are left out.
    again = structure.restructure(spark, place("out"), bad_share=0.1, resolution=5)
    assert {r.run_id for r in again.where("structured").collect()} >= {"FastCharge_000004_CH4.csv"}


def test_structure_by_parameters(spark, tmp_path):
    fleet(tmp_path)
    place = lambda name: str(tmp_path / name)
    structure.main(["structure", place("in"), place("out"), "--rules", "auto", "--parameters", place("p"), "--resolution", "5", "--diagnostic-resolution", "7", "--tag", "t"])
    table = lambda name: spark.read.parquet(place(f"out/{name}"))
    diagnostic = sorted((r.cycle_index, r.cycle_type) for r in table("diagnostic_cycles").collect())
    assert diagnostic[:5] == [(1, "reset"), (2, "hppc"), (3, "rpt_0.2C"), (4, "rpt_1C"), (5, "rpt_2C")] and (9, "reset") in diagnostic and len(diagnostic) == 10
    assert {r.run_id for r in table("diagnostic_summary").collect()} == {"PreDiag_000002_CH2.csv"}
    regular = {r.cycle_index for r in table("summary").where("run_id like 'Pre%'").collect()}
    assert not regular & {c for c, _ in diagnostic} and {0, 6, 7, 8} <= regular
    # The voltage range is the whole project's, 3.0 to 3.8; that of runs without one is the default.
    ends = lambda run: table("curves").where(F.col("run_id").startswith(run) & (F.col("axis") == "voltage")).agg(F.min("voltage"), F.max("voltage")).first()
    assert tuple(ends("PreDiag")) == (3.0, 3.8) and tuple(ends("FastCharge")) == (2.8, 3.5)
    used = {r.run_id: r.structuring_parameters for r in spark.read.schema(sinks.STATUS).json(place("out/status")).where("structured").collect()}
    assert '"nominal_capacity":2.5' in used["PreDiag_000002_CH2.csv"] and '"nominal_capacity":1.5' in used["FastCharge_000001_CH1.csv"]
    # Structured again without diagnostics, no row of them is left, and the cycles are regular ones.
    structure.restructure(spark, place("out"), "auto", resolution=5)
    assert table("diagnostic_summary").count() == table("diagnostic_curves").count() == table("diagnostic_cycles").count() == 0
    assert {c for c, _ in diagnostic} <= {r.cycle_index for r in table("summary").where("run_id like 'Pre%'").collect()} | {19}
    with pytest.raises(SystemExit):
        structure.main(["structure", place("in"), place("v"), "--validation-only", "--halt-on-error"])
    assert not (tmp_path / "v" / "summary").exists()


def test_files_are_decoded_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in", "A_CH1.csv", cycle_rows(range(5), lambda c: (1, 2)))
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    files, samples = structure.load(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    sinks.write_table(samples.mapInArrow(counted, samples.schema), str(tmp_path / "out" / "raw"))
    assert seen.value == 40 == spark.read.parquet(str(tmp_path / "out" / "raw")).count()
