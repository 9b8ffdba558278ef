"""Formats of users: batch, stream, and in the structuring plan."""

import datetime as dt
import os

import pytest
from voltlake.plans import structure
from voltlake.sources import intake, own

COLUMNS = "data_point int, cycle_index int, step_index int, test_time double, date_time timestamp, current double, voltage double, charge_capacity double, discharge_capacity double, charge_energy double, discharge_energy double, internal_resistance double, temperature double"


def pipes_format():
    """A class made here goes to the workers as it is; they cannot import tests."""

    class Pipes(own.OwnFormat):
        """point|cycle|step|seconds|current|voltage|charge|discharge"""

        format_name, columns, pattern = "pipes", COLUMNS, r".*\.pipes"

        @staticmethod
        def parse(text):
            import datetime as dt

            for line in text.splitlines():
                point, cycle, step, *rest = line.split("|")
                t, i, v, qc, qd = map(float, rest)
                yield int(point), int(cycle), int(step), t, dt.datetime(2020, 1, 1) + dt.timedelta(seconds=t), i, v, qc, qd, 3 * qc, 3 * qd, 0.1, 25.0

    return Pipes


def text(cycles):
    rows = []
    for c in range(cycles):
        for s, i in ((1, 1.0), (2, -1.0)):
            for k in range(3):
                v, q = (3.0 + k / 4, k / 2) if i > 0 else (3.5 - k / 4, k / 2)
                rows.append(f"{len(rows)}|{c}|{s}|{10.0 * len(rows)}|{i}|{v}|{q if i > 0 else 1.0}|{q if i < 0 else 0.0}")
    return "\n".join(rows) + "\n"


@pytest.fixture
def pipes(spark):
    own.use(spark, pipes_format())
    yield
    intake.FORMATS.pop("pipes")


def place(tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for i in range(3):
        (tmp_path / "in" / f"r{i}.pipes").write_text(text(2 + i))
    (tmp_path / "in" / "sub" / "broken.pipes").write_text(text(1) + "7|what\n")
    (tmp_path / "in" / "_hidden").write_text("no")
    return str(tmp_path / "in")


def test_batch(spark, tmp_path, pipes):
    df = spark.read.format("pipes").load(place(tmp_path))
    assert df.rdd.getNumPartitions() == 4 and df.schema.names[0] == "run_id" and df.schema.names[-1] == "error"
    rows = df.collect()
    n = {r: sum(x.run_id == r and x.error is None for x in rows) for r in {x.run_id for x in rows}}
    assert n == {"r0.pipes": 12, "r1.pipes": 18, "r2.pipes": 24, "broken.pipes": 6}
    (bad,) = [x for x in rows if x.error]
    assert bad.run_id == "broken.pipes" and bad.error.startswith("after 6 rows: ValueError") and bad.voltage is None
    one = spark.read.format("pipes").load(os.path.join(str(tmp_path), "in", "r1.pipes"))
    assert one.count() == 18
    with pytest.raises(Exception, match="needs a path"):
        spark.read.format("pipes").load().count()


def test_stream(spark, tmp_path, pipes):
    where = place(tmp_path)

    def go():
        query = spark.readStream.format("pipes").load(where).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return spark.read.parquet(str(tmp_path / "out")).where("error is null").groupBy("run_id").count()

    assert {r.run_id: r["count"] for r in go().collect()} == {"r0.pipes": 12, "r1.pipes": 18, "r2.pipes": 24, "broken.pipes": 6}
    (tmp_path / "in" / "late.pipes").write_text(text(5))
    os.utime(tmp_path / "in" / "late.pipes", (dt.datetime.now().timestamp() + 60,) * 2)
    assert {r.run_id: r["count"] for r in go().collect()} == {"r0.pipes": 12, "r1.pipes": 18, "r2.pipes": 24, "broken.pipes": 6, "late.pipes": 30}


def test_structure(spark, tmp_path, pipes):
    status = structure.run(spark, place(tmp_path), str(tmp_path / "out"), resolution=5).collect()
    assert {r.run_id: (r.format, r.structured) for r in status if r.run_id.endswith(".pipes")} == {"r0.pipes": ("pipes", True), "r1.pipes": ("pipes", True), "r2.pipes": ("pipes", True), "broken.pipes": ("pipes", False)}
    assert [r.error for r in status if r.run_id == "broken.pipes"][0].startswith("1 bad rows: after 6 rows: ValueError")
    counts = {r.run_id: r["count"] for r in spark.read.parquet(str(tmp_path / "out" / "summary")).groupBy("run_id").count().collect()}
    assert set(counts) == {"r0.pipes", "r1.pipes", "r2.pipes"} and counts["r2.pipes"] >= 3


def test_wrong_width(spark):
    class Thin(own.OwnFormat):
        format_name, columns = "thin", "a int, b int"

        @staticmethod
        def parse(text):
            yield 1, 2
            yield (3,)

    files = spark.createDataFrame([("x/f", "")], "file string, text string")
    assert [tuple(r) for r in own.read_texts(files, Thin).collect()] == [("f", 1, 2, None), ("f", None, None, "after 1 rows: ValueError: a row of 1 values, not 2")]
