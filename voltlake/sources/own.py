"""Readers by users: a format is a class with a parser of one file's text.

The same class is a Spark data source (``spark.read.format(name)`` and ``spark.readStream.format(name)``, a
partition a file) and, once registered, a format of the structuring plan. A file that its parser cannot
read gives one row whose column error says why, and stops no other.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from . import intake

#: Rows of a file that are handed on at once.
ROWS = 10_000


def _full_schema(columns: str) -> str:
    """The schema of a format's rows: run_id, its own columns, error. As text: Python workers cannot parse it."""
    return f"run_id string, {columns}, error string"


def _rows(parse, text: str, run_id: str, width: int) -> Iterator[tuple]:
    """The rows of a file with run_id and error; what the parser raises is told in a last row."""
    n = 0
    try:
        for row in parse(text):
            row = tuple(row)
            if len(row) != width:
                raise ValueError(f"a row of {len(row)} values, not {width}")
            n += 1
            yield (run_id, *row, None)
    except Exception as e:  # any error of a user's parser is this file's alone
        yield (run_id, *[None] * width, f"after {n} rows: {type(e).__name__}: {e}")


@dataclass
class _File(InputPartition):
    """A file and when it was modified (nanoseconds)."""

    path: str
    modified: int


def _listed(path: str) -> list[_File]:
    """The files under a path or URI (of any store that Arrow knows), by name; hidden ones are left out."""
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else fs.FileSystem.from_uri(f"file://{path}")
    info = store.get_file_info(place)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(place, recursive=True))
    prefix = path[: len(path) - len(place.rstrip("/"))] if path.rstrip("/").endswith(place.rstrip("/")) else ""
    return sorted((_File(prefix + f.path, f.mtime_ns or 0) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))), key=lambda f: f.path)


class _Reader(DataSourceReader):
    def __init__(self, source: type[OwnFormat], options: dict, width: int):
        self.source, self.options, self.width = source, options, width

    def files(self) -> list[_File]:
        if "path" not in self.options:
            raise ValueError(f"{self.source.name()} needs a path")
        return _listed(self.options["path"])

    def partitions(self) -> list[InputPartition]:
        return self.files()

    def read(self, partition: _File) -> Iterator[tuple]:
        from pyarrow import fs

        store, place = fs.FileSystem.from_uri(partition.path)
        run_id = partition.path.rpartition("/")[2]
        try:
            with store.open_input_stream(place) as f:
                text = f.read().decode(self.source.encoding)
        except (OSError, UnicodeDecodeError) as e:
            yield (run_id, *[None] * self.width, f"{type(e).__name__}: {e}")
            return
        yield from _rows(self.source.parse, text, run_id, self.width)


class _StreamReader(_Reader, DataSourceStreamReader):
    """Files by their time: an offset is the latest time seen and the files of just that time."""

    def initialOffset(self) -> dict:
        return {"modified": -1, "files": "[]"}

    def latestOffset(self) -> dict:
        files = self.files()
        last = max((f.modified for f in files), default=-1)
        return {"modified": last, "files": json.dumps([f.path for f in files if f.modified == last])}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, upto = set(json.loads(start["files"])), set(json.loads(end["files"]))
        return [f for f in self.files() if (f.modified > start["modified"] or (f.modified == start["modified"] and f.path not in before)) and (f.modified < end["modified"] or f.path in upto)]

    def commit(self, end: dict) -> None:
        pass


class OwnFormat(DataSource):
    """Base of users' formats: set format_name and columns (DDL), and define parse.

    pattern: how names of such files look, for the structuring plan (None: they are named with ``--format``).
    """

    format_name: str
    columns: str
    pattern: str | None = None
    encoding: str = "utf-8"

    @staticmethod
    def parse(text: str) -> Iterable[tuple]:
        """The rows of one file, in the order of columns; whatever it raises becomes the file's error."""
        raise NotImplementedError

    @classmethod
    def name(cls) -> str:
        return cls.format_name

    def schema(self) -> str:
        return _full_schema(self.columns)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(type(self), self.options, len(schema.fields) - 2)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _StreamReader(type(self), self.options, len(schema.fields) - 2)


def use(spark: SparkSession, source: type[OwnFormat]) -> None:
    """Makes a format known to spark.read and to the structuring plan."""
    spark.dataSource.register(source)
    intake.register(intake.Format(source.name(), source.pattern, lambda spark, files: read_texts(files, source), "ISO-8859-1" if source.encoding.lower() in ("iso-8859-1", "latin-1") else "UTF-8"))


def read_texts(files: DataFrame, source: type[OwnFormat]) -> DataFrame:
    """The rows of a table of files (file, text) by a format's parser."""
    schema, parse = T.StructType.fromDDL(_full_schema(source.columns)), source.parse
    width = len(schema.fields) - 2

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, text in zip(batch["file"], batch["text"]):
                held = []
                for row in _rows(parse, text, file.rpartition("/")[2], width):
                    held.append(row)
                    if len(held) >= ROWS:
                        yield pd.DataFrame(held, columns=schema.names)
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=schema.names)

    return files.mapInPandas(rows, schema)
