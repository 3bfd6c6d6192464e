"""Tables of runs as a data source of Spark: JSON lines by run, published by commits, read in batches or as a stream of commits.

    register(spark)
    write_runs(rows, path)                                       # rows with run_id; Spark makes the JSON, tasks only store it
    spark.read.format("trackmill_runs").schema(S).load(path)     # S and run_id; a filter on run_id opens no other run's files
    spark.readStream.format("trackmill_runs").schema(S).load(path)

A writing task stores files under names of their own. Only when all tasks are done does the driver write a commit, a list of the files with their lengths, rows and SHA-256, and only
what a commit lists is ever read: a task that is lost or runs twice leaves files that nobody sees. Commits are numbered by one writer at a time. A folder without commits is read by its files, <run>/*.jsonl.
Folders are of any store that pyarrow's file systems open."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.json as pajson
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from .tables import json_ready

NAME, COMMITS, RUN = "trackmill_runs", "_commits", "run_id"


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    fs, at = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return fs, at.rstrip("/")


def commits(path: str) -> list[list[dict]]:
    """What each commit lists, in order."""
    fs, at = _store(path)
    found = fs.get_file_info(pafs.FileSelector(f"{at}/{COMMITS}", allow_not_found=True))
    return [json.loads(fs.open_input_stream(f.path).read()) for f in sorted(found, key=lambda f: f.path) if f.path.endswith(".json")]


def _files(path: str) -> list[dict]:
    """Committed files or, without a commit, all of the runs' folders."""
    if listed := commits(path):
        return [f for c in listed for f in c]
    fs, at = _store(path)
    found = fs.get_file_info(pafs.FileSelector(at, recursive=True, allow_not_found=True))
    return [{"file": f.path[len(at) + 1 :], "run": f.path.split("/")[-2]} for f in sorted(found, key=lambda f: f.path) if f.is_file and f.path.endswith(".jsonl") and "/" in f.path[len(at) + 1 :]]


@dataclass
class RunFile(InputPartition):
    file: str
    run: str


@dataclass
class Stored(WriterCommitMessage):
    files: list


def _batches(path: str, part: RunFile, schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """A file's rows in the schema's columns, of which run_id is the folder's name. Blank lines don't count, fields that a line lacks are null, other ones are left out."""
    fs, at = _store(path)
    own = to_arrow_schema(T.StructType([f for f in schema if f.name != RUN]))
    if fs.get_file_info(f"{at}/{part.file}").size == 0:
        return
    options = pajson.ParseOptions(explicit_schema=own, unexpected_field_behavior="ignore")
    reader = pajson.open_json(fs.open_input_stream(f"{at}/{part.file}"), pajson.ReadOptions(block_size=8 << 20), options)
    for batch in reader:
        columns = [pa.array([unquote(part.run)] * batch.num_rows, pa.string()) if f.name == RUN else batch.column(f.name) for f in schema]
        yield pa.RecordBatch.from_arrays(columns, names=schema.names)


class RunReader(DataSourceReader):
    """A partition for each file. Filters run_id = and run_id IN are answered by the folders, and Spark is told so."""

    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema_, self.runs = path, schema, None

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == (RUN,):
                asked = set(f.value) if isinstance(f, In) else {f.value}
                self.runs = asked if self.runs is None else self.runs & asked
            else:
                yield f

    def partitions(self):
        return [RunFile(f["file"], f["run"]) for f in _files(self.path) if self.runs is None or unquote(f["run"]) in self.runs]

    def read(self, partition: RunFile):
        yield from _batches(self.path, partition, self.schema_)


class RunStream(DataSourceStreamReader):
    """The offset is a number of commits."""

    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema_ = path, schema

    def initialOffset(self) -> dict:
        return {"commits": 0}

    def latestOffset(self) -> dict:
        return {"commits": len(commits(self.path))}

    def partitions(self, start: dict, end: dict):
        return [RunFile(f["file"], f["run"]) for c in commits(self.path)[start["commits"] : end["commits"]] for f in c]

    def read(self, partition: RunFile):
        yield from _batches(self.path, partition, self.schema_)


class RunWriter(DataSourceArrowWriter):
    """Rows (run_id, line): a task has a file for each of its runs; the commit comes when all are stored."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, at = _store(self.path)
        task, opened = uuid.uuid4().hex, {}
        for batch in iterator:
            lines: dict[str, list[str]] = {}
            for run, line in zip(batch.column(RUN).to_pylist(), batch.column("line").to_pylist()):
                lines.setdefault(run or "", []).append(line)
            for run, own in lines.items():
                if run not in opened:
                    folder = quote(run, safe="") or "%"
                    fs.create_dir(f"{at}/{folder}")
                    file = f"{folder}/{task}.jsonl"
                    opened[run] = {"file": file, "run": folder, "rows": 0, "length": 0, "to": fs.open_output_stream(f"{at}/{file}"), "hash": hashlib.sha256()}
                raw, f = ("\n".join(own) + "\n").encode(), opened[run]
                f["to"].write(raw)
                f["hash"].update(raw)
                f["rows"], f["length"] = f["rows"] + len(own), f["length"] + len(raw)
        for f in opened.values():
            f.pop("to").close()
            f["sha256"] = f.pop("hash").hexdigest()
        return Stored(list(opened.values()))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, at = _store(self.path)
        fs.create_dir(f"{at}/{COMMITS}")
        name = f"{at}/{COMMITS}/{len(commits(self.path)):010d}"
        with fs.open_output_stream(f"{name}.tmp") as f:
            f.write(json.dumps([f for m in messages if m for f in m.files]).encode())
        fs.move(f"{name}.tmp", f"{name}.json")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, at = _store(self.path)
        for f in (f for m in messages if m for f in m.files):
            fs.delete_file(f"{at}/{f['file']}")


class RunTables(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        raise ValueError("give the table's schema; run_id may be one of its columns")

    def reader(self, schema: T.StructType) -> RunReader:
        return RunReader(self.options["path"], schema)

    def streamReader(self, schema: T.StructType) -> RunStream:
        return RunStream(self.options["path"], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> RunWriter:
        if overwrite:
            raise ValueError("runs are only ever added: write in append mode")
        return RunWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RunTables)


def write_runs(rows: DataFrame, path: str) -> None:
    """Add rows (run_id and any others) as JSON lines with sorted keys, nulls kept, NaN and infinities null. A null run_id is the run "%"."""
    register(rows.sparkSession)
    body = json_ready(rows.drop(RUN))
    line = F.to_json(F.struct(*[F.col(f"`{c}`") for c in body.columns]), {"ignoreNullFields": "false"})
    ready = json_ready(rows).select(F.col(RUN).cast("string").alias(RUN), line.alias("line"))
    ready.write.format(NAME).mode("append").save(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, run_id, rows, length, sha256) of all committed files."""
    found = [(f["file"], unquote(f["run"]), f["rows"], f["length"], f["sha256"]) for c in commits(path) for f in c]
    return spark.createDataFrame(found, "file string, run_id string, rows long, length long, sha256 string")
