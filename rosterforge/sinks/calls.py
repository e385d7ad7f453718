"""Rows that are acted on in a service, by a Spark data source writer: each action of Spark on the outcome reads a table, none calls the service again.

Tasks write what came of their rows in small files as they go on. An attempt that follows a failed one of the same task, and a later run
into the same folder, takes known outcomes from there and calls only for the other rows. What a task did after its last file is not
known when its worker is lost; those rows are called once more, so calls are to be harmless when repeated.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of which the outcome is written at a time.
FLUSH = 500


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: in spark.checkpoint.dir; on one machine a temporary one where that is not set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is to name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="rosterforge-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written to a new shared folder and read from there: what reads them several times works them out once."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _at(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pyarrow.fs.LocalFileSystem(), folder)


def _write(files: pyarrow.fs.FileSystem, path: str, write: Callable) -> None:
    """Writes a file beside its place and then moves it there, so that a file that is there is whole."""
    folder, _, name = path.rpartition("/")
    beside = f"{folder}/_{uuid.uuid4().hex}.{name}"
    files.create_dir(folder, recursive=True)
    with files.open_output_stream(beside) as stream:
        write(stream)
    files.move(beside, path)


@dataclass
class Done(WriterCommitMessage):
    """What a task tells the driver: numbers only."""

    partition: int
    called: int
    known: int


class CallWriter(DataSourceWriter):
    """make: gives, for the known outcomes of a task, the function that acts on one row and gives its outcome."""

    def __init__(self, make: Callable[[list[dict]], Callable[[dict], dict]], outcome: T.StructType, key: str, folder: str, run: str, flush: int):
        self.make, self.outcome, self.key, self.folder, self.run, self.flush = make, outcome, key, folder, run, flush

    def write(self, rows: Iterator) -> Done:
        context = TaskContext.get()
        files, root = _at(self.folder)
        own = f"{root}/{self.run}/task-{context.partitionId():06d}"
        schema = to_arrow_schema(self.outcome)
        known = self._known(files, own, schema)
        handle, there = self.make(known), {x[self.key] for x in known}
        held, n, called = [], 0, 0

        def flush() -> None:
            nonlocal held, n
            if held:
                table = pa.Table.from_pylist(held, schema=schema)
                _write(files, f"{own}/{context.taskAttemptId():012d}-{n:06d}.parquet", lambda stream: pyarrow.parquet.write_table(table, stream))
                held, n = [], n + 1

        try:
            for row in rows:
                row = row.asDict()
                if row[self.key] not in there:
                    held.append({self.key: row[self.key], **handle(row)})
                    called += 1
                    if len(held) >= self.flush:
                        flush()
        finally:
            flush()
        return Done(context.partitionId(), called, len(known))

    @staticmethod
    def _known(files: pyarrow.fs.FileSystem, own: str, schema: pa.Schema) -> list[dict]:
        """What earlier attempts of this task have written."""
        found = files.get_file_info(pyarrow.fs.FileSelector(own, allow_not_found=True))
        paths = sorted(f.path for f in found if f.path.endswith(".parquet") and not f.path.rpartition("/")[2].startswith("_"))
        return [row for p in paths for row in pyarrow.parquet.read_table(p, schema=schema, filesystem=files).to_pylist()]

    def _say(self, state: str, messages: list) -> None:
        files, root = _at(self.folder)
        done = [m for m in messages if m is not None]
        said = json.dumps({"state": state, "tasks": len(done), "unfinished": len(messages) - len(done), "called": sum(m.called for m in done), "known": sum(m.known for m in done)})
        _write(files, f"{root}/{self.run}/_{state}.json", lambda stream: stream.write(said.encode()))

    def commit(self, messages: list) -> None:
        self._say("committed", messages)

    def abort(self, messages: list) -> None:
        self._say("aborted", messages)


def _source(writer: CallWriter) -> type[DataSource]:
    class Calls(DataSource):
        @classmethod
        def name(cls) -> str:
            return "service_calls"

        def schema(self) -> str:
            return "dummy int"

        def writer(self, schema, overwrite: bool) -> CallWriter:
            return writer

    return Calls


def runs(folder: str) -> dict[str, dict]:
    """What is known of each run into a folder: its state (committed, aborted, or open: neither was said) and counts."""
    files, root = _at(folder)
    out = {}
    for f in files.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True)):
        if f.type == pyarrow.fs.FileType.Directory:
            said = [x for x in files.get_file_info(pyarrow.fs.FileSelector(f.path)) if x.path.endswith(("/_committed.json", "/_aborted.json"))]
            out[f.path.rpartition("/")[2]] = json.loads(files.open_input_stream(said[-1].path).read()) if said else {"state": "open"}
    return out


def outcomes(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The outcomes in a folder, with run and state: of rows of a run that was broken off too, whose other rows have no outcome."""
    known = runs(folder)
    if not known:
        return spark.createDataFrame([], f"{schema}, run string, state string")
    read = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(*[f"{folder.rstrip('/')}/{r}" for r in sorted(known)])
    run = F.regexp_extract(F.col("_metadata.file_path"), r"/(run-[0-9a-f]+)/task-", 1)
    states = F.create_map(*[F.lit(x) for r, of in known.items() for x in (r, of["state"])])  # one entry a run
    return read.withColumn("run", run).withColumn("state", F.element_at(states, F.col("run")))


def act(
    rows: DataFrame, deal: Callable[[DataFrame], DataFrame], make: Callable[[list[dict]], Callable[[dict], dict]], outcome: str, key: str, folder: str | None = None, flush: int = FLUSH
) -> DataFrame:
    """Acts on each row once and gives outcomes() of the folder, without run and state.

    deal: deals the rows that are to be worked on out to tasks; key: a column that tells rows apart. outcome: the schema of the key and of what the function that make gives returns. Rows of which the folder knows
    the outcome are left out. If a task fails for good, the error is raised, and acting again goes on from there. Keep speculation off.
    """
    spark = rows.sparkSession
    folder = folder or shared_folder(spark, "calls")
    todo = deal(rows)
    if runs(folder):
        known = outcomes(spark, folder, outcome).select(F.col(key).alias("known"))
        todo = deal(rows.join(known, rows[key] == known["known"], "left_anti"))
    writer = CallWriter(make, T.StructType.fromDDL(outcome), key, folder, f"run-{uuid.uuid4().hex}", flush)
    spark.dataSource.register(_source(writer))
    todo.write.format("service_calls").mode("append").save()
    return outcomes(spark, folder, outcome).drop("run", "state")
