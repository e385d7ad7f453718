"""Helpers that the training-text operators share: word pattern, shared tables, array packing."""

from __future__ import annotations

import functools
import itertools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Spark's setting by which a query removes its shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole(c: str | Column) -> Column:
    """The text, a null as the empty text."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, UPPER, LOWER)


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="shared-")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is to name a folder that the driver and all executors share")
        folder = _own_folder()
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """The rows of df, written to the shared folder and read from there: lineage ends here, and a lost executor costs no recomputation. tidy: the shuffles of df go as soon as it is written."""
    path, conf = shared_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    if tidy:
        conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if tidy:
            conf.set(CLEANUP, before) if before is not None else conf.unset(CLEANUP)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_keys(key: Column, text: Column) -> dict[str, Column]:
    """Columns that tell rows apart by doc_id and text, in joins that hold null ids for equal: __id, __none (whether it is null) and __hash. Rows that have all three in common repeat each other."""
    return {"__id": F.coalesce(key.cast("long"), F.lit(0).cast("long")), "__none": key.isNull(), "__hash": F.xxhash64(text)}


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """The rows of docs, written with a number of their own in a column __row: decisions carried on it meet one row each, whatever ids and texts repeat."""
    return written(docs.withColumn("__row", F.monotonically_increasing_id()), name)


def aside(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage that gives rows of docs with their columns. Columns of docs whose names begin with two underscores, as those do that a stage adds, have other names in the stage."""

    @functools.wraps(stage)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        clashing = {c for c in docs.columns if c.startswith("__")}
        if not clashing:
            return stage(docs, *args, **options)
        taken = {c.lower() for c in docs.columns}
        free = (n for k in itertools.count() if (n := f"aside_{k}") not in taken)
        inside = [next(free) if c in clashing else c for c in docs.columns]
        return stage(docs.toDF(*inside), *args, **options).toDF(*docs.columns)

    return run


def one_of_repeats(rows: DataFrame, names: list[str], again: DataFrame | None = None) -> DataFrame:
    """One row of those that have the columns `names` (never null) in common. again: the values that several rows have, if known. Of these, the first of each salt and then the first of those, so that no task has all rows that repeat."""
    if again is None:
        again = written(rows.groupBy(*names).count().where("count > 1").select(*names), "repeated")
    if again.isEmpty():
        return rows
    first = lambda *by: F.row_number().over(Window.partitionBy(*names, *by).orderBy("__salt")) == 1
    salted = rows.join(again, names, "left_semi").withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(1021)))
    once = salted.withColumn("__first", first("__salt")).where("__first").withColumn("__first", first()).where("__first").drop("__salt", "__first")
    return rows.join(again, names, "left_anti").unionByName(once)


def drop_written(df: DataFrame) -> None:
    """Removes the files of a table from written() that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_working: list = [None, None]


def works(operator: str, forget: Callable[[], object] = lambda: None) -> None:
    """Says, where a task begins, for which operator a worker works. What it remembers for another one is forgotten then, so that a worker that serves several in turn holds no more than one's memory."""
    if _working[0] != operator:
        if _working[1]:
            _working[1]()
        _working[:] = operator, forget
    pa.default_memory_pool().release_unused()


def blocks(batches: Iterable[pa.RecordBatch], text: int, size: int) -> Iterator[tuple[int, pa.Table]]:
    """The rows of a task in blocks of about `size` bytes of text (column number `text`) or one longer text, each with a number that no other block of the query has while its table is written once."""
    task, n, held, parts = TaskContext.get().partitionId() << 32, 0, 0, []
    for batch in batches:
        lengths = np.cumsum(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False))
        at, gone = 0, 0
        while at < batch.num_rows:
            end = max(int(np.searchsorted(lengths, gone + size - held, "right")), at + (not held))
            if end > at:
                parts.append(batch.slice(at, end - at))
                held, gone, at = held + int(lengths[end - 1]) - gone, int(lengths[end - 1]), end
            if at < batch.num_rows or held >= size:
                yield task | n, pa.Table.from_batches(parts)
                n, held, parts = n + 1, 0, []
    if parts:
        yield task | n, pa.Table.from_batches(parts)


def map_texts(docs: DataFrame, make: Callable[[list[str]], dict[str, list]], schema: str, key: str = "doc_id", text: str = "text", part_bytes: int = 4 << 20) -> DataFrame:
    """doc_id and what `make` gives for the texts, a null text as the empty text.

    make: gets texts of about part_bytes together (or one longer text), and gives columns of the schema. Batches of Spark are cut into such
    parts, so that a task holds a few MB of what is made at a time, however long the texts are.
    """
    fields = T.StructType.fromDDL(f"doc_id long, {schema}")
    arrow = to_arrow_schema(fields)

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False)
            part = np.cumsum(lengths) // part_bytes
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    made = make(texts[a:b].to_pylist())
                    yield pa.RecordBatch.from_arrays([ids[a:b], *(pa.array(made[f.name], f.type) for f in list(arrow)[1:])], schema=arrow)

    return docs.select(docs[key].cast("long").alias("doc_id"), whole(docs[text]).alias("text")).mapInArrow(run, fields)
