"""Loads in chunks that can be resumed, and user rows as a stream (see loads for what is made of them)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import load
from ..schema import RECORD
from ..sources.files import input_digest


#: So many jobs at most work through a table, each of which reads it: a job takes several waves where there are more.
JOBS = 16
LEDGER = "chunk_id int, run string, digest string, written_at timestamp, total long, successes long, failures long, users_created long, duplicate_users long, memberships_created long, duplicate_memberships long, roles_assigned long"


def process_chunks(rows: DataFrame, size: int, table: str, make: Callable[[DataFrame], DataFrame] | None = None, wave: int = 1000, digest: str | None = None) -> DataFrame:
    """Works through numbered rows in chunks of `size` and gives the summary of each chunk (see chunk_ledger) from the ledger at path `table`.

    make: the outcomes of some rows, where chunks are independent; load.outcomes in chunks of that size if None. Chunks are worked on in waves of `wave`, one or (of a table of more than JOBS waves) several that follow each other at a time, which are added to the ledger when they are done, so a run that was
    broken off goes on with the first wave that the ledger lacks: rows of others are left out before anything is worked out. digest: of the input (by files.input_digest if None); a ledger of another input is
    refused. Runs only add to the ledger; where two at once did the same chunk, the one of the smaller name counts.
    """
    spark = rows.sparkSession
    make = make or (lambda part: load.outcomes(part, chunk_size=size))
    digest = digest or input_digest(rows)
    run, done = f"run-{uuid.uuid4().hex}", finished_waves(spark, table, size, wave, digest)
    last = rows.agg(F.max(RECORD)).first()[0]
    waves = 0 if last is None else (last - 1) // (size * wave) + 1
    for low, high in _runs([k for k in range(waves) if k not in done], -(-waves // JOBS)):
        part = rows.where(F.col(RECORD).between(low * size * wave + 1, (high + 1) * size * wave))
        found = load.chunk_summaries(make(part), size).select("chunk_id", F.lit(run).alias("run"), F.lit(digest).alias("digest"), F.current_timestamp().alias("written_at"), *load.counters())
        found.withColumn("wave", F.expr(f"chunk_id div {wave}").cast("int")).write.mode("append").parquet(table)
    return chunk_ledger(spark, table)


def _runs(numbers: list[int], most: int) -> list[tuple[int, int]]:
    """The first and last of each run of numbers that follow each other, of no more than `most`."""
    out: list[tuple[int, int]] = []
    for k in numbers:
        if out and k == out[-1][1] + 1 and k - out[-1][0] < most:
            out[-1] = out[-1][0], k
        else:
            out.append((k, k))
    return out


def _there(spark: SparkSession, table: str) -> bool:
    """Whether a table has data yet; a run that was broken off before its first commit leaves none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(path) and any(s.getPath().getName().endswith(".parquet") for s in files.listStatus(path))


def finished_waves(spark: SparkSession, table: str, size: int, wave: int, digest: str) -> set[int]:
    """The numbers of the waves that a ledger has. One of another input, or of chunks or waves of another size, is refused."""
    if not _there(spark, table):
        return set()
    ledger = spark.read.schema(f"{LEDGER}, wave int").parquet(table)
    if other := ledger.where(F.col("digest") != digest).select("digest").first():
        raise ValueError(f"the ledger is of another input: {other.digest}, not {digest}")
    waves = ledger.groupBy("wave").agg(F.min("chunk_id").alias("low"), F.max("chunk_id").alias("high"), F.max("total").alias("most")).collect()  # a row for each `wave` chunks
    if any(not w.wave * wave <= w.low <= w.high < (w.wave + 1) * wave or w.most > size for w in waves):
        raise ValueError("the ledger is of chunks or waves of another size")
    return {w.wave for w in waves}


def chunk_ledger(spark: SparkSession, table: str) -> DataFrame:
    """One row a chunk: chunk_id, run, digest, written_at, runs (how many did it), state (see load.status_label) and the counters. No rows without a ledger."""
    if not _there(spark, table):
        return spark.createDataFrame([], f"{LEDGER}, runs long, state string")
    names = [f.split(" ")[0] for f in LEDGER.split(", ")]
    one = spark.read.schema(LEDGER).parquet(table).groupBy("chunk_id").agg(F.min_by(F.struct(*names[1:]), "run").alias("row"), F.count("*").alias("runs"))
    return one.select("chunk_id", "row.*", "runs").withColumn("state", load.status_label(F.col("successes"), F.col("failures")))


def last_job(spark: SparkSession, folder: str) -> str | None:
    """The name of the folder inside `folder` that was changed last; None if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return None
    jobs = [(s.getModificationTime(), s.getPath().getName()) for s in files.listStatus(path) if s.isDirectory()]
    return max(jobs)[1] if jobs else None


def progress(chunks: DataFrame, total: int) -> DataFrame:
    """One row: chunks done, percent, and the time left by the mean of the last five durations. chunks: chunk_id, duration_ms."""
    last = chunks.where(F.col("duration_ms").isNotNull()).orderBy(F.desc("chunk_id")).limit(5)
    both = chunks.agg(F.count("*").alias("done")).crossJoin(last.agg(F.avg("duration_ms").alias("mean_ms")))  # one row each
    return both.select("done", F.round(F.col("done") * 100.0 / max(1, total)).cast("int").alias("percent"), (F.col("mean_ms") * (total - F.col("done"))).alias("left_ms"))


def stream_users(spark: SparkSession, path: str, schema: str, files_each: int = 8) -> DataFrame:
    """User rows as files arrive, some files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(path)


def first_per_email(users: DataFrame, event_time: str | None = None, late: str = "1 day") -> DataFrame:
    """The first row of each email in a stream. With an event time, state older than `late` goes."""
    keyed = users.withColumn("email_key", text.email_key(F.col("email")))
    return keyed.withWatermark(event_time, late).dropDuplicatesWithinWatermark(["email_key"]) if event_time else keyed.dropDuplicates(["email_key"])


def org_counts(users: DataFrame, event_time: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Rows by organisation and time window, of a stream."""
    return users.withWatermark(event_time, late).groupBy(F.window(event_time, window), "org_external_id").agg(F.count("*").alias("rows"))
