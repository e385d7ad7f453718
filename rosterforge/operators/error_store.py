"""Error analysis that grows with the log: each log file is summed up once, and the sums of all files merge to what one pass over all of them gives.

A store is a folder of Parquet tables with a part for each log: of each group its count, first error, first examples and first emails;
the counts of each type, status and reason; and the distinct emails. Logs are in the order in which they were added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sinks.calls import stored
from ..sources.files import input_digest
from . import analyze

#: The tables of a store and their schemas.
TABLES = {
    "logs": "log int, digest string, total long, retryable long, non_retryable long",
    "groups": "log int, group_id string, pattern string, errorType string, httpStatus int, count long, severity string, retryable boolean, retry_type string, first_record long",
    "examples": "log int, group_id string, at long", "emails": "log int, group_id string, at long, email string", "histogram": "log int, dimension string, value string, errors long", "addresses": "log int, email string",
}


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], TABLES[name])
    return spark.read.schema(TABLES[name]).option("recursiveFileLookup", "true").parquet(f"{folder}/{name}")


def add_log(errors: DataFrame, folder: str, order: str = "line", buckets: int = 16) -> bool:
    """Adds the errors of one log (see files.read_errors) to a store and says whether they were new: a log that the store has is left out, by its digest. Reads the log only, not what the store has of others.

    The row in `logs` is written last, and what a run left without it is written over by the next. One run adds at a time.
    """
    spark = errors.sparkSession
    digest = input_digest(errors.select(*[c for c in errors.columns if not dict(errors.dtypes)[c].startswith("map")], *[F.to_json(c).alias(c) for c, k in errors.dtypes if k.startswith("map")]))
    logs = _read(spark, folder, "logs")
    if not logs.where(F.col("digest") == digest).isEmpty():
        return False
    log = (logs.agg(F.max("log")).first()[0] or 0) + 1
    has_row = F.when(F.col("rawRow").isNotNull(), F.lit(True)).alias("rawRow")  # what rows hold is not kept
    errors = stored(analyze.with_groups(errors).select(order, "email", "userId", "errorType", "httpStatus", has_row, *analyze.CLASSES, *analyze.GROUPED), "classed-errors")  # classed once, for six tables
    one = analyze.retryability(errors).select(F.lit(digest).alias("digest"), F.col("total_errors").alias("total"), F.col("retryable_errors").alias("retryable"), F.col("non_retryable_errors").alias("non_retryable"))
    made = {
        "groups": analyze.groups(errors, order), "examples": analyze.examples(errors, order).select("group_id", F.explode("records").alias("at")), "emails": analyze.first_emails(errors, order),
        "histogram": analyze.histogram(errors).drop("percent"), "addresses": errors.select("email").where(F.coalesce("email", F.lit("")) != "").distinct().repartition(buckets, "email"), "logs": one,
    }
    for name, df in made.items():
        columns = [f.split(" ")[0] for f in TABLES[name].split(", ")]
        df.withColumn("log", F.lit(log)).select(*[F.col(c).cast(k) for c, k in (f.split(" ") for f in TABLES[name].split(", "))]).toDF(*columns).write.mode("overwrite").parquet(f"{folder}/{name}/log-{log:06d}")
    return True


def _known(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's rows of the logs that were added as a whole."""
    return _read(spark, folder, name).join(_read(spark, folder, "logs").select("log"), "log", "left_semi")


def groups(spark: SparkSession, folder: str) -> DataFrame:
    """analyze.groups() of all logs, with first_log: the log of the group's first error, of which first_record is the place."""
    first = F.min(F.struct("log", "first_record", "retryable", "retry_type")).alias("first")
    made = _known(spark, folder, "groups").groupBy("group_id").agg(F.first("pattern").alias("pattern"), F.first("errorType").alias("errorType"), F.first("httpStatus").alias("httpStatus"), F.sum("count").alias("count"), first)
    level = analyze.severity(F.col("errorType"), F.col("httpStatus"), F.col("first.retryable"))
    return made.select("group_id", "pattern", "errorType", "httpStatus", "count", level.alias("severity"), F.col("first.retryable").alias("retryable"), F.col("first.retry_type").alias("retry_type"), F.col("first.log").alias("first_log"), F.col("first.first_record").alias("first_record"))


def examples(spark: SparkSession, folder: str, most: int = analyze.EXAMPLES) -> DataFrame:
    """(group_id, records): log and place of the first errors of each group. A log has at most `most` of each."""
    place = F.row_number().over(Window.partitionBy("group_id").orderBy("log", "at"))
    first = _known(spark, folder, "examples").withColumn("n", place).where(F.col("n") <= most)
    return first.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("log", "at"))).alias("records"))


def affected_emails(spark: SparkSession, folder: str, most: int = analyze.EMAILS) -> DataFrame:
    """(group_id, emails): the first distinct emails of each group, which are among the first ones of its logs."""
    firsts = _known(spark, folder, "emails").groupBy("group_id", "email").agg(F.min(F.struct("log", "at")).alias("first"))
    place = F.row_number().over(Window.partitionBy("group_id").orderBy("first"))
    chosen = firsts.withColumn("n", place).where(F.col("n") <= most).groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("first", "email"))).alias("found"))
    return chosen.select("group_id", F.transform("found", lambda x: x["email"]).alias("emails"))


def histogram(spark: SparkSession, folder: str) -> DataFrame:
    """analyze.histogram() of all logs."""
    return analyze.with_percent(_known(spark, folder, "histogram").groupBy("dimension", "value").agg(F.sum("errors").alias("errors")))


def retryability(spark: SparkSession, folder: str) -> DataFrame:
    """analyze.retryability() of all logs; an email that several logs have counts once."""
    total = _read(spark, folder, "logs").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "retryable", "non_retryable")])
    emails = _known(spark, folder, "addresses").select("email").distinct().agg(F.count("*").alias("affected_emails"))
    share = lambda c: F.when(F.col("total") > 0, F.round(F.col(c) * 100.0 / F.col("total"), 6)).otherwise(0.0)
    return total.crossJoin(emails).select(  # one row each
        F.col("total").alias("total_errors"), F.col("retryable").alias("retryable_errors"), F.col("non_retryable").alias("non_retryable_errors"), share("retryable").alias("retryable_percent"), share("non_retryable").alias("non_retryable_percent"), "affected_emails",
    )
