"""Generated user rows for tests and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names in turn.
FIRST, LAST = ("Alice", "Bob", "Carol", "David", "Emma", "Frank", "Grace", "Henry"), ("Smith", "Jones", "Brown", "Taylor", "Wilson", "Davies", "Evans")


def org_number(i, orgs: int, skewed: bool = False):
    """The organisation of user i, counted from 0: in turn, or such that a fifth of the organisations have four fifths of the users."""
    if not skewed:
        return i % orgs
    top = max(1, orgs // 5)
    bottom = max(1, orgs - top)
    return F.when((i * 7919) % 1000 < 800, (i * 31) % top).otherwise(F.when(F.lit(orgs > top), F.lit(top) + (i * 13) % bottom).otherwise(0))


def users(spark: SparkSession, n: int, orgs: int = 10, skewed: bool = False, error_percent: int = 0) -> DataFrame:
    i = F.col("id")
    pick = lambda names: F.element_at(F.array(*[F.lit(x) for x in names]), (i % len(names) + 1).cast("int"))
    org = org_number(i, orgs, skewed)
    broken = (i * 37) % 100 < error_percent
    return spark.range(n).select(
        (i + 1).alias("record_number"), F.when(broken, F.concat(F.lit("user"), i)).otherwise(F.concat(F.lit("user"), i, F.lit("@example.com"))).alias("email"), pick(FIRST).alias("first_name"), pick(LAST).alias("last_name"),
        F.when(i % 2 == 0, "true").otherwise("false").alias("email_verified"), F.concat(F.lit("ext_"), i).alias("external_id"), F.concat(F.lit("org-"), F.lpad(org.cast("string"), 6, "0")).alias("org_external_id"), F.concat(F.lit("Organization "), org).alias("org_name"),
    )


def distribution(df: DataFrame) -> DataFrame:
    """One row: organisations used, and average, most and fewest users of one."""
    counts = df.groupBy("org_external_id").agg(F.count("*").alias("n"))
    return counts.agg(F.count("*").alias("orgs_used"), F.round(F.avg("n"), 6).alias("avg_users"), F.max("n").alias("max_users"), F.min("n").alias("min_users"))
