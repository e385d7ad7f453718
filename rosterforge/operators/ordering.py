"""Operators whose result depends on row order. The order is a record number column, made once where rows are read; nothing sorts a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import RECORD


def with_record_number(df: DataFrame, first: int = 1, name: str = RECORD) -> DataFrame:
    """Rows numbered in the order in which they are read, without gaps: each partition's rows go on from those of the partitions before it, which are counted first.

    df must give the same partitions whenever it is read, as files do.
    """
    ided = df.withColumn("__id", F.monotonically_increasing_id()).withColumn("__p", F.expr("shiftright(__id, 33)"))
    counts = ided.groupBy("__p").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__begins"))  # a row per partition
    number = F.col("__begins") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + first
    return ided.join(F.broadcast(begins), "__p").withColumn(name, number).drop("__id", "__p", "__begins")


def number_by(df: DataFrame, *order: str, first: int = 1, name: str = RECORD, buckets: int = 64) -> DataFrame:
    """Rows numbered by columns that are unique together, without gaps and without one task for all rows.

    The order is cut into ranges at some rows of a sample (of about 20 rows a range); ranges are numbered apart, each from where the one before ends. The cuts are part of the plan, so
    every part of it sees the same ranges. Where the columns are not unique, equal rows are numbered in any order.
    """
    key = F.struct(*order)
    share = min(1.0, 20.0 * buckets / max(1, df.count()))
    seen = df.select(*order).sample(share, seed=5).orderBy(*order).collect()
    cuts = seen[len(seen) // buckets :: max(1, len(seen) // buckets)]
    kinds = dict(df.dtypes)
    at = F.size(F.filter(F.array(*[F.struct(*[F.lit(r[c]).cast(kinds[c]).alias(c) for c in order]) for r in cuts]), lambda b: b <= key)) if cuts else F.lit(0)
    ranged = df.withColumn("__range", at)
    within = Window.partitionBy("__range").orderBy(*order)
    counts = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__begins"))  # a row per range
    return ranged.withColumn("__at", F.row_number().over(within)).join(F.broadcast(begins), "__range").withColumn(name, F.col("__begins") + F.col("__at") + first - 1).drop("__range", "__begins", "__at")


def _by(keys: str | list[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def keep_first(df: DataFrame, keys: str | list[str], order: str = RECORD) -> DataFrame:
    """The first row of each key. Combined before the shuffle, so a frequent key costs one row per task."""
    rows = df.groupBy(*_by(keys)).agg(F.min_by(F.struct("*"), order).alias("row"))
    return rows.select("row.*")


def keep_last(df: DataFrame, keys: str | list[str], order: str = RECORD) -> DataFrame:
    return df.groupBy(*_by(keys)).agg(F.max_by(F.struct("*"), order).alias("row")).select("row.*")


def flag_later(df: DataFrame, key: str, order: str = RECORD, name: str = "is_duplicate") -> DataFrame:
    """Whether a row's key was seen in an earlier row; false for a null key. A key's first row comes from an aggregate and is joined, so that a frequent key needs no sort in one task."""
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("__first"))
    return df.join(first, key, "left").withColumn(name, F.coalesce(F.col(order) > F.col("__first"), F.lit(False))).drop("__first")


def first_non_blank(value: Column, blank: Column, order: str = RECORD) -> Column:
    """Aggregate: the value of the first row in which it is not blank."""
    return F.min_by(value, F.when(~blank, F.col(order)))


def distinct_values(df: DataFrame, key: str, value: str, order: str = RECORD) -> DataFrame:
    """(key, value, at): the distinct values of each key and the row where each is first. A row a value, however many a key has."""
    return df.where(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("value")).agg(F.min(order).alias("at"))


def ordered_distinct(df: DataFrame, key: str, value: str, order: str = RECORD, name: str = "values") -> DataFrame:
    """(key, array) of each key's distinct values in the order of their first rows. All distinct values of one key are one row, as those of a user's roles can be; where a key may have very many, take distinct_values()."""
    listed = distinct_values(df, key, value, order).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("found"))
    return listed.select(key, F.transform("found", lambda x: x["value"]).alias(name))


def chunk_id(size: int, order: str = RECORD) -> Column:
    """The chunk of a record: of `size` rows each, from 0."""
    return F.expr(f"cast(({order} - 1) div {size} as int)")


def chunks(total: DataFrame, size: int) -> DataFrame:
    """(chunk_id, start_row, end_row) for a one-row table with total_rows; the last chunk ends at the last row."""
    n = F.ceil(F.col("total_rows") / size).cast("int")
    each = total.select("total_rows", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))).alias("chunk_id"))
    return each.select("chunk_id", (F.col("chunk_id").cast("long") * size + 1).alias("start_row"), F.least((F.col("chunk_id").cast("long") + 1) * size, "total_rows").alias("end_row"))


def in_range(df: DataFrame, start_row: int, end_row: int, order: str = RECORD) -> DataFrame:
    return df.where(F.col(order).between(start_row, end_row))


def moving_average(df: DataFrame, value: str, order: str, name: str = "moving", rows: int = 5, size: int = 100_000) -> DataFrame:
    """df with the average of a column over each row and the `rows` - 1 before it in an order that no two rows share.

    Rows are numbered and cut into ranges of `size`; the last rows of a range go to the next one too, so that each range is worked on by itself and no task has all rows.
    """
    numbered = number_by(df, order, name="__n")
    place, part = F.col("__n") - 1, F.expr(f"(__n - 1) div {size}")
    parts = F.when(F.pmod(place, F.lit(size)) >= size - (rows - 1), F.array(part, part + 1)).otherwise(F.array(part))
    dealt = numbered.withColumn("__part", F.explode(parts))
    within = Window.partitionBy("__part").orderBy("__n").rowsBetween(1 - rows, 0)
    made = dealt.withColumn(name, F.avg(value).over(within))
    return made.where(F.col("__part") == part).drop("__part", "__n")
