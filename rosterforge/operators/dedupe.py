"""Merging of user rows that share an email."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsons, text
from ..schema import RECORD, with_known_columns
from ..sinks.calls import stored
from .ordering import first_non_blank

# Fields that are filled from later rows.
FILLED = ("first_name", "last_name", "external_id", "password_hash", "password_hash_type", "org_id", "org_external_id", "org_name")


def grouped(df: DataFrame) -> DataFrame:
    """Rows with email_key; rows without an email go."""
    return with_known_columns(df).withColumn("email_key", F.nullif(text.email_key(F.col("email")), F.lit(""))).where(F.col("email_key").isNotNull())


def _merged(c: str) -> Column:
    """The first row's value if it is not empty, else the first filled one, trimmed."""
    base = F.min_by(F.coalesce(c, F.lit("")), RECORD)
    return F.coalesce(F.nullif(base, F.lit("")), first_non_blank(text.trimmed(F.col(c)), text.is_blank(F.col(c))), base)


def merge(df: DataFrame) -> DataFrame:
    """One row per email. Its first row is the base; FILLED come from the first row that has them; email_verified is true if it is in any row; metadata keys come from the first row that has a value for
    them, with its JSON type; an email of one row keeps its metadata as it is. All aggregates combine before the shuffle. rows: how many were merged."""
    rows = grouped(df)
    carried = [c for c in df.columns if c not in FILLED and c not in ("email_verified", "metadata", RECORD, "email_key")]
    verified = F.when(F.bool_or(text.parse_bool(F.col("email_verified"))), "true").otherwise(F.min_by("email_verified", RECORD))
    base = F.min_by(F.struct(*[F.col(c) for c in carried]), RECORD)
    one = rows.groupBy("email_key").agg(
        F.min(RECORD).alias(RECORD), F.count("*").alias("rows"), base.alias("base"), verified.alias("email_verified"), *[_merged(c).alias(c) for c in FILLED], F.min_by("metadata", RECORD).alias("base_metadata")
    )
    kept = merge_metadata(rows)
    named = kept.withColumnRenamed("email_key", "__key")
    joined = one.join(named, one["email_key"] == named["__key"], "left")
    return joined.select(RECORD, "email_key", "rows", *[F.col("base")[c].alias(c) for c in carried], "email_verified", *FILLED, F.when(F.col("rows") == 1, F.col("base_metadata")).otherwise(F.coalesce("metadata", "base_metadata")).alias("metadata"))


def metadata_entries(rows: DataFrame) -> DataFrame:
    """(email_key, record_number, at, key, value) of each row's metadata object; values as JSON texts."""
    each = rows.select("email_key", RECORD, F.posexplode(F.map_entries(jsons.token_map(F.col("metadata")))).alias("at", "entry"))
    return each.select("email_key", RECORD, "at", F.col("entry.key").alias("key"), F.col("entry.value").alias("value"))


def metadata_values(rows: DataFrame) -> DataFrame:
    """(email_key, key, value, first): of each key the JSON text of the first row in which it is not empty (see jsons.is_empty_token), else that of the last row; first: the row in which the key occurs first."""
    filled = F.when(~jsons.is_empty_token(F.col("value")), F.col(RECORD))
    return metadata_entries(rows).groupBy("email_key", "key").agg(F.coalesce(F.min_by("value", filled), F.max_by("value", RECORD)).alias("value"), F.min(F.struct(RECORD, "at")).alias("first"))


def merge_metadata(rows: DataFrame) -> DataFrame:
    """(email_key, metadata): a JSON object of metadata_values; whole numbers as keys come first in their order, as JSON objects of the sink's kind have them, then the others in that of their first occurrence."""
    whole = F.when(F.col("key").rlike("^(0|[1-9][0-9]{0,8})$"), F.col("key").cast("long"))
    place = F.struct(whole.isNull().alias("named"), whole.alias("number"), "first", "key", "value")
    listed = metadata_values(rows).groupBy("email_key").agg(F.array_sort(F.collect_list(place)).alias("found"))
    return listed.select("email_key", jsons.object_of_tokens(F.transform("found", lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value")))).alias("metadata"))


def conflict_values(df: DataFrame) -> DataFrame:
    """(email_key, field, value, at, strategy): the different filled values of each field in which rows of one email differ, and the row where each is first. One row a value, however many an email has.

    Metadata fields are metadata.<key>, their values JSON texts: the first that is not empty and whatever differs from it in later rows. Rows are parsed twice, here; the frame that is given reads tables of distinct values.
    """
    rows = grouped(df)
    fields = [F.struct(F.lit(c).alias("field"), text.filled(F.col(c)).alias("value"), F.lit("first-non-empty").alias("strategy")) for c in FILLED]
    verified = F.struct(F.lit("email_verified").alias("field"), text.bool_text(F.col("email_verified")).alias("value"), F.lit("true-if-any").alias("strategy"))
    long = rows.select("email_key", RECORD, F.explode(F.array(*fields, verified)).alias("x")).select("email_key", RECORD, "x.*").where(F.col("value").isNotNull())
    entries = metadata_entries(rows).select("email_key", RECORD, F.concat(F.lit("metadata."), "key").alias("field"), "value", F.lit("first-occurrence").alias("strategy"))
    every = long.unionByName(entries)
    key = ["email_key", "field", "strategy"]
    firsts = stored(every.groupBy(*key, "value").agg(F.min(RECORD).alias("first"), F.max(RECORD).alias("last")), "conflict-firsts")
    counted = F.when((F.col("strategy") != "first-occurrence") | ~jsons.is_empty_token(F.col("value")), F.col("first"))
    stats = firsts.groupBy(*key).agg(F.count("*").alias("n"), F.min(counted).alias("begin")).where("n > 1 AND begin IS NOT NULL")
    open_ = firsts.join(stats, key).where(F.col("last") >= F.col("begin"))
    # an empty metadata value may come before the first that counts, and again after it: then its place is the later one
    early = open_.where(F.col("first") < F.col("begin")).select(*key, "value", "begin")
    later = early.join(entries.where(jsons.is_empty_token(F.col("value"))), [*key, "value"]).where(F.col(RECORD) > F.col("begin")).groupBy(*key, "value").agg(F.min(RECORD).alias("at"))
    again = stored(later, "conflict-again")
    placed = open_.where(F.col("first") >= F.col("begin")).select(*key, "value", F.col("first").alias("at")).unionByName(again)
    several = placed.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return placed.join(several, key).select("email_key", "field", "value", "at", "strategy")


def conflicts(df: DataFrame) -> DataFrame:
    """(email_key, field, values, chosen, strategy): conflict_values() as a list for each email and field, in the order of their first rows. The values of one field of one email are one row; where an email may have very many, take conflict_values()."""
    listed = conflict_values(df).groupBy("email_key", "field", "strategy").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("found"))
    values = F.transform("found", lambda x: x["value"])
    chosen = F.when(F.col("strategy") == "true-if-any", "true").otherwise(values[0])
    return listed.select("email_key", "field", values.alias("values"), chosen.alias("chosen"), "strategy")


def merge_details(df: DataFrame) -> DataFrame:
    """(email_key, duplicate_count, first_row, last_row) of each email with more than one row."""
    counted = grouped(df).groupBy("email_key").agg(F.count("*").alias("duplicate_count"), F.min(RECORD).alias("first_row"), F.max(RECORD).alias("last_row"))
    return counted.where("duplicate_count > 1")


def summary(df: DataFrame) -> DataFrame:
    """One row: total rows with an email, unique emails, groups of more than one row, rows that merging removes."""
    per = grouped(df).groupBy("email_key").agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"), F.count("*").alias("unique_emails"), F.count_if(F.col("n") > 1).alias("duplicate_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("rows_removed"))
