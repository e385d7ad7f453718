"""Loads: payloads, the outcome of each row in a dry run, chunks that can be resumed, and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsons, text
from ..schema import BOTH_ORGS, INVALID_METADATA, MISSING_EMAIL, RECORD, with_known_columns
from .joins import resolve_orgs, with_user_roles
from .ordering import chunk_id


def build(df: DataFrame) -> DataFrame:
    """Rows with what is to be created and build_error, which is null for a row that can be loaded: email, JSON metadata and at most one organisation reference are asked for."""
    df = with_known_columns(df)
    f = lambda c: text.filled(F.col(c))
    metadata = f("metadata")
    hashed = f("password_hash").isNotNull() & f("password_hash_type").isNotNull()
    error = (
        F.when(f("email").isNull(), MISSING_EMAIL)
        .when(metadata.isNotNull() & (~jsons.is_json(metadata) | (metadata == "null")), INVALID_METADATA)
        .when(f("org_id").isNotNull() & f("org_external_id").isNotNull(), BOTH_ORGS)
    )
    return df.withColumns(
        {
            "email_key": F.nullif(text.email_key(F.col("email")), F.lit("")), "build_error": error, "payload_metadata": jsons.flattened(F.col("metadata")),
            "payload_hash": F.when(hashed, f("password_hash")), "payload_hash_type": F.when(hashed, f("password_hash_type")), "payload_password": F.when(~hashed, f("password")),
            "verified": text.parse_bool(F.col("email_verified")), "own_roles": text.split_list(F.col("role_slugs")),
        }
    )


def payloads(built: DataFrame) -> DataFrame:
    """The payload of each row that can be loaded."""
    return built.where(F.col("build_error").isNull()).select(
        RECORD, text.filled(F.col("email")).alias("email"), text.filled(F.col("first_name")).alias("first_name"), text.filled(F.col("last_name")).alias("last_name"), F.col("payload_password").alias("password"),
        F.col("payload_hash").alias("password_hash"), F.col("payload_hash_type").alias("password_hash_type"), F.col("verified").alias("email_verified"), text.filled(F.col("external_id")).alias("external_id"), F.col("payload_metadata").alias("metadata"),
    )


def prepared(df: DataFrame, orgs: DataFrame | None = None, roles: DataFrame | None = None, create_missing: bool = False) -> DataFrame:
    """(record_number, email_key, org, n_roles, error_type, error): what each row is to create, or why it cannot. Row by row, so rows may be a stream."""
    built = build(df)
    resolved = resolve_orgs(built, orgs, create_missing) if orgs is not None else built.withColumns({"resolved_org_id": text.filled(F.col("org_id")), "org_error": F.lit(None).cast("string")})
    resolved = with_user_roles(resolved, roles, F.col("own_roles")) if roles is not None else resolved.withColumn("all_roles", F.coalesce("own_roles", F.array().cast("array<string>")))
    return resolved.select(
        RECORD, "email_key", F.col("resolved_org_id").alias("org"), F.size(F.array_distinct("all_roles")).alias("n_roles"),
        F.when(F.col("build_error").isNotNull(), "user_create").when(F.col("org_error").isNotNull(), "org_resolution").alias("error_type"), F.coalesce("build_error", "org_error").alias("error"),
    )


def outcomes(df: DataFrame, orgs: DataFrame | None = None, roles: DataFrame | None = None, create_missing: bool = False, chunk_size: int | None = None) -> DataFrame:
    """What a dry run does with each row.

    A row with an error in building or in its organisation is left out first. Of the others the first of an email creates the user, later ones are duplicates; the first of an email and
    organisation creates the membership and assigns its roles. Each key's first row is an aggregate that is joined to the rows: a user with very many rows costs no task more
    than others, nor do rows that are left out, which have keys of their own in the join. chunk_size: users and memberships are told apart within chunks of so many rows, as independent chunks do.
    """
    good = F.col("error_type").isNull()
    rows = prepared(df, orgs, roles, create_missing).withColumns({
        "chunk": chunk_id(chunk_size) if chunk_size else F.lit(0), "at_email": F.when(good, F.col("email_key")).otherwise(F.concat(F.lit("\0"), F.col(RECORD).cast("string"))), "at_org": F.coalesce("org", F.lit("\0"))
    })
    members = rows.where(good).groupBy("chunk", "at_email", "at_org").agg(F.min(RECORD).alias("first_member"))
    users = members.groupBy("chunk", "at_email").agg(F.min("first_member").alias("first_user"))
    joined = rows.join(members.join(users, ["chunk", "at_email"]), ["chunk", "at_email", "at_org"], "left")
    return decided(joined, F.col("first_user") == F.col(RECORD), F.col("first_member") == F.col(RECORD))


def decided(rows: DataFrame, first_of_user: Column, first_of_member: Column) -> DataFrame:
    """Outcomes of prepared() rows, of which it is known whether they are the first of their email, and of email and organisation, that can be loaded."""
    good = F.col("error_type").isNull()
    member = good & F.col("org").isNotNull()
    return rows.select(
        RECORD, "email_key", "org", "error_type", "error", F.when(good, text.dry_run_user(F.col("email_key"))).alias("user_id"),
        F.when(~good, None).when(first_of_user, "created").otherwise("duplicate").alias("user_outcome"), F.when(~member, None).when(first_of_member, "created").otherwise("duplicate").alias("membership_outcome"),
        F.when(member & first_of_member, F.col("n_roles")).otherwise(0).alias("roles_assigned"),
    )


def counters() -> dict[str, Column]:
    user, member = F.col("user_outcome"), F.col("membership_outcome")
    return {
        "total": F.count("*"), "successes": F.count_if(F.col("error_type").isNull()), "failures": F.count_if(F.col("error_type").isNotNull()), "users_created": F.count_if(user == "created"), "duplicate_users": F.count_if(user == "duplicate"),
        "memberships_created": F.count_if(member == "created"), "duplicate_memberships": F.count_if(member == "duplicate"), "roles_assigned": F.coalesce(F.sum("roles_assigned"), F.lit(0)).cast("long"),
    }


def status_label(successes: Column, failures: Column) -> Column:
    return F.when(failures == 0, "Success").when(successes > 0, "Completed with errors").otherwise("Failed")


def summary(found: DataFrame) -> DataFrame:
    one = found.agg(*[v.alias(k) for k, v in counters().items()])
    return one.withColumn("status", status_label(F.col("successes"), F.col("failures")))


def chunk_summaries(found: DataFrame, size: int) -> DataFrame:
    """The counters of each chunk: kept in a table, they add up to the summary."""
    return found.groupBy(chunk_id(size).alias("chunk_id")).agg(*[v.alias(k) for k, v in counters().items()])


def total_of_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.agg(*[F.coalesce(F.sum(k), F.lit(0)).cast("long").alias(k) for k in counters()]).withColumn("status", status_label(F.col("successes"), F.col("failures")))


def error_records(found: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """The failed rows as records for the error log; with `rows`, those as they were read go along as rawRow (see sinks.files.redacted)."""
    failed = found.where(F.col("error_type").isNotNull())
    records = failed.select(F.col(RECORD).alias("recordNumber"), F.col("email_key").alias("email"), F.col("error_type").alias("errorType"), F.col("error").alias("errorMessage"))
    if rows is None:
        return records
    raw = F.map_from_entries(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in rows.columns if c != RECORD]))
    return records.join(rows.select(F.col(RECORD).alias("recordNumber"), raw.alias("rawRow")), "recordNumber")
