"""Lookups: organisations, roles, passwords, permissions, TOTP secrets. Build sides have one row per key, so a join never multiplies rows; Spark broadcasts them when they are small enough by its own measure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..schema import ORG_NOT_FOUND, RECORD, require_columns
from .ordering import keep_first, keep_last, ordered_distinct

ORG_COLUMNS = ("org_id", "org_external_id", "org_name")


def org_mapping(df: DataFrame, key: str) -> DataFrame:
    """(key, org_id, org_external_id, org_name) of a mapping table; the last row of a key wins; rows without a key go."""
    require_columns(df, [key], [ORG_COLUMNS])
    clean = [(text.filled(F.col(c)) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in ORG_COLUMNS]
    return keep_last(df.select(RECORD, text.filled(F.col(key)).alias(key), *clean).where(F.col(key).isNotNull()), key).drop(RECORD)


def apply_org_mapping(rows: DataFrame, mapping: DataFrame, on: str, key: str) -> DataFrame:
    """Rows with the mapped organisation: an org_id stands alone; without one, external id and name."""
    named = mapping.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in ORG_COLUMNS])
    joined = rows.drop(*ORG_COLUMNS).join(named, rows[on] == named["__key"], "left")
    alone = F.col("__org_id").isNotNull()
    return joined.withColumns({"org_id": F.col("__org_id"), **{c: F.when(~alone, F.col(f"__{c}")) for c in ORG_COLUMNS[1:]}}).drop("__key", *[f"__{c}" for c in ORG_COLUMNS])


def role_mapping(df: DataFrame, key: str, slug: str = "role_slug") -> DataFrame:
    """(key, roles): each user's distinct roles in the order of their first rows."""
    require_columns(df, [key, slug])
    clean = df.select(RECORD, text.filled(F.col(key)).alias(key), text.filled(F.col(slug)).alias(slug)).where(F.col(key).isNotNull() & F.col(slug).isNotNull())
    return ordered_distinct(clean, key, slug, name="roles")


def role_mapping_summary(df: DataFrame, key: str = "external_id", slug: str = "role_slug") -> DataFrame:
    """One row: valid rows, distinct users, distinct roles."""
    user, role = text.filled(F.col(key)), text.filled(F.col(slug))
    both = user.isNotNull() & role.isNotNull()
    return df.agg(
        F.count("*").alias("total_rows"), F.count_if(both).alias("valid_rows"), F.countDistinct(F.when(both, user)).alias("users"), F.countDistinct(F.when(both, role)).alias("roles")
    )


def with_user_roles(rows: DataFrame, roles: DataFrame, own: Column) -> DataFrame:
    """rows with all_roles: own roles, then the mapped ones (external_id, roles), each once."""
    named = roles.select(F.col("external_id").alias("__id"), F.col("roles").alias("__roles"))
    none = F.array().cast("array<string>")
    joined = rows.withColumn("__own", F.coalesce(own, none)).join(named, rows["external_id"] == named["__id"], "left")
    return joined.withColumn("all_roles", F.array_union("__own", F.coalesce("__roles", none))).drop("__id", "__roles", "__own")


def password_lookup(df: DataFrame) -> DataFrame:
    """(email_key, hash, algorithm, set_date) of a password export; rows without email or hash go; the last row of an email wins."""
    rows = df.select(RECORD, text.email_key(F.col("email")).alias("email_key"), text.filled(F.col("passwordHash")).alias("hash"), F.col("password_set_date.$date").alias("set_date"))
    rows = rows.where((F.col("email_key") != "") & F.col("hash").isNotNull())
    return keep_last(rows, "email_key").withColumn("algorithm", text.hash_algorithm(F.col("hash"))).drop(RECORD)


def merge_passwords(rows: DataFrame, lookup: DataFrame) -> DataFrame:
    """rows with password_hash, password_hash_type and password_set_date of their email; '' where there is none."""
    named = lookup.select(F.col("email_key").alias("__key"), F.col("hash").alias("__hash"), F.col("algorithm").alias("__type"), F.col("set_date").alias("__date"))
    joined = rows.join(named, text.email_key(rows["email"]) == named["__key"], "left")
    filled = {"password_hash": "__hash", "password_hash_type": "__type", "password_set_date": "__date"}
    return joined.withColumns({k: F.coalesce(v, F.lit("")) for k, v in filled.items()}).drop("__key", *filled.values())


def parse_role_definitions(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(definitions, problems) of role_slug, role_name, role_type, permissions and an organisation.

    A definition is checked by the first of: slug, name, type (environment or organization), and for the latter an organisation. The first of a scope (slug, or slug and
    organisation) stays. problems: record_number, level (error or warning), message.
    """
    require_columns(df, ["role_slug", "role_name", "role_type", "permissions"])
    c = lambda name: text.filled(F.col(name)) if name in df.columns else F.lit(None).cast("string")
    kind = c("role_type")
    org = F.coalesce(c("org_id"), c("org_external_id"))
    rows = df.select(
        RECORD, c("role_slug").alias("slug"), c("role_name").alias("name"), kind.alias("type"), F.coalesce(text.split_list(F.col("permissions")), F.array().cast("array<string>")).alias("permissions"),
        c("org_id").alias("org_id"), c("org_external_id").alias("org_external_id"),
        F.when(c("role_slug").isNull(), "missing role_slug").when(c("role_name").isNull(), "missing role_name").alias("error"),
        F.when(kind.isNull() | ~kind.isin("environment", "organization"), "unknown role_type").when((kind == "organization") & org.isNull(), "organization role without an organization").alias("warning"),
    )
    good = rows.where(F.col("error").isNull() & F.col("warning").isNull()).drop("error", "warning")
    scoped = good.withColumn("scope", F.when(F.col("type") == "environment", F.col("slug")).otherwise(F.concat_ws(":", "slug", F.coalesce("org_id", "org_external_id"))))
    kept = keep_first(scoped, "scope")
    firsts = kept.select(F.col("scope").alias("__scope"), F.col(RECORD).alias("__first"))
    again = scoped.join(firsts, scoped["scope"] == firsts["__scope"]).where(F.col(RECORD) != F.col("__first"))
    problems = (
        rows.where(F.col("error").isNotNull()).select(RECORD, F.lit("error").alias("level"), F.col("error").alias("message"))
        .unionByName(rows.where(F.col("error").isNull() & F.col("warning").isNotNull()).select(RECORD, F.lit("warning").alias("level"), F.col("warning").alias("message")))
        .unionByName(again.select(RECORD, F.lit("warning").alias("level"), F.concat(F.lit("repeats the definition of row "), F.col("__first").cast("string")).alias("message")))
    )
    return kept.drop("scope"), problems


def permission_diff(wanted: Column, there: Column) -> tuple[Column, Column]:
    """(missing, extra) of two lists, order and repeats as they are."""
    return F.filter(wanted, lambda p: ~F.array_contains(there, p)), F.filter(there, lambda p: ~F.array_contains(wanted, p))


def process_roles(definitions: DataFrame, existing: DataFrame) -> DataFrame:
    """What a run would do for each definition: slug, org_id, action (exists or created), missing, extra, match. existing: slug, org_id (null: environment), permissions."""
    there = existing.select(F.col("slug").alias("__slug"), F.col("org_id").alias("__org"), F.col("permissions").alias("__there"))
    joined = definitions.join(there, (definitions["slug"] == there["__slug"]) & definitions["org_id"].eqNullSafe(there["__org"]), "left")
    missing, extra = permission_diff(F.col("permissions"), F.col("__there"))
    found = F.col("__slug").isNotNull()
    return joined.select(
        RECORD, "slug", "org_id", F.when(found, "exists").otherwise("created").alias("action"), F.when(found, missing).alias("missing"), F.when(found, extra).alias("extra"),
        F.when(found, (F.size(missing) == 0) & (F.size(extra) == 0)).alias("match"),
    )


def role_summary(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("total"), *[F.count_if(F.col("action") == a).alias(a) for a in ("created", "exists", "skipped", "error")], F.count_if(~F.coalesce("match", F.lit(True))).alias("mismatched"))


def distinct_permissions(definitions: DataFrame) -> DataFrame:
    """(slug, name) of each permission that a definition names."""
    return definitions.select(F.explode("permissions").alias("slug")).distinct().withColumn("name", text.display_name(F.col("slug")))


def unique_orgs(df: DataFrame) -> DataFrame:
    """(org_external_id, org_name): the first name of each external id, in the order of a locale. Sorting is for reports; leave it to the reader of a large result."""
    rows = df.select(RECORD, text.filled(F.col("org_external_id")).alias("org_external_id"), text.filled(F.col("org_name")).alias("org_name")).where(F.col("org_external_id").isNotNull())
    return keep_first(rows, "org_external_id").drop(RECORD).orderBy(F.collate("org_external_id", "UNICODE"))


def resolve_orgs(rows: DataFrame, orgs: DataFrame, create_missing: bool = False) -> DataFrame:
    """rows with resolved_org_id and org_error.

    orgs: id, external_id. Each distinct organisation is looked up once: by org_id, else by external id, else, if asked for, an id for a new one is made. A row without
    either has no organisation and no error.
    """
    key = text.scope_key(text.filled(F.col("org_id")), text.filled(F.col("org_external_id")))
    keyed = rows.withColumn("__key", key)
    keys = F.array(F.concat(F.lit("id:"), "id"), F.concat(F.lit("ext:"), "external_id"))
    known = orgs.select(F.explode(F.array_compact(keys)).alias("__known"), F.col("id").alias("__id")).groupBy("__known").agg(F.min("__id").alias("__id"))
    joined = keyed.join(known, keyed["__key"] == known["__known"], "left")
    made = F.when(F.lit(create_missing) & F.col("__key").startswith("ext:"), text.dry_run_org(text.filled(F.col("org_external_id"))))
    resolved = F.coalesce("__id", made)
    lost = F.col("__key").isNotNull() & resolved.isNull()
    return joined.withColumns({"resolved_org_id": resolved, "org_error": F.when(lost, F.concat(F.lit(ORG_NOT_FOUND), F.coalesce(text.filled(F.col("org_id")), text.filled(F.col("org_external_id")))))}).drop("__key", "__known", "__id")


def resolve_one(orgs: DataFrame, org_id: str | None = None, external_id: str | None = None, create_missing: bool = False) -> str | None:
    """The id of the one organisation that a whole load is for; None if none is named, an error if it is not there."""
    if not org_id and not external_id:
        return None
    found = orgs.where(F.col("id") == org_id if org_id else F.col("external_id") == external_id).select("id").first()
    if found:
        return found.id
    if create_missing and external_id:
        return f"org_dryrun_{external_id}"
    raise LookupError(f"{ORG_NOT_FOUND}{org_id or external_id}")


def lookup_statistics(rows: DataFrame, key: Column) -> DataFrame:
    """Hits and misses of a lookup that keeps every key: the first row of a key misses."""
    counts = rows.agg(F.count(key).alias("lookups"), F.countDistinct(key).alias("misses"))
    hits = F.col("lookups") - F.col("misses")
    return counts.select("lookups", hits.alias("hits"), "misses", F.when(F.col("lookups") > 0, F.round(100.0 * hits / F.col("lookups"), 2)).otherwise(0.0).alias("hit_rate"))


def export_members(orgs: DataFrame, members: DataFrame, users: DataFrame, allowed: list[str] | None = None, done: DataFrame | None = None) -> DataFrame:
    """Organisations, their members and the members' records. allowed: ids of organisations to take; done: (org_id) of those that an earlier run has finished."""
    chosen = orgs.where(F.col("org_id").isin(allowed)) if allowed else orgs
    if done is not None:
        chosen = chosen.join(done.select("org_id").distinct(), "org_id", "left_anti")
    return chosen.join(members, "org_id").join(users, "user_id", "left")


def export_summary(exported: DataFrame) -> DataFrame:
    """One row: rows exported and skipped (by skip_reason), distinct organisations."""
    return exported.agg(F.count_if(F.col("skip_reason").isNull()).alias("users_exported"), F.count_if(F.col("skip_reason").isNotNull()).alias("users_skipped"), F.countDistinct("org_external_id").alias("organizations"))


def totp_from_csv(df: DataFrame) -> DataFrame:
    """(email_key, secret) of rows that have both."""
    return df.select(RECORD, text.email_key(F.col("email")).alias("email_key"), text.filled(F.col("totp_secret")).alias("secret")).where((F.col("email_key") != "") & F.col("secret").isNotNull())


def totp_from_json(df: DataFrame) -> DataFrame:
    """As totp_from_csv, of records whose secret is in totp_secret, in secret, or in the first TOTP factor of mfa_factors."""
    factor = F.get(F.filter("mfa_factors", lambda f: f["type"] == "totp"), F.lit(0))
    secret = F.coalesce(*[F.nullif(c, F.lit("")) for c in (F.col("totp_secret"), F.col("secret"), factor["secret"], factor["totp_secret"])])
    return df.select(RECORD, text.email_key(F.col("email")).alias("email_key"), secret.alias("secret")).where((F.col("email_key") != "") & F.col("secret").isNotNull())


def plan_totp(records: DataFrame, users: DataFrame) -> DataFrame:
    """Each record with its user's id and outcome: enroll or user_not_found. users: id, email."""
    known = keep_first(users.select("id", text.email_key(F.col("email")).alias("__key")), "__key", "id")
    joined = records.join(known, records["email_key"] == known["__key"], "left")
    return joined.select(RECORD, "email_key", "secret", F.col("id").alias("user_id"), F.when(F.col("id").isNull(), "user_not_found").otherwise("enroll").alias("outcome"))


def totp_summary(found: DataFrame) -> DataFrame:
    """One row: total, enrolled, skipped, failures (those without a user among them) and user_not_found, of plan_totp() or of what came of it (sinks.rest.enroll)."""
    o = F.col("outcome")
    return found.agg(
        F.count("*").alias("total"), F.count_if(o.isin("enroll", "enrolled")).alias("enrolled"), F.count_if(o == "skipped").alias("skipped"), F.count_if(o.isin("failed", "user_not_found")).alias("failures"),
        F.count_if(o == "user_not_found").alias("user_not_found"),
    )
