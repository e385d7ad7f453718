"""Exports of identity providers to user rows. Each gives the rows and, for rows left out, a skip_reason; both come from one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsons, text
from ..schema import BAD_EMAIL, BAD_METADATA, KNOWN_COLUMNS, MISSING_ADDRESS, MISSING_FIELD, RECORD, USER_DISABLED, require_columns
from .joins import apply_org_mapping, org_mapping, role_mapping


def _clean(df: DataFrame, name: str) -> Column:
    return text.filled(F.col(name)) if name in df.columns else F.lit(None).cast("string")


# What goes into the metadata of a Clerk row, in order, and its source.
CLERK_METADATA = {
    "clerk_user_id": "id", "username": "username", "primary_phone_number": "primary_phone_number", "verified_phone_numbers": "verified_phone_numbers",
    "unverified_phone_numbers": "unverified_phone_numbers", "verified_email_addresses": "verified_email_addresses",
    "unverified_email_addresses": "unverified_email_addresses", "totp_secret": "totp_secret",
}


def clerk(df: DataFrame) -> DataFrame:
    """Clerk export rows: only bcrypt hashes are kept, emails count as verified, all else of use goes into metadata (to_json leaves nulls out)."""
    require_columns(df, ["primary_email_address", "id"])
    email, hasher, digest = _clean(df, "primary_email_address"), F.lower(_clean(df, "password_hasher")), _clean(df, "password_digest")
    bcrypt = digest.isNotNull() & (hasher == "bcrypt")
    metadata = F.to_json(F.struct(*[_clean(df, c).alias(k) for k, c in CLERK_METADATA.items()]))
    return df.select(
        RECORD, email.alias("email"), _clean(df, "first_name").alias("first_name"), _clean(df, "last_name").alias("last_name"), F.lit("true").alias("email_verified"), _clean(df, "id").alias("external_id"),
        F.when(bcrypt, digest).alias("password_hash"), F.when(bcrypt, "bcrypt").alias("password_hash_type"), F.nullif(metadata, F.lit("{}")).alias("metadata"),
        F.when(email.isNull(), "Missing required field: primary_email_address").alias("skip_reason"),
        F.when(digest.isNotNull() & hasher.isNotNull() & ~bcrypt, F.concat(F.lit("unsupported password hasher "), hasher)).alias("warning"),
    )


@dataclass(frozen=True)
class Scrypt:
    signer_key: str
    salt_separator: str = "Bw=="
    rounds: int = 8
    mem_cost: int = 14


def firebase(df: DataFrame, strategy: str = "first-space", include_disabled: bool = False, scrypt: Scrypt | None = None) -> DataFrame:
    """Firebase records (nested, schema FIREBASE_USER): disabled users are left out unless asked for; a hash needs the project's scrypt parameters."""
    email, uid = _clean(df, "email"), _clean(df, "localId")
    disabled = F.coalesce("disabled", F.lit(False))
    first, last = text.split_display_name(F.col("displayName"), strategy)
    has_hash = F.nullif("passwordHash", F.lit("")).isNotNull() & F.nullif("salt", F.lit("")).isNotNull()
    phc = text.scrypt_phc(F.col("passwordHash"), F.col("salt"), scrypt.signer_key, scrypt.salt_separator, scrypt.rounds, scrypt.mem_cost) if scrypt else F.lit(None).cast("string")
    attributes = text.filled(F.col("customAttributes"))
    listed = lambda c: F.when(F.size(c) > 0, F.to_json(c))
    quoted = lambda c: F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    # values as JSON texts, so that objects stay objects
    parts = {
        "firebase_uid": quoted(uid), "phone_number": quoted(_clean(df, "phoneNumber")), "photo_url": quoted(_clean(df, "photoUrl")),
        "custom_attributes": F.when(jsons.is_json(attributes), attributes).otherwise(quoted(attributes)),
        "provider_info": listed(F.col("providerUserInfo")), "mfa_info": listed(F.col("mfaInfo")),
        "created_at": quoted(text.epoch_ms_to_iso(F.col("createdAt"))), "last_signed_in_at": quoted(text.epoch_ms_to_iso(F.col("lastSignedInAt"))),
        "disabled": F.when(disabled & F.lit(include_disabled), "true"),
    }
    sources = {"firebase_uid": uid, "phone_number": _clean(df, "phoneNumber"), "photo_url": _clean(df, "photoUrl"), "custom_attributes": attributes, "created_at": text.epoch_ms_to_iso(F.col("createdAt")), "last_signed_in_at": text.epoch_ms_to_iso(F.col("lastSignedInAt"))}
    entries = [F.when(sources[k].isNotNull() if k in sources else v.isNotNull(), F.concat(F.lit(f'"{k}":'), v)) for k, v in parts.items()]
    metadata = F.array_join(F.array_compact(F.array(*entries)), ",")
    return df.select(
        RECORD, email.alias("email"), F.nullif(first, F.lit("")).alias("first_name"), F.nullif(last, F.lit("")).alias("last_name"), F.coalesce(F.col("emailVerified"), F.lit(False)).cast("string").alias("email_verified"),
        uid.alias("external_id"), F.when(has_hash, phc).alias("password_hash"), F.when(has_hash & phc.isNotNull(), "firebase-scrypt").alias("password_hash_type"),
        F.when(metadata != "", F.concat(F.lit("{"), metadata, F.lit("}"))).alias("metadata"),
        F.when(email.isNull(), MISSING_ADDRESS).when(disabled & F.lit(not include_disabled), USER_DISABLED).alias("skip_reason"),
        F.when(has_hash & phc.isNull(), "no scrypt parameters: the password is not carried over").alias("warning"),
    )


def auth0(df: DataFrame) -> DataFrame:
    """Auth0 users joined to their organisation (columns org_id, org_name, org_display_name; user_metadata and app_metadata as JSON texts, identities as an array of structs, hash and algorithm)."""
    given, family = F.nullif("given_name", F.lit("")), F.nullif("family_name", F.lit(""))
    from_name = given.isNull() & family.isNull()
    audit = {"auth0_user_id": F.col("user_id"), "auth0_created_at": F.col("created_at"), "auth0_updated_at": F.col("updated_at")}
    if "identities" in df.columns:
        audit["auth0_identities"] = F.when(F.size("identities") > 0, F.to_json(F.transform("identities", lambda i: F.struct(i["provider"].alias("provider"), i["connection"].alias("connection"), i["isSocial"].alias("isSocial")))))
    more = {"auth0_last_login": F.nullif("last_login", F.lit("")), "auth0_logins_count": F.col("logins_count").cast("string")}
    always = F.create_map(*[x for k, v in list(audit.items())[:3] for x in (F.lit(k), v)]).cast(jsons.MAP)
    rest = F.map_filter(F.create_map(*[x for k, v in [*list(audit.items())[3:], *more.items()] for x in (F.lit(k), v)]).cast(jsons.MAP), lambda k, v: v.isNotNull())
    metadata = jsons.sanitised(jsons.merged(jsons.merged(jsons.merged(jsons.string_map(F.col("user_metadata")), jsons.string_map(F.col("app_metadata"))), always), rest))
    algorithm = F.col("algorithm") if "algorithm" in df.columns else F.lit(None).cast("string")
    row = df.select(
        RECORD, F.col("email"), F.when(from_name, text.first_token(F.col("name"))).otherwise(F.col("given_name")).alias("first_name"),
        F.when(from_name, text.other_tokens(F.col("name"))).otherwise(F.col("family_name")).alias("last_name"), F.col("email_verified").cast("string").alias("email_verified"), F.col("user_id").alias("external_id"),
        jsons.object_or_null(metadata).alias("metadata"), F.col("org_id").alias("org_external_id"), F.coalesce(F.nullif("org_display_name", F.lit("")), F.col("org_name")).alias("org_name"),
        (F.col("hash") if "hash" in df.columns else F.lit(None).cast("string")).alias("password_hash"), text.supported_algorithm(F.nullif(algorithm, F.lit(""))).alias("password_hash_type"),
    )
    return row.withColumn("skip_reason", exported_row_error(row))


def exported_row_error(df: DataFrame) -> Column:
    """What keeps a mapped row from being exported; null for a good one."""
    email, metadata = F.col("email"), F.nullif("metadata", F.lit(""))
    return (
        F.when(text.is_blank(email), MISSING_FIELD)
        .when(~email.contains("@"), F.concat(F.lit(BAD_EMAIL), email))
        .when(metadata.isNotNull() & ~jsons.is_json(metadata), BAD_METADATA)
    )


def output_columns(mapping: DataFrame | None, roles: DataFrame | None) -> list[str]:
    """The base columns, the organisation columns that the first mapping row has a value for, and role_slugs if any role is mapped. Reads one row of each."""
    base = [c for c in KNOWN_COLUMNS if c in ("email", "first_name", "last_name", "email_verified", "external_id", "password_hash", "password_hash_type", "metadata")]
    first = mapping.orderBy(RECORD).first() if mapping is not None else None
    base += [c for c in ("org_id", "org_external_id", "org_name") if first is not None and c in first and (first[c] or "").strip()]
    return base + (["role_slugs"] if roles is not None and roles.limit(1).count() else [])


def with_mappings(rows: DataFrame, mapping: DataFrame | None = None, roles: DataFrame | None = None, key: str = "user_id") -> DataFrame:
    """Rows with their organisation and role_slugs (comma-separated, in order), joined on external_id = key."""
    if mapping is not None:
        rows = apply_org_mapping(rows, org_mapping(mapping, key), "external_id", key)
    if roles is not None:
        listed = role_mapping(roles, key).select(F.col(key).alias("__user"), F.array_join("roles", ",").alias("role_slugs"))
        rows = rows.join(listed, rows["external_id"] == listed["__user"], "left").drop("__user")
    return rows


def transform_summary(rows: DataFrame) -> DataFrame:
    """One row of counts over a transform's result (before skipped rows are left out)."""
    kept = F.col("skip_reason").isNull()
    counts = {
        "total_users": F.count("*"), "transformed_users": F.count_if(kept), "skipped_users": F.count_if(~kept),
        "with_password": F.count_if(kept & F.col("password_hash").isNotNull()), "without_password": F.count_if(kept & F.col("password_hash").isNull()),
    }
    if "org_id" in rows.columns:
        mapped = F.coalesce(F.col("org_id"), F.col("org_external_id"), F.col("org_name")).isNotNull()
        counts |= {"with_org": F.count_if(kept & mapped), "without_org": F.count_if(kept & ~mapped)}
    if "role_slugs" in rows.columns:
        counts |= {"with_roles": F.count_if(kept & F.col("role_slugs").isNotNull())}
    return rows.agg(*[v.alias(k) for k, v in counts.items()])


def skip_reasons(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("skip_reason").isNotNull()).groupBy("skip_reason").agg(F.count("*").alias("rows"))
