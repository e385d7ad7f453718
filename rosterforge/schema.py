"""Relations of the engine: the canonical user row and what is derived from it."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The known columns of a user row, in output order.
KNOWN_COLUMNS = (
    "email", "password", "password_hash", "password_hash_type", "first_name", "last_name", "email_verified",
    "external_id", "metadata", "org_id", "org_external_id", "org_name", "role_slugs",
)
RECORD = "record_number"
ISSUE = ("severity", "category", "field", "email", "message", "rule_id", "original_value", "fixed_value", "org_id", "org_external_id")
ISSUES = f"array<struct<{','.join(f'{c}:string' for c in ISSUE)}>>"
# The columns of an error log and the fields of the exports that are read.
ERROR_RECORD = (
    "recordNumber long, email string, userId string, errorType string, errorMessage string, timestamp string, rawRow map<string,string>, httpStatus int, code string, requestId string, "
    "orgId string, orgExternalId string, roleSlugs array<string>"
)
FIREBASE_USER = (
    "localId string, email string, emailVerified boolean, displayName string, photoUrl string, phoneNumber string, disabled boolean, passwordHash string, salt string, customAttributes string, "
    "createdAt string, lastSignedInAt string, providerUserInfo array<struct<providerId:string,rawId:string,email:string,displayName:string,photoUrl:string>>, "
    "mfaInfo array<struct<mfaEnrollmentId:string,displayName:string,phoneInfo:string,enrolledAt:string>>"
)
PASSWORD = "email string, passwordHash string, password_set_date struct<`$date`:string>"
TOTP = "email string, totp_secret string, secret string, mfa_factors array<struct<type:string,secret:string,totp_secret:string>>"
# Messages by which retry classes, reports and skip reasons tell cases apart.
MISSING_EMAIL = "Missing required email"
INVALID_METADATA = "Invalid metadata JSON"
BOTH_ORGS = "Row cannot specify both org_id and org_external_id"
ORG_NOT_FOUND = "Organization not found: "
HASH_WITHOUT_TYPE = "password_hash provided without password_hash_type"
EMPTY_ROLES = "role_slugs column is present but empty"
MISSING_ADDRESS = "Missing email address"
USER_DISABLED = "User is disabled"
MISSING_FIELD = "Missing required field: email"
BAD_EMAIL = "Invalid email format: "
BAD_METADATA = "Invalid metadata: must be valid JSON"


def require_columns(df: DataFrame, every: Sequence[str] = (), some: Sequence[Sequence[str]] = ()) -> DataFrame:
    """df, if it has each column of `every` and one of each group of `some`. Checked on the schema, so also for a table without rows."""
    missing = [c for c in every if c not in df.columns] + ["|".join(g) for g in some if not any(c in df.columns for c in g)]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df


def detect_mode(columns: Iterable[str], org_flag: bool = False) -> str:
    """single-org if an organisation is given from outside, multi-org if a column names one, else user-only."""
    if org_flag:
        return "single-org"
    return "multi-org" if {"org_id", "org_external_id", "org_name"} & set(columns) else "user-only"


def with_known_columns(df: DataFrame) -> DataFrame:
    """df with each known column that it lacks as null, and a record number column, which is null where there was none."""
    missing = {c: F.lit(None).cast("string") for c in KNOWN_COLUMNS if c not in df.columns}
    if RECORD not in df.columns:
        missing[RECORD] = F.lit(None).cast("long")
    return df.withColumns(missing) if missing else df
