"""The engine's operators as queries over the given tables, each with the SQL that gives the same rows.

User rows and error records are derived from the table `events`, one per event, by integer arithmetic: see users() and USERS_SQL, errors() and ERRORS_SQL.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import jsons, text
from .operators import analyze, dedupe, joins, load, ordering, transforms, validate
from .operators.mapping import FieldMapping, MetadataMapping, Profile, apply_profile, unmapped_counts
from .plans.planner import estimated
from .schema import FIREBASE_USER
from .sources.synthetic import distribution, org_number

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SCRYPT = transforms.Scrypt("key-_1", "Bw==", 8, 14)


def query(sql: str | None = None, *parts: str):
    """Registers a query under its function's name. parts: the common tables that its SQL starts with."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (f"WITH {', '.join(parts)} " if parts else "") + sql.strip()
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


USERS_SQL = """
users AS (SELECT event_id + 1 AS record_number, event_type, user_id,
  CASE WHEN event_id % 13 = 0 THEN '' WHEN event_id % 17 = 0 THEN 'user' || (user_id % 97) WHEN event_id % 7 = 0 THEN '  USER' || (user_id % 97) || '@Org' || (user_id % 10) || '.example.com '
    ELSE 'User' || (user_id % 97) || '@Org' || (user_id % 10) || '.example.com' END AS email,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'First' || (user_id % 50) END AS first_name, event_type AS last_name,
  CASE event_id % 6 WHEN 0 THEN 'true' WHEN 1 THEN 'yes' WHEN 2 THEN '1' WHEN 3 THEN 'no' WHEN 4 THEN 'maybe' ELSE '' END AS email_verified,
  'user_' || user_id AS external_id, props AS metadata,
  CASE WHEN event_id % 19 = 0 THEN 'org_' || (user_id % 10) ELSE NULL END AS org_id,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE 'org-' || lpad(CAST(user_id % 10 AS VARCHAR), 6, '0') END AS org_external_id,
  'Organization ' || (event_id % 3) AS org_name,
  CASE WHEN event_id % 4 = 0 THEN '["admin", "member"]' WHEN event_id % 4 = 1 THEN 'member, viewer' WHEN event_id % 4 = 2 THEN 'Bad Role,member' ELSE '' END AS role_slugs,
  CASE WHEN event_id % 23 = 0 THEN '$2b$10$abc' ELSE NULL END AS password_hash, CASE WHEN event_id % 46 = 0 THEN 'bcrypt' ELSE NULL END AS password_hash_type
  FROM events)"""
ERRORS_SQL = """
errors AS (SELECT event_id + 1 AS rn, CASE WHEN event_id % 9 = 0 THEN NULL ELSE 'User' || (user_id % 97) || '@example.com' END AS email, CASE WHEN event_id % 2 = 0 THEN 'user_' || user_id ELSE NULL END AS user_id,
  CASE event_id % 4 WHEN 0 THEN 'user_create' WHEN 1 THEN 'membership_create' WHEN 2 THEN 'org_resolution' ELSE NULL END AS error_type,
  CASE event_id % 7 WHEN 0 THEN 400 WHEN 1 THEN 409 WHEN 2 THEN 422 WHEN 3 THEN 429 WHEN 4 THEN 500 WHEN 5 THEN 503 ELSE NULL END AS status,
  CASE event_id % 5 WHEN 0 THEN 'Invalid email u' || user_id || '@mail.example.com   given' WHEN 1 THEN 'Organization not found: org_' || repeat(CAST(user_id % 10 AS VARCHAR), 24)
    WHEN 2 THEN 'Request 0a1b2c3d-0000-4000-8000-' || lpad(CAST(user_id AS VARCHAR), 12, '0') || ' failed' WHEN 3 THEN 'Unexpected token in JSON at ' || (100000 + user_id) ELSE 'Server said no ' || (user_id % 3) END AS message,
  event_id % 10 <> 0 AS has_row FROM events)"""
#: The text functions in SQL; the derived rows have ASCII white space only.
EMAIL_SQL = "nullif(lower(trim(coalesce(email, ''))), '')"
BOOL_SQL = "CASE WHEN lower(trim(email_verified)) IN ('true','1','yes','y') THEN true WHEN lower(trim(email_verified)) IN ('false','0','no','n') THEN false END"
PATTERN_SQL = (
    "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(message, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{2,}\\b', '<EMAIL>', 'g'), "
    "'\\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\\b', '<UUID>', 'gi'), '\\borg_[A-Za-z0-9]{20,}', '<ORG_ID>', 'g'), '\\buser_[A-Za-z0-9]{20,}', '<USER_ID>', 'g'), '\\b\\d{5,}\\b', '<NUMBER>', 'g'), '\\s+', ' ', 'g'))"
)
REASON_SQL = """CASE WHEN status = 429 THEN 'rate_limit' WHEN error_type = 'org_resolution' AND lower(message) LIKE '%not found%' THEN 'org_not_found'
  WHEN error_type = 'org_resolution' AND (status IS NULL OR status >= 500) THEN 'org_lookup_error' WHEN error_type = 'org_resolution' THEN 'org_resolution_error'
  WHEN error_type = 'membership_create' AND user_id IS NOT NULL AND status = 409 THEN 'membership_duplicate' WHEN error_type = 'membership_create' AND user_id IS NOT NULL AND status >= 500 THEN 'membership_error_user_exists'
  WHEN error_type = 'membership_create' AND user_id IS NOT NULL AND status >= 400 THEN 'membership_validation_error' WHEN error_type = 'user_create' AND status >= 500 THEN 'user_create_server_error'
  WHEN error_type = 'user_create' AND status >= 400 THEN 'user_create_validation_error' WHEN status >= 500 THEN 'server_error' WHEN status = 409 THEN 'conflict_duplicate'
  WHEN status IN (400, 422) THEN 'validation_error' WHEN status IS NULL THEN 'unknown_error' ELSE 'unknown_non_retryable' END"""
AGAIN = "('rate_limit','org_lookup_error','membership_error_user_exists','user_create_server_error','server_error','unknown_error')"
CLASSED_SQL = f"classed AS (SELECT *, {REASON_SQL} AS reason, {PATTERN_SQL} AS pattern FROM errors)"
GROUPS_SQL = f"""
grps AS (SELECT substr(md5(coalesce(error_type, 'unknown') || '-' || coalesce(CAST(status AS VARCHAR), 'none') || '-' || pattern), 1, 12) AS group_id, pattern, error_type, status, count(*) AS n,
  min(rn) AS first_record, arg_min(reason IN {AGAIN}, rn) AS retryable FROM classed GROUP BY ALL),
graded AS (SELECT *, CASE WHEN NOT retryable AND status IN (400, 422) THEN 'critical' WHEN error_type = 'org_resolution' THEN 'critical' WHEN status = 409 THEN 'high' WHEN status >= 500 THEN 'medium' ELSE 'low' END AS severity FROM grps)"""


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User rows out of events: mixed case, padding, blanks, wrong booleans, repeats."""
    e, i, u = table(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id")
    name = lambda s: F.concat(F.lit(s), (u % 97).cast("string"), F.lit("@Org"), (u % 10).cast("string"), F.lit(".example.com"))
    return e.select(
        (i + 1).alias("record_number"), "event_type", "user_id",
        F.when(i % 13 == 0, "").when(i % 17 == 0, F.concat(F.lit("user"), (u % 97).cast("string"))).when(i % 7 == 0, F.concat(name("  USER"), F.lit(" "))).otherwise(name("User")).alias("email"),
        F.when(i % 5 != 0, F.concat(F.lit("First"), (u % 50).cast("string"))).alias("first_name"), F.col("event_type").alias("last_name"),
        F.element_at(F.array(*[F.lit(x) for x in ("true", "yes", "1", "no", "maybe", "")]), (i % 6 + 1).cast("int")).alias("email_verified"),
        F.concat(F.lit("user_"), u.cast("string")).alias("external_id"), F.col("props").alias("metadata"), F.when(i % 19 == 0, F.concat(F.lit("org_"), (u % 10).cast("string"))).alias("org_id"),
        F.when(i % 11 != 0, F.concat(F.lit("org-"), F.lpad((u % 10).cast("string"), 6, "0"))).alias("org_external_id"), F.concat(F.lit("Organization "), (i % 3).cast("string")).alias("org_name"),
        F.element_at(F.array(*[F.lit(x) for x in ('["admin", "member"]', "member, viewer", "Bad Role,member", "")]), (i % 4 + 1).cast("int")).alias("role_slugs"),
        F.when(i % 23 == 0, "$2b$10$abc").alias("password_hash"), F.when(i % 46 == 0, "bcrypt").alias("password_hash_type"),
    )


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i, u = table(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id")
    text_of = lambda c: c.cast("string")
    pick = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), (i % len(values) + 1).cast("int"))
    message = (
        F.when(i % 5 == 0, F.concat(F.lit("Invalid email u"), text_of(u), F.lit("@mail.example.com   given"))).when(i % 5 == 1, F.concat(F.lit("Organization not found: org_"), F.repeat(text_of(u % 10), 24)))
        .when(i % 5 == 2, F.concat(F.lit("Request 0a1b2c3d-0000-4000-8000-"), F.lpad(text_of(u), 12, "0"), F.lit(" failed"))).when(i % 5 == 3, F.concat(F.lit("Unexpected token in JSON at "), text_of(u + 100000)))
        .otherwise(F.concat(F.lit("Server said no "), text_of(u % 3)))
    )
    return e.select(
        (i + 1).alias("recordNumber"), F.when(i % 9 != 0, F.concat(F.lit("User"), text_of(u % 97), F.lit("@example.com"))).alias("email"), F.when(i % 2 == 0, F.concat(F.lit("user_"), text_of(u))).alias("userId"),
        pick(("user_create", "membership_create", "org_resolution", None), "string").alias("errorType"), pick((400, 409, 422, 429, 500, 503, None), "int").alias("httpStatus"), message.alias("errorMessage"),
        F.when(i % 10 != 0, F.create_map(F.lit("email"), F.lit("x"))).alias("rawRow"),
    )


@query(f"SELECT record_number, lower(trim(email)) AS email, nullif(trim(first_name), '') AS first_name, upper(last_name) AS last_name, CAST({BOOL_SQL} AS VARCHAR) AS email_verified, coalesce(org_id, 'none') AS org_id FROM users", USERS_SQL)
def q01_canonical_projection(spark, sf_dir):
    profile = Profile("events", (FieldMapping("email", "email", "lowercase_trim", default=""), FieldMapping("first_name", "first_name", "trim"), FieldMapping("last_name", "last_name", "uppercase"), FieldMapping("email_verified", "email_verified", "to_boolean"), FieldMapping("org_id", "org_id", default="none")))
    return apply_profile(users(spark, sf_dir), profile)


@query(f"SELECT record_number, CAST({BOOL_SQL} AS VARCHAR) AS parsed, CASE WHEN trim(email_verified) = '' THEN email_verified ELSE CAST(coalesce({BOOL_SQL}, false) AS VARCHAR) END AS fixed FROM users", USERS_SQL)
def q02_boolean_like(spark, sf_dir):
    rows = users(spark, sf_dir).withColumn("parsed", text.bool_text(F.col("email_verified")))
    return validate.fix_rows(rows, [validate.rule_by_id("boolean-format")]).select("record_number", "parsed", F.col("email_verified").alias("fixed"))


ISSUES_SQL = """
SELECT record_number, 'required-email' AS rule_id, 'error' AS severity, 'email' AS field FROM users WHERE trim(email) = ''
UNION ALL SELECT record_number, 'email-format', 'error', 'email' FROM users WHERE trim(email) <> '' AND email NOT LIKE '%@%'
UNION ALL SELECT record_number, 'email-whitespace', 'warning', 'email' FROM users WHERE email <> trim(email)
UNION ALL SELECT record_number, 'org-id-conflict', 'error', NULL FROM users WHERE org_id IS NOT NULL AND org_external_id IS NOT NULL
UNION ALL SELECT record_number, 'boolean-format', 'warning', 'email_verified' FROM users WHERE email_verified = 'maybe'
UNION ALL SELECT record_number, 'role-slugs-format', 'warning', 'role_slugs' FROM users WHERE role_slugs = ''
UNION ALL SELECT record_number, 'role-slugs-format', 'error', 'role_slugs' FROM users WHERE role_slugs = 'Bad Role,member'
UNION ALL SELECT record_number, 'password-hash-complete', 'error', 'password_hash' FROM users WHERE password_hash IS NOT NULL AND password_hash_type IS NULL"""
ISSUES_CTE = f"issues AS ({ISSUES_SQL})"
STATUS_SQL = "status AS (SELECT u.record_number, CASE WHEN bool_or(i.severity = 'error') THEN 'invalid' WHEN bool_or(i.severity = 'warning') THEN 'warning' ELSE 'valid' END AS status FROM users u LEFT JOIN issues i USING (record_number) GROUP BY 1)"


@query("SELECT * FROM issues", USERS_SQL, ISSUES_CTE)
def q03_validation_issues(spark, sf_dir):
    return validate.row_issues(validate.check_rows(users(spark, sf_dir))).select("record_number", "rule_id", "severity", "field")


@query(
    f"""SELECT count(*) AS total_rows, count(*) FILTER (status = 'valid') AS valid_rows, count(*) FILTER (status = 'invalid') AS invalid_rows, count(*) FILTER (status = 'warning') AS warning_rows,
  count(DISTINCT {EMAIL_SQL}) AS duplicate_emails, count(DISTINCT external_id) AS duplicate_external_ids, count({EMAIL_SQL}) - count(DISTINCT {EMAIL_SQL}) AS repeated_emails, CAST(0 AS BIGINT) AS fixes
  FROM users JOIN status USING (record_number)""",
    USERS_SQL, ISSUES_CTE, STATUS_SQL,
)
def q04_validation_summary(spark, sf_dir):
    return validate.summary(validate.validate(users(spark, sf_dir)))


@query(f"SELECT record_number, rule_id FROM (SELECT record_number, 'duplicate-email' AS rule_id, row_number() OVER (PARTITION BY {EMAIL_SQL} ORDER BY record_number) AS n, {EMAIL_SQL} AS k FROM users UNION ALL SELECT record_number, 'duplicate-external-id', row_number() OVER (PARTITION BY external_id ORDER BY record_number), external_id FROM users) WHERE n > 1 AND k IS NOT NULL", USERS_SQL)
def q05_duplicates_flagged(spark, sf_dir):
    return validate.duplicate_issues(users(spark, sf_dir)).select("record_number", "rule_id")


def _first_sql(c: str) -> str:
    return f"coalesce(nullif(arg_min(coalesce({c}, ''), record_number), ''), arg_min(trim({c}), record_number) FILTER (trim(coalesce({c}, '')) <> ''), '') AS {c}"


@query(
    f"""SELECT {EMAIL_SQL} AS email_key, min(record_number) AS record_number, count(*) AS rows, CASE WHEN bool_or({BOOL_SQL}) THEN 'true' ELSE arg_min(email_verified, record_number) END AS email_verified,
  {', '.join(_first_sql(c) for c in dedupe.FILLED)}, arg_min(email, record_number) AS email FROM users WHERE {EMAIL_SQL} IS NOT NULL GROUP BY 1""",
    USERS_SQL,
)
def q06_merge_by_email(spark, sf_dir):
    made = dedupe.merge(users(spark, sf_dir))
    return made.select("email_key", "record_number", "rows", "email_verified", *[F.coalesce(c, F.lit("")).alias(c) for c in dedupe.FILLED], "email")


#: Metadata of several JSON types, of user rows: (email_key, record_number, at, key, value), values as JSON texts.
TYPED_SQL = """
typed AS (SELECT * REPLACE (CASE event_id % 9 WHEN 0 THEN '{"k":0,"s":"0","b":false,"10":' || user_id % 3 || '}' WHEN 1 THEN '{"o":{"z":1,"a":[1,2,{"q":null}]},"k":' || user_id % 5 || ',"n":null}'
    WHEN 2 THEN '{"s":"x' || user_id % 4 || '","b":true,"d":1.5}' WHEN 3 THEN '' WHEN 4 THEN 'not json' WHEN 5 THEN '[1,2]' WHEN 6 THEN '{"b":"false","e":"","u":"\u00e9\\"q","2":"two"}' WHEN 7 THEN NULL ELSE metadata END AS metadata) FROM
  (SELECT *, record_number - 1 AS event_id FROM users)),
objects AS (SELECT EMAIL record_number, metadata FROM typed WHERE CASE WHEN json_valid(metadata) THEN json_type(metadata) END = 'OBJECT'),
entries AS (SELECT email_key, record_number, place, key, CAST(json_extract(metadata, '$."' || key || '"') AS VARCHAR) AS value FROM
  (SELECT email_key, record_number, metadata, unnest(json_keys(metadata)) AS key, generate_subscripts(json_keys(metadata), 1) AS place FROM objects WHERE email_key IS NOT NULL)),
chosen AS (SELECT email_key, key, coalesce(arg_min(value, record_number) FILTER (value NOT IN ('null', 'false', '""', '0')), arg_max(value, record_number)) AS value, min(record_number * 100 + place) AS first FROM entries GROUP BY ALL)""".replace("EMAIL", f"{EMAIL_SQL} AS email_key,")


def typed_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User rows with metadata of several JSON types."""
    i, rows = F.col("record_number") - 1, users(spark, sf_dir)
    of = lambda n: (F.col("user_id") % n).cast("string")
    made = (
        F.when(i % 9 == 0, F.concat(F.lit('{"k":0,"s":"0","b":false,"10":'), of(3), F.lit("}"))).when(i % 9 == 1, F.concat(F.lit('{"o":{"z":1,"a":[1,2,{"q":null}]},"k":'), of(5), F.lit(',"n":null}')))
        .when(i % 9 == 2, F.concat(F.lit('{"s":"x'), of(4), F.lit('","b":true,"d":1.5}'))).when(i % 9 == 3, "").when(i % 9 == 4, "not json").when(i % 9 == 5, "[1,2]").when(i % 9 == 6, '{"b":"false","e":"","u":"é\\"q","2":"two"}')
        .when(i % 9 == 7, None).otherwise(F.col("metadata"))
    )
    return rows.withColumn("metadata", made)


@query(
    f"""SELECT email_key, field, string_agg(value, '|' ORDER BY pos, value) AS values, CASE strategy WHEN 'true-if-any' THEN 'true' ELSE arg_min(value, pos) END AS chosen, strategy FROM (
  SELECT email_key, field, value, strategy, min(record_number) AS pos FROM (
    {' UNION ALL '.join(f"SELECT {EMAIL_SQL} AS email_key, record_number, '{c}' AS field, nullif(trim({c}), '') AS value, 'first-non-empty' AS strategy FROM typed" for c in dedupe.FILLED)}
    UNION ALL SELECT {EMAIL_SQL}, record_number, 'email_verified', CAST({BOOL_SQL} AS VARCHAR), 'true-if-any' FROM typed
    UNION ALL SELECT e.email_key, e.record_number, 'metadata.' || e.key, e.value, 'first-occurrence' FROM entries e
      JOIN (SELECT email_key, key, min(record_number) AS begin FROM entries WHERE value NOT IN ('null', 'false', '""', '0') GROUP BY ALL) s ON s.email_key = e.email_key AND s.key = e.key AND e.record_number >= s.begin)
  WHERE value IS NOT NULL AND email_key IS NOT NULL GROUP BY ALL) GROUP BY email_key, field, strategy HAVING count(*) > 1""",
    USERS_SQL, TYPED_SQL,
)
def q07_merge_conflicts(spark, sf_dir):
    return dedupe.conflicts(typed_users(spark, sf_dir)).select("email_key", "field", F.array_join("values", "|").alias("values"), "chosen", "strategy")


@query(f"SELECT CAST(sum(n) AS BIGINT) AS total_rows, count(*) AS unique_emails, count(*) FILTER (n > 1) AS duplicate_groups, CAST(sum(n - 1) AS BIGINT) AS rows_removed FROM (SELECT count(*) AS n FROM users WHERE {EMAIL_SQL} IS NOT NULL GROUP BY {EMAIL_SQL})", USERS_SQL)
def q08_merge_summary(spark, sf_dir):
    return dedupe.summary(users(spark, sf_dir))


@query("SELECT email_key, key, value FROM chosen", USERS_SQL, TYPED_SQL)
def q09_metadata_merge(spark, sf_dir):
    return dedupe.metadata_values(dedupe.grouped(typed_users(spark, sf_dir))).select("email_key", "key", "value")


@query(
    f"""SELECT email_key, n AS rows, CASE WHEN n = 1 THEN base ELSE coalesce(merged, base) END AS metadata FROM (SELECT {EMAIL_SQL} AS email_key, count(*) AS n, list(metadata ORDER BY record_number)[1] AS base FROM typed WHERE {EMAIL_SQL} IS NOT NULL GROUP BY 1)
  LEFT JOIN (SELECT email_key, '{{' || string_agg('"' || key || '":' || value, ',' ORDER BY coalesce(try_cast(key AS INTEGER), 1000000), first) || '}}' AS merged FROM chosen GROUP BY 1) USING (email_key)""",
    USERS_SQL, TYPED_SQL,
)
def q69_typed_metadata(spark, sf_dir):
    return dedupe.merge(typed_users(spark, sf_dir)).select("email_key", "rows", "metadata")


@query(
    """SELECT record_number, m.org_id AS org_id, CASE WHEN m.org_id IS NULL THEN m.org_external_id END AS org_external_id, CASE WHEN m.org_id IS NULL THEN m.org_name END AS org_name FROM users u LEFT JOIN
  (SELECT external_id, arg_max({'a': org_id}, record_number).a AS org_id, arg_max(org_external_id, record_number) AS org_external_id, arg_max(org_name, record_number) AS org_name FROM (SELECT record_number, external_id,
    CASE WHEN record_number % 3 = 0 THEN 'org_' || n_nationkey ELSE NULL END AS org_id, 'ext_' || n_nationkey AS org_external_id, n_name AS org_name FROM users JOIN nation ON n_nationkey = user_id % 25 WHERE user_id % 2 = 0) GROUP BY 1) m USING (external_id)""",
    USERS_SQL,
)
def q10_org_mapping(spark, sf_dir):
    rows, nation = users(spark, sf_dir), table(spark, sf_dir, "nation")
    mapping = rows.where("user_id % 2 = 0").join(nation, nation["n_nationkey"] == rows["user_id"] % 25).select(
        "record_number", "external_id", F.when(F.col("record_number") % 3 == 0, F.concat(F.lit("org_"), F.col("n_nationkey").cast("string"))).alias("org_id"), F.concat(F.lit("ext_"), F.col("n_nationkey").cast("string")).alias("org_external_id"), F.col("n_name").alias("org_name")
    )
    return joins.apply_org_mapping(rows.select("record_number", "external_id"), joins.org_mapping(mapping, "external_id"), "external_id", "external_id").select("record_number", "org_id", "org_external_id", "org_name")


@query("SELECT external_id, string_agg(event_type, ',' ORDER BY pos) AS roles FROM (SELECT external_id, event_type, min(record_number) AS pos FROM users GROUP BY 1, 2) GROUP BY 1", USERS_SQL)
def q11_roles_per_user(spark, sf_dir):
    made = joins.role_mapping(users(spark, sf_dir).withColumnRenamed("event_type", "role_slug"), "external_id")
    return made.select("external_id", F.array_join("roles", ",").alias("roles"))


ROLES_SQL = "roles AS (SELECT external_id, list(event_type ORDER BY pos) AS roles FROM (SELECT external_id, event_type, min(record_number) AS pos FROM users GROUP BY 1, 2) GROUP BY 1)"
OWN_SQL = "CASE record_number % 4 WHEN 1 THEN ['admin', 'member'] WHEN 2 THEN ['member', 'viewer'] WHEN 3 THEN ['Bad Role', 'member'] ELSE [] END"


@query(f"SELECT record_number, array_to_string(list_concat({OWN_SQL}, list_filter(roles, lambda x: NOT list_contains({OWN_SQL}, x))), ',') AS all_roles FROM users JOIN roles USING (external_id)", USERS_SQL, ROLES_SQL)
def q12_role_union(spark, sf_dir):
    rows = users(spark, sf_dir)
    roles = joins.role_mapping(rows.withColumnRenamed("event_type", "role_slug"), "external_id")
    return joins.with_user_roles(rows, roles, text.split_list(F.col("role_slugs"))).select("record_number", F.array_join("all_roles", ",").alias("all_roles"))


HASH_SQL = "CASE o_orderkey % 6 WHEN 0 THEN '$2b$10$' || o_orderkey WHEN 1 THEN md5(CAST(o_orderkey AS VARCHAR)) WHEN 2 THEN sha256(CAST(o_orderkey AS VARCHAR)) WHEN 3 THEN 'pbkdf2:' || o_orderkey WHEN 4 THEN '' ELSE 'x' || o_orderkey END"


@query(
    f"""SELECT c_custkey, coalesce(hash, '') AS password_hash, CASE WHEN hash IS NULL THEN '' WHEN regexp_matches(hash, '^\\$2[abxy]\\$') THEN 'bcrypt' WHEN regexp_matches(hash, '^[a-fA-F0-9]{{32}}$') THEN 'md5' WHEN regexp_matches(hash, '^[a-fA-F0-9]{{64}}$') THEN 'sha256'
  WHEN hash LIKE '%:%' THEN 'pbkdf2' ELSE 'bcrypt' END AS password_hash_type FROM customer LEFT JOIN (SELECT o_custkey, arg_max(h, o_orderkey) AS hash FROM (SELECT o_custkey, o_orderkey, nullif({HASH_SQL}, '') AS h FROM orders) WHERE h IS NOT NULL GROUP BY 1) ON o_custkey = c_custkey"""
)
def q13_password_merge(spark, sf_dir):
    k = F.col("o_orderkey")
    t = k.cast("string")
    made = F.when(k % 6 == 0, F.concat(F.lit("$2b$10$"), t)).when(k % 6 == 1, F.md5(t)).when(k % 6 == 2, F.sha2(t, 256)).when(k % 6 == 3, F.concat(F.lit("pbkdf2:"), t)).when(k % 6 == 4, "").otherwise(F.concat(F.lit("x"), t))
    email = lambda c: F.concat(F.lit("C"), c.cast("string"), F.lit("@example.com"))
    export = table(spark, sf_dir, "orders").select(k.alias("record_number"), email(F.col("o_custkey")).alias("email"), made.alias("passwordHash"), F.struct(F.lit(None).cast("string").alias("$date")).alias("password_set_date"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", email(F.col("c_custkey")).alias("email"))
    return joins.merge_passwords(rows, joins.password_lookup(export)).select("c_custkey", "password_hash", "password_hash_type")


@query(
    """SELECT 'brand' || k AS slug, CASE WHEN s_nationkey IS NULL THEN 'created' ELSE 'exists' END AS action, CASE WHEN s_nationkey IS NOT NULL THEN array_to_string(list_filter(p, lambda x: NOT list_contains(s, x)), ',') END AS missing,
  CASE WHEN s_nationkey IS NOT NULL THEN array_to_string(list_filter(s, lambda x: NOT list_contains(p, x)), ',') END AS extra
  FROM (SELECT p_size AS k, list_sort(list(DISTINCT p_type)) AS p FROM part GROUP BY 1) LEFT JOIN (SELECT s_nationkey, list_sort(list(DISTINCT CASE s_suppkey % 3 WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'STANDARD' ELSE 'OTHER' END)) AS s FROM supplier GROUP BY 1) ON s_nationkey = k"""
)
def q14_permission_diff(spark, sf_dir):
    listed = lambda c: F.array_sort(F.collect_set(c))
    wanted = table(spark, sf_dir, "part").groupBy("p_size").agg(listed("p_type").alias("permissions")).select(F.lit(1).alias("record_number"), F.concat(F.lit("brand"), F.col("p_size").cast("string")).alias("slug"), F.lit(None).cast("string").alias("org_id"), "permissions")
    kind = F.when(F.col("s_suppkey") % 3 == 0, "ECONOMY").when(F.col("s_suppkey") % 3 == 1, "STANDARD").otherwise("OTHER")
    there = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(listed(kind).alias("permissions")).select(F.concat(F.lit("brand"), F.col("s_nationkey").cast("string")).alias("slug"), F.lit(None).cast("string").alias("org_id"), "permissions")
    return joins.process_roles(wanted, there).select("slug", "action", F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"))


@query("SELECT org_external_id, arg_min(org_name, record_number) AS org_name FROM users WHERE org_external_id IS NOT NULL GROUP BY 1", USERS_SQL)
def q15_unique_orgs(spark, sf_dir):
    return joins.unique_orgs(users(spark, sf_dir))


@query(
    """SELECT record_number, CASE WHEN org_id IS NOT NULL THEN a.id ELSE b.id END AS resolved_org_id, CASE WHEN coalesce(org_id, org_external_id) IS NOT NULL AND (CASE WHEN org_id IS NOT NULL THEN a.id ELSE b.id END) IS NULL THEN 'Organization not found: ' || coalesce(org_id, org_external_id) END AS org_error
  FROM users LEFT JOIN (SELECT 'org_' || n_nationkey AS id FROM nation WHERE n_nationkey % 3 <> 0) a ON a.id = org_id LEFT JOIN (SELECT 'org_' || n_nationkey AS id, 'org-' || lpad(CAST(n_nationkey AS VARCHAR), 6, '0') AS ext FROM nation WHERE n_nationkey % 3 <> 0) b ON b.ext = org_external_id""",
    USERS_SQL,
)
def q16_resolve_orgs(spark, sf_dir):
    return joins.resolve_orgs(users(spark, sf_dir), orgs(spark, sf_dir)).select("record_number", "resolved_org_id", "org_error")


def orgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey").cast("string")
    return table(spark, sf_dir, "nation").where("n_nationkey % 3 <> 0").select(F.concat(F.lit("org_"), key).alias("id"), F.concat(F.lit("org-"), F.lpad(key, 6, "0")).alias("external_id"))


OUTCOME_SQL = f"""
built AS (SELECT record_number, {EMAIL_SQL} AS email_key, org_id, org_external_id, CASE WHEN record_number % 4 = 0 THEN 0 ELSE 2 END AS n_roles, CASE WHEN {EMAIL_SQL} IS NULL OR (org_id IS NOT NULL AND org_external_id IS NOT NULL) THEN 'user_create' END AS build_error FROM users),
resolved AS (SELECT b.*, CASE WHEN org_id IS NOT NULL THEN x.id ELSE y.id END AS org FROM built b LEFT JOIN (SELECT 'org_' || n_nationkey AS id FROM nation WHERE n_nationkey % 3 <> 0) x ON x.id = org_id
  LEFT JOIN (SELECT 'org_' || n_nationkey AS id, 'org-' || lpad(CAST(n_nationkey AS VARCHAR), 6, '0') AS ext FROM nation WHERE n_nationkey % 3 <> 0) y ON y.ext = org_external_id),
failed AS (SELECT *, CASE WHEN build_error IS NOT NULL THEN build_error WHEN coalesce(org_id, org_external_id) IS NOT NULL AND org IS NULL THEN 'org_resolution' END AS error_type FROM resolved),
ranked AS (SELECT *, row_number() OVER (PARTITION BY email_key ORDER BY record_number) AS nu, row_number() OVER (PARTITION BY email_key, org ORDER BY record_number) AS nm FROM failed WHERE error_type IS NULL),
outcomes AS (SELECT record_number, email_key, org, error_type, CASE WHEN nu = 1 THEN 'created' ELSE 'duplicate' END AS user_outcome, CASE WHEN org IS NULL THEN NULL WHEN nm = 1 THEN 'created' ELSE 'duplicate' END AS membership_outcome,
  CASE WHEN org IS NOT NULL AND nm = 1 THEN n_roles ELSE 0 END AS roles_assigned FROM ranked UNION ALL SELECT record_number, email_key, org, error_type, NULL, NULL, 0 FROM failed WHERE error_type IS NOT NULL)"""
COUNTERS_SQL = """count(*) AS total, count(*) FILTER (error_type IS NULL) AS successes, count(*) FILTER (error_type IS NOT NULL) AS failures, count(*) FILTER (user_outcome = 'created') AS users_created, count(*) FILTER (user_outcome = 'duplicate') AS duplicate_users,
  count(*) FILTER (membership_outcome = 'created') AS memberships_created, count(*) FILTER (membership_outcome = 'duplicate') AS duplicate_memberships, CAST(sum(roles_assigned) AS BIGINT) AS roles_assigned"""


@query(f"SELECT (record_number - 1) // 1000 AS chunk_id, {COUNTERS_SQL} FROM outcomes GROUP BY 1", USERS_SQL, OUTCOME_SQL)
def q17_chunk_summaries(spark, sf_dir):
    return load.chunk_summaries(load.outcomes(users(spark, sf_dir), orgs(spark, sf_dir)), 1000).withColumn("chunk_id", F.col("chunk_id").cast("long"))


@query("SELECT chunk_id, rows, round(avg(rows) OVER (ORDER BY chunk_id ROWS 4 PRECEDING), 6) AS moving FROM (SELECT l_orderkey // 1000 AS chunk_id, count(*) AS rows FROM lineitem GROUP BY 1)")
def q18_chunk_moving_average(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy(F.expr("l_orderkey div 1000").alias("chunk_id")).agg(F.count("*").alias("rows"))
    return ordering.moving_average(counts, "rows", "chunk_id", size=20).withColumn("moving", F.round("moving", 6))


@query("SELECT record_number, email_key, org, error_type, user_outcome, membership_outcome, CAST(roles_assigned AS INTEGER) AS roles_assigned FROM outcomes", USERS_SQL, OUTCOME_SQL)
def q19_load_outcomes(spark, sf_dir):
    return load.outcomes(users(spark, sf_dir), orgs(spark, sf_dir)).select("record_number", "email_key", "org", "error_type", "user_outcome", "membership_outcome", "roles_assigned")


@query(f"SELECT *, CASE WHEN failures = 0 THEN 'Success' WHEN successes > 0 THEN 'Completed with errors' ELSE 'Failed' END AS status FROM (SELECT {COUNTERS_SQL} FROM outcomes)", USERS_SQL, OUTCOME_SQL)
def q20_load_summary(spark, sf_dir):
    return load.summary(load.outcomes(users(spark, sf_dir), orgs(spark, sf_dir)))


KEY_SQL = "CASE WHEN org_id IS NOT NULL THEN 'id:' || org_id WHEN org_external_id IS NOT NULL THEN 'ext:' || org_external_id END"


@query(f"SELECT lookups, lookups - misses AS hits, misses, round(100.0 * (lookups - misses) / lookups, 2) AS hit_rate FROM (SELECT count({KEY_SQL}) AS lookups, count(DISTINCT {KEY_SQL}) AS misses FROM users)", USERS_SQL)
def q21_lookup_statistics(spark, sf_dir):
    return joins.lookup_statistics(users(spark, sf_dir), text.scope_key(F.col("org_id"), F.col("org_external_id")))


@query(f"SELECT rn AS record_number, {PATTERN_SQL} AS pattern FROM errors", ERRORS_SQL)
def q22_message_patterns(spark, sf_dir):
    return errors(spark, sf_dir).select(F.col("recordNumber").alias("record_number"), text.message_pattern(F.col("errorMessage")).alias("pattern"))


@query(f"SELECT rn AS record_number, reason, reason IN {AGAIN} AS retryable, CASE WHEN reason = 'rate_limit' THEN 'with_backoff' WHEN reason IN {AGAIN} THEN 'immediate' END AS retry_type, CASE WHEN reason = 'rate_limit' THEN 5000 END AS delay_ms FROM classed", ERRORS_SQL, CLASSED_SQL)
def q23_retry_classes(spark, sf_dir):
    return analyze.classify(errors(spark, sf_dir)).select(F.col("recordNumber").alias("record_number"), F.col("retry_reason").alias("reason"), "retryable", "retry_type", F.col("retry_delay_ms").alias("delay_ms"))


@query("SELECT group_id, pattern, error_type, status, n, severity, retryable, first_record FROM graded", ERRORS_SQL, CLASSED_SQL, GROUPS_SQL)
def q24_error_groups(spark, sf_dir):
    return _groups(spark, sf_dir)


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = analyze.groups(errors(spark, sf_dir))
    return made.select("group_id", "pattern", F.col("errorType").alias("error_type"), F.col("httpStatus").alias("status"), F.col("count").alias("n"), "severity", "retryable", "first_record")


@query(
    """SELECT group_id, code, code NOT IN ('rate_limit', 'server_error') AS actionable, n AS affected FROM (SELECT *, CASE WHEN lower(pattern) LIKE '%invalid email%' OR lower(pattern) LIKE '%email format%' THEN 'invalid_email' WHEN lower(pattern) LIKE '%missing required%' OR lower(pattern) LIKE '%required field%' THEN 'missing_field'
  WHEN status = 409 AND error_type = 'user_create' THEN 'duplicate_user' WHEN status = 409 AND error_type = 'membership_create' THEN 'duplicate_membership' WHEN error_type = 'org_resolution' AND lower(pattern) LIKE '%not found%' THEN 'org_not_found'
  WHEN lower(pattern) LIKE '%json%' THEN 'invalid_json' WHEN lower(pattern) LIKE '%password_hash%' AND lower(pattern) LIKE '%type%' THEN 'hash_without_type' WHEN status = 429 THEN 'rate_limit' WHEN status >= 500 THEN 'server_error' WHEN status IN (400, 422) THEN 'validation_error' END AS code FROM graded) WHERE code IS NOT NULL""",
    ERRORS_SQL, CLASSED_SQL, GROUPS_SQL,
)
def q25_suggestions(spark, sf_dir):
    return analyze.suggestions(analyze.groups(errors(spark, sf_dir))).select("group_id", "code", "actionable", "affected")


@query(
    f"""SELECT dimension, value, count(*) AS errors, round(count(*) * 100.0 / (SELECT count(*) FROM classed), 6) AS percent FROM (SELECT 'type' AS dimension, coalesce(error_type, 'unknown') AS value FROM classed UNION ALL SELECT 'status', coalesce(CAST(status AS VARCHAR), 'none') FROM classed
  UNION ALL SELECT CASE WHEN reason IN {AGAIN} THEN 'retry_reason' ELSE 'other_reason' END, reason FROM classed) GROUP BY 1, 2""",
    ERRORS_SQL, CLASSED_SQL,
)
def q26_error_histograms(spark, sf_dir):
    return analyze.histogram(errors(spark, sf_dir))


RETRY_SQL = f"retries AS (SELECT * FROM classed WHERE reason IN {AGAIN} AND has_row AND email IS NOT NULL)"


@query("SELECT rn AS record_number, lower(email) AS email_key, reason FROM (SELECT *, row_number() OVER (PARTITION BY lower(email) ORDER BY rn) AS n FROM retries) WHERE n = 1", ERRORS_SQL, CLASSED_SQL, RETRY_SQL)
def q27_retry_set(spark, sf_dir):
    return analyze.retry_set(errors(spark, sf_dir)).select(F.col("recordNumber").alias("record_number"), "email_key", F.col("retry_reason").alias("reason"))


@query("SELECT group_id, severity, n, first_record FROM graded ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, n DESC, first_record LIMIT 5", ERRORS_SQL, CLASSED_SQL, GROUPS_SQL)
def q28_top_groups(spark, sf_dir):
    return analyze.top_groups(analyze.groups(errors(spark, sf_dir))).select("group_id", "severity", F.col("count").alias("n"), "first_record")


NAME_SQL = "(CASE WHEN p_partkey % 5 = 0 THEN replace(p_name, ' ', '') ELSE '  ' || p_name || ' ' || p_brand END)"


@query(
    f"""SELECT p_partkey, CASE WHEN instr(n, ' ') > 0 THEN substr(n, 1, instr(n, ' ') - 1) ELSE n END AS first_a, CASE WHEN instr(n, ' ') > 0 THEN substr(n, instr(n, ' ') + 1) ELSE '' END AS last_a,
  regexp_replace(n, ' [^ ]*$', '') AS first_b, CASE WHEN instr(n, ' ') > 0 THEN regexp_extract(n, ' ([^ ]*)$', 1) ELSE '' END AS last_b, n AS first_c FROM (SELECT p_partkey, trim({NAME_SQL}) AS n FROM part)"""
)
def q29_name_splits(spark, sf_dir):
    name = F.when(F.col("p_partkey") % 5 == 0, F.replace("p_name", F.lit(" "), F.lit(""))).otherwise(F.concat(F.lit("  "), "p_name", F.lit(" "), "p_brand"))
    a, b, c = (text.split_display_name(name, s) for s in ("first-space", "last-space", "first-name-only"))
    return table(spark, sf_dir, "part").select("p_partkey", a[0].alias("first_a"), a[1].alias("last_a"), b[0].alias("first_b"), b[1].alias("last_b"), c[0].alias("first_c"))


@query("SELECT c_custkey, '$firebase-scrypt$hash=' || replace(replace(c_name || '-_', '-', '+'), '_', '/') || '$salt=' || replace(replace(c_mktsegment || '_', '-', '+'), '_', '/') || '$sk=key+/1$ss=Bw==$r=8$m=14' AS phc FROM customer")
def q30_scrypt_phc(spark, sf_dir):
    phc = text.scrypt_phc(F.concat("c_name", F.lit("-_")), F.concat("c_mktsegment", F.lit("_")), SCRYPT.signer_key, SCRYPT.salt_separator, SCRYPT.rounds, SCRYPT.mem_cost)
    return table(spark, sf_dir, "customer").select("c_custkey", phc.alias("phc"))


@query("SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN strftime(make_timestamp((1648020042135 + event_id * 7777) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') END AS iso FROM events")
def q31_epoch_to_iso(spark, sf_dir):
    ms = F.when(F.col("event_id") % 9 == 0, "never").otherwise(F.concat((F.lit(1648020042135) + F.col("event_id") * 7777).cast("string"), F.lit(" ms")))
    return table(spark, sf_dir, "events").select("event_id", text.epoch_ms_to_iso(ms).alias("iso"))


@query("SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(CASE p_partkey % 3 WHEN 0 THEN p_brand || ',' || p_type ELSE p_brand || ' , ,' || p_type || ',' END, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS items FROM part")
def q32_list_parsing(spark, sf_dir):
    raw = F.when(F.col("p_partkey") % 3 == 0, F.to_json(F.array("p_brand", "p_type"))).otherwise(F.concat("p_brand", F.lit(" , ,"), "p_type", F.lit(",")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.split_list(raw), "|").alias("items"))


@query("SELECT count(*) AS orgs_used, round(avg(n), 6) AS avg_users, max(n) AS max_users, min(n) AS min_users FROM (SELECT CASE WHEN (c_custkey * 7919) % 1000 < 800 THEN (c_custkey * 31) % 4 ELSE 4 + (c_custkey * 13) % 16 END AS org, count(*) AS n FROM customer GROUP BY 1)")
def q33_skewed_orgs(spark, sf_dir):
    return distribution(table(spark, sf_dir, "customer").select(org_number(F.col("c_custkey"), 20, skewed=True).alias("org_external_id")))


@query("SELECT skip_reason, count(*) AS rows FROM (SELECT CASE WHEN c_custkey % 7 = 0 THEN 'Missing email address' WHEN c_custkey % 5 = 0 THEN 'User is disabled' END AS skip_reason FROM customer) WHERE skip_reason IS NOT NULL GROUP BY 1")
def q34_skip_reasons(spark, sf_dir):
    return transforms.skip_reasons(transforms.firebase(_firebase_users(spark, sf_dir)))


def _firebase_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the nested export form out of customers."""
    k = F.col("c_custkey")
    known = {
        "localId": F.concat(F.lit("uid"), k.cast("string")), "email": F.when(k % 7 != 0, F.concat(F.lit("c"), k.cast("string"), F.lit("@example.com"))), "emailVerified": k % 2 == 0, "displayName": F.replace("c_name", F.lit("#"), F.lit(" ")),
        "disabled": k % 5 == 0, "passwordHash": F.when(k % 3 == 0, "aGFz-_"), "salt": F.when(k % 3 == 0, "c2Fs"), "createdAt": (k * 1000 + 1648020042135).cast("string"),
    }
    fields = spark.createDataFrame([], FIREBASE_USER).schema
    return table(spark, sf_dir, "customer").select((k + 1).alias("record_number"), *[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


@query("SELECT column_name AS column, n AS rows FROM (SELECT count(*) AS n FROM events), (SELECT unnest(['ts', 'value']) AS column_name)")
def q35_unmapped_columns(spark, sf_dir):
    profile = Profile("events", (FieldMapping("user_id", "external_id"), FieldMapping("event_type", "last_name"), FieldMapping("event_id", "email")), MetadataMapping(("props",)))
    return unmapped_counts(table(spark, sf_dir, "events"), profile)


TABLES = ("customer", "events", "lineitem", "nation", "orders", "part", "region", "supplier")


@query("SELECT name, n AS rows, CASE WHEN ceil(n / 10.0) < 60 THEN '~' || CAST(ceil(n / 10.0) AS BIGINT) || ' seconds' WHEN ceil(n / 10.0) < 3600 THEN '~' || CAST(ceil(ceil(n / 10.0) / 60.0) AS BIGINT) || ' minutes' ELSE '~' || CAST(ceil(ceil(n / 10.0) / 3600.0) AS BIGINT) || ' hours' END AS estimate FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in TABLES) + ")")
def q36_plan_estimates(spark, sf_dir):
    counts = [table(spark, sf_dir, t).agg(F.lit(t).alias("name"), F.count("*").alias("rows")) for t in TABLES]
    return functools.reduce(DataFrame.union, counts).withColumn("estimate", estimated(F.col("rows")))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(user_id AS VARCHAR) AS auth0_org_id, '' AS nothing FROM events")
def q37_metadata_sanitised(spark, sf_dir):
    raw = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("long").alias("k"), F.col("user_id").alias("org_id"), F.lit(None).cast("string").alias("nothing")), {"ignoreNullFields": "false"})
    m = jsons.sanitised(jsons.string_map(raw))
    return table(spark, sf_dir, "events").select("event_id", m["k"].alias("k"), m["auth0_org_id"].alias("auth0_org_id"), m["nothing"].alias("nothing"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'o' || user_id WHEN 1 THEN 'p' || user_id END AS org_id, CASE event_id % 3 WHEN 0 THEN 'N' || event_type END AS org_name FROM events")
def q38_org_from_metadata(spark, sf_dir):
    u, i = F.col("user_id").cast("string"), F.col("event_id")
    own = F.when(i % 3 == 0, F.to_json(F.struct(F.concat(F.lit("o"), u).alias("organization_id"), F.concat(F.lit("N"), "event_type").alias("org_name")))).otherwise("{}")
    app = F.when(i % 3 == 2, "{}").otherwise(F.to_json(F.struct(F.concat(F.lit("p"), u).alias("tenant"))))
    found = jsons.org_from_metadata(own, app, id_field="tenant")
    return table(spark, sf_dir, "events").select("event_id", found["org_id"].alias("org_id"), found["org_name"].alias("org_name"))


@query(
    """SELECT n_name AS org, c_custkey, orders, spent FROM (SELECT n_name, c_custkey, count(o_orderkey) AS orders, round(coalesce(sum(o_totalprice), 0), 2) AS spent, row_number() OVER (PARTITION BY n_name ORDER BY count(o_orderkey) DESC, c_custkey) AS n
  FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey WHERE r_name IN ('ASIA', 'EUROPE') GROUP BY 1, 2) WHERE n <= 3"""
)
def q39_org_members(spark, sf_dir):
    region, nation = table(spark, sf_dir, "region").where(F.col("r_name").isin("ASIA", "EUROPE")), table(spark, sf_dir, "nation")
    orgs_ = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(F.col("n_nationkey").alias("org_id"), F.col("n_name").alias("org"))
    members = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("org_id"), F.col("c_custkey").alias("user_id"))
    spent = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("spent"))
    found = joins.export_members(orgs_, members, spent).select("org", F.col("user_id").alias("c_custkey"), F.coalesce("orders", F.lit(0)).alias("orders"), F.round(F.coalesce("spent", F.lit(0.0)), 2).alias("spent"))
    rank = F.row_number().over(Window.partitionBy("org").orderBy(F.desc("orders"), "c_custkey"))
    return found.withColumn("n", rank).where("n <= 3").drop("n")


@query("SELECT doc_id, md5(lower(trim(text))) AS text_key FROM (SELECT *, row_number() OVER (PARTITION BY md5(lower(trim(text))) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def q40_first_of_equal_texts(spark, sf_dir):
    keyed = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.lower(F.trim("text"))).alias("text_key"))
    return ordering.keep_first(keyed, "text_key", "doc_id")


@query(f"SELECT * FROM (SELECT count(*) AS total_errors, count(*) FILTER (reason IN {AGAIN} AND has_row AND email IS NOT NULL) AS retryable_errors, count(*) FILTER (reason NOT IN {AGAIN}) AS non_retryable_errors, round(count(*) FILTER (reason IN {AGAIN} AND has_row AND email IS NOT NULL) * 100.0 / count(*), 6) AS retryable_percent, round(count(*) FILTER (reason NOT IN {AGAIN}) * 100.0 / count(*), 6) AS non_retryable_percent, count(DISTINCT email) AS affected_emails FROM classed)", ERRORS_SQL, CLASSED_SQL)
def q41_retryability(spark, sf_dir):
    return analyze.retryability(errors(spark, sf_dir))


@query("SELECT (c_custkey + 1) AS record_number, 'c' || c_custkey || '@example.com' AS email, regexp_extract(replace(c_name, '#', ' '), '^([^ ]*)', 1) AS first_name, regexp_extract(replace(c_name, '#', ' '), ' (.*)$', 1) AS last_name, CAST(c_custkey % 2 = 0 AS VARCHAR) AS email_verified, 'uid' || c_custkey AS external_id, CASE WHEN c_custkey % 3 = 0 THEN '$firebase-scrypt$hash=aGFz+/$salt=c2Fs$sk=key+/1$ss=Bw==$r=8$m=14' END AS password_hash FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 5 <> 0")
def q42_firebase_users(spark, sf_dir):
    made = transforms.firebase(_firebase_users(spark, sf_dir), scrypt=SCRYPT)
    return made.where("skip_reason is null").select("record_number", "email", "first_name", "last_name", "email_verified", "external_id", "password_hash")


@query("SELECT k AS group_id, array_to_string(list_slice(list(rn ORDER BY rn), 1, 3), ',') AS records FROM (SELECT *, substr(md5(coalesce(error_type, 'unknown') || '-' || coalesce(CAST(status AS VARCHAR), 'none') || '-' || pattern), 1, 12) AS k FROM classed) GROUP BY 1", ERRORS_SQL, CLASSED_SQL)
def q43_error_examples(spark, sf_dir):
    return analyze.examples(errors(spark, sf_dir)).select("group_id", F.array_join(F.transform("records", lambda x: x.cast("string")), ",").alias("records"))


@query("SELECT group_id, array_to_string(list_slice(list(email ORDER BY pos), 1, 10), ',') AS emails FROM (SELECT k AS group_id, email, min(rn) AS pos FROM (SELECT *, substr(md5(coalesce(error_type, 'unknown') || '-' || coalesce(CAST(status AS VARCHAR), 'none') || '-' || pattern), 1, 12) AS k FROM classed) WHERE email IS NOT NULL GROUP BY 1, 2) GROUP BY 1", ERRORS_SQL, CLASSED_SQL)
def q44_affected_emails(spark, sf_dir):
    return analyze.affected_emails(errors(spark, sf_dir)).select("group_id", F.array_join("emails", ",").alias("emails"))
