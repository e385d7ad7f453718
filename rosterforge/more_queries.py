"""More of the engine's operators as queries: fixes, exports of other services, role definitions, secrets, names and metadata. See queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import jsons, text
from .operators import joins, ordering, transforms, validate
from .operators.mapping import AUTH0, apply_profile
from .queries import USERS_SQL, query, table, users

NAME_SQL = "CASE c_custkey % 3 WHEN 0 THEN '  First' || c_custkey || '   van  der Last' WHEN 1 THEN 'Only' || c_custkey ELSE ' A B ' END"


def _customers(spark, sf_dir):
    k = F.col("c_custkey")
    t = k.cast("string")
    name = F.when(k % 3 == 0, F.concat(F.lit("  First"), t, F.lit("   van  der Last"))).when(k % 3 == 1, F.concat(F.lit("Only"), t)).otherwise(" A B ")
    return table(spark, sf_dir, "customer").select((k + 1).alias("record_number"), k.alias("k"), t.alias("t"), name.alias("name"))


@query(f"SELECT c_custkey AS k, regexp_extract(trim({NAME_SQL}), '^\\S+') AS first_token, regexp_replace(regexp_replace(trim({NAME_SQL}), '^\\S+\\s*', ''), '\\s+', ' ', 'g') AS others FROM customer")
def q45_name_tokens(spark, sf_dir):
    return _customers(spark, sf_dir).select("k", text.first_token(F.col("name")).alias("first_token"), text.other_tokens(F.col("name")).alias("others"))


@query("SELECT c_custkey AS k, 'dry-run-user-a' || c_custkey || '@x.example' AS dry_user, 'org_dryrun_e' || c_custkey AS dry_org, 'A' || c_custkey || '+run7@X.example' AS email, 'id' || c_custkey || '_run7' AS external_id FROM customer")
def q46_fixture_ids(spark, sf_dir):
    email = F.concat(F.lit("A"), F.col("t"), F.lit("@X.example"))
    return _customers(spark, sf_dir).select(
        "k", text.dry_run_user(F.concat(F.lit(" "), email)).alias("dry_user"), text.dry_run_org(F.concat(F.lit("e"), F.col("t"))).alias("dry_org"), text.unique_suffix(email, "run7").alias("email"), text.unique_suffix(F.concat(F.lit("id"), F.col("t")), "run7").alias("external_id")
    )


@query("SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'bad_email: no domain; weak: ' || c_custkey WHEN 1 THEN 'unknown: said ' || c_custkey ELSE 'outer_code' END AS message FROM customer")
def q47_api_error_texts(spark, sf_dir):
    entry = lambda code, message: F.struct(F.lit(code).cast("string").alias("code"), message.alias("message"))
    t = F.col("t")
    found = F.when(F.col("k") % 3 == 0, F.array(entry("bad_email", F.lit("no domain")), entry("weak", t))).when(F.col("k") % 3 == 1, F.array(entry(None, F.concat(F.lit("said "), t))))
    return _customers(spark, sf_dir).select("k", text.api_error_text(F.lit("outer_code"), found).alias("message"))


@query("SELECT record_number, trim(email) AS email FROM users", USERS_SQL)
def q48_emails_fixed(spark, sf_dir):
    return validate.fix_rows(users(spark, sf_dir), [validate.rule_by_id("email-whitespace")]).select("record_number", "email")


FIXED_SQL = """
fixed AS (SELECT record_number, trim(email) = '' OR email NOT LIKE '%@%' OR (org_id IS NOT NULL AND org_external_id IS NOT NULL) OR role_slugs = 'Bad Role,member' OR (password_hash IS NOT NULL AND password_hash_type IS NULL) AS wrong,
  email <> trim(email) OR email_verified = 'maybe' AS clears, role_slugs = '' AS warned, (email <> trim(email))::INTEGER + (email_verified IN ('yes', '1', 'no', 'maybe'))::INTEGER AS n_fixes FROM users),
graded AS (SELECT record_number, CASE WHEN wrong THEN 'invalid' WHEN warned AND NOT clears THEN 'warning' ELSE 'valid' END AS status, n_fixes FROM fixed)"""


@query("SELECT record_number, status, n_fixes FROM graded", USERS_SQL, FIXED_SQL)
def q49_auto_fixed_rows(spark, sf_dir):
    return validate.validate(users(spark, sf_dir), auto_fix=True).select("record_number", "status", "n_fixes")


@query("SELECT status, count(*) AS rows, CAST(sum(n_fixes) AS BIGINT) AS fixes FROM graded GROUP BY 1", USERS_SQL, FIXED_SQL)
def q50_fixes_by_status(spark, sf_dir):
    return validate.validate(users(spark, sf_dir), auto_fix=True).groupBy("status").agg(F.count("*").alias("rows"), F.sum("n_fixes").cast("long").alias("fixes"))


def _metadata(spark, sf_dir):
    k, t = F.col("k"), F.col("t")
    made = F.when(k % 4 == 0, F.concat(F.lit('{"a":'), t, F.lit("}"))).when(k % 4 == 1, F.concat(F.lit('{"a":['), t, F.lit('],"b":{"c":2},"d":"x"}'))).when(k % 4 == 2, F.concat(F.lit("{bad"), t)).otherwise("")
    return _customers(spark, sf_dir).select("record_number", "k", F.concat(F.lit("c"), t, F.lit("@x.example")).alias("email"), made.alias("metadata"))


@query("SELECT c_custkey + 1 AS record_number, CASE c_custkey % 4 WHEN 1 THEN 'metadata-arrays-objects' ELSE 'metadata-json' END AS rule_id, CASE c_custkey % 4 WHEN 1 THEN 'warning' ELSE 'error' END AS severity FROM customer, (VALUES (1), (2)) fields(n) WHERE c_custkey % 4 = 1 OR (c_custkey % 4 = 2 AND n = 1)")
def q51_metadata_issues(spark, sf_dir):
    return validate.row_issues(validate.check_rows(_metadata(spark, sf_dir))).select("record_number", "rule_id", "severity")


@query("""SELECT c_custkey + 1 AS record_number, CASE c_custkey % 4 WHEN 0 THEN '{"a":' || c_custkey || '}' WHEN 1 THEN '{"a":"[' || c_custkey || ']","b":"{\\"c\\":2}","d":"x"}' WHEN 2 THEN '{bad' || c_custkey ELSE '' END AS metadata FROM customer""")
def q52_metadata_fixed(spark, sf_dir):
    return validate.fix_rows(_metadata(spark, sf_dir), [validate.rule_by_id("metadata-arrays-objects")]).select("record_number", "metadata")


@query("""SELECT c_custkey + 1 AS record_number, 'c' || c_custkey || '@x.example' AS email, CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END AS email_verified, 'auth0|' || c_custkey AS external_id, CASE WHEN c_custkey % 5 = 0 THEN 'org' || c_custkey END AS org_external_id,
  '{"_provider":"auth0","auth0_k":"' || (c_custkey % 3) || CASE WHEN c_custkey % 2 = 0 THEN '","auth0_plan":"p"}' ELSE '","auth0_app_metadata":"note"}' END AS metadata FROM customer""")
def q53_built_in_profile(spark, sf_dir):
    k, t = F.col("k"), F.col("t")
    rows = _customers(spark, sf_dir).select(
        "record_number", F.concat(F.lit(" C"), t, F.lit("@X.example")).alias("email"), F.when(k % 2 == 0, "yes").otherwise("0").alias("email_verified"), F.concat(F.lit("auth0|"), t).alias("user_id"),
        F.when(k % 5 == 0, F.concat(F.lit("org"), t)).otherwise(" ").alias("org_id"), F.concat(F.lit('{"k":"'), (k % 3).cast("string"), F.lit('"}')).alias("user_metadata"), F.when(k % 2 == 0, '{"plan":"p"}').otherwise("note").alias("app_metadata"),
    )
    return apply_profile(rows, AUTH0).select("record_number", "email", "email_verified", "external_id", "org_external_id", "metadata")


def _clerk(spark, sf_dir):
    k, t = F.col("k"), F.col("t")
    return transforms.clerk(_customers(spark, sf_dir).select(
        "record_number", F.when(k % 6 == 0, " ").otherwise(F.concat(F.lit("c"), t, F.lit("@x.example"))).alias("primary_email_address"), F.concat(F.lit("user"), t).alias("id"), F.lit("F").alias("first_name"), F.lit("").alias("last_name"),
        F.when(k % 2 == 0, F.concat(F.lit("n"), t)).alias("username"), F.when(k % 3 == 0, "$2a$x").when(k % 3 == 1, "zz").alias("password_digest"), F.when(k % 3 == 0, "bcrypt").when(k % 3 == 1, "argon").alias("password_hasher"),
    ))


@query("""SELECT c_custkey + 1 AS record_number, CASE WHEN c_custkey % 6 <> 0 THEN 'c' || c_custkey || '@x.example' END AS email, 'F' AS first_name, CAST(NULL AS VARCHAR) AS last_name, 'user' || c_custkey AS external_id, CASE WHEN c_custkey % 3 = 0 THEN '$2a$x' END AS password_hash,
  CASE WHEN c_custkey % 3 = 0 THEN 'bcrypt' END AS password_hash_type, '{"clerk_user_id":"user' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN '","username":"n' || c_custkey ELSE '' END || '"}' AS metadata, CASE WHEN c_custkey % 3 = 1 THEN 'unsupported password hasher argon' END AS warning FROM customer""")
def q54_clerk_users(spark, sf_dir):
    return _clerk(spark, sf_dir).select("record_number", "email", "first_name", "last_name", "external_id", "password_hash", "password_hash_type", "metadata", "warning")


@query("SELECT count(*) AS total_users, count(*) FILTER (c_custkey % 6 <> 0) AS transformed_users, count(*) FILTER (c_custkey % 6 = 0) AS skipped_users, count(*) FILTER (c_custkey % 6 <> 0 AND c_custkey % 3 = 0) AS with_password, count(*) FILTER (c_custkey % 6 <> 0 AND c_custkey % 3 <> 0) AS without_password FROM customer")
def q55_transform_summary(spark, sf_dir):
    return transforms.transform_summary(_clerk(spark, sf_dir))


@query("""SELECT c_custkey + 1 AS record_number, CASE WHEN c_custkey % 2 = 0 THEN 'G' ELSE regexp_extract(trim(n), '^\\S+') END AS first_name, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE regexp_replace(regexp_replace(trim(n), '^\\S+\\s*', ''), '\\s+', ' ', 'g') END AS last_name,
  'org' || (c_custkey % 9) AS org_external_id, CASE WHEN c_custkey % 5 = 0 THEN 'Shown' ELSE 'name' || (c_custkey % 9) END AS org_name, CASE c_custkey % 3 WHEN 0 THEN 'bcrypt' WHEN 1 THEN 'auth0' END AS password_hash_type,
  '{"auth0_org_id":"old","theme":"t' || c_custkey || '","auth0_user_id":"auth0|' || c_custkey || '","auth0_created_at":"2024-01-01","auth0_updated_at":"","auth0_logins_count":"' || c_custkey || '"}' AS metadata,
  CASE c_custkey % 7 WHEN 0 THEN 'Missing required field: email' WHEN 1 THEN 'Invalid email format: c' || c_custkey END AS skip_reason FROM (SELECT *, """ + NAME_SQL + " AS n FROM customer)")
def q56_auth0_users(spark, sf_dir):
    k, t = F.col("k"), F.col("t")
    rows = _customers(spark, sf_dir).select(
        "record_number", F.when(k % 7 == 0, " ").when(k % 7 == 1, F.concat(F.lit("c"), t)).otherwise(F.concat(F.lit("c"), t, F.lit("@x.example"))).alias("email"), "name", F.when(k % 2 == 0, "G").otherwise("").alias("given_name"),
        F.lit(None).cast("string").alias("family_name"), F.lit(True).alias("email_verified"), F.concat(F.lit("auth0|"), t).alias("user_id"), F.lit("2024-01-01").alias("created_at"), F.lit(None).cast("string").alias("updated_at"), F.lit("").alias("last_login"),
        k.alias("logins_count"), F.lit('{"org_id":"old","theme":"x"}').alias("user_metadata"), F.concat(F.lit('{"theme":"t'), t, F.lit('"}')).alias("app_metadata"), F.concat(F.lit("org"), (k % 9).cast("string")).alias("org_id"),
        F.concat(F.lit("name"), (k % 9).cast("string")).alias("org_name"), F.when(k % 5 == 0, "Shown").alias("org_display_name"), F.when(k % 3 == 0, "BCRYPT_10").when(k % 3 == 1, "scrypt").alias("algorithm"), F.lit("h").alias("hash"),
    )
    return transforms.auth0(rows).select("record_number", "first_name", "last_name", "org_external_id", "org_name", "password_hash_type", "metadata", "skip_reason")


@query("SELECT count(*) FILTER (c_custkey % 7 > 1) AS users_exported, count(*) FILTER (c_custkey % 7 <= 1) AS users_skipped, count(DISTINCT c_custkey % 9) AS organizations FROM customer")
def q57_export_summary(spark, sf_dir):
    k = F.col("k")
    return joins.export_summary(_customers(spark, sf_dir).select(F.when(k % 7 == 0, "a").when(k % 7 == 1, "b").alias("skip_reason"), (k % 9).alias("org_external_id")))


ROLES_SQL = """
d AS (SELECT p_partkey AS rn, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE 'role-' || (p_partkey % 20) END AS slug, CASE WHEN p_partkey % 13 = 0 THEN '' ELSE 'Role' END AS name, CASE p_partkey % 4 WHEN 0 THEN 'environment' WHEN 3 THEN 'other' ELSE 'organization' END AS kind,
  CASE WHEN p_partkey % 4 = 1 THEN 'org_' || (p_partkey % 3) END AS org_id, CASE WHEN p_partkey % 3 = 0 THEN '["a:read","b-c"]' ELSE 'a:read, p' || (p_partkey % 5) END AS permissions FROM part),
checked AS (SELECT *, CASE WHEN slug = '' THEN 'missing role_slug' WHEN name = '' THEN 'missing role_name' END AS error, CASE WHEN kind = 'other' THEN 'unknown role_type' WHEN kind = 'organization' AND org_id IS NULL THEN 'organization role without an organization' END AS warning FROM d),
scoped AS (SELECT *, min(rn) OVER (PARTITION BY slug, org_id) AS first FROM checked WHERE error IS NULL AND warning IS NULL),
kept AS (SELECT *, CASE WHEN rn % 3 = 0 THEN ['a:read', 'b-c'] ELSE ['a:read', 'p' || (rn % 5)] END AS list FROM scoped WHERE rn = first)"""


def _definitions(spark, sf_dir):
    k = F.col("p_partkey")
    cat = lambda s, m: F.concat(F.lit(s), (k % m).cast("string"))
    return joins.parse_role_definitions(table(spark, sf_dir, "part").select(
        k.alias("record_number"), F.when(k % 11 != 0, cat("role-", 20)).otherwise(" ").alias("role_slug"), F.when(k % 13 != 0, "Role").alias("role_name"), F.when(k % 4 == 0, "environment").when(k % 4 == 3, "other").otherwise("organization").alias("role_type"),
        F.when(k % 4 == 1, cat("org_", 3)).alias("org_id"), F.when(k % 3 == 0, '["a:read","b-c"]').otherwise(cat("a:read, p", 5)).alias("permissions"),
    ))


@query("SELECT rn AS record_number, slug, kind AS type, org_id, array_to_string(list, ',') AS permissions FROM kept", ROLES_SQL)
def q58_role_definitions(spark, sf_dir):
    return _definitions(spark, sf_dir)[0].select("record_number", "slug", "type", "org_id", F.array_join("permissions", ",").alias("permissions"))


@query("SELECT rn AS record_number, 'error' AS level, error AS message FROM checked WHERE error IS NOT NULL UNION ALL SELECT rn, 'warning', warning FROM checked WHERE error IS NULL AND warning IS NOT NULL UNION ALL SELECT rn, 'warning', 'repeats the definition of row ' || first FROM scoped WHERE rn <> first", ROLES_SQL)
def q59_role_problems(spark, sf_dir):
    return _definitions(spark, sf_dir)[1].select("record_number", "level", "message")


@query("SELECT DISTINCT p AS slug, CASE WHEN p = 'a:read' THEN 'A Read' WHEN p = 'b-c' THEN 'B C' ELSE upper(p) END AS name FROM (SELECT unnest(list) AS p FROM kept)", ROLES_SQL)
def q60_distinct_permissions(spark, sf_dir):
    return joins.distinct_permissions(_definitions(spark, sf_dir)[0])


@query("SELECT count(*) AS total, count(*) FILTER (kind <> 'environment') AS created, count(*) FILTER (kind = 'environment') AS exists, CAST(0 AS BIGINT) AS skipped, CAST(0 AS BIGINT) AS error, count(*) FILTER (kind = 'environment' AND list <> ['a:read', 'b-c']) AS mismatched FROM kept", ROLES_SQL)
def q61_role_summary(spark, sf_dir):
    definitions = _definitions(spark, sf_dir)[0]
    existing = spark.range(20).select(F.concat(F.lit("role-"), F.col("id").cast("string")).alias("slug"), F.lit(None).cast("string").alias("org_id"), F.array(F.lit("b-c"), F.lit("a:read")).alias("permissions"))
    return joins.role_summary(joins.process_roles(definitions, existing))


@query("SELECT count(*) AS total_rows, count(*) FILTER (record_number % 3 <> 0) AS valid_rows, count(DISTINCT external_id) FILTER (record_number % 3 <> 0) AS users, count(DISTINCT event_type) FILTER (record_number % 3 <> 0) AS roles FROM users", USERS_SQL)
def q62_role_mapping_summary(spark, sf_dir):
    return joins.role_mapping_summary(users(spark, sf_dir).select("record_number", "external_id", F.when(F.col("record_number") % 3 != 0, F.col("event_type")).otherwise(" ").alias("role_slug")))


TOTP_SQL = "planned AS (SELECT c_custkey + 1 AS record_number, 'c' || c_custkey || '@x.example' AS email_key, 's' || c_custkey AS secret, CASE WHEN c_custkey % 2 = 0 THEN 'u' || c_custkey END AS user_id FROM customer WHERE c_custkey % 5 <> 0)"


def _totp(spark, sf_dir):
    rows, k, t = _customers(spark, sf_dir), F.col("k"), F.col("t")
    email = F.concat(F.lit(" C"), t, F.lit("@x.example"))
    records = joins.totp_from_csv(rows.select("record_number", email.alias("email"), F.when(k % 5 != 0, F.concat(F.lit("s"), t)).otherwise("").alias("totp_secret")))
    return joins.plan_totp(records, rows.where(k % 2 == 0).select(F.concat(F.lit("u"), t).alias("id"), email.alias("email")))


@query("SELECT *, CASE WHEN user_id IS NULL THEN 'user_not_found' ELSE 'enroll' END AS outcome FROM planned", TOTP_SQL)
def q63_totp_plan(spark, sf_dir):
    return _totp(spark, sf_dir)


@query(
    """SELECT count(*) AS total, count(*) FILTER (o = 'enrolled') AS enrolled, count(*) FILTER (o = 'skipped') AS skipped, count(*) FILTER (o IN ('failed', 'user_not_found')) AS failures, count(*) FILTER (o = 'user_not_found') AS user_not_found FROM
  (SELECT CASE WHEN user_id IS NULL THEN 'user_not_found' WHEN record_number % 5 = 0 THEN 'skipped' WHEN record_number % 5 = 1 THEN 'failed' ELSE 'enrolled' END AS o FROM planned)""",
    TOTP_SQL,
)
def q64_totp_summary(spark, sf_dir):
    r, planned = F.col("record_number") % 5, F.col("outcome") == "enroll"
    came_of_it = F.when(~planned, F.col("outcome")).when(r == 0, "skipped").when(r == 1, "failed").otherwise("enrolled")
    return joins.totp_summary(_totp(spark, sf_dir).withColumn("outcome", came_of_it))


@query("""SELECT c_custkey + 1 AS record_number, CASE c_custkey % 4 WHEN 0 THEN '{"a":' || c_custkey || '}' WHEN 1 THEN '{"a":[' || c_custkey || '],"b":{"c":2},"d":"x"}' WHEN 2 THEN '"{bad' || c_custkey || '"' END AS json FROM customer""")
def q65_json_texts(spark, sf_dir):
    return _metadata(spark, sf_dir).select("record_number", jsons.to_json_string(F.col("metadata")).alias("json"))


@query("""SELECT c_custkey + 1 AS record_number, CASE c_custkey % 4 WHEN 0 THEN '{"a":"' || c_custkey || '"}' WHEN 1 THEN '{"a":"[' || c_custkey || ']","b":"{\\"c\\":2}","d":"x"}' END AS metadata FROM customer""")
def q66_loader_metadata(spark, sf_dir):
    return _metadata(spark, sf_dir).select("record_number", jsons.object_or_null(jsons.flattened(F.col("metadata"))).alias("metadata"))


@query("""SELECT c_custkey AS k, '{"a":"' || CASE WHEN c_custkey % 2 = 0 THEN '2' ELSE '1' END || '","b":"x"' || CASE WHEN c_custkey % 2 = 0 THEN ',"c":"y"' ELSE '' END || '}' AS merged FROM customer""")
def q67_merged_maps(spark, sf_dir):
    pairs = lambda *kv: F.create_map(*[F.lit(x) for x in kv])
    right = F.when(F.col("k") % 2 == 0, pairs("c", "y", "a", "2"))
    return _customers(spark, sf_dir).select("k", F.to_json(jsons.merged(pairs("a", "1", "b", "x"), right)).alias("merged"))


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS record_number FROM events")
def q68_numbered_rows(spark, sf_dir):
    return ordering.number_by(table(spark, sf_dir, "events").select("ts", "event_id"), "ts", "event_id").select("event_id", "record_number")
