"""Queries whose operators act on something outside of one plan: row sinks, streams with state, ledgers and stores. Each works on the whole tables, by way of tables of its own in the shared folder. See queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .operators import dedupe, error_store, load
from .queries import BOOL_SQL, CLASSED_SQL, COUNTERS_SQL, EMAIL_SQL, ERRORS_SQL, GROUPS_SQL, OUTCOME_SQL, TYPED_SQL, USERS_SQL, errors, orgs, query, typed_users, users
from .sinks import rest
from .sinks.calls import shared_folder
from .streaming import incremental, loads


@query(
    f"""SELECT * FROM (SELECT email_key, field, value, min(record_number) AS at, strategy, count(*) OVER (PARTITION BY email_key, field) AS n FROM (
    {' UNION ALL '.join(f"SELECT {EMAIL_SQL} AS email_key, record_number, '{c}' AS field, nullif(trim({c}), '') AS value, 'first-non-empty' AS strategy FROM typed" for c in dedupe.FILLED)}
    UNION ALL SELECT {EMAIL_SQL}, record_number, 'email_verified', CAST({BOOL_SQL} AS VARCHAR), 'true-if-any' FROM typed
    UNION ALL SELECT e.email_key, e.record_number, 'metadata.' || e.key, e.value, 'first-occurrence' FROM entries e
      JOIN (SELECT email_key, key, min(record_number) AS begin FROM entries WHERE value NOT IN ('null', 'false', '""', '0') GROUP BY ALL) s ON s.email_key = e.email_key AND s.key = e.key AND e.record_number >= s.begin)
  WHERE value IS NOT NULL AND email_key IS NOT NULL GROUP BY email_key, field, value, strategy) WHERE n > 1""",
    USERS_SQL, TYPED_SQL,
)
def q70_conflict_values(spark, sf_dir):
    return dedupe.conflict_values(typed_users(spark, sf_dir)).withColumn("n", F.count("*").over(Window.partitionBy("email_key", "field")))


@query("SELECT record_number, email_key, 'dry-run-user-' || email_key AS user_id, user_outcome, membership_outcome, CASE WHEN membership_outcome = 'duplicate' THEN 409 WHEN membership_outcome = 'created' OR user_outcome = 'created' THEN 201 ELSE 200 END AS http_status FROM outcomes WHERE error_type IS NULL", USERS_SQL, OUTCOME_SQL)
def q71_row_sink(spark, sf_dir):
    rows = load.prepared(users(spark, sf_dir), orgs(spark, sf_dir)).where(F.col("error_type").isNull()).select("record_number", F.col("email_key").alias("email"), "org", F.array(F.lit("member")).alias("roles"))
    return rest.load(rows, rest.DryService(), rate=1e9).select("record_number", "email_key", "user_id", "user_outcome", "membership_outcome", "http_status")


@query("SELECT record_number, email_key, org, error_type, user_outcome, membership_outcome, CAST(roles_assigned AS INTEGER) AS roles_assigned FROM outcomes", USERS_SQL, OUTCOME_SQL)
def q72_stream_outcomes(spark, sf_dir):
    """The rows arrive in five parts, in the order of their numbers; after each the query ends, and the next one goes on with its state."""
    folder, rows = shared_folder(spark, "stream"), users(spark, sf_dir)
    last = rows.agg(F.max("record_number")).first()[0] or 0
    for k in range(5):
        rows.where(F.col("record_number").between(k * last // 5 + 1, (k + 1) * last // 5)).write.mode("append").parquet(f"{folder}/in")
        stream = incremental.stream_users(spark, f"{folder}/in", rows.schema, files_each=1 << 30)
        loads.load_stream(stream, f"{folder}/out", f"{folder}/checkpoint", orgs(spark, sf_dir)).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("record_number", "email_key", "org", "error_type", "user_outcome", "membership_outcome", "roles_assigned")


CHUNK_OUTCOME_SQL = OUTCOME_SQL.replace("PARTITION BY email_key", "PARTITION BY (record_number - 1) // 500, email_key")


@query(f"SELECT CAST((record_number - 1) // 500 AS INTEGER) AS chunk_id, {COUNTERS_SQL}, CAST(1 AS BIGINT) AS runs FROM outcomes GROUP BY 1", USERS_SQL, CHUNK_OUTCOME_SQL)
def q73_chunk_ledger(spark, sf_dir):
    """The first run is broken off after some waves; the second one goes on."""
    folder, rows, waves = shared_folder(spark, "ledger"), users(spark, sf_dir), []

    def make(part):
        waves.append(1)
        if len(waves) == 3:
            raise InterruptedError
        return load.outcomes(part, orgs(spark, sf_dir), chunk_size=500)

    for _ in range(2):
        try:
            made = incremental.process_chunks(rows, 500, folder, make, wave=50)
        except InterruptedError:
            continue
    return made.select("chunk_id", *load.counters(), "runs")


@query("SELECT group_id, pattern, error_type, status, n, severity, retryable, first_record FROM graded", ERRORS_SQL, CLASSED_SQL, GROUPS_SQL)
def q74_error_store(spark, sf_dir):
    """The errors as three logs, one after the other."""
    folder, rows = shared_folder(spark, "errors"), errors(spark, sf_dir)
    last = rows.agg(F.max("recordNumber")).first()[0] or 0
    for k in range(3):
        error_store.add_log(rows.where(F.col("recordNumber").between(k * last // 3 + 1, (k + 1) * last // 3)), folder, "recordNumber")
    made = error_store.groups(spark, folder)
    return made.select("group_id", "pattern", F.col("errorType").alias("error_type"), F.col("httpStatus").alias("status"), F.col("count").alias("n"), "severity", "retryable", "first_record")
