"""Analysis of load errors: patterns, classes, groups, suggestions and the rows to retry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..schema import KNOWN_COLUMNS

#: Report lists: errors shown of a group, emails shown of a group.
EXAMPLES, EMAILS = 3, 10


def _status(low: int, high: int | None = None) -> Column:
    s = F.coalesce("httpStatus", F.lit(0))
    return (s >= low) & (s < high) if high else s >= low


#: What classify() and with_groups() add.
CLASSES, GROUPED = ("retry_reason", "retryable", "retry_type", "retry_delay_ms"), ("pattern", "group_id")


def classify(df: DataFrame) -> DataFrame:
    """df with retryable, retry_reason, retry_type and retry_delay_ms. The first case that fits decides: a rate limit, then what the error's type tells, then the status alone. Errors that have all these columns stay as they are."""
    if set(CLASSES) <= set(df.columns):
        return df
    kind, status = F.col("errorType"), F.coalesce("httpStatus", F.lit(0))
    org, user = kind == "org_resolution", kind == "user_create"
    member = (kind == "membership_create") & (F.coalesce("userId", F.lit("")) != "")
    cases = [
        (status == 429, "rate_limit"), (org & F.lower("errorMessage").contains("not found"), "org_not_found"), (org & ((status == 0) | _status(500)), "org_lookup_error"), (org, "org_resolution_error"),
        (member & (status == 409), "membership_duplicate"), (member & _status(500), "membership_error_user_exists"), (member & _status(400, 500), "membership_validation_error"),
        (user & _status(500), "user_create_server_error"), (user & _status(400, 500), "user_create_validation_error"),
        (_status(500), "server_error"), (status == 409, "conflict_duplicate"), (status.isin(400, 422), "validation_error"), (status == 0, "unknown_error"),
    ]
    reason = F.lit("unknown_non_retryable")
    for condition, name in reversed(cases):
        reason = F.when(condition, name).otherwise(reason)
    again = F.col("retry_reason").isin("rate_limit", "org_lookup_error", "membership_error_user_exists", "user_create_server_error", "server_error", "unknown_error")
    limited = F.col("retry_reason") == "rate_limit"
    return (
        df.withColumn("retry_reason", reason)
        .withColumn("retryable", again)
        .withColumns({"retry_type": F.when(limited, "with_backoff").when(again, "immediate"), "retry_delay_ms": F.when(limited, 5000)})
    )


def retry_description(kind: Column, delay_ms: Column) -> Column:
    return F.when(kind == "immediate", "Retry immediately").when(kind == "with_backoff", F.concat(F.lit("Retry with backoff, first after "), delay_ms.cast("string"), F.lit(" ms"))).otherwise("After a fix")


def group_id(pattern: Column, kind: Column, status: Column) -> Column:
    """12 hex digits of a digest of type, status and pattern."""
    known = F.when(F.coalesce(status, F.lit(0)) == 0, "none").otherwise(status.cast("string"))
    return F.substring(F.md5(F.concat_ws("-", F.coalesce(F.nullif(kind, F.lit("")), F.lit("unknown")), known, pattern)), 1, 12)


def severity(kind: Column, status: Column, retryable: Column) -> Column:
    s = F.coalesce(status, F.lit(0))
    return F.when(~retryable & s.isin(400, 422), "critical").when(kind == "org_resolution", "critical").when(s == 409, "high").when(s >= 500, "medium").otherwise("low")


def with_groups(df: DataFrame) -> DataFrame:
    """Classified errors with pattern and group_id; those that have them all stay as they are."""
    if {*CLASSES, *GROUPED} <= set(df.columns):
        return df
    return classify(df).withColumn("pattern", text.message_pattern(F.col("errorMessage"))).withColumn("group_id", group_id(F.col("pattern"), F.col("errorType"), F.col("httpStatus")))


def groups(df: DataFrame, order: str = "recordNumber") -> DataFrame:
    """One row per kind of error: group_id, pattern, errorType, httpStatus, count, severity, retryable and retry_type of its first error, first_record.

    Nothing is listed, so a group may hold any share of the errors.
    """
    first = F.min(F.struct(F.col(order).alias("at"), "retryable", "retry_type", "retry_delay_ms"))
    made = with_groups(df).groupBy("group_id").agg(F.first("pattern").alias("pattern"), F.first("errorType").alias("errorType"), F.first("httpStatus").alias("httpStatus"), F.count("*").alias("count"), first.alias("first"))
    level = severity(F.col("errorType"), F.col("httpStatus"), F.col("first.retryable"))
    return made.select("group_id", "pattern", "errorType", "httpStatus", "count", level.alias("severity"), F.col("first.retryable").alias("retryable"), F.col("first.retry_type").alias("retry_type"), F.col("first.at").alias("first_record"))


def severity_rank(c: Column) -> Column:
    return F.when(c == "critical", 0).when(c == "high", 1).when(c == "medium", 2).otherwise(3)


def top_groups(made: DataFrame, k: int = 5) -> DataFrame:
    """By severity, then count, then first occurrence."""
    return made.orderBy(severity_rank(F.col("severity")), F.desc("count"), "first_record").limit(k)


def _first_of_each(rows: DataFrame, most: int) -> DataFrame:
    """The rows of each group that come first by `at`. Spark keeps `most` rows of a group in each task before the shuffle, as the rank is compared with a constant."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy("group_id").orderBy("at"))).where(F.col("__n") <= most).drop("__n")


def examples(df: DataFrame, order: str = "recordNumber", most: int = EXAMPLES) -> DataFrame:
    """(group_id, records): the first errors of each group. Tasks pass on the first ones of each group only, before errors are dealt out."""
    first = _first_of_each(with_groups(df).select("group_id", F.col(order).alias("at")), most)
    return first.groupBy("group_id").agg(F.array_sort(F.collect_list("at")).alias("records"))


def first_emails(df: DataFrame, order: str = "recordNumber", most: int = EMAILS) -> DataFrame:
    """(group_id, email, at) of the first distinct emails of each group."""
    firsts = with_groups(df).where(F.coalesce("email", F.lit("")) != "").groupBy("group_id", "email").agg(F.min(order).alias("at"))
    return _first_of_each(firsts, most)


def affected_emails(df: DataFrame, order: str = "recordNumber", most: int = EMAILS) -> DataFrame:
    """(group_id, emails): the first distinct emails of each group."""
    chosen = first_emails(df, order, most).groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("at", "email"))).alias("first"))
    return chosen.select("group_id", F.transform("first", lambda x: x["email"]).alias("emails"))


#: code, whether the one who loads can act on it, and what to do.
ADVICE = (
    ("invalid_email", True, "Correct the email addresses; each needs the form name@domain"),
    ("missing_field", True, "Fill the required fields; the validation report lists the rows"),
    ("duplicate_user", True, "These users exist already; leave the rows out"),
    ("duplicate_membership", True, "These memberships exist already; keep one row per user and organization"),
    ("org_not_found", True, "Check the organization ids, or give org_name so that missing ones are created"),
    ("invalid_json", True, "Correct the JSON in the metadata column"),
    ("hash_without_type", True, "Add password_hash_type to the rows with password_hash"),
    ("rate_limit", False, "Load with lower concurrency and retry"),
    ("server_error", False, "Wait a few minutes and load the retry set"),
    ("validation_error", True, "Read the error message and correct the data"),
)


def suggestion_code(pattern: Column, kind: Column, status: Column) -> Column:
    """The code of the first advice that fits a group; null if none does."""
    p, s = F.lower(pattern), F.coalesce(status, F.lit(0))
    return (
        F.when(p.contains("invalid email") | p.contains("email format"), "invalid_email").when(p.contains("missing required") | p.contains("required field"), "missing_field")
        .when((s == 409) & (kind == "user_create"), "duplicate_user").when((s == 409) & (kind == "membership_create"), "duplicate_membership")
        .when((kind == "org_resolution") & p.contains("not found"), "org_not_found").when(p.contains("json"), "invalid_json").when(p.contains("password_hash") & p.contains("type"), "hash_without_type")
        .when(s == 429, "rate_limit").when(s >= 500, "server_error").when(s.isin(400, 422), "validation_error")
    )


def suggestions(made: DataFrame) -> DataFrame:
    """(group_id, severity, count, code, actionable, advice) of the groups that an advice fits."""
    known = made.sparkSession.createDataFrame(list(ADVICE), "code string, actionable boolean, advice string")
    coded = made.withColumn("code", suggestion_code(F.col("pattern"), F.col("errorType"), F.col("httpStatus")))
    return coded.join(F.broadcast(known), "code").select("group_id", "severity", F.col("count").alias("affected"), "code", "actionable", "advice")


def retryable_with_row(classified: DataFrame) -> Column:
    """Whether a retry has what it needs: the raw row and an email."""
    return F.col("retryable") & F.col("rawRow").isNotNull() & (F.coalesce("email", F.lit("")) != "")


def histogram(df: DataFrame) -> DataFrame:
    """(dimension, value, errors, percent) by type, status and reason, in one pass."""
    classified = classify(df)
    long = classified.select(
        F.explode(
            F.array(
                F.struct(F.lit("type").alias("dimension"), F.coalesce("errorType", F.lit("unknown")).alias("value")), F.struct(F.lit("status").alias("dimension"), F.coalesce(F.col("httpStatus").cast("string"), F.lit("none")).alias("value")),
                F.struct(F.when(F.col("retryable"), "retry_reason").otherwise("other_reason").alias("dimension"), F.col("retry_reason").alias("value")),
            )
        ).alias("x")
    ).select("x.*")
    return with_percent(long.groupBy("dimension", "value").agg(F.count("*").alias("errors")))


def with_percent(counts: DataFrame) -> DataFrame:
    """(dimension, value, errors, percent) of counts: a row for each type, status and reason."""
    # each error counts once for its type, once for its status and once for its reason
    all_errors = F.sum("errors").over(Window.partitionBy(F.when(F.col("dimension").isin("type", "status"), F.col("dimension")).otherwise("reason")))
    return counts.select("dimension", "value", "errors", F.round(F.col("errors") * 100.0 / all_errors, 6).alias("percent"))


def retryability(df: DataFrame) -> DataFrame:
    """One row: total, retryable (with all that a retry needs), non-retryable, their percentages (0 without errors), distinct emails."""
    c = classify(df)
    total = F.count("*")
    good, bad = F.count_if(retryable_with_row(c)), F.count_if(~F.col("retryable"))
    share = lambda x: F.when(total > 0, F.round(x * 100.0 / total, 6)).otherwise(0.0)
    return c.agg(total.alias("total_errors"), good.alias("retryable_errors"), bad.alias("non_retryable_errors"), share(good).alias("retryable_percent"), share(bad).alias("non_retryable_percent"), F.countDistinct(F.nullif("email", F.lit(""))).alias("affected_emails"))


def retry_set(df: DataFrame, order: str = "recordNumber", include_duplicates: bool = False) -> DataFrame:
    """The errors to retry: of each email (case apart) the first one, unless all are asked for."""
    c = classify(df)
    rows = c.where(retryable_with_row(c)).withColumn("email_key", F.lower("email"))
    if include_duplicates:
        return rows
    return rows.groupBy("email_key").agg(F.min_by(F.struct(*[F.col(x) for x in rows.columns if x != "email_key"]), order).alias("row")).select("row.*", "email_key")


def retry_columns(raw_keys: list[str]) -> list[str]:
    """The columns of a retry file: known ones in their order (but role_slugs, which is one of the others), then the others as they come."""
    known = [c for c in KNOWN_COLUMNS if c in raw_keys and c != "role_slugs"]
    return known + [c for c in raw_keys if c not in known]


def retry_table(again: DataFrame, order: str = "recordNumber", every: bool = False) -> tuple[DataFrame | None, list[str]]:
    """(rows of a retry file, columns that only other rows have) of retry_set(): the columns are those of the first row, known ones first, the others in its order; None without rows.

    every: the columns of all rows, others after those of the first row by where they come first. The names of columns are listed on the driver, the rows are not.
    """
    first = again.agg(F.min_by(F.map_keys("rawRow"), order).alias("keys")).first().keys
    if first is None:
        return None, []
    key = again.select(F.col(order).alias("at"), F.posexplode(F.map_keys("rawRow")).alias("place", "key"))
    others = key.where(~F.col("key").isin(list(first))).groupBy("key").agg(F.min(F.struct("at", "place")).alias("first")).orderBy("first").select("key").collect()
    more = [r.key for r in others]
    columns = retry_columns(list(first)) + (more if every else [])
    return again.select(*[F.col("rawRow")[c].alias(c) for c in columns]), more
