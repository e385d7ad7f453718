"""Validation and auto-fix of user rows: a registry of rules, each a Column, all worked out in one pass over the rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsons, text
from ..schema import BAD_EMAIL, EMPTY_ROLES, HASH_WITHOUT_TYPE, ISSUE, ISSUES, KNOWN_COLUMNS, MISSING_EMAIL, RECORD, detect_mode, with_known_columns

Present = set[str]


@dataclass(frozen=True)
class Rule:
    """issues: of the columns present, an array of ISSUE structs (null or empty for a good row). fix: of the columns present, {column: new value}; a null value leaves the cell as it is."""

    id: str
    severity: str
    category: str
    issues: Callable[[Present], Column] | None = None
    fix: Callable[[Present], dict[str, Column]] | None = None


def _issue(rule: str, severity: str, message: Column | str, field: str | None = None, **more: Column) -> Column:
    known = {"severity": F.lit(severity), "category": F.lit("row"), "field": F.lit(field), "email": F.coalesce("email", F.lit("")), "message": F.lit(message) if isinstance(message, str) else message, "rule_id": F.lit(rule), **more}
    return F.struct(*[known.get(f, F.lit(None)).cast("string").alias(f) for f in ISSUE])


def _when(condition: Column, issue: Column) -> Column:
    return F.when(condition, F.array(issue))


def _required_email(_: Present) -> Column:
    return _when(text.is_blank(F.col("email")), _issue("required-email", "error", MISSING_EMAIL, "email", email=F.lit(None)))


def _email_format(_: Present) -> Column:
    clean = text.filled(F.col("email"))
    return _when(clean.isNotNull() & ~clean.contains("@"), _issue("email-format", "error", F.concat(F.lit(BAD_EMAIL), clean), "email", email=clean))


def _email_whitespace(_: Present) -> Column:
    raw, clean = F.col("email"), text.trimmed(F.col("email"))
    return _when(raw != clean, _issue("email-whitespace", "warning", F.concat(F.lit('Email has whitespace: "'), raw, F.lit('"')), "email", email=clean, original_value=raw, fixed_value=clean))


def _metadata_json(_: Present) -> Column:
    clean = text.filled(F.col("metadata"))
    return _when(clean.isNotNull() & ~jsons.is_json(clean), _issue("metadata-json", "error", "Invalid JSON in metadata field", "metadata"))


def _metadata_nested(_: Present) -> Column:
    clean = text.filled(F.col("metadata"))
    made = lambda e: _issue("metadata-arrays-objects", "warning", F.concat(F.lit('Metadata field "'), e["key"], F.lit('" holds an array or object')), "metadata", original_value=e["value"], fixed_value=e["value"])
    return F.transform(jsons.nested_entries(clean), made)


def _org_conflict(_: Present) -> Column:
    both = text.filled(F.col("org_id")).isNotNull() & text.filled(F.col("org_external_id")).isNotNull()
    return _when(both, _issue("org-id-conflict", "error", "Row has both org_id and org_external_id", org_id=F.col("org_id"), org_external_id=F.col("org_external_id")))


def _boolean_format(_: Present) -> Column:
    raw = F.col("email_verified")
    wrong = ~text.is_blank(raw) & text.parse_bool(raw).isNull()
    return _when(wrong, _issue("boolean-format", "warning", F.concat(F.lit('Invalid boolean value: "'), raw, F.lit('"')), "email_verified", original_value=raw, fixed_value=F.lit("false")))


def _role_slugs(present: Present) -> Column:
    if "role_slugs" not in present:
        return F.lit(None).cast(ISSUES)
    empty = _issue("role-slugs-format", "warning", EMPTY_ROLES, "role_slugs")
    wrong = F.filter(text.split_list(F.col("role_slugs")), lambda s: ~s.rlike("^[a-z0-9_-]+$"))
    made = F.transform(wrong, lambda s: _issue("role-slugs-format", "error", F.concat(F.lit('Invalid role slug "'), s, F.lit('"')), "role_slugs"))
    return F.when(text.is_blank(F.col("role_slugs")), F.array(empty)).otherwise(made)


def _hash_complete(_: Present) -> Column:
    lone = text.filled(F.col("password_hash")).isNotNull() & text.filled(F.col("password_hash_type")).isNull()
    return _when(lone, _issue("password-hash-complete", "error", HASH_WITHOUT_TYPE, "password_hash"))


def _fix_email(_: Present) -> dict[str, Column]:
    return {"email": text.trimmed(F.col("email"))}


def _fix_metadata(_: Present) -> dict[str, Column]:
    return {"metadata": jsons.stringify_nested(text.filled(F.col("metadata")))}


def _fix_boolean(_: Present) -> dict[str, Column]:
    raw = F.col("email_verified")
    return {"email_verified": F.when(~text.is_blank(raw), F.coalesce(text.bool_text(raw), F.lit("false")))}


RULES = (
    Rule("required-email-column", "error", "header"), Rule("unknown-columns", "warning", "header"), Rule("mode-detection", "info", "header"),
    Rule("required-email", "error", "row", _required_email), Rule("email-format", "error", "row", _email_format), Rule("email-whitespace", "warning", "row", _email_whitespace, _fix_email),
    Rule("metadata-json", "error", "row", _metadata_json), Rule("metadata-arrays-objects", "warning", "row", _metadata_nested, _fix_metadata), Rule("org-id-conflict", "error", "row", _org_conflict),
    Rule("boolean-format", "warning", "row", _boolean_format, _fix_boolean), Rule("role-slugs-format", "error", "row", _role_slugs), Rule("password-hash-complete", "error", "row", _hash_complete),
    Rule("duplicate-email", "warning", "duplicate"), Rule("duplicate-external-id", "warning", "duplicate"),
)


def rules_by_category(category: str) -> list[Rule]:
    return [r for r in RULES if r.category == category]


def rule_by_id(name: str) -> Rule | None:
    return next((r for r in RULES if r.id == name), None)


def fixing_rules() -> list[Rule]:
    return [r for r in RULES if r.fix]


def header_issues(columns: list[str]) -> list[dict]:
    """What the header alone shows; the last one tells the mode."""
    found = [] if "email" in columns else [{"severity": "error", "rule_id": "required-email-column", "message": "Missing required column: email"}]
    found += [{"severity": "warning", "rule_id": "unknown-columns", "field": c, "message": f"Unknown column: {c}"} for c in columns if c not in KNOWN_COLUMNS and c != RECORD]
    return [*found, {"severity": "info", "rule_id": "mode-detection", "message": f"Detected mode: {detect_mode(columns)}"}]


def check_rows(df: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """df with issues: an array of ISSUE structs, in the order of the rules."""
    present = set(df.columns)
    chosen = [r for r in (rules or RULES) if r.issues]
    none = F.array().cast(ISSUES)
    return with_known_columns(df).withColumn("issues", F.flatten(F.array(*[F.coalesce(r.issues(present), none) for r in chosen])))


def duplicate_issues(df: DataFrame) -> DataFrame:
    """(record_number, ISSUE fields) for each row whose email or external id an earlier row has. A key's first row is joined to the others; no task sorts all rows of a key."""
    df = with_known_columns(df)
    made = []
    for rule, field, key in (("duplicate-email", "email", text.email_key(F.col("email"))), ("duplicate-external-id", "external_id", text.trimmed(F.col("external_id")))):
        keyed = df.select(RECORD, "email", F.nullif(key, F.lit("")).alias("__key")).where(F.col("__key").isNotNull())
        first = keyed.groupBy(F.col("__key").alias("__first_key")).agg(F.min(RECORD).alias("__first"))
        later = keyed.join(first, keyed["__key"] == first["__first_key"]).where(F.col(RECORD) > F.col("__first"))
        message = F.concat(F.lit(f"Duplicate {field}: "), F.col("__key"))
        made.append(later.select(RECORD, _issue(rule, "warning", message, field, category=F.lit("duplicate")).alias("issue")))
    return made[0].union(made[1]).select(RECORD, "issue.*")


def row_issues(checked: DataFrame) -> DataFrame:
    """(record_number, ISSUE fields), one row per issue of check_rows."""
    return checked.select(RECORD, F.explode("issues").alias("issue")).select(RECORD, "issue.*")


def fix_rows(df: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """df with all fixes, in the order of the rules, and changes: an array of (field, original_value, fixed_value)."""
    fixed = {c: F.coalesce(new, F.col(c)) for c, new in _fixes(df, rules)}
    return df.withColumn("changes", changes_of(df, rules)).withColumns(fixed)


def _fixes(df: DataFrame, rules: list[Rule] | None) -> list[tuple[str, Column]]:
    present = set(df.columns)
    return [(c, new) for r in rules or fixing_rules() for c, new in r.fix(present).items() if c in present]


def changes_of(df: DataFrame, rules: list[Rule] | None = None) -> Column:
    """The changes that the fixes would make to a row."""
    change = lambda c, new: F.struct(F.lit(c).alias("field"), F.col(c).alias("original_value"), new.alias("fixed_value"))
    made = [F.when(new.isNotNull() & ~new.eqNullSafe(F.col(c)), change(c, new)) for c, new in _fixes(df, rules)]
    return F.array_compact(F.array(*made))


def validate(df: DataFrame, auto_fix: bool = False) -> DataFrame:
    """One row per input row: record_number, email_key, external_id, status (invalid, warning, valid) and n_fixes. With auto_fix, a row one of whose warnings is fixed has no warning left."""
    checked = check_rows(df)
    severity = lambda s: F.exists("issues", lambda i: i["severity"] == s)
    changes = F.lit(0)
    clears = F.lit(False)
    if auto_fix:
        checked = checked.withColumn("changes", changes_of(df))
        changes = F.size("changes")
        clears = F.exists("issues", lambda i: (i["severity"] == "warning") & F.array_contains(F.transform("changes", lambda c: c["field"]), i["field"]) & (i["field"] != "metadata"))
    status = F.when(severity("error"), "invalid").when(severity("warning") & ~clears, "warning").otherwise("valid")
    return checked.select(RECORD, F.nullif(text.email_key(F.col("email")), F.lit("")).alias("email_key"), text.filled(F.col("external_id")).alias("external_id"), status.alias("status"), changes.alias("n_fixes"))


def summary(validated: DataFrame) -> DataFrame:
    """One row: rows by status, distinct emails and external ids (under the names that reports use: duplicate_emails, duplicate_external_ids), rows that repeat one, fixes."""
    return validated.agg(
        F.count("*").alias("total_rows"), F.count_if(F.col("status") == "valid").alias("valid_rows"), F.count_if(F.col("status") == "invalid").alias("invalid_rows"), F.count_if(F.col("status") == "warning").alias("warning_rows"),
        F.countDistinct("email_key").alias("duplicate_emails"), F.countDistinct("external_id").alias("duplicate_external_ids"),
        (F.count("email_key") - F.countDistinct("email_key")).alias("repeated_emails"), F.coalesce(F.sum("n_fixes"), F.lit(0)).cast("long").alias("fixes"),
    )
