"""Commands: python -m rosterforge COMMAND --help. Each reads files, writes files and prints a summary; loads are dry runs, as real ones need a client (sinks.rest); enroll-totp takes one by name (module:factory)."""

from __future__ import annotations

import argparse
import importlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import analyze, dedupe, joins, load, mapping, transforms, validate
from .functions import text
from .plans import planner
from .schema import require_columns
from .sinks import files as out
from .sinks import rest
from .sources import files
from .streaming import incremental


def _session() -> SparkSession:
    return SparkSession.builder.appName("rosterforge").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _plain(df: DataFrame) -> DataFrame:
    """Only what fits a CSV cell."""
    return df.select(*[c for c, kind in df.dtypes if not kind.startswith(("array", "map", "struct")) and c not in ("record_number", "skip_reason", "warning", "email_key", "rows")])


def _finish(title: str, found: dict, path: str | None) -> None:
    print(out.summary_text(title, found))
    if path:
        out.write_report(found, path)


def cmd_validate(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = files.read_csv(spark, a.csv)
    found = out.report(validate.summary(validate.validate(rows, a.auto_fix)))
    found["header"] = validate.header_issues([c for c in rows.columns if c != "record_number"])
    if a.issues:
        out.write_json_lines(validate.row_issues(validate.check_rows(rows)).unionByName(validate.duplicate_issues(rows)), a.issues, "overwrite")
    good = validate.fix_rows(rows).drop("changes") if a.auto_fix else rows
    if a.fixed_csv:
        out.write_csv(good.drop("record_number"), a.fixed_csv)
    if a.deduped_csv:
        out.write_csv(_plain(dedupe.merge(good)), a.deduped_csv)
        found["dedupe"] = out.report(dedupe.summary(good))
    _finish("Validation", found, a.report)
    return 1 if found["invalid_rows"] else 2 if found["warning_rows"] else 0


def cmd_map(spark: SparkSession, a: argparse.Namespace) -> int:
    profile = mapping.load_profile(a.profile)
    rows = files.read_csv(spark, a.csv)
    mapped = mapping.apply_profile(rows, profile)
    out.write_csv(mapped.drop("record_number"), a.out)
    _finish("Mapping", {"rows": mapped.count(), "unmapped": {r["column"]: r["rows"] for r in mapping.unmapped_counts(rows, profile).collect()}}, a.report)
    return 0


def cmd_transform(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.provider == "clerk":
        made, key = transforms.clerk(files.read_csv(spark, a.source, strict=False)), "clerk_user_id"
    else:
        scrypt = transforms.Scrypt(a.signer_key, a.salt_separator, a.rounds, a.mem_cost) if a.signer_key else None
        made, key = transforms.firebase(files.read_user_document(spark, a.source), a.name_split, a.include_disabled, scrypt), "firebase_uid"
    org = files.read_csv(spark, a.orgs) if a.orgs else None
    roles = files.read_csv(spark, a.roles) if a.roles else None
    made = transforms.with_mappings(made, org, roles, key).cache()
    kept, skipped = out.split_skipped(made)
    out.write_csv(kept, a.out, [c for c in transforms.output_columns(org, joins.role_mapping(roles, key) if roles is not None else None) if c in kept.columns])
    if a.skipped:
        out.write_json_lines(skipped, a.skipped, "overwrite")
    _finish("Transform", {**out.report(transforms.transform_summary(made)), "skip_reasons": {r.skip_reason: r["rows"] for r in transforms.skip_reasons(made).collect()}}, a.report)
    return 0


def cmd_merge_passwords(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = files.read_csv(spark, a.csv, strict=False)
    made = joins.merge_passwords(rows.drop("password_hash", "password_hash_type", "password_set_date"), joins.password_lookup(files.read_passwords(spark, a.passwords)))
    out.write_csv(made.drop("record_number"), a.out)
    _finish("Passwords", out.report(made.agg(F.count("*").alias("rows"), F.count_if(F.col("password_hash") != "").alias("with_password"))), a.report)
    return 0


def cmd_roles(spark: SparkSession, a: argparse.Namespace) -> int:
    kept, problems = joins.parse_role_definitions(files.read_csv(spark, a.csv))
    if a.existing:
        rows = require_columns(files.read_csv(spark, a.existing, number=False), ["slug", "org_id", "permissions"])
        there = rows.select("slug", F.nullif("org_id", F.lit("")).alias("org_id"), F.coalesce(text.split_list(F.col("permissions")), F.array().cast("array<string>")).alias("permissions"))
    else:
        there = spark.createDataFrame([], "slug string, org_id string, permissions array<string>")
    found = out.report(joins.role_summary(joins.process_roles(kept, there)))
    found["problems"] = {r.level: r["count"] for r in problems.groupBy("level").count().collect()}
    if a.problems:
        out.write_json_lines(problems, a.problems, "overwrite")
    _finish("Roles (dry run)", found, a.report)
    return 0


def cmd_enroll(spark: SparkSession, a: argparse.Namespace) -> int:
    records = files.read_totp(spark, a.totp)
    records = joins.totp_from_csv(records) if a.totp.endswith(".csv") else joins.totp_from_json(records)
    planned = joins.plan_totp(records, require_columns(files.read_csv(spark, a.users, number=False), ["id", "email"]))
    if a.client:
        module, _, name = a.client.partition(":")
        found = rest.enroll(planned, getattr(importlib.import_module(module), name)(), a.rate, folder=a.outcomes)
    else:
        found = planned
    summary = out.report(joins.totp_summary(found))
    if a.failed:
        out.write_json_lines(found.where(F.col("outcome").isin("failed", "user_not_found")), a.failed, "overwrite")
    _finish("Enrolment" if a.client else "Enrolment (dry run)", summary, a.report)
    return 1 if summary["failures"] else 0


def cmd_plan(spark: SparkSession, a: argparse.Namespace) -> int:
    options = planner.Options(a.csv, a.concurrency, a.workers, a.chunk_size, a.job, a.org_id, a.org_external_id)
    made = planner.plan(options, files.header(spark, a.csv), files.count_rows(spark, a.csv), os.cpu_count() or 1)
    _finish("Plan", vars(made), a.report)
    return 1 if made.errors else 0


def cmd_load(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = files.read_csv(spark, a.csv)
    if a.org_id:
        rows = rows.withColumn("org_id", F.lit(a.org_id)).drop("org_external_id")
    roles = joins.role_mapping(files.read_csv(spark, a.user_roles), "external_id") if a.user_roles else None
    orgs = files.read_csv(spark, a.orgs, number=False).select("id", "external_id") if a.orgs else None
    found = load.outcomes(rows, orgs, roles, a.create_missing, a.chunk_size if a.job else None)
    if a.job:
        chunks = incremental.process_chunks(rows, a.chunk_size, f"{a.job}/chunks", lambda part: load.outcomes(part, orgs, roles, a.create_missing, a.chunk_size))
        summary = load.total_of_chunks(chunks)
    else:
        summary = load.summary(found)
    if a.errors:
        out.write_errors(out.redacted(load.error_records(found, rows)), a.errors)
    _finish("Load (dry run)", out.report(summary), a.report)
    return 0


def cmd_analyze(spark: SparkSession, a: argparse.Namespace) -> int:
    records, bad = files.read_errors(spark, a.errors)
    records = records.cache()
    groups = analyze.groups(records, "line").cache()
    found = out.report(analyze.retryability(records)) | {
        "unreadable_lines": bad.count(), "top_groups": [r.asDict() for r in analyze.top_groups(groups, a.top).collect()],
        "suggestions": [r.asDict() for r in analyze.suggestions(groups).orderBy(F.desc("affected")).limit(a.top).collect()],
    }
    if a.retry_csv:
        again = analyze.retry_set(records, "line", a.include_duplicates).cache()
        table, others = analyze.retry_table(again, "line", a.all_columns)
        if table is not None:
            out.write_csv(table, a.retry_csv)
        found["columns_of_other_rows"] = others
    _finish("Errors", found, a.report)
    return 0 if found["retryable_errors"] else 1


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="rosterforge", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, run, *options: tuple) -> None:
        p = commands.add_parser(name)
        for flag, kind in options:
            if kind is bool:
                p.add_argument(flag, action="store_true")
            else:
                p.add_argument(flag, required=kind == "must", type=kind if callable(kind) else str, default=None if kind in ("must", str) else {"--concurrency": 10, "--workers": 1, "--chunk-size": 1000, "--top": 5, "--rounds": 8, "--mem-cost": 14, "--rate": 50.0}.get(flag))
        p.add_argument("--report")
        p.set_defaults(run=run)

    add("validate", cmd_validate, ("--csv", "must"), ("--auto-fix", bool), ("--issues", str), ("--fixed-csv", str), ("--deduped-csv", str))
    add("map", cmd_map, ("--csv", "must"), ("--profile", "must"), ("--out", "must"))
    for name in ("clerk", "firebase"):
        more = (("--name-split", str), ("--include-disabled", bool), ("--signer-key", str), ("--salt-separator", str), ("--rounds", int), ("--mem-cost", int)) if name == "firebase" else ()
        add(f"transform-{name}", cmd_transform, ("--source", "must"), ("--out", "must"), ("--orgs", str), ("--roles", str), ("--skipped", str), *more)
        commands.choices[f"transform-{name}"].set_defaults(provider=name, name_split="first-space", salt_separator="Bw==")
    add("merge-passwords", cmd_merge_passwords, ("--csv", "must"), ("--passwords", "must"), ("--out", "must"))
    add("roles", cmd_roles, ("--csv", "must"), ("--existing", str), ("--problems", str))
    add("enroll-totp", cmd_enroll, ("--totp", "must"), ("--users", "must"), ("--client", str), ("--rate", float), ("--outcomes", str), ("--failed", str))
    add("plan", cmd_plan, ("--csv", "must"), ("--concurrency", int), ("--workers", int), ("--chunk-size", int), ("--job", str), ("--org-id", str), ("--org-external-id", str))
    add("load", cmd_load, ("--csv", "must"), ("--orgs", str), ("--user-roles", str), ("--org-id", str), ("--create-missing", bool), ("--job", str), ("--chunk-size", int), ("--errors", str))
    add("analyze", cmd_analyze, ("--errors", "must"), ("--retry-csv", str), ("--include-duplicates", bool), ("--all-columns", bool), ("--top", int))
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    return a.run(_session(), a)
