"""Plans of loads: estimates, checks of options, recommendations, and the steps of a whole migration."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import detect_mode

#: Users a second at concurrency 10 with one worker.
BASE_RATE = 10


@dataclass(frozen=True)
class Options:
    path: str = ""
    concurrency: int = 10
    workers: int = 1
    chunk_size: int = 1000
    job: str | None = None
    org_id: str | None = None
    org_external_id: str | None = None
    dry_run: bool = False


def estimate(rows: int, concurrency: int = 10, workers: int = 1) -> str:
    """A rough duration: seconds below a minute, then minutes, then hours, each rounded up."""
    seconds = math.ceil(rows / (BASE_RATE * (concurrency / 10) * workers))
    for unit, size, below in (("seconds", 1, 60), ("minutes", 60, 3600)):
        if seconds < below:
            return f"~{math.ceil(seconds / size)} {unit}"
    return f"~{math.ceil(seconds / 3600)} hours"


def estimated(rows: Column, concurrency: int = 10, workers: int = 1) -> Column:
    """estimate() of a column of numbers of rows."""
    seconds = F.ceil(rows / (BASE_RATE * (concurrency / 10) * workers))
    said = lambda n, unit: F.concat(F.lit("~"), F.ceil(n).cast("string"), F.lit(f" {unit}"))
    return F.when(seconds < 60, said(seconds, "seconds")).when(seconds < 3600, said(seconds / 60, "minutes")).otherwise(said(seconds / 3600, "hours"))


def chunk_count(rows: int, size: int = 1000) -> int:
    return math.ceil(rows / size)


def remaining_seconds(done: int, total: int, elapsed: float, evidence: int = 2) -> float | None:
    """Time left at the pace so far; None before there is evidence for a pace."""
    return None if done < evidence or elapsed <= 0 or done > total else (total - done) * elapsed / done


def check_options(o: Options, mode: str, rows: int) -> tuple[list[str], list[str]]:
    """(errors, warnings)."""
    errors = [
        text
        for wrong, text in (
            (not o.path, "no input path"), (o.org_id and o.org_external_id, "both organization ids are given"), (o.concurrency < 1, "concurrency below 1"), (o.workers < 1, "workers below 1"),
            (o.chunk_size < 1, "chunk size below 1"), (o.workers > 1 and not o.job, "several workers need a job"),
        )
        if wrong
    ]
    warnings = [
        text
        for odd, text in (
            (0 < o.chunk_size < 100, "chunks of fewer than 100 rows"), (rows > 10_000 and not o.job, "more than 10,000 rows without a job that can be resumed"),
            ((o.org_id or o.org_external_id) and mode == "user-only", "an organization is given for rows without one"),
        )
        if odd
    ]
    return errors, warnings


def recommendations(o: Options, rows: int, cpus: int) -> list[str]:
    found = []
    if rows > 10_000 and not o.job:
        found.append("use a job, so that the load can be resumed")
    if rows > 10_000 and o.workers == 1:
        found.append(f"use {min(cpus - 1, 4) if rows > 50_000 else 2} workers")
    if rows > 100_000 and o.concurrency == 10:
        found.append("raise the concurrency to 20 or more")
    return found


@dataclass(frozen=True)
class Plan:
    mode: str
    rows: int
    duration: str
    chunks: int | None
    errors: list[str]
    warnings: list[str]
    advice: list[str]


def plan(o: Options, columns: list[str], rows: int, cpus: int = 4) -> Plan:
    mode = detect_mode(columns, bool(o.org_id or o.org_external_id))
    errors, warnings = check_options(o, mode, rows)
    return Plan(mode, rows, estimate(rows, o.concurrency, o.workers), chunk_count(rows, o.chunk_size) if o.job else None, errors, warnings, recommendations(o, rows, cpus))


@dataclass(frozen=True)
class Answers:
    """What a migration is to do."""

    source: str
    size: str = "small"
    has_passwords: bool = False
    has_roles: bool = False
    has_totp: bool = False
    validate: bool = True
    auto_fix: bool = True
    dry_run: bool = True


@dataclass
class Step:
    id: str
    run: Callable[[dict], object] | None = None
    skip: Callable[[dict], bool] | None = None
    optional: bool = False
    options: dict = field(default_factory=dict)


SCALES = {"small": (1000, 10), "medium": (2000, 15), "large": (5000, 20)}


def steps(a: Answers) -> list[Step]:
    """The steps of a migration, in order."""
    chunk, concurrency = SCALES[a.size]
    load = {"chunk_size": chunk, "concurrency": concurrency}
    made = [Step("export")] if a.source == "auth0" else [Step(f"transform-{a.source}")] if a.source in ("clerk", "firebase") else []
    made += [Step("merge-passwords")] if a.has_passwords and a.source == "auth0" else []
    made += [Step("process-role-definitions")] if a.has_roles else []
    made += [Step("validate", options={"auto_fix": a.auto_fix})] if a.validate else []
    made += [Step("plan")] + ([Step("dry-run", options=load)] if a.dry_run else []) + [Step("import", options=load)]
    made += [Step("enroll-totp", optional=True)] if a.has_totp else []
    failed = lambda done: not done.get("import", {}).get("failures")
    return [*made, Step("analyze-errors", skip=failed), Step("retry", skip=failed, options={"concurrency": 5})]


def execute(todo: list[Step], runs: dict[str, Callable[[dict], object]]) -> dict:
    """Runs steps in order: {id: result}; a failure ends the run unless the step is optional. Under "states": completed, skipped or failed by id; under "seconds": how long each took."""
    done: dict = {"states": {}, "seconds": {}}
    for s in todo:
        if s.skip and s.skip(done):
            done["states"][s.id], done["seconds"][s.id] = "skipped", 0.0
            continue
        began = time.monotonic()
        try:
            done[s.id] = (s.run or runs[s.id])({**s.options, "done": done})
            done["states"][s.id] = "completed"
        except Exception as e:
            done["states"][s.id] = "failed"
            done[s.id] = {"error": str(e)}
        done["seconds"][s.id] = time.monotonic() - began
        if done["states"][s.id] == "failed" and not s.optional:
            break
    return done


def result(done: dict) -> dict:
    """Of a run: whether no step failed, how many steps there were, completed, failed and were skipped, and how long all took."""
    states = list(done["states"].values())
    return {"success": "failed" not in states, "steps": len(states), **{s: states.count(s) for s in ("completed", "failed", "skipped")}, "seconds": sum(done["seconds"].values())}
