"""Loads into a REST service: one partition per task, each with its share of the rate, and calls that can be repeated without harm. See calls: acting on the outcomes calls nothing again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources.rest import Bucket, RetryAfter, asked_seconds, with_retry
from . import calls

RESULT = "record_number long, email_key string, user_id string, user_outcome string, membership_outcome string, error_type string, error string, http_status int"


def _calling(rate: float) -> Callable:
    """Calls with a share of the rate, again after a 429 or a server error; then the last status stands for the answer."""
    bucket = Bucket(rate)

    def call(f, *args):
        def once():
            bucket.acquire()
            answer = f(*args)
            status = answer[0] if isinstance(answer, tuple) else answer
            if status == 429 or status >= 500:
                raise RetryAfter(status, asked_seconds(answer[1] if isinstance(answer, tuple) else None))
            return answer if isinstance(answer, tuple) else (answer, None)

        try:
            return with_retry(once)
        except RetryAfter as e:
            return e.status, None

    return call


class DryService:
    """Stands for the service in a dry run on the way that real loads go: each call succeeds, and what a task has made is there the next time. Its ids are those of text.dry_run_user()."""

    def __init__(self):
        self.members: set[tuple] = set()

    def create_user(self, row: dict) -> tuple[int, str]:
        return 201, f"dry-run-user-{row['email_key']}"

    def create_membership(self, user: str, org: str, roles: list[str]) -> int:
        there = (user, org) in self.members
        self.members.add((user, org))
        return 409 if there else 201

    def delete_user(self, user: str) -> int:
        return 200


def load(rows: DataFrame, client, rate: float = 50.0, tasks: int = 8, require_membership: bool = False, folder: str | None = None, flush: int = calls.FLUSH) -> DataFrame:
    """What came of each row (record_number, email, org, roles, ...): RESULT, read from a table in `folder` (a new one in the shared folder where that is None).

    client: picklable, with create_user(row) -> (status, id), create_membership(user_id, org, roles) -> status, delete_user(id) -> status and, for users that are there already, user_by_email(email) -> (status, id). A body in the
    place of the id of a 429 or a server error may have retry_after. Rows of one email, trimmed and in lower case, go to one task, so a user is made once;
    a 409 counts as a duplicate. A membership that fails with 422 is tried without roles. With require_membership, a user made for a row whose
    membership fails is deleted again.

    The service is called here, once: the frame that is given reads the table. A load into the folder of one that was broken off goes on with the rows that have no outcome there yet.
    """

    def make(known: list[dict]) -> Callable[[dict], dict]:
        call = _calling(rate / tasks)
        gone = {x["email_key"] for x in known if require_membership and x["error_type"] == "membership_create" and x["user_outcome"] == "created"}
        users: dict[str, str | None] = {x["email_key"]: x["user_id"] for x in known if x["user_outcome"] and x["email_key"] not in gone}

        def handle(row: dict) -> dict:
            email, member, outcome, status, made = row["email_key"], None, "duplicate", 200, False
            if email not in users:
                status, user = call(client.create_user, row)
                made = status in (200, 201)
                outcome = "created" if made else "duplicate" if status == 409 else None
                if outcome == "duplicate" and user is None:  # the answer names no user: the service is asked for it
                    user = call(client.user_by_email, email)[1] if hasattr(client, "user_by_email") else None
                if outcome:
                    users[email] = user
            if outcome is None:
                return {"email_key": email, "error_type": "user_create", "error": f"status {status}", "http_status": status}
            failed, user = None, users[email]
            if row.get("org") and user is None:
                failed = status = 409
            elif row.get("org"):
                status, _ = call(client.create_membership, user, row["org"], list(row.get("roles") or []))
                if status == 422:
                    status, _ = call(client.create_membership, user, row["org"], [])
                member = "created" if status in (200, 201) else "duplicate" if status == 409 else None
                failed = None if member else status
                if failed and require_membership and made:
                    call(client.delete_user, users.pop(email))
            return {
                "email_key": email, "user_id": user, "user_outcome": outcome, "membership_outcome": member, "error_type": "membership_create" if failed else None, "error": f"status {failed}" if failed else None, "http_status": status,
            }

        return handle

    deal = lambda todo: todo.repartition(tasks, "email_key").sortWithinPartitions("record_number")
    return calls.act(rows.withColumn("email_key", text.email_key(F.col("email"))), deal, make, RESULT, "record_number", folder, flush)


def enroll(planned: DataFrame, client, rate: float = 50.0, tasks: int = 4, folder: str | None = None) -> DataFrame:
    """(record_number, outcome): enrolls the TOTP secret of each planned record (joins.plan_totp), once. client: enroll_factor(user_id, secret) -> status; an existing factor (409) counts as skipped."""

    def make(known: list[dict]) -> Callable[[dict], dict]:
        call = _calling(rate / tasks)

        def handle(row: dict) -> dict:
            if row["outcome"] != "enroll":
                return {"outcome": row["outcome"]}
            status, _ = call(client.enroll_factor, row["user_id"], row["secret"])
            return {"outcome": "enrolled" if status in (200, 201) else "skipped" if status == 409 else "failed"}

        return handle

    return calls.act(planned, lambda todo: todo.repartition(tasks, "record_number"), make, "record_number long, outcome string", "record_number", folder)


def ensure(wanted: DataFrame, key: str, create, rate: float = 50.0, tasks: int = 8, most_failed: float = 0.1, folder: str | None = None) -> DataFrame:
    """(key, id, outcome) of each distinct key of a dimension (organisations, roles, permissions) before rows that need it are loaded: created, existed or failed.

    create(row) -> (status, id) or status, where 409 says that the key is there, with its id if the answer has one. Each key is dealt to one task and asked for once, however many rows have it; of those the one that is
    smallest in its other columns is created. Nothing goes through the driver. A task gives up when more than `most_failed` of its keys (and 10 at least) have failed, and the load as a whole when that share of all has.
    """
    kind = dict(wanted.dtypes)[key]
    others = [c for c in wanted.columns if c != key]
    one = wanted.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*others)).alias("others")).select(key, "others.*") if others else wanted.where(F.col(key).isNotNull()).select(key).distinct()

    def make(known: list[dict]) -> Callable[[dict], dict]:
        call = _calling(rate / tasks)
        seen = {"all": len(known), "failed": sum(x["outcome"] == "failed" for x in known)}

        def handle(row: dict) -> dict:
            status, made = call(create, row)
            outcome = "created" if status in (200, 201) else "existed" if status == 409 else "failed"
            seen["all"] += 1
            seen["failed"] += outcome == "failed"
            if seen["failed"] > max(10, most_failed * seen["all"]):
                raise RuntimeError(f"{seen['failed']} of {seen['all']} keys failed, the last with status {status}")
            return {"id": made, "outcome": outcome}

        return handle

    made = calls.act(one, lambda todo: todo.repartition(tasks, key), make, f"`{key}` {kind}, id string, outcome string", key, folder)
    total = made.agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "failed").alias("failed")).first()
    if total.failed > max(1, most_failed * total.n):
        raise RuntimeError(f"{total.failed} of {total.n} keys failed")
    return made


def with_ids(rows: DataFrame, ensured: DataFrame, key: str, name: str = "org") -> DataFrame:
    """The rows with the id of their key, from ensure(); null where there is none."""
    ids = ensured.select(F.col(key).alias("ensured_key"), F.col("id").alias(name))
    return rows.join(ids, rows[key] == ids["ensured_key"], "left").drop("ensured_key")
