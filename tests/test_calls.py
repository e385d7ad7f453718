"""Row sinks: each row is called for once, whatever Spark does with the outcome, and a run that was broken off is gone on with."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from rosterforge.sinks import calls
from rosterforge.sinks import rest as sink


class Counted:
    """A service that writes a line for each call; create_user fails on rows of `broken` while that file is there."""

    def __init__(self, folder):
        self.folder = str(folder)

    def said(self, what):
        with open(f"{self.folder}/calls-{os.getpid()}", "a") as f:
            f.write(what + "\n")

    def create_user(self, row):
        email = row["email_key"]
        if email.startswith("broken") and os.path.exists(f"{self.folder}/broken"):
            if open(f"{self.folder}/broken").read() == "once":
                os.remove(f"{self.folder}/broken")
            raise OSError("connection lost")
        self.said(f"user {email}")
        return (409, f"id-{email}") if email.startswith("dup") else (400, None) if email.startswith("bad") else (201, f"id-{email}")

    def create_membership(self, user, org, roles):
        self.said(f"member {user} {org}")
        return 422 if roles == ["odd"] else 500 if org == "down" else 201

    def delete_user(self, user):
        self.said(f"delete {user}")
        return 200


def called(folder):
    return sorted(x for f in os.listdir(folder) if f.startswith("calls-") for x in open(f"{folder}/{f}").read().split("\n") if x)


def people(spark, n=60):
    return spark.range(1, n + 1).select(
        F.col("id").alias("record_number"), F.concat(F.when(F.col("id") == n, " Broken").when(F.col("id") % 7 == 0, "dup").otherwise("u"), (F.col("id") % 20).cast("string"), F.lit("@X")).alias("email"),
        F.when(F.col("id") % 3 != 0, F.concat(F.lit("o"), (F.col("id") % 2).cast("string"))).alias("org"), F.array(F.lit("r")).alias("roles"),
    )


def test_actions_on_the_outcome_call_nothing(spark, tmp_path):
    made = sink.load(people(spark), Counted(tmp_path), rate=1e6, tasks=3)
    before = called(tmp_path)
    assert len([x for x in before if x.startswith("user")]) == people(spark).select(F.lower(F.trim("email"))).distinct().count()
    assert made.count() == 60 and made.where("user_outcome = 'created'").count() == len({x for x in before if x.startswith("user u") or x.startswith("user broken")})
    assert called(tmp_path) == before


def test_a_run_that_was_broken_off_goes_on(spark, tmp_path):
    """The rows before the failure have their outcome, and none is called twice."""
    (tmp_path / "broken").write_text("always")
    folder = str(tmp_path / "out")
    with pytest.raises(Exception, match="connection lost"):
        sink.load(people(spark), Counted(tmp_path), rate=1e6, tasks=1, folder=folder, flush=7)
    assert [r["state"] for r in calls.runs(folder).values()] == ["aborted"]
    known = calls.outcomes(spark, folder, sink.RESULT)
    assert known.count() == 59 and known.select("state").distinct().collect()[0][0] == "aborted"
    (tmp_path / "broken").unlink()
    made = sink.load(people(spark), Counted(tmp_path), rate=1e6, tasks=1, folder=folder)
    assert made.count() == made.select("record_number").distinct().count() == 60
    assert sorted(r["state"] for r in calls.runs(folder).values()) == ["aborted", "committed"] and [r["called"] for r in calls.runs(folder).values() if r["state"] == "committed"] == [1]
    once = called(tmp_path)
    assert len(once) == len(set(once)) or len([x for x in once if x.startswith("user")]) == len({x for x in once if x.startswith("user")})
    again = sink.load(people(spark), Counted(tmp_path), rate=1e6, tasks=1, folder=folder)
    assert again.count() == 60 and called(tmp_path) == once


def test_a_task_that_fails_once_is_done_again_without_its_calls(tmp_path):
    """Spark tries the task again in the same job; in a process of its own, as one thread's master has no retries."""
    (tmp_path / "broken").write_text("once")
    code = f"""
import sys; sys.path[:0] = {[os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]!r}
from pyspark.sql import SparkSession
import test_calls as t
s = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
made = t.sink.load(t.people(s), t.Counted({str(tmp_path)!r}), rate=1e6, tasks=1, folder={str(tmp_path / 'out')!r}, flush=1000)
print("ROWS", made.count(), made.select("record_number").distinct().count(), [(r["state"], r["called"], r["known"]) for r in t.calls.runs({str(tmp_path / 'out')!r}).values()])
"""
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert "ROWS 60 60 [('committed', 1, 59)]" in said.stdout, said.stdout + said.stderr[-2000:]
    users = [x for x in called(tmp_path) if x.startswith("user")]
    assert len(users) == len(set(users))


def test_memberships_that_fail_undo_their_user(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a@x", "down", []), (2, "a@x", "o", ["odd"]), (3, "bad@x", "o", [])], "record_number long, email string, org string, roles array<string>")
    slow = Counted(tmp_path)
    made = {r.record_number: (r.user_outcome, r.membership_outcome, r.error_type, r.http_status) for r in sink.load(rows, slow, rate=1e6, tasks=2, require_membership=True).collect()}
    assert made == {1: ("created", None, "membership_create", 500), 2: ("created", "created", None, 201), 3: (None, None, "user_create", 400)}
    assert [x for x in called(tmp_path) if x.startswith("delete")] == ["delete id-a@x"] and called(tmp_path).count("user a@x") == 2


class Orgs(Counted):
    def __call__(self, row):
        self.said(f"org {row['org']} {row['name']}")
        return 500 if row["org"].startswith("no") else (409, "there") if row["org"] == "o1" else (201, f"id-{row['org']}")


def test_a_dimension_is_made_in_the_cluster(spark, tmp_path, monkeypatch):
    rows = spark.range(400).select(F.concat(F.lit("o"), (F.col("id") % 40).cast("string")).alias("org"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"))
    made = sink.ensure(rows.union(spark.createDataFrame([(None, "x")], rows.schema)), "org", Orgs(tmp_path), rate=1e6, tasks=3)
    found = {r.org: (r.id, r.outcome) for r in made.collect()}
    assert len(found) == 40 and found["o1"] == ("there", "existed") and found["o2"] == ("id-o2", "created") and len(called(tmp_path)) == 40
    users = spark.createDataFrame([("a", "o2"), ("b", "o77"), ("c", None)], "email string, org string")
    assert {r.email: r.org_id for r in sink.with_ids(users, made, "org", "org_id").collect()} == {"a": "id-o2", "b": None, "c": None}


def test_a_dimension_that_mostly_fails_is_given_up(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("time.sleep", lambda s: None)

    class Refused(Counted):
        def __call__(self, row):
            self.said(row["org"])
            return 400

    with pytest.raises(Exception, match="keys failed"):
        sink.ensure(spark.range(500).select(F.col("id").cast("string").alias("org")), "org", Refused(tmp_path), rate=1e6, tasks=2)
    assert len(called(tmp_path)) < 60
