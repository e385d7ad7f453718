import json

import pytest
from pyspark.sql import functions as F

from rosterforge.operators import load
from rosterforge.plans import planner
from rosterforge.sinks import files as out
from rosterforge.sinks import rest as sink
from rosterforge.sources import files, rest, synthetic
from rosterforge.streaming import incremental, loads


def test_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes('﻿email,first_name,metadata\n a@x.com ,"  Ann ","{""k"":1}"\n\nb@x.com,"two\nlines",\n'.encode())
    df = files.read_csv(spark, str(path))
    assert [tuple(r) for r in df.orderBy("record_number").collect()] == [("a@x.com", "  Ann ", '{"k":1}', 1), ("b@x.com", "two\nlines", "", 2)]
    assert files.header(spark, str(path)) == ["email", "first_name", "metadata"] and files.count_rows(spark, str(path)) == 2
    assert len(files.file_digest(spark, str(path))) == 64
    path.write_text("a,b\n1\n1,2,3\n")
    assert [tuple(r) for r in files.read_csv(spark, str(path), strict=False, number=False).collect()] == [("1", None), ("1", "2")]
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        files.read_csv(spark, str(path), number=False).collect()


def test_json(spark, tmp_path):
    path = tmp_path / "users.json"
    path.write_text(json.dumps({"users": [{"localId": "1", "email": "a@x.com", "mfaInfo": [{"displayName": "p"}]}, {"localId": "2"}]}))
    df = files.read_user_document(spark, str(path))
    assert [(r.localId, r.record_number) for r in df.collect()] == [("1", 1), ("2", 2)] and df.first().mfaInfo[0].displayName == "p"
    path.write_text("{}")
    with pytest.raises(ValueError, match="users"):
        files.read_user_document(spark, str(path))
    lines = tmp_path / "e.jsonl"
    lines.write_text('{"recordNumber":1,"errorMessage":"x","httpStatus":429}\n\nnot json\n{"recordNumber":2,"rawRow":{"email":"a"}}\n')
    good, bad = files.read_errors(spark, str(lines))
    assert sorted(r.recordNumber for r in good.collect()) == [1, 2] and [r.value for r in bad.collect()] == ["not json"]
    lines.write_text('{"email":"A@x.com","passwordHash":"$2b$x","password_set_date":{"$date":"d"}}\nbroken\n')
    from rosterforge.operators import joins

    assert [tuple(r) for r in joins.password_lookup(files.read_passwords(spark, str(lines))).select("email_key", "hash", "set_date", "algorithm").collect()] == [("a@x.com", "$2b$x", "d", "bcrypt")]


def test_sinks(spark, tmp_path):
    df = spark.sql("select 1 as n, true as b, array('x') as roles, map('email','a','password','p') as rawRow, 'a,\"b' as t")
    assert out.write_errors(df.limit(0), str(tmp_path / "none.csv")) is False and not (tmp_path / "none.csv").exists()
    out.write_errors(out.redacted(df), str(tmp_path / "e.csv"), every=True)
    back = files.read_csv(spark, str(tmp_path / "e.csv")).first()
    assert (back.b, back.roles, back.rawRow, back.t, back.httpStatus) == ("true", '["x"]', '{"email":"a"}', 'a,"b', "")
    out.write_errors(df.withColumn("errorMessage", F.lit('a,"b\nc')), str(tmp_path / "f.csv"))
    back = files.read_csv(spark, str(tmp_path / "f.csv"), number=False)
    assert back.columns == list(out.ERROR_COLUMNS) and back.first().errorMessage == 'a,"b\nc'
    out.write_report({"a": 1}, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"a": 1}
    kept, skipped = out.split_skipped(spark.sql("select explode(array(null, 'x')) as skip_reason"))
    assert (kept.count(), skipped.count()) == (1, 1)
    assert "rows  3" in out.summary_text("Done", {"rows": 3})


class Client:
    """A service in memory."""

    def get(self, path, params):
        if path == "/organizations":
            ids = [{"id": f"o{k}", "name": f"n{k}"} for k in range(250)]
            return 200, ids[params["page"] * params["per_page"] : (params["page"] + 1) * params["per_page"]]
        if path == "/organizations/o1/members":
            return 200, [{"user_id": "u1"}, {"user_id": "u2"}][params["page"] * params["per_page"] :]
        if path.endswith("/roles"):
            return (200, {"data": [{"slug": "a"}], "after": "x"}) if not params["after"] else (200, {"data": [{"slug": "b"}], "after": None})
        if path == "/users":
            assert params["fields"].startswith("user_id") and params["from"] % params["per_page"] == 0
            return 200, [{"user_id": f"u{k}", "email": f"{k}@x.com"} for k in range(params["from"], min(130, params["from"] + params["per_page"]))]
        if path == "/users/u1":
            return 200, {"email": "1@x.com"}
        return 404, None


def test_paged_sources(spark):
    assert rest.read_paged(spark, Client(), rest.organizations(pages_each=1), total_pages=3).agg(F.countDistinct("id")).first()[0] == 250
    assert sorted(tuple(r) for r in rest.read_paged(spark, Client(), rest.members(["o1", "gone"])).collect()) == [("o1", "u1"), ("o1", "u2")]
    assert [r.slug for r in rest.read_paged(spark, Client(), rest.roles(["o1"])).orderBy("slug").collect()] == ["a", "b"]
    assert rest.read_paged(spark, Client(), rest.all_users()).count() == 130
    assert rest.can_connect(Client())
    keys = spark.createDataFrame([("u1",), ("u1",), ("u9",)], "user_id string")
    assert [tuple(r) for r in rest.point_lookup(keys, Client(), "/users/{key}", "user_id string, email string").collect()] == [("u1", "1@x.com")]


def test_token_bucket_and_retry():
    slept = []
    bucket = rest.Bucket(10, 2, clock=lambda: 0.0, sleep=slept.append)
    for _ in range(4):
        bucket.acquire()
    assert slept == [pytest.approx(0.1), pytest.approx(0.1)] or len(slept) == 2
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise rest.RetryAfter(429, 1.5 if len(calls) == 1 else None)
        return "ok"

    waits = []
    assert rest.with_retry(flaky, sleep=waits.append) == "ok" and waits == [1.5, 1.0]
    with pytest.raises(rest.RetryAfter):
        rest.with_retry(lambda: (_ for _ in ()).throw(rest.RetryAfter(400)), sleep=waits.append)
    token = rest.Token(lambda: ("t", 1000))
    assert token.get(0) == "t" and token.until == 700


class Service:
    def create_user(self, row):
        return (409, "old") if row["email"].startswith("dup") else (500, None) if row["email"].startswith("bad") else (201, "id-" + row["email"])

    def create_membership(self, user, org, roles):
        return 422 if roles else 201 if org == "o1" else 409

    def delete_user(self, user):
        return 200


def test_load_into_service(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a@x", "o1", ["r"]), (2, "a@x", "o2", []), (3, "dup@x", None, []), (4, "bad@x", "o1", [])], "record_number long, email string, org string, roles array<string>")
    made = {r.record_number: r for r in sink.load(rows, Service(), rate=1e6, tasks=2).collect()}
    assert (made[1].user_outcome, made[1].membership_outcome) == ("created", "created") and (made[2].user_outcome, made[2].membership_outcome) == ("duplicate", "duplicate")
    assert made[3].user_outcome == "duplicate" and made[4].error_type == "user_create"


def test_synthetic(spark):
    df = synthetic.users(spark, 1000, orgs=20, skewed=True, error_percent=10)
    assert df.where("not contains(email, '@')").count() == 100
    one = synthetic.distribution(df).first()
    assert one.orgs_used == 20 and one.max_users > 3 * one.avg_users
    assert synthetic.distribution(synthetic.users(spark, 100)).first().max_users == 10


def test_planner():
    assert [planner.estimate(n) for n in (100, 600, 36_000)] == ["~10 seconds", "~1 minutes", "~1 hours"]
    assert planner.chunk_count(2500) == 3 and planner.remaining_seconds(1, 10, 5) is None and planner.remaining_seconds(5, 10, 5) == 5
    errors, warnings = planner.check_options(planner.Options("", 0, 2, 50, org_id="a", org_external_id="b"), "user-only", 20_000)
    assert len(errors) == 4 and len(warnings) == 3
    p = planner.plan(planner.Options("x.csv", job="j"), ["email", "org_name"], 60_000)
    assert (p.mode, p.chunks, p.errors, p.advice) == ("multi-org", 60, [], ["use 3 workers"])
    ids = [s.id for s in planner.steps(planner.Answers("auth0", "medium", has_passwords=True, has_roles=True, has_totp=True))]
    assert ids == ["export", "merge-passwords", "process-role-definitions", "validate", "plan", "dry-run", "import", "enroll-totp", "analyze-errors", "retry"]


def test_estimates_of_a_column(spark):
    ns = [0, 1, 599, 600, 601, 35_999, 36_000, 36_001, 10**9]
    made = spark.createDataFrame([(n,) for n in ns], "n long").select("n", planner.estimated(F.col("n")).alias("e"), planner.estimated(F.col("n"), 20, 3).alias("f")).collect()
    assert all(r.e == planner.estimate(r.n) and r.f == planner.estimate(r.n, 20, 3) for r in made)


def test_execute_steps():
    runs = {"validate": lambda o: {"ok": True}, "plan": lambda o: 1 / 0, "import": lambda o: {}}
    done = planner.execute(planner.steps(planner.Answers("csv", dry_run=False)), runs)
    assert done["states"] == {"validate": "completed", "plan": "failed"} and set(done["seconds"]) == {"validate", "plan"}
    result = planner.result(done)
    assert result.pop("seconds") >= 0 and result == {"success": False, "steps": 2, "completed": 1, "failed": 1, "skipped": 0}
    runs["plan"] = lambda o: {}
    assert planner.execute(planner.steps(planner.Answers("csv", dry_run=False)), runs)["states"]["retry"] == "skipped"


def test_resumed_chunks(spark, tmp_path):
    """A run that is broken off goes on with the waves that are not done; only their rows are worked out."""
    df, table, seen = synthetic.users(spark, 100), str(tmp_path / "chunks"), []

    def make(part):
        seen.append((part.agg(F.min("record_number"), F.max("record_number")).first(), part))
        if len(seen) == 3:
            raise RuntimeError("broken off")
        return load.outcomes(part, chunk_size=10)

    with pytest.raises(RuntimeError, match="broken off"):
        incremental.process_chunks(df, 10, table, make, wave=2)
    assert incremental.chunk_ledger(spark, table).count() == 4
    again = incremental.process_chunks(df, 10, table, make, wave=2)
    assert [tuple(r) for r, _ in seen] == [(1, 20), (21, 40), (41, 60), (41, 60), (61, 80), (81, 100)]
    plan = seen[-1][1]._jdf.queryExecution().optimizedPlan().toString()
    assert "81" in plan and "100" in plan and "Filter" in plan
    found = load.outcomes(df, chunk_size=10)
    assert again.count() == 10 and load.total_of_chunks(again).first() == load.summary(found).first()
    assert {(r.runs, r.state) for r in again.collect()} == {(1, "Success")}
    assert incremental.process_chunks(df, 10, table, make, wave=2).count() == 10 and len(seen) == 6
    for other in (df.where("record_number > 1"), df.withColumn("email", F.upper("email"))):
        with pytest.raises(ValueError, match="another input"):
            incremental.process_chunks(other, 10, table, wave=2)
    with pytest.raises(ValueError, match="another size"):
        incremental.process_chunks(df, 5, table, wave=2)
    times = spark.createDataFrame([(k, 100 * k) for k in range(1, 8)], "chunk_id int, duration_ms long")
    assert tuple(incremental.progress(times, 10).first()) == (7, 70, 1500.0)


def test_jobs_do_not_grow_with_the_waves(spark, tmp_path):
    df, table, seen = synthetic.users(spark, 400), str(tmp_path / "chunks"), []

    def make(part):
        seen.append(1)
        if len(seen) == 3:
            raise RuntimeError("broken off")
        return load.outcomes(part, chunk_size=10)

    with pytest.raises(RuntimeError, match="broken off"):
        incremental.process_chunks(df, 10, table, make, wave=1)
    assert incremental.chunk_ledger(spark, table).count() == 6  # of 40 waves, three a job
    made = incremental.process_chunks(df, 10, table, make, wave=1)
    assert len(seen) == 3 + 12 and incremental._runs([0, 1, 2, 5, 6, 7, 8], 3) == [(0, 2), (5, 7), (8, 8)]
    assert {r.runs for r in made.collect()} == {1} and load.total_of_chunks(made).first() == load.summary(load.outcomes(df, chunk_size=10)).first()


def test_two_runs_at_once_count_each_chunk_once(spark, tmp_path):
    df, table = synthetic.users(spark, 60), str(tmp_path / "chunks")
    other = []

    def make(part):  # another run does everything while this one is at its first wave
        if not other:
            other.append(1)
            incremental.process_chunks(df, 10, table, wave=2)
        return load.outcomes(part, chunk_size=10)

    made = incremental.process_chunks(df, 10, table, make, wave=2)
    assert sorted(r.runs for r in made.collect()) == [2] * 6
    assert load.total_of_chunks(made).first() == load.summary(load.outcomes(df, chunk_size=10)).first()
    assert incremental.process_chunks(df.limit(0), 10, str(tmp_path / "none")).count() == 0


def test_streams(spark, tmp_path):
    df = synthetic.users(spark, 50).withColumn("ts", F.timestamp_seconds(F.col("record_number") * 60))
    df.write.parquet(str(tmp_path / "in"))
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    stream = incremental.stream_users(spark, str(tmp_path / "in"), ddl)
    q = loads.load_stream(stream.drop("ts"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert load.summary(spark.read.parquet(str(tmp_path / "out"))).first().users_created == 50
    firsts = incremental.first_per_email(stream.union(stream)).writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start()
    firsts.awaitTermination(120)
    assert spark.table("firsts").count() == 50
    counted = incremental.org_counts(stream, "ts").writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    counted.awaitTermination(120)
    assert spark.table("counted").agg(F.sum("rows")).first()[0] == 50


def test_parents_share_the_rate_of_the_tasks_that_run():
    reader = rest.PagedReader(None, rest.members([str(k) for k in range(10_000)], tasks=4), ["parent", "user_id"], 0)
    parts = reader.partitions()
    assert len(parts) == 4 and sorted(p for part in parts for p in part.parents) == sorted(str(k) for k in range(10_000))
    waits = []
    slow = rest.Bucket(0.5, clock=lambda: 0.0, sleep=waits.append)
    slow.acquire()
    slow.acquire()
    assert waits == [2.0]


def test_retry_waits_as_long_as_the_server_asks():
    assert rest.asked_seconds({"retry_after": "7"}) == 7 and rest.asked_seconds({"Retry-After": 0}) == 0
    assert rest.asked_seconds({"Retry-After": "soon"}) is None and rest.asked_seconds([1]) is None and rest.asked_seconds(None) is None
    waits, answers = [], iter([(429, {"retry_after": 9}), (200, [])])

    def call():
        status, body = next(answers)
        if status == 429:
            raise rest.RetryAfter(status, rest.asked_seconds(body))
        return body

    assert rest.with_retry(call, sleep=waits.append) == [] and waits == [9]


def test_resume_after_a_run_without_data(spark, tmp_path):
    import os

    os.makedirs(tmp_path / "table" / "_temporary")
    assert incremental.finished_waves(spark, str(tmp_path / "table"), 10, 1000, "x") == set()
    assert incremental.process_chunks(synthetic.users(spark, 5), 10, str(tmp_path / "table")).count() == 1


def test_digests_tell_inputs_apart(spark):
    df = synthetic.users(spark, 50)
    assert files.input_digest(df) == files.input_digest(df.repartition(5)) != files.input_digest(df.limit(49))
    assert files.input_digest(df.union(df)) != files.input_digest(df) and files.input_digest(df.limit(0)) == "0-0-0"


def test_lookups_have_as_many_tasks_as_share_the_rate(spark):
    keys = spark.createDataFrame([(f"k{k}",) for k in range(50)], "user_id string")
    assert rest.point_lookup(keys, Client(), "/x/{key}", "user_id string", rate=80, tasks=3).rdd.getNumPartitions() <= 3


def test_lines_can_be_split(spark, tmp_path):
    path = tmp_path / "big.csv"
    path.write_text("a,b\n" + "".join(f"{k},{k}\n" for k in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        whole, split = (files.read_csv(spark, str(path), line_breaks=x) for x in (True, False))
        assert whole.rdd.getNumPartitions() == 1 < split.rdd.getNumPartitions()
        assert split.where("a + 1 != record_number").count() == 0 and split.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
