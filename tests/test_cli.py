import json

from rosterforge import cli
from rosterforge.operators import joins
from rosterforge.sinks import rest as sink
from rosterforge.sources import files
from rosterforge.streaming import incremental


def run(tmp_path, *argv):
    code = cli.main([*argv, "--report", str(tmp_path / "r.json")])
    return code, json.loads((tmp_path / "r.json").read_text())


def test_validate_and_load(spark, tmp_path):
    csv = tmp_path / "u.csv"
    csv.write_text('email,first_name,email_verified,org_external_id\n" a@x.com ",Ann,yes,e1\na@x.com,,no,e1\nb@x.com,Bob,1,e2\n')
    code, found = run(tmp_path, "validate", "--csv", str(csv), "--auto-fix", "--fixed-csv", str(tmp_path / "fixed"), "--deduped-csv", str(tmp_path / "one"), "--issues", str(tmp_path / "issues"))
    assert (code, found["valid_rows"], found["fixes"], found["dedupe"]["rows_removed"]) == (0, 3, 4, 1)
    merged = {r.email: r for r in files.read_csv(spark, str(tmp_path / "one")).collect()}
    assert set(merged) == {"a@x.com", "b@x.com"} and merged["a@x.com"].email_verified == "true"
    orgs = tmp_path / "o.csv"
    orgs.write_text("id,external_id\norg_1,e1\n")
    code, found = run(tmp_path, "load", "--csv", str(csv), "--orgs", str(orgs), "--job", str(tmp_path / "job"), "--chunk-size", "2", "--errors", str(tmp_path / "errors.jsonl"))
    assert (found["users_created"], found["failures"], found["status"]) == (1, 1, "Completed with errors")
    assert incremental.last_job(spark, str(tmp_path / "job")) == "chunks" and incremental.last_job(spark, str(tmp_path / "none")) is None
    code, found = run(tmp_path, "analyze", "--errors", str(tmp_path / "errors.jsonl"), "--retry-csv", str(tmp_path / "retry"))
    assert (code, found["total_errors"], found["top_groups"][0]["severity"]) == (1, 1, "critical")
    code, found = run(tmp_path, "plan", "--csv", str(csv), "--workers", "2")
    assert code == 1 and found["mode"] == "multi-org" and found["rows"] == 3


def test_transforms(spark, tmp_path):
    users = tmp_path / "f.json"
    users.write_text(json.dumps({"users": [{"localId": "1", "email": "a@x.com", "displayName": "Ann Lee", "passwordHash": "h", "salt": "s"}, {"localId": "2"}]}))
    orgs = tmp_path / "o.csv"
    orgs.write_text("firebase_uid,org_id\n1,org_9\n")
    code, found = run(tmp_path, "transform-firebase", "--source", str(users), "--out", str(tmp_path / "f"), "--orgs", str(orgs), "--signer-key", "k", "--skipped", str(tmp_path / "s"))
    assert (found["transformed_users"], found["skip_reasons"]) == (1, {"Missing email address": 1})
    row = files.read_csv(spark, str(tmp_path / "f")).first()
    assert (row.org_id, row.last_name) == ("org_9", "Lee") and row.password_hash.startswith("$firebase-scrypt$hash=h")
    clerk = tmp_path / "c.csv"
    clerk.write_text("id,first_name,primary_email_address\nu1,Ann,a@x.com\n")
    assert run(tmp_path, "transform-clerk", "--source", str(clerk), "--out", str(tmp_path / "c"))[1]["transformed_users"] == 1
    passwords = tmp_path / "p.ndjson"
    passwords.write_text('{"email":"A@x.com","passwordHash":"$2b$1"}\n')
    mapped = tmp_path / "m.csv"
    mapped.write_text("email,given_name\na@x.com,Ann\nb@x.com,Bob\n")
    assert run(tmp_path, "merge-passwords", "--csv", str(mapped), "--passwords", str(passwords), "--out", str(tmp_path / "w"))[1] == {"rows": 2, "with_password": 1}
    assert run(tmp_path, "map", "--csv", str(mapped), "--profile", "auth0", "--out", str(tmp_path / "m"))[1] == {"rows": 2, "unmapped": {}}
    roles = tmp_path / "r.csv"
    roles.write_text('role_slug,role_name,role_type,permissions\nadmin,Admin,environment,"a,b"\n,X,environment,\n')
    found = run(tmp_path, "roles", "--csv", str(roles), "--problems", str(tmp_path / "problems"))[1]
    assert (found["created"], found["problems"], spark.read.json(str(tmp_path / "problems")).count()) == (1, {"error": 1}, 1)
    there = tmp_path / "there.csv"
    there.write_text('slug,org_id,permissions\nadmin,,"a,c"\n')
    found = run(tmp_path, "roles", "--csv", str(roles), "--existing", str(there))[1]
    assert (found["created"], found["exists"], found["mismatched"]) == (0, 1, 1)


def test_errors_without_numbers_keep_their_order(spark, tmp_path):
    log = tmp_path / "e.jsonl"
    lines = [(9, "z late number", 500), (None, "a no number", 500), (1, "z late number", 500)]
    log.write_text("".join(json.dumps({"recordNumber": n, "errorMessage": m, "httpStatus": s, "email": f"{n}@x.com", "rawRow": {"zip": "1", "email": f"{n}@x.com"}}) + "\n" for n, m, s in lines))
    code, found = run(tmp_path, "analyze", "--errors", str(log), "--retry-csv", str(tmp_path / "retry"))
    assert [g["pattern"] for g in found["top_groups"]] == ["z late number", "a no number"] and found["columns_of_other_rows"] == []
    assert files.read_csv(spark, str(tmp_path / "retry"), number=False).columns == ["email", "zip"]


class Factors:
    def enroll_factor(self, user, secret):
        return {"new": 201, "old": 409}.get(secret, 400)


def test_enroll_and_ensure(spark):
    planned = spark.createDataFrame([(1, "a", "new", "u1", "enroll"), (2, "b", "old", "u2", "enroll"), (3, "c", "x", None, "user_not_found"), (4, "d", "bad", "u4", "enroll")], "record_number long, email_key string, secret string, user_id string, outcome string")
    made = {r.record_number: r.outcome for r in sink.enroll(planned, Factors(), rate=1e6, tasks=2).collect()}
    assert made == {1: "enrolled", 2: "skipped", 3: "user_not_found", 4: "failed"}
    orgs = spark.createDataFrame([("o1", "e1")], "id string, external_id string")
    assert joins.resolve_one(orgs) is None and joins.resolve_one(orgs, external_id="e1") == "o1" and joins.resolve_one(orgs, external_id="e2", create_missing=True) == "org_dryrun_e2"


def test_enrolment_command(spark, tmp_path):
    secrets, users = tmp_path / "t.csv", tmp_path / "u.csv"
    secrets.write_text("email,totp_secret\nA@x.com,new\nb@x.com,old\nc@x.com,bad\nd@x.com,new\n")
    users.write_text("id,email\n1,a@x.com\n2,b@x.com\n3,c@x.com\n")
    argv = ("enroll-totp", "--totp", str(secrets), "--users", str(users), "--failed", str(tmp_path / "failed"))
    assert run(tmp_path, *argv) == (1, {"total": 4, "enrolled": 3, "skipped": 0, "failures": 1, "user_not_found": 1})
    code, found = run(tmp_path, *argv, "--client", "test_cli:Factors", "--rate", "1000000", "--outcomes", str(tmp_path / "out"))
    assert (code, found) == (1, {"total": 4, "enrolled": 1, "skipped": 1, "failures": 2, "user_not_found": 1})
    assert spark.read.json(str(tmp_path / "failed")).count() == 2
