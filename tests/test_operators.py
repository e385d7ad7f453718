import json

import pytest
from pyspark.sql import functions as F

from rosterforge.operators import analyze, dedupe, joins, load, mapping, ordering, transforms, validate
from rosterforge.schema import FIREBASE_USER, detect_mode, require_columns


def rows(spark, columns, *cells):
    names = columns.split()
    schema = ", ".join(f"{c} string" for c in names)
    return spark.createDataFrame([(*r, i) for i, r in enumerate(cells, 1)], f"{schema}, record_number long")


def listed(df, *columns):
    return [tuple(r) for r in df.orderBy("record_number").select(*columns).collect()]


def test_schema_checks(spark):
    df = rows(spark, "email org_name")
    assert detect_mode(df.columns) == "multi-org" and detect_mode(["email"]) == "user-only" and detect_mode([], True) == "single-org"
    with pytest.raises(ValueError, match="org_id"):
        require_columns(df, ["email"], [["org_id"]])


def test_validation_of_bad_rows(spark):
    """Five rows, each with an error; four distinct emails."""
    df = rows(
        spark, "email email_verified metadata org_id org_external_id password_hash password_hash_type",
        ("", "true", "", "", "", "", ""), ("not-an-email", "true", "", "", "", "", ""), ("c@x.com", "maybe", "{bad", "", "", "", ""), ("d@x.com", "no", "", "org_1", "ext", "", ""), ("e@x.com", "", "", "", "", "$2a$", ""),
    )
    one = validate.summary(validate.validate(df)).first()
    assert (one.total_rows, one.invalid_rows, one.duplicate_emails, one.repeated_emails) == (5, 5, 4, 0)
    issues = validate.row_issues(validate.check_rows(df))
    assert {(r.record_number, r.rule_id) for r in issues.collect()} == {
        (1, "required-email"), (2, "email-format"), (3, "metadata-json"), (3, "boolean-format"), (4, "org-id-conflict"), (5, "password-hash-complete"),
    }


def test_fixes(spark):
    """Three fixes, three valid rows."""
    df = rows(spark, "email email_verified", (" a@x.com ", "true"), ("b@x.com", "yes"), ("c@x.com", "0"))
    one = validate.summary(validate.validate(df, auto_fix=True)).first()
    assert (one.valid_rows, one.warning_rows, one.fixes) == (3, 0, 3)
    assert listed(validate.fix_rows(df), "email", "email_verified") == [("a@x.com", "true"), ("b@x.com", "true"), ("c@x.com", "false")]


def test_nested_metadata_stays_a_warning_when_fixed(spark):
    df = rows(spark, "email metadata", ("a@x.com", '{"tags":["x"],"n":1}'))
    one = validate.summary(validate.validate(df, auto_fix=True)).first()
    assert (one.warning_rows, one.fixes) == (1, 1)
    assert listed(validate.fix_rows(df), "metadata") == [('{"tags":"[\\"x\\"]","n":1}',)]


def test_role_slugs_present_or_absent(spark):
    assert validate.row_issues(validate.check_rows(rows(spark, "email", ("a@x.com",)))).count() == 0
    found = validate.row_issues(validate.check_rows(rows(spark, "email role_slugs", ("a@x.com", ""), ("b@x.com", '["ok","Not OK"]'))))
    assert sorted((r.record_number, r.severity) for r in found.collect()) == [(1, "warning"), (2, "error")]


def test_registry_and_headers():
    assert len(validate.rules_by_category("row")) == 9 and len(validate.fixing_rules()) == 3
    assert validate.rule_by_id("email-format").severity == "error" and validate.rule_by_id("x") is None
    assert [i["rule_id"] for i in validate.header_issues(["name"])] == ["required-email-column", "unknown-columns", "mode-detection"]


MERGE = ("email first_name external_id email_verified metadata", ("A@x.com", "", "1", "no", '{"k":0,"a":"x"}'), ("a@x.com ", "Ann", "2", "yes", '{"k":5,"b":"y"}'), ("b@x.com", "Bob", "3", "", ""), ("", "Nobody", "4", "", ""))


@pytest.mark.parametrize("partitions", [1, 7])
def test_merge(spark, partitions):
    df = rows(spark, *MERGE).repartition(partitions)
    made = {r.email_key: r for r in dedupe.merge(df).collect()}
    a = made["a@x.com"]
    assert (a.rows, a.first_name, a.external_id, a.email_verified, a.email) == (2, "Ann", "1", "true", "A@x.com")
    assert json.loads(a.metadata) == {"k": 5, "a": "x", "b": "y"} and list(json.loads(a.metadata)) == ["k", "a", "b"]
    assert set(made) == {"a@x.com", "b@x.com"}
    found = {(r.email_key, r.field): (r["values"], r.chosen) for r in dedupe.conflicts(df).collect()}
    assert found[("a@x.com", "external_id")] == (["1", "2"], "1") and found[("a@x.com", "email_verified")][1] == "true"
    one = dedupe.summary(df).first()
    assert (one.total_rows, one.unique_emails, one.duplicate_groups, one.rows_removed) == (3, 2, 1, 1)


def test_merged_metadata_keeps_types_and_order(spark):
    first = '{"z":{"b":1,"a":[1,{"q":null,"c":2.5}]},"n":0,"f":false,"s":"0","t":true,"x":null,"2":"two"}'
    second = '{"n":7,"f":"false","s":"1","t":false,"x":[],"1":"one","e":"","u":"\\u00e9\\"","i":1.0}'
    df = rows(spark, "email metadata", ("a@x.com", first), ("A@x.com", second), ("b@x.com", ' {"n": 1, "t" : true }'), ("c@x.com", "no json"), ("c@x.com", "[1]"), ("d@x.com", None), ("d@x.com", '{"k":0}'), ("d@x.com", '{"k":""}'))
    made = {r.email_key: r.metadata for r in dedupe.merge(df.repartition(3)).collect()}
    assert made["a@x.com"] == '{"1":"one","2":"two","z":{"b":1,"a":[1,{"q":null,"c":2.5}]},"n":7,"f":"false","s":"0","t":true,"x":[],"e":"","u":"é\\"","i":1}'
    assert (made["b@x.com"], made["c@x.com"], made["d@x.com"]) == (' {"n": 1, "t" : true }', "no json", '{"k":""}')


def test_conflicts_do_not_parse_rows_for_every_step(spark):
    df = spark.createDataFrame([(1, "a@x", '{"k":1}'), (2, "a@x", '{"k":2}')], "record_number long, email string, metadata string")
    made = dedupe.conflict_values(df)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and sorted((r.field, r.value) for r in made.collect()) == [("metadata.k", "1"), ("metadata.k", "2")]


def test_metadata_conflicts_begin_at_the_first_value(spark):
    """An empty value before it is none, after it is; the text "0" is a value."""
    each = ("0", "5", "0", '"5"', "5", "null", "0")
    df = rows(spark, "email metadata", *[("a@x.com", f'{{"k":{v},"e":{"null" if k else 0},"s":"0"}}') for k, v in enumerate(each)])
    found = {r.field: (r["values"], r.chosen, r.strategy) for r in dedupe.conflicts(df).collect()}
    assert found == {"metadata.k": (["5", "0", '"5"', "null"], "5", "first-occurrence")}
    assert sorted((r.value, r["at"]) for r in dedupe.conflict_values(df).collect()) == [('"5"', 4), ("0", 3), ("5", 2), ("null", 6)]


def test_mapped_metadata_keeps_types(spark):
    df = spark.createDataFrame([("a@x.com", '{"n":1,"o":{"b":[true]},"t":"1"}', '{"n":false}', "free \"text\""), ("b@x.com", "[1]", "", "")], "email string, user_metadata string, app_metadata string, note string")
    profile = mapping.Profile("typed", (mapping.FieldMapping("email", "email"),), mapping.MetadataMapping(["user_metadata", "app_metadata", "note"], prefix="p_", static={"v": 2, "on": True}))
    made = [r.metadata for r in mapping.apply_profile(df, profile).orderBy("email").collect()]
    assert made == ['{"v":2,"on":true,"p_n":false,"p_o":{"b":[true]},"p_t":"1","p_note":"free \\"text\\""}', '{"v":2,"on":true}']


def test_one_user_in_three_organizations(spark):
    df = rows(spark, "email org_id", *[("a@x.com", f"org_{k}") for k in range(3)])
    one = load.summary(load.outcomes(df)).first()
    assert (one.users_created, one.duplicate_users, one.memberships_created, one.status) == (1, 2, 3, "Success")


def test_failed_rows_create_nothing(spark):
    df = rows(spark, "email metadata", ("a@x.com", "{bad"), ("a@x.com", ""), ("", ""))
    assert listed(load.outcomes(df), "error_type", "user_outcome") == [("user_create", None), (None, "created"), ("user_create", None)]
    assert load.error_records(load.outcomes(df)).count() == 2


def test_chunks_add_up(spark):
    df = rows(spark, "email org_id", *[(f"u{k % 7}@x.com", f"org_{k % 3}") for k in range(50)])
    found = load.outcomes(df)
    assert load.total_of_chunks(load.chunk_summaries(found, 8)).first() == load.summary(found).first()
    total = spark.sql("select 25L as total_rows")
    assert [tuple(r) for r in ordering.chunks(total, 10).orderBy("chunk_id").collect()] == [(0, 1, 10), (1, 11, 20), (2, 21, 25)]
    scoped = load.summary(load.outcomes(df, chunk_size=25)).first()
    assert scoped.users_created == 14


def test_resolve_organizations(spark):
    orgs = spark.createDataFrame([("org_1", "ext_1")], "id string, external_id string")
    df = rows(spark, "org_id org_external_id", ("org_1", ""), ("", "ext_1"), ("", "new"), ("", ""), ("gone", ""))
    assert listed(joins.resolve_orgs(df, orgs), "resolved_org_id") == [("org_1",), ("org_1",), (None,), (None,), (None,)]
    assert listed(joins.resolve_orgs(df, orgs, True), "resolved_org_id", "org_error")[2:] == [("org_dryrun_new", None), (None, None), (None, "Organization not found: gone")]


def test_mappings_last_wins_and_roles_in_order(spark):
    m = rows(spark, "user_id org_id org_external_id org_name", ("u1", "", "e1", "N1"), ("u1", "o2", "e2", "N2"), ("u2", "", "e3", "N3"))
    df = rows(spark, "external_id", ("u1",), ("u2",), ("u3",))
    assert listed(transforms.with_mappings(df, m), "org_id", "org_external_id", "org_name") == [("o2", None, None), (None, "e3", "N3"), (None, None, None)]
    r = rows(spark, "user_id role_slug", ("u1", "b"), ("u1", "a"), ("u1", "b"), ("u2", ""))
    assert listed(transforms.with_mappings(df, roles=r), "role_slugs") == [("b,a",), (None,), (None,)]
    assert transforms.output_columns(m, r)[-3:] == ["org_external_id", "org_name", "role_slugs"]
    assert tuple(joins.role_mapping_summary(r, "user_id").first()) == (4, 3, 1, 2)


def test_clerk(spark):
    df = rows(spark, "id first_name primary_email_address password_digest password_hasher username", ("u1", "Ann", "a@x.com", "$2a$", "bcrypt", "ann"), ("u2", "", "b@x.com", "argon", "argon2id", ""), ("u3", "", "", "", "", ""))
    made = transforms.clerk(df)
    assert listed(made, "email", "password_hash", "skip_reason") == [("a@x.com", "$2a$", None), ("b@x.com", None, None), (None, None, "Missing required field: primary_email_address")]
    assert json.loads(made.where("record_number = 1").first().metadata) == {"clerk_user_id": "u1", "username": "ann"}
    assert tuple(transforms.transform_summary(made).first()) == (3, 2, 1, 1, 1)


def test_firebase(spark):
    user = {"localId": "f1", "email": "a@x.com", "emailVerified": True, "displayName": "Ann Lee", "passwordHash": "a-_b", "salt": "c_", "customAttributes": '{"role":"x"}', "createdAt": "1648020042135", "mfaInfo": []}
    data = [user, {"localId": "f2", "email": "b@x.com", "disabled": True}, {"localId": "f3"}]
    df = spark.createDataFrame([{**u, "record_number": i} for i, u in enumerate(data, 1)], FIREBASE_USER + ", record_number long")
    made = transforms.firebase(df, scrypt=transforms.Scrypt("sk-"))
    assert listed(made, "skip_reason") == [(None,), ("User is disabled",), ("Missing email address",)]
    one = made.where("record_number = 1").first()
    assert one.password_hash == "$firebase-scrypt$hash=a+/b$salt=c/$sk=sk+$ss=Bw==$r=8$m=14" and (one.first_name, one.last_name) == ("Ann", "Lee")
    assert json.loads(one.metadata) == {"firebase_uid": "f1", "custom_attributes": {"role": "x"}, "created_at": "2022-03-23T07:20:42.135Z"}
    kept = transforms.firebase(df, include_disabled=True).where("record_number = 2").first()
    assert kept.skip_reason is None and json.loads(kept.metadata)["disabled"] is True


def test_auth0(spark):
    df = rows(
        spark, "email given_name family_name name email_verified user_id created_at updated_at last_login logins_count user_metadata app_metadata org_id org_name org_display_name",
        ("a@x.com", "", "", "Ann Mary Lee", "true", "auth0|1", "t1", "t2", "", "3", '{"org_id":"z","x":1}', '{"x":[2]}', "o1", "name", ""),
    )
    one = transforms.auth0(df).first()
    assert (one.first_name, one.last_name, one.org_external_id, one.org_name, one.skip_reason) == ("Ann", "Mary Lee", "o1", "name", None)
    assert json.loads(one.metadata) == {"auth0_org_id": "z", "x": "[2]", "auth0_user_id": "auth0|1", "auth0_created_at": "t1", "auth0_updated_at": "t2", "auth0_logins_count": "3"}


def test_profiles(spark, tmp_path):
    df = rows(spark, "email given_name user_metadata app_metadata extra", (" A@X.com", "Ann", '{"a":"1"}', "plain", "z"), ("", "", "", "[1]", ""))
    made = mapping.apply_profile(df, mapping.AUTH0)
    assert made.columns[1:5] == ["email", "password_hash", "password_hash_type", "first_name"]
    assert listed(made, "email", "metadata") == [("a@x.com", '{"_provider":"auth0","auth0_a":"1","auth0_app_metadata":"plain"}'), (None, '{"_provider":"auth0"}')]
    assert [tuple(r) for r in mapping.unmapped_counts(df, mapping.AUTH0).collect()] == [("extra", 2)]
    path = tmp_path / "p.json"
    path.write_text(json.dumps({"name": "own", "mappings": [{"sourceField": "extra", "targetField": "last_name", "transformer": "uppercase", "defaultValue": "none"}]}))
    assert listed(mapping.apply_profile(df, mapping.load_profile(str(path))), "last_name") == [("Z",), ("none",)]
    assert mapping.validate_profile({"mappings": [{"sourceField": "a", "transformer": "x"}]}) == ["name is missing", "mapping 0: targetField is missing", "mapping 0: unknown transformer x"]
    assert mapping.built_in_names() == ["auth0"] and mapping.too_many_errors(mapping.mapping_errors(made), 0)


def test_role_definitions(spark):
    df = rows(
        spark, "role_slug role_name role_type permissions org_id",
        ("admin", "Admin", "environment", "a,b", ""), ("admin", "Again", "environment", "a", ""), ("admin", "Org", "organization", '["c"]', "o1"), ("", "X", "environment", "", ""), ("y", "Y", "other", "", ""), ("z", "Z", "organization", "", ""),
    )
    kept, problems = joins.parse_role_definitions(df)
    assert listed(kept, "slug", "org_id") == [("admin", None), ("admin", "o1")]
    assert listed(problems, "record_number", "level") == [(2, "warning"), (4, "error"), (5, "warning"), (6, "warning")]
    there = spark.createDataFrame([("admin", None, ["b", "x"])], "slug string, org_id string, permissions array<string>")
    found = joins.process_roles(kept, there)
    assert listed(found, "action", "missing", "extra", "match") == [("exists", ["a"], ["x"], False), ("created", None, None, None)]
    assert {tuple(r) for r in joins.distinct_permissions(kept).collect()} == {("a", "A"), ("b", "B"), ("c", "C")}
    assert joins.role_summary(found).first().created == 1


def test_totp(spark):
    df = spark.createDataFrame([("A@x.com", None, "s1", None, 1), ("b@x.com", "", "", [("totp", None, "s2")], 2), ("c@x.com", None, None, [], 3)], "email string, totp_secret string, secret string, mfa_factors array<struct<type:string,secret:string,totp_secret:string>>, record_number long")
    users = spark.createDataFrame([("u1", "a@X.com")], "id string, email string")
    planned = joins.plan_totp(joins.totp_from_json(df), users)
    assert listed(planned, "email_key", "secret", "outcome") == [("a@x.com", "s1", "enroll"), ("b@x.com", "s2", "user_not_found")]
    assert tuple(joins.totp_summary(planned).first()) == (2, 1, 0, 1, 1)


ERRORS = "recordNumber long, email string, userId string, errorType string, errorMessage string, httpStatus int, rawRow map<string,string>"


def errors(spark, *cells):
    return spark.createDataFrame([(i, *c) for i, c in enumerate(cells, 1)], ERRORS)


@pytest.mark.parametrize(
    ("kind", "message", "status", "user", "reason"),
    [
        ("user_create", "x", 429, None, "rate_limit"), ("org_resolution", "Not Found", 500, None, "org_not_found"), ("org_resolution", "x", None, None, "org_lookup_error"), ("org_resolution", "x", 400, None, "org_resolution_error"),
        ("membership_create", "x", 409, "u", "membership_duplicate"), ("membership_create", "x", 500, "u", "membership_error_user_exists"), ("membership_create", "x", 422, "u", "membership_validation_error"), ("membership_create", "x", 409, None, "conflict_duplicate"),
        ("user_create", "x", 503, None, "user_create_server_error"), ("user_create", "x", 409, None, "user_create_validation_error"), (None, "x", 500, None, "server_error"), (None, "x", 422, None, "validation_error"), (None, "x", None, None, "unknown_error"),
        (None, "x", 404, None, "unknown_non_retryable"), ("membership_create", "x", None, "u", "unknown_error"),
    ],
)
def test_retry_classes(spark, kind, message, status, user, reason):
    assert analyze.classify(errors(spark, ("e", user, kind, message, status, None))).first().retry_reason == reason


def test_groups_suggestions_and_retry_set(spark):
    raw = {"email": "x"}
    df = errors(
        spark, ("a@x.com", None, "user_create", "Invalid email format for a@x.com", 400, raw), ("b@x.com", None, "user_create", "Invalid email format for b@x.com", 400, raw), ("B@x.com", None, None, "down", 500, raw),
        ("b@X.com", None, None, "down", 500, raw), ("c@x.com", None, None, "down", 500, None),
    )
    made = analyze.groups(df)
    assert [(r["count"], r.severity, r.retryable) for r in analyze.top_groups(made).collect()] == [(2, "critical", False), (3, "medium", True)]
    assert {r.code for r in analyze.suggestions(made).collect()} == {"invalid_email", "server_error"}
    assert [r.recordNumber for r in analyze.retry_set(df).collect()] == [3] and analyze.retry_set(df, include_duplicates=True).count() == 2
    one = analyze.retryability(df).first()
    assert (one.total_errors, one.retryable_errors, one.non_retryable_errors, one.retryable_percent) == (5, 2, 2, 40.0)
    assert analyze.retryability(df.limit(0)).first().retryable_percent == 0.0
    assert analyze.retry_columns(["z", "email", "role_slugs", "metadata"]) == ["email", "metadata", "z", "role_slugs"]


def test_group_ids(spark):
    df = spark.createDataFrame([("p", None, None)], "p string, k string, s int")
    import hashlib

    assert df.select(analyze.group_id(F.col("p"), F.col("k"), F.col("s"))).first()[0] == hashlib.md5(b"unknown-none-p").hexdigest()[:12]


def test_record_numbers(spark):
    df = spark.range(1000).repartition(7)
    assert [r[0] for r in ordering.number_by(df, "id").where("record_number != id + 1").collect()] == []
    pairs = spark.createDataFrame([(k % 3, f"v{k:03}") for k in range(200)] + [(None, "x")], "a int, b string")
    found = [tuple(r) for r in ordering.number_by(pairs, "a", "b", buckets=7).orderBy("record_number").collect()]
    assert [r[2] for r in found] == list(range(1, 202)) and [r[:2] for r in found] == [(None, "x"), *sorted((k % 3, f"v{k:03}") for k in range(200))]
    assert ordering.number_by(pairs.limit(0), "a").count() == 0
    assert sorted(r.record_number for r in ordering.with_record_number(df).collect()) == list(range(1, 1001))


def test_empty_tables(spark):
    empty = rows(spark, "email org_id metadata first_name").limit(0)
    assert validate.summary(validate.validate(empty, True)).first().total_rows == 0
    assert dedupe.merge(empty).count() == 0 and load.outcomes(empty).count() == 0
    assert load.summary(load.outcomes(empty)).first().status == "Success"


def test_retry_tables_have_the_columns_of_the_first_row(spark):
    """In their order, however many; those of other rows are named, and added where that is asked for."""
    many = [f"c{k:04d}" for k in range(1500, 0, -1)]
    data = [(2, {"z2": "1", "email": "b", "a1": "2"}), (1, {"zz": "x", "email": "a", **dict.fromkeys(many, "v"), "a": "y"}), (3, {"b3": "3", "z2": "4"})]
    texts = spark.createDataFrame([(n, json.dumps(row)) for n, row in data], "recordNumber long, raw string")
    again = texts.select("recordNumber", F.from_json("raw", "map<string,string>").alias("rawRow")).repartition(3)  # keeps the order of keys
    table, others = analyze.retry_table(again)
    assert table.columns == ["email", "zz", *many, "a"] and others == ["z2", "a1", "b3"] and table.count() == 3
    assert analyze.retry_table(again, every=True)[0].columns == ["email", "zz", *many, "a", "z2", "a1", "b3"]
    assert analyze.retry_table(again.limit(0)) == (None, [])


@pytest.mark.parametrize("size", [4, 7, 1000])
def test_moving_averages_go_over_ranges(spark, size):
    values = [(k * 3, float(k * k % 17)) for k in range(50)]
    made = ordering.moving_average(spark.createDataFrame(values, "at long, v double").repartition(4), "v", "at", size=size).orderBy("at").collect()
    plain = [v for _, v in values]
    assert [r.moving for r in made] == pytest.approx([sum(plain[max(0, k - 4) : k + 1]) / len(plain[max(0, k - 4) : k + 1]) for k in range(50)])
