"""Streams of user rows: outcomes do not depend on how rows are cut into micro-batches."""

import random
import time

import pytest
from pyspark.sql import functions as F

from rosterforge.operators import load
from rosterforge.streaming import incremental, loads

SCHEMA = "record_number long, email string, org_id string, org_external_id string, metadata string, role_slugs string"


def people(n, seed=1):
    """Some rows without email, with bad metadata or two organisations, before and between good ones of the same emails."""
    rnd = random.Random(seed)
    out = []
    for k in range(1, n + 1):
        email = rnd.choice(["", "a@x", "A@X ", "b@x", f"u{k % 9}@x", f"u{k % 9}@x"])
        bad = rnd.random() < 0.3
        org = rnd.choice([None, "o1", "o2"])
        out.append((k, email, org, "e1" if bad and org else None, "{bad" if bad and not org else "", rnd.choice(["admin", "admin,member", ""])))
    return out


def run(spark, tmp_path, batches, **options):
    """The outcomes of the batches, each a file of its own, some in one run of the query and the rest in the next."""
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (batches[: len(batches) // 2], batches[len(batches) // 2 :]):
        for rows in part:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        if part:
            query = loads.load_stream(incremental.stream_users(spark, source, SCHEMA, files_each=1), sink, str(tmp_path / "cp"), **options)
            if options.get("ttl_ms"):  # goes on until it is stopped
                for _ in range(60):
                    if query.exception() or sum(p["numInputRows"] for p in query.recentProgress) >= sum(map(len, part)):
                        break
                    time.sleep(1)
                query.stop()
            else:
                assert query.awaitTermination(90) is not False
            assert query.exception() is None
    return sorted(tuple(r) for r in spark.read.parquet(sink).drop("batch").collect())


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Each micro-batch opens a state store and a worker for each partition."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("sizes", [[40], [1, 22, 17]])
def test_outcomes_are_those_of_one_table(spark, tmp_path, sizes):
    rows = people(40)
    cuts = [sum(sizes[:k]) for k in range(len(sizes) + 1)]
    got = run(spark, tmp_path, [rows[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])
    assert got == sorted(tuple(r) for r in load.outcomes(spark.createDataFrame(rows, SCHEMA)).collect())


def test_a_failed_row_does_not_make_the_user(spark, tmp_path):
    rows = [(1, "a@x", "o1", "e1", "", ""), (2, "a@x", "o1", None, "", "r"), (3, "a@x", "o1", None, "", "r"), (4, "a@x", "o2", None, "", "r,s")]
    got = {r[0]: r[5:] for r in run(spark, tmp_path, [rows[:1], rows[1:2], rows[2:]])}
    assert got == {1: (None, None, None, 0), 2: ("dry-run-user-a@x", "created", "created", 1), 3: ("dry-run-user-a@x", "duplicate", "duplicate", 0), 4: ("dry-run-user-a@x", "duplicate", "created", 2)}


def test_organisations_are_joined_and_state_ends(spark, tmp_path):
    orgs = spark.createDataFrame([("o9", "e9")], "id string, external_id string")
    rows = [(1, "a@x", None, "e9", "", ""), (2, "a@x", None, "gone", "", ""), (3, "a@x", None, "e9", "", "")]
    got = {r[0]: (r[2], r[3], r[6], r[7]) for r in run(spark, tmp_path, [rows[:1], rows[1:]], orgs=orgs, ttl_ms=3_600_000)}
    assert got == {1: ("o9", None, "created", "created"), 2: (None, "org_resolution", None, None), 3: ("o9", None, "duplicate", "duplicate")}


def test_rows_are_not_moved_for_the_state(spark, tmp_path):
    """Spark keeps a count for each user and membership, which tasks add up before anything is dealt out; no row goes through a function's state. A row that comes later makes nothing, whatever its number is."""
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [[(k, "a@x", "o1", None, "", "r") for k in range(101, 401)], [(k, "a@x", f"o{k % 2}", None, "", "r") for k in range(1, 101)]]
    seen = []
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        query = loads.load_stream(incremental.stream_users(spark, source, SCHEMA, files_each=1), sink, str(tmp_path / "cp"))
        assert query.awaitTermination(90) is not False
        seen += [(o["operatorName"], o["numRowsTotal"]) for p in query.recentProgress if p["numInputRows"] for o in p["stateOperators"]]
    assert seen == [("stateStoreSave", 2), ("stateStoreSave", 3)]
    found = spark.read.parquet(sink)
    assert found.count() == 400 and [r.record_number for r in found.where("user_outcome = 'created'").collect()] == [101]
    assert sorted((r.record_number, r.org, r.roles_assigned) for r in found.where("membership_outcome = 'created'").collect()) == [(2, "o0", 1), (101, "o1", 1)]
