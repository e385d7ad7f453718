"""Logs that are added one by one give what one pass over all of them gives."""

import random

from pyspark.sql import functions as F

from rosterforge.operators import analyze, error_store

SCHEMA = "line long, recordNumber long, email string, userId string, errorType string, errorMessage string, httpStatus int, rawRow map<string,string>"


def log(spark, seed, n=120):
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        status = rnd.choice([None, 400, 409, 429, 500])
        rows.append((k, rnd.choice([None, k]), rnd.choice([None, "", f"u{rnd.randrange(40)}@x"]), rnd.choice([None, "id"]), rnd.choice(["user_create", "org_resolution", None]), f"said {rnd.randrange(4)} {seed if rnd.random() < 0.1 else ''}", status, rnd.choice([None, {"email": "x"}])))
    return spark.createDataFrame(rows, SCHEMA)


def listed(df):
    return sorted(map(str, df.collect()))


def test_logs_merge_to_one_pass(spark, tmp_path):
    folder, logs = str(tmp_path / "store"), [log(spark, k) for k in (1, 2, 3)]
    assert error_store.groups(spark, folder).count() == 0 and error_store.retryability(spark, folder).first().total_errors == 0
    for k, df in enumerate(logs, 1):
        assert error_store.add_log(df, folder) and not error_store.add_log(df.repartition(3), folder)
        every = logs[0].withColumn("line", F.col("line") + 1_000)
        for j, other in enumerate(logs[1:k], 2):
            every = every.union(other.withColumn("line", F.col("line") + 1_000 * j))
        every = every.cache()
        place = F.col("first_log") * 1_000 + F.col("first_record")
        assert listed(error_store.groups(spark, folder).withColumn("first_record", place).drop("first_log")) == listed(analyze.groups(every, "line"))
        flat = error_store.examples(spark, folder).select("group_id", F.transform("records", lambda x: x["log"] * 1_000 + x["at"]).alias("records"))
        assert listed(flat) == listed(analyze.examples(every, "line"))
        assert listed(error_store.affected_emails(spark, folder)) == listed(analyze.affected_emails(every, "line"))
        assert listed(error_store.histogram(spark, folder)) == listed(analyze.histogram(every))
        assert error_store.retryability(spark, folder).first() == analyze.retryability(every).first()
        every.unpersist()


def test_a_log_that_was_not_added_as_a_whole_does_not_count(spark, tmp_path):
    folder = str(tmp_path / "store")
    error_store.add_log(log(spark, 1), folder)
    before = listed(error_store.groups(spark, folder))
    analyze.groups(log(spark, 2), "line").withColumn("log", F.lit(2)).select(*[f.split(" ")[0] for f in error_store.TABLES["groups"].split(", ")]).write.parquet(f"{folder}/groups/log-000002")
    assert listed(error_store.groups(spark, folder)) == before
    assert error_store.add_log(log(spark, 3), folder) and error_store.retryability(spark, folder).first().total_errors == 240
    assert error_store.groups(spark, folder).agg(F.sum("count")).first()[0] == 240


def test_a_log_is_classed_once(spark, tmp_path, monkeypatch):
    seen, pattern = [], analyze.text.message_pattern
    monkeypatch.setattr(analyze.text, "message_pattern", lambda c: seen.append(1) or pattern(c))
    assert error_store.add_log(log(spark, 9), str(tmp_path / "once"), "line") and len(seen) == 1
