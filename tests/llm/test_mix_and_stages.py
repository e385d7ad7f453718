"""The mix's flow and selection, and the pipeline's stages on tables with odd columns and many repeated rows."""

import random
import time
from collections import defaultdict

import pytest
from brute import WORD
from pyspark.sql import functions as F

from rosterforge.llm import exact_dedup, mixing, near_dups, quality_model


def test_flow_of_very_many_patterns():
    rng = random.Random(4)
    patterns = {str(k): (["a", "b"] if k % 3 else [rng.choice("ab")], rng.randrange(1, 50)) for k in range(60_000)}
    total = sum(w for _, w in patterns.values())
    began = time.time()
    taken = mixing.route(patterns, {"a": total * 0.9, "b": total * 0.5})
    assert time.time() - began < 30 and sum(taken.values()) == round(total * 0.9) + round(total * 0.5)


def nothing(patterns, quota, most):
    return dict.fromkeys(patterns, 0)


def test_the_flow_decides_for_single_sources_too(spark):
    rows = [(i, "a b c", f"s{i % 40}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert mixing.mix_documents(docs, flow=nothing).where("taken > 0").count() == 0
    assert mixing.apply_mix(docs, flow=nothing).count() == 0 and mixing.apply_mix(docs).count() > 0


def plain_selection(rows, quota, most=3, rounds=5):
    """{(doc_id, at): words taken}: whole rounds of a pattern's rows, then those whose middle is within the rest in the order of their draws, then single rows that bring the sum nearer."""
    taken = {}
    by = defaultdict(list)
    for doc_id, pattern, size, draw, at in rows:
        by[pattern].append((draw % (1 << 64), at, size, doc_id, draw))
    for pattern, own in by.items():
        words = sum(r[2] for r in own)
        times, rest = divmod(quota[pattern], max(1, words))
        more, before = {}, 0
        for _, at, size, _, _ in sorted(own):
            more[at] = rest > 0 and before + size / 2 <= rest
            before += size
        missing, turned = rest - sum(r[2] for r in own if more[r[1]]), set()
        for _ in range(rounds):
            can = [(abs(s - abs(missing)), draw, at, s) for _, at, s, _, draw in own if at not in turned and ((missing > 0 and not more[at] and times < most) or (missing < 0 and more[at])) and abs(s - abs(missing)) < abs(missing)]
            if missing == 0 or not can:
                break
            _, _, at, size = min(can)
            turned.add(at)
            missing -= -size if more[at] else size
        for _, at, size, doc_id, _ in own:
            taken[doc_id] = size * (times + (more[at] != (at in turned)))
    return taken


@pytest.mark.parametrize("overlapping", [False, True])
def test_selected_rows(spark, overlapping):
    rng = random.Random(6)
    data = [(i, "w " * rng.choice([0, 1, 3, 20, 90]), rng.choice([["a"], ["b"], ["c"], ["a", "b"] if overlapping else ["a"], [None]])) for i in range(400)]
    docs = spark.createDataFrame(data, "doc_id long, text string, sources array<string>").coalesce(1)
    pattern = {i: tuple(sorted(s, key=lambda x: (x is None, x or ""))) for i, _, s in data}
    draws = {r.doc_id: r.d for r in docs.select("doc_id", F.xxhash64("doc_id", "text", F.lit(mixing.SEED)).alias("d")).collect()}
    solved = {}

    def flow(patterns, quota, most):
        return {p: round(1.3 * w) if "a" in p else w // 3 for p, (_, w) in patterns.items()}

    made, _ = mixing.mix(docs, F.col("sources"), flow=flow)
    rows = made.collect()
    names = {r.doc_id: r.pattern for r in rows}
    words = defaultdict(int)
    for i, t, _ in data:
        words[names[i]] += len(WORD.findall(t))
    solved = flow({p: (None, w) for p, w in words.items()}, None, 3)
    assert len({(pattern[i], p) for i, p in names.items()}) == len(set(names.values()))
    assert {r.doc_id: r.taken for r in rows} == plain_selection([(i, names[i], len(WORD.findall(t)), draws[i], k) for k, (i, t, _) in enumerate(data)], solved)


CLASHING = ("__id", "__none", "__hash", "__row", "__score", "__own", "__first", "__salt", "aside_0", "bucket", "keep_id")


def test_stages_leave_columns_of_any_name_alone(spark):
    """Also with null and very long texts."""
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = [(i, t, "en", "s") for i, t in enumerate(["one text of some words", None, "", "w " * 30_000, "x" * 50_000, "another text of other words", "One text of some words"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").select("*", *[F.concat(F.lit(f"{c} "), F.col("doc_id")).alias(c) for c in CLASHING])
    for stage in (exact_dedup.drop_copies, near_dups.keep_one_each, mixing.apply_mix, lambda d: quality_model.keep_good(d, labels)):
        made = stage(docs)
        assert made.columns == docs.columns
        found = made.collect()
        assert found and all(r[c] == f"{c} {r.doc_id}" for r in found for c in CLASHING)
    assert sorted(r.doc_id for r in exact_dedup.drop_copies(docs).collect()) == [2, 3, 4, 5, 6]


def test_rows_that_repeat_very_often(spark):
    docs = spark.range(3000).select(F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 2500, "a b c d e f g").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"), F.lit("x").alias("__first"))
    for stage in (exact_dedup.drop_copies, near_dups.keep_one_each):
        assert stage(docs).count() == 501
