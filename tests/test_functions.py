import pytest
from pyspark.sql import functions as F

from rosterforge.functions import jsons, text, transformers


def values(spark, f, *cells):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("c")).alias("x")).collect()]


def test_trim_takes_all_white_space(spark):
    assert values(spark, text.trimmed, "\t a b\n", " x﻿", "", None) == ["a b", "x", "", None]


def test_blank(spark):
    assert values(spark, text.is_blank, None, "", " \t", "x") == [True, True, True, False]


def test_booleans(spark):
    cells = ("true", " YES ", "1", "y", "False", "0", "no", "N", "maybe", "", "t", None)
    assert values(spark, text.parse_bool, *cells) == [True] * 4 + [False] * 4 + [None] * 4


@pytest.mark.parametrize(
    ("strategy", "name", "first", "last"),
    [
        ("first-space", "Ann Lee", "Ann", "Lee"), ("first-space", "Ann Mary Lee", "Ann", "Mary Lee"), ("last-space", "Ann Mary Lee", "Ann Mary", "Lee"), ("first-name-only", "Ann Lee", "Ann Lee", ""),
        ("first-space", "Ann", "Ann", ""), ("last-space", "Ann", "Ann", ""), ("first-space", "  ", "", ""), ("first-space", None, "", ""), ("first-space", "Ann  Lee", "Ann", " Lee"),
    ],
)
def test_name_splits(spark, strategy, name, first, last):
    assert values(spark, lambda c: F.struct(*text.split_display_name(c, strategy)), name) == [(first, last)]


def test_name_tokens(spark):
    assert values(spark, lambda c: F.struct(text.first_token(c), text.other_tokens(c)), " Ann  Mary Lee ", "Ann") == [("Ann", "Mary Lee"), ("Ann", "")]


def test_epoch(spark):
    assert values(spark, text.epoch_ms_to_iso, "1648020042135", "12abc", "x", None) == ["2022-03-23T07:20:42.135Z", "1970-01-01T00:00:00.012Z", None, None]


def test_hash_algorithm(spark):
    assert values(spark, text.hash_algorithm, "$2b$10$x", "a" * 32, "b" * 64, "c" * 128, "p:q", "zzz") == ["bcrypt", "md5", "sha256", "sha512", "pbkdf2", "bcrypt"]


def test_lists(spark):
    assert values(spark, text.split_list, '["a", " b ", ""]', "a, b,,c ", "", None, "[broken", '["x"') == [["a", "b"], ["a", "b", "c"], [], None, ["[broken"], ['["x"']]


def test_message_patterns(spark):
    cells = (
        "User john.doe@example.com exists", "id 123E4567-e89b-12d3-a456-426614174000 gone", "org_01ABCDEFGHIJKLMNOPQRST and user_01ABCDEFGHIJKLMNOPQRST", "code 12345 and 500", "a \n  b ",
    )
    assert values(spark, text.message_pattern, *cells) == ["User <EMAIL> exists", "id <UUID> gone", "<ORG_ID> and <USER_ID>", "code <NUMBER> and 500", "a b"]


def test_display_name(spark):
    assert values(spark, text.display_name, "users:read", "org_ADMIN-x.y") == ["Users Read", "Org ADMIN X Y"]


def test_json_helpers(spark):
    assert values(spark, jsons.is_object, '{"a":1}', "[1]", "3", "x", None) == [True, False, False, False, False]
    assert values(spark, jsons.stringify_nested, '{"a":[1,2],"b":{"c":"é"},"d":1.0,"e":true}', '{"a":1}', "x") == ['{"a":"[1,2]","b":"{\\"c\\":\\"é\\"}","d":1.0,"e":true}', None, None]
    assert values(spark, jsons.nested_keys, '{"a":[1],"b":"[x]","c":{"d":1},"e":null}', "x") == [["a", "c"], None]
    assert values(spark, jsons.to_json_string, '{"a": 1}', 'say "hi"', " ") == ['{"a": 1}', '"say \\"hi\\""', None]


def test_flattened_metadata(spark):
    assert values(spark, jsons.flattened, '{"a":[1],"b":"x","c":2}', "3", "null", "bad", "") == [{"a": "[1]", "b": "x", "c": "2"}, {}, None, None, None]


def test_merged_maps_keep_order_and_right_wins(spark):
    df = spark.sql("select map('a','1','b','2') as x, map('b','3','c','4') as y")
    assert list(df.select(jsons.merged(F.col("x"), F.col("y"))).first()[0].items()) == [("a", "1"), ("b", "3"), ("c", "4")]


def test_sanitised_renames_reserved(spark):
    df = spark.sql("select map('org_id','1','x',cast(null as string)) as m")
    assert df.select(jsons.sanitised(F.col("m"))).first()[0] == {"auth0_org_id": "1", "x": ""}


def test_transformers_registry(spark):
    assert transformers.names() == sorted(["lowercase_trim", "to_boolean", "to_json_string", "uppercase", "trim", "split_name", "merge_metadata", "identity"])
    with pytest.raises(KeyError):
        transformers.get("nothing")
    transformers.register("shout", lambda c: F.concat(c, F.lit("!")))
    assert transformers.has("shout") and values(spark, transformers.get("shout"), "x") == ["x!"]
    transformers._REGISTRY.pop("shout")


def test_unique_suffix_and_durations(spark):
    assert values(spark, lambda c: text.unique_suffix(c, "7"), "a@b.c", "id", "") == ["a+7@b.c", "id_7", None]
    assert [text.format_duration(x) for x in (5_000, 65_000, 3_725_000)] == ["5s", "1m 5s", "1h 2m 5s"]
    assert [text.rough_duration(x) for x in (5_000, 125_000, 3_900_000)] == ["5s", "2m", "1h 5m"]


def test_api_errors(spark):
    df = spark.sql("select 'c' as code, array(named_struct('code', 'a', 'message', 'x'), named_struct('code', null, 'message', '')) as some, cast(array() as array<struct<code:string,message:string>>) as none, cast(null as string) as gone")
    assert tuple(df.select(text.api_error_text(F.col("code"), F.col("some")), text.api_error_text(F.col("code"), F.col("none")), text.api_error_text(F.col("gone"), F.col("none"))).first()) == ("a: x; unknown", "c", "unknown_error")


def test_json_expressions_do_not_multiply(spark):
    """Merged maps are worked out once a row each, however deep they are nested."""
    df = spark.createDataFrame([('{"a":1,"b":"x"}', '{"b":2}')], "x string, y string")
    made = jsons.merged(jsons.merged(jsons.merged(jsons.string_map(F.col("x")), jsons.string_map(F.col("y"))), jsons.string_map(F.col("x"))), jsons.string_map(F.col("y")))
    one = df.select(jsons.object_or_null(made).alias("m"))
    assert one.first().m == '{"a":"1","b":"2"}'
    assert one._jdf.queryExecution().optimizedPlan().toString().count("from_json") + one._jdf.queryExecution().optimizedPlan().toString().count("JsonToStructs") <= 8
    own = df.select(jsons.org_from_metadata(F.to_json(F.struct("x")), F.to_json(F.struct("y")), "t").alias("o"))
    assert own.first().o is None and own._jdf.queryExecution().optimizedPlan().toString().count("to_json") <= 4
