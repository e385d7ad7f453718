"""JSON objects in text columns.

Objects are read as map<string,string>, which keeps the order of keys: by string_map() with texts without quotes, or, where values must keep
their type when they are written again, by token_map() with each value's JSON text. Nested values are JSON text in both.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import is_blank, trimmed

MAP = "map<string,string>"


def once(make: Callable[..., Column], *values: Column) -> Column:
    """make(*values), where each value is worked out once a row however often make has it. An expression that stands in another one several times is worked out as often, and nested ones multiply."""
    bound = F.array(F.struct(*[v.alias(f"v{k}") for k, v in enumerate(values)]))
    return F.element_at(F.transform(bound, lambda x: make(*[x[f"v{k}"] for k in range(len(values))])), 1)


def is_json(c: Column) -> Column:
    """Whether a text is JSON; null for null."""
    return F.try_parse_json(c).isNotNull()


def is_object(c: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT"), F.lit(False))


def string_map(c: Column) -> Column:
    """A JSON object's values as texts: strings without quotes, others as JSON; null for what is no object."""
    return once(lambda c: F.when(is_object(c), F.from_json(c, MAP)), c)


def quoted(c: Column) -> Column:
    """A text as a JSON string."""
    return once(lambda listed: F.substring(listed, F.lit(2), F.length(listed) - 2), F.to_json(F.array(c)))


def _entries(c: Column) -> Column:
    """(e, kind) of a JSON object's entries: key and value as text, and the value's type. Parsed once for all of them."""

    def of(c: Column) -> Column:
        kinds = F.transform(F.map_entries(F.from_json(c, "map<string,variant>")), lambda e: F.schema_of_variant(e["value"]))
        return F.when(is_object(c), F.arrays_zip(F.map_entries(F.from_json(c, MAP)).alias("e"), kinds.alias("kind")))

    return once(of, c)


def token_map(c: Column) -> Column:
    """A JSON object's values as JSON texts, each of its own type and nested ones with the order of their keys; null for what is no object. Numbers are written as briefly as they can be: 1.0 is 1."""

    def token(x: Column) -> Column:
        kind, value = x["kind"], x["e"]["value"]
        number = F.regexp_replace(F.regexp_replace(value, r"^(-?\d+)\.0+$", "$1"), "^-0$", "0")
        made = F.when(value.isNull(), "null").when(kind == "STRING", quoted(value)).when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), number).otherwise(value)
        return F.struct(x["e"]["key"].alias("key"), made.alias("value"))

    return F.map_from_entries(F.transform(_entries(c), token))


def is_empty_token(token: Column) -> Column:
    """Whether a value's JSON text is null, false, the empty text or the number 0; the texts "0" and "false" are values."""
    return token.isNull() | token.isin("null", "false", '""') | token.rlike(r"^-?0(\.0*)?([eE].*)?$")


def object_of_tokens(entries: Column) -> Column:
    """The JSON object of an array of structs (key, value) whose values are JSON texts; null if there are none."""
    def of(entries: Column) -> Column:
        parts = F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(":"), F.coalesce(e["value"], F.lit("null"))))
        return F.when(F.size(entries) > 0, F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")))

    return once(of, entries)


def nested_entries(c: Column) -> Column:
    """The entries (key, value) of a JSON object whose values are arrays or objects; null for what is no object."""
    nested = F.filter(_entries(c), lambda x: x["kind"].rlike("^(ARRAY|OBJECT)"))
    return F.transform(nested, lambda x: x["e"])


def nested_keys(c: Column) -> Column:
    """The keys of a JSON object whose values are arrays or objects."""
    return F.transform(nested_entries(c), lambda e: e["key"])


@F.pandas_udf(StringType())
def stringify_nested(texts: pd.Series) -> pd.Series:
    """A JSON object in which arrays and objects are JSON texts and all else keeps type and order; null for what has no such value. By Arrow batches, as no built-in keeps both."""

    def one(text):
        try:
            found = json.loads(text)
        except (TypeError, ValueError):
            return None
        if not isinstance(found, dict) or not any(isinstance(v, (dict, list)) for v in found.values()):
            return None
        compact = lambda v: json.dumps(v, separators=(",", ":"), ensure_ascii=False)
        return compact({k: compact(v) if isinstance(v, (dict, list)) else v for k, v in found.items()})

    return texts.map(one)


def to_json_string(c: Column) -> Column:
    """JSON as it is; any other text as a JSON string; null if blank."""
    return once(lambda c: F.when(is_blank(c), None).when(is_json(c), c).otherwise(quoted(c)), c)


def object_or_null(m: Column) -> Column:
    """A map as a JSON object; null if it has no entries."""
    return once(lambda m: F.when(F.size(m) > 0, F.to_json(m)), m)


# Keys that clash with the sink's own.
RESERVED = ("organization_id", "organization_name", "org_id", "org_name", "organizationId", "organizationName")


def sanitised(m: Column, prefix: str = "auth0_") -> Column:
    """A map with texts for all values ('' for null), reserved keys renamed."""
    renamed = F.transform_keys(m, lambda k, v: F.when(k.isin(*RESERVED), F.concat(F.lit(prefix), k)).otherwise(k))
    return F.transform_values(renamed, lambda k, v: F.coalesce(v, F.lit("")))


def merged(left: Column, right: Column) -> Column:
    """Both maps' entries; where both have a key, the right one's value, at the left one's place. Null counts as empty."""
    none = F.create_map().cast(MAP)

    def of(a: Column, b: Column) -> Column:
        mine = F.transform(F.map_entries(a), lambda e: F.struct(e["key"].alias("key"), F.when(F.map_contains_key(b, e["key"]), F.element_at(b, e["key"])).otherwise(e["value"]).alias("value")))
        more = F.filter(F.map_entries(b), lambda e: ~F.map_contains_key(a, e["key"]))
        return F.map_from_entries(F.concat(mine, F.transform(more, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))))

    return once(of, F.coalesce(left, none), F.coalesce(right, none))


def org_from_metadata(user_metadata: Column, app_metadata: Column, id_field: str | None = None, name_field: str | None = None) -> Column:
    """struct(org_id, org_name) from the first of two metadata texts that has either; own field names before the usual ones."""

    def value(c: Column, fields: list[str]) -> Column:
        return F.coalesce(*[once(lambda x: F.when(~x.isin("", "false"), x), F.get_json_object(c, f"$.{f}")) for f in fields])

    def of(c: Column) -> Column:
        found = lambda org_id, name: F.when(org_id.isNotNull() | name.isNotNull(), F.struct(org_id.alias("org_id"), name.alias("org_name")))
        own = [value(c, [f for f in fields if f]) for fields in ((id_field, "organization_id", "org_id", "organizationId"), (name_field, "organization_name", "org_name", "organizationName"))]
        return once(found, *own)

    return once(lambda user, app: F.coalesce(once(of, user), once(of, app)), user_metadata, app_metadata)


def flattened(c: Column) -> Column:
    """Loader's view of metadata: a map of texts; empty for JSON that is no object, null for null, blank and what is no JSON."""
    return once(lambda text: F.when(is_object(text), string_map(text)).when(is_json(text) & (text != "null"), F.create_map().cast(MAP)), trimmed(c))
