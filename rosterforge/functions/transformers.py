"""Named transformers of mapping profiles: Column to Column. More can be registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import jsons, text

Transformer = Callable[[Column], Column]
_REGISTRY: dict[str, Transformer] = {}


def register(name: str, f: Transformer) -> None:
    _REGISTRY[name] = f


def get(name: str) -> Transformer:
    if name not in _REGISTRY:
        raise KeyError(f"unknown transformer {name}; known: {', '.join(names())}")
    return _REGISTRY[name]


def names() -> list[str]:
    return sorted(_REGISTRY)


def has(name: str) -> bool:
    return name in _REGISTRY


register("lowercase_trim", lambda c: F.lower(text.filled(c)))
register("to_boolean", text.bool_text)
register("to_json_string", jsons.to_json_string)
register("uppercase", lambda c: F.upper(text.unless_blank(c)))
register("trim", text.filled)
register("split_name", text.first_token)
register("merge_metadata", lambda c: F.nullif(c, F.lit("{}")))
register("identity", text.unless_blank)
