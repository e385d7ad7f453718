"""Declarative mapping of source tables to user rows by profiles."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsons, text, transformers
from ..schema import KNOWN_COLUMNS, RECORD, require_columns


@dataclass(frozen=True)
class FieldMapping:
    source: str
    target: str
    transformer: str | None = None
    default: str | None = None
    skip_if_blank: bool = False


@dataclass(frozen=True)
class MetadataMapping:
    sources: tuple[str, ...]
    target: str = "metadata"
    prefix: str = ""
    static: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Profile:
    name: str
    fields: tuple[FieldMapping, ...]
    metadata: MetadataMapping | None = None
    description: str = ""

    def sources(self) -> set[str]:
        return {m.source for m in self.fields} | set(self.metadata.sources if self.metadata else ())


AUTH0 = Profile(
    "auth0",
    (
        FieldMapping("email", "email", "lowercase_trim"), FieldMapping("given_name", "first_name", "trim"), FieldMapping("family_name", "last_name", "trim"),
        FieldMapping("email_verified", "email_verified", "to_boolean"), FieldMapping("user_id", "external_id", "trim"),
        FieldMapping("org_id", "org_external_id", "trim", skip_if_blank=True), FieldMapping("org_name", "org_name", "trim", skip_if_blank=True),
        FieldMapping("password_hash", "password_hash", skip_if_blank=True), FieldMapping("password_hash_type", "password_hash_type", skip_if_blank=True),
    ),
    MetadataMapping(("user_metadata", "app_metadata"), prefix="auth0_", static={"_provider": "auth0"}),
    "Auth0 user export",
)
BUILT_IN = {p.name: p for p in (AUTH0,)}


def built_in_names() -> list[str]:
    return sorted(BUILT_IN)


def validate_profile(found: dict) -> list[str]:
    """What is wrong with a profile's JSON form: nothing for a good one."""
    wrong = [f"{k} is missing" for k in ("name", "mappings") if not found.get(k)]
    mappings = found.get("mappings") or []
    if not isinstance(mappings, list):
        return [*wrong, "mappings is no list"]
    for i, m in enumerate(mappings):
        wrong += [f"mapping {i}: {k} is missing" for k in ("sourceField", "targetField") if not m.get(k)]
        if m.get("transformer") and not transformers.has(m["transformer"]):
            wrong.append(f"mapping {i}: unknown transformer {m['transformer']}")
    if (meta := found.get("metadataMapping")) and not isinstance(meta.get("sourceFields"), list):
        wrong.append("metadataMapping: sourceFields is no list")
    return wrong


def profile_from_json(found: dict) -> Profile:
    if wrong := validate_profile(found):
        raise ValueError("; ".join(wrong))
    fields = tuple(FieldMapping(m["sourceField"], m["targetField"], m.get("transformer"), m.get("defaultValue"), bool(m.get("skipIfBlank"))) for m in found["mappings"])
    meta = found.get("metadataMapping")
    metadata = MetadataMapping(tuple(meta["sourceFields"]), meta.get("targetField", "metadata"), meta.get("fieldPrefix") or "", {k: str(v) for k, v in (meta.get("staticMetadata") or {}).items()}) if meta else None
    return Profile(found["name"], fields, metadata, found.get("description", ""))


def load_profile(name_or_path: str) -> Profile:
    if name_or_path in BUILT_IN:
        return BUILT_IN[name_or_path]
    with open(name_or_path, encoding="utf-8") as f:
        return profile_from_json(json.load(f))


def field_column(m: FieldMapping, columns: list[str]) -> Column:
    """A source column mapped: blank gives the default (or null), else the transformer decides."""
    if m.source not in columns:
        return F.lit(None if m.skip_if_blank else m.default).cast("string")
    c = F.col(m.source).cast("string")
    made = transformers.get(m.transformer)(c) if m.transformer else c
    return F.when(text.is_blank(c), F.lit(None if m.skip_if_blank else m.default)).otherwise(made)


def metadata_column(m: MetadataMapping, columns: list[str]) -> Column:
    """Static entries, then each source's: the keys of a JSON object with the prefix, other text that is no JSON under the prefixed column name; JSON that is no object goes. Later entries win; values keep their JSON types."""
    entries = F.create_map(*[F.lit(x) for k, v in m.static.items() for x in (k, json.dumps(v, ensure_ascii=False, separators=(",", ":")))]).cast(jsons.MAP) if m.static else F.create_map().cast(jsons.MAP)
    for source in m.sources:
        if source in columns:
            c = F.col(source)
            own = F.transform_keys(jsons.token_map(c), lambda k, v: F.concat(F.lit(m.prefix), k))
            raw = F.create_map(F.lit(m.prefix + source), jsons.quoted(c))
            entries = jsons.merged(entries, F.when(~text.is_blank(c), F.when(jsons.is_object(c), own).when(~jsons.is_json(c), raw)))
    return jsons.object_of_tokens(F.map_entries(entries))


def apply_profile(df: DataFrame, profile: Profile) -> DataFrame:
    """User rows: the profile's target columns in the known order, then others; the record number goes along."""
    made = {m.target: field_column(m, df.columns) for m in profile.fields}
    if profile.metadata:
        made[profile.metadata.target] = metadata_column(profile.metadata, df.columns)
    ordered = [c for c in KNOWN_COLUMNS if c in made and c != "role_slugs"] + [c for c in made if c not in KNOWN_COLUMNS]
    return df.select(*([RECORD] if RECORD in df.columns else []), *[made[c].alias(c) for c in ordered])


def unmapped_counts(df: DataFrame, profile: Profile) -> DataFrame:
    """(column, rows) of each source column that the profile does not use: one count serves all."""
    unused = [c for c in df.columns if c not in profile.sources() and c != RECORD]
    n = df.agg(F.count("*").alias("rows"))
    return n.select(F.explode(F.array(*[F.lit(c) for c in unused]).cast("array<string>")).alias("column"), "rows")


def mapping_errors(mapped: DataFrame, most: int = 1000) -> DataFrame:
    """Rows without an email. More than `most` of them mean that the profile is the wrong one (see too_many_errors)."""
    require_columns(mapped, ["email"])
    return mapped.where(text.is_blank(F.col("email")))


def too_many_errors(errors: DataFrame, most: int = 1000) -> bool:
    return errors.limit(most + 1).count() > most
