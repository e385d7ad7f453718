"""Scalar functions over string columns. Each takes and gives Columns and stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words for booleans.
TRUE_WORDS, FALSE_WORDS = ("true", "1", "yes", "y"), ("false", "0", "no", "n")


def trimmed(c: Column) -> Column:
    """Without white space, any that Unicode has, and byte-order marks at both ends. SQL's trim() takes spaces only."""
    return F.regexp_replace(c, r"(?U)^[\s﻿]+|[\s﻿]+$", "")


def is_blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(trimmed(c) == "", F.lit(True))


def filled(c: Column) -> Column:
    """The trimmed text, null if blank."""
    return F.nullif(trimmed(c), F.lit(""))


def unless_blank(c: Column) -> Column:
    """The text as it is, null if blank."""
    return F.when(~is_blank(c), c)


def parse_bool(c: Column) -> Column:
    """true/1/yes/y and false/0/no/n in any case, else null."""
    word = F.lower(trimmed(c))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def bool_text(c: Column) -> Column:
    return parse_bool(c).cast("string")


def email_key(c: Column) -> Column:
    """What two rows of one user share."""
    return F.lower(trimmed(c))


def first_token(c: Column) -> Column:
    return F.split(filled(c), r"\s+")[0]


def other_tokens(c: Column) -> Column:
    """All but the first token, one space between them."""
    parts = F.split(filled(c), r"\s+")
    return F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), " ")


def split_display_name(c: Column, strategy: str = "first-space") -> tuple[Column, Column]:
    """First and last name, '' where there is none. Strategies: first-space, last-space, first-name-only. What stands after the space is not trimmed again."""
    name = F.coalesce(trimmed(c), F.lit(""))
    if strategy == "first-space":
        at = F.instr(name, " ")
    elif strategy == "last-space":
        at = F.when(F.instr(name, " ") > 0, F.length(name) - F.length(F.substring_index(name, " ", -1))).otherwise(0)
    else:
        at = F.lit(0)
    return F.when(at > 0, F.substring(name, F.lit(1), at - 1)).otherwise(name), F.when(at > 0, F.substring(name, at + 1, F.length(name))).otherwise("")


def epoch_ms_to_iso(c: Column) -> Column:
    """The leading integer of a text, in milliseconds since 1970, as an ISO time in UTC; null if there is none. The session's time zone must be UTC."""
    ms = F.nullif(F.regexp_extract(c, r"^\s*([+-]?\d+)", 1), F.lit("")).try_cast("long")
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def standard_base64(c: Column) -> Column:
    """URL-safe base64 in the standard alphabet."""
    return F.translate(c, "-_", "+/")


def scrypt_phc(password_hash: Column, salt: Column, signer_key: str, salt_separator: str, rounds: int, mem_cost: int) -> Column:
    """The PHC text of a modified-scrypt hash. Null if a part is."""
    key, separator = (F.lit(x.translate(str.maketrans("-_", "+/"))) for x in (signer_key, salt_separator))
    return F.concat(
        F.lit("$firebase-scrypt$hash="), standard_base64(password_hash), F.lit("$salt="), standard_base64(salt), F.lit("$sk="), key, F.lit("$ss="), separator, F.lit(f"$r={rounds}$m={mem_cost}")
    )


def hash_algorithm(c: Column) -> Column:
    """The algorithm that a stored hash looks like; bcrypt if none is seen."""
    return (
        F.when(c.rlike(r"^\$2[abxy]\$"), "bcrypt")
        .when(c.rlike("^[a-fA-F0-9]{32}$"), "md5")
        .when(c.rlike("^[a-fA-F0-9]{64}$"), "sha256")
        .when(c.rlike("^[a-fA-F0-9]{128}$"), "sha512")
        .when(c.contains(":"), "pbkdf2")
        .otherwise("bcrypt")
    )


def supported_algorithm(c: Column) -> Column:
    """The password type that the sink knows for a source's algorithm."""
    word = F.lower(c)
    return F.when(c.isNull(), None).when(word.contains("bcrypt"), "bcrypt").when(word.contains("md5"), "md5").otherwise("auth0")


def split_list(c: Column) -> Column:
    """The items of a JSON array, or of a text with commas: trimmed, without empty ones; null for null, empty for blank."""
    text = trimmed(c)
    parsed = F.when(text.startswith("["), F.from_json(text, "array<string>", {"mode": "PERMISSIVE"}))
    items = F.coalesce(F.when(F.size(parsed) >= 0, parsed), F.split(text, ","))
    return F.filter(F.transform(items, lambda x: trimmed(F.coalesce(x, F.lit("null")))), lambda x: x != "")


def display_name(c: Column) -> Column:
    """A name for a slug: its parts between : . _ and -, each with a capital, the rest as it is."""
    parts = F.split(c, "[:._-]")
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x)))), " ")


# What error messages are stripped of, in this order.
MESSAGE_PARTS = (
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "<EMAIL>"),
    (r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<UUID>"),
    (r"\borg_[A-Za-z0-9]{20,}", "<ORG_ID>"),
    (r"\buser_[A-Za-z0-9]{20,}", "<USER_ID>"),
    (r"\b\d{5,}\b", "<NUMBER>"),
    (r"(?U)\s+", " "),
)


def message_pattern(c: Column) -> Column:
    """An error message without what differs from row to row."""
    for pattern, put in MESSAGE_PARTS:
        c = F.regexp_replace(c, pattern, put)
    return trimmed(c)


def api_error_text(code: Column, errors: Column) -> Column:
    """code: message; code: message ... of an array of structs with code and message; the outer code where there are none."""
    each = F.transform(errors, lambda e: F.concat_ws(": ", F.coalesce(e["code"], F.lit("unknown")), F.nullif(e["message"], F.lit(""))))
    return F.when(F.size(errors) > 0, F.array_join(each, "; ")).otherwise(F.coalesce(code, F.lit("unknown_error")))


def scope_key(org_id: Column, external_id: Column) -> Column:
    """The key of an organisation in a lookup: by id if there is one, else by external id."""
    return F.when(org_id.isNotNull(), F.concat(F.lit("id:"), org_id)).when(external_id.isNotNull(), F.concat(F.lit("ext:"), external_id))


def role_key(slug: Column, org_id: Column) -> Column:
    return F.when(org_id.isNotNull(), F.concat(F.lit("org:"), org_id, F.lit(":"), slug)).otherwise(F.concat(F.lit("env:"), slug))


def dry_run_user(email: Column) -> Column:
    return F.concat(F.lit("dry-run-user-"), email_key(email))


def dry_run_org(external_id: Column) -> Column:
    return F.concat(F.lit("org_dryrun_"), external_id)


def unique_suffix(c: Column, suffix: str) -> Column:
    """For fixtures: the suffix before the @ of an email, or at the end of an id."""
    return F.when(c.contains("@"), F.regexp_replace(c, "@", f"+{suffix}@")).when(~is_blank(c), F.concat(c, F.lit(f"_{suffix}")))


def format_duration(ms: float) -> str:
    """1h 2m 3s, 2m 3s or 3s."""
    seconds = int(ms // 1000)
    hours, minutes, rest = seconds // 3600, seconds % 3600 // 60, seconds % 60
    return f"{hours}h {minutes}m {rest}s" if hours else f"{minutes}m {rest}s" if minutes else f"{rest}s"


def rough_duration(ms: float) -> str:
    """Seconds below a minute, minutes below an hour, else hours and minutes."""
    if ms < 60_000:
        return f"{round(ms / 1000)}s"
    return f"{round(ms / 60_000)}m" if ms < 3_600_000 else f"{int(ms // 3_600_000)}h {round(ms % 3_600_000 / 60_000)}m"
