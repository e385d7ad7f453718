"""Tables as files. All writes go through Spark's committer, so a lost task leaves no half-written file."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None, mode: str = "overwrite") -> None:
    """With a header and the given columns; booleans are true and false."""
    (df.select(*columns) if columns else df).write.mode(mode).csv(path, header=True, quote='"', escape='"', emptyValue="")


def write_json_lines(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


# Columns that are not written to logs.
SECRET = ("password", "password_hash", "totp_secret", "secret")


def redacted(df: DataFrame, column: str = "rawRow") -> DataFrame:
    """df with secrets taken out of a map column."""
    return df.withColumn(column, F.map_filter(column, lambda k, v: ~k.isin(*SECRET)))


# The columns of an error file in CSV, in order.
ERROR_COLUMNS = ("recordNumber", "email", "userId", "errorType", "errorMessage", "httpStatus", "code", "requestId", "timestamp", "rawRow")


def write_errors(df: DataFrame, path: str, every: bool = False) -> bool:
    """For a path that ends so a CSV file of ERROR_COLUMNS, of which those that df lacks are empty, with lists and maps as JSON (every: and whatever else df has); else JSON lines of all columns. Nothing at all without errors."""
    if not df.limit(1).count():
        return False
    if path.endswith(".csv"):
        kinds = dict(df.dtypes)
        names = [*ERROR_COLUMNS, *(c for c in df.columns if every and c not in ERROR_COLUMNS)]
        flat = lambda c: F.to_json(c) if kinds[c].startswith(("array", "map", "struct")) else F.col(c)
        write_csv(df.select(*[(flat(c) if c in kinds else F.lit(None).cast("string")).alias(c) for c in names]), path)
    else:
        write_json_lines(df, path, "overwrite")
    return True


def split_skipped(df: DataFrame, reason: str = "skip_reason") -> tuple[DataFrame, DataFrame]:
    """(rows kept, rows skipped)."""
    return df.where(F.col(reason).isNull()).drop(reason), df.where(F.col(reason).isNotNull())


def report(df: DataFrame) -> dict:
    """A one-row summary as a dict."""
    return df.first().asDict(recursive=True)


def write_report(found: dict, path: str) -> None:
    """A driver-side JSON report, put in place at once."""
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        json.dump(found, f, indent=2, default=str)
    os.replace(f"{path}.new", path)


def summary_text(title: str, found: dict) -> str:
    """A summary in lines, for a console."""
    wide = max(map(len, found), default=0)
    return "\n".join([title, *(f"  {k.ljust(wide)}  {v}" for k, v in found.items())])
