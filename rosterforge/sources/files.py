"""Files as tables. CSV, JSON and JSONL cells are text; rows get a record number in reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import with_record_number
from ..schema import ERROR_RECORD, FIREBASE_USER, PASSWORD, TOTP, require_columns


def read_csv(spark: SparkSession, path: str, strict: bool = True, number: bool = True, line_breaks: bool = True) -> DataFrame:
    """A CSV file with a header: byte-order mark dropped, quoted line breaks and doubled quotes understood, unquoted cells trimmed. strict: a row with another number of cells is an error; else short rows
    are filled with nulls and long ones cut. An empty cell is an empty text. line_breaks: cells may have quoted line breaks, and then each file is read by one task; without them a large file is read by many."""
    df = spark.read.csv(
        path, header=True, inferSchema=False, multiLine=line_breaks, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True,
        mode="FAILFAST" if strict else "PERMISSIVE", enforceSchema=False, nullValue="\x00", emptyValue="",
    )
    df = df.select(*[F.coalesce(c, F.lit("")).alias(c) if strict else F.col(c) for c in df.columns])
    return with_record_number(df) if number else df


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names: the schema only, without the rows."""
    return spark.read.csv(path, header=True, inferSchema=False).columns


def read_user_document(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document with an array `users`, one row per user."""
    document = spark.read.schema(f"users array<struct<{_struct(FIREBASE_USER)}>>").json(path, multiLine=True)
    if document.where(F.col("users").isNull()).limit(1).count():
        raise ValueError(f"{path} has no array 'users'")
    return document.select(F.posexplode("users").alias("at", "user")).select("user.*", (F.col("at") + 1).cast("long").alias("record_number"))


def _struct(ddl: str) -> str:
    """name type, ... as name:type,... at the top level."""
    out, depth = [], 0
    part = ""
    for ch in ddl + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            name, kind = part.strip().split(" ", 1)
            out.append(f"{name}:{kind}")
            part = ""
        else:
            part += ch
    return ",".join(out)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, lines that are no JSON object). Blank lines are neither. Rows have a number `line` that grows as they were read."""
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id()).where(~F.col("value").rlike(r"^\s*$"))
    parsed = lines.select("value", "line", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("row"))
    bad = F.col("row").isNull() | F.col("row._bad").isNotNull()
    return parsed.where(~bad).select("row.*", "line").drop("_bad"), parsed.where(bad).select("value")


def read_errors(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return read_json_lines(spark, path, ERROR_RECORD)


def read_passwords(spark: SparkSession, path: str) -> DataFrame:
    """A password export in NDJSON, numbered; lines that are no JSON are left out."""
    return with_record_number(read_json_lines(spark, path, PASSWORD)[0].drop("line"))


def read_totp(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".csv"):
        return require_columns(read_csv(spark, path), ["email", "totp_secret"])
    return with_record_number(read_json_lines(spark, path, TOTP)[0].drop("line"))


def file_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file, by Spark so that any store will do."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]


def input_digest(rows: DataFrame) -> str:
    """A digest of a table's rows, whatever their order: how many there are, and the sum and exclusive or of their hashes. One pass, a row a task."""
    h = F.xxhash64(*[F.col(c) for c in sorted(rows.columns)])
    found = rows.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(20,0)")).alias("total"), F.bit_xor(h).alias("mixed")).first()
    return f"{found.n}-{found.total or 0}-{found.mixed or 0}"


def count_rows(spark: SparkSession, path: str) -> int:
    """Records, not lines: a quoted line break is no new row."""
    return read_csv(spark, path, number=False).count()
