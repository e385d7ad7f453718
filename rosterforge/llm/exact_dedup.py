"""Exact dedup with an extendible-hash index on shared files, in DataFrame operations only."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, aside, documents, one_of_repeats, row_keys, whole, written

#: A bucket with more distinct keys than this is split.
CAPACITY = 4096
#: Bits of a hash, and so the greatest depth of a directory.
BITS = 64


@dataclass
class Index:
    """entries: bucket, hash, place (in the chain of texts with one hash), body (where the chain has several texts), digest, keep_id, group_size. directory: slot, depth, bucket; it has
    2 ** depth slots. chained: the hashes that several texts have."""

    entries: DataFrame
    directory: DataFrame
    depth: int
    chained: DataFrame

    def buckets(self, rows: DataFrame) -> DataFrame:
        """Rows with a column hash, and the bucket that the directory names for it."""
        return rows.withColumn("slot", slot(F.col("hash"), self.depth)).join(self.directory.select("slot", "bucket"), "slot").drop("slot")


def slot(of_hash: Column, depth: int) -> Column:
    """The first bits of a hash, as a number."""
    return F.shiftrightunsigned(of_hash, BITS - depth) if depth else F.lit(0).cast("long")


def bucket_directory(keys: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """The directory after all splits (slot, depth, bucket), and its depth.

    keys: a column hash, one row per distinct hash. A bucket of local depth d holds the keys that agree in the first d bits. It is split, which doubles the directory where d was the global depth,
    while it has more than capacity keys. So the buckets are the prefixes that have no more keys than that while the prefix one bit shorter has more.
    """
    depth = max(0, math.ceil(math.log2(max(1, keys.count()) / capacity))) + 1
    while True:
        slots = written(keys.groupBy(slot(F.col("hash"), depth).alias("slot")).agg(F.count("*").alias("keys")), "exact-slots")
        if depth == BITS or slots.where(F.col("keys") > capacity).isEmpty():
            break
        depth += 1
    at_depth = slots.select("slot", "keys", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("depth"))
    prefixes = at_depth.groupBy("depth", F.expr(f"shiftright(slot, {depth} - depth)").alias("prefix")).agg(F.sum("keys").alias("keys"))
    fits = written(prefixes.where((F.col("keys") <= capacity) | (F.col("depth") == depth)).select("depth", "prefix"), "exact-prefixes")
    halves = fits.select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
    leaves = fits.join(halves, ["depth", "prefix"], "left_anti")  # those whose undivided bucket did not fit
    begin, size = F.expr(f"shiftleft(prefix, {depth} - depth)"), F.expr(f"shiftleft(1L, {depth} - depth)")
    return written(leaves.select(F.explode(F.sequence(begin, begin + size - 1)).alias("slot"), "depth", begin.alias("bucket")), "exact-directory"), depth


def _named(docs: DataFrame, key: str, text: str, hashed: Callable[[Column], Column]) -> DataFrame:
    """doc_id, hash, body: columns are renamed at once, so that further columns of the input cannot clash."""
    return docs.select(F.col(key).alias("doc_id"), ascii_lower(whole(text)).alias("body")).withColumn("hash", hashed(F.col("body")))


def exact_index(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, hashed: Callable[[Column], Column] = F.xxhash64) -> Index:
    """The index of a table's texts.

    Rows are first combined by their whole normalised text where they lie, so that a text with very many copies leaves each task once. Hashes that several texts have, as their bytes tell, make chains, in the order of
    bytes. The entries are dealt to owners by ranges of buckets; each owner numbers the chains of its range and writes its file.
    """
    named = _named(docs, key, text, hashed)
    groups = [F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")]
    digest = F.sha2("body", 256).alias("digest")
    texts = written(named.groupBy("hash", "body").agg(*groups).select("hash", digest, "keep_id", "group_size"), "exact-texts")
    chained = written(texts.groupBy("hash").count().where("count > 1").select("hash"), "exact-chained")
    directory, depth = bucket_directory(texts.select("hash").distinct(), capacity)
    alone = texts.join(chained, "hash", "left_anti").withColumn("body", F.lit(None).cast("string"))
    several = named.join(chained, "hash", "left_semi").groupBy("hash", "body").agg(*groups).withColumn("digest", digest)
    made = Index(alone, directory, depth, chained)
    owned = made.buckets(alone.unionByName(several)).repartitionByRange("bucket")
    place = F.row_number().over(Window.partitionBy("bucket", "hash").orderBy("body")) - 1
    made.entries = written(owned.select("bucket", "hash", place.alias("place"), "body", "digest", "keep_id", "group_size"), "exact-index")
    return made


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """Each row with the group of rows that have an equal text: doc_id, keep_id, group_size, kept, text_sha256, bucket, chain.

    Texts are equal when identical after lower-casing A-Z only; a null text counts as the empty text. The row with the largest
    doc_id of a group stays; of rows with one doc_id and one text, repeated as they are, one is kept. A null doc_id counts as the smallest.
    An empty table gives no rows; further columns are left out.

    A row finds its group through its hash's slot, the bucket, and the hash there; where several texts have the hash, by its bytes.
    """
    index = exact_index(docs, key, text, capacity, hashed)
    many = index.chained.withColumn("many", F.lit(True))
    sought = _named(docs, key, text, hashed).join(many, "hash", "left").select("doc_id", "hash", F.when(F.col("many"), F.col("body")).alias("sought"), F.pmod(F.monotonically_increasing_id(), F.lit(1021)).alias("salt"))
    # of rows that repeat, the first of each salt and then the first of those: however many repeat, no task has them all
    first = lambda *by: F.row_number().over(Window.partitionBy("doc_id", "hash", "sought", *by).orderBy("salt")) == 1
    once = sought.withColumn("one", first("salt")).withColumn("one", F.col("one") & first(F.when(F.col("one"), F.lit(-1)).otherwise(F.col("salt"))))
    entries = index.entries.withColumnRenamed("hash", "at").withColumnRenamed("bucket", "in")
    found = index.buckets(once).join(entries, (F.col("bucket") == F.col("in")) & (F.col("hash") == F.col("at")) & F.col("sought").eqNullSafe(F.col("body")))
    return found.select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("one")).alias("kept"), F.col("digest").alias("text_sha256"), "bucket", F.col("place").alias("chain")
    )


@aside
def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each text, with the columns of docs: the one of the largest doc_id, and of rows that repeat doc_id and text any one."""
    index = exact_index(docs, key, text)
    keep = F.col("keep_id").cast("long")
    stays = index.entries.select(*[c.alias(n) for n, c in row_keys(keep, F.lit("")).items() if n != "__hash"], F.col("hash").alias("__hash"), F.col("body").alias("__body"), F.col("place").alias("__place"))
    body = ascii_lower(whole(docs[text]))
    rows = docs.withColumns(row_keys(docs[key], body))
    # of texts with one hash those that are equal meet
    met = rows.join(stays, ["__id", "__none", "__hash"]).where(F.col("__body").isNull() | (F.col("__body") == ascii_lower(whole(F.col(text)))))
    return one_of_repeats(met, ["__id", "__none", "__hash", "__place"]).select(*docs.columns)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP1_SQL = f"""
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM t"""
