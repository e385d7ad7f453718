"""Sharding by jump consistent hashing (Lamping and Veach, 2014): no ring table, and a further shard only takes rows into itself."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, whole

SHARDS = 24
#: Rows of one shard are numbered in so many blocks, so that no task holds a whole shard.
BLOCKS = 1021


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key. Each step draws the next shard count at which the key would move, until that lies beyond the last shard."""
    state = keys.astype(np.int64).view(np.uint64).copy()
    at = np.zeros(len(state), np.int64)
    moving = np.arange(len(state))
    with np.errstate(over="ignore"):
        while len(moving):
            state[moving] = state[moving] * np.uint64(2862933555777941757) + np.uint64(1)
            draw = (state[moving] >> np.uint64(33)).astype(np.float64) + 1.0
            to = ((at[moving] + 1) * (2.0**31 / draw)).astype(np.int64)
            stays = to < shards
            moving = moving[stays]
            at[moving] = to[stays]
    return at


def jump_shards(key: Column, shards: int) -> Column:
    """The shard of a long key, and its shard if there were one more (a struct shard, grown_shard); a null key counts as 0."""

    @F.arrow_udf("shard int, grown_shard int")
    def of(keys: pa.Array) -> pa.Array:
        own = keys.to_numpy(zero_copy_only=False)
        return pa.StructArray.from_arrays([pa.array(jump(own, n), pa.int32()) for n in (shards, shards + 1)], ["shard", "grown_shard"])

    return of(F.coalesce(key.cast("long"), F.lit(0)))


def shard_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, blocks: int = BLOCKS) -> DataFrame:
    """Each row with its shard, its slot there (0, 1, ... without gaps) and its shard if there were one more.

    Law "key": the key and the number of shards alone decide. A null key counts as key 0, a null text as the empty text (8 bytes
    of framing, checksum 0); repeated keys get one slot each; an empty table gives no rows; columns besides key and text are left out.

    Slots: rows are counted by shard and block of keys (at most shards x blocks counters, so these can be broadcast), the counters'
    running sums are where each block begins, and rows are numbered within their block only.
    """
    # columns are renamed at once, so that further columns of the input cannot clash
    named = docs.select(F.col(key).cast("long").alias("doc_id"), whole(text).alias("text"))
    placed = named.select(
        "doc_id", (F.octet_length("text") + 8).cast("long").alias("size"), F.crc32("text").alias("text_crc32"), jump_shards(F.col("doc_id"), shards).alias("to"),
        # rows without a key are one shard's; their texts put them into blocks
        F.pmod(F.coalesce("doc_id", F.crc32("text")), F.lit(blocks)).cast("int").alias("block"),
    ).select("doc_id", "size", "text_crc32", "to.shard", "to.grown_shard", "block")
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counters = placed.groupBy("shard", "block").count()
    begins = counters.select("shard", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("begins"))
    within = Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("at", F.row_number().over(within) - 1)
        .join(F.broadcast(begins), ["shard", "block"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("begins") + F.col("at")).cast("long").alias("slot"), "grown_shard")
    )


#: DuckDB has no crc32: its table of 256 entries comes from the rule of its polynomial, and bytes are folded one after another.
OP7_SQL = f"""
WITH RECURSIVE bits AS (SELECT i AS n, i AS v, 0 AS k FROM range(256) t(i) UNION ALL SELECT n, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY n) AS t FROM bits WHERE k = 8),
d AS (SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) + 8 AS size FROM documents),
c AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(text), '..'), lambda x: ('0x' || x)::BIGINT)), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS text_crc32 FROM d, crc),
j AS (SELECT doc_id, n, doc_id::HUGEINT AS state, 0::BIGINT AS here, 0::BIGINT AS there FROM documents, (VALUES ({SHARDS}), ({SHARDS} + 1)) s(n)
  UNION ALL SELECT doc_id, n, s2, there, floor((there + 1) * (2147483648::DOUBLE / ((s2 >> 33) + 1)::DOUBLE))::BIGINT FROM (SELECT *, (state * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS s2 FROM j WHERE there < n)),
placed AS (SELECT doc_id, max(here) FILTER (n = {SHARDS}) AS shard, max(here) FILTER (n = {SHARDS} + 1) AS grown_shard FROM j GROUP BY 1)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id % {BLOCKS}, doc_id) - 1 AS slot, grown_shard::INTEGER AS grown_shard FROM c JOIN placed USING (doc_id)"""


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))
