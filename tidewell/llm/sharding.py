"""Shards by a Feistel permutation of global row numbers: reproducible, and any row's shard and slot can be
computed from its number alone. DataFrame functions only.

Row numbers follow a hash of the row: its top bits name one of BUCKETS ranges, the rows of earlier ranges
are counted once, and each range is numbered by itself. So a row's number depends on the rows alone, not
on how they are partitioned.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.llm.base import cut

SHARDS, ROUNDS, SEED = 8, 4, 42
#: Ranges of row numbers: their counts are the only rows that meet in one task.
BUCKETS_BITS = 14


def numbered(rows: DataFrame, key: list[Column], name: str) -> tuple[DataFrame, int]:
    """rows with their global row number (from 0) in order of a hash of key, and how many there are.

    Rows of equal hash stand in order of key; rows whose keys are equal too can change places.
    """
    hashed = rows.withColumn("_tw_h", F.xxhash64(*key)).withColumn("_tw_b", F.shiftrightunsigned("_tw_h", 64 - BUCKETS_BITS))
    counts = cut(hashed.groupBy("_tw_b").agg(F.count("*").alias("_tw_n")))
    total = counts.agg(F.sum("_tw_n")).first()[0] or 0
    ahead = Window.orderBy("_tw_b").rowsBetween(Window.unboundedPreceding, -1)  # at most 2^BUCKETS_BITS rows
    starts = counts.select("_tw_b", F.coalesce(F.sum("_tw_n").over(ahead), F.lit(0)).alias("_tw_s"))
    within = F.row_number().over(Window.partitionBy("_tw_b").orderBy("_tw_h", *key))
    out = hashed.withColumn("_tw_r", within).join(F.broadcast(starts), "_tw_b")
    return out.withColumn(name, F.col("_tw_s") + F.col("_tw_r") - 1).drop("_tw_h", "_tw_b", "_tw_n", "_tw_r", "_tw_s"), total


def _rounds(df: DataFrame, value: str, wide: int, long: int, seed: int) -> DataFrame:
    """df with column value (0 to wide * long - 1) permuted: halves value div long and value mod long take
    turns at adding a hash of the other."""
    df = df.withColumn("_tw_l", F.expr(f"{value} div {long}")).withColumn("_tw_k", F.col(value) % long)
    for k in range(ROUNDS):
        df = df.withColumn("_tw_l", F.pmod(F.col("_tw_l") + F.pmod(F.xxhash64(F.lit(seed), F.lit(2 * k), "_tw_k"), F.lit(wide)), F.lit(wide)))
        df = df.withColumn("_tw_k", F.pmod(F.col("_tw_k") + F.pmod(F.xxhash64(F.lit(seed), F.lit(2 * k + 1), "_tw_l"), F.lit(long)), F.lit(long)))
    return df.withColumn(value, F.col("_tw_l") * long + F.col("_tw_k")).drop("_tw_l", "_tw_k")


def walks(spark: SparkSession, n: int, wide: int, long: int, seed: int) -> int:
    """How often the permutation must be applied again until every number is below n.

    Only the fewer than sqrt(n) numbers from n to wide * long - 1 can follow each other outside, so walking
    all of them gives the exact count.
    """
    outside, count = spark.range(n, wide * long).select(F.col("id").alias("p")), 0
    while outside.limit(1).count():
        outside = cut(_rounds(outside, "p", wide, long, seed).where(F.col("p") >= n))
        count += 1
    return count


def permuted(df: DataFrame, number: str, n: int, seed: int = SEED) -> DataFrame:
    """df with number (0 to n - 1) permuted: Feistel rounds over a product just above n, walking on while outside."""
    if n < 2:
        return df
    wide = math.isqrt(n - 1) + 1
    long = -(-n // wide)
    df = _rounds(df, number, wide, long, seed)
    for _ in range(walks(df.sparkSession, n, wide, long, seed)):
        df = _rounds(df.withColumn("_tw_p", F.col(number)), "_tw_p", wide, long, seed)
        df = df.withColumn(number, F.when(F.col(number) >= n, F.col("_tw_p")).otherwise(F.col(number))).drop("_tw_p")
    return df


def shard(rows: DataFrame, key: list[Column], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """rows with ``shard`` (0 to shards - 1), and ``slot`` (from 0 without gaps in each shard).

    Law ``rows``: the shards' counts are at most one apart. Rows whose keys are equal can change places;
    with whole rows as key that shows nowhere. Nulls are values like others. An empty table stays empty.
    Columns named shard or slot are replaced; all others stay.
    """
    found, n = numbered(rows.drop("shard", "slot"), key, "_tw_x")
    found = permuted(found, "_tw_x", n, seed)
    return found.withColumn("shard", (F.col("_tw_x") % shards).cast("int")).withColumn("slot", F.expr(f"_tw_x div {shards}")).drop("_tw_x")


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One narrow row a document: id, size (UTF-8 bytes and 1), text_crc32, law, shard, slot, grown_shard.

    Null texts have size 1 and the crc32 of nothing. Under law ``rows`` a further shard moves rows
    everywhere, so grown_shard is null.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    narrow = cut(docs.select(F.col(id_column).alias("id"), (F.octet_length(value) + 1).cast("long").alias("size"), F.crc32(value.cast("binary")).alias("text_crc32")))
    found = shard(narrow, [F.col("id"), F.col("size"), F.col("text_crc32")], shards)
    return found.select(F.col("id").alias(id_column), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
