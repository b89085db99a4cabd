"""Sharding by a Feistel permutation with cycle walking.

Every row gets a global row number (its rank in a fixed order of the data,
whatever the partitions); a keyed permutation of [0, n) turns it into a
position; shard = position mod shards, slot = position div shards. So shard
counts differ by at most one, slots have no gaps, and the place of any row
number, or the row number at any place, can be computed without the data.
DataFrame functions only.

Defined results: the order is by hash bucket, key, text checksum and size,
nulls first; null keys and null texts are ordinary values; rows equal in all
of these are interchangeable and get different positions; a table without rows
gives none; the input's columns travel in one struct, so their names cannot
clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, packed, table

#: Row numbers are counted in this many hash buckets: rows of a bucket are
#: ranked in one task, and the table of bucket offsets has at most so many
#: rows (1 MB).
BUCKETS = 1 << 16
ROUNDS = 6


def feistel(x: Column, n: int, seed: int, rounds: int = ROUNDS) -> Column:
    """A bijection of [0, a*b): x = l*b + r; even rounds add a hash of r to l
    modulo a, odd rounds a hash of l to r modulo b."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    b = max(1, -(-n // a))

    def mixed(i: Column, v: Column) -> Column:
        return F.xxhash64(F.lit(seed).cast("long"), i, v)

    def one(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        left = F.when(even, F.pmod(s["l"] + F.pmod(mixed(i, s["r"]), F.lit(a).cast("long")), F.lit(a).cast("long"))).otherwise(s["l"])
        right = F.when(even, s["r"]).otherwise(F.pmod(s["r"] + F.pmod(mixed(i, s["l"]), F.lit(b).cast("long")), F.lit(b).cast("long")))
        return F.struct(left.alias("l"), right.alias("r"))

    by = F.lit(b).cast("long")
    start = F.struct(F.call_function("div", x, by).alias("l"), F.pmod(x, by).alias("r"))
    return F.aggregate(F.array(*[F.lit(i) for i in range(rounds)]), start, one, lambda s: s["l"] * F.lit(b).cast("long") + s["r"])


def permuted(x: Column, n: int, seed: int) -> Column:
    """Cycle walking: apply the network until the value is below n. Fewer than
    sqrt(n) + 1 values lie outside, so a walk is almost always one step; the
    last bound covers the longest walk there can be."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    outside = a * max(1, -(-n // a)) - n

    def walk(y: Column, steps: int) -> Column:
        return F.when(y < n, y).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(max(1, steps))), y, lambda v, _: F.when(v < n, v).otherwise(feistel(v, n, seed))))

    y = feistel(x, n, seed)
    if outside == 0:
        return y
    y = walk(y, min(outside, 32))
    return walk(y, outside) if outside > 32 else y


def numbered(df: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
    """(row: all columns of ``df``, key, crc, size, number), and the number of
    rows. ``number`` is the global row number.

    Two steps: counts per bucket give offsets (summed in two levels, so no
    task sees more than a few hundred rows of them); the rank inside a bucket
    comes from a window over that bucket alone."""
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    size = F.coalesce(F.octet_length(text), F.lit(0))
    bucket = F.pmod(F.xxhash64(F.col(key), crc, size), F.lit(BUCKETS)).cast("int")
    counts = cut(df.select(bucket.alias("b")).groupBy("b").agg(F.count("*").alias("n")), "buckets")
    by_high = counts.groupBy(F.shiftright("b", 8).alias("high")).agg(F.sum("n").alias("m"))
    by_high = by_high.select("high", (F.sum("m").over(Window.orderBy("high")) - F.col("m")).alias("before"))
    within = counts.withColumns({"high": F.shiftright("b", 8), "run": F.sum("n").over(Window.partitionBy(F.shiftright("b", 8)).orderBy("b")) - F.col("n")})
    offsets = within.join(by_high, "high").select("b", (F.col("before") + F.col("run")).alias("offset"))
    n = counts.agg(F.sum("n")).first()[0] or 0
    rows = df.select(packed(df), F.col(key).alias("key"), crc.alias("crc"), size.alias("size"), bucket.alias("bucket"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("bucket").orderBy("key", "crc", "size")))
    rows = rows.join(F.broadcast(offsets), F.col("bucket") == F.col("b"))  # at most BUCKETS rows
    return rows.select("row", "key", "crc", "size", (F.col("offset") + F.col("rank") - 1).alias("number")), n


def shard_rows(df: DataFrame, shards: int = 24, seed: int = 20240501, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row: all columns of ``df``, key, crc: CRC-32 of the text, size: its
    UTF-8 bytes plus 8, number, position, shard, slot)."""
    rows, n = numbered(df, key, text)
    position = F.col("position")
    rows = rows.withColumn("position", permuted(F.col("number"), n, seed))
    return rows.withColumns({"shard": F.pmod(position, F.lit(shards)).cast("int"), "slot": F.call_function("div", position, F.lit(shards).cast("long")), "size": F.col("size").cast("long") + 8})


def op5_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = shard_rows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select(F.col("key").alias("doc_id"), "size", F.col("crc").cast("long").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("number").alias("row_number"), "position")
