"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a key's hash. A bucket that holds
more than the byte limit splits on one more bit, and only such buckets split, until
each fits. Bits are read in rounds: a round sums the bytes of the cells that its
bits distinguish, and the sums of the cells' shorter prefixes tell at which bit
each bucket stops. Only rows of buckets that still do not fit go to the next
round. When all bits of the key's hash are used (one key, too many bytes), the bits
of a hash of the row follow, so a hot key is spread without moving the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Most bytes of a shard; bits of the key's and of the row's hash; bits a round reads.
SHARD_BYTES, HASH_BITS, ROUND_BITS = 1 << 20, 60, 12


def _bits(value: Column) -> Column:
    """The first 60 bits of md5 as a string of 0 and 1."""
    return F.lpad(F.conv(F.substring(F.md5(value), 1, HASH_BITS // 4), 16, 2), HASH_BITS, "0")


def extendible_shards(rows: DataFrame, key: str, size: Column, limit: int = SHARD_BYTES) -> DataFrame:
    """(key, bytes, shard, depth, oversized): the shard of every row; shard is its bit prefix.

    ``size`` gives a row's bytes (null: 0); equal keys stay together while they fit. A row
    that alone exceeds the limit has a shard of its own, marked oversized. A null key
    is a key. An empty table gives an empty result; without a split the prefix is empty. Texts are measured, not
    read, whatever their length; equal rows are dealt apart by their row number only where their key is split.
    """
    text = F.coalesce(F.col(key).cast("string"), F.lit("\0null"))
    salt = F.concat_ws("#", text, F.monotonically_increasing_id().cast("string"))
    spark = rows.sparkSession
    left = stored(rows.select(F.col(key).alias("key"), F.coalesce(size, F.lit(0)).cast("long").alias("bytes"),
                              F.concat(_bits(text), _bits(salt)).alias("bits")), "to-shard")
    out, depth = None, 0
    while True:
        to = min(depth + ROUND_BITS, 2 * HASH_BITS)
        cells = left.groupBy(F.substring("bits", 1, to).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
        nodes = cells.select("cell", "bytes", "n", F.explode(F.sequence(F.lit(depth), F.lit(to))).alias("depth"))
        prefix = F.expr("substring(cell, 1, depth)")
        sums = nodes.groupBy(prefix.alias("shard"), "depth").agg(F.sum("bytes").alias("total"), F.sum("n").alias("rows"))
        stops = sums.where((F.col("total") <= limit) | (F.col("rows") == 1) | (F.col("depth") == 2 * HASH_BITS))
        ends = (nodes.select("cell", "depth", prefix.alias("shard")).join(stops, ["shard", "depth"]).groupBy("cell")
                .agg(F.min(F.struct("depth", "shard", "total")).alias("end")))
        ends = stored(ends, "directory")
        placed = left.withColumn("cell", F.substring("bits", 1, to)).join(ends, "cell", "left")
        done = placed.where("end is not null").select(F.col("key").alias(key), "bytes", "end.shard", "end.depth", (F.col("end.total") > limit).alias("oversized"))
        out = done if out is None else out.unionByName(done)
        depth = to
        if depth == 2 * HASH_BITS:
            return out
        left = stored(placed.where("end is null").select("key", "bytes", "bits"), "to-shard")
        if left.isEmpty():
            return out


def write_shards(rows: DataFrame, key: str, path: str, limit: int = SHARD_BYTES) -> DataFrame:
    """Write ``rows`` (with text) as one folder per shard below ``path``; returns the shards (shard, bytes, rows).

    Keys are taken to be unique; rows of one key go to the shard of its first prefix.
    """
    shards = extendible_shards(rows, key, F.octet_length("text"), limit)
    of_key = shards.groupBy(F.col(key).alias("_key")).agg(F.min("shard").alias("_shard"))
    named = rows.join(of_key, rows[key].eqNullSafe(of_key["_key"])).drop("_key").withColumn("shard", F.concat(F.lit("b"), "_shard")).drop("_shard")
    named.repartition("shard").write.partitionBy("shard").parquet(path)
    return shards.groupBy("shard").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows"))


ORACLE = f"""
WITH b AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS bytes,
    lpad(bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, chr(0) || 'null')), 1, 15))::BIGINT), 60, '0') AS bits FROM documents),
n AS (SELECT b.*, d.range AS depth, substr(bits, 1, d.range) AS shard FROM b, range(0, 61) d),
t AS (SELECT depth, shard, sum(bytes) AS total, count(*) AS k FROM n GROUP BY ALL),
s AS (SELECT n.*, t.total, row_number() OVER (PARTITION BY doc_id ORDER BY n.depth) AS r
  FROM n JOIN t USING (depth, shard) WHERE t.total <= {SHARD_BYTES} OR t.k = 1)
SELECT doc_id, bytes, shard, depth, total > {SHARD_BYTES} AS oversized FROM s WHERE r = 1
"""
