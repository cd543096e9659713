"""Sharding by extendible hashing.

The directory is indexed by the leading bits of a key's hash. Only buckets over the byte limit split on
another bit, until every shard fits or holds one key. The directory is found from cells of finely cut hash
space, a few for each shard, so no step moves documents or depends on the size of one bucket.

Defined cases: a null or empty text has 0 bytes; a text of any length counts whole; a null key hashes like an empty one; rows of one key stay together, and a
key larger than the limit has a shard of its own, marked ``fits`` false; an empty table has no shards; columns
but the key and the text are left out, so none can clash.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm.shared import written

HASH_BITS = 60
#: Bits beyond those that equal shards would need, and bits of each further round.
SPARE_BITS, ROUND_BITS = 4, 12


def key_hash(key: str) -> Column:
    """60 bits of the key's md5."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def _directory(hashed: DataFrame, base: int, bits: int, limit: int) -> DataFrame:
    """``cell, depth, whole`` for the hash prefixes of ``bits`` bits: the depth at which a cell's bucket fits, and
    whether it does (false: it has to split beyond these bits). Buckets at ``base`` bits are known to be too large."""
    cells = hashed.groupBy(F.shiftright("h", HASH_BITS - bits).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.min("h").alias("low"), F.max("h").alias("high"))
    levels = cells.withColumn("level", F.explode(F.sequence(F.lit(base), F.lit(bits))))
    levels = levels.withColumn("prefix", F.expr(f"cell div bigint(power(2, {bits} - level))"))
    over = levels.groupBy("level", "prefix").agg(F.sum("bytes").alias("bytes"), F.min("low").alias("low"), F.max("high").alias("high"))
    over = over.where((F.col("bytes") > limit) & (F.col("low") != F.col("high"))).select("level", "prefix", F.lit(1).alias("over"))
    depths = levels.select("cell", "level", "prefix").join(over, ["level", "prefix"], "left").groupBy("cell").agg(F.count("over").alias("splits"))
    return depths.select("cell", (F.col("splits") + base).cast("int").alias("depth"), (F.col("splits") <= bits - base).alias("whole"))


def assign(df: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, bytes, shard, depth, shard_bytes, shard_rows, fits`` for every row; a shard is named by its bits."""
    sizes = df.select(F.col(key).alias("key"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("bytes"), key_hash(key).alias("h"))
    left = sizes = written(sizes, "shard-sizes")
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    done, base = [], 0
    bits = max(1, min(HASH_BITS, math.ceil(math.log2(max(1, total / limit))) + SPARE_BITS))
    while True:
        directory = written(_directory(left, base, bits, limit), "shard-directory")
        met = left.withColumn("cell", F.shiftright("h", HASH_BITS - bits)).join(directory, "cell")
        done.append(met.where("whole").select("key", "bytes", "h", "depth"))
        if bits >= HASH_BITS or directory.where("not whole").isEmpty():
            break
        left = written(met.where("not whole").select("key", "bytes", "h"), "shard-left")
        base, bits = bits, min(HASH_BITS, bits + ROUND_BITS)
    placed = reduce(DataFrame.union, done)
    prefix = F.expr(f"h div bigint(power(2, {HASH_BITS} - depth))")
    placed = placed.withColumn("shard", F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.conv(prefix.cast("string"), 10, 2), F.col("depth"), F.lit("0"))))
    shards = placed.groupBy("shard").agg(F.sum("bytes").alias("shard_bytes"), F.count("*").alias("shard_rows"))
    out = placed.join(shards, "shard")
    return out.select(F.col("key").alias(key), "bytes", "shard", "depth", "shard_bytes", "shard_rows", (F.col("shard_bytes") <= limit).alias("fits"))
