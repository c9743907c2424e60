"""Sharding by extendible hashing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.shared import cut

#: Directory bits that one round of splitting looks at.
ROUND_BITS = 12
KEY_BITS = 64
SALT_BITS = 64


def _prefix(bits: int) -> Column:
    """The first ``bits`` bits of the row's 128-bit string ``h``."""
    return F.substring("h", 1, bits)


def _bit_string(value: Column) -> Column:
    return F.lpad(F.bin(value), 64, "0")


def shard(docs: DataFrame, limit_bytes: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Assigns every row to a shard whose texts stay within ``limit_bytes``.

    A directory maps prefixes of the key's hash to shards. All rows start under the empty prefix; a prefix whose rows
    exceed the limit splits on its next bit, others stay as they are. Sums are made bottom-up from one pre-aggregated
    row per prefix of the deepest level looked at, so no task sees the rows of a large prefix together, and only
    rows of prefixes that are still too large go to the next round, :data:`ROUND_BITS` bits deeper.

    The hash has 64 bits of the key, then 64 bits of a number that each row keeps: rows that repeat one key, even
    a third of the table, split by the latter. Returns ``key``, ``n_bytes``, ``shard`` (the prefix, as 0 and 1; ``''``
    when one shard holds all), ``depth`` and ``shard_bytes``.

    NULL text has no bytes. NULL keys hash like any other value. A single row above the limit gets a shard alone, at the
    depth where no other row shares its prefix; its ``shard_bytes`` then exceed the limit. Rows of equal key are
    told apart by their number, so each gives a row. An empty table gives no rows. Other columns are ignored.
    """
    if limit_bytes < 1:
        raise ValueError("limit_bytes must be positive")
    rows = docs.select(
        F.col(key),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        F.monotonically_increasing_id().alias("row"),
    )
    # The written row number makes the salt stable: whatever is recomputed later reads the same one.
    rows = cut(rows, "shard-rows").withColumn(
        "h", F.concat(_bit_string(F.xxhash64(F.lit("shard"), F.col(key))), _bit_string(F.xxhash64(F.lit("salt"), "row")))
    )
    open_rows, done, base = rows, [], 0
    while True:
        deepest = min(base + ROUND_BITS, KEY_BITS + SALT_BITS)
        leaves = open_rows.groupBy(_prefix(deepest).alias("p")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
        depths = F.explode(F.sequence(F.lit(base), F.lit(deepest))).alias("depth")
        paths = leaves.select(depths, "p", "b", "n").withColumn("shard", F.expr("substring(p, 1, depth)"))
        sums = paths.groupBy("depth", "shard").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("n"))
        fits = sums.filter((F.col("shard_bytes") <= limit_bytes) | (F.col("n") == 1))
        # The shortest prefix that fits is the shard: only prefixes that don't fit have split.
        directory = (
            paths.select("p", "depth", "shard")
            .join(fits, ["depth", "shard"], "left")
            .groupBy("p")
            .agg(F.min(F.when(F.col("n").isNotNull(), F.struct("depth", "shard", "shard_bytes"))).alias("leaf"))
        )
        directory = cut(directory.select("p", "leaf.*"), "shard-directory")
        last = deepest == KEY_BITS + SALT_BITS
        placed = open_rows.withColumn("p", _prefix(deepest)).join(directory.filter("shard IS NOT NULL"), "p")
        done.append(placed.select(key, "n_bytes", "shard", "depth", "shard_bytes"))
        large = directory.filter("shard IS NULL").select("p")
        if last or large.isEmpty():
            break
        open_rows = open_rows.withColumn("p", _prefix(deepest)).join(large, "p", "left_semi").drop("p")
        base = deepest
    return reduce(DataFrame.unionByName, done)
