"""What the text operators share: written intermediate tables, word arrays, and distributed running sums."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import mark, release, remove, scratch, shared_dir, written  # noqa: F401  shared with the rest of the library

#: White space that separates words.
SPACE = r"[\x20\x09-\x0D]"
def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """Words of a text in order; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def top_bits(h: Column, bits: int = 8) -> Column:
    """The highest bits of a 64-bit hash: buckets whose order agrees with the unsigned order of the hash."""
    return F.shiftrightunsigned(h, 64 - bits).cast("int")


#: Keys with more than a SHARE-th of all rows are hot; there are fewer than SHARE of them.
SHARE = 1000


def join_counted(df: DataFrame, counted: DataFrame, keys: list[str], n: str, total: int, how: str = "left_semi") -> DataFrame:
    """Joins `df` (of about `total` rows) to `counted`, a written table of keys with the number `n` of their rows: hot keys by broadcast, so that their rows
    stay where they are, and the others by merging. `how`: left_semi or inner."""
    hot = F.broadcast(counted.where(F.col(n) * SHARE > total).drop(n))
    rest = counted.where(F.col(n) * SHARE <= total).drop(n)
    return df.join(hot, keys, how).unionByName(df.join(hot.select(*keys), keys, "left_anti").join(rest.hint("merge"), keys, how))


#: About how many rows a slice of a running sum holds, where hashes allow.
SLICE_ROWS = 2**18


def running_sum(df: DataFrame, keys: list[str], h: str, order: list[str], amount: Column, out: str, rows: int) -> DataFrame:
    """Adds the sum of `amount` over the earlier rows of the same keys, in the order (top bits of h, h, order).

    A key may hold any share of the rows, of which there are about `rows`: it's cut by hash into slices of about SLICE_ROWS rows or less (256 at least);
    the slices' sums are added up per key (a row a slice), and a window runs only inside a slice.
    """
    bits = max(8, math.ceil(math.log2(max(rows, 1) / SLICE_ROWS)))
    part = df.withColumns({"_slice": top_bits(F.col(h), bits), "_amount": amount.cast("long")})
    sums = part.groupBy(*keys, "_slice").agg(F.sum("_amount").alias("_sum"))
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*keys, "_slice", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = W.partitionBy(*keys, "_slice").orderBy(h, *order).rowsBetween(W.unboundedPreceding, -1)
    return (
        part.join(sums.hint("merge"), [*keys, "_slice"])
        .withColumn(out, F.col("_base") + F.coalesce(F.sum("_amount").over(inside), F.lit(0)))
        .drop("_slice", "_amount", "_base")
    )
