"""Deterministic sampling by hash: stratified, balanced, quota and weighted draws, tie-aware top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import r6, ratio
from .stats import nth_values


def _h(key: str, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))


def stratified(df: DataFrame, strata: list[str], key: str, n: int, seed: str = "s") -> DataFrame:
    """n of each stratum (all of smaller ones) in hash order, with inclusion probability and weight."""
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("stratum_size")).withColumnsRenamed({c: f"_{c}" for c in strata})
    # the rank alone: each task passes on its first n of a stratum, so no task sorts a whole one
    d = df.withColumn("_r", F.row_number().over(W.partitionBy(*strata).orderBy(_h(key, seed), key))).where(F.col("_r") <= n)
    same = F.lit(True)
    for c in strata:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    d = d.join(sizes.hint("merge"), same)
    p = F.least(F.lit(1.0), ratio(F.lit(n), "stratum_size"))
    return d.select(*strata, key, "stratum_size", r6(p).alias("inclusion"), r6(1 / p).alias("weight"))


def round_robin(df: DataFrame, by: str, cell: list[str], key: str, n: int, seed: str = "s") -> DataFrame:
    """n per `by`, the cells drawn in turn by hash order."""
    d = df.withColumn("_r", F.row_number().over(W.partitionBy(by, *cell).orderBy(_h(key, seed), key))).where(F.col("_r") <= n)
    return d.withColumn("draw", F.row_number().over(W.partitionBy(by).orderBy("_r", *cell))).where(F.col("draw") <= n).select(by, *cell, key, "draw")


def terciles(df: DataFrame, value: str, digits: int = 4) -> DataFrame:
    """Adds `tercile`, T1 to T3, by the values a third and two thirds up the order of all rows (rounded); NULL for a null value."""
    low, high = nth_values(df, value, lambda n: [n // 3, 2 * n // 3], digits)
    v = F.round(value, digits)
    return df.withColumn("tercile", F.when(v <= F.lit(low), "T1").when(v <= F.lit(high), "T2").when(v.isNotNull(), "T3"))


def shortfalls(df: DataFrame, by: list[str], n: int) -> DataFrame:
    """Groups that can't give n rows, with what they have; a draw takes all of these."""
    return df.groupBy(*by).agg(F.lit(n).alias("requested"), F.count(F.lit(1)).alias("available")).where(F.col("available") < n)


def content_order(df: DataFrame, text: list[str], by: str, n: int) -> DataFrame:
    """First n per `by` in the order of a content hash."""
    h = F.sha2(F.concat_ws("|", *text), 256)
    return df.withColumn("content_hash", h).withColumn("place", F.row_number().over(W.partitionBy(by).orderBy("content_hash", *text))).where(F.col("place") <= n).select(by, *text, "place")


def quota_panel(df: DataFrame, quotas: DataFrame, category: str, key: str, spread: str | None = None, seed: str = "s") -> DataFrame:
    """Exact quotas per category; with `spread` at most one record of each of its values per category."""
    if spread:
        df = df.withColumn("_s", F.row_number().over(W.partitionBy(category, spread).orderBy(_h(key, seed), key))).where("_s = 1").drop("_s")
    most = quotas.agg(F.max("quota")).first()[0] or 0
    d = df.withColumn("_r", F.row_number().over(W.partitionBy(category).orderBy(_h(key, seed), key))).where(F.col("_r") <= most).join(quotas.hint("merge"), category)
    return d.where(F.col("_r") <= F.col("quota")).select(category, key)


def weighted_draw(targets: DataFrame, marginal: DataFrame, stratum: str, seed: str = "w") -> DataFrame:
    """One category for each target, by cumulative counts within its stratum: a range join on a hashed point."""
    w = W.partitionBy(stratum).orderBy("category")
    m = marginal.withColumns({"hi": F.sum("count").over(w.rowsBetween(W.unboundedPreceding, 0)), "total": F.sum("count").over(W.partitionBy(stratum))}).withColumn("lo", F.col("hi") - F.col("count"))
    u = F.conv(F.substring(_h("target_id", seed), 1, 8), 16, 10).cast("double") / 4294967296.0
    t = targets.withColumn("_u", u)
    return t.join(m, stratum).where((F.col("_u") * F.col("total") >= F.col("lo")) & (F.col("_u") * F.col("total") < F.col("hi"))).select("target_id", stratum, "category")


def top_k(df: DataFrame, by: list[str], value: str, k: int) -> DataFrame:
    """Tie-aware: everything that ranks within k."""
    return df.withColumn("rank", F.rank().over(W.partitionBy(*by).orderBy(F.desc(value)))).where(F.col("rank") <= k)
