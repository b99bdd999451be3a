"""Order statistics of groups of any size: places by counting, rank correlation by counting inversions. No buffer or task grows with a group."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import r6
from ..scratch import written

#: Rows of a bucket of one side: at least LEAST, and STEP times the square root of the largest group, so that buckets and the grid of buckets grow alike.
LEAST, STEP = 1024, 16


def joined(a: DataFrame, b: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Joins on keys in which nulls are equal; b's keys are dropped. Without keys, b is one row."""
    if not keys:
        return a.crossJoin(F.broadcast(b))
    named = {k: f"_key{n}" for n, k in enumerate(keys)}
    b = b.select(*(F.col(c).alias(named.get(c, c)) for c in b.columns))
    on = [F.col(k).eqNullSafe(F.col(other)) for k, other in named.items()]
    return a.join(b.hint("merge"), on, how).drop(*named.values())


def cumulative(counts: DataFrame, by: list[str], value: str, n: str = "n") -> DataFrame:
    """Adds `before`, how many rows of the group have lower values, to (by, value, n) with one row a value.

    Rows are sorted by range, so a group may lie in many parts; the parts' sums are added up (a row a part), and a window runs inside a part.
    """
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*by, value]
    ranged = written(counts.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy(*by, "_part").agg(F.sum(n).alias("_sum"))
    base = sums.select(*by, "_part", F.coalesce(F.sum("_sum").over(W.partitionBy(*(by or [F.lit(0)])).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = W.partitionBy(*by, "_part").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    return joined(ranged, base, [*by, "_part"]).withColumn("before", F.col("_base") + F.coalesce(F.sum(n).over(inside), F.lit(0))).drop("_part", "_base")


def at_places(df: DataFrame, by: list[str], value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(by, n, names): of the n values of a group that aren't null, in order, those at places (from 0, given n); NULL where there is no such place."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_k"))
    c = cumulative(counts, by, "_v", "_k")
    total = c.groupBy(*by).agg(F.sum("_k").alias("n"))
    c = joined(c, total, by)
    here = lambda place: (F.col("before") <= place) & (place < F.col("before") + F.col("_k"))
    return c.groupBy(*by).agg(F.first("n").alias("n"), *(F.max(F.when(here(f(F.col("n"))), F.col("_v"))).alias(name) for name, f in places.items()))


def quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by, n, names): exact quantiles, between neighbours in proportion, as `percentile` has them."""
    place = lambda q: lambda n: F.lit(q) * (n - 1)
    ends = {f"_{end}{k}": (lambda f, g: lambda n: f(g(n)))(f, place(q)) for k, q in shares.items() for end, f in (("lo", F.floor), ("hi", F.ceil))}
    got = at_places(df, by, value, ends)
    part = lambda q: F.lit(q) * (F.col("n") - 1) - F.floor(F.lit(q) * (F.col("n") - 1))
    return got.select(*by, "n", *((F.col(f"_lo{k}") + (F.col(f"_hi{k}") - F.col(f"_lo{k}")) * part(q)).cast("double").alias(k) for k, q in shares.items()))


def inversions(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> int:
    """The sum of w_i w_j over pairs with x_i < x_j and y_i > y_j: from the highest bit of y's rank down, the weights of set bits before each unset one."""
    order = np.lexsort((y, x))
    r, w = np.unique(y[order], return_inverse=True)[1].astype(np.int64), w[order].astype(np.int64)
    total = 0
    for b in reversed(range(int(r.max(initial=0)).bit_length())):
        o = np.argsort(r >> (b + 1), kind="stable")
        prefix, bit, own = r[o] >> (b + 1), (r[o] >> b) & 1, w[o]
        ones = np.cumsum(bit * own)
        start = np.searchsorted(prefix, prefix)
        earlier = np.where(start > 0, ones[start - 1], 0)
        total += int((((ones - earlier) * (1 - bit)) * own).sum())
    return total


def _bucketed(rows: DataFrame, by: list[str], value: str, size: int) -> DataFrame:
    """(by, value, bucket, alone): buckets of the order of about `size` rows; a value with more rows has a bucket alone."""
    c = cumulative(rows.groupBy(*by, value).agg(F.sum("w").alias("n")), by, value)
    heavy = F.col("n") >= size
    return c.select(*by, value, (2 * F.floor(F.col("before") / size) + heavy.cast("int")).alias("bucket"), heavy.alias("alone"), "n")


def tau_b(df: DataFrame, by: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """(by, n, tau_b, undefined_reason): Kendall's tau-b of pairs in which neither value is null.

    Discordant pairs are inversions. Both sides are cut into buckets of their order, ties whole. A pair in different buckets of both sides is an inversion of the grid of buckets (one row a cell);
    a pair in one bucket of y but not of x, or in one of x, is counted inside that bucket. Each is a bounded task; ties come from counts.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.count(F.lit(1)).alias("w"))
    rows = written(rows, "pairs")
    group = rows.groupBy(*by).agg(F.sum("w").alias("n"), F.sum(F.col("w") * (F.col("w") - 1) / 2).alias("_both"))
    size = max(LEAST, STEP * math.isqrt(group.agg(F.max("n")).first()[0] or 0))
    bx, by_ = (_bucketed(rows, by, k, size) for k in ("x", "y"))
    ties = lambda b, name: b.groupBy(*by).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias(name))
    placed = joined(rows, bx.select(*by, "x", F.col("bucket").alias("bx"), F.col("alone").alias("ax")), [*by, "x"])
    placed = written(joined(placed, by_.select(*by, "y", F.col("bucket").alias("by_"), F.col("alone").alias("ay")), [*by, "y"]), "placed")
    part = lambda kind, where, bucket, u, v: placed.where(where).select(*by, F.lit(kind).alias("kind"), F.col(bucket).cast("long").alias("bucket"), F.col(u).cast("double").alias("u"), F.col(v).cast("double").alias("v"), "w")
    grid = placed.groupBy(*by, "bx", "by_").agg(F.sum("w").alias("w")).select(*by, F.lit("grid").alias("kind"), F.lit(0).cast("long").alias("bucket"), F.col("bx").cast("double").alias("u"), F.col("by_").cast("double").alias("v"), "w")
    whole = grid.unionByName(part("x", "not ax", "bx", "x", "y")).unionByName(part("y", "not ay", "by_", "bx", "y"))
    keys = [*by, "kind", "bucket"]

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf.iloc[:1][keys].copy()
        out["q"] = inversions(pdf["u"].to_numpy(), pdf["v"].to_numpy(), pdf["w"].to_numpy())
        return out

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.select(*keys).schema)
    q = written(whole.groupBy(*keys).applyInPandas(count, f"{fields}, q long"), "inversions").groupBy(*by).agg(F.sum("q").alias("_q"))
    g = group
    for other in (ties(bx, "_tx"), ties(by_, "_ty"), q):
        g = joined(g, other, by)
    pairs = F.col("n") * (F.col("n") - 1) / 2
    s = pairs - F.col("_tx") - F.col("_ty") + F.col("_both") - 2 * F.coalesce("_q", F.lit(0))
    flat = (F.col("_tx") == pairs) | (F.col("_ty") == pairs)
    reason = F.when(F.col("n") < 3, "too_few").when(flat, "no_variance")
    return g.select(*by, "n", F.when(reason.isNull(), r6(s / F.sqrt((pairs - F.col("_tx")) * (pairs - F.col("_ty"))))).alias("tau_b"), reason.alias("undefined_reason"))
