"""Packing by optimal length buckets: dynamic programming over the global length histogram, then token-budget batches.

A document's length is its number of ids under the given tokenizer, or a given column. The histogram has a row for each length that occurs, so
what reaches the driver is bounded by the longest text, not by the corpus. The programme chooses at most `k` upper bounds, each a length that
occurs, with the least possible padding sum(count * (bound - length)). Inside a bucket, documents are shuffled by hash and cut into batches of
`budget // bound` documents (one at least), so that a padded batch stays within the token budget.

Defined results: null and empty texts and null lengths have length 0, cost nothing and go in the first bucket; a document longer than the
budget is a batch of its own; texts of any length are encoded whole; repeated rows are packed as rows; an empty table gives no rows; extra columns
pass through, but those named like a result (n_tokens, bucket, batch, place, padding) give way to it.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running_sum, written
from .tokenfiles import token_counts

BUCKETS, BUDGET = 12, 16_384
RESULT = ("n_tokens", "bucket", "batch", "place", "padding")


def optimal_bounds(histogram: list[tuple[int, int]], k: int) -> list[int]:
    """Upper bounds of at most k buckets with the least padding; histogram holds (length, count).

    best[j] is the least cost of the first j + 1 lengths with the buckets so far. Adding one, cost(j) = upto[j + 1] * size[j] + the least over i of
    best[i - 1] - upto[i] * size[j]: lines of falling slope met at rising places, so a hull of lines answers each j in constant time.
    """
    if not histogram:
        return []
    size, n = zip(*sorted(histogram), strict=True)
    upto = [0, *accumulate(n)]
    best, back = [upto[j + 1] * s for j, s in enumerate(size)], []
    for _ in range(min(k, len(size)) - 1):
        hull, head, cost, first = [], 0, [], []
        for j, s in enumerate(size):
            slope, base = -upto[j], best[j - 1] if j else 0
            while len(hull) - head >= 2 and (base - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - slope):
                hull.pop()
            hull.append((slope, base, j))
            while len(hull) - head >= 2 and hull[head + 1][0] * s + hull[head + 1][1] <= hull[head][0] * s + hull[head][1]:
                head += 1
            cost.append(upto[j + 1] * s + hull[head][0] * s + hull[head][1])
            first.append(hull[head][2])
        back.append(first)
        best = cost
    bounds, j = [], len(size) - 1
    for first in reversed([[0] * len(size), *back]):
        bounds.append(size[j])
        if first[j] == 0:
            break
        j = first[j] - 1
    return sorted(bounds)


def _sized(docs: DataFrame, row: Column, length: Column | None, tokenizer: str | None, seed: int) -> DataFrame:
    """_row, _id, _n (the length), _h (the order inside a bucket)."""
    if (length is None) == (tokenizer is None):
        raise ValueError("give either a column of lengths or a tokenizer")
    if length is not None:
        df = docs.select(F.struct(row.alias("_row"), F.col("doc_id").alias("_id")).alias("k"), length.alias("n"))
    else:
        df = docs.select(F.struct(row.alias("_row"), F.col("doc_id").alias("_id")).alias("k"), F.col("text"))
        df = df.mapInArrow(token_counts(tokenizer), f"k {df.schema['k'].dataType.simpleString()}, n long")
    df = df.select("k.*", F.coalesce("n", F.lit(0)).cast("long").alias("_n"))
    return written(df.withColumn("_h", F.xxhash64(F.lit(seed), "_id", "_n")), "sized")


def pack_bounds(sized: DataFrame, buckets: int = BUCKETS) -> list[int]:
    return optimal_bounds([(r["_n"], r["n"]) for r in sized.groupBy("_n").agg(F.count(F.lit(1)).alias("n")).collect()], buckets)


def _packed(sized: DataFrame, buckets: int, budget: int) -> DataFrame:
    bounds = pack_bounds(sized, buckets)
    bound = F.coalesce(*(F.when(F.col("_n") <= b, F.lit(b).cast("long")) for b in bounds)) if bounds else F.lit(0).cast("long")
    ranked = running_sum(sized.withColumn("bucket", bound), ["bucket"], "_h", ["_id"], F.lit(1), "_rank", sized.count())
    fit = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("bucket", F.lit(1)))).cast("long")
    return ranked.withColumns({"n_tokens": F.col("_n"), "batch": F.floor(F.col("_rank") / fit).cast("long"), "place": (F.col("_rank") % fit).cast("int"), "padding": F.col("bucket") - F.col("_n")})


def pack(docs: DataFrame, tokenizer: str | None = None, length: Column | None = None, buckets: int = BUCKETS, budget: int = BUDGET, seed: int = 29) -> DataFrame:
    """The documents with n_tokens, bucket (its bound: what each is padded to), batch (numbered in the bucket), place, padding."""
    row = F.struct(*(f"`{c}`" for c in docs.columns if c.lower() not in RESULT))
    return _packed(_sized(docs, row, length, tokenizer, seed), buckets, budget).select("_row.*", *RESULT)


def pack_ids(docs: DataFrame, tokenizer: str | None = None, length: Column | None = None, buckets: int = BUCKETS, budget: int = BUDGET, seed: int = 29) -> DataFrame:
    """As `pack`, without the texts: doc_id, n_tokens, bucket, batch, place, padding."""
    return _packed(_sized(docs, F.lit(None).cast("int"), length, tokenizer, seed), buckets, budget).select(F.col("_id").alias("doc_id"), *RESULT)
