"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

Targets are weights filled like water up to a greatest number of repeats. The schedule maps the golden-ratio sequence
frac((i + 1) * phi) through the cumulative targets, so each prefix of the mix is close to the targets; a slot's rank inside its
source names the block it takes. Each source is shuffled by hash and cut into blocks of equal words; block `rank mod blocks` of
epoch `rank div blocks` is joined to the slot. The length of a block is its source's own, so that a small source is many blocks
too; a source's share of the slots is its target in blocks.

Defined results: null text has size 0; null source is a source of its own, after the others; an empty table gives no rows; a
source without words has target 0 and its documents take 0. Rows that repeat a doc_id count as documents of their own in the
schedule. The order inside a source depends on doc_id, text length and seed only,
so reruns agree. Extra columns pass through `mixed_documents`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import n_words, running_sum, top_bits, written

WEIGHTS = (5.0, 2.0, 1.0)
REPEATS = 3
#: Slots are at least so many where the corpus has that many words, and blocks at most so long.
LEAST_SLOTS, BLOCK = 2**17, 4096
#: A source's words, and its target, are at least so many blocks where they are that many words.
LEAST_BLOCKS = 256
#: The fraction of the golden ratio times 2**32, less 2**32 so that its product with a slot's low 32 bits fits a long.
PHI = 2654435769 - 2**32
#: The unit interval is cut into so many cells at least, and four a source, by which slots find their source.
CELLS = 4096
#: Rows of sources are broadcast up to this measured size; beyond it they are joined by merging.
BROADCAST_BYTES = 2**23


def beside(sources: DataFrame) -> DataFrame:
    """Rows of sources (a written table with `_src`), hinted for a join: broadcast if they are measured to be small, else merged."""
    size = sources.agg(F.sum(F.octet_length("_src") + 64)).first()[0] or 0
    return F.broadcast(sources) if size <= BROADCAST_BYTES else sources.hint("merge")


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, repeats: float = REPEATS) -> DataFrame:
    """A row for each source: _none, _src (its key), source_size, target, block_words, blocks, slots (its target in blocks), lo, hi
    (its share of the unit interval), total.

    With sources in ascending order of cap / weight, those at their cap come first: the water level after the first k are capped
    is (total - their caps) / (weights of the rest), and a source is capped if its cap / weight is not above the level that holds
    before it. One row a source, so the window is as small as the list of sources.
    """
    by = sized.groupBy("_none", "_src").agg(F.sum("size").alias("source_size"))
    place = (F.row_number().over(W.orderBy("_none", "_src")) - 1) % len(weights)
    order = W.orderBy("_ratio", "_none", "_src")
    upto, all_ = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    level = (F.col("total") - F.coalesce(F.sum("_cap").over(upto), F.lit(0.0))) / (F.sum("_weight").over(all_) - F.coalesce(F.sum("_weight").over(upto), F.lit(0.0)))
    walk = W.orderBy("_none", "_src").rowsBetween(W.unboundedPreceding, 0)
    return (
        by.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")))
        .withColumns({"_cap": F.col("source_size") * F.lit(float(repeats)), "total": F.sum("source_size").over(all_)})
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_level", level)
        .withColumn("_free", F.col("_ratio") > F.col("_level"))
        .withColumn("_at", F.min(F.when(F.col("_free"), F.struct("_ratio", "_none", "_src", "_level"))).over(all_)["_level"])
        .withColumn("target", F.when(F.col("_free"), F.col("_weight") * F.col("_at")).otherwise(F.col("_cap")))
        .withColumn("block_words", F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.col("total") / LEAST_SLOTS), F.floor(F.least("source_size", "target") / LEAST_BLOCKS))).cast("long"))
        .withColumn("blocks", F.ceil(F.col("source_size") / F.col("block_words")).cast("long"))
        # a last block may be short: a slot gives source_size / blocks words on average
        .withColumn("slots", F.coalesce(F.try_divide(F.col("target") * F.col("blocks"), F.col("source_size")), F.lit(0.0)))
        .withColumn("hi", F.coalesce(F.try_divide(F.sum("slots").over(walk), F.sum("slots").over(all_)), F.lit(0.0)))
        .withColumn("lo", F.coalesce(F.lag("hi").over(W.orderBy("_none", "_src")), F.lit(0.0)))
        .select("_none", "_src", "source_size", "target", "block_words", "blocks", "slots", "lo", "hi", "total")
    )


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select(
        "doc_id", n_words(F.col("text")).alias("size"), F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_src"),
        F.xxhash64(F.lit(seed), "doc_id", F.char_length(F.coalesce("text", F.lit("")))).alias("_h"),
    )


def schedule(spark, targets: DataFrame, n_cells: int, slots: int) -> DataFrame:
    """The slots of the mix in order: slot, _none, _src, rank (among the source's slots). A slot's point is held against the sources
    of its cell; points fall evenly, so no cell is hot. Slots are cut into chunks, ranked inside a chunk, and raised by the
    counts of the chunks before it."""
    cells = F.sequence(F.floor(F.col("lo") * n_cells), F.floor(F.col("hi") * n_cells))
    edges = written(targets.where("lo < hi").select("_none", "_src", "lo", "hi", F.explode(cells).alias("_cell")), "edges")
    point = F.pmod(F.pmod(F.col("slot") + 1, F.lit(2**32)) * F.lit(PHI), F.lit(2**32)) / F.lit(float(2**32))
    got = spark.range(slots).withColumnRenamed("id", "slot").withColumn("_p", point).withColumn("_cell", F.floor(F.col("_p") * n_cells))
    got = got.join(beside(edges), "_cell").where("_p >= lo and _p < hi").drop("lo", "hi", "_p", "_cell")
    chunk = (F.col("slot") * 65536 / F.lit(max(slots, 1))).cast("long")
    got = got.withColumn("_h", F.shiftleft(chunk, 48).bitwiseOR(F.col("slot")))
    return running_sum(got, ["_none", "_src"], "_h", [], F.lit(1), "rank", slots).drop("_h")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, repeats: int = REPEATS, seed: int = 17) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sized documents with their place `start` in the source's shuffled stream and their source's columns, targets, taken blocks).

    Taken blocks have a row for each slot: slot, _none, _src, epoch, block.
    """
    spark = docs.sparkSession
    sized = written(_sized(docs, seed), "sized")
    targets = written(source_targets(sized, weights, repeats), "targets")
    n_sources, slots = targets.agg(F.count(F.lit(1)), F.sum("slots")).first()
    placed = written(running_sum(sized, ["_none", "_src"], "_h", ["doc_id", "size"], F.col("size"), "start", sized.count()), "placed")
    placed = placed.join(beside(targets.select("_none", "_src", "source_size", "target", "block_words", "blocks")), ["_none", "_src"])
    taken = (
        schedule(spark, targets, max(CELLS, 4 * n_sources), round(slots or 0))
        .join(beside(targets.select("_none", "_src", "blocks")), ["_none", "_src"])
        .where(F.col("rank") < F.col("blocks") * repeats)
        .select("slot", "_none", "_src", (F.col("rank") / F.col("blocks")).cast("long").alias("epoch"), (F.col("rank") % F.col("blocks")).alias("block"))
    )
    return placed, targets, written(taken, "taken")


def _first(c: str) -> Column:
    return (F.col(c) / F.col("block_words")).cast("long")


def mix_report(docs: DataFrame, weights: Sequence[float] = WEIGHTS, repeats: int = REPEATS, seed: int = 17) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, taken."""
    placed, _, taken = mix(docs, weights, repeats, seed)
    lo, hi = F.greatest("start", F.col("block") * F.col("block_words")), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("block_words"))
    parts = placed.where("size > 0").select("_none", "_src", "start", "size", "block_words", F.explode(F.sequence(_first("start"), ((F.col("start") + F.col("size") - 1) / F.col("block_words")).cast("long"))).alias("block"))
    times = taken.groupBy("_none", "_src", "block").agg(F.count(F.lit(1)).alias("_times"))
    got = parts.join(times.hint("merge"), ["_none", "_src", "block"]).groupBy("_none", "_src", "start").agg(F.sum(F.col("_times") * (hi - lo)).alias("_got"))
    # the start is a document's own among those of its source that have words
    got = got.select(F.col("_none").alias("_n"), F.col("_src").alias("_s"), F.col("start").alias("_at"), "_got").hint("merge")
    return (
        placed.join(got, (placed["_none"] == got["_n"]) & (placed["_src"] == got["_s"]) & (placed["start"] == got["_at"]) & (placed["size"] > 0), "left")
        .select("doc_id", "size", "source_size", "target", F.coalesce("_got", F.lit(0)).cast("long").alias("taken"))
    )


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, repeats: int = REPEATS, seed: int = 17) -> DataFrame:
    """The mix in whole documents: each document appears once for each time that the block with its first word is taken."""
    placed, _, taken = mix(docs, weights, repeats, seed)
    at = placed.withColumn("block", F.least(_first("start"), F.col("blocks") - 1))
    times = taken.groupBy("_none", "_src", "block").agg(F.count(F.lit(1)).cast("int").alias("_times"))
    times = at.join(times.hint("merge"), ["_none", "_src", "block"]).select(F.col("doc_id").alias("_id"), F.col("_h").alias("_k"), "_times").groupBy("_id", "_k").agg(F.max("_times").alias("_times"))
    rows = docs.select(F.struct("*").alias("_row"), F.xxhash64(F.lit(seed), "doc_id", F.char_length(F.coalesce("text", F.lit("")))).alias("_k"))
    got = rows.join(times.hint("merge"), (rows["_k"] == times["_k"]) & F.col("_row.doc_id").eqNullSafe(F.col("_id")))
    return got.select("_row", F.explode(F.sequence(F.lit(1), "_times")).alias("_n")).select("_row.*")
