"""Exact dedup by two-pass Bloom filtering, in DataFrame functions only.

Pass 1 sets two cells of a bitmap for each text's hash. A word of the bitmap is 64 cells; each task folds its rows into words before anything
shuffles, and the words of all tasks are merged: bits seen at all, bits seen an odd number of times, and hits tell which cells were hit twice (where three
hits make that unclear, the whole word counts as hit twice, which a filter may do). Only words with such cells stay, so what is left grows with the
repeats and not with the corpus. Pass 2 tests each row against them: only rows whose every cell was hit twice may be repeats, and only they
shuffle. The rest pass straight through. The filter is broadcast at a measured size of at most BROADCAST_BYTES; a larger one meets the rows by a
merge join. It decides what moves, never what is equal: groups are formed on the SHA-256.

Defined results: a null text counts as empty, and all empty texts are equal; a null doc_id sorts last; rows that repeat a
doc_id and its text are one document, and `exact_dedup` returns one of them (that with the greatest hash of its columns); texts are hashed whole at any
length; an empty table gives no rows; extra columns pass through unchanged, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from .common import SPACE, written

CELLS_PER_ROW = 64
#: A word of the filter is two longs.
BROADCAST_BYTES = 2**26


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", "")


def text_sha256(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def _digest(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), F.unhex(text_sha256(F.col("text"))).alias("sha")
    )


def _cells(sha: Column, bits: int) -> list[Column]:
    mask = F.lit((1 << bits) - 1).cast("long")
    return [F.xxhash64(sha, F.lit(k)).bitwiseAND(mask) for k in range(2)]


def repeated_cells(digest: DataFrame, bits: int) -> DataFrame:
    """The filter, written: words of 64 cells with a bit set for each cell that was, or may have been, hit more than once."""
    bit = F.expr("shiftleft(1L, cast(cell & 63 as int))")
    cells = digest.select(F.explode(F.array(*_cells(F.col("sha"), bits))).alias("cell")).select(F.shiftright("cell", 6).alias("word"), bit.alias("bit"))
    words = cells.groupBy("word").agg(F.bit_or("bit").alias("any"), F.bit_xor("bit").alias("odd"), F.count(F.lit(1)).alias("hits"))
    even = "(any & ~odd)"
    words = words.select("word", F.expr(f"if(hits = bit_count(odd) + 2 * bit_count({even}), {even}, any)").alias("bits"))
    return written(words.where("bits != 0"), "filter")


def filter_bits(rows: int) -> int:
    return max(12, math.ceil(math.log2(CELLS_PER_ROW * max(rows, 1))))


def flag(df: DataFrame, cells: DataFrame, bits: int) -> DataFrame:
    """Adds `maybe`: every cell of the row's `sha` was hit more than once."""
    hit = F.lit(True)
    small = 16 * cells.count() <= BROADCAST_BYTES
    for k, cell in enumerate(_cells(F.col("sha"), bits)):
        side = cells.select(F.col("word").alias(f"_w{k}"), F.col("bits").alias(f"_b{k}"))
        side = F.broadcast(side) if small else side.hint("merge")
        df = df.withColumn(f"_c{k}", cell).join(side, F.shiftright(f"_c{k}", 6) == F.col(f"_w{k}"), "left")
        hit = hit & F.coalesce(F.expr(f"(shiftrightunsigned(_b{k}, cast(_c{k} & 63 as int)) & 1L) = 1L"), F.lit(False))
    return df.withColumn("maybe", hit).drop(*(f"_{c}{k}" for k in range(2) for c in "cwb"))


def _best(n_chars: Column, doc_id: Column, *ties: Column) -> Column:
    """Greatest for the longest text, then the least doc_id; ~x falls as x rises, for every long."""
    return F.struct(n_chars, doc_id.isNotNull(), F.bitwise_not(F.coalesce(doc_id, F.lit(0).cast("long"))), *ties)


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256."""
    digest = written(_digest(docs), "digest")
    bits = filter_bits(digest.count())
    rows = flag(digest, repeated_cells(digest, bits), bits)
    out = lambda keep, size: ("doc_id", keep.alias("keep_id"), size.alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    alone = rows.where("not maybe").select(*out(F.col("doc_id"), F.lit(1).cast("long")))
    maybe = rows.where("maybe")
    # written before it is joined: both sides then shuffle for the join alone, and Spark can split a hot group
    groups = written(maybe.groupBy("sha").agg(F.max_by("doc_id", _best(F.col("n_chars"), F.col("doc_id"))).alias("_keep"), F.count(F.lit(1)).alias("_size")), "groups")
    return alone.unionByName(maybe.join(groups.hint("merge"), "sha").select(*out(F.col("_keep"), F.col("_size"))))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The documents that stay, all their columns unchanged; rows that cannot be repeats don't shuffle."""
    digest = written(_digest(docs), "digest")
    bits = filter_bits(digest.count())
    rows = docs.select(F.struct("*").alias("_row"), F.unhex(text_sha256(F.col("text"))).alias("sha"))
    rows = flag(rows, repeated_cells(digest, bits), bits)
    plain = [F.col(f"_row.`{f.name}`") for f in docs.schema if not isinstance(f.dataType, (MapType, VariantType))]
    best = _best(F.char_length(F.coalesce("_row.text", F.lit(""))), F.col("_row.doc_id"), F.xxhash64(*plain))
    kept = rows.where("maybe").groupBy("sha").agg(F.max_by("_row", best).alias("_row"))
    return rows.where("not maybe").select("_row").union(kept.select("_row")).select("_row.*")
