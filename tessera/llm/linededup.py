"""Line dedup by winnowing over line hashes, in DataFrame and SQL functions only.

A document's lines with a word are hashed. Of every RUN consecutive line hashes the least (the last of ties) is its fingerprint, so any
run of RUN lines that occurs twice is guaranteed to share one. Fingerprints that occur once in the corpus end there. The places
of the others are joined to the first place of the same window of lines, and matches are extended both ways: windows that
follow each other in a document and are all later repeats form one maximal run. Later repeated runs are deleted, with the blank
lines inside them; the first occurrence, in the order of doc_id and line, stays.

Lines are compared without the white space at their ends. Windows are judged on the input and may overlap. Defined results: null
and empty texts have no lines with words and lose nothing; a null doc_id sorts last; rows that repeat a doc_id and its text are one document and lose nothing
to each other; extra columns pass through `remove_repeated_lines`; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

RUN = 3
_BLANK = r"\\x20\\x09\\x0B-\\x0D"


def _windows(docs: DataFrame, run: int) -> DataFrame:
    """A row for each window of `run` lines with words: its number j, its first and last line a and b, its fingerprint, whether the
    fingerprint is a newly selected one, and the MD5 of its lines' MD5s."""
    df = docs.select(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), F.xxhash64("doc_id", "text").alias("key"), F.coalesce("text", F.lit("")).alias("t")).distinct()
    lines = f"filter(transform(split(t, '\\n', -1), (x, i) -> struct(i, regexp_replace(x, '^[{_BLANK}]+|[{_BLANK}]+$', '') as x)), l -> l.x != '')"
    df = df.select("id", "key", F.expr(f"transform({lines}, l -> struct(l.i as i, unhex(md5(l.x)) as h, xxhash64(l.x) as f))").alias("l"))
    least = f"array_min(transform(slice(l, j + 1, {run}), (x, k) -> struct(x.f as f, -(j + k) as p)))"
    key = f"unhex(md5(aggregate(slice(l, j + 1, {run}), X'', (s, x) -> concat(s, x.h))))"
    window = f"struct(j, get(l, j).i as a, get(l, j + {run - 1}).i as b, {least} as w, {key} as k)"
    df = df.select("id", "key", F.expr(f"if(size(l) >= {run}, transform(sequence(0, size(l) - {run}), j -> {window}), array())").alias("v"))
    new = "coalesce(x.w.p != get(v, x.j - 1).w.p, true)"
    return df.select("id", "key", F.expr(f"inline(transform(v, x -> struct(x.j as j, x.a as a, x.b as b, x.w.f as print, {new} as picked, x.k as k)))"))


def repeated_runs(docs: DataFrame, run: int = RUN) -> DataFrame:
    """(id, key, a, b): maximal runs of lines a..b whose every window is a later repeat."""
    all_ = written(_windows(docs, run), "line-windows")
    prints = all_.where("picked").groupBy("print").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("print")
    alive = written(all_.join(prints.hint("merge"), "print", "left_semi"), "line-places")
    first = written(alive.groupBy("k").agg(F.min(F.struct("id", "key", "j")).alias("at"), F.count(F.lit(1)).alias("n")).where("n > 1").select("k", "at"), "line-firsts")
    later = alive.join(first.hint("merge"), "k").where(F.struct("id", "key", "j") > F.col("at"))
    order = W.partitionBy("id", "key").orderBy("j")
    step = F.when(F.lag("j").over(order) == F.col("j") - 1, 0).otherwise(1)
    runs = later.withColumn("_new", step).withColumn("_run", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("id", "key", "_run").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("_run")


def _marked(docs: DataFrame, head, run: int) -> DataFrame:
    """`head`, _l (the lines), _k (those that stay)."""
    runs = repeated_runs(docs, run).groupBy("id", "key").agg(F.collect_list(F.struct("a", "b")).alias("_runs"))
    rows = docs.select(head, F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), F.xxhash64("doc_id", "text").alias("key"), F.coalesce("text", F.lit("")).alias("_t"))
    df = rows.join(runs.hint("merge"), ["id", "key"], "left").withColumn("_l", F.split("_t", "\n", -1))
    return df.withColumn("_k", F.expr("if(_runs is null, _l, filter(_l, (x, i) -> not exists(_runs, r -> i between r.a and r.b)))"))


def line_report(docs: DataFrame, run: int = RUN) -> DataFrame:
    """One row for each document: doc_id, n_lines, n_removed, kept_sha256 (of the lines that stay, joined by line feeds)."""
    df = _marked(docs, F.col("doc_id"), run)
    return df.select("doc_id", F.size("_l").cast("long").alias("n_lines"), (F.size("_l") - F.size("_k")).cast("long").alias("n_removed"), F.sha2(F.array_join("_k", "\n"), 256).alias("kept_sha256"))


def remove_repeated_lines(docs: DataFrame, run: int = RUN) -> DataFrame:
    """The documents without their later repeated runs; a null text stays null."""
    df = _marked(docs, F.struct("*").alias("_row"), run)
    text = F.when(F.col("_row.text").isNotNull(), F.array_join("_k", "\n"))
    return df.withColumn("_row", F.col("_row").withField("text", text)).select("_row.*")
