"""Sections of sessions: headers, log-driven boundaries, floors, windows, excerpts by words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.text import n_words, r6, ratio
from .literals import literal_hits, terms_of


def by_turn():
    return W.partitionBy("session_id").orderBy("turn_index")


def so_far():
    return by_turn().rowsBetween(W.unboundedPreceding, 0)


def by_headers(turns: DataFrame, number: Column) -> DataFrame:
    """Section of each turn by the last header number so far (NULL before the first), with a warning on headers that repeat, go back or
    leave a gap."""
    df = turns.withColumn("header", number)
    df = df.withColumn("section_no", F.last("header", ignorenulls=True).over(so_far()))
    before = F.last("header", ignorenulls=True).over(by_turn().rowsBetween(W.unboundedPreceding, -1))
    warn = F.when(F.col("header").isNotNull(), F.when(before.isNull(), F.lit(None).cast("string")).when(F.col("header") == before, "duplicate").when(F.col("header") < before, "out_of_order").when(F.col("header") > before + 1, "gap"))
    return df.withColumn("warning", warn).select("session_id", "turn_index", "header", "section_no", "warning")


def by_log(turns: DataFrame, log: DataFrame, sections: int) -> DataFrame:
    """Sections opened by the transition rows of a log (session_id, ord, turn_index, utterance): in the order of the log each is matched to a moderator
    turn of its number and text (case and white space apart), the k-th of equal rows to the k-th of equal turns. At most sections - 1 open one; rows up to the
    last of these without a turn are `missing`; `monotonic` says whether the boundaries follow each other as in the log. Blank utterances don't count."""
    # capitals, not lower case: a log in capitals has SS where the turn has ß (and lower(upper(x)) won't do, Spark shortens it to lower(x))
    key = lambda c: F.trim(F.regexp_replace(F.upper(c), r"\s+", " "))
    same = lambda order: F.row_number().over(W.partitionBy("session_id", "turn_index", "_k").orderBy(order))
    rows = log.withColumn("_k", key("utterance")).where("_k != ''").withColumn("_i", same("ord"))
    said = turns.where("role = 'moderator'").select("session_id", "turn_index", key("text").alias("_k")).withColumn("_i", same("turn_index")).withColumn("_hit", F.lit(1))
    rows = rows.join(said.hint("merge"), ["session_id", "turn_index", "_k", "_i"], "left").withColumn("_hit", F.coalesce("_hit", F.lit(0)))
    in_log = W.partitionBy("session_id").orderBy("ord")
    rows = rows.withColumn("_done", F.sum("_hit").over(in_log) - F.col("_hit")).where(F.col("_done") < sections - 1)
    missing = rows.groupBy("session_id").agg(F.count_if(F.col("_hit") == 0).alias("missing"))
    bounds = rows.where("_hit = 1").withColumn("_back", F.coalesce(F.lag("turn_index").over(in_log) > F.col("turn_index"), F.lit(False)))
    order = bounds.groupBy("session_id").agg((~F.bool_or("_back")).alias("monotonic"))
    opened = bounds.groupBy("session_id", "turn_index").agg(F.count(F.lit(1)).alias("_b"))
    df = turns.join(opened.hint("merge"), ["session_id", "turn_index"], "left").withColumn("section_no", F.sum(F.coalesce("_b", F.lit(0))).over(so_far()))
    df = df.join(missing.hint("merge"), "session_id", "left").join(order.hint("merge"), "session_id", "left")
    return df.select("session_id", "turn_index", "section_no", F.coalesce("missing", F.lit(0)).alias("missing"), F.coalesce("monotonic", F.lit(True)).alias("monotonic"))


def crosscheck(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two segmentations turn by turn: agreeing, off by one section, in conflict, or only in one."""
    j = a.select("session_id", "turn_index", F.col("section_no").alias("x")).join(b.select("session_id", "turn_index", F.col("section_no").alias("y")), ["session_id", "turn_index"], "full")
    state = F.when(F.col("x").isNull() | F.col("y").isNull(), "one_sided").when(F.col("x") == F.col("y"), "agree").when(F.abs(F.col("x") - F.col("y")) == 1, "boundary").otherwise("conflict")
    return j.withColumn("s", state).groupBy("session_id").pivot("s", ["agree", "boundary", "conflict", "one_sided"]).count().na.fill(0)


def sections(turns: DataFrame, least_turns: int = 3, least_words: int = 150) -> DataFrame:
    """Per section: turns, words, distinct participants, and whether it meets the floor."""
    part = F.col("role") == "participant"
    g = turns.groupBy("session_id", "section").agg(
        F.count(F.lit(1)).alias("turns"), F.count_if(F.coalesce(part, F.lit(False))).alias("participant_turns"), F.sum(F.when(part, F.col("n_words")).otherwise(0)).alias("words"), F.count_distinct(F.when(part, F.col("speaker_id"))).alias("participants")
    )
    return g.withColumn("meets_floor", (F.col("participant_turns") >= least_turns) & (F.col("words") >= least_words))


def comparable(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sections (group_id, section, meets_floor) on both sides above the floor, or the reason why one is skipped."""
    j = a.select("group_id", "section", F.col("meets_floor").alias("fa")).join(b.select("group_id", "section", F.col("meets_floor").alias("fb")), ["group_id", "section"], "full")
    reason = F.when(F.col("fa").isNull(), "missing_a").when(F.col("fb").isNull(), "missing_b").when(~F.col("fa"), "thin_a").when(~F.col("fb"), "thin_b")
    return j.select("group_id", "section", reason.alias("skip"), reason.isNull().alias("comparable"))


def window_cut(turns: DataFrame, anchor: Column, closing: Column) -> DataFrame:
    """Turns from the first that poses the anchor up to before the last closing turn after it; sessions without an anchor keep none."""
    b = turns.groupBy("session_id").agg(F.min(F.when(anchor, F.col("turn_index"))).alias("start"), F.max(F.when(closing, F.col("turn_index"))).alias("_close"))
    b = b.withColumn("stop", F.when(F.col("_close") > F.col("start"), F.col("_close")))
    inside = F.coalesce((F.col("turn_index") >= F.col("start")) & (F.col("stop").isNull() | (F.col("turn_index") < F.col("stop"))), F.lit(False))
    return turns.join(b, "session_id").groupBy("session_id", "start", "stop").agg(F.count_if(inside).alias("included"), F.count_if(~inside).alias("excluded"), F.sum(F.when(inside, F.col("n_words")).otherwise(0)).alias("words"))


def ask_offset(turns: DataFrame, ask: str, lead: str, residue: str) -> DataFrame:
    """Adds `offset`, dropped_words and review for boundary turns: where the ask starts inside the text, in code points from 0.

    The last sentence that matches `ask` is the anchor; it's extended back over each earlier sentence that matches `ask` or `lead` and not `residue`, up to
    the first that fails. review is `clean` (starts at 0), `trimmed`, or `human` with a null offset: no ask, or residue in what is kept.
    """
    df = turns.withColumn("_s", F.split(F.coalesce("text", F.lit("")), r"(?<=[.!?])(?=\s)"))
    last = lambda test: F.array_max(F.filter(F.transform("_s", lambda x, i: F.when(test(x, i), i)), lambda i: i.isNotNull()))
    df = df.withColumn("_a", last(lambda x, i: x.rlike(ask)))
    stop = last(lambda x, i: (i < F.col("_a")) & ~(x.rlike(f"{ask}|{lead}") & ~x.rlike(residue)))
    df = df.withColumn("_lo", F.when(F.col("_a").isNotNull(), F.coalesce(stop + 1, F.lit(0))))
    head = F.array_join(F.slice("_s", 1, F.coalesce("_lo", F.lit(0))), "")
    kept = F.array_join(F.slice("_s", F.coalesce("_lo", F.lit(0)) + 1, F.size("_s")), "")
    gap = F.char_length(kept) - F.char_length(F.regexp_replace(kept, r"^\s+", ""))
    ok = F.col("_lo").isNotNull() & ~kept.rlike(residue)
    df = df.withColumns({"offset": F.when(ok, F.char_length(head) + F.when(F.col("_lo") > 0, gap).otherwise(0)), "dropped_words": F.when(ok, n_words(head))})
    return df.withColumn("review", F.when(~ok, "human").when(F.col("offset") == 0, "clean").otherwise("trimmed")).drop("_s", "_a", "_lo")


def openers(turns: DataFrame, questions: DataFrame) -> DataFrame:
    """The latest question (by terms) that a moderator turn asks decides; a question opens once, as the successor of the highest opened so
    far; later asks are reformulations. questions: question, term."""
    t = turns.where("role = 'moderator'").select("session_id", "turn_index", F.lower("text").alias("_low"))
    asks = literal_hits(t, ["session_id", "turn_index"], "_low", terms_of(questions, "term")).join(tx.listed(questions), "term")
    q = asks.groupBy("session_id", "turn_index").agg(F.max_by("question", F.struct("first", "question")).alias("question"))
    before = by_turn().rowsBetween(W.unboundedPreceding, -1)
    first = F.row_number().over(W.partitionBy("session_id", "question").orderBy("turn_index")) == 1
    q = q.withColumn("_first", first).withColumn("_top", F.coalesce(F.max("question").over(before), F.lit(0)))
    return q.select("session_id", "turn_index", "question", F.when(F.col("_first") & (F.col("question") == F.col("_top") + 1), "opens").when(F.col("_first"), "out_of_turn").otherwise("reformulates").alias("kind"))


def word_budget(turns: DataFrame, target: int, starts: int = 10, least: float = 0.9) -> DataFrame:
    """From every start the longest run of turns within `target` words; runs of at least 90 % are eligible, and up to `starts` evenly
    spaced ones are selected, from a phase that the hash of the session sets."""
    c = turns.withColumn("_cum", F.sum("n_words").over(so_far()))
    # starts and stops are events on the running sum of words; within reach of a start is a range of that sum
    event = F.array(F.struct((F.col("_cum") - F.col("n_words")).alias("at"), F.lit(None).cast("bigint").alias("stop")), F.struct(F.col("_cum").alias("at"), F.col("turn_index").cast("bigint").alias("stop")))
    e = c.select("session_id", "turn_index", F.explode(event).alias("e")).select("session_id", "turn_index", "e.*")
    reach = W.partitionBy("session_id").orderBy("at").rangeBetween(0, target)
    run = e.withColumn("_last", F.max(F.when(F.col("stop").isNotNull(), F.struct("stop", "at"))).over(reach)).where("stop is null and _last.stop >= turn_index")
    run = run.select("session_id", F.col("turn_index").alias("start"), F.col("_last.stop").alias("stop"), (F.col("_last.at") - F.col("at")).alias("words")).where(F.col("words") >= least * target)
    w = W.partitionBy("session_id")
    run = run.withColumns({"_i": F.row_number().over(w.orderBy("start")) - 1, "_n": F.count(F.lit(1)).over(w)})
    seed = F.conv(F.substring(F.sha2(F.col("session_id").cast("string"), 256), 1, 8), 16, 10).cast("long")
    picks = F.transform(F.sequence(F.lit(0), F.lit(starts - 1)), lambda i: F.floor((i + (seed % 1000) / 1000.0) * (F.col("_n") / starts)))
    return run.where((F.col("_n") <= starts) | F.array_contains(picks, F.col("_i").cast("long"))).select("session_id", "start", "stop", "words")


def completeness(turns: DataFrame, required: int) -> DataFrame:
    """First moderator turn per section, and the share of required sections with a participant turn."""
    mod, part = F.col("role") == "moderator", F.col("role") == "participant"
    s = turns.groupBy("session_id", "section").agg(F.min(F.when(mod, F.col("turn_index"))).alias("opener"), F.bool_or(F.coalesce(part, F.lit(False))).alias("answered"))
    g = s.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("section", "opener"))).alias("openers"), F.array_sort(F.collect_set(F.when(F.col("answered") & (F.col("section") < required), F.col("section")))).alias("_have"))
    return g.select("session_id", F.size("openers").alias("sections"), r6(F.size("_have") / F.lit(required)).alias("share"), F.array_sort(F.array_except(F.sequence(F.lit(0), F.lit(required - 1)), "_have")).alias("missing"))


def guide_coverage(turns: DataFrame, total: int) -> DataFrame:
    """Sections completed and skipped, moves between sections, and questions asked in the first and second half."""
    df = turns.withColumns({"_move": F.coalesce(F.col("section") != F.lag("section").over(by_turn()), F.lit(False)), "_ask": (F.col("role") == "moderator") & F.contains("text", F.lit("?"))})
    ask = lambda t: F.count_if(F.coalesce(F.col("_ask") & t, F.lit(False)))
    return df.groupBy("session_id").agg(
        F.count_distinct("section").alias("completed"), (total - F.count_distinct("section")).alias("skipped"), F.count_if("_move").alias("moves"), ask(F.col("section") < total / 2).alias("early_asks"), ask(F.col("section") >= total / 2).alias("late_asks")
    )
