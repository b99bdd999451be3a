"""Turn-taking structure of sessions: shares, adjacency, chains, lengths, concentration, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import r6, ratio
from .order import at_places, joined, quantiles

BINS = (0, 10, 25, 50, 100, 200, 250, 300)


def is_mod() -> Column:
    return F.col("role") == "moderator"


def is_part() -> Column:
    return F.col("role") == "participant"


def _count(test: Column) -> Column:
    return F.count_if(F.coalesce(test, F.lit(False)))


def window_counts(turns: DataFrame) -> DataFrame:
    """Per session: words, participant and moderator turns, included and skipped (blank) turns."""
    full = F.col("n_words") > 0
    return turns.groupBy("session_id").agg(
        F.sum("n_words").alias("words"), _count(is_part() & full).alias("participant_turns"), _count(is_mod() & full).alias("moderator_turns"), _count(full).alias("included"), _count(~full).alias("skipped")
    )


def turn_lengths(turns: DataFrame) -> DataFrame:
    """Per session: median and exclusive IQR (quartiles at place q (n + 1), between neighbours; NULL under four values) of participant words a turn, shares of turns under 10, 25 and 50 words."""
    own = turns.where(is_part() & (F.col("n_words") > 0))
    share = lambda k: r6(F.avg((F.col("n_words") < k).cast("double"))).alias(f"under_{k}")
    got = own.groupBy("session_id").agg(share(10), share(25), share(50))
    h = lambda q, n: F.lit(q) * (n + 1)
    places = {"_lo": lambda n: F.floor((n - 1) / 2), "_hi": lambda n: F.ceil((n - 1) / 2)}
    places |= {f"_{end}{k}": (lambda q, end: lambda n: F.floor(h(q, n)) - 1 if end == "a" else F.least(F.floor(h(q, n)), n - 1))(q, end) for k, q in ((1, 0.25), (3, 0.75)) for end in "ab"}
    at = at_places(own, ["session_id"], "n_words", places)
    quartile = lambda k, q: F.col(f"_a{k}") + (F.col(f"_b{k}") - F.col(f"_a{k}")) * (h(q, F.col("n")) - F.floor(h(q, F.col("n"))))
    at = at.select("session_id", "n", ((F.col("_lo") + F.col("_hi")) / 2).alias("median_words"), r6(F.when(F.col("n") >= 4, quartile(3, 0.75) - quartile(1, 0.25))).alias("iqr"))
    return joined(at, got, ["session_id"], "inner").select("session_id", "n", "median_words", "under_10", "under_25", "under_50", "iqr")


def gini(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """Gini of a value within `by`; NULL with fewer than two members or a zero total."""
    rank = values.withColumn("_i", F.row_number().over(W.partitionBy(*by).orderBy(value)))
    n, total = F.count(F.lit(1)), F.sum(value)
    g = ratio(2 * F.sum(F.col("_i") * F.col(value)) - (n + 1) * total, n * total)
    return rank.groupBy(*by).agg(n.alias("members"), r6(F.when(n >= 2, g)).alias("gini"))


def speaker_totals(turns: DataFrame) -> DataFrame:
    return turns.where(is_part()).groupBy("session_id", "speaker_id").agg(F.count(F.lit(1)).alias("turns"), F.sum("n_words").alias("words"))


def moderator_shares(turns: DataFrame) -> DataFrame:
    words = F.sum(F.when(is_mod(), F.col("n_words")).otherwise(0))
    return turns.where("role is not null").groupBy("session_id").agg(r6(ratio(_count(is_mod()), F.count(F.lit(1)))).alias("turn_share"), r6(ratio(words, F.sum("n_words"))).alias("word_share"))


def _ordered(turns: DataFrame) -> tuple[DataFrame, W]:
    return turns.where("role is not null"), W.partitionBy("session_id").orderBy("turn_index")


def adjacency(turns: DataFrame) -> DataFrame:
    """Participant-to-participant moves as a share of all moves, and moves between different participants as a share of their turns."""
    df, w = _ordered(turns)
    df = df.withColumns({"_r": F.lag("role").over(w), "_s": F.lag("speaker_id").over(w)})
    both = is_part() & (F.col("_r") == "participant")
    return df.groupBy("session_id").agg(
        r6(ratio(_count(both), F.count(F.lit(1)) - 1)).alias("adjacency"), r6(ratio(_count(both & (F.col("_s") != F.col("speaker_id"))), _count(is_part()))).alias("cross_speaker")
    )


def chains(turns: DataFrame) -> DataFrame:
    """Runs of participant turns that no moderator turn interrupts: session_id, island, depth."""
    df, w = _ordered(turns)
    island = F.sum(F.when(is_mod(), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("island", island).where(is_part()).groupBy("session_id", "island").agg(F.count(F.lit(1)).alias("depth"))


def chain_depth(turns: DataFrame) -> DataFrame:
    d = F.col("depth")
    share = lambda k: r6(ratio(F.sum(F.when(d >= k, d).otherwise(0)), F.sum(d))).alias(f"in_{k}_plus")
    return chains(turns).groupBy("session_id").agg(r6(F.avg(d)).alias("mean_depth"), F.max(d).alias("max_depth"), F.count(F.lit(1)).alias("n_chains"), share(3), share(5))


def distributions(turns: DataFrame) -> DataFrame:
    """Long rows (session_id, distribution_id, element_label, value) of words a turn, a speaker's turns and words, and chain depths."""
    totals = speaker_totals(turns)
    row = lambda df, name, label, value: df.select("session_id", F.lit(name).alias("distribution_id"), F.col(label).cast("string").alias("element_label"), F.col(value).cast("double").alias("value"))
    return (
        row(turns.where(is_part()), "words_per_turn", "turn_index", "n_words").unionByName(row(totals, "speaker_turns", "speaker_id", "turns"))
        .unionByName(row(totals, "speaker_words", "speaker_id", "words")).unionByName(row(chains(turns), "chain_depth", "island", "depth"))
    )


def entropy(turns: DataFrame) -> DataFrame:
    """Shannon entropy of participation in bits, and its share of the greatest for as many speakers."""
    t = speaker_totals(turns)
    total = F.sum("turns").over(W.partitionBy("session_id"))
    p = t.withColumn("p", F.col("turns") / total)
    h, n = -F.sum(F.col("p") * F.log2("p")), F.count(F.lit(1))
    return p.groupBy("session_id").agg(n.alias("speakers"), r6(h + 0.0).alias("bits"), r6(F.when(n > 1, h / F.log2(n))).alias("normalised"))


def process(turns: DataFrame) -> DataFrame:
    """Participants, longest run of one speaker, words a turn, and whether the sample is enough; imbalance if a speaker has 60 % of turns."""
    df, w = _ordered(turns)
    new = F.when(F.lag("speaker_id").over(w) == F.col("speaker_id"), 0).otherwise(1)
    df = df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = df.groupBy("session_id", "_run", "speaker_id").agg(F.count(F.lit(1)).alias("n")).groupBy("session_id").agg(F.max("n").alias("longest_run"))
    most = speaker_totals(turns).groupBy("session_id").agg(F.max("turns").alias("_most"), F.sum("turns").alias("participant_turns"), F.count(F.lit(1)).alias("participants"))
    own = df.where(is_part()).groupBy("session_id").agg(r6(F.avg("n_words")).alias("avg_words"), F.min("n_words").alias("min_words"), F.max("n_words").alias("max_words"))
    status = F.when(F.col("participant_turns") < 3, "insufficient_sample").otherwise("ok")
    return (
        runs.join(most, "session_id").join(own, "session_id")
        .withColumns({"status": status, "imbalanced": (F.col("participants") > 1) & (ratio("_most", "participant_turns") >= 0.6)}).drop("_most")
    )


def actions(turns: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Moderator turns by the first kind whose pattern they match (or other), with each kind's share of the session's."""
    kind = F.coalesce(*(F.when(F.lower("text").rlike(p), k) for k, p in kinds.items()), F.lit("other"))
    n = turns.where(is_mod()).withColumn("action", kind).groupBy("session_id", "action").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rate", r6(ratio("n", F.sum("n").over(W.partitionBy("session_id")))))


def drift_episodes(turns: DataFrame, off_topic: Column, least: int = 3, within: int = 2) -> DataFrame:
    """Runs of at least `least` off-topic participant turns, and whether one of the next moderator turns redirects (asks)."""
    df, w = _ordered(turns)
    part = df.withColumn("off", off_topic).withColumn("mod_seq", F.sum(F.when(is_mod(), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    own = part.where(is_part()).withColumn("_brk", F.sum(F.when(F.col("off"), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = own.where("off").groupBy("session_id", "_brk").agg(F.count(F.lit(1)).alias("length"), F.min("turn_index").alias("start"), F.max("turn_index").alias("stop"), F.max("mod_seq").alias("seq")).where(F.col("length") >= least)
    mods = part.where(is_mod()).select(F.col("session_id").alias("_s"), F.col("mod_seq").alias("_m"), F.contains("text", F.lit("?")).alias("asks"))
    return (
        runs.join(mods, (F.col("session_id") == F.col("_s")) & F.col("_m").between(F.col("seq") + 1, F.col("seq") + within), "left")
        .groupBy("session_id", "start", "stop", "length").agg(F.coalesce(F.bool_or("asks"), F.lit(False)).alias("redirected"))
    )


def bin_label(n: Column) -> Column:
    edges = [*BINS, None]
    return F.coalesce(*(F.when((n >= a) & (n < b if b is not None else F.lit(True)), f"{a}-{b - 1}" if b is not None else f"{a}+") for a, b in zip(edges, edges[1:], strict=False)))


def binned_shares(turns: DataFrame) -> DataFrame:
    """Share of participant turns in each length bin: within the session, then averaged over a group's sessions, then over groups. Bins
    that a session doesn't use count as 0."""
    own = turns.where(is_part())
    n = own.groupBy("condition", "group_id", "session_id", bin_label(F.col("n_words")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    size = n.groupBy("condition", "group_id", "session_id").agg(F.sum("n").alias("total"))
    labels = turns.sparkSession.createDataFrame([(f"{a}-{b - 1}",) for a, b in zip(BINS, BINS[1:], strict=False)] + [(f"{BINS[-1]}+",)], "bin string")
    grid = size.crossJoin(F.broadcast(labels)).join(n, ["condition", "group_id", "session_id", "bin"], "left")
    cell = grid.withColumn("share", F.coalesce(F.col("n"), F.lit(0)) / F.col("total")).groupBy("condition", "group_id", "bin").agg(F.avg("share").alias("share"))
    return cell.groupBy("condition", "bin").agg(r6(F.avg("share")).alias("mean_share"), r6(F.stddev_samp("share")).alias("sd_share"), F.count(F.lit(1)).alias("groups"))


def location(rows: DataFrame, statistic: Column, name: str) -> DataFrame:
    """A statistic of (condition, group_id, session_id, value) rows inside each session, then mean per group, then per condition."""
    inside = rows.groupBy("condition", "group_id", "session_id").agg(statistic.alias("s"))
    return inside.groupBy("condition", "group_id").agg(F.avg("s").alias("s")).groupBy("condition").agg(r6(F.avg("s")).alias(name), F.count("s").alias("groups"))


def variation(metric: DataFrame) -> DataFrame:
    """(condition, group_id, value): replicates averaged in the group, then mean, SD, CV and range across groups."""
    m = metric.groupBy("condition", "group_id").agg(F.avg("value").alias("v"))
    sd = F.stddev_samp("v")
    return m.groupBy("condition").agg(r6(F.avg("v")).alias("mean"), r6(sd).alias("sd"), r6(ratio(sd, F.avg("v"))).alias("cv"), r6(F.max("v") - F.min("v")).alias("range"))


def sliced_rates(rows: DataFrame, test: Column, by: list[str]) -> DataFrame:
    """The rate of a test over every slice of `by` (CUBE); `grouping` names the slice's level."""
    return rows.cube(*by).agg(F.count(F.lit(1)).alias("n"), r6(F.avg(test.cast("double"))).alias("rate"), F.grouping_id().alias("level"))


def envelope(metric: DataFrame, reference: str = "human") -> DataFrame:
    """Each condition's mean, min and max of a value, against the reference's range: inside yes, partial or no."""
    s = metric.groupBy("condition").agg(F.avg("value").alias("mean"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    ref = s.where(F.col("condition") == reference).select(F.col("lo").alias("ref_lo"), F.col("hi").alias("ref_hi"))
    inside = F.when((F.col("lo") >= F.col("ref_lo")) & (F.col("hi") <= F.col("ref_hi")), "yes").when(F.col("mean").between(F.col("ref_lo"), F.col("ref_hi")), "partial").otherwise("no")
    return s.crossJoin(F.broadcast(ref)).select("condition", r6("mean").alias("mean"), r6("lo").alias("lo"), r6("hi").alias("hi"), inside.alias("inside"))


def length_ratio(turns: DataFrame, reference: str = "human") -> DataFrame:
    """A session's words over the mean words of its group's reference sessions, and the group's reference width (median words a turn)."""
    words = turns.groupBy("condition", "group_id", "session_id").agg(F.sum("n_words").alias("words"))
    width = quantiles(turns.where((F.col("condition") == reference) & is_part()), ["group_id"], "n_words", {"_m": 0.5}).select("group_id", F.floor("_m").cast("long").alias("width"))
    ref = words.where(F.col("condition") == reference).groupBy("group_id").agg(F.avg("words").alias("_ref"))
    return words.where(F.col("condition") != reference).join(ref, "group_id", "left").join(width, "group_id", "left").select("session_id", "group_id", "condition", r6(ratio("words", "_ref")).alias("ratio"), "width")
