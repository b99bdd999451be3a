"""Coded evidence: verification of quotes, presence, reach, recurrence, accumulation, alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import f1, normalised, r6, ratio, with_each
from ..scratch import written
from .stats import wilson

CELL = ["condition", "group_id", "replicate"]


def verify_quotes(quotes: DataFrame, turns: DataFrame) -> DataFrame:
    """Each quote against its turn: empty, no_turn, raw, normalised (after folding case, quotes and space) or rejected; then the moderator and
    the speaker rules. quotes: session_id, turn_index, speaker, quote, code."""
    t = turns.select("session_id", "turn_index", "text", "role", "speaker_id").withColumn("_t", F.lit(True))
    j = quotes.join(t, ["session_id", "turn_index"], "left")
    verdict = (
        F.when(F.trim(F.coalesce("quote", F.lit(""))) == "", "no_quote").when(F.col("_t").isNull(), "no_turn")
        .when(~(F.contains("text", "quote") | F.contains(normalised("text"), normalised("quote"))), "not_in_turn")
        .when(F.col("role") == "moderator", "moderator").when(F.col("speaker") != F.col("speaker_id"), "speaker_mismatch").when(F.contains("text", "quote"), "raw").otherwise("normalised")
    )
    return j.select("session_id", "code", "turn_index", "speaker", verdict.alias("verdict"))


def coded_presence(verified: DataFrame, participants: DataFrame) -> DataFrame:
    """Codes of sessions: present if a quote survives; voiced_by, reach (share of the session's participants) and quote validity."""
    good = F.col("verdict").isin("raw", "normalised")
    g = verified.groupBy("session_id", "code").agg(F.count(F.lit(1)).alias("quotes"), F.count_if(good).alias("valid"), F.array_sort(F.collect_set(F.when(good, F.col("speaker")))).alias("voiced_by"))
    return g.join(participants, "session_id").select("session_id", "code", (F.col("valid") > 0).alias("present"), "voiced_by", r6(ratio(F.size("voiced_by"), "participants")).alias("reach"), r6(ratio("valid", "quotes")).alias("validity"))


def coding_failures(coding: DataFrame, turns: DataFrame, allowed: list[str], relational: list[str]) -> DataFrame:
    """Failed codings as rows: unknown label, missing evidence turn, relational label without a visible target."""
    t = turns.select("session_id", F.col("turn_index").alias("evidence")).withColumn("_e", F.lit(True))
    j = coding.join(t, ["session_id", "evidence"], "left")
    fails = F.array_compact(F.array(F.when(~F.col("label").isin(allowed), "unknown_label"), F.when(F.col("_e").isNull(), "no_evidence"), F.when(F.col("label").isin(relational) & F.col("target").isNull(), "no_target")))
    return j.select("session_id", "item", "label", F.explode(fails).alias("failure"))


def overlap_scores(presence: DataFrame, reference: str, parent: Column | None = None) -> DataFrame:
    """Recall, precision and F1 of each session's present codes against the reference session of its group; an empty side is undefined. Codes
    may be lifted to a parent first."""
    p = presence.where("present").select(*CELL, (parent if parent is not None else F.col("code")).alias("code")).distinct()
    ref = p.where(F.col("condition") == reference).select("group_id", "code", F.lit(True).alias("_r"))
    n_ref = ref.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_ref"))
    gen = p.where(F.col("condition") != reference).join(ref, ["group_id", "code"], "left")
    g = gen.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n_gen"), F.count("_r").alias("shared")).join(n_ref, "group_id", "left")
    g = g.withColumns({"_rc": ratio("shared", "n_ref"), "_pc": ratio("shared", "n_gen")})
    return g.select(*CELL, "n_gen", "n_ref", "shared", r6("_rc").alias("recall"), r6("_pc").alias("precision"), r6(f1("_rc", "_pc")).alias("f1"))


def reach(presence: DataFrame, shared_with: str | None = None) -> DataFrame:
    """Mean share of participants that voice a present code; over the codes that the reference has too, if asked."""
    p = presence.where("present")
    if shared_with:
        p = p.join(p.where(F.col("condition") == shared_with).select("group_id", "code"), ["group_id", "code"], "left_semi")
    return p.groupBy(*CELL).agg(F.count(F.lit(1)).alias("codes"), r6(F.avg(ratio("voiced", "participants"))).alias("mean_reach"))


def presence_grid(presence: DataFrame) -> DataFrame:
    """Every session with every code: present or absent, and reach for present ones only. Both dimensions are small."""
    cells = with_each(presence.select(*CELL).distinct(), presence, "code")
    p = presence.where("present").select(*CELL, "code", ratio("voiced", "participants").alias("_v"))
    return cells.join(p, [*CELL, "code"], "left").select(*CELL, "code", F.col("_v").isNotNull().alias("present"), r6("_v").alias("reach"))


def recurrence(presence: DataFrame) -> DataFrame:
    """Groups that hold each code by condition and replicate, 0 where never; and the range over the replicates."""
    n = presence.where("present").groupBy("condition", "replicate", "code").agg(F.count_distinct("group_id").alias("groups"))
    grid = with_each(presence.select("condition", "replicate").distinct(), presence, "code")
    g = grid.join(n, ["condition", "replicate", "code"], "left").withColumn("groups", F.coalesce("groups", F.lit(0)))
    return g.groupBy("condition", "code").agg(F.min("groups").alias("least"), F.max("groups").alias("most"), F.max("groups").alias("_m")).withColumn("never", F.col("_m") == 0).drop("_m")


def accumulation(presence: DataFrame) -> DataFrame:
    """Expected distinct codes after k groups over all orders, in closed form: a code in m of n groups is missed with C(n-m, k) / C(n, k);
    the product form avoids factorials."""
    p = presence.where("present").select("condition", "replicate", "group_id", "code").distinct()
    n = p.groupBy("condition", "replicate").agg(F.count_distinct("group_id").alias("n"))
    m = p.groupBy("condition", "replicate", "code").agg(F.count(F.lit(1)).alias("m")).groupBy("condition", "replicate", "m").agg(F.count(F.lit(1)).alias("codes"))
    j = m.join(n, ["condition", "replicate"]).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    miss = F.aggregate(F.sequence(F.lit(0), F.col("k") - 1), F.lit(1.0), lambda acc, i: acc * F.greatest(F.col("n") - F.col("m") - i, F.lit(0)) / (F.col("n") - i))
    e = j.withColumn("_miss", miss).groupBy("condition", "replicate", "k").agg(F.sum(F.col("codes") * (1 - F.col("_miss"))).alias("e"))
    return e.select("condition", "replicate", "k", r6("e").alias("expected"), r6(F.col("e") - F.coalesce(F.lag("e").over(W.partitionBy("condition", "replicate").orderBy("k")), F.lit(0.0))).alias("gain"))


#: Groups up to which all orders are taken into account: unions over 2^n subsets.
MOST_GROUPS = 12
#: Mean codes added by a further group under which the curve counts as flat.
PLATEAU = 0.5


def accumulation_envelope(presence: DataFrame) -> DataFrame:
    """Distinct codes after k groups of a condition's replicate: mean, least and most over all orders, in the order of the groups, the mean gain, and the plateau: the first k after which
    every further mean gain is under PLATEAU (NULL if there is none).

    A group's codes are bits of longs; unions over all subsets of n groups come from a lattice in which each subset is one smaller by a bitwise or. Beyond MOST_GROUPS groups only the order of
    the groups is given. Groups without a code count as groups."""
    by = ["condition", "replicate"]
    groups = presence.select(*by, "group_id").distinct()
    groups = groups.withColumns({"_i": F.row_number().over(W.partitionBy(*by).orderBy("group_id")) - 1, "n": F.count(F.lit(1)).over(W.partitionBy(*by))})
    codes = presence.where("present").select("code").distinct()
    codes = codes.withColumn("_c", F.row_number().over(W.orderBy("code")) - 1)  # a codebook is a small list
    p = presence.where("present").select(*by, "group_id", "code").distinct().join(groups, [*by, "group_id"]).join(F.broadcast(codes), "code")
    new = p.groupBy(*by, "code").agg(F.min("_i").alias("_i")).groupBy(*by, "_i").agg(F.count(F.lit(1)).alias("_new"))
    seen = groups.select(*by, "n", "_i").join(new, [*by, "_i"], "left").withColumn("observed", F.sum(F.coalesce("_new", F.lit(0))).over(W.partitionBy(*by).orderBy("_i")))
    masks = p.groupBy(*by, "n", F.floor(F.col("_c") / 63).alias("_w"), "_i").agg(F.bit_or(F.expr("shiftleft(1L, cast(_c % 63 as int))")).alias("_m"))
    words = masks.where(F.col("n") <= MOST_GROUPS).groupBy(*by, "n", "_w").agg(F.map_from_entries(F.collect_list(F.struct("_i", "_m"))).alias("_m"))
    lattice = "aggregate(sequence(0, cast(n as int) - 1), array(0L), (u, i) -> concat(u, transform(u, x -> x | coalesce(_m[i], 0L))))"
    subsets = words.select(*by, "n", F.posexplode(F.expr(f"transform({lattice}, x -> bit_count(x))")).alias("_s", "_bits")).groupBy(*by, "n", "_s").agg(F.sum("_bits").alias("_bits"))
    k = subsets.where("_s > 0").groupBy(*by, F.bit_count("_s").cast("int").alias("k")).agg(F.min("_bits").alias("least"), F.avg("_bits").alias("_mean"), F.max("_bits").alias("most"))
    e = seen.withColumn("k", F.col("_i") + 1).join(k, [*by, "k"], "left")
    none = ~F.max(F.col("observed") > 0).over(W.partitionBy(*by))  # no code at all: no row of masks
    fill = lambda c: F.when(none & (F.col("n") <= MOST_GROUPS), 0).otherwise(F.col(c))
    e = e.select(*by, "n", "k", "observed", fill("least").cast("long").alias("least"), fill("_mean").cast("double").alias("_mean"), fill("most").cast("long").alias("most"))
    gain = F.round(F.col("_mean") - F.lag("_mean").over(W.partitionBy(*by).orderBy("k")), 4)
    e = e.withColumn("gain", gain)
    last = F.coalesce(F.max(F.when(F.col("gain") >= PLATEAU, F.col("k"))).over(W.partitionBy(*by)), F.lit(1))
    known = F.max(F.col("_mean")).over(W.partitionBy(*by)).isNotNull()
    return e.withColumn("plateau", F.when(known & (last < F.col("n")), last)).select(*by, "k", "least", r6("_mean").alias("mean"), "most", "observed", "gain", "plateau")


def accumulation_summary(presence: DataFrame) -> DataFrame:
    """Per condition over its replicates, which are not further groups: mean, least and greatest final repertoire, and the codes seen anywhere, as a share of the codebook."""
    p = presence.where("present")
    final = presence.select("condition", "replicate").distinct().join(p.groupBy("condition", "replicate").agg(F.count_distinct("code").alias("_f")), ["condition", "replicate"], "left").withColumn("_f", F.coalesce("_f", F.lit(0)))
    g = final.groupBy("condition").agg(F.count(F.lit(1)).alias("replicates"), r6(F.avg("_f")).alias("mean"), F.min("_f").alias("least"), F.max("_f").alias("most"))
    union = p.groupBy("condition").agg(F.count_distinct("code").alias("anywhere"))
    book = presence.agg(F.count_distinct("code").alias("_book"))
    return g.join(union, "condition", "left").crossJoin(F.broadcast(book)).withColumn("anywhere", F.coalesce("anywhere", F.lit(0))).withColumn("of_codebook", r6(ratio("anywhere", "_book"))).drop("_book")


def first_seen(rows: DataFrame) -> DataFrame:
    """New and cumulative clusters in the order of units, and the share of the final repertoire. rows: series, unit, cluster."""
    f = rows.groupBy("series", "cluster").agg(F.min("unit").alias("unit")).groupBy("series", "unit").agg(F.count(F.lit(1)).alias("new"))
    u = rows.select("series", "unit").distinct().join(f, ["series", "unit"], "left").withColumn("new", F.coalesce("new", F.lit(0)))
    w = W.partitionBy("series")
    return u.select("series", "unit", "new", F.sum("new").over(w.orderBy("unit").rowsBetween(W.unboundedPreceding, 0)).alias("cumulative")).withColumn("share", r6(ratio("cumulative", F.max("cumulative").over(w))))


def coverage_by_words(turns: DataFrame, evidence: DataFrame) -> DataFrame:
    """Cumulative distinct codes against cumulative words, turn by turn; evidence: session_id, turn_index, code."""
    f = evidence.groupBy("session_id", "code").agg(F.min("turn_index").alias("turn_index")).groupBy("session_id", "turn_index").agg(F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy("session_id").orderBy("turn_index").rowsBetween(W.unboundedPreceding, 0)
    return turns.join(f, ["session_id", "turn_index"], "left").select("session_id", "turn_index", F.sum("n_words").over(w).alias("words"), F.sum(F.coalesce("_n", F.lit(0))).over(w).alias("codes"))


def excerpt_recall(excerpts: DataFrame, evidence: DataFrame, reference: DataFrame) -> DataFrame:
    """Codes with evidence inside each excerpt (range join within the session) against the session's reference codes: mean, deviation (NULL of one) and range."""
    e = excerpts.select("session_id", "start", "stop").join(evidence, "session_id").where(F.col("turn_index").between(F.col("start"), F.col("stop")))
    got = e.select("session_id", "start", "code").distinct().join(reference.withColumn("_r", F.lit(1)), ["session_id", "code"], "left")
    n_ref = reference.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_ref"))
    s = got.groupBy("session_id", "start").agg(F.count(F.lit(1)).alias("n"), F.count("_r").alias("hit")).join(n_ref, "session_id")
    s = s.withColumns({"_rc": ratio("hit", "n_ref"), "_pc": ratio("hit", "n")})
    return s.groupBy("session_id").agg(F.count(F.lit(1)).alias("k"), r6(F.avg("_rc")).alias("recall"), r6(F.stddev_samp("_rc")).alias("recall_sd"), r6(F.min("_rc")).alias("recall_min"), r6(F.max("_rc")).alias("recall_max"), r6(F.avg("_pc")).alias("precision"), r6(F.stddev_samp("_pc")).alias("precision_sd"))


def tri_state(presence: DataFrame, measured: DataFrame) -> DataFrame:
    """Every measured session with every code: reach if present, 0 if truly absent, NULL if the session was not measured."""
    grid = with_each(presence.select(*CELL).distinct(), presence, "code")
    j = grid.join(measured.withColumn("_m", F.lit(True)), CELL, "left").join(presence.where("present").select(*CELL, "code", ratio("voiced", "participants").alias("_v")), [*CELL, "code"], "left")
    state = F.when(F.col("_m").isNull(), "UNMEASURED").when(F.col("_v").isNull(), "TRUE_ABSENCE").otherwise("PRESENT")
    return j.select(*CELL, "code", state.alias("state"), r6(F.when(state == "PRESENT", F.col("_v")).when(state == "TRUE_ABSENCE", 0.0)).alias("score"))


def set_differences(presence: DataFrame, reference: str) -> DataFrame:
    """Codes by group: in the reference only, in any generated session only, or in both."""
    p = presence.where("present")
    ref, gen = (p.where(t).select("group_id", "code").distinct() for t in (F.col("condition") == reference, F.col("condition") != reference))
    tag = lambda df, k: df.withColumn("kind", F.lit(k))
    return tag(ref.exceptAll(gen), "missed").unionByName(tag(gen.exceptAll(ref), "emergent")).unionByName(tag(ref.intersect(gen), "shared"))


#: Pairs of a block that are settled in one row; larger blocks go by rounds. Pairs in a part.
SMALL, PAIRS_A_PART = 1024, 500_000


def greedy_matching(pairs: DataFrame, small: int = SMALL) -> DataFrame:
    """One-to-one pairs by falling similarity inside each block: (block, a, b, sim), ties by a, then b; pairs with a null take no part, repeated ones count once.

    Blocks of up to `small` pairs are sorted and settled in one row each, larger ones in rounds. Parts are set by the number of pairs, as pairs are small when shuffled and large when sorted."""
    pairs = pairs.select("block", "a", "b", "sim").where("block is not null and a is not null and b is not null and sim is not null")
    sizes = written(pairs.groupBy("block").agg(F.count(F.lit(1)).alias("_n")), "sizes")
    large = sizes.where(F.col("_n") > small).select("block")
    pairs = pairs.repartition(1 + (sizes.agg(F.sum("_n")).first()[0] or 0) // PAIRS_A_PART, "block")
    if large.isEmpty():
        return _in_one_row(pairs)
    many = pairs.join(large.hint("merge"), "block", "left_semi")
    return _in_one_row(pairs.join(large.hint("merge"), "block", "left_anti")).unionByName(_in_rounds(many))


def _in_one_row(pairs: DataFrame) -> DataFrame:
    """Pairs of small blocks: a block's pairs in order, each taken unless one of its ends is."""
    order = F.struct((~F.isnan("sim")).alias("_o"), (-F.col("sim")).alias("_s"), "a", "b", "sim")
    g = pairs.groupBy("block").agg(F.sort_array(F.collect_list(order)).alias("_p"))
    free = "array_contains(s.a, p.a) or array_contains(s.b, p.b)"
    take = "named_struct('a', array_append(s.a, p.a), 'b', array_append(s.b, p.b), 'sim', array_append(s.sim, p.sim))"
    g = g.select("block", F.expr(f"aggregate(_p, named_struct('a', slice(_p.a, 1, 0), 'b', slice(_p.b, 1, 0), 'sim', slice(_p.sim, 1, 0)), (s, p) -> if({free}, s, {take}))").alias("_t"))
    return g.select("block", F.inline(F.arrays_zip(F.col("_t.a").alias("a"), F.col("_t.b").alias("b"), F.col("_t.sim").alias("sim"))).alias("a", "b", "sim"))


def _in_rounds(pairs: DataFrame) -> DataFrame:
    """In each round every pair that comes first among the pairs of both its ends is taken, which greedy order would take too, and all pairs of taken ends leave. Rounds are written;
    they go on until no pair is left (a few for mixed similarities; a chain of pairs that fall evenly takes one for each link)."""
    left = written(pairs.distinct(), "pairs")
    taken = left.where("false")
    while n := left.count():
        parts, order = 1 + n // PAIRS_A_PART, [F.desc("sim"), "a", "b"]
        a, b = W.partitionBy("block", "a"), W.partitionBy("block", "b")
        seen = left.repartition(parts, "block", "a").withColumn("_a", F.row_number().over(a.orderBy(*order)))
        seen = seen.repartition(parts, "block", "b").withColumn("_b", F.row_number().over(b.orderBy(*order))).withColumn("_hit", (F.col("_a") == 1) & (F.col("_b") == 1))
        seen = written(seen.withColumn("_gone", F.max("_hit").over(b)).drop("_a", "_b"), "round")
        hit = seen.where("_hit").select("block", "a", "b", "sim")
        taken = taken.unionByName(hit)
        left = seen.where("not _gone").select("block", "a", "b", "sim").repartition(parts, "block", "a").join(hit.select("block", "a").hint("merge"), ["block", "a"], "left_anti")
        left = written(left, "left")
    return taken


def judge_disagreement(pairs: DataFrame, low: float = 0.35, high: float = 0.65) -> DataFrame:
    """Pairs judged alike though dissimilar, or unlike though similar."""
    kind = F.when(F.col("judged") & (F.col("sim") < low), "yes_but_dissimilar").when(~F.col("judged") & (F.col("sim") > high), "no_but_similar")
    return pairs.withColumn("kind", kind).where("kind is not null")


def pair_states(decisions: DataFrame) -> DataFrame:
    """Items' states from pair decisions (yes / unsure / no) and bounds of the matched share, per block and overall (grouping sets)."""
    i = decisions.groupBy("block", "a").agg(F.bool_or(F.col("decision") == "yes").alias("_y"), F.bool_or(F.col("decision") == "unsure").alias("_u"))
    i = i.withColumn("state", F.when(F.col("_y"), "confirmed").when(F.col("_u"), "unresolved").otherwise("not"))
    n = lambda *s: F.count_if(F.col("state").isin(*s))
    return i.rollup("block").agg(F.count(F.lit(1)).alias("items"), n("confirmed").alias("confirmed"), n("unresolved").alias("unresolved"), r6(ratio(n("confirmed"), F.count(F.lit(1)))).alias("lower"), r6(ratio(n("confirmed", "unresolved"), F.count(F.lit(1)))).alias("upper"))


def reconcile_repetitions(rows: DataFrame) -> DataFrame:
    """Two repetitions of an item (item, repetition, category, confidence): agreement gives the verdict, anything else is unresolved."""
    at = lambda c, r: F.max(F.when(F.col("repetition") == r, F.col(c)))
    g = rows.groupBy("item").agg(at("category", 1).alias("c1"), at("category", 2).alias("c2"), F.min("confidence").alias("_low"))
    ok = (F.col("c1") == F.col("c2")) & (F.col("_low") >= 0.5)
    return g.select("item", "c1", "c2", F.when(F.coalesce(ok, F.lit(False)), F.col("c1")).otherwise("unresolved").alias("verdict"))


def assignment_stability(rows: DataFrame, passes: int) -> DataFrame:
    """Items that are in every pass with one value and never uncertain."""
    g = rows.groupBy("item").agg(F.count_distinct("pass").alias("passes"), F.count_distinct("value").alias("values"), F.bool_or(F.col("value") == "UNCERTAIN").alias("_u"))
    return g.select("item", "passes", "values", ((F.col("passes") == passes) & (F.col("values") == 1) & ~F.col("_u")).alias("stable"))


def partition_alignment(rows: DataFrame) -> DataFrame:
    """Pair Jaccard of two partitions (item, a, b) from counts: sum n(n-1)/2 over A, B and both, never the pairs themselves."""
    pairs = F.sum(F.col("n") * (F.col("n") - 1) / 2)
    n = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    tot = lambda k, name: n.groupBy(k).agg(F.sum("n").alias("n")).agg(pairs.alias(name))
    j = n.agg(pairs.alias("both")).crossJoin(F.broadcast(tot("a", "in_a"))).crossJoin(F.broadcast(tot("b", "in_b")))  # one row each
    return j.select("both", (F.col("in_a") - F.col("both")).alias("only_a"), (F.col("in_b") - F.col("both")).alias("only_b"), r6(ratio("both", F.col("in_a") + F.col("in_b") - F.col("both"))).alias("jaccard"))


def cluster_presence(rows: DataFrame) -> DataFrame:
    """Clusters by unit: raters that raise it; rows: cluster, unit, rater."""
    g = rows.groupBy("cluster", "unit").agg(F.array_sort(F.collect_set("rater")).alias("raters"))
    g = g.groupBy("cluster").agg(F.min("unit").alias("first_unit"), F.count(F.lit(1)).alias("units"), F.count_if(F.size("raters") > 1).alias("units_shared"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("raters")))).alias("raters"))
    return g.withColumn("exclusive", F.size("raters") == 1)


def prevalence_bands(presence: DataFrame) -> DataFrame:
    """Codes grouped by exactly equal prevalence (sessions with the code), ties kept."""
    n = presence.where("present").groupBy("condition", "code").agg(F.count(F.lit(1)).alias("sessions"))
    b = n.groupBy("condition", "sessions").agg(F.array_sort(F.collect_list("code")).alias("codes"))
    return b.withColumn("band", F.dense_rank().over(W.partitionBy("condition").orderBy(F.desc("sessions"))))


def treatments(presence: DataFrame) -> DataFrame:
    """Breadth under three readings of rank-10 borders: LOWER drops codes voiced by one participant, MID keeps, UPPER adds contested ones
    (absent though voiced by two or more); the original is untouched."""
    t = presence.sparkSession.createDataFrame([("LOWER",), ("MID",), ("UPPER",)], "treatment string")
    v = F.col("voiced")
    p = presence.crossJoin(F.broadcast(t)).withColumn("p", F.when(F.col("treatment") == "LOWER", F.col("present") & (v > 1)).when(F.col("treatment") == "UPPER", F.col("present") | (v >= 2)).otherwise(F.col("present")))
    return p.groupBy("condition", "treatment").agg(F.count_if("p").alias("present"), r6(F.avg(F.when(F.col("p"), ratio("voiced", "participants")))).alias("mean_reach"))


BASE = "BASE"


def scenarios(presence: DataFrame, overrides: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The coded presence under the base and every scenario: `overrides` (scenario, condition, group_id, replicate, code, present) replaces single cells, everything else is the base's, and the given table
    stays as it is. `names`: scenarios that count even if they override nothing. One plan carries the column `scenario` through whatever follows."""
    names = overrides.select("scenario").distinct().unionByName(presence.sparkSession.createDataFrame([(x,) for x in (BASE, *(names or []))], "scenario string"))
    o = overrides.select("scenario", *CELL, "code", F.col("present").alias("_o"))
    p = with_each(presence, names, "scenario").join(o.hint("merge"), ["scenario", *CELL, "code"], "left")
    return p.withColumns({"overridden": F.col("_o").isNotNull() & (F.col("_o") != F.col("present")), "present": F.coalesce("_o", "present")}).drop("_o")


def scenario_recurrence(under: DataFrame) -> DataFrame:
    """Per scenario and condition: overridden and present cells, codes seen anywhere, mean reach of present cells, and the mean number of groups that hold a code in a replicate."""
    cells = under.groupBy("scenario", "condition").agg(F.count_if("overridden").alias("overridden"), F.count_if("present").alias("present"), F.count_distinct(F.when(F.col("present"), F.col("code"))).alias("codes"), r6(F.avg(F.when(F.col("present"), ratio("voiced", "participants")))).alias("mean_reach"))
    held = under.groupBy("scenario", "condition", "replicate", "code").agg(F.count_distinct(F.when(F.col("present"), F.col("group_id"))).alias("_g")).groupBy("scenario", "condition").agg(r6(F.avg("_g")).alias("mean_groups"))
    return cells.join(held, ["scenario", "condition"])


def cross_rater(rows: DataFrame, gate: float, overall: float) -> DataFrame:
    """Outcome of an item by two raters (a, b in 0/1, b may be NULL). Agreement corroborates only codes whose control agreement reaches `gate`, and only if
    the Wilson lower bound of the agreement of all controls reaches `overall`."""
    agreed = (F.col("a") == F.col("b")).cast("double")
    control = rows.where("control").groupBy("code").agg(F.avg(agreed).alias("agreement"))
    total = rows.where("control").agg(F.sum(agreed).alias("_k"), F.count("b").alias("_n"))
    total = total.select(F.coalesce((F.col("_n") > 0) & (wilson("_k", "_n")[0] >= overall), F.lit(False)).alias("_open"))
    label = F.when(F.col("b").isNull(), F.when(F.col("a") == 1, "present_unchecked").otherwise("absent_unchecked")).when(F.col("a") == F.col("b"), F.when(F.col("a") == 1, "both_present").otherwise("both_absent")).otherwise("disagree")
    j = rows.where("not control").join(control, "code", "left").crossJoin(F.broadcast(total))  # the right side is one row
    j = j.withColumns({"label": label, "corroborated": F.col("_open") & F.coalesce(F.col("agreement") >= gate, F.lit(False)) & (F.col("a") == F.col("b"))})
    return j.groupBy("code", "label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("corroborated", F.lit(False))).alias("corroborated"))


def calibration_scores(rows: DataFrame) -> DataFrame:
    """The second rater against the first's presences and absences (a): found, not found and unresolved, with the rate of agreement and its interval."""
    g = rows.groupBy(F.col("a").alias("original")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col("b") == 1, F.lit(False))).alias("found"), F.count_if(F.coalesce(F.col("b") == 0, F.lit(False))).alias("not_found"), F.count_if(F.col("b").isNull()).alias("unresolved"))
    k = F.when(F.col("original") == 1, F.col("found")).otherwise(F.col("not_found"))
    lo, hi = wilson(k, "n")
    return g.select("*", r6(ratio(k, "n")).alias("rate"), r6(lo).alias("lower"), r6(hi).alias("upper"))


def extend_taxonomy(assigned: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Assignments (item, cluster, is_new, uncertain) against a frozen taxonomy: strict (known clusters) and extended denominators, problems."""
    j = assigned.join(taxonomy.withColumn("_k", F.lit(True)), "cluster", "left")
    known = F.col("_k").isNotNull()
    kind = F.when(F.col("uncertain"), "uncertain").when(F.col("is_new") & known, "problem_not_new").when(~F.col("is_new") & ~known, "problem_unknown").when(F.col("is_new"), "new").otherwise("known")
    return j.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("items"), F.count_distinct("cluster").alias("clusters"))


def completeness(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Sessions' result codes against the expected list: missing, duplicate, unexpected; anything off is incomplete, never absent."""
    cells = with_each(results.select("session_id").distinct(), expected, "code").hint("merge")
    n = results.groupBy("session_id", "code").agg(F.count(F.lit(1)).alias("n"))
    j = cells.withColumn("_e", F.lit(True)).join(n, ["session_id", "code"], "full")
    g = j.groupBy("session_id").agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("n") > 1).alias("duplicate"), F.count_if(F.col("_e").isNull()).alias("unexpected"))
    return g.withColumn("status", F.when((F.col("missing") + F.col("duplicate") + F.col("unexpected")) == 0, "complete").otherwise("incomplete"))


def absence_strata(presence: DataFrame) -> DataFrame:
    """Session-code cells verified present and absent, by condition."""
    return presence_grid(presence).groupBy("condition").agg(F.count_if("present").alias("present"), F.count_if(~F.col("present")).alias("absent"))
