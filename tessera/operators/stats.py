"""Summaries, effects, inference and agreement in which undefined stays NULL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import f1, r6, ratio, with_each
from ..scratch import written
from .order import joined, quantiles, tau_b


def honest_summary(values: DataFrame, by: list[str], expected: DataFrame) -> DataFrame:
    """n valid of n expected, mean, median, sample SD (0 for one value), range and coverage. expected: by columns and n_expected."""
    v = F.col("value")
    g = values.groupBy(*by).agg(
        F.count(v).alias("n_valid"), F.avg(v).alias("_m"), F.when(F.count(v) == 1, F.lit(0.0)).otherwise(F.stddev_samp(v)).alias("_s"), F.min(v).alias("_lo"), F.max(v).alias("_hi")
    )
    g = joined(g, quantiles(values, by, "value", {"_d": 0.5}).drop("n"), by)
    j = expected.join(g, by, "left").withColumn("n_valid", F.coalesce("n_valid", F.lit(0)))
    status = F.when(F.col("n_valid") == 0, "none").when(F.col("n_valid") < F.col("n_expected"), "partial").otherwise("complete")
    return j.select(*by, "n_expected", "n_valid", r6("_m").alias("mean"), r6("_d").alias("median"), r6("_s").alias("sd"), r6("_lo").alias("min"), r6("_hi").alias("max"), status.alias("coverage"))


def missing_units(values: DataFrame, by: list[str], unit: str, expected: DataFrame) -> DataFrame:
    """Units of the expected list (by, unit) without a value, per group: how many, and which. A unit whose value is NULL is missing."""
    have = values.where("value is not null").select(*by, unit).distinct()
    gone = expected.select(*by, unit).distinct().join(have, [*by, unit], "left_anti")
    return gone.groupBy(*by).agg(F.count(F.lit(1)).alias("n_missing"), F.array_sort(F.collect_list(unit)).alias("missing"))


def route_a(values: DataFrame, reference: str, strict: bool = True) -> DataFrame:
    """(condition, group_id, replicate, metric, value) to metric × group × condition over replicates, with the reference's value; STRICT
    keeps only metrics without an undefined value."""
    if strict:
        values = values.join(values.groupBy("metric").agg(F.bool_or(F.col("value").isNull()).alias("_bad")).where("not _bad").select("metric"), "metric", "left_semi")
    ref = values.where(F.col("condition") == reference).groupBy("metric", "group_id").agg(F.avg("value").alias("_ref"))
    g = values.where(F.col("condition") != reference).groupBy("metric", "group_id", "condition").agg(F.avg("value").alias("_v"), F.count("value").alias("n"))
    return g.join(ref, ["metric", "group_id"], "left").select("metric", "group_id", "condition", "n", r6("_v").alias("value"), r6("_ref").alias("reference"))


def route_b(values: DataFrame) -> DataFrame:
    """Replicates across groups, refused for conditions whose groups offer different replicate sets."""
    sets = values.groupBy("condition", "group_id").agg(F.array_sort(F.collect_set("replicate")).alias("s")).groupBy("condition").agg((F.count_distinct("s") == 1).alias("available"))
    g = values.groupBy("condition", "replicate").agg(F.avg("value").alias("_v"), F.count("value").alias("groups"))
    return g.join(sets, "condition").select("condition", "replicate", "available", F.when(F.col("available"), r6("_v")).alias("value"), "groups")


def study_level(values: DataFrame) -> DataFrame:
    """Means of replicates, summarised across replicates per condition."""
    m = values.groupBy("condition", "replicate").agg(F.avg("value").alias("v"))
    return m.groupBy("condition").agg(F.count("v").alias("replicates"), r6(F.avg("v")).alias("mean"), r6(F.when(F.count("v") == 1, F.lit(0.0)).otherwise(F.stddev_samp("v"))).alias("sd"), r6(F.min("v")).alias("min"), r6(F.max("v")).alias("max"))


def paired_effects(values: DataFrame, a: str, b: str) -> DataFrame:
    """Per group: difference of condition means, df-weighted pooled SD, standardised difference and whom it favours (decided unrounded)."""
    pick = lambda c, f: f(F.when(F.col("condition") == c, F.col("value")))
    g = values.where(F.col("condition").isin(a, b)).groupBy("group_id").agg(*(pick(c, f).alias(f"{n}{k}") for k, c in (("a", a), ("b", b)) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))))
    sd = F.sqrt(ratio((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb"), F.col("na") + F.col("nb") - 2))
    d = F.col("ma") - F.col("mb")
    return g.withColumns({"_d": d, "_sd": sd}).select("group_id", r6("_d").alias("difference"), r6("_sd").alias("pooled_sd"), r6(ratio("_d", "_sd")).alias("standardised"), F.when(F.col("_d") > 0, a).when(F.col("_d") < 0, b).when(F.col("_d") == 0, "tie").alias("favours"))


def effect_summary(diffs: DataFrame) -> DataFrame:
    """(unit, d): mean, median, direction counts and exact ties, overall and with each unit left out."""
    known = diffs.where("d is not null")
    n = known.count()
    # the values around the middle: what the median becomes depends only on whether the value left out lies below, at or above it
    at = lambda k: F.percentile("d", F.lit(min(max((k - 1) / max(n - 1, 1), 0.0), 1.0)))
    c = (n + 1) // 2
    signs = {"up": F.col("d") > 0, "down": F.col("d") < 0, "ties": F.col("d") == 0}
    total = diffs.agg(F.count(F.lit(1)).alias("_n"), F.count("d").alias("_k"), F.sum("d").alias("_s"), F.percentile("d", F.lit(0.5)).alias("_m"), at(c - 1).alias("_a"), at(c).alias("_b"), at(c + 1).alias("_c"), *(F.count_if(t).alias(f"_{k}") for k, t in signs.items()))
    side = F.when(F.col("d") < F.col("_b"), F.lit(-1)).when(F.col("d") > F.col("_b"), 1).otherwise(0)
    odd = F.when(side < 0, F.col("_b") + F.col("_c")).when(side > 0, F.col("_a") + F.col("_b")).otherwise(F.col("_a") + F.col("_c")) / 2
    without = (odd if n % 2 else F.when(side > 0, F.col("_b")).otherwise(F.col("_c"))) if n > 1 else F.lit(None).cast("double")
    one = diffs.crossJoin(F.broadcast(total)).select(  # the right side is one row
        F.col("unit").alias("left_out"), (F.col("_n") - 1).alias("n"), r6(ratio(F.col("_s") - F.coalesce("d", F.lit(0.0)), F.col("_k") - F.col("d").isNotNull().cast("int"))).alias("mean"),
        r6(F.when(F.col("d").isNull(), F.col("_m")).otherwise(without)).alias("median"), *((F.col(f"_{k}") - F.coalesce(t, F.lit(False)).cast("int")).alias(k) for k, t in signs.items()),
    ).where("n > 0")
    return one.unionByName(total.where("_n > 0").select(F.lit(None).cast(diffs.schema["unit"].dataType).alias("left_out"), F.col("_n").alias("n"), r6(ratio("_s", "_k")).alias("mean"), r6("_m").alias("median"), *(F.col(f"_{k}").alias(k) for k in signs)))


def sign_test(diffs: DataFrame, by: list[str]) -> DataFrame:
    """Exact two-sided sign test with ties dropped: n, k, p, and the least p that n allows."""
    g = diffs.groupBy(*by).agg(F.count_if(F.col("d") != 0).cast("int").alias("n"), F.least(F.count_if(F.col("d") > 0), F.count_if(F.col("d") < 0)).cast("int").alias("k"))
    start = F.struct(F.pow(F.lit(0.5), F.col("n")).alias("term"), F.lit(0.0).alias("sum"))
    tail = F.aggregate(F.sequence(F.lit(0), F.col("k")), start, lambda acc, i: F.struct((acc["term"] * (F.col("n") - i) / (i + 1)).alias("term"), (acc["sum"] + acc["term"]).alias("sum")))["sum"]
    return g.select(*by, "n", "k", F.when(F.col("n") > 0, r6(F.least(F.lit(1.0), 2 * tail))).alias("p"), F.when(F.col("n") > 0, r6(F.least(F.lit(1.0), 2 * F.pow(F.lit(0.5), F.col("n"))))).alias("least_p"))


def wilson(k: Column | str, n: Column | str, z: float = 1.96) -> tuple[Column, Column]:
    k, n = (F.col(x) if isinstance(x, str) else x for x in (k, n))
    p, d = ratio(k, n), 1 + z * z / n
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    mid = (p + z * z / (2 * n)) / d
    return F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half)


def wilson_gate(counts: DataFrame, low: float, high: float) -> DataFrame:
    """(unit, k, n): interval and a decision in three bands."""
    lo, hi = wilson("k", "n")
    return counts.where("n > 0").withColumns({"_lo": lo, "_hi": hi}).select("unit", "k", "n", r6("_lo").alias("lower"), r6("_hi").alias("upper"), F.when(F.col("_lo") >= high, "pass").when(F.col("_hi") < low, "fail").otherwise("open").alias("decision"))


def least_k(n: Column | str, target: float, z: float = 1.96) -> Column:
    """The smallest k of n whose Wilson lower bound reaches `target` (below 1), NULL if none does: the bound reaches it just where k / n lies z standard
    errors, taken at the target, above it."""
    n = F.col(n) if isinstance(n, str) else n
    k = F.ceil(n * target + z * F.sqrt(n * target * (1 - target)))
    return F.when((n > 0) & (k <= n), k)


def nth_values(df: DataFrame, value: str, places: Callable[[int], list[int]], digits: int = 4) -> list[float | None]:
    """The values, rounded, at places (from 0, given the number of rows) of all rows in order. Rows are counted by rounded value first, and one row
    reaches the driver; nulls don't count, and an empty table gives None."""
    c = df.where(F.col(value).isNotNull()).groupBy(F.round(value, digits).alias("_v")).agg(F.count(F.lit(1)).alias("_k"))
    n = c.agg(F.sum("_k")).first()[0] or 0
    at = places(n)
    if not n:
        return [None] * len(at)
    row = c.agg(*(F.percentile("_v", F.lit(min(k / max(n - 1, 1), 1.0)), F.col("_k")) for k in at)).first()
    return [round(v, digits) for v in row]


def average_ranks(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    w = W.partitionBy(*by)
    ties = F.count(F.lit(1)).over(W.partitionBy(*by, value))
    return df.withColumn(out, F.rank().over(w.orderBy(value)) + (ties - 1) / 2.0)


def spearman(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, x, y): rank correlation; NULL with a reason for under two pairs or a constant side."""
    r = average_ranks(average_ranks(df.where("x is not null and y is not null"), by, "x", "_rx"), by, "y", "_ry")
    g = r.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), ratio(F.covar_pop("_rx", "_ry"), F.stddev_pop("_rx") * F.stddev_pop("_ry")).alias("_c"), (F.min("x") == F.max("x")).alias("_kx"), (F.min("y") == F.max("y")).alias("_ky"))
    reason = F.when(F.col("n") < 2, "too_few").when(F.col("_kx") | F.col("_ky"), "no_variance")
    return g.select(*by, "n", F.when(reason.isNull(), r6("_c")).alias("rho"), reason.alias("undefined_reason"))


def kendall(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, x, y): tau-b of groups of any size, from counts of ties and inversions; NULL with a reason if undefined."""
    return tau_b(df, by)


def agreement(df: DataFrame, by: list[str]) -> DataFrame:
    """Two raters (by, a, b in 0/1): raw agreement, Cohen's kappa, Gwet's AC1, Krippendorff's alpha, NULL where chance is certain; each rater's positives, and their prevalence."""
    ok = df.where("a is not null and b is not null")
    g = ok.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("po"), F.avg(F.col("a").cast("double")).alias("pa"), F.avg(F.col("b").cast("double")).alias("pb"), F.sum("a").cast("long").alias("positives_a"), F.sum("b").cast("long").alias("positives_b"))
    q = (F.col("pa") + F.col("pb")) / 2
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    ac, de = 2 * q * (1 - q), 2 * q * (1 - q) * (2 * F.col("n")) / (2 * F.col("n") - 1)
    chance = lambda e: r6(ratio(F.col("po") - e, 1 - e))
    return g.select(*by, "n", r6("po").alias("agreement"), chance(pe).alias("kappa"), chance(ac).alias("ac1"), r6(1 - ratio(1 - F.col("po"), de)).alias("alpha"), "positives_a", "positives_b", r6(q).alias("prevalence"))


#: Positives of both raters together from which a code counts as observed.
LEAST_POSITIVES = 3


def validation_status(agreed: DataFrame, elicited: Column) -> DataFrame:
    """Adds to agreement's rows what they validate: a code that was asked for (`elicited`) is validated with enough positives, another is opportunistic detection, and without positives there is only
    evidence of specificity."""
    enough = F.col("positives_a") + F.col("positives_b") >= LEAST_POSITIVES
    status = F.when(elicited & enough, "validated").when(elicited, "not_fully_validated").when(enough, "opportunistic_detection").otherwise("specificity_only")
    return agreed.withColumns({"elicited": elicited, "status": status})


def classification(df: DataFrame) -> DataFrame:
    """(gold, predicted): per label tp, fp, fn, precision, recall and F1."""
    n = confusion(df)
    side = lambda c, name: n.groupBy(F.col(c).alias("label")).agg(F.sum("n").alias(name), F.sum(F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(0)).alias(f"_{name}"))
    r = side("gold", "g").join(side("predicted", "p"), "label", "full").na.fill(0, ["g", "p", "_g", "_p"]).withColumn("tp", F.col("_g"))
    r = r.withColumns({"fp": F.col("p") - F.col("tp"), "fn": F.col("g") - F.col("tp"), "_pr": ratio("tp", "p"), "_rc": ratio("tp", "g")})
    return r.select("label", "tp", "fp", "fn", r6("_pr").alias("precision"), r6("_rc").alias("recall"), r6(f1("_rc", "_pr")).alias("f1"))


def confusion(df: DataFrame) -> DataFrame:
    """The confusion matrix as rows: gold, predicted, n."""
    return df.where("gold is not null and predicted is not null").groupBy("gold", "predicted").agg(F.count(F.lit(1)).alias("n"))


def classification_summary(df: DataFrame) -> DataFrame:
    """One row: trials, accuracy, and over labels that occur in gold, macro-F1 (precision of a label never predicted is 0) and balanced accuracy (mean recall)."""
    c = classification(df).where(F.col("tp") + F.col("fn") > 0)
    g, p, tp = (F.col(k).cast("double") for k in ("fn", "fp", "tp"))
    return c.agg(F.sum(F.col("tp") + F.col("fn")).alias("n"), F.count(F.lit(1)).alias("labels"), r6(ratio(F.sum("tp"), F.sum(F.col("tp") + F.col("fn")))).alias("accuracy"), r6(F.avg(2 * tp / (2 * tp + g + p))).alias("macro_f1"), r6(F.avg(tp / (tp + g))).alias("balanced_accuracy"))


def horvitz_thompson(df: DataFrame) -> DataFrame:
    """(side, stratum, N, predicted, label or NULL if uncoded): weights N / coded, weighted tp, fp, fn, tn, prevalence, recall, precision, Kish n and
    Wilson bounds of the prevalence."""
    coded = df.where("label is not null")
    w = coded.withColumn("w", F.col("N") / F.count(F.lit(1)).over(W.partitionBy("side", "stratum")))
    s = lambda t: F.sum(F.when(t, F.col("w")).otherwise(0.0))
    g = w.groupBy("side").agg(F.sum("w").alias("_W"), F.sum(F.col("w") * F.col("w")).alias("_W2"), s(F.col("label") == 1).alias("_pos"), s(F.col("predicted") == 1).alias("_pre"), s((F.col("label") == 1) & (F.col("predicted") == 1)).alias("_tp"))
    g = g.withColumns({"_n": F.col("_W") * F.col("_W") / F.col("_W2"), "_p": F.col("_pos") / F.col("_W")})
    lo, hi = wilson(F.col("_p") * F.col("_n"), F.col("_n"))
    cells = {"tp": F.col("_tp"), "fp": F.col("_pre") - F.col("_tp"), "fn": F.col("_pos") - F.col("_tp"), "tn": F.col("_W") - F.col("_pos") - F.col("_pre") + F.col("_tp")}
    return g.select("side", *(r6(c).alias(k) for k, c in cells.items()), r6("_p").alias("prevalence"), r6(ratio("_tp", "_pos")).alias("recall"), r6(ratio("_tp", "_pre")).alias("precision"), r6("_n").alias("kish_n"), r6(lo).alias("lower"), r6(hi).alias("upper"))


def recall_gap(estimates: DataFrame, a: str, b: str, small: float = 0.15, large: float = 0.30) -> DataFrame:
    """One row: the difference of the two sides' recalls and whether their contrast can be read: pass, marginal, fail, or undetermined."""
    of = lambda s: F.max(F.when(F.col("side") == s, F.col("recall")))
    g = estimates.agg(F.abs(of(a) - of(b)).alias("_g"))
    return g.select(r6("_g").alias("gap"), F.when(F.col("_g").isNull(), "undetermined").when(F.col("_g") < small, "pass").when(F.col("_g") < large, "marginal").otherwise("fail").alias("verdict"))


def leik(df: DataFrame, by: list[str], total: int) -> DataFrame:
    """(by, stance in -1, 0, 1): Leik's consensus, modes, share in the mode, coverage, mean and standard deviation (of all, 0 for one)."""
    n = F.count(F.lit(1))
    share = lambda v: F.avg((F.col("stance") <= v).cast("double"))
    g = df.groupBy(*by).agg(n.alias("n"), share(-1).alias("c1"), share(0).alias("c2"), *(F.count_if(F.col("stance") == v).alias(f"k{v + 1}") for v in (-1, 0, 1)), r6(F.avg("stance")).alias("mean"), r6(F.stddev_pop("stance")).alias("sd"))
    d = lambda c: F.when(F.col(c) <= 0.5, F.col(c)).otherwise(1 - F.col(c))
    top = F.greatest("k0", "k1", "k2")
    modes = F.array_compact(F.array(*(F.when(F.col(f"k{v + 1}") == top, F.lit(v)) for v in (-1, 0, 1))))
    return g.select(*by, "n", r6(1 - 2 * (d("c1") + d("c2")) / 2).alias("consensus"), modes.alias("modes"), r6(top / F.col("n")).alias("in_mode"), r6(F.col("n") / F.lit(total)).alias("coverage"), "mean", "sd")


#: Metrics whose names hold one of these lie in 0..1.
BOUNDED = "share|rate|density|gini"


def calibrate(values: DataFrame, reference: str, near: float = 0.15, narrow: float = 0.05) -> DataFrame:
    """Counts of values by their place against the reference range: inside, near (within a share of the range, for bounded metrics not beyond 0..1),
    outside, or undefined. A range of one point holds only that point, and what is within `narrow` of it is near."""
    r = values.where(F.col("condition") == reference).groupBy("metric").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    v, lo, hi, m = F.col("value"), F.col("lo"), F.col("hi"), near * (F.col("hi") - F.col("lo"))
    bounded = F.col("metric").rlike(BOUNDED)
    low, high = F.when(bounded, F.greatest(lo - m, F.lit(0.0))).otherwise(lo - m), F.when(bounded, F.least(hi + m, F.lit(1.0))).otherwise(hi + m)
    point = F.when(F.abs(v - lo) < 1e-6, "inside").when(F.abs(v - lo) <= narrow, "near").otherwise("outside")
    status = F.when(v.isNull() | lo.isNull(), "undefined").when(lo == hi, point).when(v.between(lo, hi), "inside").when(v.between(low, high), "near").otherwise("outside")
    return values.where(F.col("condition") != reference).join(r, "metric", "left").groupBy("metric", "condition", status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def progression(values: DataFrame, by: list[str]) -> DataFrame:
    """(by, stage, value, direction `down` or `up`): the last stage against the first: improved, stable, regressed, still_problematic; not_enough without
    two values or without either end, not_comparable without a direction."""
    g = values.groupBy(*by).agg(F.count("value").alias("_n"), F.min_by("value", "stage").alias("first"), F.max_by("value", "stage").alias("last"), F.first("direction").alias("_d"))
    a, b, d = F.col("first"), F.col("last"), F.col("_d")
    better = F.when(d == "down", b < a).otherwise(b > a)
    worse = F.when((d == "down") & (b <= 0), "regressed").otherwise("still_problematic")
    status = F.when((F.col("_n") < 2) | a.isNull() | b.isNull(), "not_enough").when(~F.coalesce(d.isin("down", "up"), F.lit(False)), "not_comparable").when(a == b, "stable").when(better, "improved").otherwise(worse)
    return g.select(*by, r6("first").alias("first"), r6("last").alias("last"), status.alias("status"))


#: Shuffles that one row of a task draws.
CHUNK = 1000


def _matches(frames):
    """A fold's margins and a chunk of its shuffles, to matches by shuffle: the shuffled table of counts is drawn guess by guess, each
    a multivariate hypergeometric draw from the truths still left."""
    import numpy as np
    import pandas as pd

    for frame in frames:
        for r in frame.itertuples():
            rng, n = np.random.default_rng(r.seed % 2**64), int(r.n)
            both = [(int(m["t"]), int(m["g"])) for m in r.margins if m["t"] and m["g"]]
            total, hits = np.full(n, int(r.size), dtype=np.int64), np.zeros(n, dtype=np.int64)
            left = [np.full(n, t, dtype=np.int64) for t, _ in both]
            for i, (_, g) in enumerate(both):
                rest, take = total.copy(), np.full(n, g, dtype=np.int64)
                for j in range(i, len(both)):
                    got = rng.hypergeometric(left[j], rest - left[j], take)
                    hits += got if j == i else 0
                    rest, take = rest - left[j], take - got
                    left[j] = left[j] - got
                total = total - g
            yield pd.DataFrame({"perm": np.arange(n, dtype=np.int64) + int(r.first), "hits": hits})


def permutation_test(trials: DataFrame, draws: int, seed: int = 41) -> DataFrame:
    """(fold, trial, truth, guess): guesses are shuffled inside folds, `draws` times; one-sided p and the null mean.

    A shuffle matters only by its counts of (truth, guess), so trials are reduced to the counts of each label by fold, and tables with
    these margins are drawn (below 10**9 trials a fold). Trials without a truth or a guess are left out.
    """
    known = trials.where("truth is not null and guess is not null")
    sides = known.select("fold", F.inline(F.array(*(F.struct(F.col(c).alias("label"), F.lit(int(c == "truth")).alias("t"), F.lit(int(c == "guess")).alias("g")) for c in ("truth", "guess")))))
    sides = sides.groupBy("fold", "label").agg(F.sum("t").alias("t"), F.sum("g").alias("g"))
    folds = sides.groupBy("fold").agg(F.array_sort(F.collect_list(F.struct("label", "t", "g"))).alias("_m"), F.sum("t").alias("size"))
    chunks = folds.select("fold", "size", F.transform("_m", lambda m: F.struct(m["t"].alias("t"), m["g"].alias("g"))).alias("margins"), F.explode(F.array(*(F.lit(k).cast("long") for k in range(0, draws, CHUNK)))).alias("first"))
    chunks = chunks.repartition("fold", "first").select("margins", "size", "first", F.least(F.lit(CHUNK), F.lit(draws) - F.col("first")).alias("n"), F.xxhash64(F.lit(seed), "fold", "first").alias("seed"))
    null = chunks.mapInPandas(_matches, "perm long, hits long").groupBy("perm").agg(F.sum("hits").alias("hits"))
    seen = known.agg(F.count_if(F.col("truth") == F.col("guess")).alias("_hits"), F.count(F.lit(1)).alias("_n"))
    got = null.crossJoin(seen).groupBy("_hits", "_n").agg(F.avg("hits").alias("_mean"), ((F.count_if(F.col("hits") >= F.col("_hits")) + 1) / (F.count(F.lit(1)) + 1)).alias("p"))
    return got.select((F.col("_hits") / F.col("_n")).alias("accuracy"), (F.col("_mean") / F.col("_n")).alias("null_mean"), "p")


def signed_rank(diffs: DataFrame, by: list[str]) -> DataFrame:
    """(by, d): Wilcoxon's rank sums of the positive and the negative differences, zeros dropped, average ranks; two-sided p by the normal approximation
    with the variance corrected for ties."""
    d = average_ranks(diffs.where("d <> 0").withColumn("_a", F.abs("d")), by, "_a", "_r").withColumn("_t", F.count(F.lit(1)).over(W.partitionBy(*by, "_a")))
    side = lambda t: F.sum(F.when(t, F.col("_r")).otherwise(0.0))
    g = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), side(F.col("d") > 0).alias("w_plus"), side(F.col("d") < 0).alias("w_minus"), F.sum(F.col("_t") * F.col("_t") - 1).alias("_ties"))
    n = F.col("n").cast("double")
    z = F.abs(ratio(F.col("w_plus") - n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48.0)))
    return g.select(*by, "n", "w_plus", "w_minus", r6(_two_sided(z)).alias("p"))


#: Terms of the series of the error function: enough up to 8.5 standard deviations, beyond which both tails are under 2e-17.
TERMS = 150


def _two_sided(z: Column) -> Column:
    """Both tails of the normal law beyond z: 1 - erf(z / sqrt(2)), by the series of positive terms 2 / sqrt(pi) exp(-x^2) (x + 2 x^3 / 3 + 4 x^5 / 15 + ...)."""
    x = z / math.sqrt(2)
    start = F.struct(x.alias("t"), x.alias("s"))
    step = lambda a, k: F.struct((a["t"] * 2 * x * x / (2 * k + 1)).alias("t"), (a["s"] + a["t"] * 2 * x * x / (2 * k + 1)).alias("s"))
    erf = F.lit(2 / math.sqrt(math.pi)) * F.exp(-x * x) * F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step)["s"]
    return F.when(z > 8.5, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - erf))


def rank_effects(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, side 'a' or 'b', value): Mann-Whitney U of a, Cliff's delta and two-sided p (normal approximation), Holm-corrected over `by`."""
    r = average_ranks(df, by, "value", "_r").groupBy(*by).agg(F.sum(F.when(F.col("side") == "a", F.col("_r"))).alias("_ra"), F.count_if(F.col("side") == "a").alias("na"), F.count_if(F.col("side") == "b").alias("nb"))
    u = F.col("_ra") - F.col("na") * (F.col("na") + 1) / 2.0
    z = ratio(u - F.col("na") * F.col("nb") / 2.0, F.sqrt(F.col("na") * F.col("nb") * (F.col("na") + F.col("nb") + 1) / 12.0))
    r = r.withColumns({"u": u, "delta": ratio(2 * u, F.col("na") * F.col("nb")) - 1, "_z": F.abs(z)})
    r = r.withColumn("_p", _two_sided(F.col("_z")))
    w = W.orderBy("_p", *by)
    r = r.withColumn("_adj", F.least(F.lit(1.0), F.col("_p") * (F.count(F.lit(1)).over(W.partitionBy()) - F.row_number().over(w) + 1)))
    return r.select(*by, r6("u").alias("u"), r6("delta").alias("delta"), r6("_p").alias("p"), r6(F.max("_adj").over(w.rowsBetween(W.unboundedPreceding, 0))).alias("holm"))


def condition_wins(values: DataFrame, a: str, b: str) -> DataFrame:
    m = values.where(F.col("condition").isin(a, b)).groupBy("metric", "group_id").agg(F.avg(F.when(F.col("condition") == a, F.col("value"))).alias("x"), F.avg(F.when(F.col("condition") == b, F.col("value"))).alias("y"))
    d = F.col("x") - F.col("y")
    return m.groupBy("metric").agg(F.count_if(d > 0).alias("favour_a"), F.count_if(d < 0).alias("favour_b"), F.count_if(d == 0).alias("ties"), r6(F.avg(d)).alias("mean_difference"))


def stability_matrix(rows: DataFrame) -> DataFrame:
    """Repetition 1 against repetition 2 of each item, by family: counts of category pairs."""
    a, b = (rows.where(F.col("repetition") == k).select("item", "family", F.col("category").alias(f"c{k}")) for k in (1, 2))
    return a.join(b.drop("family"), "item").groupBy("family", "c1", "c2").agg(F.count(F.lit(1)).alias("n")).withColumn("agree", F.col("c1") == F.col("c2"))


def stability_rates(rows: DataFrame) -> DataFrame:
    """Agreement of repetitions 1 and 2, overall (family NULL, `level` 1) and by family, without planted items (item, family, planted, repetition, category); planted ones are counted, and how many of them
    have their true category (`expected`) in both."""
    key = ["item", "family", "planted", "expected"]
    at = lambda k: F.max(F.when(F.col("repetition") == k, F.col("category")))
    g = rows.groupBy(*key).agg(at(1).alias("c1"), at(2).alias("c2")).where("c1 is not null and c2 is not null")
    own, same = ~F.col("planted"), F.col("c1") == F.col("c2")
    right = F.col("planted") & (F.col("c1") == F.col("expected")) & (F.col("c2") == F.col("expected"))
    return g.rollup("family").agg(F.grouping_id().cast("int").alias("level"), F.count_if(own).alias("items"), F.count_if(own & same).alias("agree"), r6(ratio(F.count_if(own & same), F.count_if(own))).alias("rate"), F.count_if("planted").alias("planted"), F.count_if(right).alias("planted_right"))


def closer_to_reference(values: DataFrame, reference: str, a: str, b: str) -> DataFrame:
    """Groups in which condition a's mean is nearer the reference than b's, over groups with all three."""
    mean = lambda c: F.avg(F.when(F.col("condition") == c, F.col("value")))
    g = values.groupBy("metric", "group_id").agg(mean(reference).alias("h"), mean(a).alias("a"), mean(b).alias("b")).where("h is not null and a is not null and b is not null")
    return g.groupBy("metric").agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.abs(F.col("a") - F.col("h")) < F.abs(F.col("b") - F.col("h"))).alias("a_closer"))


def ordering_similarity(scores: DataFrame, by: list[str]) -> DataFrame:
    """(by, item, x, y) scores of the same codes on two sides: tau-b, rho, mean absolute difference, tie-aware top-3 overlap, and tied pairs of each side."""
    top = lambda c: F.rank().over(W.partitionBy(*by).orderBy(F.desc(c))) <= 3
    t = scores.withColumns({"_x": top("x"), "_y": top("y")}).groupBy(*by).agg(r6(F.avg(F.abs(F.col("x") - F.col("y")))).alias("mean_abs"), r6(ratio(F.count_if(F.col("_x") & F.col("_y")), F.count_if(F.col("_x") | F.col("_y")))).alias("top3"))
    ties = lambda c: scores.groupBy(*by, c).agg(F.count(F.lit(1)).alias("_k")).groupBy(*by).agg(F.sum(F.col("_k") * (F.col("_k") - 1) / 2).cast("long").alias(f"ties_{c}"))
    return kendall(scores, by).join(spearman(scores, by).select(*by, "rho"), by).join(t, by).join(ties("x"), by).join(ties("y"), by)


def _measured(presence: DataFrame, measured: DataFrame, reference: str) -> tuple[DataFrame, DataFrame]:
    """(unit, code, x) of the reference's sessions and (unit, condition, replicate, code, y) of the others: reach of a present code, 0 of one truly absent; NULL where the session wasn't measured.
    The grid has a row for each session and code of the codebook."""
    cells = presence.select("condition", "group_id", "replicate").distinct().join(measured.withColumn("_m", F.lit(True)), ["condition", "group_id", "replicate"], "left")
    said = presence.where("present").select("condition", "group_id", "replicate", "code", ratio("voiced", "participants").alias("_v"))
    grid = with_each(cells, presence, "code").join(said, ["condition", "group_id", "replicate", "code"], "left")
    grid = written(grid.select("condition", "group_id", "replicate", "code", F.when(F.col("_m"), F.coalesce("_v", F.lit(0.0))).alias("v")), "grid")
    return grid.where(F.col("condition") == reference).select("group_id", "code", F.col("v").alias("x")), grid.where(F.col("condition") != reference).select("group_id", "condition", "replicate", "code", F.col("v").alias("y"))


CELL = ["group_id", "condition", "replicate"]


def group_ordering(presence: DataFrame, measured: DataFrame, reference: str) -> DataFrame:
    """Each session's reach against its group's reference, code by code: over the codes that the reference voices (`n_present`; recovered, at zero, unmeasured), and over the union with the session's own
    (n_union, tau_union). A session that wasn't measured scores nothing."""
    ref, gen = _measured(presence, measured, reference)
    both = gen.join(ref, ["group_id", "code"]).withColumnRenamed("code", "item")
    own = both.where("x > 0")
    facts = own.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n_present"), F.count_if(F.col("y") > 0).alias("recovered"), F.count_if(F.col("y") == 0).alias("at_zero"), F.count_if(F.col("y").isNull()).alias("unmeasured"))
    scored = ordering_similarity(own.where("y is not null"), CELL)
    union = kendall(both.where("(x > 0 or y > 0) and y is not null"), CELL).select(*CELL, F.col("n").alias("n_union"), F.col("tau_b").alias("tau_union"))
    return facts.join(scored, CELL, "left").join(union, CELL, "left")


def study_ordering(presence: DataFrame, measured: DataFrame, reference: str) -> DataFrame:
    """Each replicate of a condition as one study against the reference: order of the codes by groups that hold them, and by mean reach over the measured groups."""
    ref, gen = _measured(presence, measured, reference)
    profile = lambda df, by, v, n, m: df.groupBy(*by).agg(F.count_if(F.col(v) > 0).cast("double").alias(n), r6(F.avg(v)).alias(m), F.count_if(F.col(v).isNull()).alias(f"_{n}"))
    r, by = profile(ref, ["code"], "x", "xn", "xm"), ["condition", "replicate"]
    j = profile(gen, [*by, "code"], "y", "yn", "ym").join(r, "code").withColumnRenamed("code", "item")
    use = j.where("xm is not null and ym is not null")
    side = lambda x, y, name: ordering_similarity(use.select(*by, "item", F.col(x).alias("x"), F.col(y).alias("y")), by).select(*by, F.col("n").alias("codes"), F.col("tau_b").alias(f"tau_{name}"), F.col("undefined_reason").alias(f"reason_{name}"), F.col("top3").alias(f"top3_{name}"))
    blank = j.groupBy(*by).agg(F.sum("_yn").alias("unmeasured"))
    return blank.join(side("xn", "yn", "groups"), by, "left").join(side("xm", "ym", "reach").drop("codes"), by, "left")


def scenario_orderings(presence: DataFrame, reference: str) -> DataFrame:
    """group_ordering's tau-b under each scenario of `presence` (scenario, condition, group_id, replicate, code, present, voiced, participants), all in one plan: over the codes that the scenario's reference voices."""
    said = F.when(F.col("present"), ratio("voiced", "participants")).otherwise(0.0)
    p = written(presence.select("scenario", *CELL, "code", said.alias("v")), "scenarios")
    ref = p.where(F.col("condition") == reference).select("scenario", "group_id", "code", F.col("v").alias("x")).where("x > 0")
    j = p.where(F.col("condition") != reference).withColumnRenamed("v", "y").join(ref, ["scenario", "group_id", "code"]).withColumnRenamed("code", "item")
    return kendall(j, ["scenario", *CELL])


def transitions(orderings: DataFrame, base: str) -> DataFrame:
    """Each scenario's figure against the base's: whether it stays, becomes or ceases to be defined, and by how much it moves; sessions that only one side has count as undefined on the other."""
    one, by = orderings.where(F.col("scenario") == base), CELL
    named = orderings.where(F.col("scenario") != base).select("scenario").distinct()
    cells = with_each(orderings.select(*by).distinct(), named, "scenario")
    j = cells.join(orderings.select("scenario", *by, F.col("tau_b").alias("tau")), ["scenario", *by], "left").join(one.select(*by, F.col("tau_b").alias("base")), by, "left")
    a, b = F.col("base").isNotNull(), F.col("tau").isNotNull()
    kind = F.when(a & b, "stays_defined").when(a, "becomes_undefined").when(b, "becomes_defined").otherwise("stays_undefined")
    return j.select("scenario", *by, r6("base").alias("base"), r6("tau").alias("tau"), r6(F.col("tau") - F.col("base")).alias("moved"), kind.alias("transition"))


def ordering_summary(orderings: DataFrame, a: str, b: str) -> DataFrame:
    """Of group_ordering's rows, per group: the median over replicates of the defined tau-b of conditions a and b, their difference and its direction; values of single replicates are never averaged."""
    m = orderings.groupBy("group_id", "condition").agg(F.count("tau_b").alias("k"), F.percentile("tau_b", F.lit(0.5)).alias("m"), F.min("tau_b").alias("lo"), F.max("tau_b").alias("hi"))
    of = lambda c, v: F.max(F.when(F.col("condition") == c, F.col(v)))
    g = m.groupBy("group_id").agg(*(of(c, v).alias(f"{s}_{v}") for s, c in (("a", a), ("b", b)) for v in ("k", "m", "lo", "hi")))
    d = F.col("a_m") - F.col("b_m")
    direction = F.when(d.isNull(), "undefined").when(d > 0, a).when(d < 0, b).otherwise("tie")
    return g.select("group_id", *(F.coalesce(f"{s}_k", F.lit(0)).alias(f"defined_{s}") for s in "ab"), *(r6(f"{s}_{v}").alias(f"{name}_{s}") for s in "ab" for v, name in (("m", "median"), ("lo", "least"), ("hi", "most"))), r6(d).alias("difference"), direction.alias("direction"))
