"""Quality rules by weak supervision, in DataFrame and SQL functions only.

Each rule votes good (1) or bad (-1) or abstains (0). Expectation-maximisation on the table of vote patterns (at most 3**rules rows at
any corpus size, so that is all the driver sees) estimates each rule's rate of each vote on good and on bad documents. A document
stays if it passes the two base rules and its posterior probability of being good, under the fitted rates of votes and abstentions, is
at least 0.5.

Defined results: null and empty texts have no words and fail the base rule; extra columns pass through `quality_filter`; repeated
rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, words, written
from .weak import expectation_maximisation, log_ratios

#: The commonest function words of four languages.
COMMON = (
    "the of and to in is that it for was on are with as this be at or from "
    "der die und den das von zu mit sich des auf ein eine ist im als auch es "
    "de la le les et des en un une du que dans est pour pas qui sur au "
    "el los las del se por con para una su al lo como"
).split()
#: rule: (feature, good if, bad if); else the rule abstains. Rules that look for a fault don't take its absence for a virtue.
RULES = {
    "symbols": ("symbol_ratio", "false", "symbol_ratio > 0.1"),
    "word_length": ("mean_word", "mean_word between 3.5 and 7.5", "mean_word < 3 or mean_word > 8.5"),
    "distinct": ("distinct_ratio", "false", "distinct_ratio < 0.25"),
    "repeats": ("repeat_ratio", "false", "repeat_ratio > 0.3"),
    "lines": ("dup_line_ratio", "false", "dup_line_ratio > 0.3"),
    "common": ("common_words", "common_words >= 2", "common_words = 0"),
    "sentences": ("end_ratio", "end_ratio >= 0.6", "n_lines >= 2 and end_ratio < 0.2"),
}
_LOW = 0xFFFFFF  # a word's place in the low bits of a long whose other bits are hash; longer texts take structs of both


def _flat_repeats(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words from `_w`: places of 3-word windows are sorted by hash inside the row; neighbours that share it are
    compared as strings, so the hash only decides what is compared."""
    near = lambda f: f"{f('i-1')} or {f('i+1')}"
    window = "xxhash64(get(_w, i), get(_w, i + 1), get(_w, i + 2))"
    packed = f"sort_array(transform(sequence(0, size(_w) - 3), i -> ({window} & ~{_LOW}L) | i))"
    pairs = f"array_sort(transform(sequence(0, size(_w) - 3), i -> struct({window} as h, i as p)))"
    return (
        df.withColumn("_k", F.expr(f"if(n_words >= 3 and n_words <= {_LOW}, {packed}, array())"))
        .withColumn("_k", F.expr(f"filter(_k, (x, i) -> {near(lambda j: f'((x ^ get(_k, {j})) & ~{_LOW}L) = 0L')})"))
        .withColumn("_k", F.expr(f"transform(_k, x -> cast(x & {_LOW}L as int))"))
        .withColumn("_s", F.expr(f"if(n_words > {_LOW}, {pairs}, array())"))
        .withColumn("_k", F.expr(f"if(n_words > {_LOW}, transform(filter(_s, (x, i) -> {near(lambda j: f'x.h = get(_s, {j}).h')}), x -> x.p), _k)"))
        .withColumn("_k", F.expr("array_sort(transform(_k, p -> struct(concat_ws(' ', slice(_w, p + 1, 3)) as t, p as p)))"))
        .withColumn("_k", F.expr(f"sort_array(transform(filter(_k, (x, i) -> {near(lambda j: f'x.t = get(_k, {j}).t')}), x -> x.p))"))
        .withColumn("n_repeat_words", F.expr("aggregate(zip_with(_k, slice(_k, 2, size(_k)), (a, b) -> least(3, coalesce(b - a, 3))), 0L, (s, x) -> s + x)"))
        .drop("_k", "_s")
    )


def features(docs: DataFrame, keep: list[Column | str]) -> DataFrame:
    """`keep` and, for each document, the counts and ratios that the rules read."""
    df = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_t")).withColumn("_w", words(F.col("_t"))).withColumn("n_words", F.size("_w").cast("long"))
    df = _flat_repeats(df).withColumn("_l", F.expr(r"filter(split(_t, '\n', -1), l -> rlike(l, '[^\\x20\\x09-\\x0D]'))"))
    df = df.withColumns({
        "word_chars": (F.char_length("_t") - F.regexp_count("_t", F.lit(SPACE))).cast("long"),
        "n_symbols": F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_lines": F.size("_l"), "_dl": F.size(F.array_distinct("_l")), "_du": F.size(F.array_distinct("_w")),
        "common_words": F.size(F.array_intersect("_w", F.array(*map(F.lit, COMMON)))),
        "_ends": F.expr(r"size(filter(_l, l -> rlike(l, '[.!?:;\"][\\x20\\x09-\\x0D]*$')))"),
    }).withColumn("n_dup_lines", (F.col("n_lines") - F.col("_dl")).cast("long"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return df.withColumns({
        "symbol_ratio": ratio("n_symbols", "n_words"), "mean_word": ratio("word_chars", "n_words"), "distinct_ratio": ratio("_du", "n_words"),
        "repeat_ratio": ratio("n_repeat_words", "n_words"), "dup_line_ratio": ratio("n_dup_lines", "n_lines"), "end_ratio": ratio("_ends", "n_lines"),
    }).drop("_t", "_w", "_l", "_dl", "_du", "_ends")


def votes(scored: DataFrame) -> DataFrame:
    return scored.withColumns({f"vote_{k}": F.when(F.col("n_words") == 0, 0).when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0) for k, (_, good, bad) in RULES.items()})


def fit(voted: DataFrame) -> tuple[float, dict[str, dict[int, float]]]:
    """Expectation-maximisation over the vote patterns: the log odds of good, and for each rule and vote its log likelihood ratio."""
    names = list(RULES)
    patterns = [(tuple(r[f"vote_{k}"] for k in names), r["n"]) for r in voted.groupBy(*(f"vote_{k}" for k in names)).agg(F.count(F.lit(1)).alias("n")).collect()]
    prior, rate = expectation_maximisation(patterns, len(names), prior=0.8, bounds=(0.5, 0.99))
    return math.log(prior / (1 - prior)), dict(zip(names, log_ratios(rate, len(names)), strict=True))


def _verdict(voted: DataFrame, model: tuple[float, dict[str, dict[int, float]]]) -> DataFrame:
    odds = F.lit(model[0])
    for k, r in model[1].items():
        odds = odds + F.when(F.col(f"vote_{k}") == 1, r[1]).when(F.col(f"vote_{k}") == -1, r[-1]).otherwise(r[0])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return voted.withColumn("quality", 1 / (1 + F.exp(-odds))).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality") >= 0.5))


def quality_report(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, the base counts, base_failed, kept, quality (the posterior) and each rule's vote."""
    voted = written(votes(features(docs, ["doc_id"])), "votes")
    out = _verdict(voted, fit(voted))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality", *(f"vote_{k}" for k in RULES))


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents that stay, all their columns unchanged."""
    voted = written(votes(features(docs, [F.struct("*").alias("_row")])), "votes")
    return _verdict(voted, fit(voted)).where("kept").select("_row.*")
