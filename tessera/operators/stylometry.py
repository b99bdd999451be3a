"""Speaker attribution by style: cells, folds, n-gram TF-IDF centroids, identity gaps."""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import n_words, r6, ratio, word_slice
from ..scratch import written
from .order import joined, quantiles
from .stats import nth_values

CELL = ["doc", "question", "participant"]


def cells(turns: DataFrame) -> DataFrame:
    """Text of each document × question × participant in turn order, with opaque labels by document and word counts."""
    g = turns.groupBy(*CELL).agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("_t"))
    label = F.concat(F.lit("S"), F.dense_rank().over(W.partitionBy("doc").orderBy("participant")).cast("string"))
    df = g.withColumns({"label": label, "text": F.array_join(F.transform("_t", lambda x: x["text"]), " ")})
    return df.select(*CELL, "label", "text", n_words("text").alias("words"))


def eligibility(cell: DataFrame, budgets: list[int], others: int = 2) -> DataFrame:
    """For each word budget: folds with at least two participants who meet it in the held-out question and in `others` more."""
    b = cell.sparkSession.createDataFrame([(x,) for x in budgets], "budget int")
    j = cell.crossJoin(F.broadcast(b)).withColumn("ok", F.col("words") >= F.col("budget"))
    j = j.withColumn("_o", F.sum(F.col("ok").cast("int")).over(W.partitionBy("budget", "doc", "participant")) - F.col("ok").cast("int"))
    f = j.groupBy("budget", "doc", "question").agg(F.count_if(F.col("ok") & (F.col("_o") >= others)).alias("participants"))
    return f.groupBy("budget").agg(F.count_if(F.col("participants") >= 2).alias("folds"), F.count_distinct(F.when(F.col("participants") >= 2, F.col("doc"))).alias("docs"))


#: Distinct words of cells in a part, and of a document whose n-grams are counted at once; more go in slices by the hash of the n-gram.
WORDS_A_PART, WORDS_A_SLICE = 20_000, 50_000


def char_ngrams(w: str, lo: int, hi: int) -> list[str]:
    """Character n-grams of a padded word; a shorter word gives itself once for each n."""
    return [g for n in range(lo, hi + 1) for g in ([w] if len(w) <= n else [w[i : i + n] for i in range(len(w) - n + 1)])]


def products(cell: DataFrame, lo: int, hi: int) -> DataFrame:
    """(cell, qb, pb, at, t): inner products of the n-gram counts (of words padded by one space at each side) of the ordered pairs of cells of a document that
    share a gram, apart by `at`, the questions of the cells that hold the gram (once for each cell).

    The distinct words are written and dealt by document; a document's n-grams are counted where its words lie and never move.
    """
    w = F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != "")
    pad = written(cell.select(*CELL, F.explode(w).alias("_w")).groupBy(*CELL, "_w").agg(F.count(F.lit(1)).alias("_c")), "words")
    slices = pad.withColumn("_k", F.floor(F.count(F.lit(1)).over(W.partitionBy("doc")) / WORDS_A_SLICE) + 1).withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1)))
    slices = slices.repartition(1 + pad.count() // WORDS_A_PART, "doc", "_s")

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[["question", "participant"]].drop_duplicates().reset_index(drop=True)
        place = pdf.merge(own.assign(_i=own.index), on=["question", "participant"])
        word, words = pd.factorize(place["_w"])
        grams = [[g for g in char_ngrams(f" {x} ", lo, hi) if key[2] == 1 or crc32(g.encode()) % key[2] == key[1]] for x in words]
        by_word = np.zeros((len(words), len(own)), np.int64)
        np.add.at(by_word, (word, place["_i"].to_numpy()), place["_c"].to_numpy())
        gram, names = pd.factorize(np.array([g for gs in grams for g in gs], object))
        tf = np.zeros((len(names), len(own)), np.int64)
        np.add.at(tf, gram, by_word[np.repeat(np.arange(len(words)), [len(gs) for gs in grams])])
        asked, questions = pd.factorize(own["question"], sort=True)
        held = np.stack([(tf[:, asked == k] > 0).sum(1) for k in range(len(questions))], 1)
        which = np.zeros(len(names), np.int64)
        for column in held.T:
            which = pd.factorize(which * (len(own) + 1) + column)[0]
        order = np.argsort(which, kind="stable")
        out = []
        for rows in np.split(order, np.cumsum(np.bincount(which))[:-1]) if len(order) else []:
            at, part = held[rows[0]], tf[rows]
            t = part.T @ part
            a, b = np.nonzero(t)
            out.append(pd.DataFrame({"doc": key[0], "question": own["question"].to_numpy()[a], "participant": own["participant"].to_numpy()[a], "qb": own["question"].to_numpy()[b], "pb": own["participant"].to_numpy()[b], "at": [np.repeat(questions, at)] * len(a), "t": t[a, b]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["doc", "question", "participant", "qb", "pb", "at", "t"])

    doc, question, participant = (cell.schema[c].dataType.simpleString() for c in CELL)
    fields = f"doc {doc}, question {question}, participant {participant}, qb {question}, pb {participant}, at array<{question}>, t long"
    p = slices.groupBy("doc", "_s", "_k").applyInPandas(count, fields)
    return written(p.groupBy(*CELL, "qb", "pb", "at").agg(F.sum("t").alias("t")), "products")


def same_cell() -> Column:
    return (F.col("question") == F.col("qb")) & (F.col("participant") == F.col("pb"))


def cosines(cell: DataFrame, lo: int, hi: int, test: Column) -> DataFrame:
    """(cell, qb, pb, s): cosines of the n-gram counts of pairs of cells that meet `test`."""
    p = products(cell, lo, hi).where(test | same_cell()).groupBy(*CELL, "qb", "pb").agg(F.sum("t").alias("t"))
    norm = p.where(same_cell()).select(*CELL, F.sqrt("t").alias("_na"))
    p = p.where(test).join(norm.hint("merge"), CELL).join(norm.select("doc", F.col("question").alias("qb"), F.col("participant").alias("pb"), F.col("_na").alias("_nb")).hint("merge"), ["doc", "qb", "pb"])
    return p.select(*CELL, "qb", "pb", (F.col("t") / (F.col("_na") * F.col("_nb"))).alias("s"))


def attribute(cell: DataFrame, lo: int = 3, hi: int = 5) -> DataFrame:
    """Leave one question out: idf and speaker centroids come from a document's other questions only; each held-out cell goes to the nearest
    centroid (ties to the least participant). Gives one trial a cell: truth, guess, margin.

    All follows from inner products of counts: in a fold a gram's idf depends on the questions of the cells that hold it, so products are summed apart
    by these, and weights come to sums, not to grams.
    """
    q, p, qb, pb, fold = (F.col(c) for c in ("question", "participant", "qb", "pb", "fold"))
    t = products(cell, lo, hi).where((q != qb) | (p == pb))
    n = cell.groupBy("doc", "question").agg(F.count(F.lit(1)).alias("_n")).select("doc", q.alias("fold"), (F.sum("_n").over(W.partitionBy("doc")) - F.col("_n")).alias("_n"))
    g = t.join(n.hint("merge"), "doc").where(((q == fold) | (p == pb)) & ((qb != fold) | same_cell())).withColumn("_df", F.size(F.filter("at", lambda x: x != fold))).where("_df > 0")
    idf = F.log((1 + F.col("_n")) / (1 + F.col("_df"))) + 1
    g = written(g.groupBy("doc", "fold", "question", "participant", "qb", "pb").agg(F.sum(F.col("t") * idf * idf).alias("g")), "weighted")
    size = g.where(same_cell()).select("doc", "fold", "question", "participant", F.sqrt("g").alias("_na"))
    other = size.select("doc", "fold", q.alias("qb"), p.alias("pb"), F.col("_na").alias("_nb"))
    near = g.where(qb != fold).join(other.hint("merge"), ["doc", "fold", "qb", "pb"])
    norm = near.where(q != fold).join(size.hint("merge"), ["doc", "fold", "question", "participant"]).groupBy("doc", "fold", pb.alias("candidate")).agg(F.sqrt(F.sum(F.col("g") / (F.col("_na") * F.col("_nb")))).alias("norm"))
    d = near.where(q == fold).groupBy("doc", "fold", "participant", pb.alias("candidate")).agg(F.sum(F.col("g") / F.col("_nb")).alias("d"))
    tn = size.where(q == fold).select("doc", "fold", "participant", F.col("_na").alias("tn"))
    s = d.join(norm.hint("merge"), ["doc", "fold", "candidate"]).join(tn.hint("merge"), ["doc", "fold", "participant"]).withColumn("sim", F.round(F.col("d") / (F.col("norm") * F.col("tn")), 9))
    rank = F.row_number().over(W.partitionBy("doc", "fold", "participant").orderBy(F.desc("sim"), "candidate"))
    s = s.withColumns({"_r": rank, "_k": F.count(F.lit(1)).over(W.partitionBy("doc", "fold", "participant"))})
    return s.groupBy("doc", "fold", F.col("participant").alias("truth")).agg(F.max(F.when(F.col("_r") == 1, F.col("candidate"))).alias("guess"), F.max("_k").alias("candidates"), r6(F.max(F.when(F.col("_r") == 1, F.col("sim"))) - F.max(F.when(F.col("_r") == 2, F.col("sim")))).alias("margin"))


def trial_summary(trials: DataFrame) -> DataFrame:
    """Accuracy, mean chance of the folds, accuracy corrected for chance, and over the true speakers mean F1 and mean recall, per document."""
    hit, chance = (F.col("truth") == F.col("guess")).cast("double"), 1.0 / F.col("candidates")
    g = trials.groupBy("doc").agg(F.count(F.lit(1)).alias("trials"), F.avg(hit).alias("_a"), F.avg(chance).alias("_c"))
    sides = trials.select("doc", F.inline(F.array(*(F.struct(F.col(c).alias("_l"), F.lit(int(c == "truth")).alias("_t"), F.lit(int(c == "guess")).alias("_p"), (F.col("truth") == F.col("guess")).cast("int").alias("_h")) for c in ("truth", "guess")))))
    by = sides.groupBy("doc", "_l").agg(F.sum("_t").alias("_t"), F.sum("_p").alias("_p"), (F.sum("_h") / 2).alias("_h")).where("_t > 0")
    by = by.groupBy("doc").agg(F.avg(2 * F.col("_h") / (F.col("_t") + F.col("_p"))).alias("_f"), F.avg(F.col("_h") / F.col("_t")).alias("_r"))
    rates = (r6("_a").alias("accuracy"), r6("_c").alias("chance"), r6(ratio(F.col("_a") - F.col("_c"), 1 - F.col("_c"))).alias("corrected"), r6("_f").alias("macro_f1"), r6("_r").alias("balanced_accuracy"))
    return g.join(by.hint("merge"), "doc").select("doc", "trials", *rates)


def hierarchical(summary: DataFrame, group: str) -> DataFrame:
    """Documents to groups: missing documents are absent, not zero."""
    return summary.groupBy(group).agg(F.count("accuracy").alias("docs"), r6(F.avg("accuracy")).alias("accuracy"), r6(F.avg("corrected")).alias("corrected"))


def identity_gap(cell: DataFrame, lo: int = 3, hi: int = 5) -> DataFrame:
    """Cosine of n-gram counts between cells of different questions: same speaker against different speakers within each question pair."""
    p = cosines(cell, lo, hi, F.col("question") < F.col("qb"))
    p, by = written(p.withColumn("same", F.col("participant") == F.col("pb")), "cosines"), ["doc", "question", "qb"]
    median = lambda test, name: quantiles(p.where(test), by, "s", {name: 0.5}).drop("n")
    q = p.select(*by).distinct()
    for test, name in (("same", "own"), ("not same", "other")):
        q = joined(q, median(test, name), by)
    return q.groupBy("doc").agg(F.count(F.lit(1)).alias("pairs"), r6(F.percentile(F.col("own") - F.col("other"), F.lit(0.5))).alias("gap"))


def within_question(cell: DataFrame, lo: int = 3, hi: int = 5) -> DataFrame:
    """Median cosine of different speakers' cells of one question, then over a document's questions."""
    p = cosines(cell, lo, hi, (F.col("question") == F.col("qb")) & (F.col("participant") < F.col("pb")))
    return p.groupBy("doc", "question").agg(F.percentile("s", F.lit(0.5)).alias("m")).groupBy("doc").agg(F.count(F.lit(1)).alias("questions"), r6(F.percentile("m", F.lit(0.5))).alias("similarity"))


def budgeted(cell: DataFrame, budget: int) -> DataFrame:
    """Cells of at least `budget` words, cut to their first `budget`."""
    return cell.where(F.col("words") >= budget).withColumn("text", word_slice("text", 1, budget))


def sweep(cell: DataFrame, settings: list[tuple[int, int, int]]) -> DataFrame:
    """The attribution summary over n-gram ranges and word budgets (lo, hi, budget), each recomputed from cells that are cut and written once."""
    least, most = min(b for *_, b in settings), max(b for *_, b in settings)
    cell, out = written(cell.where(F.col("words") >= least).withColumn("text", word_slice("text", 1, most)), "cells"), None
    for lo, hi, budget in settings:
        t = attribute(budgeted(cell, budget), lo, hi).agg(F.count(F.lit(1)).alias("trials"), r6(F.avg((F.col("truth") == F.col("guess")).cast("double"))).alias("accuracy")).select(F.lit(f"{lo}-{hi}@{budget}").alias("setting"), "trials", "accuracy")
        out = t if out is None else out.unionByName(t)
    return out


# Words that deny, and words of high frequency.
NEGATION = ["not", "never", "no", "nothing", "none", "dont", "doesnt", "didnt", "wouldnt", "wont", "cant", "couldnt", "hardly", "rarely", "barely"]
FREQUENCY = ["always", "every", "constantly", "usually", "mostly", "often", "definitely", "absolutely"]
FREQUENT_PHRASE = "all the time"


def pair_screen(turns: DataFrame, least_words: int, least_shared: int, far: float = 0.12, cut: float = 0.70) -> DataFrame:
    """A speaker's turns in different questions, as candidates for a check of consistency: shared content terms (four letters or more), their Jaccard, the
    cosine of the turns' TF-IDF (over the speaker's turns), whether they differ in denial or in high frequency, and a stratum. Pairs of a cosine at or
    above that at the place `cut` of all, with enough shared terms, are high, with or without contrast; the others are controls."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    often = F.arrays_overlap(words, F.array(*map(F.lit, FREQUENCY))) | F.contains(F.lower("text"), F.lit(FREQUENT_PHRASE))
    t = turns.where(F.col("n_words") >= least_words).select("doc", "participant", "question", "ord", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)).alias("k"), F.arrays_overlap(words, F.array(*map(F.lit, NEGATION))).alias("no"), often.alias("often"))
    who, t = ["doc", "participant"], written(t, "screened")
    tf = t.select(*who, "question", "ord", F.explode("k").alias("term")).groupBy(*who, "question", "ord", "term").agg(F.count(F.lit(1)).alias("tf"))
    n = t.groupBy(*who).agg(F.count(F.lit(1)).alias("n"))
    idf = tf.groupBy(*who, "term").agg(F.count(F.lit(1)).alias("df")).join(n.hint("merge"), who).select(*who, "term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    w = tf.join(idf.hint("merge"), [*who, "term"]).withColumn("x", F.col("tf") * F.col("idf"))
    w = written(w.withColumn("x", F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(W.partitionBy(*who, "ord")))), "weights")
    v = w.select(*who, F.col("question").alias("qb"), F.col("ord").alias("ob"), "term", F.col("x").alias("y"))
    cos = w.join(v.hint("merge"), [*who, "term"]).where(F.col("question") < F.col("qb")).groupBy(*who, "ord", "ob").agg(F.sum(F.col("x") * F.col("y")).alias("_c"))
    d = t.withColumn("k", F.array_distinct("k"))
    b = d.select(*who, F.col("question").alias("qb"), F.col("ord").alias("ob"), F.col("k").alias("kb"), F.col("no").alias("nb"), F.col("often").alias("fb"))
    j = d.join(b.hint("merge"), who).where(F.col("question") < F.col("qb")).join(cos.hint("merge"), [*who, "ord", "ob"], "left")
    contrast = (F.col("no") != F.col("nb")) | (F.col("often") != F.col("fb"))
    j = j.select(*who, "ord", "ob", F.size(F.array_intersect("k", "kb")).alias("shared"), F.size(F.array_union("k", "kb")).alias("_u"), F.round(F.coalesce("_c", F.lit(0.0)), 4).alias("cosine"), contrast.alias("contrast"))
    j = written(j, "screened-pairs")  # the level takes two passes
    (level,) = nth_values(j, "cosine", lambda n: [int(n * cut)])
    high = (F.col("cosine") >= F.lit(level)) & (F.col("shared") >= least_shared)
    jac = ratio("shared", "_u")
    stratum = F.when(high & F.col("contrast"), "high_with_contrast").when(high, "high_without_contrast").otherwise("control")
    return j.select(*who, "ord", "ob", "shared", r6(jac).alias("jaccard"), F.coalesce(jac < far, F.lit(True)).alias("far"), "cosine", "contrast", stratum.alias("stratum"))
