"""Lexical geometry: diversity, overlap, TF-IDF similarity; long-form vectors, joins on terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import r6, ratio, tokens
from ..scratch import written


#: Terms above a COMMON-th of all (document, term) rows are hot.
COMMON = 1000

#: Hashes whose n-grams are counted by themselves; with more of them (rare n-grams only, all as frequent) all n-grams are.
FEW = 10_000


def _worded(turns: DataFrame, by: list[str], min_len: int = 1) -> DataFrame:
    """(by, turn_index, _words, _k): the tokens of each turn that has any, parted by a space, and their number."""
    t = turns.where(F.lower("text").rlike(f"[a-z]{{{min_len}}}")).select(*by, "turn_index", tokens("text", "[a-z]+", min_len).alias("_t"))
    return t.select(*by, "turn_index", F.array_join("_t", " ").alias("_words"), F.size("_t").alias("_k"))


def token_rows(turns: DataFrame, by: list[str], min_len: int = 1) -> DataFrame:
    """(by, pos, term): the tokens of a unit in the order of its turns. Turns are put in order, not tokens."""
    t = _placed(_worded(turns, by, min_len), by).select(*by, "_before", F.posexplode(F.split("_words", " ")).alias("_i", "term"))
    return t.select(*by, "term", (F.col("_before") + F.col("_i") + 1).cast("int").alias("pos"))


def terms(turns: DataFrame, by: list[str]) -> DataFrame:
    """(by, term): the tokens of a unit, as often as they occur, without an order."""
    return turns.select(*by, F.explode(tokens("text", "[a-z]+")).alias("term"))


def term_rows(turns: DataFrame, by: list[str]) -> DataFrame:
    """(by, term): the distinct tokens of each turn."""
    return turns.select(*by, F.explode(F.array_distinct(tokens("text", "[a-z]+"))).alias("term"))


def diversity(rows: DataFrame, by: list[str], *windows: int) -> DataFrame:
    """TTR and, for each window, MATTR: a token is new in the windows that start after its last occurrence, so the distinct counts of all windows add
    up in one pass; NULL for units shorter than the window."""
    prev = F.coalesce(F.lag("pos").over(W.partitionBy(*by, "term").orderBy("pos")), F.lit(0))
    # reads _prev (of all rows), so that it comes after that window and needs no sort of its own
    d = rows.withColumn("_prev", prev).withColumn("_n", F.count_if(F.col("_prev") >= 0).over(W.partitionBy(*by)))

    def new(window: int) -> Column:
        lo, hi = F.greatest(F.col("_prev") + 1, F.col("pos") - window + 1, F.lit(1)), F.least(F.col("pos"), F.col("_n") - window + 1)
        return F.sum(F.greatest(hi - lo + 1, F.lit(0)))

    g = d.groupBy(*by).agg(F.count(F.lit(1)).alias("tokens"), F.count_if(F.col("_prev") == 0).alias("types"), *(new(w).alias(f"_s{w}") for w in windows))
    mattr = lambda w: F.when(F.col("tokens") >= w, ratio(f"_s{w}", F.lit(w) * (F.col("tokens") - w + 1)))
    return g.select(*by, "tokens", "types", r6(ratio("types", "tokens")).alias("ttr"), *(r6(mattr(w)).alias(f"mattr_{w}") for w in windows))


def vocabulary_overlap(rows: DataFrame) -> DataFrame:
    """Mean pairwise Jaccard of the speakers' vocabularies in a session, from counts of shared terms."""
    v = written(rows.select("session_id", "speaker_id", "term").distinct(), "vocabularies")
    n = v.groupBy("session_id", "speaker_id").agg(F.count(F.lit(1)).alias("n"))
    who = v.where("speaker_id is not null").groupBy("session_id", "term").agg(F.collect_list("speaker_id").alias("_s")).where(F.size("_s") > 1)
    two = F.flatten(F.transform("_s", lambda a: F.transform(F.filter("_s", lambda b: a < b), lambda b: F.struct(a.alias("speaker_id"), b.alias("sb")))))
    shared = who.select("session_id", F.inline(two)).groupBy("session_id", "speaker_id", "sb").agg(F.count(F.lit(1)).alias("k"))
    pairs = n.join(n.withColumnsRenamed({"speaker_id": "sb", "n": "nb"}).hint("merge"), "session_id").where("speaker_id < sb").join(shared.hint("merge"), ["session_id", "speaker_id", "sb"], "left")
    k = F.coalesce("k", F.lit(0))
    return pairs.withColumn("j", k / (F.col("n") + F.col("nb") - k)).groupBy("session_id").agg(F.count(F.lit(1)).alias("pairs"), r6(F.avg("j")).alias("jaccard"))


def budgeted_overlap(turns: DataFrame, budget: int, windows: int = 10) -> DataFrame:
    """Speakers' windows of `budget` tokens, evenly spread and all different: pairwise Jaccard, Jensen-Shannon distance (base 2) and cosine of term
    counts, averaged over the pairs of each window and over windows. The speaker with the fewest places for a window sets their number. A session in
    which a speaker has fewer than `budget` tokens, or with one speaker only, stays undefined. No token becomes a row: turns do, then speakers with the
    tokens inside their windows (windows * budget at most), then pairs of windows, so tasks hold about as much as the texts."""
    by = ["session_id", "speaker_id"]
    t = written(_worded(turns, by), "tokens")
    size = t.groupBy(*by).agg(F.sum("_k").alias("_n"))
    least = size.groupBy("session_id").agg(F.min("_n").alias("_least"), F.count(F.lit(1)).alias("speakers"))
    k = F.least(F.lit(windows), F.col("_least") - budget + 1).cast("int")
    least = least.withColumn("windows", F.when((F.col("_least") >= budget) & (F.col("speakers") > 1), k))
    at = F.when(F.col("windows") == 1, F.array(F.floor((F.col("_n") - budget) / 2))).otherwise(F.transform(F.sequence(F.lit(0), F.col("windows") - 1), lambda i: F.bround(i * (F.col("_n") - budget) / (F.col("windows") - 1)).cast("long")))
    place = size.join(least.where("windows is not null").hint("merge"), "session_id").select(*by, at.alias("_at"))
    a = written(_covered(_placed(t, by), place, by, budget), "covered")
    b = a.withColumnsRenamed({"speaker_id": "sb", "_words": "_other", "_from": "_ofrom"})
    pairs = a.join(b.hint("merge"), "session_id").where("speaker_id < sb").select("session_id", F.split("_words", " ").alias("_a"), F.split("_other", " ").alias("_b"), F.arrays_zip("_from", "_ofrom").alias("_i"))
    w = pairs.select("session_id", "_a", "_b", F.inline("_i")).select("session_id", _counts(F.slice("_a", F.col("_from") + 1, budget)).alias("a"), _counts(F.slice("_b", F.col("_ofrom") + 1, budget)).alias("b"))
    shared = F.transform(F.array_intersect(F.map_keys("a"), F.map_keys("b")), lambda t: F.struct(F.element_at("a", t).alias("x"), F.element_at("b", t).alias("y")))
    w = w.select("session_id", "a", "b", shared.alias("_s"))
    # in counts; a term of one side only adds its count to the sum of the Jensen-Shannon terms, as log2(x / (x / 2)) is 1
    kl = lambda v, x, y: v * F.log2(2 * v / (x + y)) - v
    js = 2 * budget + F.aggregate("_s", F.lit(0.0), lambda s, p: s + kl(p["x"], p["x"], p["y"]) + kl(p["y"], p["x"], p["y"]))
    dot = F.aggregate("_s", F.lit(0).cast("long"), lambda s, p: s + p["x"] * p["y"])
    square = lambda c: F.aggregate(F.map_values(c), F.lit(0).cast("long"), lambda s, x: s + x * x)
    g = w.select("session_id", (F.size("_s") / (F.size("a") + F.size("b") - F.size("_s"))).alias("jac"), F.sqrt(F.greatest(js / (2 * budget), F.lit(0.0))).alias("js"), (dot / F.sqrt(square("a") * square("b"))).alias("cos"))
    g = g.groupBy("session_id").agg(r6(F.avg("jac")).alias("jaccard"), r6(F.avg("js")).alias("js"), r6(F.avg("cos")).alias("cosine"))
    return least.join(g.hint("merge"), "session_id", "left").select("session_id", "speakers", "windows", "jaccard", "js", "cosine")


def _placed(t: DataFrame, by: list[str]) -> DataFrame:
    """(by, _words, _k, _before): the turns of a unit with the number of its tokens before each. Turns of the same turn_index go token by token, the first
    tokens of all before the second ones (as ordered by themselves), so these are cut into tokens."""
    t = t.repartition(*by).withColumn("_same", F.count(F.lit(1)).over(W.partitionBy(*by, "turn_index")))
    whole = F.array(F.struct(F.lit(0).alias("_p"), F.col("_words"), F.col("_k")))
    each = F.transform(F.split("_words", " "), lambda x, i: F.struct(i.alias("_p"), x.alias("_words"), F.lit(1).alias("_k")))
    t = t.select(*by, "turn_index", F.inline(F.when(F.col("_same") > 1, each).otherwise(whole)))
    return t.withColumn("_before", F.sum("_k").over(W.partitionBy(*by).orderBy("turn_index", "_p", "_words").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_k"))


def _covered(placed: DataFrame, place: DataFrame, by: list[str], budget: int) -> DataFrame:
    """(by, _words, _from): a unit's tokens that lie in windows, in their order, and how many of them come before each window."""
    inside = F.filter(F.split("_words", " "), lambda _, p: F.exists("_at", lambda a: (F.col("_before") + p >= a) & (F.col("_before") + p < a + budget)))
    t = placed.join(place.hint("merge"), by).where(F.exists("_at", lambda a: (a < F.col("_before") + F.col("_k")) & (a + budget > F.col("_before"))))
    g = t.select(*by, "_at", F.struct("_before", F.array_join(inside, " ").alias("_words")).alias("_part")).groupBy(*by).agg(F.first("_at").alias("_at"), F.sort_array(F.collect_list("_part")).alias("_parts"))
    new = lambda i: F.transform(F.slice("_at", 2, i), lambda a, j: F.least(a - F.get("_at", j), F.lit(budget)))
    start = F.transform("_at", lambda _, i: F.aggregate(new(i), F.lit(0).cast("long"), lambda s, x: s + x).cast("int"))
    return g.select(*by, F.array_join("_parts._words", " ").alias("_words"), start.alias("_from"))


def _counts(terms: Column) -> Column:
    """The occurrences of each term of an array, as a map: in sorted order a term ends where the next one starts. Arrays of one element bind what is used more than once."""
    bind = lambda c, f: F.get(F.transform(F.array(c), f), 0)
    starts = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: (j == 0) | (F.get(s, j) != F.get(s, j - 1)))
    counts = lambda s, at: F.map_from_arrays(F.transform(at, lambda j: F.get(s, j)), F.zip_with(at, F.slice(at, 2, F.size(s)), lambda x, y: (F.coalesce(y, F.size(s)) - x).cast("long")))
    return bind(F.sort_array(terms), lambda s: bind(starts(s), lambda at: counts(s, at)))


def direction_verdict(values: DataFrame, a: str, b: str) -> DataFrame:
    """(spec, condition, group_id, value): group means, then condition means by spec; whether specs with all groups agree on the sign."""
    m = values.groupBy("spec", "condition", "group_id").agg(F.avg("value").alias("v")).groupBy("spec", "condition").agg(F.avg("v").alias("v"), F.count("v").alias("n"))
    at = lambda c, x: F.max(F.when(F.col("condition") == c, F.col(x)))
    return m.groupBy("spec").agg(r6(at(a, "v") - at(b, "v")).alias("difference"), F.least(at(a, "n"), at(b, "n")).alias("groups"), (at(a, "v") > at(b, "v")).alias("a_greater"))


def tfidf(rows: DataFrame, doc: str) -> DataFrame:
    """(doc, term, weight): raw counts times smooth idf ln((1 + n) / (1 + df)) + 1, L2-normalised."""
    tf = written(rows.groupBy(doc, "term").agg(F.count(F.lit(1)).alias("tf")), "counts")
    n = tf.select(doc).distinct().agg(F.count(F.lit(1)).alias("_n"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    # a term with more than a COMMON-th of all rows goes to every row by broadcast, and there are fewer than COMMON of these; the rest are joined by merging
    total = tf.agg(F.count(F.lit(1)).alias("_rows"))
    often = F.broadcast(df.crossJoin(F.broadcast(total)).where(F.col("_df") * COMMON > F.col("_rows")).drop("_rows"))
    rare = tf.join(often.select("term"), "term", "left_anti").join(df.hint("merge"), "term")
    w = tf.join(often, "term").unionByName(rare).crossJoin(F.broadcast(n)).withColumn("w", F.col("tf") * (F.log((1 + F.col("_n")) / (1 + F.col("_df"))) + 1))
    return w.select(doc, "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(doc)))).alias("weight"))


def cosine_pairs(vectors: DataFrame, block: str, doc: str) -> DataFrame:
    """Cosine of pairs of documents inside a block, as a join on terms."""
    b = vectors.select(block, F.col(doc).alias("other"), "term", F.col("weight").alias("_w"))
    return vectors.join(b.hint("merge"), [block, "term"]).where(F.col(doc) < F.col("other")).groupBy(block, doc, "other").agg(r6(F.sum(F.col("weight") * F.col("_w"))).alias("cosine"))


def length_bands(turns: DataFrame, edges: list[int]) -> DataFrame:
    """Turns, words and distinct words by length band and condition."""
    band = F.coalesce(*(F.when(F.col("n_words") < e, F.lit(f"<{e}")) for e in edges), F.lit(f">={edges[-1]}"))
    return turns.groupBy("condition", band.alias("band")).agg(F.count(F.lit(1)).alias("turns"), F.sum("n_words").alias("words"))


def keyness(rows: DataFrame, side: str, least: int = 20) -> DataFrame:
    """Log-likelihood keyness of terms between two values of `side` (0 and 1); terms of at least `least` occurrences."""
    c = rows.groupBy("term").agg(F.count_if(F.col(side) == 0).alias("a"), F.count_if(F.col(side) == 1).alias("b"))
    t = c.agg(F.sum("a").alias("_ta"), F.sum("b").alias("_tb"))
    j = c.where(F.col("a") + F.col("b") >= least).crossJoin(F.broadcast(t))
    e = lambda k: F.col(f"_t{k}") * (F.col("a") + F.col("b")) / (F.col("_ta") + F.col("_tb"))
    part = lambda k: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / e(k))).otherwise(0.0)
    return j.select("term", "a", "b", r6(2 * (part("a") + part("b"))).alias("g2"))


def mean_pairwise(vectors: DataFrame, group: str, doc: str) -> DataFrame:
    """Mean pairwise cosine distance inside a group of unit vectors, in closed form from the squared norm of their sum: linear in the texts."""
    n = vectors.select(group, doc).distinct().groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    s = vectors.groupBy(group, "term").agg(F.sum("weight").alias("s")).groupBy(group).agg(F.sum(F.col("s") * F.col("s")).alias("_q"))
    return n.join(s.hint("merge"), group).select(group, "n", r6(1 - ratio(F.col("_q") - F.col("n"), F.col("n") * (F.col("n") - 1))).alias("distance"))


def speaker_collapse(vectors: DataFrame, session: str, speaker: str, doc: str) -> DataFrame:
    """Mean cosine distance between speakers' centroids, and the mean distance of texts to their own centroid. Both in closed form for texts of unit length, linear in
    them: a speaker's n texts have inner products with the centroid that sum to n times its squared norm, and the sum of centroids of unit length has a squared norm that holds all pairs."""
    by = [session, speaker]
    v = written(vectors.where(F.col(session).isNotNull() & F.col(speaker).isNotNull()).select(*by, doc, "term", "weight"), "weights")
    n = v.select(*by, doc).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    c = written(v.groupBy(*by, "term").agg(F.sum("weight").alias("_s")), "centroids")
    norm = c.groupBy(*by).agg(F.sqrt(F.sum(F.col("_s") * F.col("_s"))).alias("_norm"))
    sums = c.join(norm.hint("merge"), by).groupBy(session, "term").agg(F.sum(F.col("_s") / F.col("_norm")).alias("_u")).groupBy(session).agg(F.sum(F.col("_u") * F.col("_u")).alias("_q"))
    g = n.join(norm.hint("merge"), by).groupBy(session).agg(F.count(F.lit(1)).alias("_k"), F.sum("_n").alias("_n"), F.sum("_norm").alias("_w")).where("_k > 1").join(sums.hint("merge"), session)
    return g.select(session, r6(1 - F.col("_w") / F.col("_n")).alias("within"), r6(1 - (F.col("_q") - F.col("_k")) / (F.col("_k") * (F.col("_k") - 1))).alias("between"))


def recurring_ngrams(rows: DataFrame, n: int = 4, least: int = 4, top: int = 25) -> DataFrame:
    """The `top` most frequent n-grams of at least `least` occurrences. Hashes are counted first, so that only these move; an n-gram is at most as frequent
    as its hash. N-grams of the most frequent hashes are then counted themselves: from the last place's hash up, and
    further down where hashes that clash leave places free."""
    t = rows.select(tokens("text", "[a-z]+").alias("t")).where(F.size("t") >= n)
    g = t.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("t") - n), lambda i: F.array_join(F.slice("t", i + 1, n), " "))).alias("ngram"))
    hashed = written(g.groupBy(_hash("ngram").alias("h")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least), "hashes")
    most = [r.n for r in hashed.orderBy(F.desc("n")).limit(top).select("n").collect()]
    bound = most[-1] if len(most) == top else least
    while (often := hashed.where(F.col("n") >= bound).select("h")).limit(FEW + 1).count() <= FEW:
        part = g.withColumn("h", _hash("ngram")).join(F.broadcast(often), "h", "left_semi")
        found = written(part.groupBy("ngram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= bound).orderBy(F.desc("n"), "ngram").limit(top), "often")
        if bound == least or found.count() == top:
            return found.orderBy(F.desc("n"), "ngram")
        bound = max(least, bound // 2)
    return g.groupBy("ngram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "ngram").limit(top)


def _hash(c: str) -> Column:
    return F.xxhash64(c)
