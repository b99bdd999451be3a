"""Marker lexicons and pattern families scored per turn and rolled up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.text import r6, ratio


def clause_markers(turns: DataFrame, lexicon: DataFrame, opening: int = 2) -> DataFrame:
    """At most one marker a clause (the first in lexicon order that starts it); divergence and alignment counts in the opening clauses
    and the whole turn, and the opening's label. lexicon: marker, kind, ord."""
    c = turns.select("session_id", "turn_index", F.posexplode(tx.clauses("text")).alias("k", "clause"))
    # markers and clauses meet on as many first characters as every marker has
    least = lexicon.where("marker != ''").agg(F.min(F.char_length("marker"))).first()[0] or 1
    keyed = tx.listed(lexicon.where("marker != ''").withColumn("_key", F.left("marker", F.lit(least))))
    hit = F.coalesce(F.startswith("clause", "marker"), F.lit(False))
    found = c.withColumn("_key", F.left("clause", F.lit(least))).join(keyed, "_key", "left").groupBy("session_id", "turn_index", "k").agg(F.min_by("kind", F.when(hit, F.col("ord"))).alias("kind"))
    n = lambda kind, test: F.count_if(F.coalesce((F.col("kind") == kind) & test, F.lit(False)))
    early, any_ = F.col("k") < opening, F.lit(True)
    got = found.groupBy("session_id", "turn_index").agg(
        F.count(F.lit(1)).alias("clauses"), n("divergence", early).alias("d1_div"), n("alignment", early).alias("d1_align"), n("divergence", any_).alias("div_full"), n("alignment", any_).alias("align_full")
    )
    d, a = F.col("d1_div") > 0, F.col("d1_align") > 0
    return got.withColumn("label", F.when(d & a, "mixed").when(d, "divergence").when(a, "alignment").otherwise("none"))


def style_rates(turns: DataFrame, families: dict[str, str]) -> DataFrame:
    """Per speaker: type-token ratio, sentence length (mean and population variance) and each family's hits per 100 words; rates are NULL without words."""
    t = tx.tokens("text", "[a-z]+")
    df = turns.select("session_id", "speaker_id", "n_words", t.alias("t"), F.size(tx.sentences("text")).alias("ns"), F.aggregate(tx.sentences("text"), F.lit(0), lambda s, x: s + tx.n_words(x) * tx.n_words(x)).alias("_w2"), F.aggregate(tx.sentences("text"), F.lit(0), lambda s, x: s + tx.n_words(x)).alias("_w1"), *(tx.hits(F.lower("text"), p).alias(k) for k, p in families.items()))
    g = df.groupBy("session_id", "speaker_id").agg(
        F.sum("n_words").alias("words"), F.size(F.array_distinct(F.flatten(F.collect_list("t")))).alias("_types"), F.sum(F.size("t")).alias("_tokens"), F.sum("ns").alias("_ns"), F.sum("_w1").alias("_w1"), F.sum("_w2").alias("_w2"), *(F.sum(k).alias(k) for k in families)
    )
    return g.select("session_id", "speaker_id", "words", r6(ratio("_types", "_tokens")).alias("ttr"), r6(ratio("words", "_ns")).alias("sentence_words"), r6(ratio("_w2", "_ns") - F.pow(ratio("_w1", "_ns"), F.lit(2))).alias("sentence_variance"), *(r6(100 * ratio(k, "words")).alias(k) for k in families))


def style_ranges(rates: DataFrame, families: list[str]) -> DataFrame:
    return rates.groupBy("session_id").agg(*(r6(F.max(k) - F.min(k)).alias(f"{k}_range") for k in families))


def topic_terms(turns: DataFrame, concrete: list[str], abstract: list[str], flag_over: int = 5) -> DataFrame:
    """Turns with topic terms, turns with abstract terms only, and a flag above a number of these."""
    low = F.lower("text")
    hit = lambda terms: F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(low, t))
    g = turns.select("session_id", hit(concrete).alias("c"), hit(abstract).alias("a")).groupBy("session_id").agg(F.count_if("c").alias("topic_turns"), F.count_if(F.col("a") & ~F.col("c")).alias("abstract_only"))
    return g.withColumn("flagged", F.col("abstract_only") > flag_over)


def pattern_counts(turns: DataFrame, patterns: dict[str, str]) -> DataFrame:
    return turns.groupBy("session_id").agg(*(F.sum(tx.hits("text", p)).alias(k) for k, p in patterns.items()))


def phrase_hits(turns: DataFrame, phrases: list[str]) -> DataFrame:
    """Moderator entries with any phrase, total hits, the share of entries with one, and hits an entry."""
    n = sum((tx.occurrences(F.lower("text"), p) for p in phrases), F.lit(0))
    g = turns.where("role = 'moderator'").withColumn("_n", n).groupBy("session_id").agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("_n") > 0).alias("with_hits"), F.sum("_n").alias("hits"))
    return g.withColumns({"rate": r6(ratio("with_hits", "entries")), "per_entry": r6(ratio("hits", "entries"))})


#: Quantities with their units, expressions of time, capitalised words inside sentences, and the capitalised words that name nothing.
NUMBER = r"(?i)(?<![A-Za-z])(?:£|\$|€)?[0-9]+(?:[.,][0-9]+)?\s?(?:%|p|k|quid|pounds?|mins?|minutes?|hours?|years?|stone|kg|lbs?|ml|l)?(?![A-Za-z])"
TEMPORAL = (
    r"(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday|january|february|march|april|may|june|july|august|september|october|november|december|yesterday|today|tonight|tomorrow"
    r"|last\s+(?:night|week|month|year|time|summer|winter)|this\s+(?:morning|afternoon|evening|week|month|year)|next\s+(?:week|month|year)"
    r"|(?:every|each)\s+(?:day|week|weekend|morning|night|friday|saturday|sunday)|[0-9]+\s*(?:years?|months?|weeks?|days?)\s+ago|o'?clock|midday|midnight|lunchtime|teatime|weekend)"
)
NO_ENTITY = (
    "The And But Yeah Well That This There They Then When What With You Your For Not Its It's Like Just Because Actually Maybe Probably Honestly Sometimes Also Even Still Nah Yes No Okay Right "
    "One Some Most All Every Something Someone Anything Anyone Everything Everyone Nothing Nobody Mean Think Know Get Got Say Said Sort Kind Bit Thing Things People Blokes Lads Mate Mates Guys Men "
    "Food Pub Home Work Life Time Day Days Week Suppose Guess Wonder Take Point Fair Whereas Whether Which Where While Who Whose How Why Any Both"
).split()
_WORD = r"[\p{L}\p{N}_]"
ENTITY = rf"(?<![.!?]\s)(?<!\A)(?<!{_WORD})([A-Z][a-z]{{2,}})(?!{_WORD})"


def anchors(turns: DataFrame, roster: DataFrame, first_words: int = 40) -> DataFrame:
    """Specificity anchors: quantities, expressions of time and capitalised words that don't begin a sentence, but for words that name nothing and the first names of the
    session's roster (session_id, name), in the whole turn and in its first words."""
    own = roster.groupBy("session_id").agg(F.collect_set(F.lower(F.get(tx.words("name"), F.lit(0)))).alias("_own"))
    df = turns.join(own.hint("merge"), "session_id", "left").withColumns({"_own": F.coalesce("_own", F.array().cast("array<string>")), "_part": tx.word_slice("text", 1, first_words)})
    no = F.array(*map(F.lit, NO_ENTITY))
    others = lambda t: F.size(F.filter(F.regexp_extract_all(t, F.lit(ENTITY), F.lit(1)), lambda x: ~F.array_contains(no, x) & ~F.array_contains("_own", F.lower(x))))
    kinds = {"numbers": lambda t: tx.hits(t, NUMBER), "times": lambda t: tx.hits(F.lower(t), rf"(?<!{_WORD}){TEMPORAL}(?!{_WORD})"), "names": others}
    df = df.select("session_id", "turn_index", *(f(F.col("text")).alias(k) for k, f in kinds.items()), *(f(F.col("_part")).alias(f"{k}_first") for k, f in kinds.items()))
    return df.withColumns({f"anchors{part}": F.col(f"numbers{part}") + F.col(f"times{part}") + F.col(f"names{part}") for part in ("", "_first")})


def entity_density(entities: DataFrame, sizes: DataFrame, stop: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Entities without the stop list, classed by the gazetteer, per 100 words of the unit."""
    kept = entities.join(tx.listed(stop), "entity", "left_anti").join(tx.listed(gazetteer), "entity", "left").withColumn("kind", F.coalesce("kind", F.lit("other")))
    n = kept.groupBy("unit", "kind").agg(F.count(F.lit(1)).alias("n"))
    return n.join(sizes.hint("merge"), "unit").select("unit", "kind", "n", r6(100 * ratio("n", "words")).alias("density"))


EXACT = {
    "percent": r"[0-9]+([.,][0-9]+)?%", "date_time": r"[0-9]{1,2}:[0-9]{2}|[0-9]{4}-[0-9]{2}-[0-9]{2}", "statistic": r"[0-9]+ (out of|of|/) [0-9]+",
    "quantity": r"[$][0-9]+|[0-9]+ ?(kg|km|eur|usd)", "frequency": r"[0-9]+ times|every [0-9]+", "precise": r"exactly|precisely|approximately",
}


def exactness(turns: DataFrame) -> DataFrame:
    """Turns in which an exactness detector fires: the detectors, the matched strings, and a stable id."""
    got = {k: F.regexp_extract_all(F.lower("text"), F.lit(p), F.lit(0)) for k, p in EXACT.items()}
    fired = F.array_compact(F.array(*(F.when(F.size(m) > 0, k) for k, m in got.items())))
    ident = F.upper(F.substring(F.sha2(F.concat_ws("|", "session_id", F.col("turn_index").cast("string")), 256), 1, 16))
    return turns.select("session_id", "turn_index", ident.alias("candidate_id"), fired.alias("detectors"), F.size(F.flatten(F.array(*got.values()))).alias("matches")).where(F.size("detectors") > 0)


def numeral_rate(turns: DataFrame) -> DataFrame:
    g = turns.where("role = 'participant'").groupBy("session_id").agg(F.sum(tx.hits("text", "[0-9]+")).alias("_n"), F.sum("n_words").alias("_w"))
    return g.select("session_id", r6(1000 * ratio("_n", "_w")).alias("per_1000"))


def term_rates(turns: DataFrame, terms: DataFrame) -> DataFrame:
    """Whole-word hits of a term list per 100 words, by term."""
    t = turns.select("session_id", F.explode(tx.tokens("text", "[a-z]+")).alias("term")).groupBy("session_id", "term").agg(F.count(F.lit(1)).alias("n"))
    words = turns.groupBy("session_id").agg(F.sum("n_words").alias("words"))
    return t.join(tx.listed(terms), "term").join(words.hint("merge"), "session_id").select("session_id", "term", "n", r6(100 * ratio("n", "words")).alias("rate"))


def reference_density(turns: DataFrame, roster: DataFrame) -> DataFrame:
    """Share of participant turns that name another member of the session's roster (by token); names of two members don't count, `ambiguous` says how many there are."""
    clear = roster.groupBy("session_id", "name").agg(F.min("speaker_id").alias("_who"), F.countDistinct("speaker_id").alias("_n")).where("_n = 1")
    t = turns.where("role = 'participant'").select("session_id", "turn_index", "speaker_id", F.explode_outer(F.array_distinct(tx.tokens("text", "[a-z]+"))).alias("name"))
    hit = t.join(clear.hint("merge"), ["session_id", "name"], "left").withColumn("_h", F.coalesce(F.col("_who") != F.col("speaker_id"), F.lit(False)))
    per = hit.groupBy("session_id", "turn_index").agg(F.bool_or("_h").alias("h"))
    shared = roster.where("name <> ''").groupBy("session_id", "name").agg(F.countDistinct("speaker_id").alias("_n")).where("_n > 1").groupBy("session_id").agg(F.count(F.lit(1)).alias("_k"))
    g = per.groupBy("session_id").agg(F.count(F.lit(1)).alias("turns"), r6(F.avg(F.col("h").cast("double"))).alias("density"))
    return g.join(shared.hint("merge"), "session_id", "left").select("session_id", "turns", "density", F.coalesce("_k", F.lit(0)).alias("ambiguous"))


def label_density(turns: DataFrame, members: DataFrame, ambiguous: list[str]) -> DataFrame:
    """Share of participant turns that name another member by the first word of their name, with words of letters only (`density`) and with words that may be labels such as mf_p2 or p1.1 (`label_density`); names under
    three characters and those that are ordinary words don't count. `unrepresentable` names can't occur among words of letters, `collapsed` names share their first word: either makes the plain figure invalid.
    members: session_id, speaker_id, name."""
    first = F.lower(F.get(tx.words("name"), F.lit(0)))
    clean = lambda c: F.transform(c, lambda x: F.when(F.endswith(x, F.lit("'s")), F.left(x, F.char_length(x) - 2)).otherwise(F.regexp_replace(x, r"\.+$", "")))
    m = members.select("session_id", "speaker_id", "name", first.alias("first")).where(F.char_length("first") >= 3).distinct().withColumn("_common", F.col("first").isin(ambiguous))
    facts = m.groupBy("session_id").agg(
        F.count_if("_common").alias("excluded"), F.count_if(~F.col("_common") & ~F.col("first").rlike("^[a-z]+('[a-z]+)?$")).alias("unrepresentable"),
        (F.count_distinct(F.when(~F.col("_common"), F.col("first"))) < F.count_if(~F.col("_common"))).alias("collapsed"), F.collect_set(F.when(~F.col("_common"), F.struct("speaker_id", "first"))).alias("_m"),
    )
    t = turns.where("role = 'participant'").select("session_id", "speaker_id", *(clean(tx.tokens("text", p)).alias(k) for k, p in (("_plain", "[a-z]+(?:'[a-z]+)?"), ("_label", r"[a-z][a-z0-9_.']*"))))
    t = t.join(facts.hint("merge"), "session_id")
    hit = lambda k: F.exists("_m", lambda x: (x["speaker_id"] != F.col("speaker_id")) & F.array_contains(k, x["first"])).cast("double")
    g = t.groupBy("session_id").agg(F.count(F.lit(1)).alias("turns"), r6(F.avg(hit("_plain"))).alias("density"), r6(F.avg(hit("_label"))).alias("label_density"), *(F.first(k).alias(k) for k in ("excluded", "unrepresentable", "collapsed")))
    return g.withColumn("valid", (F.col("unrepresentable") == 0) & ~F.col("collapsed"))


def keyword_rate(turns: DataFrame, keywords: list[str]) -> DataFrame:
    any_ = F.exists(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.lower("text"), k))
    return turns.where("role = 'participant'").groupBy("session_id").agg(r6(F.avg(any_.cast("double"))).alias("rate"))


POLARITY = {"negated": "not no never nicht kein pas sin".split(), "frequent": "always often immer oft toujours siempre".split(), "change": "now anymore then jetzt mais pero".split()}


def polarity_contrast(turns: DataFrame) -> DataFrame:
    """Flags of each turn and its predecessor by the same speaker; a contrast if negation or frequency differ."""
    f = turns.select("session_id", "speaker_id", "turn_index", *(F.lower("text").rlike(tx.any_of(p)).alias(k) for k, p in POLARITY.items()))
    w = W.partitionBy("session_id", "speaker_id").orderBy("turn_index")
    f = f.withColumns({f"prev_{k}": F.lag(k).over(w) for k in ("negated", "frequent")})
    return f.select("session_id", "turn_index", *POLARITY, ((F.col("negated") != F.col("prev_negated")) | (F.col("frequent") != F.col("prev_frequent"))).alias("contrast"))


def residue(turns: DataFrame, distinctive: list[str], least: int = 2) -> DataFrame:
    """Classes of content that should not be left in a span: digits, web addresses, brackets, a cluster of distinctive tokens."""
    cluster = F.size(F.array_intersect(tx.tokens("text", "[a-z]+"), F.array(*map(F.lit, distinctive)))) >= least
    tests = {"digits": F.col("text").rlike("[0-9]{4}"), "url": F.col("text").rlike("https?://|www[.]"), "bracket": F.col("text").rlike(r"[\[\]{}]"), "cluster": cluster}
    classes = F.array_compact(F.array(*(F.when(t, k) for k, t in tests.items())))
    return turns.select("session_id", "turn_index", classes.alias("classes")).where(F.size("classes") > 0)


def log_markers(lines: DataFrame, by: str, markers: list[str]) -> DataFrame:
    """Occurrences of literal markers in each run's log text, and whether the run lost a cycle (the first marker fires)."""
    cols = [F.sum(tx.occurrences("text", m)).alias(f"m{k}") for k, m in enumerate(markers)]
    return lines.groupBy(by).agg(*cols).withColumn("lost", F.col("m0") > 0)


def stage_directions(turns: DataFrame, keep: int = 5) -> DataFrame:
    """Turns with *...* or [...] directions: count per session, the first few as evidence."""
    t = turns.where(F.col("text").rlike(r"[*][^*]+[*]|\[[^\]]+\]"))
    w = W.partitionBy("session_id").orderBy("turn_index")
    t = t.withColumns({"rank": F.row_number().over(w), "total": F.count(F.lit(1)).over(W.partitionBy("session_id"))})
    return t.where(F.col("rank") <= keep).select("session_id", "turn_index", "rank", "total")
