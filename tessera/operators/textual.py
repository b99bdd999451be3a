"""Projections over turn texts: cleaning, splitting, windows, flattening."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from .literals import literal_hits, terms_of


def non_empty(turns: DataFrame) -> DataFrame:
    return turns.where(F.trim(F.coalesce("text", F.lit(""))) != "")


def blind_labels(turns: DataFrame) -> DataFrame:
    """Speakers as `Participant k` by first appearance, turns as T001... in order; moderators keep their role."""
    first = turns.where("role = 'participant'").groupBy("session_id", "speaker_id").agg(F.min("turn_index").alias("_f"))
    k = first.select("session_id", "speaker_id", F.row_number().over(W.partitionBy("session_id").orderBy("_f", "speaker_id")).alias("_k"))
    label = F.row_number().over(W.partitionBy("session_id").orderBy("turn_index")).cast("string")
    turn = F.concat(F.lit("T"), F.when(F.char_length(label) < 3, F.lpad(label, 3, "0")).otherwise(label))
    df = turns.join(k, ["session_id", "speaker_id"], "left")
    who = F.when(F.col("role") == "moderator", "Moderator").otherwise(F.concat(F.lit("Participant "), F.col("_k").cast("string")))
    return df.select("session_id", "turn_index", turn.alias("label"), who.alias("who"))


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: unicodedata.normalize("NFKC", x).casefold(), na_action="ignore")


def match_key(c: Column | str, compatibility: bool = True) -> Column:
    """The form in which quotes are compared; compatibility forms (NFKC) have no SQL built-in and take one vectorised function."""
    plain = tx.normalised(c)
    return nfkc(plain) if compatibility else plain


def roster_scrub(turns: DataFrame, roster: DataFrame, placeholder: str = "[NAME]") -> DataFrame:
    """Folded text (lower case, no accents, single spaces) in which each word of the session's roster names, of three letters or more, is replaced, with
    the number of hits. Only a letter or digit of the Latin alphabet next to a name keeps it, so `David,` and `David's` are found, and neighbours both."""
    part = roster.select("session_id", F.explode(F.split(tx.folded("name"), " ")).alias("_n")).where(F.col("_n").rlike(r"^\p{L}{3,}$"))
    names = part.groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_set("_n")), "|").alias("_n"))
    pattern = F.concat(F.lit("(?<![a-z0-9])(?:"), F.col("_n"), F.lit(")(?![a-z0-9])"))
    df = turns.join(names.hint("merge"), "session_id", "left").withColumns({"_p": F.coalesce(pattern, F.lit("$^")), "_t": tx.folded("text")})
    return df.withColumns({"scrubbed": F.expr(f"trim(regexp_replace(_t, _p, '{placeholder}'))"), "hits": F.expr("regexp_count(_t, _p)")}).drop("_n", "_p", "_t")


def leakage(texts: DataFrame, forbidden: DataFrame) -> DataFrame:
    """(token, texts, hits): in how many texts each forbidden token still stands, and how often; tokens that stand nowhere have zeros."""
    found = literal_hits(texts, [], "text", terms_of(forbidden, "token")).groupBy("term").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("hits"))
    tokens = forbidden.select("token").where("token != ''").distinct()
    return tokens.join(found.hint("merge"), F.col("token") == F.col("term"), "left").select("token", F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("hits", F.lit(0)).alias("hits"))


def sentence_rows(turns: DataFrame, by_capital: bool = False) -> DataFrame:
    cut = tx.sentences_by_capital if by_capital else tx.sentences
    return turns.select("session_id", "turn_index", F.posexplode(cut("text")).alias("sentence_index", "sentence"))


def clause_rows(turns: DataFrame) -> DataFrame:
    return turns.select("session_id", "turn_index", F.posexplode(tx.clauses("text")).alias("clause_index", "clause"))


def truncated(c: Column | str, n: int) -> Column:
    return tx.word_slice(c, 1, n)


def centred(c: Column | str, budget: int) -> Column:
    """The middle `budget` words; NULL if the text has fewer."""
    n = tx.n_words(c)
    start = F.greatest(F.floor((n - budget) / 2).cast("int") + 1, F.lit(1))
    return F.when(n >= budget, tx.word_slice(c, start, budget))


#: Sentences of context on each side of an excerpt.
CONTEXT = 2


def excerpts(turns: DataFrame, budget: int) -> DataFrame:
    """Adds `excerpt`, excerpt_words, context, reduced, literal, excerpt_sha256 and text_sha256.

    A text within the budget of words, or of one sentence, stands whole. Of others whole sentences are taken: the middle one, then by steps the shorter of
    its neighbours (the earlier of equal ones), until the budget is reached. `context` is up to two sentences on each side; `literal` says whether the
    excerpt stands in the text as it is (line feeds between sentences become spaces). Null texts have a null excerpt.
    """
    df = turns.withColumn("_s", tx.sentences("text")).withColumn("_n", F.transform("_s", lambda x: F.size(F.split(x, r"\s+"))))
    df = df.withColumn("_m", F.floor(F.size("_s") / 2).cast("int"))

    def grow(acc: Column, _: Column) -> Column:
        before, after = F.get("_n", acc["lo"] - 1), F.get("_n", acc["hi"] + 1)
        back, more = F.coalesce(before <= after, before.isNotNull()), acc["n"] < budget
        down, up = more & back, more & ~back & after.isNotNull()
        return F.struct((acc["lo"] - down.cast("int")).alias("lo"), (acc["hi"] + up.cast("int")).alias("hi"), (acc["n"] + F.when(down, before).when(up, after).otherwise(0)).alias("n"))

    start = F.struct(F.col("_m").alias("lo"), F.col("_m").alias("hi"), F.coalesce(F.get("_n", F.col("_m")), F.lit(0)).alias("n"))
    df = df.withColumn("_x", F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_s"))), start, grow))
    df = df.withColumn("reduced", (tx.n_words("text") > budget) & (F.size("_s") > 1))
    piece = lambda lo, hi: F.slice("_s", lo + 1, F.greatest(hi - lo + 1, F.lit(0)))
    lo, hi = F.col("_x.lo"), F.col("_x.hi")
    around = F.concat(piece(F.greatest(lo - CONTEXT, F.lit(0)), lo - 1), piece(hi + 1, hi + CONTEXT))
    df = df.withColumns({"excerpt": F.when(F.col("reduced"), F.array_join(piece(lo, hi), " ")).otherwise(F.col("text")), "context": F.when(F.col("reduced"), F.array_join(around, " ")).otherwise("")})
    df = df.withColumns({"excerpt_words": tx.n_words("excerpt"), "literal": F.contains("text", F.col("excerpt")), "excerpt_sha256": F.sha2("excerpt", 256), "text_sha256": F.sha2("text", 256)})
    return df.drop("_s", "_n", "_m", "_x")


def flattened(payload: Column | str, depth: int = 8) -> Column:
    """Entries (path, value) of a JSON object: keys of nested objects joined by dots, lists as `<list len=n>`, null as NULL. Objects nested deeper than
    `depth` stay JSON text; empty ones, and what is no object or no JSON, have no entry."""
    entries = F.array(F.struct(F.lit("").alias("path"), F.try_parse_json(payload).alias("v")))

    def open_(e: Column) -> Column:
        inner = F.try_variant_get(e["v"], "$", "map<string,variant>")
        prefix = F.when(e["path"] == "", F.lit("")).otherwise(F.concat(e["path"], F.lit(".")))
        below = F.transform(F.map_entries(inner), lambda m: F.struct(F.concat(prefix, m["key"]).alias("path"), m["value"].alias("v")))
        return F.when(inner.isNull(), F.array(e)).otherwise(below)

    for _ in range(depth):
        entries = F.flatten(F.transform(entries, open_))
    n = lambda e: F.size(F.try_variant_get(e["v"], "$", "array<variant>"))
    value = lambda e: F.when(F.try_variant_get(e["v"], "$", "array<variant>").isNotNull(), F.concat(F.lit("<list len="), n(e).cast("string"), F.lit(">"))).otherwise(F.try_variant_get(e["v"], "$", "string"))
    return F.transform(F.filter(entries, lambda e: e["path"] != ""), lambda e: F.struct(e["path"].alias("path"), value(e).alias("value")))


def payload_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """JSON payloads by key: dotted paths only in a, only in b, or with other values."""
    flat = lambda df, v: df.select(key, F.inline(flattened("payload"))).select(key, "path", F.col("value").alias(v), F.lit(True).alias(f"_{v}"))
    j = flat(a, "va").join(flat(b, "vb").hint("merge"), [key, "path"], "full")
    state = F.when(F.col("_vb").isNull(), "only_a").when(F.col("_va").isNull(), "only_b").when(~F.col("va").eqNullSafe(F.col("vb")), "differs").otherwise("same")
    return j.withColumn("state", state).drop("_va", "_vb")


def strip_boilerplate(turns: DataFrame, phrases: list[str]) -> DataFrame:
    """Template phrases deleted from the text, and which were found (sorted, distinct)."""
    p = "|".join(phrases)
    return turns.select("session_id", "turn_index", F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(f"({p})"), F.lit(1)))).alias("removed"), F.char_length(F.regexp_replace("text", p, "")).alias("kept_chars"))


def turn_third(turns: DataFrame) -> DataFrame:
    """early, middle or final by a turn's place in its session."""
    w = W.partitionBy("session_id")
    n, total = F.row_number().over(w.orderBy("turn_index")), F.count(F.lit(1)).over(w)
    third = F.when(n * 3 <= total, "early").when(n * 3 <= 2 * total, "middle").otherwise("final")
    return turns.select("session_id", "turn_index", third.alias("third"))
