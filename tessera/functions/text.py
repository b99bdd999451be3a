"""Column builders over text: words, tokens, counts and ratios in which undefined is NULL, never 0."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def words(c: Column | str) -> Column:
    """Words parted by white space; none for null or blank text."""
    return F.filter(F.split(F.coalesce(_col(c), F.lit("")), r"\s+"), lambda x: x != "")


def n_words(c: Column | str) -> Column:
    return F.size(words(c))


def tokens(c: Column | str, pattern: str = "[a-z']+", min_len: int = 1) -> Column:
    """Lower-cased matches of a token pattern of at least min_len characters."""
    found = F.regexp_extract_all(F.lower(_col(c)), F.lit(pattern), F.lit(0))
    return found if min_len <= 1 else F.filter(found, lambda x: F.char_length(x) >= min_len)


def hits(c: Column | str, pattern: str) -> Column:
    return F.regexp_count(_col(c), F.lit(pattern))


def occurrences(c: Column | str, phrase: str) -> Column:
    """Non-overlapping occurrences of a literal phrase."""
    c = _col(c)
    return ((F.char_length(c) - F.char_length(F.replace(c, F.lit(phrase), F.lit("")))) / F.lit(len(phrase))).cast("int")


def any_of(words_: list[str]) -> str:
    """A pattern of whole words of lower-cased text. What stands around a word is looked at, not consumed, so neighbours count each."""
    return r"(?<!\p{L})(?:" + "|".join(words_) + r")(?!\p{L})"


def _accents() -> tuple[str, str]:
    """Precomposed Latin letters and their base letters, from the Unicode decompositions."""
    plain = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(c))) > 1}
    return "".join(plain), "".join(plain.values())


ACCENTS = _accents()


def folded(c: Column | str) -> Column:
    """Lower case, accents off, white space as single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.translate(_col(c), *ACCENTS)), r"\s+", " "))


def listed(df: DataFrame, most: int = 10_000) -> DataFrame:
    """A caller's list (lexicon, terms, rates) hinted for broadcast after its rows have been counted; a longer one is refused."""
    if (n := df.limit(most + 1).count()) > most:
        raise ValueError(f"a list of more than {most} rows ({n})")
    return df.hint("broadcast")


def with_each(df: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """Every row with every distinct value of a small dimension (a codebook, a list of groups): the values come as one row, whatever their statistics, and are exploded."""
    one = values.agg(F.array_sort(F.collect_set(name)).alias("_all"))
    return df.crossJoin(F.broadcast(one)).withColumn(name, F.explode("_all")).drop("_all")


def ratio(n: Column | str, d: Column | str) -> Column:
    """n / d; NULL where d is 0 or either is NULL."""
    return F.try_divide(_col(n).cast("double"), _col(d).cast("double"))


def f1(recall: Column | str, precision: Column | str) -> Column:
    """Harmonic mean; 0 when both are measured as 0, NULL when either is undefined."""
    r, p = _col(recall), _col(precision)
    return F.when(r + p == 0, F.lit(0.0)).otherwise(ratio(2 * r * p, r + p))


def r6(c: Column | str) -> Column:
    return F.round(_col(c).cast("double"), 6)


def sentences(c: Column | str) -> Column:
    """Sentences: cut after . ! ? before white space, and at line feeds; blanks dropped, ends trimmed."""
    cut = F.split(F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"([.!?])\s+", "$1\n"), "\n")
    return F.filter(F.transform(cut, lambda x: F.trim(x)), lambda x: x != "")


def sentences_by_capital(c: Column | str) -> Column:
    """Sentences by the stricter rule: cut after . ! ? only before a capital or an opening quote, and at line feeds."""
    cut = F.split(F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"([.!?])\s+(?=[A-Z\"'‘“])", "$1\n"), "\n")
    return F.filter(F.transform(cut, lambda x: F.trim(x)), lambda x: x != "")


def clauses(c: Column | str) -> Column:
    """Clauses of lower-cased text, cut at punctuation and at joining words."""
    cut = F.split(F.lower(F.coalesce(_col(c), F.lit(""))), r"[.,;:!?\n]+|\s(?:and|but|so|because|although|though)\s")
    return F.filter(F.transform(cut, lambda x: F.trim(x)), lambda x: x != "")


def word_slice(c: Column | str, start: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(words(c), start, n), " ")


def normalised(c: Column | str) -> Column:
    """For matching quotes: straight quotes and dashes, one space, lower case, no punctuation at the ends."""
    plain = F.translate(_col(c), "‘’“”–— ", "''\"\"-- ")
    plain = F.lower(F.trim(F.regexp_replace(F.replace(plain, F.lit("…"), F.lit("...")), r"\s+", " ")))
    return F.regexp_replace(plain, "^[.,;:!?\"' -]+|[.,;:!?\"' -]+$", "")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
