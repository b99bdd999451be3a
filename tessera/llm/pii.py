"""Personal data by weak supervision, in DataFrame and SQL functions only.

Base spans come from four patterns (e-mail, IP, card, phone), leftmost and not overlapping within a kind. Places come from the lengths of what lies
between matches, so no Python touches a text. Further candidates are digit groups and long mixed tokens that no base span
overlaps. Labelers vote on each candidate (1 personal, -1 not, 0 abstain): shapes by pattern, cue words by gazetteer, and the
surroundings. Expectation-maximisation on the table of vote patterns estimates the labelers' reliabilities; a logistic span
classifier is trained on its posteriors over the table of span features, and decides which candidates become spans. Both tables
are bounded by the numbers of votes and features, not by the corpus.

Patterns are written so that Java's matcher neither recurses nor retries: possessive repeats, and starts only at the edge of a
run or right after the match before.

Defined results: null and empty texts have no spans; ends are exclusive, places count code points; rows that repeat a doc_id
are searched as rows, and `redact` finds each by doc_id and a hash of its text; texts of any length are searched whole; base spans always stay; an empty table gives no rows; extra columns pass through `redact`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written
from .weak import expectation_maximisation, log_ratios, posterior

#: Parameters of the method's candidates (base spans have no such bounds): a mixed token is one if a digit stands after at most LEAD letters, a group of digits holds at
#: most GROUP_DIGITS of them, labelers see CONTEXT characters before a candidate, and a base span within NEAR characters is company.
LEAD, GROUP_DIGITS, CONTEXT, NEAR = 40, 24, 40, 200
KINDS = ["email", "ip", "card", "phone", "secret", "local_phone", "number"]
BASE = 4
#: kind: (pattern, what a text must hold for it). A start may only lie at the edge of a run or at the end of the last match.
PATTERNS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "instr(t, '@') > 0"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "digits and instr(t, '.') > 0"),
    "card": (r"[0-9](?:[\x20-]?[0-9]){11,}+", "digits"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "digits and instr(t, '+') > 0"),
    "other": (rf"(?<![0-9A-Za-z+])(?:\(?[0-9](?:[\x20().-]{{0,2}}[0-9]){{6,{GROUP_DIGITS - 1}}}+(?![0-9A-Za-z])|(?=[A-Za-z]{{0,{LEAD}}}[0-9])[A-Za-z0-9]{{16,}}+)", "digits"),
}
#: Words that announce personal data or credentials.
CUES = "tel phone telefon teléfono mobile fax call token key apikey secret password passwd pwd passwort clave card karte carte tarjeta visa account konto compte cuenta iban ssn passport id".split()
LABELERS = {
    "shape_phone": r"case when hit rlike '^\\(?[0-9]{3}\\)?[ .-][0-9]{3}[ .-][0-9]{4}$' then 1 else 0 end",
    "shape_secret": r"case when hit rlike '^(?=[a-z]*[0-9])(?=[0-9]*[a-z])[0-9a-f]{24,}$' or hit rlike '^(?=.*[A-Z])(?=.*[a-z])(?=.*[0-9])[A-Za-z0-9]{20,}$' then 1 else 0 end",
    "shape_plain": r"case when hit rlike '^[0-9]{1,11}$' or hit rlike '^[0-9]{1,3}([.][0-9]{3})+$' or hit rlike '^[0-9]{4}-[0-9]{2}-[0-9]{2}$' then -1 else 0 end",
    "cue": "case when cue then 1 else 0 end",
    "assigned": r"case when before rlike '[=:]\\s*[\"\']?$' then 1 when before rlike '[a-z,]\\s$' then -1 else 0 end",
    "company": "case when near then 1 else 0 end",
}
FEATURES = {
    "letters": "hit rlike '[A-Za-z]'", "separators": "hit rlike '[ ().-]'", "long": "char_length(hit) >= 24", "card_length": "n_digits between 12 and 19", "phone_length": "n_digits between 9 and 11",
    "cue": "cue", "assigned": r"before rlike '[=:]\\s*[\"\']?$'", "near": "near",
}


def _sql_text(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def _matches(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, th, found): every match of every pattern in order, with the length of the gap before it and its surroundings; th is a hash of the text."""
    df = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.xxhash64("text").alias("th"), F.coalesce("text", F.lit("")).alias("t")).withColumn("digits", F.expr("t rlike '[0-9]'"))
    for k, (pattern, where) in PATTERNS.items():
        p = _sql_text(pattern)
        df = df.withColumn(f"h_{k}", F.expr(f"case when {where} then regexp_extract_all(t, '{p}', 0) else array() end"))
        df = df.withColumn(f"g_{k}", F.expr(f"case when size(h_{k}) > 0 then split(t, '{p}', -1) else array() end"))
    part = lambda n, k: f"transform(h_{k}, (h, i) -> named_struct('kind', {n}, 'i', i, 'gap', char_length(get(g_{k}, i)), 'hit', h, 'before', lower(right(get(g_{k}, i), {CONTEXT}))))"
    return df.select("rid", "doc_id", "th", F.expr("concat(" + ", ".join(part(n, k) for n, k in enumerate(PATTERNS)) + ")").alias("found"))


def _luhn(digits: str) -> str:
    value = f"cast(substring({digits}, char_length({digits}) - i, 1) as int)"
    return f"aggregate(sequence(0, char_length({digits}) - 1), 0, (s, i) -> s + case when i % 2 = 0 then {value} when {value} > 4 then 2 * {value} - 9 else 2 * {value} end) % 10 = 0"


def _placed(found: DataFrame) -> DataFrame:
    """Matches with s, e and `ok`: valid as base spans; other candidates have kind BASE."""
    w = W.partitionBy("rid", "kind").orderBy("i")
    size = F.char_length("hit")
    df = found.select("rid", F.explode("found").alias("m")).select("rid", "m.*")
    df = df.withColumn("s", F.sum("gap").over(w.rowsBetween(W.unboundedPreceding, 0)) + F.coalesce(F.sum(size).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    df = df.withColumn("e", F.col("s") + size).withColumn("d", F.regexp_replace("hit", "[^0-9]", "")).withColumn("n_digits", F.char_length("d"))
    octets = "forall(split(hit, '\\\\.'), p -> char_length(ltrim('0', p)) <= 3 and coalesce(try_cast(ltrim('0', p) as int), 0) <= 255)"
    ok = f"case kind when 0 then true when 1 then {octets} when 2 then n_digits between 12 and 19 and {_luhn('d')} when 3 then n_digits between 9 and 15 else false end"
    return df.withColumn("ok", F.expr(ok))


def _candidates(placed: DataFrame) -> DataFrame:
    """Candidates that no base span overlaps, with their votes and features."""
    w = W.partitionBy("rid").orderBy("s", "kind", "e")
    before, after = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(1, W.unboundedFollowing)
    df = placed.where(f"ok or kind = {BASE}").withColumns({
        "_end": F.max(F.when(F.col("ok"), F.col("e"))).over(before), "_next": F.min(F.when(F.col("ok"), F.col("s"))).over(after),
    }).where(f"kind = {BASE} and coalesce(_end <= s, true) and coalesce(_next >= e, true)")
    df = df.withColumn("near", F.coalesce(F.col("s") - F.col("_end") <= NEAR, F.lit(False)) | F.coalesce(F.col("_next") - F.col("e") <= NEAR, F.lit(False)))
    df = df.withColumn("cue", F.arrays_overlap(F.split("before", r"[^\p{L}]+"), F.array(*map(F.lit, CUES))))
    df = df.withColumns({f"v_{k}": F.expr(x) for k, x in LABELERS.items()} | {f"f_{k}": F.expr(f"cast({x} as int)") for k, x in FEATURES.items()})
    return df.select("rid", "hit", "s", "e", *(f"v_{k}" for k in LABELERS), *(f"f_{k}" for k in FEATURES))


def train(candidates: DataFrame, steps: int = 300, rate: float = 1.0) -> list[float]:
    """Weights (bias first) of the span classifier: logistic regression on the posteriors of expectation-maximisation, both on counts of
    distinct (votes, features)."""
    cols = [*(f"v_{k}" for k in LABELERS), *(f"f_{k}" for k in FEATURES)]
    rows = [(tuple(r[c] for c in cols), r["n"]) for r in candidates.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).collect()]
    k = len(LABELERS)
    by_vote: dict[tuple[int, ...], int] = {}
    for x, n in rows:
        by_vote[x[:k]] = by_vote.get(x[:k], 0) + n
    prior, rates = expectation_maximisation(sorted(by_vote.items()), k, prior=0.3, abstain=0.5)
    total = max(1, sum(n for _, n in rows))
    data = [((1, *x[k:]), posterior(x[:k], prior, rates), n / total) for x, n in sorted(rows)]
    w = [math.log(prior / (1 - prior)), *[0.0] * len(FEATURES)]
    for _ in range(steps):
        slope = [1e-4 * v for v in w]
        for x, y, n in data:
            p = 1 / (1 + math.exp(min(700, max(-700, -sum(a * b for a, b in zip(w, x, strict=True))))))
            for j, v in enumerate(x):
                slope[j] += n * (p - y) * v
        w = [a - rate * b for a, b in zip(w, slope, strict=True)]
    return w


def find_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows has rid, doc_id and th (a hash of the text) for each document; spans has rid, kind (a place in KINDS), s, e, base."""
    found = written(_matches(docs), "matches")
    placed = written(_placed(found), "placed")
    more = written(_candidates(placed), "candidates")
    w = train(more)
    score = sum((F.col(f"f_{k}") * x for k, x in zip(FEATURES, w[1:], strict=True)), F.lit(w[0]))
    kind = F.when(F.col("f_letters") == 1, 4).when(F.col("v_shape_phone") == 1, 5).otherwise(6)
    more = more.where(score >= 0).select("rid", kind.alias("kind"), "s", "e", F.lit(False).alias("base"))
    base = placed.where(f"ok and kind < {BASE}").select("rid", "kind", "s", "e", F.lit(True).alias("base"))
    return found.select("rid", "doc_id", "th"), base.unionByName(more)


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def span_report(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_other."""
    rows, spans = find_spans(docs)
    by = spans.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("s", "kind", "e", "base"))).alias("found"))
    df = rows.join(by.hint("merge"), "rid", "left").withColumn("found", F.coalesce("found", F.expr("cast(array() as array<struct<s:bigint,kind:int,e:bigint,base:boolean>>)")))
    return df.select(
        "doc_id", *(F.expr(f"cast(size(filter(found, x -> x.kind = {n})) as bigint)").alias(f"n_{k}") for n, k in enumerate(KINDS[:BASE])),
        F.sha2(_joined(F.filter("found", lambda x: x["base"])), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"), F.expr("cast(size(filter(found, x -> not x.base)) as bigint)").alias("n_other"),
    )


def redact(docs: DataFrame, mark: str = "<{}>") -> DataFrame:
    """The documents with each span (of overlapping ones the first) replaced by a mark of its kind. Rows find their spans by doc_id and
    a hash of the text, so rows that repeat both are alike."""
    rows, spans = find_spans(docs.select("doc_id", "text").distinct())
    names = F.array(*(F.lit(mark.format(k)) for k in KINDS))
    keyed = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_key"))
    w = W.partitionBy("rid").orderBy("s", "kind", "e")
    first = spans.withColumn("_end", F.max("e").over(w.rowsBetween(W.unboundedPreceding, -1))).where("coalesce(_end <= s, true)")
    by = first.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("s", "kind", "e"))).alias("_spans"))
    by = rows.join(by.hint("merge"), "rid").select(F.col("doc_id").alias("_doc"), "th", "_spans")
    df = keyed.join(by.hint("merge"), F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("th")), "left").withColumn("_t", F.col("_row.text"))
    cut = F.transform("_spans", lambda x, i: F.concat(F.substring(F.col("_t"), F.coalesce(F.get("_spans", i - 1)["e"], F.lit(0)).cast("int") + 1, (x["s"] - F.coalesce(F.get("_spans", i - 1)["e"], F.lit(0))).cast("int")), F.get(names, x["kind"])))
    tail = F.substring(F.col("_t"), F.element_at("_spans", -1)["e"].cast("int") + 1, F.char_length("_t"))
    text = F.when(F.col("_spans").isNull(), F.col("_t")).otherwise(F.concat(F.array_join(cut, ""), tail))
    return df.withColumn("_row", F.col("_row").withField("text", text)).select("_row.*")
