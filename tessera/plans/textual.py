"""Text and marker queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import markers as mk
from ..operators import structure as st
from ..operators import textual as op
from ..sources.adapters import calls, panel, table, turns
from .registry import register

W_ = r"list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '')"
SENT = r"list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '')"
CLAUSE = r"list_filter(list_transform(string_split_regex(lower(coalesce(text, '')), '[.,;:!?\n]+|\s(?:and|but|so|because|although|though)\s'), lambda x: trim(x)), lambda x: x <> '')"

register("prj01_non_empty", lambda s, d: op.non_empty(turns(s, d)).select("session_id", "turn_index", "n_words"), "turns", "select session_id, turn_index, n_words from turns where trim(coalesce(text, '')) <> ''")
register("prj03_blind_labels", lambda s, d: op.blind_labels(panel(s, d)), "panel", """
    f as (select session_id, speaker_id, row_number() over (partition by session_id order by min(turn_index), speaker_id) k from panel where "role" = 'participant' group by 1, 2),
    n as (select *, row_number() over (partition by session_id order by turn_index)::varchar r from panel)
    select n.session_id, turn_index, 'T' || case when length(r) < 3 then lpad(r, 3, '0') else r end "label", case when "role" = 'moderator' then 'Moderator' else 'Participant ' || k end who from n left join f on f.session_id = n.session_id and f.speaker_id = n.speaker_id""")
register("prj04_match_key", lambda s, d: turns(s, d).select("session_id", "turn_index", F.md5(op.match_key("text", compatibility=False)).alias("key_md5")), "turns", r"""
    select session_id, turn_index, md5(regexp_replace(lower(trim(regexp_replace(replace(translate(text, '‘’“”–— ', '''''""-- '), '…', '...'), '\s+', ' ', 'g'))), '^[.,;:!?"'' -]+|[.,;:!?"'' -]+$', '', 'g')) key_md5 from turns""")
register("prj04_match_key_nfkc", lambda s, d: turns(s, d).select("session_id", "turn_index", F.md5(op.match_key("text")).alias("key_md5")))


def roster(s, d):
    """The first long word of each speaker's first turn stands for their name."""
    first = panel(s, d).where("role = 'participant'").groupBy("session_id", "speaker_id").agg(F.min_by("text", "turn_index").alias("t"))
    return first.select("session_id", "speaker_id", F.regexp_extract(F.lower("t"), "[a-z]{5,}", 0).alias("name"))


ROSTER = r"""roster as (select session_id, speaker_id, regexp_extract(lower(arg_min(text, turn_index)), '[a-z]{5,}') "name" from panel where "role" = 'participant' group by 1, 2)"""

#: Words of the folded text and what lies between them, put together again with the names replaced.
register("prj05_roster_scrub", lambda s, d: op.roster_scrub(panel(s, d), roster(s, d)).select("session_id", "turn_index", "hits", F.md5("scrubbed").alias("scrubbed_md5")), "panel", ROSTER + r""",
    n as (select session_id, list(distinct "name") p from roster where length("name") >= 3 group by 1),
    f as (select session_id, turn_index, coalesce(p, []) p, trim(regexp_replace(strip_accents(lower(text)), '\s+', ' ', 'g')) t from panel left join n using (session_id)),
    k as (select *, regexp_extract_all(t, '[a-z0-9]+') w, string_split_regex(t, '[a-z0-9]+') g from f)
    select session_id, turn_index, len(list_filter(w, lambda x: list_contains(p, x)))::int hits,
    md5(trim(array_to_string(list_transform(list_zip(g, w), lambda z: z[1] || case when z[2] is null then '' when list_contains(p, z[2]) then '[NAME]' else z[2] end), ''))) scrubbed_md5 from k where t is not null""")
register("prj06_leakage", lambda s, d: op.leakage(table(s, d, "documents").select("text"), s.createDataFrame([("token =",), ("@mail",), ("License",), ("the ",)], "token string")), "", """
    select token, count(*) filter (n > 0) texts, sum(n)::bigint hits from (select token, ((length(text) - length(replace(text, token, ''))) / length(token))::bigint n from documents cross join (select unnest(['token =', '@mail', 'License', 'the ']) token)) group by 1""")
register("prj07_sentences", lambda s, d: op.sentence_rows(turns(s, d)), "turns", f"""select session_id, turn_index, unnest({SENT}) sentence, generate_subscripts({SENT}, 1) - 1 sentence_index from turns""")
SENT_CAPITAL = SENT.replace(r"'([.!?])\s+', '\1' || chr(10)", r"""'([.!?])\s+([A-Z"''‘“])', '\1' || chr(10) || '\2'""")
register("prj07_sentences_by_capital", lambda s, d: op.sentence_rows(panel(s, d), by_capital=True), "panel", f"""select session_id, turn_index, unnest({SENT_CAPITAL}) sentence, generate_subscripts({SENT_CAPITAL}, 1) - 1 sentence_index from panel""")
register("prj08_clauses", lambda s, d: op.clause_rows(turns(s, d)), "turns", f"""select session_id, turn_index, unnest({CLAUSE}) clause, generate_subscripts({CLAUSE}, 1) - 1 clause_index from turns""")
register("prj09_word_windows", lambda s, d: turns(s, d).select("session_id", "turn_index", op.truncated("text", 12).alias("head"), op.centred("text", 20).alias("middle")), "turns", f"""
    w as (select *, {W_} w from turns) select session_id, turn_index, array_to_string(w[1:12], ' ') head, case when len(w) >= 20 then array_to_string(w[greatest((len(w) - 20) // 2 + 1, 1):greatest((len(w) - 20) // 2 + 1, 1) + 19], ' ') end middle from w""")
register("prj10_excerpt", lambda s, d: op.excerpts(turns(s, d), 40).select("session_id", "turn_index", "excerpt", "excerpt_words", "context", "reduced", "literal"))
register("prj11_payload_diff", lambda s, d: op.payload_diff(calls(s, d).select("event_id").join(table(s, d, "events").select("event_id", F.col("props").alias("payload")), "event_id"), table(s, d, "events").select("event_id", F.to_json(F.struct(F.floor("value").cast("int").alias("k"), F.col("event_type").alias("t"))).alias("payload")), "event_id").select("event_id", "path", "va", "vb", "state"), "", """
    a as (select event_id, 'k' path, props->>'$.k' va from events), b as (select event_id, 'k' path, floor(value)::int::varchar vb from events union all select event_id, 't', event_type from events)
    select event_id, path, va, vb, case when vb is null then 'only_a' when va is null then 'only_b' when va <> vb then 'differs' else 'same' end state from a full join b using (event_id, path)""".replace("\n    a as", "with a as", 1))
nested = lambda s, d, m, items, rest: table(s, d, "events").select("event_id", F.to_json(F.struct(F.struct((F.col("event_id") % m).alias("k"), F.array(*map(F.lit, range(items))).alias("l")).alias("m"), F.col("event_type").alias(rest))).alias("payload"))
register("prj11_nested_diff", lambda s, d: op.payload_diff(nested(s, d, 3, 2, "t"), nested(s, d, 2, 1, "u"), "event_id"), "", """
    with r as (select event_id, 'm.k' path, (event_id % 3)::varchar va, (event_id % 2)::varchar vb, event_type from events union all select event_id, 'm.l', '<list len=2>', '<list len=1>', event_type from events
    union all select event_id, 't', event_type, null, event_type from events union all select event_id, 'u', null, event_type, event_type from events)
    select event_id, path, va, vb, case when vb is null then 'only_a' when va is null then 'only_b' when va <> vb then 'differs' else 'same' end state from r""")
register("prj12_strip_boilerplate", lambda s, d: op.strip_boilerplate(panel(s, d), ["Licensed under [A-Za-z ,0-9.]+", "token = \"[0-9a-f]+\""]), "panel", r"""
    select session_id, turn_index, list_sort(list_distinct(regexp_extract_all(text, '(Licensed under [A-Za-z ,0-9.]+|token = "[0-9a-f]+")', 1))) removed, length(regexp_replace(text, 'Licensed under [A-Za-z ,0-9.]+|token = "[0-9a-f]+"', '', 'g')) kept_chars from panel""")
register("prj13_turn_third", lambda s, d: op.turn_third(turns(s, d)), "turns", """
    select session_id, turn_index, case when n * 3 <= t then 'early' when n * 3 <= 2 * t then 'middle' else 'final' end third from (select *, row_number() over (partition by session_id order by turn_index) n, count(*) over (partition by session_id) t from turns)""")
register("prj14_bins", lambda s, d: turns(s, d).groupBy(st.bin_label(F.col("n_words")).alias("bin")).agg(F.count(F.lit(1)).alias("n")), "turns", """
    select case when n_words < 10 then '0-9' when n_words < 25 then '10-24' when n_words < 50 then '25-49' when n_words < 100 then '50-99' when n_words < 200 then '100-199' when n_words < 250 then '200-249' when n_words < 300 then '250-299' else '300+' end bin, count(*) n from turns group by 1""")
register("prj15_tokens", lambda s, d: turns(s, d).select("session_id", "turn_index", F.size(tx.tokens("text")).alias("tokens"), F.size(F.array_distinct(tx.tokens("text", "[a-z]+", 4))).alias("content_types")), "turns", """
    select session_id, turn_index, len(regexp_extract_all(lower(text), '[a-z'']+')) tokens, len(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) >= 4))) content_types from turns""")

LEX = [("en", "alignment", 1), ("the", "alignment", 2), ("die", "alignment", 3), ("er", "divergence", 4), ("an", "divergence", 5), ("le", "divergence", 6)]
LEX_SQL = "lex as (select * from (values " + ", ".join(f"('{a}', '{b}', {c})" for a, b, c in LEX) + ") t(marker, kind, ord))"
register("mrk01_clause_markers", lambda s, d: mk.clause_markers(turns(s, d), s.createDataFrame(LEX, "marker string, kind string, ord int")), "turns", f"""
    {LEX_SQL}, c as (select session_id, turn_index, unnest({CLAUSE}) clause, generate_subscripts({CLAUSE}, 1) - 1 k from turns),
    f as (select session_id, turn_index, k, arg_min(kind, ord) kind from c left join lex on starts_with(clause, marker) group by 1, 2, 3),
    g as (select session_id, turn_index, count(*) clauses, count(*) filter (kind = 'divergence' and k < 2) d1_div, count(*) filter (kind = 'alignment' and k < 2) d1_align, count(*) filter (kind = 'divergence') div_full, count(*) filter (kind = 'alignment') align_full from f group by 1, 2)
    select *, case when d1_div > 0 and d1_align > 0 then 'mixed' when d1_div > 0 then 'divergence' when d1_align > 0 then 'alignment' else 'none' end "label" from g""")

FAM_WORDS = {"first_person": "i ich je yo".split(), "hedge": "or oder ou o".split(), "function": "the of and der die und la le de el los".split()}
FAMILIES = {k: tx.any_of(x) for k, x in FAM_WORDS.items()}
#: The same hits, counted on the letter runs of a text.
ON_WORDS = r"len(list_filter(string_split_regex(lower({0}), '[^\p{{L}}]+'), lambda x: x in {1}))"
FAM_SQL = ", ".join(f"sum({ON_WORDS.format('text', tuple(x))})::bigint {k}_n" for k, x in FAM_WORDS.items())
STYLE = f"""st as (select session_id, speaker_id, sum(n_words)::bigint words, len(list_distinct(flatten(list(regexp_extract_all(lower(text), '[a-z]+'))))) ty, sum(len(regexp_extract_all(lower(text), '[a-z]+'))) tk, sum(len({SENT})) ns, flatten(list(list_transform({SENT}, lambda y: len(list_filter(string_split_regex(y, '\\s+'), lambda z: z <> ''))))) sl, {FAM_SQL} from turns group by 1, 2),
    rates as (select session_id, speaker_id, words, round(ty / nullif(tk, 0)::double, 6) ttr, round(words / nullif(ns, 0)::double, 6) sentence_words, round(list_aggregate(sl, 'var_pop'), 6) sentence_variance, {", ".join(f"round(100 * (({k}_n)::double / nullif(words, 0)), 6) {k}" for k in FAMILIES)} from st)"""
register("mrk02_style_rates", lambda s, d: mk.style_rates(turns(s, d), FAMILIES), "turns", STYLE + " select * from rates")
register("mrk02_style_ranges", lambda s, d: mk.style_ranges(mk.style_rates(turns(s, d), FAMILIES), list(FAMILIES)), "turns", STYLE + " select session_id, " + ", ".join(f"round(max({k}) - min({k}), 6) {k}_range" for k in FAMILIES) + " from rates group by 1")
register("mrk03_topic_terms", lambda s, d: mk.topic_terms(panel(s, d), ["token", "mail", "license"], ["tion", "keit"]), "panel", """
    f as (select session_id, contains(lower(text), 'token') or contains(lower(text), 'mail') or contains(lower(text), 'license') c, contains(lower(text), 'tion') or contains(lower(text), 'keit') a from panel)
    select session_id, count(*) filter (c) topic_turns, count(*) filter (a and not c) abstract_only, count(*) filter (a and not c) > 5 flagged from f group by 1""")
ART = {"stars": "[*][*]", "braces": "[{][a-z]+[}]", "redacted": "[+]redacted[+]", "inaudible": "inaudible|removed", "stamps": r"\[[0-9]{2}:[0-9]{2}\]"}
register("mrk04_artefacts", lambda s, d: mk.pattern_counts(panel(s, d), ART), "panel", "select session_id, " + ", ".join(f"sum(len(regexp_extract_all(text, '{p}')))::bigint {k}" for k, p in ART.items()) + " from panel group by 1")
register("mrk05_phrase_hits", lambda s, d: mk.phrase_hits(turns(s, d), ["the ", "la ", "und "]), "turns", """
    h as (select session_id, (length(lower(text)) - length(replace(lower(text), 'the ', ''))) // 4 + (length(lower(text)) - length(replace(lower(text), 'la ', ''))) // 3 + (length(lower(text)) - length(replace(lower(text), 'und ', ''))) // 4 n from turns where "role" = 'moderator')
    select session_id, count(*) entries, count(*) filter (n > 0) with_hits, sum(n)::bigint hits, round(count(*) filter (n > 0) / count(*)::double, 6) rate, round(sum(n) / count(*)::double, 6) per_entry from h group by 1""")
#: On tokens, as this dialect's patterns don't look around: a digit right after a letter begins no quantity, and a single one right before letters is one only with a unit; words that begin a sentence get
#: a mark that makes them other words; other letters than ASCII count as letters at the ends of expressions of time.
UNITS = "(?i)[0-9](?:p|k|quid|pounds?|mins?|minutes?|hours?|years?|stone|kg|lbs?|ml|l)"
ANCH = {
    "numbers": f"len(list_filter(regexp_extract_all(regexp_replace({{0}}, '([A-Za-z])[0-9]', '\\1#', 'g'), '[0-9]+(?:[.,][0-9]+)?[A-Za-z]*'), lambda x: not regexp_full_match(x, '[0-9][A-Za-z]+') or regexp_full_match(x, '{UNITS}')))",
    "times": "len(regexp_extract_all(regexp_replace(lower({0}), '[^\\x00-\\x7F\\p{{P}}\\p{{S}}\\p{{Z}}]', 'x', 'g'), '\\b" + mk.TEMPORAL.replace("'", "''").replace("{", "{{").replace("}", "}}") + "\\b'))",
    "names": f"len(list_filter(regexp_extract_all(regexp_replace(regexp_replace({{0}}, '([.!?]\\s)([A-Z])', '\\1_\\2', 'g'), '^([A-Z])', '_\\1'), '[\\p{{{{L}}}}\\p{{{{N}}}}_]+'), lambda x: regexp_full_match(x, '[A-Z][a-z]{{{{2,}}}}') and x not in {tuple(x for x in mk.NO_ENTITY if chr(39) not in x)} and not list_contains(own, lower(x))))",
}
register("mrk06_anchors", lambda s, d: mk.anchors(panel(s, d), roster(s, d)), "panel", ROSTER + f""",
    ow as (select session_id, list(distinct "name") ow from roster where "name" <> '' group by 1), p as (select panel.*, coalesce(ow, []) own, array_to_string(({W_})[1:40], ' ') part from panel left join ow using (session_id)),
    a as (select session_id, turn_index, """ + ", ".join(f"{e.format('text')}::int {k}, {e.format('part')}::int {k}_first" for k, e in ANCH.items()) + """ from p)
    select *, numbers + times + names anchors, numbers_first + times_first + names_first anchors_first from a""")
STOP, GAZ = ["the", "and", "der", "und", "la"], [("that", "place"), ("with", "place"), ("les", "thing"), ("ein", "thing")]
register("mrk07_entity_density", lambda s, d: mk.entity_density(panel(s, d).select(F.col("session_id").alias("unit"), F.explode(tx.tokens("text", "[a-z]+", 3)).alias("entity")), panel(s, d).groupBy(F.col("session_id").alias("unit")).agg(F.sum("n_words").alias("words")), s.createDataFrame([(x,) for x in STOP], "entity string"), s.createDataFrame(GAZ, "entity string, kind string")), "panel", f"""
    e as (select session_id unit, unnest(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) >= 3)) entity from panel), w as (select session_id unit, sum(n_words) words from panel group by 1),
    g as (select * from (values {', '.join(map(str, GAZ))}) t(entity, kind)), k as (select unit, coalesce(kind, 'other') kind, count(*) n from e left join g using (entity) where entity not in {tuple(STOP)} group by 1, 2)
    select unit, kind, n, round(100 * (n / words::double), 6) density from k join w using (unit)""")
register("mrk08_exactness", lambda s, d: mk.exactness(panel(s, d)), "panel", r"""
    m as (select session_id, turn_index, """ + ", ".join(f"len(regexp_extract_all(lower(text), '{p}')) {k}" for k, p in mk.EXACT.items()) + r""" from panel),
    f as (select *, list_filter([""" + ", ".join(f"case when {k} > 0 then '{k}' end" for k in mk.EXACT) + r"""], lambda x: x is not null) detectors from m)
    select session_id, turn_index, upper(substr(sha256(session_id || '|' || turn_index), 1, 16)) candidate_id, detectors, """ + " + ".join(mk.EXACT) + " matches from f where len(detectors) > 0")
register("mrk09_numeral_rate", lambda s, d: mk.numeral_rate(panel(s, d)), "panel", """select session_id, round(1000 * (sum(len(regexp_extract_all(text, '[0-9]+'))) / sum(n_words)::double), 6) per_1000 from panel where "role" = 'participant' group by 1""")
register("mrk10_term_rates", lambda s, d: mk.term_rates(turns(s, d), s.createDataFrame([(x,) for x in ("the", "der", "les", "los", "in")], "term string")), "turns", """
    t as (select session_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) term from turns), c as (select session_id, term, count(*) n from t where term in ('the', 'der', 'les', 'los', 'in') group by 1, 2), w as (select session_id, sum(n_words) words from turns group by 1)
    select session_id, term, n, round(100 * (n / words::double), 6) rate from c join w using (session_id)""")
register("mrk11_reference_density", lambda s, d: mk.reference_density(panel(s, d), roster(s, d)), "panel", ROSTER + """,
    c as (select session_id, "name", min(speaker_id) who from roster group by 1, 2 having count(distinct speaker_id) = 1),
    t as (select session_id, turn_index, speaker_id, unnest(case when len(regexp_extract_all(lower(text), '[a-z]+')) = 0 then [''] else list_distinct(regexp_extract_all(lower(text), '[a-z]+')) end) "name" from panel where "role" = 'participant'),
    h as (select session_id, turn_index, bool_or(coalesce(who <> speaker_id, false)) h from t left join c using (session_id, "name") group by 1, 2),
    am as (select session_id, count(*) k from (select session_id, "name" from roster where "name" <> '' group by 1, 2 having count(distinct speaker_id) > 1) group by 1)
    select h.session_id, count(*) turns, round(avg(h::int), 6) density, coalesce(max(k), 0) ambiguous from h left join am using (session_id) group by 1""")
register("mrk12_keyword_rate", lambda s, d: mk.keyword_rate(turns(s, d), ["yes", "oui", "genau", "claro", "than"]), "turns", """
    select session_id, round(avg((contains(lower(text), 'yes') or contains(lower(text), 'oui') or contains(lower(text), 'genau') or contains(lower(text), 'claro') or contains(lower(text), 'than'))::int), 6) rate from turns where "role" = 'participant' group by 1""")
register("mrk13_polarity_contrast", lambda s, d: mk.polarity_contrast(panel(s, d)), "panel", "f as (select session_id, speaker_id, turn_index, " + ", ".join(f"{ON_WORDS.format('text', tuple(x))} > 0 {k}" for k, x in mk.POLARITY.items()) + """ from panel),
    g as (select *, lag(negated) over w pn, lag(frequent) over w pf from f window w as (partition by session_id, speaker_id order by turn_index)) select session_id, turn_index, negated, frequent, change, (negated <> pn or frequent <> pf) contrast from g""")
register("mrk14_residue", lambda s, d: mk.residue(panel(s, d), ["token", "mail", "license", "apache", "com"]), "panel", r"""
    c as (select session_id, turn_index, list_filter([case when regexp_matches(text, '[0-9]{4}') then 'digits' end, case when regexp_matches(text, 'https?://|www[.]') then 'url' end, case when regexp_matches(text, '[\[\]{}]') then 'bracket' end,
        case when len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z]+')), ['token', 'mail', 'license', 'apache', 'com'])) >= 2 then 'cluster' end], lambda x: x is not null) classes from panel) select * from c where len(classes) > 0""")
register("mrk15_log_markers", lambda s, d: mk.log_markers(table(s, d, "pages").select((F.col("page_id") % 10).alias("run"), F.col("html").alias("text")), "run", ["404", "script", "nav"]), "", """
    select page_id % 10 run, sum((length(html) - length(replace(html, '404', ''))) // 3)::bigint m0, sum((length(html) - length(replace(html, 'script', ''))) // 6)::bigint m1, sum((length(html) - length(replace(html, 'nav', ''))) // 3)::bigint m2,
    sum((length(html) - length(replace(html, '404', ''))) // 3) > 0 lost from pages group by 1""")
register("mrk16_stage_directions", lambda s, d: mk.stage_directions(panel(s, d)), "panel", r"""
    t as (select session_id, turn_index, row_number() over (partition by session_id order by turn_index) "rank", count(*) over (partition by session_id) total from panel where regexp_matches(text, '[*][^*]+[*]|\[[^\]]+\]')) select * from t where "rank" <= 5""")
