"""Segmentation and join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import markers as mk
from ..operators import pairs as pr
from ..operators import segments as sg
from ..sources.adapters import panel, presence, table, turns
from .registry import register
from .textual import ROSTER, roster



def head():
    return F.when((F.col("role") == "moderator") & (F.col("turn_index") % 3 == 0), (F.col("turn_index") / 40).cast("int"))


HEAD_SQL = """h as (select *, case when "role" = 'moderator' and turn_index % 3 = 0 then turn_index // 40 end header from panel),
    e as (select *, last_value(header ignore nulls) over (partition by session_id order by turn_index rows unbounded preceding) section_no, last_value(header ignore nulls) over (partition by session_id order by turn_index rows between unbounded preceding and 1 preceding) b from h)"""
register("seg01_by_headers", lambda s, d: sg.by_headers(panel(s, d), head()), "panel", HEAD_SQL + """
    select session_id, turn_index, header, section_no, case when header is null or b is null then null when header = b then 'duplicate' when header < b then 'out_of_order' when header > b + 1 then 'gap' end warning from e""")
LOG_SQL = r"""lg as (select session_id, turn_index * 37 % 1000 ord, turn_index, case when n_words % 3 = 0 then text || ' x' else upper(' ' || text) end u from panel where turn_index % 7 = 0),
    nl as (select *, trim(regexp_replace(lower(u), '\s+', ' ', 'g')) k from lg where trim(u) <> ''), nt as (select session_id, turn_index, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) k from panel where "role" = 'moderator'),
    lh as (select nl.session_id, nl.ord, nl.turn_index, nt.k is not null hit from nl left join nt on nt.session_id = nl.session_id and nt.turn_index = nl.turn_index and nt.k = nl.k),
    lc as (select *, sum(hit::int) over (partition by session_id order by ord) - hit::int done from lh), lo as (select * from lc where done < 3),
    lb as (select *, lag(turn_index) over (partition by session_id order by ord) > turn_index back from lo where hit), lw as (select session_id, count(*) filter (not hit) missing from lo group by 1), lv as (select session_id, not coalesce(bool_or(back), false) monotonic from lb group by 1),
    bl as (select p.session_id, p.turn_index, sum((b.turn_index is not null)::int) over (partition by p.session_id order by p.turn_index rows unbounded preceding)::bigint section_no, coalesce(missing, 0) missing, coalesce(monotonic, true) monotonic
    from panel p left join lb b on b.session_id = p.session_id and b.turn_index = p.turn_index left join lw w on w.session_id = p.session_id left join lv v on v.session_id = p.session_id)"""
TRANSITIONS = lambda s, d: panel(s, d).where("turn_index % 7 = 0").select("session_id", (F.col("turn_index") * 37 % 1000).alias("ord"), "turn_index", F.when(F.col("n_words") % 3 == 0, F.concat("text", F.lit(" x"))).otherwise(F.upper(F.concat(F.lit(" "), "text"))).alias("utterance"))
register("seg02_by_log", lambda s, d: sg.by_log(panel(s, d), TRANSITIONS(s, d), 4), "panel", LOG_SQL + " select * from bl")
register("seg03_crosscheck", lambda s, d: sg.crosscheck(sg.by_headers(panel(s, d), head()), sg.by_log(panel(s, d), TRANSITIONS(s, d), 4)), "panel", HEAD_SQL + ", " + LOG_SQL + """,
    j as (select session_id, case when e.section_no is null or bl.section_no is null then 'o' when e.section_no = bl.section_no then 'a' when abs(e.section_no - bl.section_no) = 1 then 'b' else 'c' end k from e full join bl using (session_id, turn_index))
    select session_id, count(*) filter (k = 'a') agree, count(*) filter (k = 'b') boundary, count(*) filter (k = 'c') conflict, count(*) filter (k = 'o') one_sided from j group by 1""")
SEC = """sec as (select session_id, section, count(*) turns, count(*) filter ("role" = 'participant') participant_turns, sum(case when "role" = 'participant' then n_words else 0 end)::bigint words, count(distinct case when "role" = 'participant' then speaker_id end) participants,
    count(*) filter ("role" = 'participant') >= 3 and sum(case when "role" = 'participant' then n_words else 0 end) >= 150 meets_floor from panel group by 1, 2)"""
register("seg04_sections", lambda s, d: sg.sections(panel(s, d)), "panel", SEC + " select * from sec")


def side(s, d, condition):
    df = panel(s, d).where(F.col("condition") == condition).withColumn("session_id", F.col("group_id"))
    return sg.sections(df).withColumnRenamed("session_id", "group_id")


register("seg05_comparable", lambda s, d: sg.comparable(side(s, d, "human"), side(s, d, "a")), "panel", """
    x as (select "condition", group_id, section, count(*) filter ("role" = 'participant') >= 3 and sum(case when "role" = 'participant' then n_words else 0 end) >= 150 f from panel group by 1, 2, 3),
    j as (select group_id, section, a.f fa, b.f fb from (select * from x where "condition" = 'human') a full join (select * from x where "condition" = 'a') b using (group_id, section)),
    k as (select *, case when fa is null then 'missing_a' when fb is null then 'missing_b' when not fa then 'thin_a' when not fb then 'thin_b' end skip from j) select group_id, section, skip, skip is null comparable from k""")
register("seg06_window_cut", lambda s, d: sg.window_cut(panel(s, d), F.col("role") == "moderator", (F.col("role") == "moderator") & (F.col("n_words") > 300)), "panel", """
    b as (select session_id, min(case when "role" = 'moderator' then turn_index end) "start", max(case when "role" = 'moderator' and n_words > 300 then turn_index end) c from panel group by 1),
    w as (select session_id, "start", case when c > "start" then c end stop from b), i as (select p.*, w."start", stop, coalesce(turn_index >= w."start" and (stop is null or turn_index < stop), false) inside from panel p join w using (session_id))
    select session_id, "start", stop, count(*) filter (inside) included, count(*) filter (not inside) excluded, sum(case when inside then n_words else 0 end)::bigint words from i group by 1, 2, 3""")
ASK, LEAD, RESIDUE = "(?i)the |und ", "(?i) la |les ", "[0-9]|token"
register("seg06_ask_offset", lambda s, d: sg.ask_offset(panel(s, d).where("role = 'moderator'"), ASK, LEAD, RESIDUE).select("session_id", "turn_index", "offset", "dropped_words", "review"), "panel", rf"""
    p as (select session_id, turn_index, string_split(regexp_replace(coalesce(text, ''), '([.!?])(\s)', '\1' || chr(1) || '\2', 'g'), chr(1)) x from panel where "role" = 'moderator'),
    a as (select *, list_max(list_filter(range(len(x)), lambda i: regexp_matches(x[i + 1], '{ASK}'))) an from p),
    b as (select *, case when an is not null then coalesce(list_max(list_filter(range(an), lambda i: not (regexp_matches(x[i + 1], '{ASK}|{LEAD}') and not regexp_matches(x[i + 1], '{RESIDUE}')))) + 1, 0) end lo from a),
    c as (select *, array_to_string(x[1:coalesce(lo, 0)], '') hd, array_to_string(x[coalesce(lo, 0) + 1:], '') kp from b), o as (select *, lo is not null and not regexp_matches(kp, '{RESIDUE}') ok from c),
    f as (select session_id, turn_index, case when ok then length(hd) + case when lo > 0 then length(kp) - length(regexp_replace(kp, '^\s+', '')) else 0 end end "offset", case when ok then len(list_filter(string_split_regex(hd, '\s+'), lambda w: w <> '')) end dropped_words, ok from o)
    select session_id, turn_index, "offset", dropped_words, case when not ok then 'human' when "offset" = 0 then 'clean' else 'trimmed' end review from f""")
Q = [(1, "the"), (2, "und"), (3, "tion"), (4, "los")]
register("seg07_openers", lambda s, d: sg.openers(panel(s, d), s.createDataFrame(Q, "question int, term string")), "panel", f"""
    q as (select * from (values {', '.join(map(str, Q))}) t(question, term)), a as (select session_id, turn_index, question, instr(lower(text), term) p from panel join q on instr(lower(text), term) > 0 where "role" = 'moderator'),
    b as (select session_id, turn_index, arg_max(question, p * 10 + question) question from a group by 1, 2),
    c as (select *, row_number() over (partition by session_id, question order by turn_index) = 1 f, coalesce(max(question) over (partition by session_id order by turn_index rows between unbounded preceding and 1 preceding), 0) t from b)
    select session_id, turn_index, question, case when f and question = t + 1 then 'opens' when f then 'out_of_turn' else 'reformulates' end kind from c""")
BUDGET = """c as (select session_id, turn_index, n_words, sum(n_words) over (partition by session_id order by turn_index rows unbounded preceding) cum from panel),
    r as (select c.session_id, c.turn_index "start", max(e.turn_index) stop, max(e.cum - c.cum + c.n_words)::bigint words from c join c e on e.session_id = c.session_id and e.turn_index >= c.turn_index and e.cum - c.cum + c.n_words <= 1500 group by 1, 2 having max(e.cum - c.cum + c.n_words) >= 0.9 * 1500),
    n as (select *, row_number() over (partition by session_id order by "start") - 1 i, count(*) over (partition by session_id) n from r),
    h as (select *, (('0x' || substr(sha256(session_id), 1, 8))::bigint % 1000) / 1000.0::double ph from n),
    exc as (select session_id, "start", stop, words from h where n <= 10 or list_contains(list_transform(range(10), lambda q: floor((q + ph) * (n / 10.0::double))::bigint), i))"""
register("seg08_word_budget", lambda s, d: sg.word_budget(panel(s, d), 1500), "panel", BUDGET + " select * from exc")
register("seg09_completeness", lambda s, d: sg.completeness(panel(s, d), 4), "panel", """
    z as (select session_id, section, bool_or("role" = 'participant') a from panel group by 1, 2),
    g as (select session_id, count(*)::int sections, list_sort(list_distinct(list(section) filter (a and section < 4))) h from z group by 1)
    select session_id, sections, round(len(coalesce(h, [])) / 4.0::double, 6) "share", list_filter([0, 1, 2, 3], lambda x: not list_contains(coalesce(h, []), x)) missing from g""")
register("seg10_guide_coverage", lambda s, d: sg.guide_coverage(panel(s, d), 4), "panel", """
    m as (select *, coalesce(section <> lag(section) over (partition by session_id order by turn_index), false) mv, "role" = 'moderator' and contains(text, '?') ask from panel)
    select session_id, count(distinct section) completed, 4 - count(distinct section) skipped, count(*) filter (mv) moves, count(*) filter (ask and section < 2) early_asks, count(*) filter (ask and section >= 2) late_asks from m group by 1""")

register("jn01_response_acts", lambda s, d: pr.response_acts(panel(s, d)), "panel", """
    l as (select *, lag(turn_index) over w pt, lag(speaker_id) over w ps, lag(n_words) over w pw, lag("role") over w p from panel window w as (partition by session_id, section order by turn_index))
    select session_id, section, pt prev_turn, turn_index resp_turn, ps prev_speaker_id, speaker_id resp_speaker_id, pw prev_words, n_words resp_words from l where "role" = 'participant' and p = 'participant'""")
register("jn02_bridge_rate", lambda s, d: pr.bridge_rate(turns(s, d)), "turns", """
    i as (select session_id, turn_index, "role", row_number() over (partition by session_id order by turn_index) i from turns where "role" is not null), g as (select session_id, i - lag(i) over (partition by session_id order by turn_index) g from i where "role" = 'participant')
    select session_id, count(*) pairs, count(*) filter (g > 1) bridged, round(avg((g > 1)::int), 6) rate from g where g is not null group by 1""")
register("jn03_relevance_pairs", lambda s, d: pr.relevance_pairs(panel(s, d)), "panel", """
    l as (select *, last_value(case when "role" = 'moderator' then turn_index end ignore nulls) over (partition by session_id order by turn_index rows between unbounded preceding and 1 preceding) moderator_turn, min(case when "role" = 'moderator' then turn_index end) over (partition by session_id, section) opener from panel)
    select session_id, turn_index, moderator_turn, opener from l where "role" = 'participant'""")
register("jn04_between_pairs", lambda s, d: pr.between_pairs(panel(s, d), sg.sections(panel(s, d))), "panel", SEC + """,
    a as (select p.* from panel p semi join (select * from sec where meets_floor) f on f.session_id = p.session_id and f.section = p.section where "role" = 'participant')
    select a.session_id, a.section, a.turn_index turn_a, b.turn_index turn_b, a.n_words + b.n_words words from a join a b on a.session_id = b.session_id and a.section = b.section and a.turn_index < b.turn_index and a.speaker_id <> b.speaker_id""")
register("jn05_paired_reference", lambda s, d: pr.paired_reference(panel(s, d).select("session_id", "condition", "group_id").distinct(), "human"), "panel", """
    x as (select distinct session_id, "condition", group_id from panel), r as (select group_id, min(session_id) reference_session from x where "condition" = 'human' group by 1 having count(*) = 1)
    select session_id, "condition", group_id, reference_session from x left join r using (group_id) where "condition" <> 'human'""")
register("jn06_interaction_edges", lambda s, d: pr.interaction_edges(panel(s, d), roster(s, d)), "panel", ROSTER + """,
    l as (select *, lag(speaker_id) over w tg, lag("role") over w r from panel window w as (partition by session_id order by turn_index)),
    t as (select session_id, "role", speaker_id src, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) nm from panel),
    nd as (select t.*, r.speaker_id tg from t join roster r on r.session_id = t.session_id and r."name" = t.nm),
    e as (select session_id, speaker_id src, tg, 'uptake' "type" from l where "role" = 'participant' and r = 'participant' and tg <> speaker_id
    union all select session_id, speaker_id, 'MODERATOR', 'answered' from l where "role" = 'participant' and r = 'moderator'
    union all select session_id, src, tg, 'referenced' from nd where "role" = 'participant' and src <> tg union all select session_id, 'MODERATOR', tg, 'addressed' from nd where "role" = 'moderator'),
    h as (select session_id, count(*) filter ("type" in ('uptake', 'referenced')) = 0 and count(*) filter ("type" = 'addressed') > 5 hub from e group by 1),
    k as (select session_id, count(distinct speaker_id) k from panel where "role" = 'participant' group by 1)
    select session_id, "type", count(*) edges, round(count(distinct src || '>' || tg) / nullif(case when "type" in ('uptake', 'referenced') then any_value(k) * (any_value(k) - 1) else any_value(k) end, 0)::double, 6) density, any_value(hub) hub
    from e left join k using (session_id) join h using (session_id) group by 1, 2""")


def labelled(s, d):
    """The panel with speakers named by labels, which some turns name too."""
    k, t = F.col("turn_index") % 7, F.coalesce("text", F.lit(""))
    return panel(s, d).withColumns({"speaker_id": F.concat(F.lit("Mf_"), "speaker_id"), "text": F.when(k == 3, F.concat(t, F.lit(" ask mf_de."))).when(k == 5, F.concat(t, F.lit(" so Mf_en's point"))).otherwise(F.col("text"))})


def members(s, d):
    """The first two long words of each speaker's first turn stand for their names."""
    first = labelled(s, d).where("role = 'participant'").groupBy("session_id", "speaker_id").agg(F.min_by("text", "turn_index").alias("t"))
    w = F.regexp_extract_all(F.lower("t"), F.lit("[a-z]{5,}"), F.lit(0))
    return first.where(F.size(w) >= 2).select("session_id", "speaker_id", F.concat_ws(" ", F.initcap(w[0]), w[1]).alias("name"))


LABELLED = r"""lb as (select session_id, turn_index, "role", 'Mf_' || speaker_id speaker_id, case turn_index % 7 when 3 then coalesce(text, '') || ' ask mf_de.' when 5 then coalesce(text, '') || ' so Mf_en''s point' else text end text from panel),
    me as (select session_id, speaker_id, w[1] || ' ' || w[2] nm, w[1] fi from (select session_id, speaker_id, regexp_extract_all(lower(arg_min(text, turn_index)), '[a-z]{5,}') w from lb where "role" = 'participant' group by 1, 2) where len(w) >= 2)"""
register("jn06_interaction_graph", lambda s, d: pr.interaction_graph(labelled(s, d), members(s, d)), "panel", LABELLED + r""",
    lw as (select *, lower(coalesce(text, '')) lo, ' ' || regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+', ' ', 'g') || ' ' pl from lb where "role" is not null),
    mn as (select l.session_id, "role", l.speaker_id src, m.speaker_id tg, case when contains(lo, nm) then 'full_name' when contains(pl, ' ' || fi || ' ') then 'first_name' when contains(lo, lower(m.speaker_id)) then 'id' end how from lw l join me m using (session_id)),
    lg as (select *, lag(speaker_id) over w tg, lag("role") over w r from lb where "role" is not null window w as (partition by session_id order by turn_index)),
    e as (select session_id, 'to_moderator' kind, speaker_id src, 'MODERATOR' tg, null how from lg where "role" = 'participant' and r = 'moderator' union all select session_id, 'between', speaker_id, tg, null from lg where "role" = 'participant' and r = 'participant' and tg <> speaker_id
        union all select session_id, 'between', src, tg, how from mn where "role" = 'participant' and src <> tg and how is not null union all select session_id, 'from_moderator', 'MODERATOR', tg, how from mn where "role" = 'moderator' and how is not null),
    n as (select session_id, count(distinct speaker_id) m from me group by 1),
    g as (select session_id, any_value(m) members, count(kind) edges, count(*) filter (kind = 'between') "between", count(*) filter (kind = 'from_moderator') from_moderator, count(*) filter (kind = 'to_moderator') to_moderator, count(distinct src || '>' || tg) filter (kind = 'between') pairs,
        count(distinct tg) filter (kind = 'from_moderator') fm, count(distinct src) filter (kind = 'to_moderator') tm, count(*) filter (how = 'full_name') full_name_mentions, count(*) filter (how = 'first_name') first_name_mentions, count(*) filter (how = 'id') id_mentions from n left join e using (session_id) group by 1)
    select session_id, members, edges, "between", from_moderator, to_moderator, pairs, members * (members - 1) possible, round(coalesce(pairs / nullif(members * (members - 1), 0)::double, 0), 6) density, case when members < 2 then 'insufficient_sample' else 'ok' end status,
        round(fm / members::double, 6) density_from_moderator, round(tm / members::double, 6) density_to_moderator, full_name_mentions, first_name_mentions, id_mentions, "between" = 0 and from_moderator > 5 hub from g""")


def handles(s, d):
    """Members some of whom are known by their labels only."""
    return members(s, d).withColumn("name", F.when(F.col("speaker_id") == "Mf_de", F.col("speaker_id")).otherwise(F.col("name")))


COMMON = ["their", "there", "would", "elle", "cette"]
register("mrk11_label_density", lambda s, d: mk.label_density(labelled(s, d), handles(s, d), COMMON), "panel", LABELLED + rf""",
    h as (select session_id, speaker_id, case when speaker_id = 'Mf_de' then 'mf_de' else fi end fi, case when speaker_id = 'Mf_de' then 'mf_de' else fi end in {tuple(COMMON)} cm from me),
    f as (select session_id, count(*) filter (cm) excluded, count(*) filter (not cm and not regexp_full_match(fi, '[a-z]+(''[a-z]+)?')) unrepresentable, count(distinct case when not cm then fi end) < count(*) filter (not cm) collapsed from h group by 1),
    t as (select row_number() over () k, session_id, speaker_id, list_transform(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+(?:''[a-z]+)?'), lambda x: case when x like '%''s' then x[:-3] else x end) pl,
        list_transform(regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z0-9_.'']*'), lambda x: case when x like '%''s' then x[:-3] else rtrim(x, '.') end) la from lb where "role" = 'participant'),
    r as (select t.k, t.session_id, bool_or(coalesce(h.speaker_id <> t.speaker_id and list_contains(pl, fi), false)) p, bool_or(coalesce(h.speaker_id <> t.speaker_id and list_contains(la, fi), false)) l from t join f using (session_id) left join h on h.session_id = t.session_id and not h.cm group by 1, 2)
    select session_id, count(*) turns, round(avg(p::int), 6) density, round(avg(l::int), 6) label_density, any_value(excluded) excluded, any_value(unrepresentable) unrepresentable, any_value(collapsed) collapsed, any_value(unrepresentable) = 0 and not any_value(collapsed) valid from r join f using (session_id) group by 1""")


def decisions(s, d):
    """A moderator log over the given turns: action and target from their lengths."""
    n, actions = F.col("n_words"), F.array(*map(F.lit, ("direct_probe", "redirect_to_group", "section_transition", "ask_initial_to_group", "summarise")))
    return panel(s, d).where("role = 'moderator'").select("session_id", "turn_index", F.get(actions, (n % 5).cast("int")).alias("action"), F.when(n % 3 == 0, "en").when(n % 3 == 1, "group").alias("target"))


register("jn07_targeting", lambda s, d: pr.targeting(panel(s, d), decisions(s, d), roster(s, d)), "panel", ROSTER + """,
    n as (select *, first_value(case when "role" = 'participant' then speaker_id end ignore nulls) over (partition by session_id order by turn_index rows between 1 following and unbounded following) nx from panel),
    m as (select session_id, turn_index, nx, (['direct_probe', 'redirect_to_group', 'section_transition', 'ask_initial_to_group', 'summarise'])[n_words % 5 + 1] "action", case n_words % 3 when 0 then 'en' when 1 then 'group' end target,
        exists(select 1 from roster r where r.session_id = n.session_id and list_contains(regexp_extract_all(lower(text), '[a-z]+'), r."name")) named from n where "role" = 'moderator'),
    k as (select *, case when "action" = 'direct_probe' and target = 'en' then 'strict' when target = 'group' then case when named then 'soft' when "action" = 'section_transition' then 'transition' else 'broad' end
        when "action" in ('section_transition', 'ask_initial_to_group') then 'transition' else 'ambiguous' end kind from m)
    select session_id, turn_index, "action", target, kind, case when kind = 'strict' then coalesce(nx = target, false) end honoured from k""")


def mean_words(s, d, condition):
    return panel(s, d).where((F.col("condition") == condition) & (F.col("role") == "participant")).groupBy("group_id").agg(F.avg("n_words").alias("value"))


register("jn08_side_by_side", lambda s, d: pr.side_by_side(mean_words(s, d, "a"), mean_words(s, d, "human"), ["group_id"]), "panel", """
    m as (select group_id, "condition" c, avg(n_words) v from panel where "role" = 'participant' group by 1, 2)
    select group_id, round(a.v, 6) a, round(b.v, 6) b, round(a.v - b.v, 6) difference from (select * from m where c = 'a') a full join (select * from m where c = 'human') b using (group_id)""")
register("jn09_grid_integrity", lambda s, d: pr.grid_integrity(panel(s, d).select("condition", "group_id", F.col("session_id").alias("run")).distinct(), {"condition": s.createDataFrame([("human",), ("a",), ("c",)], "condition string"), "group_id": table(s, d, "documents").select(F.col("source").alias("group_id")).distinct()}), "panel", """
    n as (select "condition", group_id, count(distinct session_id) r from panel group by 1, 2), e as (select * from (select unnest(['human', 'a', 'c']) "condition") cross join (select distinct group_id from panel))
    select "condition", group_id, coalesce(r, 0) "rows", case when r is null then 'missing' when e.group_id is null then 'unexpected' when r > 1 then 'collision' else 'ok' end state from e full join n using ("condition", group_id)""".replace("when e.group_id is null", "when \"condition\" not in ('human', 'a', 'c')"))
seq = lambda df, label: df.select("session_id", F.row_number().over(pr.by_turn()).alias("pos"), F.col(label).alias("label"))
register("jn10_sequence_diff", lambda s, d: pr.sequence_diff(seq(turns(s, d), "speaker_id"), seq(turns(s, d).where("speaker_id != 'system'"), "speaker_id")), "turns", """
    a as (select session_id, row_number() over (partition by session_id order by turn_index) pos, speaker_id x from turns), b as (select session_id, row_number() over (partition by session_id order by turn_index) pos, speaker_id y from turns where speaker_id <> 'system')
    select session_id, count(x) n_a, count(y) n_b, count(*) filter (x is distinct from y) mismatches, min(case when x is distinct from y then pos end) "first" from a full join b using (session_id, pos) group by 1""")
SH = "list_distinct(list_transform(range(len(t) - 7), lambda i: array_to_string(t[i + 1:i + 8], ' ')))"
register("jn11_contamination", lambda s, d: pr.contamination(pr.shingles(table(s, d, "documents"), "doc_id"), pr.shingles(table(s, d, "benchmark"), "item_id"), pr.shingles(table(s, d, "benchmark").where("item_id = 0"), "item_id")), "", f"""
    with b as (select item_id, unnest({SH}) h from (select item_id, regexp_extract_all(lower(text), '[a-z0-9]+') t from benchmark) where len(t) >= 8), x as (select doc_id, unnest({SH}) h from (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') t from documents) where len(t) >= 8),
    r as (select * from b where h not in (select h from b where item_id = 0)) select doc_id, count(distinct h) shared, count(distinct item_id) items, list_sort(list_distinct(list(h)))[1:3] first_hits from x join r using (h) group by 1""")
register("jn12_candidate_pairs", lambda s, d: pr.candidate_pairs(
    table(s, d, "part").select(F.floor(F.col("p_partkey") / 60).alias("block"), F.col("p_partkey").alias("ia"), F.col("p_name").alias("la"), F.split("p_name", " ").alias("ta")).where("ia % 2 = 0"),  # even keys meet odd ones
    table(s, d, "part").select(F.floor(F.col("p_partkey") / 60).alias("block"), F.col("p_partkey").alias("ib"), F.col("p_name").alias("lb"), F.split("p_name", " ").alias("tb")).where("ib % 2 = 1")), "", """
    with p as (select p_partkey // 60 block, p_partkey i, p_name l, list_distinct(string_split(p_name, ' ')) t from part),
    j as (select a.block, a.i ia, b.i ib, round(0.75 * (len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t)))::double) + 0.25 * (1 - levenshtein(a.l, b.l) / greatest(length(a.l), length(b.l))::double), 6) sim from p a join p b using (block) where a.i % 2 = 0 and b.i % 2 = 1),
    r as (select *, row_number() over (partition by block, ia order by sim desc, ib) x, row_number() over (partition by block, ib order by sim desc, ia) y from j) select block, ia, ib, sim, x <= 2 or y <= 2 or sim >= 0.18 candidate from r""")
register("jn13_reconcile", lambda s, d: pr.reconcile(table(s, d, "orders").select(F.col("o_custkey").alias("id")), table(s, d, "customer").select(F.col("c_custkey").alias("id")).where("id % 3 != 0"), "id"), "", """
    with a as (select o_custkey id, count(*) n_a from orders group by 1), b as (select c_custkey id, count(*) n_b from customer where c_custkey % 3 <> 0 group by 1)
    select id, n_a, n_b, case when n_b is null then 'only_a' when n_a is null then 'only_b' when n_a = n_b then 'match' else 'differs' end state from a full join b using (id)""")
register("jn14_attribute_match", lambda s, d: pr.attribute_match(table(s, d, "supplier").select(F.col("s_suppkey").alias("target_id"), F.col("s_nationkey").cast("int").alias("nation")), table(s, d, "customer").select(F.col("c_custkey").alias("record_id"), F.col("c_nationkey").alias("nation")), ["nation"]), "", """
    with t as (select s_suppkey target_id, s_nationkey nation, row_number() over (partition by s_nationkey order by s_suppkey) j from supplier),
    p as (select c_custkey record_id, c_nationkey nation, ceil(row_number() over (partition by c_nationkey order by md5(c_custkey::varchar), c_custkey) / 2.0) j, count(*) over (partition by c_nationkey) pool from customer)
    select target_id, coalesce(list_sort(list(record_id) filter (record_id is not null)), []) records, max(pool) pool, count(record_id) < 2 short from t left join p using (nation, j) group by 1""")
WANT, ALIAS = [("error",), ("click",), ("views",), ("buys",), ("none",)], [("views", "viewed", 1), ("views", "view", 2), ("buys", "purchase", 1)]
register("jn15_metric_mapping", lambda s, d: pr.metric_mapping(s.createDataFrame(WANT, "name string"), table(s, d, "events").groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("value")), s.createDataFrame(ALIAS, "name string, alias string, priority int")), "", """
    with h as (select event_type metric, avg(value) v from events group by 1), w as (select unnest(['error', 'click', 'views', 'buys', 'none']) "name"), a as (select * from (values ('views', 'viewed', 1), ('views', 'view', 2), ('buys', 'purchase', 1)) t(nm, al, pr)),
    b as (select nm, arg_min(v, pr) v, arg_min(al, pr) via from a join h on al = metric group by 1) select "name", round(coalesce(h.v, b.v), 6) "value", case when h.v is not null then 'exact' when b.v is not null then 'alias:' || via else 'none' end "source" from w left join h on metric = "name" left join b on nm = "name" """)
