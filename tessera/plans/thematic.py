"""Queries over coded evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import segments as sg
from ..operators import thematic as th
from ..sources.adapters import panel, presence, table, turns
from .registry import register
from .segments import BUDGET

CELL = '"condition", group_id, replicate'


def quotes(s, d):
    """Slices of participant and moderator turns: true, with other case, altered, from another speaker, empty, of a missing turn."""
    t, k = turns(s, d), F.col("turn_index") % 6
    q = F.array_join(F.slice(F.split("text", r"\s+"), 2, 5), " ")
    return t.select("session_id", F.when(k == 5, F.col("turn_index") + 100).otherwise(F.col("turn_index")).alias("turn_index"), F.when(k == 3, "nobody").otherwise(F.col("speaker_id")).alias("speaker"), F.when(k == 1, F.translate(q, "aeiou", "AEIOU")).when(k == 2, F.concat(q, F.lit(" zz"))).when(k == 4, "").otherwise(q).alias("quote"), F.concat(F.lit("C"), (F.col("n_words") % 4).cast("string")).alias("code"))


def verified(s, d):
    return th.verify_quotes(quotes(s, d), turns(s, d))


NORM = r"""regexp_replace(lower(trim(regexp_replace(replace(translate({0}, '‘’“”–— ', '''''""-- '), '…', '...'), '\s+', ' ', 'g'))), '^[.,;:!?"'' -]+|[.,;:!?"'' -]+$', '', 'g')"""
VER = rf"""q as (select session_id, case when turn_index % 6 = 5 then turn_index + 100 else turn_index end turn_index, case when turn_index % 6 = 3 then 'nobody' else speaker_id end speaker,
    array_to_string((string_split_regex(text, '\s+'))[2:6], ' ') z, turn_index % 6 k, 'C' || (n_words % 4) code from turns), q2 as (select *, case k when 1 then translate(z, 'aeiou', 'AEIOU') when 2 then z || ' zz' when 4 then '' else z end quote from q),
    ver as (select q2.session_id, code, q2.turn_index, speaker, case when trim(coalesce(quote, '')) = '' then 'no_quote' when t.session_id is null then 'no_turn' when not (contains(text, quote) or contains({NORM.format('text')}, {NORM.format('quote')})) then 'not_in_turn'
    when "role" = 'moderator' then 'moderator' when speaker <> speaker_id then 'speaker_mismatch' when contains(text, quote) then 'raw' else 'normalised' end verdict from q2 left join turns t on t.session_id = q2.session_id and t.turn_index = q2.turn_index)"""
register("thm02_verify_quotes", verified, "turns", VER + " select * from ver")
register("thm01_coded_presence", lambda s, d: th.coded_presence(verified(s, d), turns(s, d).groupBy("session_id").agg(F.count_distinct("speaker_id").alias("participants"))), "turns", VER + """,
    g as (select session_id, code, count(*) qn, count(*) filter (verdict in ('raw', 'normalised')) vn, coalesce(list_sort(list_distinct(list(speaker) filter (verdict in ('raw', 'normalised')))), []) voiced_by from ver group by 1, 2), p as (select session_id, count(distinct speaker_id) p from turns group by 1)
    select session_id, code, vn > 0 present, voiced_by, round(len(voiced_by) / p::double, 6) reach, round(vn / qn::double, 6) validity from g join p using (session_id)""")


def coding(s, d):
    return turns(s, d).select("session_id", F.col("turn_index").alias("item"), F.when(F.col("turn_index") % 4 == 3, "odd").when(F.col("turn_index") % 2 == 0, "agree").otherwise("state").alias("label"), (F.col("turn_index") + F.col("n_words") % 3).alias("evidence"), F.when(F.col("n_words") % 2 == 0, F.col("turn_index")).alias("target"))


register("thm03_coding_failures", lambda s, d: th.coding_failures(coding(s, d), turns(s, d), ["agree", "state"], ["agree"]), "turns", """
    c as (select session_id, turn_index item, case when turn_index % 4 = 3 then 'odd' when turn_index % 2 = 0 then 'agree' else 'state' end lb, turn_index + n_words % 3 ev, case when n_words % 2 = 0 then turn_index end tg from turns),
    f as (select c.session_id, item, lb "label", unnest(list_filter([case when lb not in ('agree', 'state') then 'unknown_label' end, case when t.session_id is null then 'no_evidence' end, case when lb = 'agree' and tg is null then 'no_target' end], lambda x: x is not null)) failure
    from c left join turns t on t.session_id = c.session_id and t.turn_index = c.ev) select * from f""")
SCORES = """p as (select distinct "condition", group_id, replicate, {0} code from presence where present), r as (select group_id, code from p where "condition" = 'BUILDING'), nr as (select group_id, count(*) n_ref from r group by 1),
    g as (select p."condition", p.group_id, replicate, count(*) n_gen, count(r.code) shared from p left join r on r.group_id = p.group_id and r.code = p.code where p."condition" <> 'BUILDING' group by 1, 2, 3),
    sc as (select *, shared / n_ref::double rc, shared / n_gen::double pc from g left join nr using (group_id))"""
SEL = """ select "condition", group_id, replicate, n_gen, n_ref, shared, round(rc, 6) recall, round(pc, 6) "precision", round(case when rc + pc = 0 then 0 else 2 * rc * pc / (rc + pc) end, 6) f1 from sc"""
register("thm04_overlap_scores", lambda s, d: th.overlap_scores(presence(s, d), "BUILDING"), "presence", SCORES.format("code") + SEL)
register("thm04_parent_scores", lambda s, d: th.overlap_scores(presence(s, d), "BUILDING", F.substring("code", 1, 7)), "presence", SCORES.format("substr(code, 1, 7)") + SEL)
register("thm05_reach", lambda s, d: th.reach(presence(s, d)), "presence", f"select {CELL}, count(*) codes, round(avg(voiced / participants::double), 6) mean_reach from presence where present group by 1, 2, 3")
register("thm05_reach_shared", lambda s, d: th.reach(presence(s, d), "BUILDING"), "presence", f"""p as (select * from presence where present), q as (select p.* from p semi join (select group_id, code from p where "condition" = 'BUILDING') r on r.group_id = p.group_id and r.code = p.code)
    select {CELL}, count(*) codes, round(avg(voiced / participants::double), 6) mean_reach from q group by 1, 2, 3""")
GRID = f"""c as (select distinct {CELL} from presence), k as (select distinct code from presence), g as (select c.*, k.code, p.voiced / p.participants::double v from c cross join k left join (select * from presence where present) p on p."condition" = c."condition" and p.group_id = c.group_id and p.replicate = c.replicate and p.code = k.code)"""
register("thm06_presence_grid", lambda s, d: th.presence_grid(presence(s, d)), "presence", GRID + f" select {CELL}, code, v is not null present, round(v, 6) reach from g")
register("thm07_recurrence", lambda s, d: th.recurrence(presence(s, d)), "presence", """
    n as (select "condition", replicate, code, count(distinct group_id) c from presence where present group by 1, 2, 3), g as (select x."condition", x.replicate, k.code, coalesce(c, 0) c from (select distinct "condition", replicate from presence) x cross join (select distinct code from presence) k left join n on n."condition" = x."condition" and n.replicate = x.replicate and n.code = k.code)
    select "condition", code, min(c) least, max(c) most, max(c) = 0 never from g group by 1, 2""")
register("thm08_accumulation", lambda s, d: th.accumulation(presence(s, d)), "presence", """
    p as (select distinct "condition", replicate, group_id, code from presence where present), n as (select "condition", replicate, count(distinct group_id) n from p group by 1, 2), m as (select "condition", replicate, code, count(*) m from p group by 1, 2, 3),
    j as (select *, unnest(range(1, n + 1)) k from m join n using ("condition", replicate)),
    e as (select "condition", replicate, k, sum(1 - list_product(list_transform(range(k), lambda i: greatest(n - m - i, 0) / (n - i)::double))) e from j group by 1, 2, 3)
    select "condition", replicate, k, round(e, 6) expected, round(e - coalesce(lag(e) over (partition by "condition", replicate order by k), 0), 6) gain from e""")
ENV = """g0 as (select "condition", replicate, group_id, row_number() over (partition by "condition", replicate order by group_id) - 1 i, count(*) over (partition by "condition", replicate) n from (select distinct "condition", replicate, group_id from presence)),
    p as (select distinct "condition", replicate, i, code from presence join g0 using ("condition", replicate, group_id) where present), cr as (select distinct "condition", replicate, n from g0),
    su as (select *, unnest(range(1, 1 << n)) s from cr), co as (select su."condition", su.replicate, n, s, count(distinct code) c from su left join p on p."condition" = su."condition" and p.replicate = su.replicate and (s >> i) & 1 = 1 group by 1, 2, 3, 4),
    kk as (select "condition", replicate, n, bit_count(s)::int k, min(c) least, avg(c) mean, max(c) most from co group by 1, 2, 3, 4),
    ob as (select g0."condition", g0.replicate, g0.i + 1 k, count(distinct p.code) observed from g0 left join p on p."condition" = g0."condition" and p.replicate = g0.replicate and p.i <= g0.i group by 1, 2, 3),
    ga as (select *, round(mean - lag(mean) over (partition by "condition", replicate order by k), 4) gain from kk join ob using ("condition", replicate, k)), pl as (select "condition", replicate, coalesce(max(case when gain >= 0.5 then k end), 1) l from ga group by 1, 2)"""
register("thm08_envelope", lambda s, d: th.accumulation_envelope(presence(s, d)), "presence", ENV + """
    select "condition", replicate, k, least, round(mean, 6) mean, most, observed, gain, case when l < n then l end plateau from ga join pl using ("condition", replicate)""")
register("thm08_replicates", lambda s, d: th.accumulation_summary(presence(s, d)), "presence", """
    f as (select "condition", replicate, count(distinct case when present then code end) f from presence group by 1, 2), b as (select count(distinct code) b from presence), u as (select "condition", count(distinct case when present then code end) anywhere from presence group by 1)
    select "condition", count(*) replicates, round(avg(f), 6) mean, min(f) least, max(f) most, any_value(anywhere) anywhere, round(any_value(anywhere) / any_value(b)::double, 6) of_codebook from f join u using ("condition") cross join b group by 1""")
register("thm09_first_seen", lambda s, d: th.first_seen(table(s, d, "orders").select((F.col("o_custkey") % 10).alias("series"), F.to_date("o_orderdate").alias("unit"), (F.col("o_custkey") % 300).alias("cluster"))), "", """
    with r as (select o_custkey % 10 series, o_orderdate::date unit, o_custkey % 300 cluster from orders), f as (select series, unit, count(*) new from (select series, cluster, min(unit) unit from r group by 1, 2) group by 1, 2),
    u as (select series, unit, coalesce(new, 0) new from (select distinct series, unit from r) left join f using (series, unit)), c as (select *, sum(new) over (partition by series order by unit rows unbounded preceding)::bigint cumulative from u)
    select *, round(cumulative / (max(cumulative) over (partition by series))::double, 6) "share" from c""")


def evidence(s, d):
    return panel(s, d).where("role = 'participant'").select("session_id", "turn_index", (F.col("n_words") % 12).alias("code"))


EVID = """ev as (select session_id, turn_index, n_words % 12 code from panel where "role" = 'participant')"""
register("thm10_coverage_by_words", lambda s, d: th.coverage_by_words(panel(s, d), evidence(s, d)), "panel", EVID + """,
    f as (select session_id, turn_index, count(*) n from (select session_id, code, min(turn_index) turn_index from ev group by 1, 2) group by 1, 2)
    select session_id, turn_index, sum(n_words) over w::bigint words, sum(coalesce(n, 0)) over w::bigint codes from panel left join f using (session_id, turn_index) window w as (partition by session_id order by turn_index rows unbounded preceding)""".replace("over w::bigint", "over w"))
register("thm11_excerpt_recall", lambda s, d: th.excerpt_recall(sg.word_budget(panel(s, d), 1500), evidence(s, d), evidence(s, d).where("code < 8").select("session_id", "code").distinct()), "panel", BUDGET + ", " + EVID + """,
    rf as (select distinct session_id, code from ev where code < 8), nr as (select session_id, count(*) n_ref from rf group by 1), got as (select distinct x.session_id, x."start", ev.code from exc x join ev on ev.session_id = x.session_id and ev.turn_index between x."start" and x.stop),
    sc as (select g.session_id, g."start", count(*) n, count(rf.code) hit from got g left join rf on rf.session_id = g.session_id and rf.code = g.code group by 1, 2)
    select session_id, count(*) k, round(avg(hit / n_ref::double), 6) recall, round(stddev_samp(hit / n_ref::double), 6) recall_sd, round(stddev_samp(hit / n::double), 6) precision_sd, round(min(hit / n_ref::double), 6) recall_min, round(max(hit / n_ref::double), 6) recall_max, round(avg(hit / n::double), 6) "precision" from sc join nr using (session_id) group by 1""")
register("thm12_tri_state", lambda s, d: th.tri_state(presence(s, d), presence(s, d).select(*th.CELL).distinct().where("not (group_id = 2 and replicate = 3)")), "presence", GRID + f"""
    select {CELL}, code, case when group_id = 2 and replicate = 3 then 'UNMEASURED' when v is null then 'TRUE_ABSENCE' else 'PRESENT' end state, round(case when group_id = 2 and replicate = 3 then null when v is null then 0 else v end, 6) score from g""")
register("thm16_set_differences", lambda s, d: th.set_differences(presence(s, d), "BUILDING"), "presence", """
    r as (select distinct group_id, code from presence where present and "condition" = 'BUILDING'), g as (select distinct group_id, code from presence where present and "condition" <> 'BUILDING')
    select *, 'missed' kind from (select * from r except select * from g) union all select *, 'emergent' from (select * from g except select * from r) union all select *, 'shared' from (select * from r intersect select * from g)""")


def part_pairs(s, d):
    """Even part keys against odd ones, in blocks of 60 neighbouring keys: blocks don't grow with the table. A part of 20,000 keys gives about 300,000 pairs."""
    p = table(s, d, "part").withColumn("block", F.floor(F.col("p_partkey") / 60))
    p = p.repartition(1 + p.count() // 20_000, "block")
    a = p.where("p_partkey % 2 = 0").select("block", F.col("p_partkey").alias("a"), F.col("p_retailprice").alias("x"), F.col("p_size").alias("sa"))
    b = p.where("p_partkey % 2 = 1").select("block", F.col("p_partkey").alias("b"), F.col("p_retailprice").alias("y"), F.col("p_size").alias("sb"))
    return a.join(b.hint("merge"), "block").withColumns({"sim": F.round(1 / (1 + F.abs(F.col("x") - F.col("y"))), 6), "judged": F.abs(F.col("sa") - F.col("sb")) < 5})


PP = """pp as (select a.p_partkey // 60 block, a.p_partkey a, b.p_partkey b, round(1 / (1 + abs(a.p_retailprice - b.p_retailprice)), 6) sim, abs(a.p_size - b.p_size) < 5 judged, abs(a.p_size - b.p_size) ds from part a join part b on a.p_partkey // 60 = b.p_partkey // 60 where a.p_partkey % 2 = 0 and b.p_partkey % 2 = 1)"""
register("thm17_greedy_matching", lambda s, d: th.greedy_matching(part_pairs(s, d).select("block", "a", "b", "sim")))
register("thm18_judge_disagreement", lambda s, d: th.judge_disagreement(part_pairs(s, d).select("block", "a", "b", "sim", "judged"), 0.05, 0.3), "", f"with {PP} select block, a, b, sim, judged, case when judged then 'yes_but_dissimilar' else 'no_but_similar' end kind from pp where (judged and sim < 0.05) or (not judged and sim > 0.3)")
register("thm19_pair_states", lambda s, d: th.pair_states(part_pairs(s, d).withColumn("decision", F.when(F.abs(F.col("sa") - F.col("sb")) < 1, "yes").when(F.col("judged") & (F.col("b") % 4 == 0), "unsure").otherwise("no"))), "", f"""with {PP},
    i as (select block, a, case when bool_or(ds < 1) then 'confirmed' when bool_or(judged and b % 4 = 0 and ds >= 1) then 'unresolved' else 'not' end state from pp group by 1, 2)
    select block, count(*) items, count(*) filter (state = 'confirmed') confirmed, count(*) filter (state = 'unresolved') unresolved, round(count(*) filter (state = 'confirmed') / count(*)::double, 6) "lower", round(count(*) filter (state <> 'not') / count(*)::double, 6) "upper" from i group by rollup(block)""")


def repetitions(s, d):
    return table(s, d, "lineitem").where("l_linenumber <= 2").select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("repetition"), F.col("l_returnflag").alias("category"), (F.col("l_discount") * 10).alias("confidence"), F.col("l_linestatus").alias("family"))


REPS = "reps as (select l_orderkey item, l_linenumber repetition, l_returnflag category, l_discount * 10 confidence, l_linestatus family from lineitem where l_linenumber <= 2)"
register("thm20_reconcile_repetitions", lambda s, d: th.reconcile_repetitions(repetitions(s, d)), "", f"with {REPS}, g as (select item, max(case when repetition = 1 then category end) c1, max(case when repetition = 2 then category end) c2, min(confidence) lo from reps group by 1) select item, c1, c2, case when coalesce(c1 = c2 and lo >= 0.5, false) then c1 else 'unresolved' end verdict from g")
register("thm21_assignment_stability", lambda s, d: th.assignment_stability(table(s, d, "lineitem").select(F.col("l_orderkey").alias("item"), (F.col("l_linenumber") % 3).alias("pass"), F.when(F.col("l_quantity") > 49, "UNCERTAIN").otherwise(F.col("l_returnflag")).alias("value")), 3), "", """
    with r as (select l_orderkey item, l_linenumber % 3 p, case when l_quantity > 49 then 'UNCERTAIN' else l_returnflag end v from lineitem) select item, count(distinct p) passes, count(distinct v) "values", count(distinct p) = 3 and count(distinct v) = 1 and not bool_or(v = 'UNCERTAIN') stable from r group by 1""")
register("thm22_partition_alignment", lambda s, d: th.partition_alignment(table(s, d, "customer").select(F.col("c_custkey").alias("item"), F.col("c_mktsegment").alias("a"), (F.col("c_nationkey") % 6).alias("b"))), "", """
    with n as (select c_mktsegment a, c_nationkey % 6 b, count(*) n from customer group by 1, 2), x as (select (select sum(n * (n - 1) / 2) from n) "both", (select sum(n * (n - 1) / 2) from (select a, sum(n) n from n group by 1)) ia, (select sum(n * (n - 1) / 2) from (select b, sum(n) n from n group by 1)) ib)
    select "both"::double "both", (ia - "both")::double only_a, (ib - "both")::double only_b, round("both" / (ia + ib - "both")::double, 6) jaccard from x""")
register("thm23_cluster_presence", lambda s, d: th.cluster_presence(table(s, d, "orders").select((F.col("o_custkey") % 200).alias("cluster"), (F.col("o_orderkey") % 20).alias("unit"), F.col("o_orderstatus").alias("rater"))), "", """
    with g as (select o_custkey % 200 cluster, o_orderkey % 20 unit, list_sort(list_distinct(list(o_orderstatus))) r from orders group by 1, 2)
    select cluster, min(unit) first_unit, count(*) units, count(*) filter (len(r) > 1) units_shared, list_sort(list_distinct(flatten(list(r)))) raters, len(list_distinct(flatten(list(r)))) = 1 exclusive from g group by 1""")
register("thm24_prevalence_bands", lambda s, d: th.prevalence_bands(presence(s, d)), "presence", """
    n as (select "condition", code, count(*) sessions from presence where present group by 1, 2) select "condition", sessions, list_sort(list(code)) codes, dense_rank() over (partition by "condition" order by sessions desc) band from n group by 1, 2""")

def borders(s, d):
    """Rank-10 borders read two ways: LOWER drops codes voiced by fewer than four in ten participants, UPPER adds absent ones voiced by two or more."""
    p = presence(s, d).select(*th.CELL, "code", "present", "voiced", "participants")
    lower, upper = p.where("present and voiced * 10 < participants * 4").withColumn("present", F.lit(False)), p.where("not present and voiced >= 2").withColumn("present", F.lit(True))
    return lower.withColumn("scenario", F.lit("LOWER")).unionByName(upper.withColumn("scenario", F.lit("UPPER"))).drop("voiced", "participants")


SCN = """sn as (select unnest(['BASE', 'LOWER', 'UPPER']) scenario), un as (select scenario, p.*, case when scenario = 'LOWER' and present and voiced * 10 < participants * 4 then false when scenario = 'UPPER' and not present and voiced >= 2 then true else present end pr from presence p cross join sn)"""
register("thm25_scenarios", lambda s, d: th.scenario_recurrence(th.scenarios(presence(s, d), borders(s, d), ["LOWER", "UPPER"])), "presence", SCN + """,
    c as (select scenario, "condition", count(*) filter (pr <> present) overridden, count(*) filter (pr) present, count(distinct case when pr then code end) codes, round(avg(case when pr then voiced / participants::double end), 6) mean_reach from un group by 1, 2),
    h as (select scenario, "condition", round(avg(g), 6) mean_groups from (select scenario, "condition", replicate, code, count(distinct case when pr then group_id end) g from un group by 1, 2, 3, 4) group by 1, 2) select * from c join h using (scenario, "condition")""")

register("thm25_treatments", lambda s, d: th.treatments(presence(s, d)), "presence", """
    t as (select *, case treatment when 'LOWER' then present and voiced > 1 when 'UPPER' then present or voiced >= 2 else present end p from presence cross join (select unnest(['LOWER', 'MID', 'UPPER']) treatment))
    select "condition", treatment, count(*) filter (p) present, round(avg(case when p then voiced / participants::double end), 6) mean_reach from t group by 1, 2""")
raters = lambda s, d: table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left").select(F.col("lang").alias("code"), (F.col("doc_id") % 5 == 0).alias("control"), F.contains("text", F.lit(".")).cast("int").alias("a"), F.col("quality").alias("b"))
register("thm26_cross_rater", lambda s, d: th.cross_rater(raters(s, d), 0.8, 0.7), "", """
    with r as (select lang code, doc_id % 5 = 0 k, contains(text, '.')::int a, quality b from documents left join labels using (doc_id)), c as (select code, avg((a = b)::int) ag from r where k group by 1),
    t as (select count(*) filter (a = b) / count(b)::double p, count(b)::double n from r where k), o as (select coalesce((p + 1.96::double * 1.96 / (2 * n) - 1.96::double * sqrt(p * (1 - p) / n + 1.96::double * 1.96 / (4 * n * n))) / (1 + 1.96::double * 1.96 / n) >= 0.7, false) op from t),
    j as (select code, case when b is null then case when a = 1 then 'present_unchecked' else 'absent_unchecked' end when a = b then case when a = 1 then 'both_present' else 'both_absent' end else 'disagree' end "label", op and coalesce(ag >= 0.8, false) and a = b ok from r left join c using (code) cross join o where not k)
    select code, "label", count(*) n, count(*) filter (coalesce(ok, false)) corroborated from j group by 1, 2""")
register("thm26_calibration", lambda s, d: th.calibration_scores(raters(s, d)), "", """
    with r as (select contains(text, '.')::int a, quality b from documents left join labels using (doc_id)), g as (select a original, count(*) n, count(*) filter (b = 1) found, count(*) filter (b = 0) not_found, count(*) filter (b is null) unresolved from r group by 1), k as (select *, case when original = 1 then found else not_found end / n::double p from g),
    h as (select *, (p + 1.96::double * 1.96 / (2 * n)) / (1 + 1.96::double * 1.96 / n) m, 1.96::double * sqrt(p * (1 - p) / n + 1.96::double * 1.96 / (4 * n * n)) / (1 + 1.96::double * 1.96 / n) w from k)
    select original, n, found, not_found, unresolved, round(p, 6) rate, round(greatest(0, m - w), 6) "lower", round(least(1, m + w), 6) "upper" from h""")
register("thm27_extend_taxonomy", lambda s, d: th.extend_taxonomy(table(s, d, "orders").select(F.col("o_orderkey").alias("item"), (F.col("o_custkey") % 150).alias("cluster"), (F.col("o_custkey") % 150 > 98).alias("is_new"), (F.col("o_orderkey") % 17 == 0).alias("uncertain")), s.range(100).select(F.col("id").alias("cluster"))), "", """
    with a as (select o_custkey % 150 cluster, o_custkey % 150 > 98 nw, o_orderkey % 17 = 0 un from orders), j as (select cluster, case when un then 'uncertain' when nw and cluster < 100 then 'problem_not_new' when not nw and cluster >= 100 then 'problem_unknown' when nw then 'new' else 'known' end kind from a)
    select kind, count(*) items, count(distinct cluster) clusters from j group by 1""")
register("thm28_completeness", lambda s, d: th.completeness(table(s, d, "events").select(F.col("user_id").alias("session_id"), F.get_json_object("props", "$.k").cast("int").alias("code")), s.range(60).select(F.col("id").cast("int").alias("code"))), "", """
    with r as (select user_id session_id, (props->>'$.k')::int code from events), n as (select session_id, code, count(*) n from r group by 1, 2), c as (select session_id, unnest(range(60))::int code, true e from (select distinct session_id from r)),
    g as (select session_id, count(*) filter (n is null) missing, count(*) filter (n > 1) duplicate, count(*) filter (e is null) unexpected from c full join n using (session_id, code) group by 1) select *, case when missing + duplicate + unexpected = 0 then 'complete' else 'incomplete' end status from g""")
register("thm29_absence_strata", lambda s, d: th.absence_strata(presence(s, d)), "presence", GRID + """ select "condition", count(*) filter (v is not null) present, count(*) filter (v is null) absent from g group by 1""")
