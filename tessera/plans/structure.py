"""Structural queries over sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import f1, r6, ratio
from ..operators import structure as st
from ..sources.adapters import panel, turns
from .registry import register

KINDS = {"ask": r"\?", "thank": "merci|danke|gracias|thank", "probe": "the |die |la "}

register("prj02_window_counts", lambda s, d: st.window_counts(turns(s, d)), "turns", """
    select session_id, sum(n_words) words, count(*) filter ("role" = 'participant' and n_words > 0) participant_turns,
    count(*) filter ("role" = 'moderator' and n_words > 0) moderator_turns, count(*) filter (n_words > 0) included, count(*) filter (n_words = 0) skipped from turns group by 1""")

register("agg01_turn_lengths", lambda s, d: st.turn_lengths(panel(s, d)), "panel", """
    w as (select session_id, n_words from panel where "role" = 'participant' and n_words > 0),
    l as (select session_id, count(*) n, quantile_cont(n_words, 0.5) median_words, list(n_words order by n_words) x, round(avg((n_words < 10)::int), 6) under_10,
        round(avg((n_words < 25)::int), 6) under_25, round(avg((n_words < 50)::int), 6) under_50 from w group by 1),
    h as (select *, 0.25::double * (n + 1) a, 0.75::double * (n + 1) b from l)
    select session_id, n, median_words, under_10, under_25, under_50, case when n >= 4 then round(
        (x[floor(b)::int] + (x[least(floor(b)::int + 1, n)] - x[floor(b)::int]) * (b - floor(b))) - (x[floor(a)::int] + (x[least(floor(a)::int + 1, n)] - x[floor(a)::int]) * (a - floor(a))), 6) end iqr from h""")

SPEAKERS = """t as (select session_id, speaker_id, count(*) turns, sum(n_words)::bigint words from panel where "role" = 'participant' group by 1, 2)"""

register("agg02_gini", lambda s, d: st.gini(st.speaker_totals(panel(s, d)), ["session_id"], "words"), "panel", SPEAKERS + """,
    r as (select *, row_number() over (partition by session_id order by words) i from t)
    select session_id, count(*) members, round(case when count(*) >= 2 and sum(words) > 0 then (2 * sum(i * words) - (count(*) + 1) * sum(words)) / (count(*) * sum(words))::double end, 6) gini from r group by 1""")

register("agg03_moderator_shares", lambda s, d: st.moderator_shares(turns(s, d)), "turns", """
    select session_id, round(count(*) filter ("role" = 'moderator') / count(*)::double, 6) turn_share,
    round(sum(case when "role" = 'moderator' then n_words else 0 end) / nullif(sum(n_words), 0)::double, 6) word_share from turns where "role" is not null group by 1""")

register("agg04_adjacency", lambda s, d: st.adjacency(panel(s, d)), "panel", """
    l as (select *, lag("role") over w r, lag(speaker_id) over w p from panel window w as (partition by session_id order by turn_index))
    select session_id, round(count(*) filter ("role" = 'participant' and r = 'participant') / nullif(count(*) - 1, 0)::double, 6) adjacency,
    round(count(*) filter ("role" = 'participant' and r = 'participant' and p <> speaker_id) / nullif(count(*) filter ("role" = 'participant'), 0)::double, 6) cross_speaker from l group by 1""")

CHAINS = """i as (select *, sum(case when "role" = 'moderator' then 1 else 0 end) over (partition by session_id order by turn_index rows unbounded preceding) island from panel),
    c as (select session_id, island, count(*) depth from i where "role" = 'participant' group by 1, 2)"""

register("agg05_chain_depth", lambda s, d: st.chain_depth(panel(s, d)), "panel", CHAINS + """
    select session_id, round(avg(depth), 6) mean_depth, max(depth) max_depth, count(*) n_chains, round(sum(case when depth >= 3 then depth else 0 end) / sum(depth)::double, 6) in_3_plus,
    round(sum(case when depth >= 5 then depth else 0 end) / sum(depth)::double, 6) in_5_plus from c group by 1""")

register("agg06_distributions", lambda s, d: st.distributions(panel(s, d)), "panel", SPEAKERS + ", " + CHAINS + """
    select session_id, 'words_per_turn' distribution_id, turn_index::varchar element_label, n_words::double "value" from panel where "role" = 'participant'
    union all select session_id, 'speaker_turns', speaker_id, turns from t union all select session_id, 'speaker_words', speaker_id, words from t
    union all select session_id, 'chain_depth', island::varchar, depth from c""")

register("agg07_entropy", lambda s, d: st.entropy(panel(s, d)), "panel", SPEAKERS + """,
    p as (select session_id, turns / (sum(turns) over (partition by session_id))::double p from t)
    select session_id, count(*) speakers, round(-sum(p * log2(p)) + 0.0, 6) bits, round(case when count(*) > 1 then -sum(p * log2(p)) / log2(count(*)) end, 6) normalised from p group by 1""")

register("agg08_process", lambda s, d: st.process(panel(s, d)), "panel", SPEAKERS + """,
    n as (select *, case when lag(speaker_id) over (partition by session_id order by turn_index) = speaker_id then 0 else 1 end b from panel),
    g as (select *, sum(b) over (partition by session_id order by turn_index rows unbounded preceding) run from n),
    r as (select session_id, max(c) longest_run from (select session_id, run, count(*) c from g group by 1, 2) group by 1),
    m as (select session_id, max(turns) most, sum(turns)::bigint participant_turns, count(*) participants from t group by 1),
    o as (select session_id, round(avg(n_words), 6) avg_words, min(n_words) min_words, max(n_words) max_words from panel where "role" = 'participant' group by 1)
    select session_id, longest_run, participant_turns, participants, avg_words, min_words, max_words, case when participant_turns < 3 then 'insufficient_sample' else 'ok' end status,
    participants > 1 and most / participant_turns::double >= 0.6 imbalanced from r join m using (session_id) join o using (session_id)""")

register("agg09_actions", lambda s, d: st.actions(turns(s, d), KINDS), "turns", r"""
    k as (select session_id, case when regexp_matches(lower(text), '\?') then 'ask' when regexp_matches(lower(text), 'merci|danke|gracias|thank') then 'thank' when regexp_matches(lower(text), 'the |die |la ') then 'probe' else 'other' end "action" from turns where "role" = 'moderator'),
    c as (select session_id, "action", count(*) n from k group by 1, 2) select *, round(n / (sum(n) over (partition by session_id))::double, 6) rate from c""")

register("agg10_drift_episodes", lambda s, d: st.drift_episodes(panel(s, d), F.col("n_words") < 300), "panel", """
    p as (select *, n_words < 300 off, sum(case when "role" = 'moderator' then 1 else 0 end) over (partition by session_id order by turn_index rows unbounded preceding) q from panel),
    o as (select *, sum(case when off then 0 else 1 end) over (partition by session_id order by turn_index rows unbounded preceding) brk from p where "role" = 'participant'),
    r as (select session_id, brk, count(*) length, min(turn_index) "start", max(turn_index) stop, max(q) q from o where off group by 1, 2 having count(*) >= 3)
    select r.session_id, r."start", r.stop, r.length, coalesce(bool_or(contains(p.text, '?')), false) redirected from r left join p on p.session_id = r.session_id and p."role" = 'moderator' and p.q between r.q + 1 and r.q + 2 group by all""")

register("agg15_binned_shares", lambda s, d: st.binned_shares(panel(s, d)), "panel", """
    e as (select unnest([0, 10, 25, 50, 100, 200, 250, 300]) a, unnest([9, 24, 49, 99, 199, 249, 299, 1000000000]) b, unnest(['0-9', '10-24', '25-49', '50-99', '100-199', '200-249', '250-299', '300+']) bin),
    s as (select distinct "condition", group_id, session_id from panel where "role" = 'participant'),
    n as (select session_id, bin, count(*) c from panel join e on n_words between a and b where "role" = 'participant' group by 1, 2),
    t as (select session_id, sum(c) total from n group by 1),
    g as (select "condition", group_id, s.session_id, e.bin, coalesce(c, 0) / total::double share from s cross join e join t using (session_id) left join n on n.session_id = s.session_id and n.bin = e.bin),
    h as (select "condition", group_id, bin, avg(share) share from g group by 1, 2, 3)
    select "condition", bin, round(avg(share), 6) mean_share, round(stddev_samp(share), 6) sd_share, count(*) "groups" from h group by 1, 2""")

register("agg16_location", lambda s, d: st.location(st.chains(panel(s, d)).join(panel(s, d).select("session_id", "condition", "group_id").distinct(), "session_id").withColumnRenamed("depth", "value"), F.percentile("value", F.lit(0.5)), "median_depth"), "panel", CHAINS + """,
    k as (select distinct session_id, "condition", group_id from panel), s as (select "condition", group_id, session_id, quantile_cont(depth, 0.5) m from c join k using (session_id) group by 1, 2, 3),
    g as (select "condition", group_id, avg(m) m from s group by 1, 2) select "condition", round(avg(m), 6) median_depth, count(*) "groups" from g group by 1""")

METRIC = """m as (select "condition", group_id, session_id, avg(n_words) "value" from panel where "role" = 'participant' group by 1, 2, 3)"""


def words_metric(s, d):
    return panel(s, d).where("role = 'participant'").groupBy("condition", "group_id", "session_id").agg(F.avg("n_words").alias("value"))


register("agg17_variation", lambda s, d: st.variation(words_metric(s, d)), "panel", METRIC + """,
    g as (select "condition", group_id, avg("value") v from m group by 1, 2)
    select "condition", round(avg(v), 6) mean, round(stddev_samp(v), 6) sd, round(stddev_samp(v) / avg(v), 6) cv, round(max(v) - min(v), 6) "range" from g group by 1""")

register("agg18_sliced_rates", lambda s, d: st.sliced_rates(turns(s, d), F.col("n_words") < 50, ["condition", "role", "section"]), "turns", """
    select "condition", "role", section, count(*) n, round(avg((n_words < 50)::int), 6) rate, grouping_id("condition", "role", section) "level" from turns group by cube("condition", "role", section)""")

register("agg19_envelope", lambda s, d: st.envelope(words_metric(s, d)), "panel", METRIC + """,
    s as (select "condition", avg("value") mean, min("value") lo, max("value") hi from m group by 1), r as (select lo rl, hi rh from s where "condition" = 'human')
    select "condition", round(mean, 6) mean, round(lo, 6) lo, round(hi, 6) hi, case when lo >= rl and hi <= rh then 'yes' when mean between rl and rh then 'partial' else 'no' end inside from s cross join r""")

register("agg20_length_ratio", lambda s, d: st.length_ratio(panel(s, d)), "panel", """
    w as (select "condition", group_id, session_id, sum(n_words) words from panel group by 1, 2, 3),
    r as (select group_id, avg(words) ref from w where "condition" = 'human' group by 1), q as (select group_id, floor(quantile_cont(n_words, 0.5))::bigint width from panel where "condition" = 'human' and "role" = 'participant' group by 1)
    select session_id, w.group_id, "condition", round(words / ref, 6) ratio, width from w left join r using (group_id) left join q using (group_id) where "condition" <> 'human'""")


def _rates(s, d):
    part = F.count_if(F.coalesce(st.is_part(), F.lit(False)))
    df = turns(s, d).groupBy("session_id").agg(ratio(part, F.count(F.lit(1))).alias("p"), ratio(F.count_if(F.coalesce(st.is_part() & (F.col("n_words") > 40), F.lit(False))), F.count_if(F.coalesce(st.is_mod(), F.lit(False)))).alias("r"))
    return df.select("session_id", r6("p").alias("precision"), r6("r").alias("recall"), r6(f1("r", "p")).alias("f1"))


register("agg14_undefined_safe_ratios", _rates, "turns", """
    c as (select session_id, count(*) filter ("role" = 'participant') / count(*)::double p, count(*) filter ("role" = 'participant' and n_words > 40) / nullif(count(*) filter ("role" = 'moderator'), 0)::double r from turns group by 1)
    select session_id, round(p, 6) "precision", round(r, 6) recall, round(case when r + p = 0 then 0 else 2 * r * p / (r + p) end, 6) f1 from c""")
