"""Lexical, vector and quality queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import lexical as lx
from ..operators import quality as qa
from ..operators import vectors as vc
from ..sources.adapters import calls, panel, table, turns, vectors
from .registry import register

TOK = """tok0 as (select {by}, turn_index, unnest(regexp_extract_all(lower(text), '[a-z]+')) term, generate_subscripts(regexp_extract_all(lower(text), '[a-z]+'), 1) p from {t}),
    tok as (select {by}, term, row_number() over (partition by {by} order by turn_index, p) pos from tok0)"""
register("lex01_diversity", lambda s, d: lx.diversity(lx.token_rows(turns(s, d), ["session_id", "speaker_id"]), ["session_id", "speaker_id"], 50, 100, 200), "turns", TOK.format(by="session_id, speaker_id", t="turns") + """,
    l as (select session_id, speaker_id, list(term order by pos) x from tok group by 1, 2)
    select session_id, speaker_id, len(x) tokens, len(list_distinct(x)) types, round(len(list_distinct(x)) / len(x)::double, 6) ttr, """ + ", ".join(f"case when len(x) >= {w} then round(list_avg(list_transform(range(1, len(x) - {w - 2}), lambda i: len(list_distinct(x[i:i + {w - 1}])))) / {w}, 6) end mattr_{w}" for w in (50, 100, 200)) + " from l")
register("lex02_vocabulary_overlap", lambda s, d: lx.vocabulary_overlap(lx.term_rows(panel(s, d), ["session_id", "speaker_id"])), "panel", """
    v as (select session_id, speaker_id, list_distinct(flatten(list(regexp_extract_all(lower(text), '[a-z]+')))) x from panel group by 1, 2)
    select a.session_id, count(*) pairs, round(avg(len(list_intersect(a.x, b.x)) / len(list_distinct(list_concat(a.x, b.x)))::double), 6) jaccard from v a join v b on a.session_id = b.session_id and a.speaker_id < b.speaker_id where len(a.x) > 0 and len(b.x) > 0 group by 1""")
register("lex03_budgeted_overlap", lambda s, d: lx.budgeted_overlap(turns(s, d).where("role is not null"), 100), "turns", TOK.format(by="session_id, speaker_id", t="""(select * from turns where "role" is not null)""") + """,
    n as (select session_id, speaker_id, count(*) n from tok group by 1, 2), l as (select session_id, count(*) speakers, case when min(n) >= 100 and count(*) > 1 then least(10, min(n) - 99) end windows from n group by 1),
    o as (select n.session_id, speaker_id, i, case when windows = 1 then (n - 100) // 2 else round_even(i * (n - 100) / (windows - 1)::double, 0)::bigint end o from n join l using (session_id), unnest(range(windows)) t(i)),
    c as (select o.session_id, o.i, o.speaker_id, term, count(*) / 100.0::double p from o join tok on tok.session_id = o.session_id and tok.speaker_id = o.speaker_id and pos > o and pos <= o + 100 group by 1, 2, 3, 4),
    h as (select distinct session_id, i, speaker_id from c), q as (select a.session_id, a.i, a.speaker_id, b.speaker_id sb from h a join h b on a.session_id = b.session_id and a.i = b.i and a.speaker_id < b.speaker_id),
    x as (select q.*, term, p from q join c on c.session_id = q.session_id and c.i = q.i and c.speaker_id = q.speaker_id), y as (select q.*, term, p from q join c on c.session_id = q.session_id and c.i = q.i and c.speaker_id = q.sb),
    j as (select session_id, i, speaker_id, sb, coalesce(x.p, 0) x, coalesce(y.p, 0) y from x full join y using (session_id, i, speaker_id, sb, term)),
    g as (select session_id, i, speaker_id, sb, count(*) filter (x > 0 and y > 0) / count(*)::double jac, sqrt(greatest(sum(case when x > 0 then x * log2(x / ((x + y) / 2)) else 0 end + case when y > 0 then y * log2(y / ((x + y) / 2)) else 0 end) / 2, 0)) js, sum(x * y) / sqrt(sum(x * x) * sum(y * y)) cs from j group by 1, 2, 3, 4)
    select l.session_id, any_value(speakers) speakers, any_value(windows) windows, round(avg(jac), 6) jaccard, round(avg(js), 6) js, round(avg(cs), 6) cosine from l left join g on g.session_id = l.session_id group by 1""")
spec = lambda s, d: panel(s, d).withColumn("spec", F.col("section")).withColumn("value", F.col("n_words").cast("double"))
register("lex04_direction", lambda s, d: lx.direction_verdict(spec(s, d), "a", "b"), "panel", """
    m as (select section spec, "condition", group_id, avg(n_words) v from panel group by 1, 2, 3), c as (select spec, "condition", avg(v) v, count(v) n from m group by 1, 2)
    select spec, round(max(v) filter ("condition" = 'a') - max(v) filter ("condition" = 'b'), 6) difference, least(max(n) filter ("condition" = 'a'), max(n) filter ("condition" = 'b')) "groups", max(v) filter ("condition" = 'a') > max(v) filter ("condition" = 'b') a_greater from c group by 1""")


def tfidf(s, d):
    t = turns(s, d).select(F.concat_ws(":", "session_id", "turn_index").alias("doc"), "text")
    return lx.tfidf(lx.terms(t, ["doc"]), "doc").join(turns(s, d).select(F.concat_ws(":", "session_id", "turn_index").alias("doc"), "session_id", "speaker_id", "group_id"), "doc")


TF = """tk as (select session_id, turn_index, speaker_id, group_id, session_id || ':' || turn_index doc, unnest(regexp_extract_all(lower(text), '[a-z]+')) term from turns), tc as (select doc, term, count(*) tf from tk group by 1, 2), dn as (select count(distinct doc) n from tk), dfq as (select term, count(*) df from tc group by 1),
    tw as (select doc, term, tf * (ln((1 + n) / (1 + df)::double) + 1) w from tc join dfq using (term) cross join dn), tv as (select doc, term, w / sqrt(sum(w * w) over (partition by doc)) weight from tw), dm as (select distinct doc, session_id, speaker_id, group_id from tk)"""
register("lex05_tfidf", lambda s, d: tfidf(s, d).select("doc", "term", F.round("weight", 6).alias("weight")), "turns", TF + " select doc, term, round(weight, 6) weight from tv")
register("lex06_speaker_collapse", lambda s, d: lx.speaker_collapse(tfidf(s, d), "session_id", "speaker_id", "doc"), "turns", TF + """,
    v as (select * from tv join dm using (doc)), n as (select session_id, speaker_id, count(distinct doc) n from v group by 1, 2), c as (select session_id, speaker_id, term, sum(weight) / any_value(n) c from v join n using (session_id, speaker_id) group by 1, 2, 3), nm as (select session_id, speaker_id, sqrt(sum(c * c)) nm from c group by 1, 2),
    dt as (select a.session_id, a.speaker_id x, b.speaker_id y, sum(a.c * b.c) dt from c a join c b on a.session_id = b.session_id and a.term = b.term and a.speaker_id < b.speaker_id group by 1, 2, 3),
    bt as (select a.session_id, round(avg(1 - coalesce(dt, 0) / (a.nm * b.nm)), 6) "between" from nm a join nm b on a.session_id = b.session_id and a.speaker_id < b.speaker_id left join dt on dt.session_id = a.session_id and dt.x = a.speaker_id and dt.y = b.speaker_id group by 1),
    o as (select v.session_id, v.speaker_id, doc, sum(weight * c.c) dd from v join c on c.session_id = v.session_id and c.speaker_id = v.speaker_id and c.term = v.term group by 1, 2, 3), wi as (select o.session_id, round(avg(1 - dd / nm), 6) "within" from o join nm on nm.session_id = o.session_id and nm.speaker_id = o.speaker_id group by 1)
    select session_id, "within", "between" from wi join bt using (session_id)""")
register("lex07_group_distance", lambda s, d: lx.mean_pairwise(tfidf(s, d), "group_id", "doc"), "turns", TF + """,
    v as (select * from tv join dm using (doc)), n as (select group_id, count(distinct doc) n from v group by 1), q as (select group_id, sum(x * x) q from (select group_id, term, sum(weight) x from v group by 1, 2) group by 1) select group_id, n, round(1 - (q - n) / (n * (n - 1))::double, 6) distance from n join q using (group_id)""")
register("lex08_recurring_ngrams", lambda s, d: lx.recurring_ngrams(table(s, d, "documents")), "", """
    with t as (select regexp_extract_all(lower(text), '[a-z]+') t from documents), g as (select unnest(list_transform(range(1, len(t) - 2), lambda i: array_to_string(t[i:i + 3], ' '))) ngram from t where len(t) >= 4) select ngram, count(*) n from g group by 1 having count(*) >= 4 order by n desc, ngram limit 25""")
register("lex09_cosine_pairs", lambda s, d: lx.cosine_pairs(tfidf(s, d).drop("speaker_id", "group_id"), "session_id", "doc"), "turns", TF + """,
    v as (select * from tv join dm using (doc)) select a.session_id, a.doc, b.doc other, round(sum(a.weight * b.weight), 6) cosine from v a join v b on a.session_id = b.session_id and a.term = b.term and a.doc < b.doc group by 1, 2, 3""")

register("vec01_pooled", lambda s, d: vc.pooled(vectors(s, d), ["unit", "speaker"]), "vectors", """
    e as (select unit, speaker, unnest(v) x, generate_subscripts(v, 1) - 1 dim from vectors), m as (select unit, speaker, dim, sum(x) x from e group by 1, 2, 3) select unit, speaker, dim, round(x / sqrt(sum(x * x) over (partition by unit, speaker)), 5) "value" from m""")
register("vec02_consecutive", lambda s, d: vc.consecutive(vectors(s, d)), "vectors", """
    l as (select *, lag(v) over w p, lag(speaker) over w ps from vectors window w as (partition by unit order by turn_index)), c as (select *, list_cosine_similarity(v, p) c from l)
    select unit, count(c) pairs, round(avg(c), 6) consecutive, round(avg(case when ps <> speaker then c end), 6) cross_speaker from c group by 1""")
register("vec03_anchoring", lambda s, d: vc.anchoring(vectors(s, d)), "vectors", """
    l as (select *, first_value(v) over w f, first_value(speaker) over w fs, row_number() over w pos, count(*) over (partition by unit) nt from vectors window w as (partition by unit order by turn_index)), c as (select unit, pos, round(list_cosine_similarity(v, f), 9) c from l where speaker <> fs and nt >= 4 qualify count(*) over (partition by unit) >= 3),
    r as (select *, rank() over (partition by unit order by pos)::double rx, rank() over (partition by unit order by c) + (count(*) over (partition by unit, c) - 1) / 2.0::double ry from c)
    select unit, round(avg(c), 6) similarity, count(*) n, case when count(*) < 2 or min(c) = max(c) then null else round(corr(rx, ry), 6) end rho from r group by 1""")
DSP = """e as (select unit, speaker, unnest(v) x, generate_subscripts(v, 1) i from vectors), so as (select unit, speaker, i, sum(x) x from e group by 1, 2, 3), sa as (select unit, i, sum(x) x from so group by 1, 2), cn as (select unit, speaker, count(*) n from vectors group by 1, 2), ca as (select unit, count(*) na from vectors group by 1),
    ot as (select so.unit, so.speaker, list(sa.x - so.x order by so.i) o from so join sa on sa.unit = so.unit and sa.i = so.i group by 1, 2), ow as (select unit, speaker, arg_min(v, turn_index) a, arg_max(v, turn_index) b from vectors group by 1, 2),
    dsp as (select unit, speaker, round(1 - list_cosine_similarity(a, b), 6) + 0.0 moved, list_cosine_similarity(b, o) > list_cosine_similarity(a, o) converges from ow join ot using (unit, speaker) join cn using (unit, speaker) join ca using (unit) where na > n)"""
register("vec04_displacement", lambda s, d: vc.displacement_summary(vectors(s, d)), "vectors", DSP + """,
    rk as (select *, row_number() over (partition by unit order by moved) i from dsp) select unit, round(avg(moved), 6) mean_moved, round(avg(converges::int), 6) converging, count(*) members, round(case when count(*) >= 2 and sum(moved) > 0 then (2 * sum(i * moved) - (count(*) + 1) * sum(moved)) / (count(*) * sum(moved)) end, 6) gini from rk group by 1""")
UV = """u as (select unit, speaker, turn_index, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) v from vectors), ue as (select unit, speaker, unnest(v) x, generate_subscripts(v, 1) i from u), us as (select unit, list(x order by i) s from (select unit, i, sum(x) x from ue group by 1, 2) group by 1)"""
DISP = UV + """, dc as (select unit, turn_index, v, s, 1 - list_inner_product(v, s) / sqrt(list_inner_product(s, s)) c from u join us using (unit)), fr as (select a.unit, round(1 - min(list_inner_product(a.v, b.v)), 6) greatest from u a join u b on a.unit = b.unit and b.turn_index < a.turn_index group by 1),
    di as (select unit, count(*) n, round(case when count(*) > 1 then 1 - (list_inner_product(any_value(s), any_value(s)) - count(*)) / (count(*) * (count(*) - 1)) end, 6) pairwise, round(avg(c), 6) to_centroid, round(avg(c) - arg_max(c, turn_index), 6) closing from dc group by 1),
    ds as (select di.*, greatest from di left join fr using (unit))"""
register("vec05_dispersion", lambda s, d: vc.dispersion(vectors(s, d)), "vectors", DISP + " select * from ds")
register("vec05_dispersion_bands", lambda s, d: vc.dispersion_bands(vc.dispersion(vectors(s, d)), [(1, 10), (5, 20), (15, 200)]), "vectors", DISP + """, bd as (select * from (values (1, 10), (5, 20), (15, 200)) t(low, high))
    select low, high, count(*) units, round(avg(pairwise), 6) pairwise, round(avg(greatest), 6) greatest, round(avg(to_centroid), 6) to_centroid, round(avg(closing), 6) closing from ds join bd on n between low and high group by 1, 2""")
register("vec06_redundancy", lambda s, d: vc.redundancy(vectors(s, d)), "vectors", UV + """,
    m as (select a.unit, a.turn_index, max(list_inner_product(a.v, b.v)) m from u a join u b on a.unit = b.unit and b.turn_index < a.turn_index group by 1, 2) select unit, count(*) turns, round(avg(m), 6) mean_max, round(avg((m >= 0.7)::int), 6) redundant from m group by 1""")
WHOLE = "whole as (select (split_part(unit, ':', 1)::int % 2)::varchar unit, * exclude (unit) from vectors), "
whole = lambda s, d: vectors(s, d).withColumn("unit", (F.split_part("unit", F.lit(":"), F.lit(1)).cast("int") % 2).cast("string"))
register("vec05_dispersion_whole", lambda s, d: vc.dispersion(whole(s, d), 0, 1024), "vectors", (WHOLE + DISP.replace("from vectors", "from whole") + " select * from ds"))
register("vec06_redundancy_whole", lambda s, d: vc.redundancy(whole(s, d), 0.7, 0, 1024), "vectors", (WHOLE + UV.replace("from vectors", "from whole") + """,
    m as (select a.unit, a.turn_index, max(list_inner_product(a.v, b.v)) m from u a join u b on a.unit = b.unit and b.turn_index < a.turn_index group by 1, 2) select unit, count(*) turns, round(avg(m), 6) mean_max, round(avg((m >= 0.7)::int), 6) redundant from m group by 1"""))
register("vec07_differentiation", lambda s, d: vc.differentiation(vectors(s, d)), "vectors", UV + """,
    sp as (select unit, speaker, sum(x * x) q from (select unit, speaker, i, sum(x) x from ue group by 1, 2, 3) group by 1, 2), sn as (select unit, speaker, count(*) n from u group by 1, 2), w as (select unit, sum(q) q, sum(n) n, sum(n * n) n2 from sp join sn using (unit, speaker) group by 1)
    select unit, round((q - n) / nullif(n2 - n, 0)::double, 6) "within", round(1 - (list_inner_product(s, s) - q) / nullif(n * n - n2, 0)::double, 6) "between" from w join us using (unit)""")
register("vec08_paired_table", lambda s, d: vc.paired_table(panel(s, d), "group_id", "condition", "human", ["a", "b"], "n_words"), "panel", """
    p as (select group_id, avg(n_words) filter ("condition" = 'human') h, avg(n_words) filter ("condition" = 'a') a, avg(n_words) filter ("condition" = 'b') b from panel group by 1)
    select group_id, round(h, 6) human, round(a, 6) a, round(b, 6) b, round(a - h, 6) a_minus_human, round(b - h, 6) b_minus_human from p""")

EXP = 'ex as (select session_id, count(*) filter (n_words > 30) expected from turns group by 1)'
FLAGS = EXP + r""", fg as (select session_id, count(*) n, count(*) filter (n_words = 0) blank, count(*) filter (not regexp_matches(text, '[.!?"]\s*$')) truncated, count(*) filter (regexp_matches(text, '\[[^\]]+\]|[*][^*]+[*]')) stage from turns group by 1),
    fm as (select fg.*, abs(coalesce(expected, 0) - n) mismatch from fg left join ex using (session_id)),
    flags as (select session_id, 'blank' flag, blank n, 'warn' severity from fm where blank > 0 union all select session_id, 'truncated', truncated, 'info' from fm where truncated > 0 union all select session_id, 'stage', stage, 'info' from fm where stage > 0 union all select session_id, 'mismatch', mismatch, 'fail' from fm where mismatch > 0)"""
flags = lambda s, d: qa.integrity_flags(turns(s, d), turns(s, d).groupBy("session_id").agg(F.count_if(F.col("n_words") > 30).alias("expected")))
register("qa01_integrity_flags", flags, "turns", FLAGS + " select * from flags")
register("qa02_recommendation", lambda s, d: qa.recommendation(flags(s, d)), "turns", FLAGS + """,
    g as (select session_id, max(case severity when 'fail' then 3 when 'warn' then 2 else 1 end) worst, count(*) filter (severity = 'fail') fails, count(*) filter (severity = 'warn') warns, list_sort(list_distinct(list(flag))) rules from flags group by 1)
    select *, case when fails > 0 then 'reject' when warns > 1 then 'review' else 'accept' end recommendation from g""")
register("qa03_readiness", lambda s, d: qa.readiness(panel(s, d), 3), "panel", """
    h as (select session_id, "role", speaker_id, text, sha256(turn_index || '|' || coalesce("role", '') || '|' || coalesce(speaker_id, '') || '|' || coalesce(text, '')) h from panel),
    g as (select session_id, count(*) n, count(*) filter ("role" = 'moderator') m, count(distinct case when "role" = 'participant' then speaker_id end) k, sha256(count(*) || '|' || sum(('0x' || h[1:15])::bigint)::varchar || '|' || sum(('0x' || h[16:30])::bigint)::varchar) content_hash from h group by 1),
    f as (select session_id, n, content_hash, list_filter([case when n < 5 then 'few_turns' end, case when m = 0 then 'no_moderator' end, case when k <> 3 then 'roster_mismatch' end], lambda x: x is not null) findings from g) select *, case when len(findings) = 0 then 'ready' else 'not_ready' end verdict from f""")


def positions(df):
    from ..operators.pairs import by_turn

    return df.select("session_id", F.row_number().over(by_turn()).alias("pos"), "speaker_id", "text")


register("qa04_transcript_compare", lambda s, d: qa.transcript_compare(positions(turns(s, d)), positions(turns(s, d).where("not (session_id % 7 = 0 and turn_index = 2)").withColumn("text", F.when(F.col("n_words") % 11 == 0, F.upper(F.lit("x"))).otherwise(F.col("text"))))), "turns", """
    a as (select session_id, row_number() over (partition by session_id order by turn_index) pos, speaker_id s, text t from turns), b as (select session_id, row_number() over (partition by session_id order by turn_index) pos, speaker_id s2, case when n_words % 11 = 0 then 'X' else text end t2 from turns where not (session_id::int % 7 = 0 and turn_index = 2)),
    j as (select session_id, pos, case when t is null or t2 is null then 'length' when s <> s2 then 'speaker' when t <> t2 then 'text' end f from a full join b using (session_id, pos))
    select session_id, count(f) differences, min(pos) filter (f is not null) "first", arg_min(f, pos) filter (f is not null) field from j group by 1""")
stated = lambda s, d: panel(s, d).where("group_id <> 'web'").groupBy("session_id").agg((F.count(F.lit(1)) + F.count_if(F.col("turn_index") % 397 == 0)).alias("expected"))
register("qa05_structure_checks", lambda s, d: qa.structure_checks(panel(s, d), stated(s, d)), "panel", r"""
    e as (select session_id, count(*) + count(*) filter (turn_index % 397 = 0) expected from panel where group_id <> 'web' group by 1),
    g as (select session_id, count(*) turns, count(*) filter (regexp_matches(text, '^[A-Z ]+$')) headings, count(*) filter (regexp_matches(text, '(^|\n)[A-Z][a-z]+:')) labels, count(*) filter (regexp_matches(text, '(^|\n)[0-9]{1,3}(\n|$)')) page_numbers from panel group by 1)
    select g.*, expected, coalesce(turns = expected, false) matches from g left join e using (session_id)""")
register("qa06_reconcile_table", lambda s, d: qa.reconcile_table(calls(s, d).groupBy(F.col("model").alias("metric")).agg(F.avg("input_tokens").alias("value"), F.count(F.lit(1)).alias("n_source")), s.createDataFrame([("error", 49.5), ("click", 10.0), ("view", 49.4), ("ghost", 1.0)], "metric string, value double"), 1.0), "calls", """
    c as (select model metric, avg(input_tokens) v, count(*) n_source from calls group by 1), t as (select * from (values ('error', 49.5::double), ('click', 10.0), ('view', 49.4), ('ghost', 1.0)) t(metric, st))
    select metric, round(v, 6) "value", round(st, 6) stated, n_source, case when st is null then 'unstated' when v is null then 'unsupported' when abs(v - st) <= 1 then 'agrees' else 'differs' end state from c full join t using (metric)""")


def audited(s, d):
    """The call log with the columns of an audited one."""
    k, failed = F.col("event_id"), F.col("failed")
    event = F.when(k % 12 == 4, "engagement_retry").when(k % 3 == 0, "response").when(k % 3 == 1, "engagement").otherwise("decision")
    error = F.when(failed & (k % 5 == 0), "fallback_after_retry").when(failed & (k % 5 == 1), "recovered_on_retry").when(failed, "malformed").when(k % 2 == 0, "none")
    c = calls(s, d).withColumns({"event": event, "error_type": error, "attempt": 1 + (k % 7 == 0).cast("int"), "fallback": k % 11 == 0, "coerced": F.when(F.col("session_id") % 2 == 1, F.when(k % 13 == 0, "age").otherwise("none")), "truncated": F.col("output_tokens") >= 95})
    return c.withColumn("stop_reason", F.when(k % 10 > 0, F.when(F.col("truncated"), "max_tokens").otherwise("end_turn")))


register("agg11_call_audit", lambda s, d: qa.call_audit(audited(s, d)), "calls", """
    a as (select *, case when event_id % 12 = 4 then 'engagement_retry' when event_id % 3 = 0 then 'response' when event_id % 3 = 1 then 'engagement' else 'decision' end ev, case when failed and event_id % 5 = 0 then 'fb' when failed and event_id % 5 = 1 then 'rec' when failed then 'bad' end er,
        output_tokens >= 95 tr, session_id % 2 = 1 rp, case when event_id % 10 > 0 then case when output_tokens >= 95 then 'max_tokens' else 'end_turn' end end sr from calls),
    g as (select session_id, count(*) calls, count(distinct model) models, sum(input_tokens)::bigint input_tokens, sum(output_tokens)::bigint output_tokens, count(er) errors, count(*) filter (event_id % 7 = 0) retries, count(*) filter (ev = 'decision') decisions, count(*) filter (ev = 'decision' and event_id % 11 = 0) fallbacks,
        count(*) filter (ev = 'response') responses, count(*) filter (ev = 'response' and tr) truncated, count(*) filter (ev = 'engagement' and event_id % 7 > 0) assessments, count(*) filter (rp and event_id % 13 = 0) coerced, any_value(rp) retry_path,
        count(*) filter (ev like 'engagement%' and er = 'fb') + count(*) filter (not rp and ev = 'engagement' and er = 'bad') forced_silences,
        nullif(concat_ws('|', case when count(*) filter (ev = 'response' and sr = 'end_turn') > 0 then 'end_turn:' || count(*) filter (ev = 'response' and sr = 'end_turn') end, case when count(*) filter (ev = 'response' and sr = 'max_tokens') > 0 then 'max_tokens:' || count(*) filter (ev = 'response' and sr = 'max_tokens') end), '') stop_reasons from a group by 1)
    select *, round(errors / calls::double, 6) error_rate, round(retries / calls::double, 6) retry_rate, round(fallbacks / nullif(decisions, 0)::double, 6) fallback_rate, round(truncated / nullif(responses, 0)::double, 6) truncation_rate, round(coerced / nullif(assessments, 0)::double, 6) coercion_rate, round(forced_silences / nullif(assessments, 0)::double, 6) forced_silence_rate from g""")
RATES = [("click", "USD", 1.5, 2.0, 0.1, 1.0, 1.0), ("view", "USD", 3.0, 3.0, 0.3, 3.5, 6.0), ("error", "EUR", 0.5, 4.0, 0.1, 0.6, 0.6), ("purchase", "USD", 1.0, 1.0, None, None, 2.0)]
rates = lambda s: s.createDataFrame(RATES, "model string, currency string, input double, output double, cache_read double, write_5m double, write_1h double")


def cached(s, d):
    """The call log with tokens read from and written to caches, some of no known time to live, and calls that name no model."""
    k = F.col("event_id")
    c = calls(s, d).withColumns({"model": F.when(k % 97 > 0, F.col("model")), "cache_read": F.when(k % 2 == 0, k % 30), "cache_writes": k % 50, "five": F.when(k % 3 == 0, F.floor(k % 50 / 2)), "hour": F.when(k % 3 == 1, F.floor(k % 50 / 2)), "ttl": F.when(k % 4 == 0, "5m").when(k % 4 == 1, "1h")})
    return qa.split_cache_writes(c)


#: Prices for all models, of which one has two prices for cache writes: sessions whose writes it holds of unknown time to live have no cost.
FULL = [("click", "USD", 1.5, 2.0, 0.1, 1.0, 1.0), ("view", "USD", 3.0, 3.0, 0.3, 3.5, 3.5), ("error", "USD", 0.5, 4.0, 0.1, 0.6, 0.7), ("purchase", "USD", 1.0, 1.0, 0.2, 2.0, 2.0)]


def full_costs(s, d):
    named = cached(s, d).drop("model").join(calls(s, d).select("event_id", "model"), "event_id")
    rate = s.createDataFrame(FULL, "model string, currency string, input double, output double, cache_read double, write_5m double, write_1h double")
    return qa.cost_totals(qa.usage_cost(named, rate, ["session_id"]), ["session_id"])


COST_SQL = """ca as (select session_id, "role", case when event_id % 97 > 0 then model end model, input_tokens i, output_tokens o, case when event_id % 2 = 0 then event_id % 30 else 0 end cr, event_id % 50 cw, case when event_id % 3 = 0 then event_id % 50 // 2 else 0 end f, case when event_id % 3 = 1 then event_id % 50 // 2 else 0 end h, event_id % 4 tl from calls),
    cs as (select *, f + case when tl = 0 then cw - f - h else 0 end w5, h + case when tl = 1 then cw - f - h else 0 end w1, case when tl > 1 then cw - f - h else 0 end wu from ca),
    rt as (select * from (values ('click', 'USD', 1.5::double, 2.0::double, 0.1::double, 1.0::double, 1.0::double), ('view', 'USD', 3, 3, 0.3, 3.5, 6), ('error', 'EUR', 0.5, 4, 0.1, 0.6, 0.6), ('purchase', 'USD', 1, 1, null, null, 2)) t(model, currency, ri, ro, rc, r5, r1)),
    cg as (select {0}, model, count(*) calls, sum(i)::bigint input_tokens, sum(o)::bigint output_tokens, sum(cr)::bigint cache_read, sum(w5)::bigint write_5m, sum(w1)::bigint write_1h, sum(wu)::bigint write_unknown from cs group by all),
    cj as (select cg.*, currency, case when cg.model is null then 'unattributed' when ri is null then 'no_rate' when (cache_read > 0 and rc is null) or (write_5m + write_1h + write_unknown > 0 and (r5 is null or r1 is null)) then 'incomplete_rate' when write_unknown > 0 and r5 <> r1 then 'ttl_unknown' else 'priced' end status,
        (input_tokens * ri + output_tokens * ro + cache_read * coalesce(rc, 0) + write_5m * coalesce(r5, 0) + write_1h * coalesce(r1, 0)) / 1e6 b, write_unknown * least(r5, r1) / 1e6 lo, write_unknown * greatest(r5, r1) / 1e6 hi from cg left join rt on rt.model = cg.model),
    co as (select {0}, model, calls, input_tokens, output_tokens, cache_read, write_5m, write_1h, write_unknown, currency, status, case when status in ('priced', 'ttl_unknown') then round(b + lo, 6) end cost_low, case when status in ('priced', 'ttl_unknown') then round(b + hi, 6) end cost_high, case when status = 'priced' then round(b + lo, 6) end cost from cj)"""
TOTAL_SQL = COST_SQL.format("session_id") + """, tt as (select session_id, count(distinct currency) currencies, case when count(distinct currency) = 1 then min(currency) end currency, count(*) - count(cost) undetermined, case when count(distinct currency) = 1 and count(cost) = count(*) then round(sum(cost), 6) end cost,
    case when count(distinct currency) = 1 and count(cost_low) = count(*) then round(sum(cost_low), 6) end cost_low, case when count(distinct currency) = 1 and count(cost_low) = count(*) then round(sum(cost_high), 6) end cost_high from co group by 1)"""
register("agg12_usage_cost", lambda s, d: qa.usage_cost(cached(s, d), rates(s), ["role"]), "calls", COST_SQL.format('"role"') + " select * from co")
register("agg12_cost_totals", lambda s, d: qa.cost_totals(qa.usage_cost(cached(s, d), rates(s), ["session_id"]), ["session_id"]), "calls", TOTAL_SQL + " select * from tt")
VALUES = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x}::double" for x in r) + ")" for r in FULL)
FULL_SQL = re.sub(r"\(values .*?\) t\(model", lambda _: f"(values {VALUES}) t(model", TOTAL_SQL.replace("case when event_id % 97 > 0 then model end model", "model"), count=1)
register("agg12_projected_cost", lambda s, d: qa.projected_cost(full_costs(s, d).withColumn("third", F.col("session_id") % 3), ["third"], 100), "calls", FULL_SQL + """
    select session_id % 3 third, count(cost) observed, count(*) - count(cost) excluded, round(avg(cost) * 100, 6) projected, round(min(cost) * 100, 6) projected_min, round(max(cost) * 100, 6) projected_max from tt group by 1""")
register("agg13_stage_durations", lambda s, d: qa.stage_durations(table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).select(F.col("event_type").alias("stage"), F.col("ts").alias("started"), F.when((F.col("event_type") != "error") | (F.col("event_id") % 50 != 0), F.col("ts") + F.make_interval(secs=F.floor("value"))).alias("ended"))), "", """
    with r as (select event_type stage, ts st, case when event_type <> 'error' or event_id % 50 <> 0 then ts + to_seconds(floor(value)) end en from events), q as (select *, (epoch_us(en) / 1e6 - epoch_us(st) / 1e6) sc from r)
    select stage, count(*) n, count(*) filter (en is null) missing, round(min(sc), 6) min_s, round(quantile_cont(sc, 0.5), 6) median_s, round(avg(sc), 6) mean_s, round(max(sc), 6) max_s, round(sum(sc), 6) total_s, case when count(*) filter (en is null) = 0 then round((max(epoch_us(en)) - min(epoch_us(st))) / 1e6, 6) end wall_s from q group by 1""")
