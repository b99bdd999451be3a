"""Queries of summaries, inference, agreement and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import sampling as sm
from ..operators import stats as st
from ..operators import thematic as th
from ..sources.adapters import panel, presence, table, turns
from .registry import register
from .thematic import REPS, SCN, borders, repetitions


def metrics(s, d):
    """Two metrics of orders: condition = market segment, group = region, replicate = order mod 3."""
    j = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    key = ["condition", "group_id", "replicate"]
    g = j.select(F.col("c_mktsegment").alias("condition"), F.col("n_regionkey").alias("group_id"), (F.col("o_orderkey") % 3).alias("replicate"), "o_totalprice", "o_orderstatus")
    g = g.groupBy(*key).agg(F.avg("o_totalprice").alias("price"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("filled"))
    g = g.withColumn("filled", F.when((F.col("group_id") == 4) & (F.col("replicate") == 2), None).otherwise(F.col("filled")))
    return g.unpivot(key, ["price", "filled"], "metric", "value")


MET = """mb as (select c_mktsegment "condition", n_regionkey group_id, o_orderkey % 3 replicate, avg(o_totalprice) price, avg((o_orderstatus = 'F')::int) filled from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2, 3),
    met as (select "condition", group_id, replicate, 'price' metric, price "value" from mb union all select "condition", group_id, replicate, 'filled', case when group_id = 4 and replicate = 2 then null else filled end from mb)"""
price = lambda s, d: metrics(s, d).where("metric = 'price'")
PRICE = MET + """, pr as (select * from met where metric = 'price')"""

register("sta01_honest_summary", lambda s, d: st.honest_summary(metrics(s, d), ["metric", "group_id"], metrics(s, d).select("metric", "group_id").distinct().withColumn("n_expected", F.lit(15))), "", f"""with {MET}
    select metric, group_id, 15 n_expected, count("value") n_valid, round(avg("value"), 6) mean, round(quantile_cont("value", 0.5), 6) median, round(case when count("value") = 1 then 0 else stddev_samp("value") end, 6) sd, round(min("value"), 6) "min", round(max("value"), 6) "max",
    case when count("value") = 0 then 'none' when count("value") < 15 then 'partial' else 'complete' end coverage from met group by 1, 2""")
register("sta01_missing_units", lambda s, d: st.missing_units(metrics(s, d).withColumn("unit", F.concat_ws(":", "condition", F.col("replicate").cast("string"))), ["metric", "group_id"], "unit", metrics(s, d).select("metric", "group_id", F.concat_ws(":", "condition", F.col("replicate").cast("string")).alias("unit"))), "", f"""with {MET}
    select metric, group_id, count(*) n_missing, list_sort(list("condition" || ':' || replicate)) missing from met where "value" is null group by 1, 2""")
register("sta02_route_a", lambda s, d: st.route_a(metrics(s, d), "BUILDING"), "", f"""with {MET}, v as (select * from met where metric not in (select metric from met where "value" is null)), r as (select metric, group_id, avg("value") rf from v where "condition" = 'BUILDING' group by 1, 2)
    select metric, group_id, "condition", count("value") n, round(avg("value"), 6) "value", round(any_value(rf), 6) reference from v left join r using (metric, group_id) where "condition" <> 'BUILDING' group by 1, 2, 3""")
register("sta03_route_b", lambda s, d: st.route_b(price(s, d).where("not (condition = 'MACHINERY' and group_id = 1 and replicate = 0)")), "", f"""with {PRICE}, v as (select * from pr where not ("condition" = 'MACHINERY' and group_id = 1 and replicate = 0)),
    a as (select "condition", count(distinct s) = 1 available from (select "condition", group_id, list_sort(list_distinct(list(replicate))) s from v group by 1, 2) group by 1)
    select "condition", replicate, available, case when available then round(avg("value"), 6) end "value", count("value") "groups" from v join a using ("condition") group by 1, 2, 3""")
register("sta04_study_level", lambda s, d: st.study_level(price(s, d)), "", f"""with {PRICE}, m as (select "condition", replicate, avg("value") v from pr group by 1, 2)
    select "condition", count(v) replicates, round(avg(v), 6) mean, round(stddev_samp(v), 6) sd, round(min(v), 6) "min", round(max(v), 6) "max" from m group by 1""")
register("sta05_paired_effects", lambda s, d: st.paired_effects(price(s, d), "MACHINERY", "FURNITURE"), "", f"""with {PRICE}, g as (select group_id, avg("value") filter ("condition" = 'MACHINERY') ma, avg("value") filter ("condition" = 'FURNITURE') mb2, var_samp("value") filter ("condition" = 'MACHINERY') va, var_samp("value") filter ("condition" = 'FURNITURE') vb,
    count(*) filter ("condition" = 'MACHINERY') na, count(*) filter ("condition" = 'FURNITURE') nb from pr where "condition" in ('MACHINERY', 'FURNITURE') group by 1), h as (select *, ma - mb2 d, sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) s from g)
    select group_id, round(d, 6) difference, round(s, 6) pooled_sd, round(d / nullif(s, 0), 6) standardised, case when d > 0 then 'MACHINERY' when d < 0 then 'FURNITURE' else 'tie' end favours from h""")
DIFF = """df as (select c_nationkey unit, avg(case when o_orderpriority < '3' then o_totalprice end) - avg(case when o_orderpriority >= '3' then o_totalprice end) d from orders join customer on o_custkey = c_custkey group by 1)"""


#: Sums of doubles depend on the order of their rows; in fixed point they don't.
EXACT = DIFF.replace("avg(case when o_orderpriority < '3' then o_totalprice end)", "sum(case when o_orderpriority < '3' then o_totalprice::decimal(18, 4) end)::double / count(case when o_orderpriority < '3' then o_totalprice end)").replace("avg(case when o_orderpriority >= '3' then o_totalprice end)", "sum(case when o_orderpriority >= '3' then o_totalprice::decimal(18, 4) end)::double / count(case when o_orderpriority >= '3' then o_totalprice end)")


def diffs(s, d):
    mean = lambda test: tx.ratio(F.sum(F.when(test, F.col("o_totalprice").cast("decimal(18, 4)"))), F.count(F.when(test, F.col("o_totalprice"))))
    return table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("unit")).agg((mean(F.col("o_orderpriority") < "3") - mean(F.col("o_orderpriority") >= "3")).alias("d"))


register("sta06_effect_summary", lambda s, d: st.effect_summary(diffs(s, d)), "", f"""with {EXACT}, l as (select unit left_out from df union all select null)
    select left_out, count(*) n, round(avg(d), 6) mean, round(quantile_cont(d, 0.5), 6) median, count(*) filter (d > 0) up, count(*) filter (d < 0) down, count(*) filter (d = 0) ties from df cross join l where unit is distinct from left_out group by 1""")
register("sta07_sign_test", lambda s, d: st.sign_test(diffs(s, d).withColumn("half", F.col("unit") % 2), ["half"]), "", f"""with {DIFF}, g as (select unit % 2 half, count(*) filter (d <> 0)::int n, least(count(*) filter (d > 0), count(*) filter (d < 0))::int k from df group by 1)
    select half, n, k, round(least(1, 2 * list_sum(list_transform(range(k + 1), lambda i: factorial(n)::double / (factorial(i::int)::double * factorial((n - i)::int)::double) * power(0.5, n)))), 6) p, round(least(1, 2 * power(0.5, n)), 6) least_p from g""")
register("sta08_wilson_gate", lambda s, d: st.wilson_gate(table(s, d, "orders").groupBy((F.col("o_custkey") % 40).alias("unit")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("k"), F.count(F.lit(1)).alias("n")), 0.34, 0.32), "", """
    with c as (select o_custkey % 40 unit, count(*) filter (o_orderstatus = 'F') k, count(*) n from orders group by 1), w as (select *, 1.96::double z, k / n::double p from c), b as (select *, (p + z * z / (2 * n)) / (1 + z * z / n) m, z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n) h from w)
    select unit, k, n, round(greatest(0, m - h), 6) "lower", round(least(1, m + h), 6) "upper", case when m - h >= 0.32 then 'pass' when m + h < 0.34 then 'fail' else 'open' end decision from b""")
register("sta08_least_k", lambda s, d: table(s, d, "orders").groupBy((F.col("o_custkey") % 40).alias("unit")).agg(F.count(F.lit(1)).alias("n")).select("unit", "n", st.least_k("n", 0.9).alias("k"), st.least_k("n", 0.5).alias("k_half")), "", """
    with c as (select o_custkey % 40 unit, count(*) n from orders group by 1), g as (select unit, n, unnest(range(n + 1)) k from c),
    w as (select unit, n, k, (k / n::double + 1.96::double * 1.96 / (2 * n)) / (1 + 1.96::double * 1.96 / n) - 1.96::double * sqrt(k / n::double * (1 - k / n::double) / n + 1.96::double * 1.96 / (4 * n * n)) / (1 + 1.96::double * 1.96 / n) lo from g)
    select unit, n, min(case when lo >= 0.9 then k end) k, min(case when lo >= 0.5 then k end) k_half from w group by 1, 2""")
XY = """xy as (select p_partkey // 200 block, p_partkey item, p_size::double x, round(p_retailprice / 50)::double y from part)"""


def xy(s, d):
    return table(s, d, "part").select(F.floor(F.col("p_partkey") / 200).alias("block"), F.col("p_partkey").alias("item"), F.col("p_size").cast("double").alias("x"), F.round(F.col("p_retailprice") / 50).alias("y"))


RHO = """rk as (select *, rank() over (partition by block order by x) + (count(*) over (partition by block, x) - 1) / 2.0::double rx, rank() over (partition by block order by y) + (count(*) over (partition by block, y) - 1) / 2.0::double ry from xy),
    rho as (select block, count(*) n, case when count(*) < 2 or min(x) = max(x) or min(y) = max(y) then null else round(corr(rx, ry), 6) end rho, case when count(*) < 2 then 'too_few' when min(x) = max(x) or min(y) = max(y) then 'no_variance' end undefined_reason from rk group by 1)"""
TAU = """pq as (select a.block, sign(a.x - b.x) * sign(a.y - b.y) s, a.x <> b.x nx, a.y <> b.y ny from xy a join xy b on a.block = b.block and a.item < b.item), tn as (select block, count(*) n from xy group by 1),
    tau as (select tn.block, any_value(n) n, case when any_value(n) < 3 or count(*) filter (nx) = 0 or count(*) filter (ny) = 0 then null else round(sum(s) / sqrt(count(*) filter (nx)::double * count(*) filter (ny)), 6) end tau_b,
    case when any_value(n) < 3 then 'too_few' when count(*) filter (nx) = 0 or count(*) filter (ny) = 0 then 'no_variance' end undefined_reason from tn left join pq on pq.block = tn.block group by 1)"""
register("sta09_spearman", lambda s, d: st.spearman(xy(s, d), ["block"]), "", f"with {XY}, {RHO} select * from rho")
register("sta09_kendall", lambda s, d: st.kendall(xy(s, d), ["block"]), "", f"with {XY}, {TAU} select * from tau")
ORDER = """t as (select *, rank() over (partition by block order by x desc) <= 3 tx, rank() over (partition by block order by y desc) <= 3 ty from xy),
    tp as (select block, round(avg(abs(x - y)), 6) mean_abs, round(count(*) filter (tx and ty) / nullif(count(*) filter (tx or ty), 0)::double, 6) top3 from t group by 1),
    kx as (select block, sum(k * (k - 1) // 2)::bigint ties_x from (select block, x, count(*) k from xy group by 1, 2) group by 1), ky as (select block, sum(k * (k - 1) // 2)::bigint ties_y from (select block, y, count(*) k from xy group by 1, 2) group by 1),
    od as (select tau.block, tau.n, tau_b, tau.undefined_reason, rho, mean_abs, top3, ties_x, ties_y from tau join rho using (block) join tp using (block) join kx using (block) join ky using (block))"""
register("thm13_ordering", lambda s, d: st.ordering_similarity(xy(s, d), ["block"]), "", f"with {XY}, {RHO}, {TAU}, {ORDER} select * from od")
WHOLE = 'xy as (select o_orderpriority block, o_orderkey item, floor(o_totalprice / 500)::double x, date_diff(\'day\', date \'1970-01-01\', o_orderdate::date)::double y from orders)'


def prices_by_day(s, d):
    return table(s, d, "orders").select(F.col("o_orderpriority").alias("block"), F.floor(F.col("o_totalprice") / 500).alias("x"), F.unix_date(F.to_date("o_orderdate")).alias("y"))


#: Groups of thousands of rows; the statement compares all pairs.
register("sta09_kendall_whole", lambda s, d: st.kendall(prices_by_day(s, d), ["block"]), "", f"with {WHOLE}, {TAU} select * from tau")


def measured(s, d):
    return presence(s, d).select("condition", "group_id", "replicate").distinct().where("not (group_id = 2 and replicate = 3)")


MS = """cl as (select distinct "condition", group_id, replicate from presence), cb as (select distinct code from presence), sd as (select "condition", group_id, replicate, code, voiced / participants::double v from presence where present),
    grid as (select cl.*, cb.code, case when cl.group_id = 2 and cl.replicate = 3 then null else coalesce(v, 0) end v from cl cross join cb left join sd using ("condition", group_id, replicate, code)),
    rf as (select group_id, code, v x from grid where "condition" = 'BUILDING'), gn as (select group_id, "condition", replicate, code, v y from grid where "condition" <> 'BUILDING'),
    bo as (select *, group_id || ':' || "condition" || ':' || replicate block from gn join rf using (group_id, code))"""
UNION_TAU = TAU.replace("xy", "xu").replace("pq", "pu").replace("tn", "tu").replace("tau as", "uau as")
GROUPS = f"""{MS}, xy as (select block, code item, x, y from bo where x > 0 and y is not null), xu as (select block, code item, x, y from bo where (x > 0 or y > 0) and y is not null), {RHO}, {TAU}, {UNION_TAU}, {ORDER},
    fc as (select block, any_value(group_id) group_id, any_value("condition") "condition", any_value(replicate) replicate, count(*) n_present, count(*) filter (y > 0) recovered, count(*) filter (y = 0) at_zero, count(*) filter (y is null) unmeasured from bo where x > 0 group by 1),
    go as (select fc.*, od.n, od.tau_b, od.undefined_reason, rho, mean_abs, top3, ties_x, ties_y, uau.n n_union, uau.tau_b tau_union from fc left join od using (block) left join uau using (block))"""
register("thm13_group_ordering", lambda s, d: st.group_ordering(presence(s, d), measured(s, d), "BUILDING"), "presence", f"{GROUPS} select * exclude (block) from go")
register("thm13_ordering_summary", lambda s, d: st.ordering_summary(st.group_ordering(presence(s, d), measured(s, d), "BUILDING"), "MACHINERY", "FURNITURE"), "presence", f"""{GROUPS},
    m as (select group_id, "condition", count(tau_b) k, quantile_cont(tau_b, 0.5) m, min(tau_b) lo, max(tau_b) hi from go group by 1, 2),
    g as (select group_id, max(case when "condition" = 'MACHINERY' then k end) ka, max(case when "condition" = 'FURNITURE' then k end) kb, max(case when "condition" = 'MACHINERY' then m end) ma, max(case when "condition" = 'FURNITURE' then m end) mb,
        max(case when "condition" = 'MACHINERY' then lo end) la, max(case when "condition" = 'FURNITURE' then lo end) lb, max(case when "condition" = 'MACHINERY' then hi end) ha, max(case when "condition" = 'FURNITURE' then hi end) hb from m group by 1)
    select group_id, coalesce(ka, 0) defined_a, coalesce(kb, 0) defined_b, round(ma, 6) median_a, round(la, 6) least_a, round(ha, 6) most_a, round(mb, 6) median_b, round(lb, 6) least_b, round(hb, 6) most_b, round(ma - mb, 6) difference,
        case when ma is null or mb is null then 'undefined' when ma > mb then 'MACHINERY' when mb > ma then 'FURNITURE' else 'tie' end direction from g""")
register("thm14_study_profiles", lambda s, d: st.study_ordering(presence(s, d), measured(s, d), "BUILDING"), "presence", f"""{MS},
    pf as (select "condition", replicate, code, count(*) filter (v > 0)::double n, round(avg(v), 6) m, count(*) filter (v is null) u from grid group by 1, 2, 3),
    jn as (select g."condition", g.replicate, g.code, r.n xn, g.n yn, r.m xm, g.m ym, g.u from pf g join pf r on r.code = g.code and r."condition" = 'BUILDING' where g."condition" <> 'BUILDING'),
    us as (select *, "condition" || ':' || replicate b from jn where xm is not null and ym is not null), xy as (select 'n' || b block, code item, xn x, yn y from us union all select 'm' || b, code, xm, ym from us), {RHO}, {TAU}, {ORDER},
    bl as (select "condition", replicate, "condition" || ':' || replicate b, sum(u)::bigint unmeasured from jn group by 1, 2)
    select "condition", replicate, unmeasured, a.n codes, a.tau_b tau_groups, a.undefined_reason reason_groups, a.top3 top3_groups, m.tau_b tau_reach, m.undefined_reason reason_reach, m.top3 top3_reach from bl left join od a on a.block = 'n' || b left join od m on m.block = 'm' || b""")


register("thm25_transitions", lambda s, d: st.transitions(st.scenario_orderings(th.scenarios(presence(s, d), borders(s, d), ["LOWER", "UPPER"]), "BUILDING"), th.BASE), "presence", SCN + f""",
    sv as (select scenario, group_id, "condition", replicate, code, case when pr then voiced / participants::double else 0 end v from un), xy as (select g.scenario || ':' || g.group_id || ':' || g."condition" || ':' || g.replicate block, g.code item, r.v x, g.v y, g.scenario, g.group_id, g."condition", g.replicate
        from sv g join sv r on r.scenario = g.scenario and r.group_id = g.group_id and r.code = g.code and r."condition" = 'BUILDING' where g."condition" <> 'BUILDING' and r.v > 0),
    {TAU}, ky as (select distinct block, scenario, group_id, "condition", replicate from xy), tk as (select ky.*, tau_b from tau join ky using (block)), cl as (select distinct group_id, "condition", replicate from tk),
    j as (select s.scenario, cl.*, t.tau_b tau, b.tau_b base from cl cross join (select unnest(['LOWER', 'UPPER']) scenario) s left join tk t on t.scenario = s.scenario and t.group_id = cl.group_id and t."condition" = cl."condition" and t.replicate = cl.replicate left join tk b on b.scenario = 'BASE' and b.group_id = cl.group_id and b."condition" = cl."condition" and b.replicate = cl.replicate)
    select scenario, group_id, "condition", replicate, base, tau, round(tau - base, 6) moved, case when base is not null and tau is not null then 'stays_defined' when base is not null then 'becomes_undefined' when tau is not null then 'becomes_defined' else 'stays_undefined' end transition from j""")


def study_scores(s, d):
    """Per condition against the reference: groups that hold a code, on both sides."""
    n = presence(s, d).where("present").groupBy("condition", "code").agg(F.count_distinct("group_id").cast("double").alias("g"))
    ref = n.where("condition = 'BUILDING'").select(F.col("code").alias("item"), F.col("g").alias("x"))
    return n.where("condition != 'BUILDING'").select(F.col("condition").alias("block"), F.col("code").alias("item"), F.col("g").alias("y")).join(ref, "item")


SXY = """sn as (select "condition", code, count(distinct group_id)::double g from presence where present group by 1, 2), xy as (select a."condition" block, a.code item, b.g x, a.g y from sn a join sn b on a.code = b.code and b."condition" = 'BUILDING' where a."condition" <> 'BUILDING')"""
register("thm14_study_ordering", lambda s, d: st.ordering_similarity(study_scores(s, d), ["block"]), "presence", f"{SXY}, {RHO}, {TAU}, {ORDER} select * from od")
register("thm15_shared_rank", lambda s, d: st.spearman(study_scores(s, d), ["block"]), "presence", f"{SXY}, {RHO} select * from rho")


def rated(s, d):
    return table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "lang"), "doc_id").select("lang", F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b"))


RATED = "ra as (select lang, quality a, 1 - toxic b from labels join documents using (doc_id))"
register("sta10_agreement", lambda s, d: st.agreement(rated(s, d), ["lang"]), "", f"""with {RATED}, g as (select lang, count(*) n, avg((a = b)::int) po, avg(a) pa, avg(b) pb, sum(a)::bigint positives_a, sum(b)::bigint positives_b from ra group by 1), h as (select *, (pa + pb) / 2 q, pa * pb + (1 - pa) * (1 - pb) pe from g)
    select lang, n, round(po, 6) agreement, round((po - pe) / nullif(1 - pe, 0), 6) kappa, round((po - 2 * q * (1 - q)) / nullif(1 - 2 * q * (1 - q), 0), 6) ac1, round(1 - (1 - po) / nullif(2 * q * (1 - q) * (2 * n) / (2 * n - 1), 0), 6) alpha, positives_a, positives_b, round(q, 6) prevalence from h""")
register("sta10_validation", lambda s, d: st.validation_status(st.agreement(rated(s, d).where("lang is not null"), ["lang"]), F.col("lang").isin("en", "de")).select("lang", "n", "prevalence", "elicited", "status"), "", f"""with {RATED}
    select lang, count(*) n, round((avg(a) + avg(b)) / 2, 6) prevalence, lang in ('en', 'de') elicited, case when lang in ('en', 'de') then case when sum(a) + sum(b) >= 3 then 'validated' else 'not_fully_validated' end when sum(a) + sum(b) >= 3 then 'opportunistic_detection' else 'specificity_only' end status
    from ra where lang is not null and a is not null and b is not null group by 1""")
register("sta11_classification", lambda s, d: st.classification(table(s, d, "orders").select(F.col("o_orderstatus").alias("gold"), F.when(F.col("o_orderkey") % 3 == 0, "F").when(F.col("o_orderkey") % 3 == 1, "O").otherwise("P").alias("predicted"))), "", """
    with p as (select o_orderstatus g, (['F', 'O', 'P'])[o_orderkey % 3 + 1] p from orders), n as (select g, p, count(*) n from p group by 1, 2), l as (select distinct g "label" from p union select distinct p from p),
    r as (select "label", sum(case when g = "label" and p = "label" then n else 0 end)::bigint tp, sum(case when g <> "label" and p = "label" then n else 0 end)::bigint fp, sum(case when g = "label" and p <> "label" then n else 0 end)::bigint fn from l cross join n group by 1)
    select "label", tp, fp, fn, round(tp / nullif(tp + fp, 0)::double, 6) "precision", round(tp / nullif(tp + fn, 0)::double, 6) recall, round(case when tp = 0 then 0 else 2.0::double * tp / (2 * tp + fp + fn) end, 6) f1 from r""")
guesses = lambda s, d: table(s, d, "orders").select(F.col("o_orderstatus").alias("gold"), F.when(F.col("o_orderkey") % 3 == 0, "F").when(F.col("o_orderkey") % 3 == 1, "O").otherwise("X").alias("predicted"))
register("sta11_confusion", lambda s, d: st.confusion(guesses(s, d)), "", "select o_orderstatus gold, (['F', 'O', 'X'])[o_orderkey % 3 + 1] predicted, count(*) n from orders group by 1, 2")
register("sta11_summary", lambda s, d: st.classification_summary(guesses(s, d)), "", """
    with p as (select o_orderstatus g, (['F', 'O', 'X'])[o_orderkey % 3 + 1] p from orders), l as (select g, count(*) n, count(*) filter (p = g) tp from p group by 1), q as (select p, count(*) k from p group by 1)
    select sum(n)::bigint n, count(*) labels, round(sum(tp) / sum(n)::double, 6) accuracy, round(avg(2.0::double * tp / (n + coalesce(k, 0))), 6) macro_f1, round(avg(tp / n::double), 6) balanced_accuracy from l left join q on q.p = l.g""")
weighted = lambda s, d: st.horvitz_thompson(table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left").select((F.col("doc_id") % 2).alias("side"), F.col("lang").alias("stratum"), F.contains("text", F.lit("***")).cast("int").alias("predicted"), (1 - F.col("quality")).alias("label")).withColumn("N", F.lit(1000)))
HT = r"""
    with r as (select doc_id % 2 side, lang stratum, contains(text, '***')::int p, 1 - quality l from documents join labels using (doc_id)), w as (select *, 1000 / (count(*) over (partition by side, stratum))::double w from r),
    g as (select side, sum(w) sw, sum(w * w) s2, sum(case when l = 1 then w else 0 end) pos, sum(case when p = 1 then w else 0 end) pre, sum(case when l = 1 and p = 1 then w else 0 end) tp, sum(case when l = 0 and p = 1 then w else 0 end) fp, sum(case when l = 1 and p = 0 then w else 0 end) fn, sum(case when l = 0 and p = 0 then w else 0 end) tn from w group by 1), h as (select *, sw * sw / s2 n, pos / sw p, 1.96::double z from g),
    b as (select *, (p + z * z / (2 * n)) / (1 + z * z / n) m, z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n) hf from h),
    ht as (select side, round(tp, 6) tp, round(fp, 6) fp, round(fn, 6) fn, round(tn, 6) tn, round(p, 6) prevalence, round(tp / nullif(pos, 0), 6) recall, round(tp / nullif(pre, 0), 6) "precision", round(n, 6) kish_n, round(greatest(0, m - hf), 6) "lower", round(least(1, m + hf), 6) "upper" from b)"""
register("sta12_horvitz_thompson", weighted, "", HT + " select * from ht")
register("sta12_recall_gap", lambda s, d: st.recall_gap(weighted(s, d).withColumn("side", F.col("side").cast("string")), "0", "1"), "", HT + """, gp as (select abs(max(recall) filter (side = 0) - max(recall) filter (side = 1)) g from ht)
    select round(g, 6) gap, case when g is null then 'undetermined' when g < 0.15 then 'pass' when g < 0.3 then 'marginal' else 'fail' end verdict from gp""")
register("sta13_leik", lambda s, d: st.leik(table(s, d, "lineitem").select((F.col("l_partkey") % 50).alias("claim"), (F.col("l_linenumber") % 3 - 1).alias("stance")), ["claim"], 2000), "", """
    with g as (select l_partkey % 50 claim, count(*) n, avg((l_linenumber % 3 - 1 <= -1)::int) c1, avg((l_linenumber % 3 - 1 <= 0)::int) c2, count(*) filter (l_linenumber % 3 = 0) k0, count(*) filter (l_linenumber % 3 = 1) k1, count(*) filter (l_linenumber % 3 = 2) k2, round(avg(l_linenumber % 3 - 1), 6) mean, round(stddev_pop(l_linenumber % 3 - 1), 6) sd from lineitem group by 1)
    select claim, n, round(1 - (case when c1 <= 0.5 then c1 else 1 - c1 end + case when c2 <= 0.5 then c2 else 1 - c2 end), 6) consensus, list_filter([case when k0 = greatest(k0, k1, k2) then -1 end, case when k1 = greatest(k0, k1, k2) then 0 end, case when k2 = greatest(k0, k1, k2) then 1 end], lambda x: x is not null) modes,
    round(greatest(k0, k1, k2) / n::double, 6) in_mode, round(n / 2000.0::double, 6) coverage, mean, sd from g""")
named = lambda s, d: metrics(s, d).withColumn("metric", F.when(F.col("metric") == "filled", "filled_share").otherwise(F.col("metric")))
register("sta14_calibrate", lambda s, d: st.calibrate(named(s, d), "BUILDING"), "", f"""with {MET}, r as (select metric, min("value") lo, max("value") hi from met where "condition" = 'BUILDING' group by 1), m as (select met.*, lo, hi, 0.15::double * (hi - lo) mg from met left join r using (metric) where "condition" <> 'BUILDING')
    select case metric when 'filled' then 'filled_share' else metric end metric, "condition", case when "value" is null or lo is null then 'undefined' when lo = hi then case when abs("value" - lo) < 1e-6 then 'inside' when abs("value" - lo) <= 0.05 then 'near' else 'outside' end when "value" between lo and hi then 'inside'
        when "value" between case when metric = 'filled' then greatest(lo - mg, 0) else lo - mg end and case when metric = 'filled' then least(hi + mg, 1) else hi + mg end then 'near' else 'outside' end status, count(*) n from m group by 1, 2, 3""")
register("sta14_progression", lambda s, d: st.progression(metrics(s, d).where("replicate = 2").select("condition", "metric", F.col("group_id").alias("stage"), "value", F.when(F.col("metric") == "price", "down").otherwise("up").alias("direction")), ["condition", "metric"]), "", f"""with {MET},
    g as (select "condition", metric, count("value") n, (list("value" order by group_id))[1] a, (list("value" order by group_id))[-1] b from met where replicate = 2 group by 1, 2)
    select "condition", metric, round(a, 6) "first", round(b, 6) "last", case when n < 2 or a is null or b is null then 'not_enough' when a = b then 'stable' when (metric = 'price') = (b < a) then 'improved' when metric = 'price' and b <= 0 then 'regressed' else 'still_problematic' end status from g""")
register("sta15_permutation_test", lambda s, d: st.permutation_test(table(s, d, "customer").select((F.col("c_nationkey") % 5).alias("fold"), F.col("c_custkey").alias("trial"), F.col("c_mktsegment").alias("truth"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_mktsegment")).otherwise("BUILDING").alias("guess")), 20_000))
#: Both tails by the terms of the error function's series, each as a product of its own.
TAILS = "(case when z > 8.5 then 0 else greatest(0, 1 - 2 / sqrt(pi()) * exp(-z * z / 2) * z / sqrt(2) * list_sum(list_transform(range(151), lambda i: coalesce(list_product(list_transform(range(1, i + 1), lambda k: z * z / (2 * k + 1)::double)), 1)))) end)"
register("sta16_rank_effects", lambda s, d: st.rank_effects(table(s, d, "customer").select("c_nationkey", F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "a").otherwise("b").alias("side"), F.round("c_acctbal", -2).alias("value")), ["c_nationkey"]), "", """
    with c as (select c_nationkey, case when c_mktsegment in ('BUILDING', 'MACHINERY') then 'a' else 'b' end side, round(c_acctbal, -2) v from customer), k as (select *, rank() over (partition by c_nationkey order by v) + (count(*) over (partition by c_nationkey, v) - 1) / 2.0::double r from c),
    g as (select c_nationkey, sum(case when side = 'a' then r end) ra, count(*) filter (side = 'a') na, count(*) filter (side = 'b') nb from k group by 1), u as (select *, ra - na * (na + 1) / 2.0::double u from g),
    z as (select *, 2 * u / (na * nb) - 1 dl, abs((u - na * nb / 2.0::double) / sqrt(na * nb * (na + nb + 1) / 12.0::double)) z from u), p as (select *, {P} p from z),
    a as (select *, least(1, p * (count(*) over () - row_number() over (order by p, c_nationkey) + 1)) ad from p) select c_nationkey, round(u, 6) u, round(dl, 6) delta, round(p, 6) p, round(max(ad) over (order by p, c_nationkey rows unbounded preceding), 6) holm from a""".replace("{P}", TAILS))
register("sta16_signed_rank", lambda s, d: st.signed_rank(table(s, d, "customer").select((F.col("c_nationkey") % 5).alias("k"), F.round("c_acctbal", -2).cast("double").alias("d")), ["k"]), "", """
    with c as (select c_nationkey % 5 k, round(c_acctbal, -2)::double d from customer where round(c_acctbal, -2) <> 0), r as (select *, rank() over (partition by k order by abs(d)) + (count(*) over (partition by k, abs(d)) - 1) / 2.0::double r, count(*) over (partition by k, abs(d)) t from c),
    g as (select k, count(*)::double n, sum(case when d > 0 then r else 0 end) w_plus, sum(case when d < 0 then r else 0 end) w_minus, sum(t * t - 1) ti from r group by 1), z as (select *, abs((w_plus - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ti / 48.0::double)) z from g)
    select k, n::bigint n, w_plus, w_minus, round({P}, 6) p from z""".replace("{P}", TAILS))
register("sta17_condition_wins", lambda s, d: st.condition_wins(metrics(s, d), "MACHINERY", "FURNITURE"), "", f"""with {MET}, m as (select metric, group_id, avg("value") filter ("condition" = 'MACHINERY') - avg("value") filter ("condition" = 'FURNITURE') d from met group by 1, 2)
    select metric, count(*) filter (d > 0) favour_a, count(*) filter (d < 0) favour_b, count(*) filter (d = 0) ties, round(avg(d), 6) mean_difference from m group by 1""")
register("sta18_stability_matrix", lambda s, d: st.stability_matrix(repetitions(s, d)), "", f"""with {REPS} select a.family, a.category c1, b.category c2, count(*) n, a.category = b.category agree from reps a join reps b on a.item = b.item and a.repetition = 1 and b.repetition = 2 group by 1, 2, 3, 5""")
planted = lambda s, d: table(s, d, "lineitem").where("l_linenumber <= 2").select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("repetition"), F.col("l_returnflag").alias("category"), F.when(F.col("l_orderkey") % 2 == 0, "even").otherwise("odd").alias("family"), (F.col("l_orderkey") % 11 == 0).alias("planted"), F.lit("N").alias("expected"))
register("sta18_rates", lambda s, d: st.stability_rates(planted(s, d)), "", """
    with g as (select l_orderkey % 11 = 0 planted, case when l_orderkey % 2 = 0 then 'even' else 'odd' end family, max(case when l_linenumber = 1 then l_returnflag end) c1, max(case when l_linenumber = 2 then l_returnflag end) c2 from lineitem where l_linenumber <= 2 group by l_orderkey), k as (select * from g where c1 is not null and c2 is not null)
    select family, grouping(family)::int "level", count(*) filter (not planted) items, count(*) filter (not planted and c1 = c2) agree, round(count(*) filter (not planted and c1 = c2) / nullif(count(*) filter (not planted), 0)::double, 6) rate, count(*) filter (planted) planted, count(*) filter (planted and c1 = 'N' and c2 = 'N') planted_right from k group by rollup (family)""")
register("sta19_closer", lambda s, d: st.closer_to_reference(metrics(s, d), "BUILDING", "MACHINERY", "FURNITURE"), "", f"""with {MET}, g as (select metric, group_id, avg("value") filter ("condition" = 'BUILDING') h, avg("value") filter ("condition" = 'MACHINERY') a, avg("value") filter ("condition" = 'FURNITURE') b from met group by 1, 2)
    select metric, count(*) "groups", count(*) filter (abs(a - h) < abs(b - h)) a_closer from g where h is not null and a is not null and b is not null group by 1""")

register("smp01_stratified", lambda s, d: sm.stratified(table(s, d, "documents"), ["lang", "source"], "doc_id", 5), "", """
    with d as (select lang, "source", doc_id, row_number() over (partition by lang, "source" order by md5('s' || doc_id), doc_id) r, count(*) over (partition by lang, "source") stratum_size from documents)
    select lang, "source", doc_id, stratum_size, round(least(1, 5 / stratum_size::double), 6) inclusion, round(1 / least(1, 5 / stratum_size::double), 6) weight from d where r <= 5""")
register("smp02_round_robin", lambda s, d: sm.round_robin(table(s, d, "customer"), "c_mktsegment", ["c_nationkey"], "c_custkey", 40), "", """
    with a as (select *, row_number() over (partition by c_mktsegment, c_nationkey order by md5('s' || c_custkey), c_custkey) r from customer), b as (select *, row_number() over (partition by c_mktsegment order by r, c_nationkey) draw from a) select c_mktsegment, c_nationkey, c_custkey, draw from b where draw <= 40""")
TERCILE = """cu as (select (list(c_acctbal order by c_acctbal))[count(*) // 3 + 1] t1, (list(c_acctbal order by c_acctbal))[2 * count(*) // 3 + 1] t2 from customer),
    te as (select customer.*, case when c_acctbal <= t1 then 'T1' when c_acctbal <= t2 then 'T2' else 'T3' end tercile from customer, cu)"""
thirds = lambda s, d: sm.terciles(table(s, d, "customer"), "c_acctbal")
register("smp02_terciles", lambda s, d: sm.round_robin(thirds(s, d), "c_mktsegment", ["c_nationkey", "tercile"], "c_custkey", 40), "", f"""with {TERCILE},
    a as (select *, row_number() over (partition by c_mktsegment, c_nationkey, tercile order by md5('s' || c_custkey), c_custkey) r from te), b as (select *, row_number() over (partition by c_mktsegment order by r, c_nationkey, tercile) draw from a) select c_mktsegment, c_nationkey, tercile, c_custkey, draw from b where draw <= 40""")
register("smp02_shortfalls", lambda s, d: sm.shortfalls(thirds(s, d), ["c_nationkey", "tercile"], 20), "", f"""with {TERCILE}
    select c_nationkey, tercile, 20 requested, count(*) available from te group by 1, 2 having count(*) < 20""")
register("smp03_content_order", lambda s, d: sm.content_order(table(s, d, "part").select("p_brand", "p_name", "p_type").distinct(), ["p_name", "p_type"], "p_brand", 6), "", """
    with p as (select distinct p_brand, p_name, p_type from part), o as (select *, row_number() over (partition by p_brand order by sha256(p_name || '|' || p_type), p_name, p_type) place from p) select * from o where place <= 6""")
QUO = [("BUILDING", 7), ("MACHINERY", 12), ("FURNITURE", 30)]
register("smp04_quota_panel", lambda s, d: sm.quota_panel(table(s, d, "customer"), s.createDataFrame(QUO, "c_mktsegment string, quota int"), "c_mktsegment", "c_custkey", "c_nationkey"), "", f"""
    with q as (select * from (values {', '.join(map(str, QUO))}) t(c_mktsegment, quota)), x as (select *, row_number() over (partition by c_mktsegment, c_nationkey order by md5('s' || c_custkey), c_custkey) z from customer),
    r as (select x.*, quota, row_number() over (partition by c_mktsegment order by md5('s' || c_custkey), c_custkey) r from x join q using (c_mktsegment) where z = 1) select c_mktsegment, c_custkey from r where r <= quota""")
register("smp05_weighted_draw", lambda s, d: sm.weighted_draw(table(s, d, "supplier").select(F.col("s_suppkey").alias("target_id"), F.col("s_nationkey").cast("int").alias("nation")), table(s, d, "customer").groupBy(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("category")).agg(F.count(F.lit(1)).alias("count")), "nation"), "", """
    with m as (select c_nationkey nation, c_mktsegment category, count(*) n from customer group by 1, 2), c as (select *, sum(n) over (partition by nation order by category rows unbounded preceding) hi, sum(n) over (partition by nation) total from m),
    t as (select s_suppkey target_id, s_nationkey nation, ('0x' || substr(md5('w' || s_suppkey), 1, 8))::bigint / 4294967296.0::double u from supplier) select target_id, nation, category from t join c using (nation) where u * total >= hi - n and u * total < hi""")
register("smp06_top_k", lambda s, d: sm.top_k(table(s, d, "part").select("p_brand", "p_partkey", "p_size"), ["p_brand"], "p_size", 3), "", """
    select * from (select p_brand, p_partkey, p_size, rank() over (partition by p_brand order by p_size desc) "rank" from part) where "rank" <= 3""")
