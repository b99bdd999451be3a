"""Source, stylometry and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import stylometry as sty
from ..scratch import scratch, shared_dir
from ..sources import transcripts as tr
from ..sources.adapters import panel, table, turns
from ..streaming import usage as us
from .registry import register


def entries(s, d):
    c, k = table(s, d, "conversations"), F.col("conv_id") % 4
    return c.select(F.col("conv_id").alias("session_id"), (F.col("turn") + F.when((k == 1) & (F.col("turn") > 2), 1).otherwise(0)).alias("turn"), F.when(F.col("role") == "assistant", "MODERATOR").when(F.col("role") == "user", "P1").otherwise("").alias("speaker_id"),
        F.when(F.col("turn") % 9 == 8, "").otherwise(F.col("text")).alias("content"), F.when(k < 2, F.col("role")).alias("speaker_role"), F.when((k == 2) | (k == 1) & (F.col("turn") == 2), "auto").alias("selection_mode"))


ENT = """en as (select conv_id session_id, turn + case when conv_id % 4 = 1 and turn > 2 then 1 else 0 end turn, case "role" when 'assistant' then 'MODERATOR' when 'user' then 'P1' else '' end sp, case when turn % 9 = 8 then '' else text end content,
    case when conv_id % 4 < 2 then "role" end sr, case when conv_id % 4 = 2 or (conv_id % 4 = 1 and turn = 2) then 'auto' end sm from conversations)"""
register("src01_canonical_turns", lambda s, d: tr.canonical_turns(entries(s, d)).select("session_id", "turn_index", "original_turn_id", "speaker_id", "role", "unresolved"), "", f"""with {ENT}
    select session_id, row_number() over (partition by session_id order by turn)::int turn_index, turn::varchar original_turn_id, nullif(sp, '') speaker_id, case when sp = 'MODERATOR' then 'moderator' when sp <> '' then 'participant' end "role", list_filter([case when sp = '' then 'speaker' end, case when trim(content) = '' then 'text' end], lambda x: x is not null) unresolved from en""")
register("src02_detect_schema", lambda s, d: tr.detect_schema(entries(s, d)), "", f"""with {ENT} select session_id, count(sr) human_fields, count(sm) synthetic_fields, case when count(sr) > 0 and count(sm) > 0 then 'mixed' when count(sr) > 0 then 'human' when count(sm) > 0 then 'synthetic' else 'neither' end "schema" from en group by 1""")
register("src03_turn_audit", lambda s, d: tr.turn_audit(entries(s, d)), "", f"""with {ENT} select session_id, count(*) "rows", 0 incomplete, count(*) - count(distinct turn) duplicates, max(turn) - min(turn) + 1 - count(distinct turn) missing, count(*) filter (trim(content) = '') "empty" from en group by 1""")
register("src04_artefacts", lambda s, d: tr.artefact_status(table(s, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_type").alias("artefact"), F.when(F.col("event_id") % 13 == 0, F.lit("{broken")).otherwise(F.col("props")).alias("content")).dropDuplicates(["session_id", "artefact", "content"]).groupBy("session_id", "artefact").agg(F.min("content").alias("content")), s.createDataFrame([("click", True), ("view", False), ("absent", True)], "artefact string, required boolean")), "", """
    with f as (select user_id session_id, event_type artefact, min(case when event_id % 13 = 0 then '{broken' else props end) c from events group by 1, 2), e as (select * from (values ('click', true), ('view', false), ('absent', true)) t(artefact, rq))
    select s.session_id, e.artefact, case when c is null then case when rq then 'missing_required' else 'missing_optional' end when json_valid(c) then 'loaded' else 'malformed' end state from (select distinct session_id from f) s cross join e left join f on f.session_id = s.session_id and f.artefact = e.artefact""")
LISTED = [("click", True), ("view", False), ("absent", True)]


def event_files(s, d):
    """The call log as JSON-lines files, one for each session group and kind, with every 13th line cut and every 29th blank; read back with their line numbers."""
    path, k = scratch(s, "logs"), F.col("event_id")
    line = F.when(k % 13 == 0, F.expr("left(props, char_length(props) - 1)")).when(k % 29 == 0, "").otherwise(F.col("props"))
    e = table(s, d, "events").select((F.col("user_id") % 20).alias("session"), F.col("event_type").alias("artefact"), "event_id", line.alias("value"))
    e.repartition("session", "artefact").sortWithinPartitions("session", "artefact", "event_id").select("session", "artefact", "value").write.partitionBy("session", "artefact").text(path)
    j = tr.json_lines(s, f"{path}/*/*")
    return j.withColumns({"session_id": F.regexp_extract("file", "session=([0-9]+)", 1).cast("long"), "artefact": F.regexp_extract("file", "artefact=([a-z]+)", 1)})


FILES = """ef as (select user_id % 20 session_id, event_type artefact, row_number() over (partition by user_id % 20, event_type order by event_id) line, event_id % 13 = 0 bad, event_id % 29 = 0 and event_id % 13 <> 0 blank from events)"""
register("src04_bad_lines", lambda s, d: event_files(s, d).where("error is not null").select("session_id", "artefact", "line", F.regexp_replace("error", "in .* line", "in file line").alias("error")), "", f"with {FILES} select session_id, artefact, line, 'Malformed JSON in file line ' || line error from ef where bad")
register("src04_files", lambda s, d: tr.file_artefacts(event_files(s, d), event_files(s, d), s.createDataFrame(LISTED, "artefact string, required boolean")), "", f"""with {FILES}, e as (select * from (values ('click', true), ('view', false), ('absent', true)) t(artefact, rq)),
    g as (select session_id, artefact, count(*) filter (not bad) records, coalesce(list_sort(list(line) filter (bad)), []) bad_lines from ef where not blank group by 1, 2)
    select s.session_id, e.artefact, case when records is null then case when rq then 'missing_required' else 'missing_optional' end when len(bad_lines) > 0 then 'malformed' else 'loaded' end state, coalesce(records, 0) records, coalesce(bad_lines, []) bad_lines
    from (select distinct session_id from ef where not blank) s cross join e left join g on g.session_id = s.session_id and g.artefact = e.artefact""")
register("src05_lines_to_turns", lambda s, d: tr.lines_to_turns(table(s, d, "documents").select("doc_id", F.regexp_replace("text", "\n(A|The|La|Der) ", "\n$1$1: ").alias("text"))).select("doc_id", "turn", "speaker", F.md5("text").alias("text_md5")), "", rf"""
    with t as (select doc_id, string_split(regexp_replace(text, '\n(A|The|La|Der) ', chr(10) || '\1\1: ', 'g'), chr(10)) x from documents), l as (select doc_id, unnest(x) t, generate_subscripts(x, 1) line from t), k as (select *, nullif(regexp_extract(t, '^([A-Z][A-Za-z]{{1,20}}):', 1), '') s from l where not regexp_matches(trim(t), '^[0-9]{{1,3}}$|^[0-9]{{1,2}}:[0-9]{{2}}$')),
    c as (select *, count(s) over (partition by doc_id order by line rows unbounded preceding) turn from k) select doc_id, turn, max(s) speaker, md5(string_agg(trim(regexp_replace(t, '^[A-Z][A-Za-z]{{1,20}}:', '')), ' ' order by line)) text_md5 from c group by 1, 2""")
PARTS = [("\n(A|The|La|Der) ", "\n$1$1: "), ("\n(And|Was) ", "\nThe Campaign’s  Issues?\n$1 "), ("\n(To|En) ", "\nEnd of transcript.\n$1 ")]


def parted(s, d):
    """Documents as raw transcripts: some words that begin a line stand for speakers, headings and ends."""
    text = F.col("text")
    for pattern, by in PARTS:
        text = F.regexp_replace(text, pattern, by)
    return tr.transcript_parts(table(s, d, "documents").select("doc_id", text.alias("text")), ["the campaigns issues", "Leaders"])


register("src05_transcript_parts", lambda s, d: parted(s, d).withColumn("text_md5", F.md5("text")).drop("text"), "", r"""
    with d as (select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\n(A|The|La|Der) ', chr(10) || '\1\1: ', 'g'), '\n(And|Was) ', chr(10) || 'The Campaign’s  Issues?' || chr(10) || '\1 ', 'g'), '\n(To|En) ', chr(10) || 'End of transcript.' || chr(10) || '\1 ', 'g') text from documents),
    l as (select doc_id, unnest(string_split(text, chr(10))) t, generate_subscripts(string_split(text, chr(10)), 1) line from d), a as (select *, nullif(regexp_extract(t, '^([A-Z][A-Za-z]{1,20}):', 1), '') s0 from l),
    b as (select *, count(s0) over w > 0 started from a window w as (partition by doc_id order by line rows unbounded preceding)), c as (select *, coalesce(bool_or(started and starts_with(lower(trim(t)), 'end of transcript')) over w, false) ended from b window w as (partition by doc_id order by line rows unbounded preceding)),
    e as (select *, case when not ended then s0 end s, not ended and s0 is null and trim(regexp_replace(regexp_replace(lower(trim(regexp_replace(t, '\s+', ' ', 'g'))), '[''‘’′]', '', 'g'), '\?+$', '')) in ('the campaigns issues', 'leaders') h from c where ended or not regexp_matches(trim(t), '^[0-9]{1,3}$|^[0-9]{1,2}:[0-9]{2}$')),
    f as (select *, count(s) over w turn0, count(*) filter (h) over w section0, max(case when s is not null then line end) over w sl, max(case when h then line end) over w hl from e window w as (partition by doc_id order by line rows unbounded preceding)),
    g as (select *, case when ended then 'back' when h then 'heading' when not started then 'front' when coalesce(hl, 0) > sl then 'loose' else 'turn' end part from f)
    select doc_id, part, case when part in ('front', 'back') then 0 else section0 end "section", case when part in ('front', 'back') then 0 else turn0 end turn, max(s) speaker, md5(string_agg(trim(case when part = 'turn' then regexp_replace(t, '^[A-Z][A-Za-z]{1,20}:', '') else t end), ' ' order by line)) text_md5 from g group by 1, 2, 3, 4""")
ITEMS = [("q1", "calm", False, 5), ("q2", "calm", True, 5), ("q3", "open", False, 5), ("q4", "open", True, 7)]
register("src06_survey", lambda s, d: tr.survey_attributes(table(s, d, "customer").select(F.col("c_custkey").alias("person"), F.to_json(F.struct((F.col("c_custkey") % 5 + 1).alias("q1"), (F.col("c_nationkey") % 5 + 1).alias("q2"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_custkey") % 4 + 1).alias("q3"), F.col("c_mktsegment").alias("q4"))).alias("payload")), s.createDataFrame(ITEMS, "question string, scale string, reverse boolean, top int")), "", """
    with a as (select c_custkey person, 'calm' scale, c_custkey % 5 + 1 x from customer union all select c_custkey, 'calm', 6 - (c_nationkey % 5 + 1) from customer union all select c_custkey, 'open', c_custkey % 4 + 1 from customer where c_custkey % 3 > 0 union all select c_custkey, 'open', null from customer)
    select person, scale, count(x) items, round(avg(x), 6) score from a group by 1, 2""")
def blocks(s, d):
    """The survey with its answers in two blocks; the second asks the first's question again."""
    q = lambda name, v: F.struct(F.lit(name).alias("id"), v.cast("string").alias("answer"))
    one, two = F.array(q("q1", F.col("c_custkey") % 5 + 1), q("q2", F.col("c_nationkey") % 5 + 1)), F.array(q("q3", F.col("c_custkey") % 4 + 1), q("q1", F.lit(9)))
    return table(s, d, "customer").select(F.col("c_custkey").alias("person"), F.to_json(F.struct(F.array(F.struct(one.alias("questions")), F.struct(two.alias("questions"))).alias("blocks"))).alias("payload"))


register("src06_nested_survey", lambda s, d: tr.survey_attributes(tr.nested_answers(blocks(s, d)), s.createDataFrame(ITEMS, "question string, scale string, reverse boolean, top int")), "", """
    with a as (select c_custkey person, 'calm' scale, c_custkey % 5 + 1 x from customer union all select c_custkey, 'calm', 6 - (c_nationkey % 5 + 1) from customer union all select c_custkey, 'open', c_custkey % 4 + 1 from customer) select person, scale, count(x) items, round(avg(x), 6) score from a group by 1, 2""")
register("src06_age_bucket", lambda s, d: tr.age_bucket(table(s, d, "part").select("p_partkey", F.when(F.col("p_size") > 40, F.concat(F.col("p_size").cast("string"), F.lit("+"))).when(F.col("p_size") > 5, F.concat_ws("-", F.col("p_size").cast("string"), (F.col("p_size") + 9).cast("string"))).otherwise("n/a").alias("bucket")), "bucket"), "", """
    select p_partkey, case when p_size > 40 then p_size || '+' when p_size > 5 then p_size || '-' || (p_size + 9) else 'n/a' end bucket, case when p_size > 40 then p_size when p_size > 5 then ceil((2 * p_size + 9) / 2.0)::int end age from part""")


def frozen(s, d):
    """A metric table written as CSV with its marks for NULL, and read back typed."""
    path = f"{shared_dir(s)}/metrics-{uuid.uuid4().hex[:8]}"
    v = F.when(F.col("o_orderkey") % 7 == 0, "None").when(F.col("o_orderkey") % 7 == 1, "null").when(F.col("o_orderkey") % 7 == 2, "n.a.").otherwise(F.col("o_totalprice").cast("string"))
    table(s, d, "orders").select(F.col("o_custkey").cast("string").alias("session_id"), (F.col("o_orderkey") % 3).cast("string").alias("replicate"), F.col("o_orderstatus").alias("metric_id"), v.alias("value")).write.option("header", True).csv(path)
    return tr.long_metrics(s, path)


register("src07_long_metrics", lambda s, d: frozen(s, d).groupBy("metric_id", "replicate").agg(F.count(F.lit(1)).alias("rows"), F.count("value").alias("n"), F.round(F.sum("value"), 2).alias("total")), "", """
    select o_orderstatus metric_id, (o_orderkey % 3)::int replicate, count(*) "rows", count(case when o_orderkey % 7 > 2 then o_totalprice end) n, round(sum(case when o_orderkey % 7 > 2 then o_totalprice end), 2) total from orders group by 1, 2""")
register("src08_fixed_schema", lambda s, d: tr.to_schema(table(s, d, "nation").withColumn("extra", F.lit(1)), "n_name string, n_nationkey bigint, note string"), "", "select n_name, n_nationkey, null note from nation")
register("src09_content_hash", lambda s, d: tr.content_hash(table(s, d, "documents"), ["doc_id", "lang", "text"], ["source"]), "", """
    select "source", sum(k)::bigint "rows", sha256(string_agg(d, '' order by b)) digest from (select "source", h[1:4] b, count(*) k, sha256(string_agg(h, '' order by h)) d from (select "source", sha256(doc_id || '|' || coalesce(lang, '') || '|' || coalesce(text, '')) h from documents) group by 1, 2) group by 1""")
register("src10_log_summary", lambda s, d: tr.log_summary(table(s, d, "events").withColumn("props", F.when(F.col("event_id") % 17 == 0, "oops").otherwise(F.col("props")))), "", """
    select event_type, count(*) n, count(*) filter (event_id % 17 = 0) corrupt, count(distinct user_id) sessions from events group by 1""")


def styled(s, d):
    return table(s, d, "conversations").where("role != 'system'").select((F.floor(F.col("conv_id") / 20)).alias("doc"), (F.col("turn") % 3).alias("question"), F.col("role").alias("participant"), (F.col("conv_id") * 100 + F.col("turn")).alias("ord"), "text", sty.n_words("text").alias("n_words"))


STC = """sc as (select conv_id // 20 doc, turn % 3 question, "role" participant, string_agg(text, ' ' order by conv_id * 100 + turn) text from conversations where "role" <> 'system' group by 1, 2, 3), sw as (select *, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') w from sc)"""


def grams_sql(sizes, budget=None):
    """Cells (of at least `budget` words, cut to them) and their n-grams of the given sizes."""
    cells_ = STC if budget is None else STC.replace("sc as", "s0 as").replace("from sc)", f"from s0), sc as (select * from sw0 where len(w) >= {budget}), sw as (select * replace (w[1:{budget}] as w) from sc)").replace("sw as (select *, list", "sw0 as (select *, list")
    return cells_ + f""", gw as (select doc, question, participant, ' ' || unnest(w) || ' ' w from sw),
    gg as (select doc, question, participant, unnest(flatten(list_transform({list(sizes)}, lambda n: case when length(w) <= n then [w] else list_transform(range(1, length(w) - n + 2), lambda i: substr(w, i, n)) end))) gram from gw), g as (select doc, question, participant, gram, count(*) tf from gg group by 1, 2, 3, 4)"""


GR = grams_sql((3, 4, 5))
register("sty01_cells", lambda s, d: sty.cells(styled(s, d)).select("doc", "question", "participant", "label", "words"), "", f"""with {STC}
    select doc, question, participant, 'S' || dense_rank() over (partition by doc order by participant) "label", len(w) words from sw""")
register("sty02_eligibility", lambda s, d: sty.eligibility(sty.cells(styled(s, d)), [100, 500, 900, 1500]), "", f"""with {STC}, j as (select doc, question, participant, budget, len(w) >= budget ok from sw cross join (select unnest([100, 500, 900, 1500]) budget)),
    o as (select *, sum(ok::int) over (partition by budget, doc, participant) - ok::int o from j), f as (select budget, doc, question, count(*) filter (ok and o >= 2) p from o group by 1, 2, 3) select budget, count(*) filter (p >= 2) folds, count(distinct case when p >= 2 then doc end) docs from f group by 1""")
ATT_TAIL = """, fo as (select distinct doc, question fold from sc), tr as (select g.*, fold from g join fo on fo.doc = g.doc and g.question <> fold), nn as (select sc.doc, fold, count(*) n from sc join fo on fo.doc = sc.doc and sc.question <> fold group by 1, 2),
    idf as (select tr.doc, tr.fold, gram, ln((1 + any_value(n)) / (1 + count(*))::double) + 1 idf from tr join nn on nn.doc = tr.doc and nn.fold = tr.fold group by 1, 2, 3),
    w0 as (select tr.*, tf * idf x from tr join idf using (doc, fold, gram)), w1 as (select *, x / sqrt(sum(x * x) over (partition by doc, fold, question, participant)) y from w0), cc as (select doc, fold, participant cand, gram, sum(y) c from w1 group by 1, 2, 3, 4), cn as (select doc, fold, cand, sqrt(sum(c * c)) norm from cc group by 1, 2, 3),
    te as (select g.doc, g.question fold, participant, g.gram, tf * idf x from g join idf on idf.doc = g.doc and idf.fold = g.question and idf.gram = g.gram), tn as (select doc, fold, participant, sqrt(sum(x * x)) tn from te group by 1, 2, 3), dd as (select te.doc, te.fold, te.participant, cand, sum(te.x * cc.c) d from te join cc on cc.doc = te.doc and cc.fold = te.fold and cc.gram = te.gram group by 1, 2, 3, 4),
    ss as (select dd.*, round(d / (norm * tn), 9) sim from dd join cn using (doc, fold, cand) join tn using (doc, fold, participant)), rk as (select *, row_number() over (partition by doc, fold, participant order by sim desc, cand) r, count(*) over (partition by doc, fold, participant) k from ss),
    att as (select doc, fold, participant truth, max(case when r = 1 then cand end) guess, max(k) candidates, round(max(case when r = 1 then sim end) - max(case when r = 2 then sim end), 6) margin from rk group by 1, 2, 3)"""
ATT = GR + ATT_TAIL
SUMM = ATT + """, sm as (select doc, count(*) trials, avg((truth = guess)::int) a, avg(1.0::double / candidates) c from att group by 1),
    lb as (select doc, truth l, count(*) n, count(*) filter (truth = guess) tp, (select count(*) from att b where b.doc = att.doc and b.guess = att.truth) pn from att group by 1, 2),
    mf as (select doc, avg(2 * tp / (n + pn)::double) f, avg(tp / n::double) r from lb group by 1),
    su as (select doc, trials, round(a, 6) accuracy, round(c, 6) chance, round((a - c) / nullif(1 - c, 0), 6) corrected, round(f, 6) macro_f1, round(r, 6) balanced_accuracy from sm join mf using (doc))"""
trials = lambda s, d: sty.attribute(sty.cells(styled(s, d)))
register("sty03_attribution", trials, "", f"with {ATT} select * from att")
register("sty04_trial_summary", lambda s, d: sty.trial_summary(trials(s, d)), "", f"with {SUMM} select * from su")
register("sty05_identity_gap", lambda s, d: sty.identity_gap(sty.cells(styled(s, d))), "", f"""with {GR}, x as (select *, tf / sqrt(sum(tf * tf) over (partition by doc, question, participant)) x from g), p as (select a.doc, a.question qa, b.question qb, a.participant pa, b.participant pb, sum(a.x * b.x) s from x a join x b on a.doc = b.doc and a.gram = b.gram and a.question < b.question group by 1, 2, 3, 4, 5),
    q as (select doc, qa, qb, quantile_cont(case when pa = pb then s end, 0.5) - quantile_cont(case when pa <> pb then s end, 0.5) d from p group by 1, 2, 3) select doc, count(*) pairs, round(quantile_cont(d, 0.5), 6) gap from q group by 1""")
register("sty06_within_question", lambda s, d: sty.within_question(sty.cells(styled(s, d))), "", f"""with {GR}, x as (select *, tf / sqrt(sum(tf * tf) over (partition by doc, question, participant)) x from g), p as (select a.doc, a.question, a.participant pa, b.participant pb, sum(a.x * b.x) s from x a join x b on a.doc = b.doc and a.gram = b.gram and a.question = b.question and a.participant < b.participant group by 1, 2, 3, 4),
    q as (select doc, question, quantile_cont(s, 0.5) m from p group by 1, 2) select doc, count(*) questions, round(quantile_cont(m, 0.5), 6) similarity from q group by 1""")
register("sty07_hierarchical", lambda s, d: sty.hierarchical(sty.trial_summary(trials(s, d)).withColumn("half", F.col("doc") % 2), "half"), "", f"with {SUMM} select doc % 2 half, count(accuracy) docs, round(avg(accuracy), 6) accuracy, round(avg(corrected), 6) corrected from su group by 1")
IN_ = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
register("sty08_pair_screen", lambda s, d: sty.pair_screen(styled(s, d).withColumn("doc", F.floor(F.col("ord") / 100)), 25, 3), "", rf"""
    with t as (select conv_id doc, "role" participant, turn % 3 question, conv_id * 100 + turn ord, regexp_extract_all(lower(text), '[a-z]{{4,}}') k, list_has_any(regexp_extract_all(lower(text), '[a-z]+'), {IN_(sty.NEGATION)}) ng, list_has_any(regexp_extract_all(lower(text), '[a-z]+'), {IN_(sty.FREQUENCY)}) or contains(lower(text), '{sty.FREQUENT_PHRASE}') fq
        from conversations where "role" <> 'system' and len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) >= 25),
    e as (select doc, participant, question, ord, unnest(k) term from t), f as (select doc, participant, question, ord, term, count(*) tf from e group by all), n as (select doc, participant, count(*) n from t group by 1, 2),
    i as (select doc, participant, term, ln((1 + any_value(n)) / (1 + count(*))::double) + 1 idf from f join n using (doc, participant) group by 1, 2, 3), w0 as (select f.*, tf * idf x from f join i using (doc, participant, term)),
    w as (select * replace (x / sqrt(sum(x * x) over (partition by doc, participant, ord)) as x) from w0), c as (select a.doc, a.participant, a.ord, b.ord ob, sum(a.x * b.x) c from w a join w b on a.doc = b.doc and a.participant = b.participant and a.term = b.term and a.question < b.question group by 1, 2, 3, 4),
    j as (select a.doc, a.participant, a.ord, b.ord ob, len(list_intersect(a.k, b.k)) shared, len(list_distinct(list_concat(a.k, b.k))) u, a.ng <> b.ng or a.fq <> b.fq contrast from t a join t b on a.doc = b.doc and a.participant = b.participant and a.question < b.question),
    s as (select j.*, round(coalesce(c, 0), 4) cosine from j left join c using (doc, participant, ord, ob)), l as (select (list(cosine order by cosine))[floor(count(*) * 0.7::double)::int + 1] lv from s)
    select doc, participant, ord, ob, shared, round(shared / nullif(u, 0)::double, 6) jaccard, coalesce(shared / nullif(u, 0)::double < 0.12, true) far, cosine, contrast, case when cosine >= lv and shared >= 3 then case when contrast then 'high_with_contrast' else 'high_without_contrast' end else 'control' end stratum from s, l""")
SWEEP = [(3, 5, 100), (3, 5, 50), (3, 5, 150), (3, 3, 100), (2, 3, 100)]
register("sty09_sweep", lambda s, d: sty.sweep(sty.cells(styled(s, d)), SWEEP), "", " union all ".join(f"select '{lo}-{hi}@{b}' setting, trials, accuracy from (with {grams_sql(range(lo, hi + 1), b)}{ATT_TAIL} select count(*) trials, round(avg((truth = guess)::int), 6) accuracy from att)" for lo, hi, b in SWEEP))

log = lambda s, d: us.read_log(s, f"{d}/events.parquet")


def newest(keys):
    return lambda df: df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("batch")))).where("_r = 1").drop("_r")


register("str01_usage_windows", lambda s, d: us.drain(us.usage_windows(log(s, d)), "update", shared_dir(s), newest(["window_start", "model"])), "", """
    select epoch(date_trunc('day', ts))::bigint window_start, event_type model, count(*) calls, count(*) filter (event_type = 'error') errors, sum((props->>'$.k')::bigint)::bigint tokens from events group by 1, 2""")
register("str01_sliding_windows", lambda s, d: us.drain(us.usage_windows(log(s, d), "7 days", slide="1 day"), "update", shared_dir(s), newest(["window_start", "model"])), "", """
    with w as (select *, unnest(range(0, 7)) back from events) select epoch(date_trunc('day', ts))::bigint - 86400 * back window_start, event_type model, count(*) calls, count(*) filter (event_type = 'error') errors, sum((props->>'$.k')::bigint)::bigint tokens from w group by 1, 2""")
register("str02_activity_sessions", lambda s, d: us.drain(us.activity_sessions(log(s, d)), "complete", shared_dir(s), newest(["user_id", "started"])), "", """
    with l as (select *, case when lag(ts) over (partition by user_id order by ts) + interval 6 hours >= ts then 0 else 1 end n from events), g as (select *, sum(n) over (partition by user_id order by ts rows unbounded preceding) k from l)
    select user_id, floor(epoch(min(ts)))::bigint started, floor(epoch(max(ts) + interval 6 hours))::bigint ended, count(*) calls, sum((props->>'$.k')::bigint)::bigint tokens, round(sum(value), 6) "value",
        first(event_id order by ts desc, event_id desc) last_event, first(event_type order by ts desc, event_id desc) last_kind, epoch_us(max(ts)) - epoch_us(min(ts)) elapsed_us from g group by user_id, k""")
register("str03_running_chains", lambda s, d: us.drain(us.running_chains(log(s, d)), "update", shared_dir(s), newest(["user_id"])).drop("expired"), "", """
    with o as (select *, sum(case when event_type = 'error' then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) k from events), r as (select user_id, k, count(*) filter (event_type <> 'error') n from o group by 1, 2)
    select user_id, arg_max(n, k) run, max(n) longest, (select count(*) from events e where e.user_id = r.user_id) events from r group by 1""")
register("str03_session_progress", lambda s, d: us.drain(us.session_progress(log(s, d)), "update", shared_dir(s), newest(["user_id"])), "", """
    with o as (select *, sum((event_type = 'error')::int) over (partition by user_id order by ts, event_id rows unbounded preceding) k from events), r as (select user_id, k, count(*) filter (event_type <> 'error') n from o group by 1, 2),
    c as (select user_id, arg_max(n, k) run, max(n) longest from r group by 1), g as (select user_id, count(*) filter (event_type = 'signup') section, count(*) calls, sum((props->>'$.k')::bigint)::bigint tokens,
        first(event_id order by ts desc, event_id desc) last_event, first(event_type order by ts desc, event_id desc) last_kind, epoch_us(max(ts)) - epoch_us(min(ts)) elapsed_us from events group by 1)
    select g.user_id, section, greatest(section - 1, 0) completed, least(greatest(section - 1, 0) / 5::double, 1) completion, run, longest, calls, tokens, last_event, last_kind, elapsed_us, case when section > 5 then 'complete' else 'running' end status from g join c using (user_id)""")
register("str04_deduplicated", lambda s, d: us.drain(us.deduplicated(log(s, d), ["user_id", "event_type"]), "append", shared_dir(s)).select("user_id", "event_type"), "", "select distinct user_id, event_type from events")
DATED = [("click", "2023-01-01", "2024-01-10", 0.5), ("click", "2024-01-10", None, 0.75), ("view", "2024-01-05", "2024-01-20", 0.25)]
dated = lambda s: s.createDataFrame(DATED, "model string, since string, until string, rate double").withColumns({c: F.col(c).cast("timestamp") for c in ("since", "until")})
register("str05_priced", lambda s, d: us.drain(us.priced(log(s, d), dated(s)), "append", shared_dir(s)), "", """
    select event_id, event_type, round(value * case when event_type = 'click' then case when ts >= timestamp '2024-01-10' then 0.75::double when ts >= timestamp '2023-01-01' then 0.5::double end when event_type = 'view' and ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-20' then 0.25::double end, 6) cost from events""")
