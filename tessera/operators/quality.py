"""Quality assessment of sessions, and the call log's audit and costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import listed, r6, ratio

SEVERITY = {"fail": 3, "warn": 2, "info": 1}


def integrity_flags(turns: DataFrame, expected: DataFrame) -> DataFrame:
    """Flag rows (session_id, flag, severity, n): blank turns, count mismatch with metadata, truncated texts, stage directions."""
    t = F.col("text")
    g = turns.groupBy("session_id").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("n_words") == 0).alias("blank"), F.count_if(~t.rlike(r"[.!?\"]\s*$")).alias("truncated"), F.count_if(t.rlike(r"\[[^\]]+\]|[*][^*]+[*]")).alias("stage"))
    g = g.join(expected, "session_id", "left").withColumn("mismatch", F.abs(F.coalesce(F.col("expected"), F.lit(0)) - F.col("_n")))
    long = g.unpivot(["session_id"], ["blank", "truncated", "stage", "mismatch"], "flag", "n").where("n > 0")
    return long.withColumn("severity", F.when(F.col("flag") == "mismatch", "fail").when(F.col("flag") == "blank", "warn").otherwise("info"))


def recommendation(flags: DataFrame) -> DataFrame:
    """Worst severity of a session's flags, counts, the rules that fired, and what to do."""
    rank = F.coalesce(*(F.when(F.col("severity") == k, v) for k, v in SEVERITY.items()))
    g = flags.groupBy("session_id").agg(F.max(rank).alias("worst"), F.count_if(F.col("severity") == "fail").alias("fails"), F.count_if(F.col("severity") == "warn").alias("warns"), F.array_sort(F.collect_set("flag")).alias("rules"))
    return g.withColumn("recommendation", F.when(F.col("fails") > 0, "reject").when(F.col("warns") > 1, "review").otherwise("accept"))


def readiness(turns: DataFrame, roster_size: int) -> DataFrame:
    """Findings per session as rows: too few turns, no moderator, roster mismatch; a hash of the content, and the verdict. The hash is that of two sums over hashes of turns (place, role, speaker, text),
    so it doesn't depend on the order of rows and no session is gathered."""
    line = F.concat_ws("|", F.col("turn_index").cast("string"), *(F.coalesce(c, F.lit("")) for c in ("role", "speaker_id", "text")))
    t = turns.withColumn("_h", F.sha2(line, 256))
    part = lambda a: F.sum(F.conv(F.substring("_h", a, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    g = t.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col("role") == "moderator", F.lit(False))).alias("m"), F.count_distinct(F.when(F.col("role") == "participant", F.col("speaker_id"))).alias("k"), part(1).alias("_a"), part(16).alias("_b"))
    f = F.array_compact(F.array(F.when(F.col("n") < 5, "few_turns"), F.when(F.col("m") == 0, "no_moderator"), F.when(F.col("k") != roster_size, "roster_mismatch")))
    return g.select("session_id", "n", F.sha2(F.concat_ws("|", F.col("n").cast("string"), "_a", "_b"), 256).alias("content_hash"), f.alias("findings"), F.when(F.size(f) == 0, "ready").otherwise("not_ready").alias("verdict"))


def transcript_compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two versions of sessions by position (session_id, pos, speaker_id, text): equal, or the first position and field that differ."""
    j = a.join(b.withColumnsRenamed({"speaker_id": "_s", "text": "_t"}), ["session_id", "pos"], "full")
    field = F.when(F.col("text").isNull() | F.col("_t").isNull(), "length").when(F.col("speaker_id") != F.col("_s"), "speaker").when(F.col("text") != F.col("_t"), "text")
    return j.groupBy("session_id").agg(F.min(F.when(field.isNotNull(), F.struct("pos", field.alias("field")))).alias("_f"), F.count_if(field.isNotNull()).alias("differences")).select("session_id", "differences", F.col("_f.pos").alias("first"), F.col("_f.field").alias("field"))


def structure_checks(turns: DataFrame, expected: DataFrame) -> DataFrame:
    """Leaks of structure into turns: headings, embedded labels, page numbers; and turns against the metadata's count (session_id, expected), which
    differ if it has none."""
    t = F.col("text")
    g = turns.groupBy("session_id").agg(F.count(F.lit(1)).alias("turns"), F.count_if(t.rlike("^[A-Z ]+$")).alias("headings"), F.count_if(t.rlike(r"(^|\n)[A-Z][a-z]+:")).alias("labels"), F.count_if(t.rlike(r"(^|\n)[0-9]{1,3}(\n|$)")).alias("page_numbers"))
    return g.join(expected.hint("merge"), "session_id", "left").withColumn("matches", F.coalesce(F.col("turns") == F.col("expected"), F.lit(False)))


def reconcile_table(computed: DataFrame, stated: DataFrame, tolerance: float) -> DataFrame:
    """Recomputed values (metric, value, n_source) against stated ones: provenance and whether they agree."""
    j = computed.join(stated.withColumnRenamed("value", "stated"), "metric", "full")
    state = F.when(F.col("stated").isNull(), "unstated").when(F.col("value").isNull(), "unsupported").when(F.abs(F.col("value") - F.col("stated")) <= tolerance, "agrees").otherwise("differs")
    return j.select("metric", r6("value").alias("value"), r6("stated").alias("stated"), "n_source", state.alias("state"))


def call_audit(calls: DataFrame) -> DataFrame:
    """Per session of a call log (session_id, event, model, input_tokens, output_tokens, error_type, attempt, fallback, coerced, truncated, stop_reason):
    totals, rates over the calls they concern, stop reasons, and participants silenced by a fault. NULL or `none` marks no error and no coercion. A run
    that logs `coerced` at all retries faults, so only faults that outlast the retry silence; in other runs a first fault does, too."""
    is_ = lambda *names: F.col("event").isin(*names)
    n = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    named = lambda c: F.coalesce(c, F.lit("none")) != "none"
    error, assess = F.col("error_type"), is_("engagement", "engagement_retry")
    lasting = F.coalesce(error.isin("fallback_after_retry", "api_error"), F.lit(False))
    g = calls.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("calls"), F.count_distinct("model").alias("models"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        n(named(error)).alias("errors"), n(F.col("attempt") > 1).alias("retries"), n(is_("decision")).alias("decisions"), n(is_("decision") & F.col("fallback")).alias("fallbacks"),
        n(is_("response")).alias("responses"), n(is_("response") & F.col("truncated")).alias("truncated"), n(is_("engagement") & (F.coalesce("attempt", F.lit(1)) == 1)).alias("assessments"),
        n(named(F.col("coerced"))).alias("coerced"), F.max(F.col("coerced").isNotNull()).alias("retry_path"), n(assess & lasting).alias("_lasting"), n(is_("engagement") & named(error) & ~lasting & (error != "recovered_on_retry")).alias("_first"),
    )
    g = g.withColumn("forced_silences", F.col("_lasting") + F.when(F.col("retry_path"), 0).otherwise(F.col("_first"))).drop("_lasting", "_first")
    rates = {"error_rate": ("errors", "calls"), "retry_rate": ("retries", "calls"), "fallback_rate": ("fallbacks", "decisions"), "truncation_rate": ("truncated", "responses"), "coercion_rate": ("coerced", "assessments"), "forced_silence_rate": ("forced_silences", "assessments")}
    why = calls.where("event = 'response' and stop_reason is not null").groupBy("session_id", "stop_reason").agg(F.count(F.lit(1)).alias("_k"))
    why = why.groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "stop_reason", F.col("_k").cast("string")))), "|").alias("stop_reasons"))
    return g.join(why, "session_id", "left").withColumns({k: r6(ratio(*v)) for k, v in rates.items()})


def split_cache_writes(calls: DataFrame) -> DataFrame:
    """Adds write_5m, write_1h and write_unknown from cache_writes (all written tokens), five, hour (those whose time to live is named) and ttl: what the
    total holds beyond the named ones takes the declared time to live, and without one stays unknown."""
    five, hour = F.coalesce("five", F.lit(0)), F.coalesce("hour", F.lit(0))
    rest = F.greatest(F.coalesce("cache_writes", F.lit(0)), five + hour) - five - hour
    of = lambda t: F.when(F.col("ttl") == t, rest).otherwise(0)
    return calls.withColumns({"write_5m": five + of("5m"), "write_1h": hour + of("1h"), "write_unknown": F.when(F.coalesce(F.col("ttl").isin("5m", "1h"), F.lit(False)), 0).otherwise(rest)})


TOKENS = ["input_tokens", "output_tokens", "cache_read", "write_5m", "write_1h", "write_unknown"]


def usage_cost(calls: DataFrame, rates: DataFrame, by: list[str]) -> DataFrame:
    """Tokens by `by` and model, with their cost from a rate table (model, currency and prices of a million tokens: input, output, cache_read, write_5m,
    write_1h). A call without a model stays unattributed, a model without a rate or without a rate that its tokens need unpriced, never 0. Writes of
    unknown time to live give bounds where their two prices differ, and then no cost."""
    u = calls.groupBy(*by, "model").agg(F.count(F.lit(1)).alias("calls"), *(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in TOKENS))
    j = u.join(listed(rates.withColumn("_rate", F.lit(True)).withColumnsRenamed({"input": "_in", "output": "_out", "cache_read": "_cr", "write_5m": "_5", "write_1h": "_1"})), "model", "left")
    writes = F.col("write_5m") + F.col("write_1h") + F.col("write_unknown")
    lacks = ((F.col("cache_read") > 0) & F.col("_cr").isNull()) | ((writes > 0) & (F.col("_5").isNull() | F.col("_1").isNull()))
    status = F.when(F.col("model").isNull(), "unattributed").when(F.col("_rate").isNull(), "no_rate").when(lacks, "incomplete_rate").when((F.col("write_unknown") > 0) & (F.col("_5") != F.col("_1")), "ttl_unknown").otherwise("priced")
    price = lambda tokens, rate: F.col(tokens) * F.coalesce(rate, F.lit(0.0)) / 1e6
    base = price("input_tokens", "_in") + price("output_tokens", "_out") + price("cache_read", "_cr") + price("write_5m", "_5") + price("write_1h", "_1")
    known = F.col("status").isin("priced", "ttl_unknown")
    j = j.withColumn("status", status).withColumns({"cost_low": F.when(known, base + price("write_unknown", F.least("_5", "_1"))), "cost_high": F.when(known, base + price("write_unknown", F.greatest("_5", "_1")))})
    return j.select(*by, "model", "calls", *TOKENS, "currency", "status", r6("cost_low").alias("cost_low"), r6("cost_high").alias("cost_high"), r6(F.when(F.col("status") == "priced", F.col("cost_low"))).alias("cost"))


def cost_totals(costs: DataFrame, by: list[str]) -> DataFrame:
    """Totals of usage_cost rows: a total only if every row is priced, bounds only if every row has them, neither across currencies."""
    g = costs.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.count("cost").alias("_k"), F.count("cost_low").alias("_b"), F.count_distinct("currency").alias("currencies"), F.min("currency").alias("_c"), *(F.sum(c).alias(c) for c in ("cost", "cost_low", "cost_high")))
    one = F.col("currencies") == 1
    bounds = {c: r6(F.when(one & (F.col("_b") == F.col("_n")), F.col(c))) for c in ("cost_low", "cost_high")}
    return g.select(*by, "currencies", F.when(one, F.col("_c")).alias("currency"), (F.col("_n") - F.col("_k")).alias("undetermined"), r6(F.when(one & (F.col("_k") == F.col("_n")), F.col("cost"))).alias("cost"), *(v.alias(k) for k, v in bounds.items()))


def projected_cost(totals: DataFrame, by: list[str], sessions: int) -> DataFrame:
    """cost_totals rows of sessions to a number of sessions: mean, least and greatest determined cost times it; others are excluded and counted, and
    there is no figure across currencies or without a determined cost."""
    ok = F.col("cost").isNotNull()
    g = totals.groupBy(*by).agg(F.count_if(ok).alias("observed"), F.count_if(~ok).alias("excluded"), F.count_distinct(F.when(ok, F.col("currency"))).alias("_c"), F.avg("cost").alias("_m"), F.min("cost").alias("_lo"), F.max("cost").alias("_hi"))
    of = lambda c: r6(F.when(F.col("_c") == 1, F.col(c) * sessions))
    return g.select(*by, "observed", "excluded", of("_m").alias("projected"), of("_lo").alias("projected_min"), of("_hi").alias("projected_max"))


def stage_durations(rows: DataFrame) -> DataFrame:
    """(stage, started, ended): n, missing ends, min, median, mean, max and total seconds; wall clock only if all have ended."""
    s = F.unix_micros("ended") / 1e6 - F.unix_micros("started") / 1e6
    g = rows.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ended").isNull()).alias("missing"), r6(F.min(s)).alias("min_s"), r6(F.percentile(s, F.lit(0.5))).alias("median_s"), r6(F.avg(s)).alias("mean_s"), r6(F.max(s)).alias("max_s"), r6(F.sum(s)).alias("total_s"), (F.max(F.unix_micros("ended")) - F.min(F.unix_micros("started"))).alias("_w"))
    return g.withColumn("wall_s", F.when(F.col("missing") == 0, r6(F.col("_w") / 1e6))).drop("_w")
