"""The given tables as the engine's model tables: turns, design, presence, embeddings, call log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import n_words


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def turns(spark: SparkSession, d: str) -> DataFrame:
    """Two-party sessions: the assistant moderates, the user takes part, system turns are not dialogue."""
    role = F.when(F.col("role") == "assistant", "moderator").when(F.col("role") == "user", "participant")
    side = F.element_at(F.array(F.lit("human"), F.lit("a"), F.lit("b")), (F.col("conv_id") % 3 + 1).cast("int"))
    return table(spark, d, "conversations").select(
        F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("turn_index"), F.col("role").alias("speaker_id"), role.alias("role"), "text",
        n_words("text").alias("n_words"), side.alias("condition"), (F.col("conv_id") % 5).alias("group_id"), (F.col("turn") / 4).cast("int").alias("section"),
    )


def panel(spark: SparkSession, d: str) -> DataFrame:
    """Many-party sessions from documents: a source's documents in blocks of 200 ids; the language speaks, Spanish moderates. Blocks keep
    sessions small however large a source grows."""
    block = F.floor(F.col("doc_id") / 200)
    role = F.when(F.col("lang") == "es", "moderator").otherwise("participant")
    return table(spark, d, "documents").select(
        F.concat_ws(":", "source", block.cast("string")).alias("session_id"), F.col("doc_id").alias("turn_index"), F.col("lang").alias("speaker_id"), role.alias("role"), "text",
        n_words("text").alias("n_words"), F.element_at(F.array(F.lit("human"), F.lit("a"), F.lit("b")), (block % 3 + 1).cast("int")).alias("condition"), F.col("source").alias("group_id"),
        (F.floor(F.col("doc_id") % 200 / 50)).cast("int").alias("section"),
    )


SESSION = ["condition", "group_id", "replicate"]


def _coded(spark: SparkSession, d: str) -> DataFrame:
    replicate = F.when(F.col("c_mktsegment") == "BUILDING", 0).otherwise(F.col("o_orderkey") % 3 + 1)
    return (
        table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
        .join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, d, "nation").select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        .select(F.col("c_mktsegment").alias("condition"), F.col("n_regionkey").alias("group_id"), replicate.alias("replicate"), F.col("p_brand").alias("code"), F.col("c_custkey").alias("speaker"))
    )


def presence(spark: SparkSession, d: str) -> DataFrame:
    """Codes of sessions: a code is present if it ranks among the ten most frequent of its session; replicate 0 of BUILDING is the
    reference. Counts are formed first, so the ranking window holds one row for each session and code."""
    from pyspark.sql import Window as W

    each = _coded(spark, d).groupBy(*SESSION, "code", "speaker").agg(F.count(F.lit(1)).alias("n"))
    people = each.select(*SESSION, "speaker").distinct().groupBy(*SESSION).agg(F.count(F.lit(1)).alias("participants"))
    by_code = each.groupBy(*SESSION, "code").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("voiced"))
    rank = F.row_number().over(W.partitionBy(*SESSION).orderBy(F.desc("n"), "code"))
    return by_code.withColumn("present", rank <= 10).join(people, SESSION)


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Embedded turns: blocks of 60 ids of a label are units, five speakers take turns."""
    unit = F.concat_ws(":", F.col("label").cast("string"), F.floor(F.col("vec_id") / 200).cast("string"))
    return table(spark, d, "embeddings").select(unit.alias("unit"), (F.col("vec_id") % 5).alias("speaker"), F.col("vec_id").alias("turn_index"), F.col("embedding").cast("array<double>").alias("v"))


def calls(spark: SparkSession, d: str) -> DataFrame:
    """The call log: model = event type, session = user, tokens from props and value."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("session_id"), F.col("event_type").alias("model"), (F.col("user_id") % 3).alias("role"), k.alias("input_tokens"), F.floor("value").cast("int").alias("output_tokens"), (F.col("event_type") == "error").alias("failed")
    )


#: The same tables in DuckDB SQL, for the oracles.
SQL = {
    "turns": r"""turns as (select conv_id::varchar session_id, turn turn_index, role speaker_id, case role when 'assistant' then 'moderator' when 'user' then 'participant' end "role", text,
        len(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '')) n_words, (['human', 'a', 'b'])[conv_id % 3 + 1] "condition", conv_id % 5 group_id, turn // 4 section from conversations)""",
    "panel": r"""panel as (select source || ':' || (doc_id // 200)::varchar session_id, doc_id turn_index, lang speaker_id, case when lang = 'es' then 'moderator' else 'participant' end "role", text,
        len(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '')) n_words, (['human', 'a', 'b'])[(doc_id // 200) % 3 + 1] "condition", source group_id, (doc_id % 200) // 50 section from documents)""",
    "presence": r"""coded as (select c_mktsegment "condition", n_regionkey group_id, case when c_mktsegment = 'BUILDING' then 0 else o_orderkey % 3 + 1 end replicate, p_brand code, c_custkey speaker
        from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join part on l_partkey = p_partkey),
        presence as (select c.*, row_number() over (partition by "condition", group_id, replicate order by n desc, code) <= 10 present, participants
        from (select "condition", group_id, replicate, code, count(*) n, count(distinct speaker) voiced from coded group by all) c
        join (select "condition", group_id, replicate, count(distinct speaker) participants from coded group by all) using ("condition", group_id, replicate))""",
    "vectors": r"""vectors as (select label::varchar || ':' || (vec_id // 200)::varchar unit, vec_id % 5 speaker, vec_id turn_index, embedding::double[] v from embeddings)""",
    "calls": r"""calls as (select event_id, ts, user_id session_id, event_type model, user_id % 3 "role", (props->>'$.k')::int input_tokens, floor(value)::int output_tokens, event_type = 'error' failed from events)""",
}


def sql(base: str, body: str) -> str:
    """An oracle: the named model tables, then the statement (which may go on with further common tables)."""
    return "with " + ", ".join(SQL[b] for b in base.split()) + (", " if not body.lstrip().lower().startswith("select") else " ") + body
