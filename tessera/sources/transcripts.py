"""Sources, sinks and schema work: transcripts, survey payloads, metric tables, logs, content hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.text import r6


def canonical_turns(entries: DataFrame) -> DataFrame:
    """Two entry schemas (human: speaker_role; synthetic: selection_mode) as one turn table; a blank speaker is unresolved, never guessed."""
    speaker = F.when(F.trim(F.coalesce("speaker_id", F.lit(""))) != "", F.col("speaker_id"))
    role = F.when(F.upper(speaker) == "MODERATOR", "moderator").when(speaker.isNotNull(), "participant")
    gaps = F.array_compact(F.array(F.when(speaker.isNull(), "speaker"), F.when(F.trim(F.coalesce("content", F.lit(""))) == "", "text")))
    order = F.row_number().over(W.partitionBy("session_id").orderBy("turn"))
    return entries.select("session_id", order.alias("turn_index"), F.col("turn").cast("string").alias("original_turn_id"), speaker.alias("speaker_id"), role.alias("role"), "content", gaps.alias("unresolved"))


def detect_schema(entries: DataFrame) -> DataFrame:
    """Whole-session classification by the fields that any entry carries: human, synthetic, mixed or neither."""
    g = entries.groupBy("session_id").agg(F.count("speaker_role").alias("human_fields"), F.count("selection_mode").alias("synthetic_fields"))
    h, s = F.col("human_fields") > 0, F.col("synthetic_fields") > 0
    return g.withColumn("schema", F.when(h & s, "mixed").when(h, "human").when(s, "synthetic").otherwise("neither"))


def turn_audit(entries: DataFrame) -> DataFrame:
    """Per session: rows without a required field, duplicate turn ids, missing ids inside the range, empty turns; nothing is dropped."""
    n = entries.groupBy("session_id", "turn").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.trim(F.coalesce("content", F.lit(""))) == "").alias("e"), F.count_if(F.col("speaker_id").isNull() | F.col("turn").isNull()).alias("inc"))
    return n.groupBy("session_id").agg(F.sum("n").alias("rows"), F.sum("inc").alias("incomplete"), F.count_if(F.col("n") > 1).alias("duplicates"), (F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("missing"), F.sum("e").alias("empty"))


def artefact_status(files: DataFrame, expected: DataFrame) -> DataFrame:
    """(session_id, artefact, content) rows against expected (artefact, required): loaded, malformed (not JSON), or missing."""
    ok = F.get_json_object("content", "$").isNotNull()
    j = files.select("session_id").distinct().crossJoin(tx.listed(expected)).join(files.withColumn("_ok", ok), ["session_id", "artefact"], "left")
    state = F.when(F.col("_ok").isNull(), F.when(F.col("required"), "missing_required").otherwise("missing_optional")).when(F.col("_ok"), "loaded").otherwise("malformed")
    return j.select("session_id", "artefact", state.alias("state"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): lines of text files with their numbers, from 1. A file may be read in many splits: lines are numbered inside a split, and the splits' counts, a row a split, are added up."""
    df = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_id"), "value")
    splits = df.groupBy("file", "_b").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    splits = splits.withColumn("_base", F.coalesce(F.sum("_n").over(W.partitionBy("file").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return df.join(splits.drop("_n").hint("merge"), ["file", "_b"]).select("file", (F.col("_id") - F.col("_first") + F.col("_base") + 1).alias("line"), "value")


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value, error): lines of JSON-lines files but for blank ones; `error` says what is wrong with a line that isn't JSON, and nothing stops at it."""
    df = numbered_lines(spark, path).where(F.trim("value") != "")
    return df.withColumn("error", F.when(F.try_parse_json("value").isNull(), F.concat(F.lit("Malformed JSON in "), F.element_at(F.split("file", "/"), -1), F.lit(" line "), F.col("line").cast("string"))))


def file_artefacts(lines: DataFrame, sessions: DataFrame, expected: DataFrame) -> DataFrame:
    """Sessions' files against the expected list. lines: session_id, artefact, line, error (of json_lines); sessions: session_id; expected: artefact, required. State is loaded, malformed (a line isn't JSON) or
    missing; records are good lines, bad_lines the numbers of the others."""
    g = lines.groupBy("session_id", "artefact").agg(F.count_if(F.col("error").isNull()).alias("records"), F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.col("line")))).alias("bad_lines"))
    j = sessions.select("session_id").distinct().crossJoin(tx.listed(expected)).join(g, ["session_id", "artefact"], "left")
    state = F.when(F.col("records").isNull(), F.when(F.col("required"), "missing_required").otherwise("missing_optional")).when(F.size("bad_lines") > 0, "malformed").otherwise("loaded")
    return j.select("session_id", "artefact", state.alias("state"), F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("bad_lines", F.array().cast("array<bigint>")).alias("bad_lines"))


def lines_to_turns(texts: DataFrame) -> DataFrame:
    """(doc_id, text) to turns: a `Speaker:` line opens a turn, later lines append, bare numbers and times are left out; lines before the first
    speaker are front matter (turn 0)."""
    lines = texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t")).where(~F.trim("t").rlike("^[0-9]{1,3}$|^[0-9]{1,2}:[0-9]{2}$"))
    speaker = F.regexp_extract("t", r"^([A-Z][A-Za-z]{1,20}):", 1)
    w = W.partitionBy("doc_id").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    df = lines.withColumn("_s", F.when(speaker != "", speaker)).withColumn("turn", F.count("_s").over(w))
    body = F.trim(F.regexp_replace("t", r"^[A-Z][A-Za-z]{1,20}:", ""))
    g = df.groupBy("doc_id", "turn").agg(F.max("_s").alias("speaker"), F.array_sort(F.collect_list(F.struct("line", body.alias("b")))).alias("_l"))
    return g.select("doc_id", "turn", "speaker", F.array_join(F.transform("_l", lambda x: x["b"]), " ").alias("text"))


#: What a line after the dialogue's start begins with, in lower case, when the dialogue is over.
THE_END = "end of transcript"


def heading_key(c: Column) -> Column:
    """How headings compare: lower case, single spaces, no apostrophes, no question marks at the end."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))), r"['‘’′]", ""), r"\?+$", ""))


def transcript_parts(texts: DataFrame, headings: list[str]) -> DataFrame:
    """(doc_id, text) to (doc_id, part, section, turn, speaker, text). A `Speaker:` line opens a turn, a line of the list `headings` closes it and opens the next section (from 1; 0 before the first).
    Parts: front (what stands before the first speaker), heading, turn, loose (lines between a heading and the next speaker), back (from a line that begins with THE_END, once somebody
    has spoken). Bare numbers and times are left out up to there; text without a line for a part gives no row, null text none at all."""
    w = W.partitionBy("doc_id").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    df = texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    name = F.regexp_extract("t", r"^([A-Z][A-Za-z]{1,20}):", 1)
    df = df.withColumn("_s", F.when(name != "", name)).withColumn("_started", F.count("_s").over(w) > 0)
    df = df.withColumn("_ended", F.max(F.col("_started") & F.lower(F.trim("t")).startswith(THE_END)).over(w))
    df = df.where("_ended" + r" or not trim(t) rlike '^[0-9]{1,3}$|^[0-9]{1,2}:[0-9]{2}$'")
    listed = F.array_contains(F.array(*(heading_key(F.lit(h)) for h in headings)), heading_key(F.col("t"))) if headings else F.lit(False)
    df = df.withColumns({"_s": F.when(~F.col("_ended"), F.col("_s")), "_h": ~F.col("_ended") & F.col("_s").isNull() & listed})
    df = df.withColumns({"turn": F.count("_s").over(w), "section": F.count_if("_h").over(w), "_open": F.last(F.when(F.col("_s").isNotNull(), "turn").when(F.col("_h"), "loose"), True).over(w)})
    part = F.when(F.col("_ended"), "back").when(F.col("_h"), "heading").when(~F.col("_started"), "front").otherwise(F.col("_open"))
    df = df.withColumn("part", part)
    outside = F.col("part").isin("front", "back")
    df = df.withColumns({"turn": F.when(outside, 0).otherwise(F.col("turn")), "section": F.when(outside, 0).otherwise(F.col("section"))})
    body = F.trim(F.when(F.col("part") == "turn", F.regexp_replace("t", r"^[A-Z][A-Za-z]{1,20}:", "")).otherwise(F.col("t")))
    g = df.groupBy("doc_id", "part", "section", "turn").agg(F.max("_s").alias("speaker"), F.array_sort(F.collect_list(F.struct("line", body.alias("b")))).alias("_l"))
    return g.select("doc_id", "part", "section", "turn", "speaker", F.array_join(F.transform("_l", lambda x: x["b"]), " ").alias("text"))


def nested_answers(df: DataFrame) -> DataFrame:
    """Surveys whose answers stand in blocks of questions (`blocks[].questions[]` with id and answer) as flat ones: person, payload."""
    blocks = F.from_json("payload", "blocks array<struct<questions array<struct<id string, answer string>>>>")["blocks"]
    asked = F.filter(F.flatten(F.filter(F.transform(blocks, lambda b: b["questions"]), lambda q: q.isNotNull())), lambda q: q["id"].isNotNull())
    first = F.filter(asked, lambda q, i: F.array_position(F.transform(asked, lambda x: x["id"]), q["id"]) == i + 1)  # the first answer to a question counts
    return df.select("person", F.to_json(F.map_from_entries(F.transform(first, lambda q: F.struct(q["id"], q["answer"])))).alias("payload"))


def survey_attributes(answers: DataFrame, items: DataFrame) -> DataFrame:
    """JSON answers by question id to scale means; reverse-scored items count max + 1 - x. items: question, scale, reverse, top."""
    a = answers.select("person", F.explode(F.from_json("payload", "map<string,string>")).alias("question", "v")).withColumn("x", F.expr("try_cast(v as double)"))
    j = a.join(tx.listed(items), "question").withColumn("x", F.when(F.col("reverse"), F.col("top") + 1 - F.col("x")).otherwise(F.col("x")))
    return j.groupBy("person", "scale").agg(F.count("x").alias("items"), r6(F.avg("x")).alias("score"))


def age_bucket(df: DataFrame, column: str) -> DataFrame:
    """`18-29` gives its middle, `65+` its start; anything else NULL."""
    lo, hi = (F.expr(f"try_cast(nullif(regexp_extract({column}, '^([0-9]+)(?:-([0-9]+)|[+])$', {k}), '') as int)") for k in (1, 2))
    return df.withColumn("age", F.when(hi.isNotNull(), F.ceil((lo + hi) / 2)).otherwise(lo).cast("int"))


def long_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Typed read of a long metric table; '', None and null are NULL, the replicate comes from its column."""
    raw = spark.read.csv(path, header=True, schema="session_id string, replicate string, metric_id string, value string")
    null = lambda c: F.when(~F.col(c).isin("", "None", "null"), F.col(c))
    return raw.select("session_id", F.expr("try_cast(replicate as int)").alias("replicate"), "metric_id", null("value").alias("_v")).withColumn("value", F.expr("try_cast(_v as double)")).drop("_v")


def to_schema(df: DataFrame, schema: str) -> DataFrame:
    """Columns of a fixed schema in its order: extra ones ignored, missing ones NULL; an empty table keeps the schema."""
    want = df.sparkSession.createDataFrame([], schema).schema
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want))


def content_hash(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """SHA-256 of each group: of the digests of its buckets (row hashes by their first four digits, sorted), so a task holds a bucket's hashes or at most
    65,536 digests."""
    h = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)
    part = df.select(*by, h.alias("_h")).groupBy(*by, F.substring("_h", 1, 4).alias("_b")).agg(F.count(F.lit(1)).alias("_k"), F.sha2(F.array_join(F.array_sort(F.collect_list("_h")), ""), 256).alias("_d"))
    digests = F.transform(F.array_sort(F.collect_list(F.struct("_b", "_d"))), lambda x: x["_d"])
    return part.groupBy(*by).agg(F.sum("_k").alias("rows"), F.sha2(F.array_join(digests, ""), 256).alias("digest"))


def log_summary(events: DataFrame) -> DataFrame:
    """Events by action, with those whose payload is not JSON."""
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.get_json_object("props", "$.k").isNull()).alias("corrupt"), F.count_distinct("user_id").alias("sessions"))
