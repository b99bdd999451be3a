"""Structured Streaming over the append-only call log: roll-ups, activity sessions, running chains, deduplication, pricing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import listed, r6


def read_log(spark: SparkSession, path: str, files_a_batch: int | None = None) -> DataFrame:
    """The log as a stream of the event files under a folder or pattern, in batches of so many files."""
    schema = spark.read.parquet(path).schema
    # a pattern, for the file source takes a plain path for a folder
    return spark.readStream.schema(schema).options(**({"maxFilesPerTrigger": files_a_batch} if files_a_batch else {})).parquet(f"{path[:-1]}[{path[-1]}]").withColumn("ts", F.col("ts").cast("timestamp"))


def usage_windows(log: DataFrame, width: str = "1 day", late: str = "2 days", slide: str | None = None) -> DataFrame:
    """Calls, errors and tokens by model in windows that start every `slide` (tumbling without one); rows later than the watermark are left out."""
    k = F.get_json_object("props", "$.k").cast("long")
    w = log.withWatermark("ts", late).groupBy(F.window("ts", width, slide), F.col("event_type").alias("model"))
    g = w.agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("event_type") == "error").alias("errors"), F.sum(k).alias("tokens"))
    return g.select(F.unix_timestamp(F.col("window.start")).alias("window_start"), "model", "calls", "errors", "tokens")


def activity_sessions(log: DataFrame, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    """Bursts of activity of each user with no pause of `gap`: calls, tokens, value, the last event (by time, then id) and its kind, and the microseconds from the first to the last."""
    k, last = F.get_json_object("props", "$.k").cast("long"), F.max(F.struct("ts", "event_id", "event_type"))
    g = log.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("calls"), F.sum(k).alias("tokens"), r6(F.sum("value")).alias("value"), F.min("ts").alias("_a"), last.alias("_z"))
    ends = [F.unix_timestamp(F.col("w.start")).alias("started"), F.unix_timestamp(F.col("w.end")).alias("ended")]
    return g.select("user_id", *ends, "calls", "tokens", "value", F.col("_z.event_id").alias("last_event"), F.col("_z.event_type").alias("last_kind"), (F.unix_micros("_z.ts") - F.unix_micros("_a")).alias("elapsed_us"))


def running_chains(log: DataFrame, breaks: str = "error", idle: str = "40 days", late: str = "2 days") -> DataFrame:
    """For each user the current and longest run of events without a break, kept as state across batches (three numbers a user).
    Events of a batch are ordered by time; the file source gives batches in order. A user idle for `idle` of event time gets a last row marked
    `expired` and loses the state; events that come after it start anew."""
    wait = int(log.sparkSession.sql(f"select unix_millis(timestamp_millis(0) + interval {idle})").first()[0])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, longest, seen = state.get if state.exists else (0, 0, 0)
        if expired := state.hasTimedOut:
            state.remove()
        else:
            rows = pd.concat(batches).sort_values(["ms", "event_id"])
            for kind in rows["event_type"]:
                run = 0 if kind == breaks else run + 1
                longest, seen = max(longest, run), seen + 1
            state.update((run, longest, seen))
            state.setTimeoutTimestamp(max(int(rows["ms"].max()) + wait, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]], "run": [run], "longest": [longest], "events": [seen], "expired": [expired]})

    rows = log.withWatermark("ts", late).select("user_id", "event_id", "ts", F.unix_millis("ts").alias("ms"), "event_type")
    out = "user_id long, run long, longest long, events long, expired boolean"
    return rows.groupBy("user_id").applyInPandasWithState(step, out, "run long, longest long, seen long", "update", GroupStateTimeout.EventTimeTimeout)


def session_progress(log: DataFrame, opens: str = "signup", breaks: str = "error", planned: int = 5, idle: str = "40 days", late: str = "2 days") -> DataFrame:
    """Progress of each user, kept as state across batches: the section (how many events of kind `opens` came so far; 0 before the first), sections completed (each is by
    the opening of the next), their share of those planned (1 at most), current and longest run without a break, calls, tokens, the last event's id and kind, and the microseconds since the first.
    Status is running, complete (all planned sections are) or expired: a user idle for `idle` of event time gets a last row of that status from a timer and loses the state."""
    wait = int(log.sparkSession.sql(f"select unix_millis(timestamp_millis(0) + interval {idle})").first()[0])
    kept = "section long, run long, longest long, calls long, tokens long, first_us long, last_us long, last_event long, last_kind string"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        section, run, longest, calls, tokens, first, last, event, kind = state.get if state.exists else (0, 0, 0, 0, 0, None, None, None, None)
        if expired := state.hasTimedOut:
            state.remove()
        else:
            rows = pd.concat(batches).sort_values(["us", "event_id"])
            ends = np.flatnonzero((rows["event_type"] == breaks).to_numpy())
            # runs between breaks; the first goes on from the batch before
            runs = np.diff(np.concatenate([[-1], ends, [len(rows)]])) - 1
            runs[0] += run
            run, longest = int(runs[-1]), max(longest, int(runs.max()))
            section, calls, tokens = section + int((rows["event_type"] == opens).sum()), calls + len(rows), tokens + int(rows["tokens"].sum())
            newest = rows.iloc[-1]
            first = int(rows["us"].min()) if first is None else min(first, int(rows["us"].min()))
            if last is None or (int(newest["us"]), int(newest["event_id"])) > (last, event):
                last, event, kind = int(newest["us"]), int(newest["event_id"]), newest["event_type"]
            state.update((section, run, longest, calls, tokens, first, last, event, kind))
            state.setTimeoutTimestamp(max(last // 1000 + wait, state.getCurrentWatermarkMs() + 1))
        done = max(section - 1, 0)
        status = "expired" if expired else "complete" if done >= planned else "running"
        row = (key[0], section, done, min(done / planned, 1.0), run, longest, calls, tokens, event, kind, last - first, status)
        yield pd.DataFrame([row], columns=[c.split()[0] for c in out.split(", ")])

    rows = log.withWatermark("ts", late).select("user_id", "event_id", "ts", F.unix_micros("ts").alias("us"), "event_type", F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)).alias("tokens"))
    out = "user_id long, section long, completed long, completion double, run long, longest long, calls long, tokens long, last_event long, last_kind string, elapsed_us long, status string"
    return rows.groupBy("user_id").applyInPandasWithState(step, out, kept, "update", GroupStateTimeout.EventTimeTimeout)


def deduplicated(log: DataFrame, keys: list[str], late: str = "40 days") -> DataFrame:
    """The first row of each key within the watermark; rows later than it are left out, and `drain_counted` counts them."""
    return log.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def priced(log: DataFrame, rates: DataFrame) -> DataFrame:
    """Each call joined to a small static table of dated rates (model, since, until or NULL, rate): the rate of a model holds from `since` to before `until`,
    and its periods don't overlap. A call without a rate stays NULL."""
    valid = (log["event_type"] == rates["model"]) & (log["ts"] >= rates["since"]) & (rates["until"].isNull() | (log["ts"] < rates["until"]))
    return log.join(listed(rates), valid, "left").select("event_id", "event_type", r6(F.col("value") * F.col("rate")).alias("cost"))


def drain(stream: DataFrame, mode: str, shared: str, last: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Runs a stream over everything that is there (availableNow) into Parquet under the shared folder and reads the result; update and
    complete modes write each batch beside the others, and `last` reduces them (`batch` is its number)."""
    return drain_counted(stream, mode, shared, last)[0]


def drain_counted(stream: DataFrame, mode: str, shared: str, last: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, int]:
    """As `drain`, with the number of rows that stateful operators left out as late (Spark holds a batch's rows
    against the watermark that the batch before it started from). Each batch adds the finished ones to the
    count, so that it covers all of them whatever number Spark remembers."""
    spark, out = stream.sparkSession, f"{shared}/stream-{uuid.uuid4().hex[:12]}"
    late: dict[int, int] = {}
    running = []

    def note() -> None:
        for p in running[0].recentProgress if running else []:
            late[p.batchId] = sum(o.numRowsDroppedByWatermark for o in p.stateOperators)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/rows/batch_no={number}")
        note()

    running.append(stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(write).start())
    running[0].awaitTermination()
    note()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    got = spark.read.schema(schema).parquet(f"{out}/rows")
    return (last(got) if last else got).drop("batch", "batch_no"), sum(late.values())
