"""Progress of sessions by a stream of several batches, against plain Python over all events."""

import random
from itertools import groupby

from pyspark.sql import functions as F

from tessera.streaming import usage

DAY = 86_400_000


def feed(spark, path, batches):
    """Event files, one a batch: rows (event_id, ms, user_id, event_type, tokens)."""
    for i, rows in enumerate(batches):
        d = spark.createDataFrame(rows, "event_id long, ms long, user_id long, event_type string, k long").select("event_id", F.timestamp_millis("ms").alias("ts"), "user_id", "event_type", F.to_json(F.struct("k")).alias("props"))
        d.coalesce(1).write.parquet(f"{path}/in/{i}")
    return usage.read_log(spark, f"{path}/in/*/*.parquet", 1)


def plain(events, planned):
    run = longest = section = 0
    for e in events:
        run = 0 if e[3] == "error" else run + 1
        longest, section = max(longest, run), section + (e[3] == "signup")
    done = max(section - 1, 0)
    return section, done, min(done / planned, 1.0), run, longest, len(events), sum(e[4] or 0 for e in events), events[-1][0], events[-1][3], (events[-1][1] - events[0][1]) * 1000, "complete" if done >= planned else "running"


def test_progress_is_that_of_all_events(spark, tmp_path):
    r = random.Random(3)
    events = sorted(((i, r.randrange(6) * DAY + r.randrange(DAY), r.randrange(5), r.choice(["view", "click", "signup", "error"]), r.choice([None, 1, 7])) for i in range(160)), key=lambda e: (e[1], e[0]))
    batches = [[e for e in events if e[1] // DAY // 2 == k] for k in range(3)]
    got = usage.drain(usage.session_progress(feed(spark, tmp_path, batches), planned=4), "update", str(tmp_path / "out"), lambda d: d.groupBy("user_id").agg(F.max_by(F.struct("*"), "batch").alias("r")).select("r.*"))
    users = {u: list(es) for u, es in groupby(sorted(events, key=lambda e: (e[2], e[1], e[0])), key=lambda e: e[2])}
    assert {x[0]: tuple(x[1:]) for x in got.collect()} == {u: plain(es, 4) for u, es in users.items()}


def test_an_idle_session_expires_and_starts_anew(spark, tmp_path):
    batches = [[(1, DAY, 1, "signup", 2), (2, 100 * DAY, 2, "view", 1)], [(3, 101 * DAY, 2, "view", 1)], [(4, 102 * DAY, 1, "view", 5)]]
    rows = usage.drain(usage.session_progress(feed(spark, tmp_path, batches)), "update", str(tmp_path / "out")).where("user_id = 1").collect()
    assert sorted((x.status, x.section, x.calls, x.tokens, x.last_event) for x in rows) == [("expired", 1, 1, 2, 1), ("running", 0, 1, 5, 4), ("running", 1, 1, 2, 1)]
