"""Order statistics, matching, accumulation and excerpts of groups of any size, against plain Python."""

import itertools
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import markers, order, pairs, segments, stats, structure, thematic


def merge_count(v):
    """Inversions of a list by merging."""
    if len(v) < 2:
        return v, 0
    a, x = merge_count(v[: len(v) // 2])
    b, y = merge_count(v[len(v) // 2 :])
    out, n, i, j = [], x + y, 0, 0
    while i < len(a) or j < len(b):
        if j == len(b) or i < len(a) and a[i] <= b[j]:
            out.append(a[i])
            i += 1
        else:
            out.append(b[j])
            n += len(a) - i
            j += 1
    return out, n


def plain_tau(rows):
    ties = lambda v: sum(k * (k - 1) // 2 for k in np.unique(np.array(v), axis=0, return_counts=True)[1].tolist())
    n0, n1, n2, n3 = len(rows) * (len(rows) - 1) // 2, ties([r[0] for r in rows]), ties([r[1] for r in rows]), ties(rows)
    if len(rows) < 3 or n0 in (n1, n2):
        return None
    q = merge_count([y for _, y in sorted(rows)])[1]
    return (n0 - n1 - n2 + n3 - 2 * q) / math.sqrt((n0 - n1) * (n0 - n2))


@pytest.mark.parametrize("n", [1, 2, 40])
def test_inversions(n):
    rng = random.Random(n)
    for _ in range(50):
        rows = [(rng.randrange(6), rng.randrange(6), rng.randrange(1, 4)) for _ in range(n)]
        want = sum(a[2] * b[2] for a in rows for b in rows if a[0] < b[0] and a[1] > b[1])
        assert order.inversions(*(np.array(v) for v in zip(*rows, strict=True))) == want


def test_tau_of_groups_of_any_size(spark, monkeypatch):
    rng = random.Random(1)
    groups = {
        "mixed": [(float(rng.randrange(300)), float(rng.randrange(300))) for _ in range(4000)], "hot": [(1.0 if rng.random() < 0.4 else rng.random(), float(rng.randrange(5))) for _ in range(3000)],
        "falling": [(float(k), float(-k)) for k in range(1500)], "flat": [(1.0, float(k)) for k in range(50)], "two": [(1.0, 2.0), (2.0, 3.0)], None: [(rng.random(), rng.random()) for _ in range(100)],
    }
    rows = [(g, x, y) for g, v in groups.items() for x, y in v] + [("two", None, 1.0), ("none", 1.0, None)]
    monkeypatch.setattr(order, "LEAST", 64)
    monkeypatch.setattr(order, "STEP", 1)
    got = {r.g: r for r in stats.kendall(spark.createDataFrame(rows, "g string, x double, y double"), ["g"]).collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        want = plain_tau(v)
        assert got[g].n == len(v) and (got[g].tau_b is None if want is None else got[g].tau_b == pytest.approx(want, abs=1e-6))
    assert got["two"].undefined_reason == "too_few" and got["flat"].undefined_reason == "no_variance"


def test_tau_of_one_group_of_200_000_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 20_000, 200_000)
    y = x + rng.integers(0, 20_000, 200_000)
    df = spark.createDataFrame(__import__("pandas").DataFrame({"x": x.astype(float), "y": y.astype(float)}))
    got = order.tau_b(df, [])
    assert got.first().tau_b == pytest.approx(plain_tau(list(zip(x.tolist(), y.tolist(), strict=True))), abs=1e-6)


def test_quantiles_are_those_of_percentile(spark):
    rng = random.Random(2)
    rows = [(g, rng.choice([None, 1.0, 2.0, 2.0, rng.random() * 5])) for g in ("a", "b", None) for _ in range(rng.randint(40, 61))] + [("one", 3.0), ("null", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = {"q0": 0.0, "q1": 0.25, "q2": 0.5, "q9": 0.9, "q10": 1.0}
    want = {r.g: r for r in df.groupBy("g").agg(F.count("v").alias("n"), *(F.percentile("v", F.lit(q)).alias(k) for k, q in shares.items())).collect() if r.n}
    got = {r.g: r for r in order.quantiles(df, ["g"], "v", shares).collect()}
    assert set(got) == set(want) == {"a", "b", None, "one"}
    for g, r in want.items():
        assert got[g].n == r.n and all(got[g][k] == pytest.approx(r[k]) for k in shares)
    whole = order.quantiles(df, [], "v", {"m": 0.5}).first()
    assert whole.m == pytest.approx(statistics.median(v for _, v in rows if v is not None))


def test_places_outside_are_null(spark):
    got = order.at_places(spark.createDataFrame([(1, 5)], "g int, v int"), ["g"], "v", {"before": lambda n: n - 2, "at": lambda n: n - 1, "after": lambda n: n}).first()
    assert (got.before, got.at, got.after) == (None, 5, None)


def test_turn_lengths_of_many_partitions(spark):
    rng = random.Random(5)
    words = [rng.randint(1, 60) for _ in range(501)]
    turns = spark.createDataFrame([("s", k, "P", "participant", "x", w) for k, w in enumerate(words)] + [("t", 0, "P", "participant", "x", 4)], "session_id string, turn_index int, speaker_id string, role string, text string, n_words int")
    got = {r.session_id: r for r in structure.turn_lengths(turns).collect()}
    q = statistics.quantiles(words, n=4)
    assert got["s"].median_words == statistics.median(words) and got["s"].iqr == pytest.approx(q[2] - q[0]) and (got["t"].n, got["t"].iqr) == (1, None)


def greedy(rows):
    out, a, b = set(), set(), set()
    for block, x, y, s in sorted({r for r in rows if None not in r}, key=lambda r: (r[0], -r[3], r[1], r[2])):
        if (block, x) not in a and (block, y) not in b:
            out.add((block, x, y, s))
            a.add((block, x))
            b.add((block, y))
    return out


def test_matching_in_rounds_is_greedy_matching(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(3), rng.randrange(40), rng.randrange(40), rng.choice([0.1, 0.5, 0.9, rng.random()])) for _ in range(2000)]
    rows += rows[:20] + [(None, 1, 1, 0.5), (1, None, 1, 0.5), (1, 1, 1, None)] + [(9, k, k + j, 1 - (2 * k + j) / 20) for k in range(6) for j in (0, 1)]
    df = spark.createDataFrame(rows, "block long, a long, b long, sim double")
    got = thematic.greedy_matching(df)
    assert "Python" not in got._jdf.queryExecution().toString() and {tuple(r) for r in got.collect()} == greedy(rows) and got.count() == len(greedy(rows))
    assert thematic.greedy_matching(df.where("false")).count() == 0


def test_envelope_is_that_of_all_orders(spark):
    rng = random.Random(6)
    codes = [f"c{k:03}" for k in range(130)]  # more than one long of bits
    held = {("a", 1): {g: {c for c in codes if rng.random() < 0.1 * g} for g in range(1, 6)}, ("a", 2): {g: {codes[0]} for g in range(1, 4)}, ("b", 1): {1: set(codes)}, ("b", 2): {1: set(), 2: set()}}
    rows = [(c, r, g, code, code in of) for (c, r), groups in held.items() for g, of in groups.items() for code in codes]
    p = spark.createDataFrame(rows, "condition string, replicate int, group_id int, code string, present boolean")
    got = {}
    for r in thematic.accumulation_envelope(p).collect():
        got.setdefault((r.condition, r.replicate), []).append(r)
    for key, groups in held.items():
        curve = lambda of: [len(set().union(*of[: k + 1])) for k in range(len(of))]
        curves = [curve(list(x)) for x in itertools.permutations(groups.values())]
        mean = [statistics.mean(c[k] for c in curves) for k in range(len(groups))]
        gains = [round(b - a, 4) for a, b in itertools.pairwise(mean)]
        plateau = next((i + 1 for i in range(len(gains)) if all(x < 0.5 for x in gains[i:])), None)
        rows = sorted(got[key], key=lambda r: r.k)
        assert [(r.least, r.most) for r in rows] == [(min(c[k] for c in curves), max(c[k] for c in curves)) for k in range(len(groups))]
        assert [r.mean for r in rows] == pytest.approx(mean, abs=1e-6) and [r.observed for r in rows] == curve([groups[g] for g in sorted(groups)]) and {r.plateau for r in rows} == {plateau}


def test_word_budget_of_a_long_session(spark):
    rng = random.Random(7)
    words = [rng.randint(0, 30) for _ in range(100_000)]
    turns = spark.createDataFrame([("s", k, w) for k, w in enumerate(words)] + [("t", 0, 2000), ("t", 1, 90), ("t", 2, 0), ("t", 3, 5)], "session_id string, turn_index int, n_words int")
    out = segments.word_budget(turns, 100, starts=10**6)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r.session_id, r.start): (r.stop, r.words) for r in out.collect()}
    want, stop, total = {}, -1, 0
    for k, w in enumerate(words):
        while stop + 1 < len(words) and total + words[stop + 1] <= 100:
            stop += 1
            total += words[stop]
        if total >= 90 and stop >= k:
            want["s", k] = (stop, total)
        total -= w
    assert {k: v for k, v in got.items() if k[0] == "s"} == want and {k: v for k, v in got.items() if k[0] == "t"} == {("t", 1): (3, 95)}


def test_group_orderings_and_their_summary(spark):
    reach = {("ref", 0): [3, 2, 1, 0], ("x", 1): [3, 2, 1, 2], ("x", 2): [1, 2, 3, 0], ("y", 1): [2, 2, 2, 1], ("y", 2): [0, 0, 0, 0]}
    rows = [(c, 1, r, f"c{k}", v > 0, v, 4) for (c, r), of in reach.items() for k, v in enumerate(of)]
    p = spark.createDataFrame(rows, "condition string, group_id int, replicate int, code string, present boolean, voiced int, participants int")
    measured = p.select("condition", "group_id", "replicate").distinct().where("not (condition = 'y' and replicate = 2)")
    g = {(r.condition, r.replicate): r for r in stats.group_ordering(p, measured, "ref").collect()}
    assert (g["x", 1].tau_b, g["x", 1].n_union, g["x", 1].recovered, g["x", 2].tau_b) == (1, 4, 3, -1) and g["x", 1].tau_union < 1
    assert (g["y", 1].undefined_reason, g["y", 1].ties_y, g["y", 2].unmeasured, g["y", 2].n) == ("no_variance", 3, 3, None)
    s = stats.ordering_summary(stats.group_ordering(p, measured, "ref"), "x", "y").first()
    assert (s.defined_a, s.median_a, s.least_a, s.most_a, s.defined_b, s.difference, s.direction) == (2, 0, -1, 1, 0, None, "undefined")
    d = {(r.condition, r.replicate): r for r in stats.study_ordering(p, measured, "ref").collect()}
    assert (d["x", 1].tau_reach, d["x", 1].codes, d["y", 2].unmeasured, d["y", 2].codes) == (pytest.approx(0.547723, abs=1e-6), 4, 4, None)


def test_anchors(spark):
    t = spark.createDataFrame([("s", 1, "we flew to New York City, it cost 3.5 kg on Friday in March"), ("s", 2, "abc12 12abc 1a 5kg £4,5 7 apples 1.2.3 2 days ago Every week. Then Bob met Anna in Été Köln"), ("s", 3, "One year or week or day. Yes And This")], "session_id string, turn_index int, text string")
    got = {r.turn_index: (r.numbers, r.times, r.names, r.anchors) for r in markers.anchors(t, spark.createDataFrame([("s", "Bob Smith")], "session_id string, name string")).collect()}
    assert got == {1: (1, 2, 5, 8), 2: (8, 2, 1, 11), 3: (0, 0, 0, 0)}


GRAPH = "session_id string, turn_index int, speaker_id string, role string, text string"


def graph(spark, said, names):
    t = spark.createDataFrame([("s", k, who, "moderator" if who == "M" else "participant", text) for k, (who, text) in enumerate(said)], GRAPH)
    return pairs.interaction_graph(t, spark.createDataFrame([("s", *n) for n in names], "session_id string, speaker_id string, name string")).first()


def test_interaction_graph(spark):
    g = graph(spark, [("P1", "Hi"), ("M", "Daniel, what do you think?")], [("P1", "Daniel Whitmore")])
    assert (g.first_name_mentions, g.from_moderator, g.status, g.density) == (1, 1, "insufficient_sample", 0)
    g = graph(spark, [("P1", "Hi"), ("P2", "I agree with Maya Chen."), ("M", "p2? What of artists"), ("P2", "yes")], [("P1", "Maya Chen"), ("P2", "Art Lee")])
    assert (g.full_name_mentions, g.first_name_mentions, g.id_mentions, g.between, g.pairs, g.density, g.to_moderator) == (1, 0, 1, 2, 1, 0.5, 1)
    g = graph(spark, [("P1", "Hi"), ("P2", "Hi"), ("P1", "Alice agrees with Bob"), ("P2", "Alice again")], [("P1", "Alice"), ("P2", "Bob")])
    assert (g.density, g.between, g.edges) == (1, 5, 5)
    g = graph(spark, [("M", "Alice")] * 6, [("P1", "Alice"), ("P2", "Bob")])
    assert g.hub and g.density_from_moderator == 0.5


def test_label_density(spark):
    t = spark.createDataFrame([("s", 0, "A", "participant", "as MF_P2 said."), ("s", 1, "B", "participant", "Anna's point"), ("s", 2, "B", "participant", "I am mf_p2."), ("s", 3, "B", "participant", "nothing")], GRAPH)
    m = spark.createDataFrame([("s", "A", "Anna Lee"), ("s", "B", "MF_P2"), ("s", "C", "Will Fox"), ("s", "D", "Al")], "session_id string, speaker_id string, name string")
    r = markers.label_density(t, m, ["will"]).first()
    assert (r.turns, r.density, r.label_density, r.excluded, r.unrepresentable, r.collapsed, r.valid) == (4, 0.25, 0.5, 1, 1, False, False)


def test_missing_units(spark):
    v = spark.createDataFrame([("m", "u1", 1.0), ("m", "u2", None), ("k", "u1", 2.0)], "metric string, unit string, value double")
    e = spark.createDataFrame([(m, u) for m in "mk" for u in ("u1", "u2", "u3")], "metric string, unit string")
    assert {r.metric: (r.n_missing, r.missing) for r in stats.missing_units(v, ["metric"], "unit", e).collect()} == {"m": (2, ["u2", "u3"]), "k": (2, ["u2", "u3"])}
