"""Queries whose cost grew faster than their input: results of the mended steps, and what they write or hold."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import lexical as lx
from tessera.operators import pivots as pv
from tessera.operators import stylometry as sty
from tessera.operators import thematic as th


def greedy(rows):
    taken, a_s, b_s = [], set(), set()
    for block, a, b, sim in sorted(set(rows), key=lambda r: (r[0], -r[3], r[1], r[2])):
        if (block, a) not in a_s and (block, b) not in b_s:
            taken.append((block, a, b, sim))
            a_s.add((block, a))
            b_s.add((block, b))
    return sorted(taken)


@pytest.mark.parametrize("small", [1024, 100, 0])
def test_matching_by_row_and_by_rounds(spark, monkeypatch, small):
    monkeypatch.setattr(th, "PAIRS_A_PART", 50)
    rng = random.Random(3)
    rows = [(k, rng.randrange(12), rng.randrange(12), rng.randrange(5) / 4) for k in (1, 2, 3) for _ in range(60 * k)]
    got = th.greedy_matching(spark.createDataFrame(rows, "block long, a long, b long, sim double"), small)
    assert got.columns == ["block", "a", "b", "sim"]
    assert sorted(tuple(r) for r in got.collect()) == greedy(rows)


def test_matching_of_a_chain_takes_no_rounds(spark, monkeypatch):
    made, written = [], th.written
    monkeypatch.setattr(th, "written", lambda df, name: made.append(name) or written(df, name))
    rows = [(1, i // 2 + i % 2, i // 2, 1 - i / 100) for i in range(40)]
    assert sorted(tuple(r) for r in th.greedy_matching(spark.createDataFrame(rows, "block long, a long, b long, sim double")).collect()) == greedy(rows)
    assert made == ["sizes"]


def test_blocks_are_copied_by_tile(spark, monkeypatch):
    monkeypatch.setattr(pv, "TILE", 3)
    v = np.random.default_rng(2).normal(size=(120, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([("u", i, x.tolist()) for i, x in enumerate(v)], "unit string, turn_index long, v array<double>")
    b = pv.blocks(df.coalesce(1), 4, 10)
    n, tiles = b.count(), b.select("unit", F.floor(F.col("block") / 3)).distinct().count()
    assert n >= 12
    for side in pv._pairs(b, ["v"], ["v"], F.lit(True)):
        assert side._df.count() == n * tiles
    cosines = v @ v.T
    got = {r.turn_index: r.m for r in pv.nearest_earlier(b).collect()}
    assert got == pytest.approx({i: cosines[i, :i].max() for i in range(1, 120)}, abs=1e-12)
    assert pv.farthest(b).first().least == pytest.approx(cosines.min(), abs=1e-12)


def recorded(monkeypatch, module):
    made, written = [], module.written
    monkeypatch.setattr(module, "written", lambda df, name: made.append(name) or written(df, name))
    return made


def test_pairs_of_turns_are_screened_once(spark, monkeypatch):
    made = recorded(monkeypatch, sty)
    rows = [(1, "u", q, q, "alpha beta gamma alpha" if q < 2 else "delta never", 4) for q in range(3)]
    got = sty.pair_screen(spark.createDataFrame(rows, "doc long, participant string, question int, ord long, text string, n_words int"), 2, 3)
    assert made == ["screened", "weights", "screened-pairs"]
    assert sorted((r.ord, r.ob, r.shared, r.cosine, r.contrast, r.stratum) for r in got.collect()) == [(0, 1, 3, 1.0, False, "high_without_contrast"), (0, 2, 0, 0.0, True, "control"), (1, 2, 0, 0.0, True, "control")]


def test_collapse_in_closed_form(spark, monkeypatch):
    made = recorded(monkeypatch, lx)
    v = np.random.default_rng(4).random((9, 5))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    who = [0, 0, 0, 0, 1, 1, 2, 2, 2]
    rows = [("s", f"p{who[d]}", d, f"t{k}", float(v[d, k])) for d in range(9) for k in range(5)] + [("alone", "p", 1, "t", 1.0), ("s", None, 10, "t0", 1.0)]
    got = lx.speaker_collapse(spark.createDataFrame(rows, "s string, p string, d long, term string, weight double"), "s", "p", "d").collect()
    c = np.array([v[np.array(who) == k].mean(0) for k in range(3)])
    cos = (c @ c.T) / np.outer(np.linalg.norm(c, axis=1), np.linalg.norm(c, axis=1))
    within = np.mean([1 - v[d] @ c[who[d]] / np.linalg.norm(c[who[d]]) for d in range(9)])
    assert [tuple(r) for r in got] == [("s", pytest.approx(within, abs=2e-6), pytest.approx(1 - np.mean([cos[0, 1], cos[0, 2], cos[1, 2]]), abs=2e-6))]
    assert made == ["weights", "centroids"]


def test_vocabularies_are_formed_once(spark, monkeypatch):
    made = recorded(monkeypatch, lx)
    rows = [("s", "a", "x y x"), ("s", "b", "Y z"), ("s", "b", "z"), ("s", "c", "q"), ("s", None, "x"), ("t", "a", "x"), (None, "a", "x"), (None, "b", "x"), ("s", "d", None)]
    turns = spark.createDataFrame(rows, "session_id string, speaker_id string, text string")
    got = lx.vocabulary_overlap(lx.term_rows(turns, ["session_id", "speaker_id"])).collect()
    assert [tuple(r) for r in got] == [("s", 3, pytest.approx(1 / 9, abs=1e-6))]
    assert made == ["vocabularies"]


def windowed(turns, budget, windows):
    """Budgeted overlap in plain Python: {session: (speakers, windows, jaccard, js, cosine)}."""
    units, out = {}, {}
    for session, speaker, turn, text in turns:
        units.setdefault((session, speaker), []).extend((turn is not None, turn or 0, p, w) for p, w in enumerate(re.findall("[a-z]+", (text or "").lower())))
    units = {k: [w for *_, w in sorted(v)] for k, v in units.items() if v}
    for session in {s for s, _ in units}:
        mine = [v for k, v in units.items() if k[0] == session]
        least = min(map(len, mine))
        if least < budget or len(mine) < 2:
            out[session] = (len(mine), None, None, None, None)
            continue
        n, got = min(windows, least - budget + 1), []
        at = lambda v: [(len(v) - budget) // 2] if n == 1 else [round(i * (len(v) - budget) / (n - 1)) for i in range(n)]  # noqa: E731, B023
        named = [v for k, v in units.items() if k[0] == session and None not in k]
        for a, b in itertools.combinations(named, 2):
            for x, y in zip(at(a), at(b), strict=True):
                x, y = Counter(a[x : x + budget]), Counter(b[y : y + budget])
                kl = sum(u[t] / budget * math.log2(2 * u[t] / (x[t] + y[t])) for u in (x, y) for t in u)
                got.append((len(x & y) / len(x | y), math.sqrt(max(kl / 2, 0)), sum(x[t] * y[t] for t in x) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))))
        out[session] = (len(mine), n, *([sum(c) / len(got) for c in zip(*got, strict=True)] if got else [None] * 3))
    return out


@pytest.mark.parametrize(("budget", "windows"), [(1, 10), (2, 10), (7, 10), (7, 1), (20, 3)])
def test_windows_of_a_budget_against_plain_python(spark, budget, windows):
    rng = random.Random(budget)
    words = lambda n: " ".join(rng.choice(["The", "a", "cat", "sat", "Mat", "7", "on"]) for _ in range(n))
    rows = [(f"s{k}", p, i, words(rng.randrange(9))) for k in range(12) for p in ("a", "b", "c")[: k % 4] for i in range(rng.randrange(1, 9))]
    rows += [("long", p, i, words(60)) for p in ("a", "b") for i in range(5)]
    rows += [("nulls", p, i, words(40)) for p in ("a", "b", None) for i in (0, None)] + [(None, p, 1, words(40)) for p in ("a", "b")] + [("blank", "a", 1, None), ("blank", "b", 1, " ")]
    got = {r.session_id: tuple(r)[1:] for r in lx.budgeted_overlap(spark.createDataFrame(rows, "session_id string, speaker_id string, turn_index long, text string"), budget, windows).collect()}
    want = windowed(rows, budget, windows)
    want |= {s: (*want[s][:2], None, None, None) for s in (None,) if s in want}
    assert set(got) == set(want)
    for s in want:
        assert got[s] == pytest.approx(want[s], abs=2e-6), s


def test_tokens_of_windows_stay_in_rows_of_speakers(spark, monkeypatch):
    made, written = {}, lx.written
    monkeypatch.setattr(lx, "written", lambda df, name: made.setdefault(name, written(df, name)))
    # two turns of the same place take turns: x x y y z z, so the middle is y y
    rows = [("s", "a", 1, "x y z"), ("s", "a", 1, "x y z"), ("s", "b", 1, "y y"), ("t", "a", 1, "w " * 500), ("t", "a", 2, "x " * 500), ("t", "b", 1, "w w"), ("t", "b", 2, "x")]
    got = lx.budgeted_overlap(spark.createDataFrame(rows, "session_id string, speaker_id string, turn_index long, text string"), 2).collect()
    assert sorted(tuple(r) for r in got) == [("s", 2, 1, 1.0, 0.0, 1.0), ("t", 2, 2, 0.75, pytest.approx(math.sqrt((math.log2(4 / 3) + math.log2(2 / 3) / 2 + 0.5) / 2) / 2, abs=1e-6), pytest.approx((1 + 0.5**0.5) / 2, abs=1e-6))]
    assert made["tokens"].count() == len(rows)
    assert sorted((r.session_id, r.speaker_id, r._words, r._from) for r in made["covered"].collect()) == [("s", "a", "y y", [0]), ("s", "b", "y y", [0]), ("t", "a", "w w x x", [0, 2]), ("t", "b", "w w x", [0, 1])]


def test_tokens_are_sorted_once(spark):
    rows = [("u", 2, "b a"), ("u", 1, "x y z"), ("u", 1, "x Y z"), ("u", 3, None), ("u", 4, "7"), (None, None, "a a")]
    t = lx.token_rows(spark.createDataFrame(rows, "u string, turn_index long, text string"), ["u"])
    assert sorted((r.u or "", r.pos, r.term) for r in t.collect()) == [("", 1, "a"), ("", 2, "a"), *(("u", i + 1, w) for i, w in enumerate("xxyyzzba"))]
    d = lx.diversity(t, ["u"], 2)
    assert sorted((r.u or "", r.tokens, r.types, r.mattr_2) for r in d.collect()) == [("", 2, 1, 0.5), ("u", 8, 5, pytest.approx(11 / 14, abs=1e-6))]
    plan = d._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.split("posexplode")[0].count("Sort [") == 1
