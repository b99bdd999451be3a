"""Values of reports, p-values, files with bad lines and small grids."""

import json
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.functions.text import with_each
from tessera.operators import pairs, quality, segments, stats, thematic
from tessera.plans import registry, stats as _plans  # noqa: F401  it registers queries
from tessera.sources import transcripts


def test_tails_of_the_normal_law(spark):
    zs = [0.0, 1e-9, 0.5, 1.0, 1.959964, 2.575829, 3.290527, 5.0, 8.0, 8.6, 40.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select("z", stats._two_sided(F.col("z")).alias("p")).collect()
    assert [r.p for r in got] == pytest.approx([math.erfc(z / math.sqrt(2)) for z in zs], abs=1e-13)


def test_classification_reports(spark):
    rows = [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("b", "c")] * 2 + [("d", "a"), (None, "a"), ("a", None)]
    df = spark.createDataFrame(rows, "gold string, predicted string")
    got = {r.label: (r.tp, r.fp, r.fn, r.f1) for r in stats.classification(df).collect()}
    assert got == {"a": (3, 1, 1, 0.75), "b": (2, 1, 2, pytest.approx(4 / 7, abs=1e-6)), "c": (0, 2, 0, None), "d": (0, 0, 1, None)}
    s = stats.classification_summary(df).first()
    assert (s.n, s.labels, s.accuracy) == (9, 3, pytest.approx(5 / 9, abs=1e-6))
    assert s.macro_f1 == pytest.approx((0.75 + 4 / 7 + 0) / 3, abs=1e-6) and s.balanced_accuracy == pytest.approx((0.75 + 0.5 + 0) / 3, abs=1e-6)
    assert {(r.gold, r.predicted): r.n for r in stats.confusion(df).collect()} == {("a", "a"): 3, ("a", "b"): 1, ("b", "b"): 2, ("b", "c"): 2, ("d", "a"): 1}


def test_validation_status(spark):
    rows = [(c, a, b) for c, k in (("p", 2), ("q", 1), ("r", 2), ("s", 0)) for a, b in [(1, 1)] * k + [(0, 0)] * 5]
    g = stats.validation_status(stats.agreement(spark.createDataFrame(rows, "code string, a int, b int"), ["code"]), F.col("code").isin("p", "q"))
    assert {r.code: (r.positives_a, r.status) for r in g.collect()} == {"p": (2, "validated"), "q": (1, "not_fully_validated"), "r": (2, "opportunistic_detection"), "s": (0, "specificity_only")}


def test_stability_leaves_planted_items_out(spark):
    rows = [(i, f, p, "N", r, c) for i, f, p, cs in ((1, "x", False, "NN"), (2, "x", False, "NA"), (3, "y", False, "AA"), (4, "y", True, "NN"), (5, "x", True, "NA"), (6, "y", False, "A")) for r, c in enumerate(cs, 1)]
    got = {r.family: r for r in stats.stability_rates(spark.createDataFrame(rows, "item int, family string, planted boolean, expected string, repetition int, category string")).collect()}
    assert {k: (r.items, r.agree, r.planted, r.planted_right) for k, r in got.items()} == {None: (3, 2, 2, 1), "x": (2, 1, 1, 0), "y": (1, 1, 1, 1)}


def test_content_hash_of_sessions(spark):
    turns = lambda rows: spark.createDataFrame(rows, "session_id string, turn_index int, role string, speaker_id string, text string")
    a, b = ("s", 0, "moderator", "M", "abc"), ("s", 1, "participant", "P", None)
    of = lambda rows: quality.readiness(turns(rows), 1).first().content_hash
    assert of([a, b]) == of([b, a]) and len({of([a, b]), of([a, (*b[:4], "")])}) == 1
    assert len({of([a, b]), of([("s", 0, "moderator", "M", "cba"), b]), of([("s", 1, "moderator", "M", "abc"), ("s", 0, "participant", "P", None)]), of([a]), of([a, a, b])}) == 5


def test_bad_lines_of_files(spark, tmp_path):
    for session, name, text in (("1", "calls", '{"a": 1}\n\n{"a": \n[1]\nx y\n'), ("1", "log", '{"k": "v"}\n' * 3), ("2", "calls", "\n \n"), ("2", "log", "{broken")):
        (tmp_path / session).mkdir(exist_ok=True)
        (tmp_path / session / name).write_text(text)
    (tmp_path / "3").mkdir()
    (tmp_path / "3" / "big").write_text("".join(json.dumps({"n": k, "pad": "x" * (k % 90)}) + "\n" if k % 4001 else "{cut\n" for k in range(1, 20_001)))
    with_split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")  # many splits of one file
        j = transcripts.json_lines(spark, f"file://{tmp_path}/*/*")
        j = j.withColumns({"session_id": F.element_at(F.split("file", "/"), -2), "artefact": F.element_at(F.split("file", "/"), -1)})
        bad = {(r.session_id, r.artefact, r.line): r.error for r in j.where("error is not null").collect()}
        expected = spark.createDataFrame([("calls", True), ("log", True), ("big", False)], "artefact string, required boolean")
        sessions = spark.createDataFrame([(k,) for k in "123"], "session_id string")
        got = {(r.session_id, r.artefact): (r.state, r.records, r.bad_lines) for r in transcripts.file_artefacts(j, sessions, expected).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", with_split)
    cut = [4001, 8002, 12003, 16004]
    assert set(bad) == {("1", "calls", 3), ("1", "calls", 5), ("2", "log", 1), *(("3", "big", k) for k in cut)} and bad["1", "calls", 3] == "Malformed JSON in calls line 3"
    assert got["1", "calls"] == ("malformed", 2, [3, 5]) and got["1", "log"] == ("loaded", 3, []) and got["1", "big"][0] == "missing_optional"
    assert got["2", "calls"][0] == "missing_required" and got["3", "big"] == ("malformed", 19_996, cut)


def test_grids_of_small_dimensions(spark):
    df = spark.createDataFrame([(1,), (2,)], "g int")
    codes = spark.createDataFrame([("b",), ("a",), ("a",), (None,)], "code string")
    assert sorted(map(tuple, with_each(df, codes, "code").collect())) == [(1, "a"), (1, "b"), (2, "a"), (2, "b")]
    seen = spark.createDataFrame([("x", 1, "r1"), ("x", 1, "r1"), ("y", 3, "r2"), ("x", 2, "r1"), ("x", 2, "r2")], "a string, b int, run string")
    got = {(r.a, r.b): r.state for r in pairs.grid_integrity(seen, {"a": spark.createDataFrame([("x",), ("y",)], "a string"), "b": spark.createDataFrame([(1,), (2,)], "b int")}).collect()}
    assert got == {("x", 1): "duplicate", ("x", 2): "collision", ("y", 1): "missing", ("y", 2): "missing", ("y", 3): "unexpected"}
    p = spark.createDataFrame([("c", 1, 1, "k", True, 1, 2), ("c", 2, 1, "l", False, 1, 2)], "condition string, group_id int, replicate int, code string, present boolean, voiced int, participants int")
    assert thematic.presence_grid(p).count() == 4


def test_10_000_terms_at_once(spark):
    import random

    from tessera.operators import literals, markers, segments, textual

    rng = random.Random(8)
    say = lambda k: "".join(rng.choice("abcé ") for _ in range(k))
    terms = sorted({say(rng.randint(1, 9)) for _ in range(9000)} | {"aa", "aaa", "a"} | {f"term{k}" for k in range(3000)})[:10_000]
    texts = [say(rng.randint(0, 300)) for _ in range(40)] + ["a" * 50, None, "", "term7term77"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    got = {(r.id, r.term): (r.n, r.first) for r in literals.literal_hits(df, ["id"], "text", terms).collect()}
    assert got == {(i, t): (x.count(t), x.index(t) + 1) for i, x in enumerate(texts) if x for t in terms if t in x}
    out = textual.leakage(df, spark.createDataFrame([(t,) for t in terms], "token string"))
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString() and len(out.collect()) == len(terms)
    assert {r.token: (r.texts, r.hits) for r in out.collect()} == {t: (sum(t in x for x in texts if x), sum(x.count(t) for x in texts if x)) for t in terms}
    with pytest.raises(ValueError, match="10000"):
        literals.terms_of(spark.range(10_001).selectExpr("cast(id as string) token"), "token")
    turns = spark.createDataFrame([("s", 0, "moderator", "But well, no way but"), ("s", 1, "moderator", "why"), ("s", 2, "moderator", None)], "session_id string, turn_index int, role string, text string")
    lexicon = spark.createDataFrame([("but well", "divergence", 2), ("but", "alignment", 1), ("no", "divergence", 3)], "marker string, kind string, ord int")
    plan = markers.clause_markers(turns, lexicon)
    assert "NestedLoop" not in plan._jdf.queryExecution().executedPlan().toString()
    assert {r.turn_index: (r.clauses, r.d1_div, r.d1_align, r.label) for r in plan.collect()}[0] == (2, 1, 1, "mixed")
    q = segments.openers(turns, spark.createDataFrame([(1, "well"), (2, "way"), (2, "no")], "question int, term string"))
    assert [(r.turn_index, r.question, r.kind) for r in q.collect()] == [(0, 2, "out_of_turn")]


def test_scenarios_leave_the_base_as_it_is(spark):
    reach = {("ref", 0): [3, 2, 1, 1], ("x", 1): [3, 2, 1, 0], ("x", 2): [1, 1, 1, 1]}
    rows = [(c, 1, r, f"c{k}", v > 0, v, 4) for (c, r), of in reach.items() for k, v in enumerate(of)]
    p = spark.createDataFrame(rows, "condition string, group_id int, replicate int, code string, present boolean, voiced int, participants int")
    over = spark.createDataFrame([("S", "x", 1, 2, "c0", False), ("S", "x", 1, 1, "c0", True), ("T", "ref", 1, 0, "c1", False), ("T", "ref", 1, 0, "c2", False)], "scenario string, condition string, group_id int, replicate int, code string, present boolean")
    under = thematic.scenarios(p, over)
    assert under.count() == 3 * len(rows) and sorted(map(tuple, under.where("scenario = 'BASE'").select(*p.columns).collect())) == sorted(rows)
    got = {(r.scenario, r.condition): (r.overridden, r.present, r.codes, r.mean_groups) for r in thematic.scenario_recurrence(under).collect()}
    assert got["BASE", "x"] == (0, 7, 4, 0.875) and got["S", "x"] == (1, 6, 4, 0.75) and got["T", "ref"] == (2, 2, 2, 0.5)
    t = {(r.scenario, r.replicate): (r.transition, r.moved) for r in stats.transitions(stats.scenario_orderings(under, "ref"), thematic.BASE).collect()}
    assert t["S", 1] == ("stays_defined", 0) and t["S", 2][0] == "becomes_defined" and t["T", 1][0] == "becomes_undefined" and t["T", 2][0] == "stays_undefined"


def test_logs_in_capitals_open_sections(spark):
    """Capitals of a sharp s are SS, which have no way back."""
    turns = spark.createDataFrame([("s", 0, "moderator", "Straße  frei"), ("s", 1, "participant", "ja"), ("s", 2, "moderator", "Gruß")], "session_id string, turn_index long, role string, text string")
    log = spark.createDataFrame([("s", 1, 0, "STRASSE FREI"), ("s", 2, 2, " gruß ")], "session_id string, ord int, turn_index long, utterance string")
    got = {r.turn_index: (r.section_no, r.missing, r.monotonic) for r in segments.by_log(turns, log, 4).collect()}
    assert got == {0: (1, 0, True), 1: (1, 0, True), 2: (2, 0, True)}


def test_equal_means_tie(spark, tmp_path):
    """Ten times 0.1 against once 0.1: in doubles the means differ by the last bit, by the order of the rows."""
    orders = [(1, "1-URGENT", 0.1)] * 10 + [(1, "5-LOW", 0.1), (2, "1-URGENT", 3.0), (2, "5-LOW", 1.0)]
    spark.createDataFrame(orders, "o_custkey long, o_orderpriority string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 7), (2, 8)], "c_custkey long, c_nationkey long").write.parquet(f"{tmp_path}/customer.parquet")
    cols = ["left_out", "n", "mean", "median", "up", "down", "ties"]
    got = sorted((tuple(r) for r in registry.QUERIES["sta06_effect_summary"](spark, str(tmp_path)).select(*cols).collect()), key=str)
    con = duckdb.connect()
    for t in ("orders", "customer"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(con.sql("select " + ", ".join(cols) + f" from ({registry.ORACLES['sta06_effect_summary']})").fetchall(), key=str)
    assert got == want == [(7, 1, 2.0, 2.0, 1, 0, 0), (8, 1, 0.0, 0.0, 0, 0, 1), (None, 2, 1.0, 1.0, 1, 0, 1)]
