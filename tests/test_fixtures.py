"""Hand-computed values, undefined cases and invariants."""

import collections
import itertools
import statistics

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  it registers the queries
from tessera.functions.text import any_of, f1, hits, listed, ratio
from tessera.operators import lexical, pairs, quality, sampling, segments, stats, structure, textual, thematic
from tessera.plans import registry
from tessera.sources import transcripts
from tessera.streaming import usage

TURNS = "session_id string, turn_index int, speaker_id string, role string, text string, n_words int"


@pytest.fixture
def turns(spark):
    rows = [("s", 0, "M", "moderator", "a b c", 3), ("s", 1, "P1", "participant", "d e", 2), ("s", 2, "P2", "participant", "f g", 2), ("z", 0, "M", "moderator", "only", 1), ("y", 0, "P1", "participant", "", 0)]
    return spark.createDataFrame(rows, TURNS)


def by(df, key="session_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_shares_and_chains(turns):
    m = by(structure.moderator_shares(turns))
    assert m["s"]["turn_share"] == pytest.approx(1 / 3, abs=1e-6) and m["s"]["word_share"] == pytest.approx(3 / 7, abs=1e-6)
    assert m["y"]["word_share"] is None  # nothing said: undefined, not 0
    assert by(structure.adjacency(turns))["s"]["adjacency"] == 0.5 and by(structure.adjacency(turns))["z"]["adjacency"] is None
    c = by(structure.chain_depth(turns))
    assert (c["s"]["mean_depth"], c["s"]["max_depth"]) == (2, 2) and "z" not in c
    assert by(structure.gini(structure.speaker_totals(turns), ["session_id"], "words"))["y"]["gini"] is None


def test_undefined_ratios(spark):
    r = spark.range(1).select(ratio(F.lit(1), F.lit(0)).alias("a"), f1(F.lit(0.0), F.lit(0.0)).alias("b"), f1(F.lit(None).cast("double"), F.lit(1.0)).alias("c")).first()
    assert (r.a, r.b, r.c) == (None, 0.0, None)


def test_overlap_scores(spark):
    sets = {("ref", 0): ["A1", "A2", "A3", "B1"], ("gen", 1): ["A1", "A2", "B1", "C1"], ("gen", 2): ["A1", "B1"]}
    p = spark.createDataFrame([(c, 1, r, code, True, 1, 2) for (c, r), codes in sets.items() for code in codes], "condition string, group_id int, replicate int, code string, present boolean, voiced int, participants int")
    got = {r.replicate: (r.recall, r.precision) for r in thematic.overlap_scores(p, "ref").collect()}
    assert got == {1: (0.75, 0.75), 2: (0.5, 1.0)}


def test_sign_test_drops_ties(spark):
    d = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 3.0), (1, 0.5), (1, -1.0), (1, 0.0), (2, 0.0)], "g int, d double")
    got = {r.g: (r.n, r.p) for r in stats.sign_test(d, ["g"]).collect()}
    assert got == {1: (5, 0.375), 2: (0, None)}


def test_permutation_test_against_all_shuffles(spark):
    folds = {"f": ("aabbc", "abbda"), "g": ("aabc", "acba"), "h": ("ab", "cc")}
    null = collections.Counter({0: 1})
    for truth, guess in folds.values():
        one = collections.Counter(sum(map(str.__eq__, truth, g)) for g in itertools.permutations(guess))
        null = sum((collections.Counter({a + b: m * n}) for a, m in null.items() for b, n in one.items()), collections.Counter())
    rows = [(f, i, t, g) for f, (truth, guess) in folds.items() for i, (t, g) in enumerate(zip(truth, guess, strict=True))]
    hits, total, n = sum(t == g for _, _, t, g in rows), null.total(), len(rows)
    d = spark.createDataFrame([*rows, ("h", 9, None, "a")], "fold string, trial int, truth string, guess string")
    r = stats.permutation_test(d, 20_000)
    assert r.columns == ["accuracy", "null_mean", "p"] and r.collect() == stats.permutation_test(d.repartition(3), 20_000).collect()
    r = r.first()
    assert r.accuracy == hits / n
    assert r.null_mean == pytest.approx(sum(k * m for k, m in null.items()) / total / n, abs=0.005)
    assert r.p == pytest.approx(sum(m for k, m in null.items() if k >= hits) / total, abs=0.015)
    assert stats.permutation_test(d.where("false"), 20).count() == 0


def test_registered_permutation_test_has_20000_draws(spark):
    r = registry.QUERIES["sta15_permutation_test"](spark, "/root/testdata/sf0.001").first()
    assert r.p < 1 / 201 and r.p * 20_001 == pytest.approx(round(r.p * 20_001))


def test_constant_side_has_no_correlation(spark):
    d = spark.createDataFrame([("a", 1, 1.0, 5.0), ("a", 2, 2.0, 5.0), ("a", 3, 3.0, 5.0), ("b", 1, 1.0, 1.0)], "k string, item int, x double, y double")
    s = {r.k: (r.rho, r.undefined_reason) for r in stats.spearman(d, ["k"]).collect()}
    assert s == {"a": (None, "no_variance"), "b": (None, "too_few")}
    assert {r.k: r.undefined_reason for r in stats.kendall(d, ["k"]).collect()} == {"a": "no_variance", "b": "too_few"}


def test_accumulation_is_monotone_and_ends_at_all_codes(spark):
    rows = [("c", 1, g, code, True) for g, codes in enumerate(["ab", "bc", "bd"]) for code in codes]
    e = thematic.accumulation(spark.createDataFrame(rows, "condition string, replicate int, group_id int, code string, present boolean")).orderBy("k").collect()
    assert [r.expected for r in e] == sorted(r.expected for r in e) and e[-1].expected == 4 and e[0].expected == 2


def test_mattr_of_short_unit_is_undefined(spark):
    t = spark.createDataFrame([("u", 0, "a b a c")], "u string, turn_index int, text string")
    r = lexical.diversity(lexical.token_rows(t, ["u"]), ["u"], 3).first()
    assert (r.tokens, r.types, r.mattr_3) == (4, 3, pytest.approx((2 + 3) / 6, abs=1e-6))
    assert lexical.diversity(lexical.token_rows(t, ["u"]), ["u"], 50).first().mattr_50 is None


def test_empty_tables(spark, turns):
    none = turns.where("false")
    for op in (structure.window_counts, structure.turn_lengths, structure.moderator_shares, structure.adjacency, structure.chain_depth, structure.process):
        assert op(none).count() == 0
    assert transcripts.to_schema(none, "a string, n_words int").columns == ["a", "n_words"]


def test_top_k_keeps_ties(spark):
    d = spark.createDataFrame([("g", 5), ("g", 5), ("g", 4), ("g", 1)], "g string, v int")
    assert sampling.top_k(d, ["g"], "v", 1).count() == 2


def test_neighbouring_names_are_all_scrubbed(spark):
    t = spark.createDataFrame([("s", 0, "Anna Ben spoke; ÁNNA's, annabel"), ("s", 1, None), ("z", 0, "Anna")], "session_id string, turn_index int, text string")
    r = spark.createDataFrame([("s", "Anna Maria"), ("s", "Ben"), ("s", "Jo")], "session_id string, name string")
    got = {(x.session_id, x.turn_index): (x.scrubbed, x.hits) for x in textual.roster_scrub(t, r).collect()}
    assert got["s", 0] == ("[NAME] [NAME] spoke; [NAME]'s, annabel", 3) and got["z", 0] == ("anna", 0) and got["s", 1][0] is None


def test_neighbouring_words_all_count(spark):
    assert spark.sql("select 'no never not knots' t").select(hits("t", any_of(["no", "never", "not"])).alias("n")).first().n == 3


def test_greedy_matching_by_hand(spark):
    rows = [(1, 1, 11, 0.9), (1, 1, 12, 0.8), (1, 2, 11, 0.9), (1, 2, 12, 0.3), (1, 3, 12, 0.1), (2, 1, 11, 0.5), (2, 4, 11, 0.5)]
    got = thematic.greedy_matching(spark.createDataFrame(rows, "block long, a long, b long, sim double"))
    assert sorted(map(tuple, got.collect())) == [(1, 1, 11, 0.9), (1, 2, 12, 0.3), (2, 1, 11, 0.5)]


def test_nfkc_key(spark):
    got = spark.sql("select 'ﬁne  “Ｑuote”.' t union all select null").select(textual.match_key("t").alias("k")).collect()
    assert {r.k for r in got} == {'fine "quote', None}


def test_excerpt_grows_by_whole_sentences(spark):
    t = spark.createDataFrame([(1, "One two. Three four five. Six seven. Eight nine ten eleven."), (2, "a b c d e f g."), (3, None)], "k int, text string")
    got = {r.k: (r.excerpt, r.excerpt_words) for r in textual.excerpts(t, 5).collect()}
    assert got[1] == ("Three four five. Six seven.", 5) and got[2] == ("a b c d e f g.", 7) and got[3][0] is None


def test_effects_without_each_unit(spark):
    for values in ([1.0, 5.0, 2.0, 9.0, -3.0], [1.0, 5.0, 2.0, 9.0], [2.0, 2.0, 2.0, 1.0], [4.0, 7.0]):
        d = spark.createDataFrame(list(enumerate(values)), "unit int, d double")
        got = {r.left_out: (r.n, r.mean, r.median, r.up) for r in stats.effect_summary(d).collect()}
        for k in (None, *range(len(values))):
            rest = [v for i, v in enumerate(values) if i != k]
            assert got[k] == (len(rest), pytest.approx(statistics.mean(rest), abs=1e-6), statistics.median(rest), sum(v > 0 for v in rest))


def test_a_large_protected_set_gives_the_same_hits(spark, monkeypatch):
    a = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "x y z a b c d e f g")], "doc_id int, text string")
    b = spark.createDataFrame([(7, "a b c d e f g h i"), (8, "q a b c d e f g h")], "item_id int, text string")
    run = lambda: sorted(map(tuple, pairs.contamination(pairs.shingles(a, "doc_id"), pairs.shingles(b, "item_id"), pairs.shingles(b.where("false"), "item_id")).collect()))
    want = run()
    monkeypatch.setattr(pairs, "PROTECTED", 0)
    assert run() == want == [(1, 2, 2, ["a b c d e f g h", "b c d e f g h i"])]


def test_lists_have_a_bound(spark):
    with pytest.raises(ValueError, match="more than 3"):
        listed(spark.range(5), most=3)


def test_excerpt_against_plain_python(spark):
    texts = ["A b c. D e. F g h i. J. K l m n o p. Q r.", "One. Two three. Four five six. Seven.\nEight nine ten.", "a b c d e f g h", "", "x. y. z."]
    for budget in (1, 4, 7, 50):
        got = {r.text: r for r in textual.excerpts(spark.createDataFrame([(t,) for t in texts], "text string"), budget).collect()}
        for text in texts:
            parts = [p for p in text.replace("\n", " ").replace(". ", ".|").split("|") if p]
            n = [len(p.split()) for p in parts]
            if len(text.split()) <= budget or len(parts) < 2:
                want, around = text, ""
            else:
                lo = hi = len(parts) // 2
                while sum(n[lo : hi + 1]) < budget and (lo or hi < len(parts) - 1):
                    if lo and (hi == len(parts) - 1 or n[lo - 1] <= n[hi + 1]):
                        lo -= 1
                    else:
                        hi += 1
                want, around = " ".join(parts[lo : hi + 1]), " ".join(parts[max(0, lo - 2) : lo] + parts[hi + 1 : hi + 3])
            r = got[text]
            assert (r.excerpt, r.context, r.literal, r.excerpt_words) == (want, around, want in text, len(want.split())), (budget, text)


def test_flattened_paths(spark):
    rows = [('{"a": {"b": {"c": 1}, "l": [1, [2]], "n": null}, "d": "x.y"}',), ("[1]",), ("broken",), (None,), ('{"e": {}}',)]
    got = spark.createDataFrame(rows, "p string").select("p", textual.flattened("p").alias("f")).collect()
    want = [[("a.b.c", "1"), ("a.l", "<list len=2>"), ("a.n", None), ("d", "x.y")], [], [], [], []]
    assert [sorted(map(tuple, r.f or [])) for r in got] == want


def test_ask_offset(spark):
    texts = {1: "Thanks Anna. A wide spread. Let us turn to food. What do you eat?", 2: "What do you eat?", 3: "No question.", 4: "Well. What do you eat? Thanks Anna.", 5: None}
    t = spark.createDataFrame(list(texts.items()), "k int, text string")
    got = {r.k: (r.offset, r.dropped_words, r.review) for r in segments.ask_offset(t, "eat", "turn to", "Anna").collect()}
    assert got == {1: (28, 5, "trimmed"), 2: (0, 0, "clean"), 3: (None, None, "human"), 4: (None, None, "human"), 5: (None, None, "human")}


def test_costs_are_never_guessed(spark):
    rows = [("s", "m", 10**6, 0, 0, 100, 40, None, None), ("s", "m", 0, 10**6, 0, 0, None, None, "5m"), ("t", None, 5, 5, 0, 0, None, None, None), ("u", "x", 5, 5, 0, 0, None, None, None), ("v", "m", 10**6, 0, 0, 10, None, None, "1h")]
    calls = spark.createDataFrame(rows, "s string, model string, input_tokens long, output_tokens long, cache_read long, cache_writes long, five long, hour long, ttl string")
    rates = spark.createDataFrame([("m", "USD", 1.0, 2.0, 0.1, 1e4, 2e4)], "model string, currency string, input double, output double, cache_read double, write_5m double, write_1h double")
    costs = quality.usage_cost(quality.split_cache_writes(calls), rates, ["s"])
    got = {r.s: (r.status, r.cost_low, r.cost_high, r.cost) for r in costs.collect()}
    assert got == {"s": ("ttl_unknown", 4.0, 4.6, None), "t": ("unattributed", None, None, None), "u": ("no_rate", None, None, None), "v": ("priced", 1.2, 1.2, 1.2)}
    p = quality.projected_cost(quality.cost_totals(costs, ["s"]), [], 10).first()
    assert (p.observed, p.excluded, p.projected, p.projected_min) == (1, 3, 12.0, 12.0)


def test_places_in_order(spark):
    d = spark.createDataFrame([(v,) for v in (5.0, 1.0, 1.0, 9.0, None, 3.0, 2.5)], "v double")
    assert stats.nth_values(d, "v", lambda n: [n // 3, 2 * n // 3, n - 1]) == [2.5, 5.0, 9.0]
    assert stats.nth_values(d.where("false"), "v", lambda n: [0]) == [None]


def test_progression(spark):
    d = spark.createDataFrame([("a", 1, 3.0, "down"), ("a", 2, 1.0, "down"), ("b", 1, 1.0, "up"), ("b", 2, None, "up"), ("c", 1, -2.0, "down"), ("c", 3, -1.0, "down"), ("d", 1, 1.0, "up"), ("d", 2, 1.0, "up"), ("e", 1, 1.0, None), ("e", 2, 2.0, None)], "k string, stage int, value double, direction string")
    assert {r.k: r.status for r in stats.progression(d, ["k"]).collect()} == {"a": "improved", "b": "not_enough", "c": "regressed", "d": "stable", "e": "not_comparable"}


def test_late_rows_and_idle_users(spark, tmp_path):
    parts = [[(1, "2024-01-01", 1, "view"), (2, "2024-05-01", 2, "view")], [(4, "2024-05-02", 2, "view"), (5, "2024-05-02", 3, "view")], [(6, "2024-05-03", 1, "view"), (3, "2024-01-02", 4, "view")]]
    for i, rows in enumerate(parts):
        d = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
        d.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    log = lambda: usage.read_log(spark, f"{tmp_path}/in/*/*.parquet", 1)
    kept, late = usage.drain_counted(usage.deduplicated(log(), ["user_id", "event_type"]), "append", str(tmp_path / "out"))
    assert late == 1 and sorted(r.event_id for r in kept.collect()) == [1, 2, 5, 6]
    got = usage.drain(usage.running_chains(log()), "update", str(tmp_path / "out")).where("user_id = 1").collect()
    assert {(r.events, r.expired) for r in got} == {(1, False), (1, True)}
