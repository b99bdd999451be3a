"""Joins between turns, sessions and corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import n_words, r6, ratio, tokens, with_each, words


def by_turn():
    return W.partitionBy("session_id").orderBy("turn_index")


def response_acts(turns: DataFrame) -> DataFrame:
    """Neighbouring turns of a section, both by participants (strict adjacency)."""
    w = W.partitionBy("session_id", "section").orderBy("turn_index")
    prev = {f"prev_{c}": F.lag(c).over(w) for c in ("turn_index", "speaker_id", "n_words", "role")}
    df = turns.withColumns(prev).where("role = 'participant' and prev_role = 'participant'")
    return df.select("session_id", "section", F.col("prev_turn_index").alias("prev_turn"), F.col("turn_index").alias("resp_turn"), "prev_speaker_id", F.col("speaker_id").alias("resp_speaker_id"), F.col("prev_n_words").alias("prev_words"), F.col("n_words").alias("resp_words"))


def bridge_rate(turns: DataFrame) -> DataFrame:
    """Pairs of consecutive participant turns with moderator turns left out, and the share of these that bridge one."""
    seq = F.row_number().over(by_turn())
    p = turns.where("role is not null").withColumn("_i", seq).where("role = 'participant'").withColumn("_gap", F.col("_i") - F.lag("_i").over(by_turn()))
    return p.where("_gap is not null").groupBy("session_id").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("_gap") > 1).alias("bridged"), r6(F.avg((F.col("_gap") > 1).cast("double"))).alias("rate"))


def relevance_pairs(turns: DataFrame) -> DataFrame:
    """As-of: each participant turn with the latest moderator turn before it and its section's opener; a window, no join."""
    mod = F.when(F.col("role") == "moderator", F.col("turn_index"))
    w = W.partitionBy("session_id", "section")
    df = turns.withColumns({"moderator_turn": F.last(mod, ignorenulls=True).over(by_turn().rowsBetween(W.unboundedPreceding, -1)), "opener": F.min(mod).over(w)})
    return df.where("role = 'participant'").select("session_id", "turn_index", "moderator_turn", "opener")


def between_pairs(turns: DataFrame, floor: DataFrame) -> DataFrame:
    """All pairs i < j of different speakers inside a section above the floor; sections are small blocks."""
    a = turns.where("role = 'participant'").join(floor.where("meets_floor"), ["session_id", "section"], "left_semi").select("session_id", "section", "turn_index", "speaker_id", "n_words")
    b = a.select("session_id", "section", F.col("turn_index").alias("turn_b"), F.col("speaker_id").alias("speaker_b"), F.col("n_words").alias("words_b"))
    return a.join(b, ["session_id", "section"]).where((F.col("turn_index") < F.col("turn_b")) & (F.col("speaker_id") != F.col("speaker_b"))).select("session_id", "section", F.col("turn_index").alias("turn_a"), "turn_b", (F.col("n_words") + F.col("words_b")).alias("words"))


def paired_reference(sessions: DataFrame, reference: str) -> DataFrame:
    """Each generated session with its group's reference session; groups without exactly one have none."""
    ref = sessions.where(F.col("condition") == reference).groupBy("group_id").agg(F.count(F.lit(1)).alias("_n"), F.min("session_id").alias("reference_session")).where("_n = 1")
    return sessions.where(F.col("condition") != reference).join(ref, "group_id", "left").select("session_id", "condition", "group_id", "reference_session")


#: Moderator actions that aim at one member, and those that open a section.
STRICT, OPENING = ("direct_probe", "reactivate_silent", "invite_to_speak"), ("section_transition",)
HUB_OVER = 5


def interaction_edges(turns: DataFrame, roster: DataFrame) -> DataFrame:
    """Directed edges by type: addressed (the moderator names a member), answered (a member speaks after the moderator), uptake (after another
    member), referenced (a member names another). Density over the possible directed pairs of the type, NULL where there are none; `hub` if the session
    has no edge between members and more than HUB_OVER from the moderator."""
    said = turns.where("role is not null").withColumns({"target": F.lag("speaker_id").over(by_turn()), "_r": F.lag("role").over(by_turn())})
    edge = lambda df, kind, source, target: df.select("session_id", source.alias("source"), target.alias("target"), F.lit(kind).alias("type"))
    moderator, who = F.lit("MODERATOR"), F.col("speaker_id")
    member = said.where("role = 'participant'")
    up = edge(member.where("_r = 'participant' and target != speaker_id"), "uptake", who, F.col("target"))
    answered = edge(member.where("_r = 'moderator'"), "answered", who, moderator)
    named = turns.where("role is not null").select("session_id", "role", "speaker_id", F.explode(F.array_distinct(tokens("text", "[a-z]+"))).alias("name"))
    named = named.join(roster.select("session_id", "name", F.col("speaker_id").alias("target")).hint("merge"), ["session_id", "name"])
    ref = edge(named.where("role = 'participant' and speaker_id != target"), "referenced", who, F.col("target"))
    addressed = edge(named.where("role = 'moderator'"), "addressed", moderator, F.col("target"))
    people = turns.where("role = 'participant'").groupBy("session_id").agg(F.count_distinct("speaker_id").alias("k"))
    g = up.unionByName(answered).unionByName(ref).unionByName(addressed).groupBy("session_id", "type").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("source", "target").alias("pairs"))
    between, session = F.col("type").isin("uptake", "referenced"), W.partitionBy("session_id")
    hub = (F.sum(F.when(between, F.col("edges")).otherwise(0)).over(session) == 0) & (F.sum(F.when(F.col("type") == "addressed", F.col("edges")).otherwise(0)).over(session) > HUB_OVER)
    possible = F.when(between, F.col("k") * (F.col("k") - 1)).otherwise(F.col("k"))
    return g.withColumn("hub", hub).join(people.hint("merge"), "session_id", "left").select("session_id", "type", "edges", r6(ratio("pairs", possible)).alias("density"), "hub")


def mentions(turns: DataFrame, members: DataFrame) -> DataFrame:
    """(session_id, turn_index, role, speaker_id, target, how), one row for each turn and member of the session that its text names: by the full name anywhere in it, else by a first name of three letters or
    more as a whole word, else by the id anywhere. members: session_id, speaker_id, name. A session's members are one array, which its turns meet once."""
    plain = lambda c: F.concat(F.lit(" "), F.regexp_replace(c, r"[^\p{L}\p{N}_]+", " "), F.lit(" "))
    full = F.lower("name")
    one = F.struct(F.col("speaker_id").alias("id"), full.alias("full"), F.get(words(full), F.lit(0)).alias("first"))
    of = members.where("trim(name) != ''").groupBy("session_id").agg(F.array_sort(F.collect_set(one)).alias("_m"))
    low = F.lower(F.coalesce("text", F.lit("")))
    t = turns.where("role is not null").join(of.hint("merge"), "session_id").withColumns({"_low": low, "_plain": plain(low)})
    how = lambda m: F.when(F.contains("_low", m["full"]), "full_name").when((F.char_length(m["first"]) > 2) & F.contains("_plain", plain(m["first"])), "first_name").when(F.contains("_low", F.lower(m["id"].cast("string"))), "id")
    found = F.filter(F.transform("_m", lambda m: F.struct(m["id"].alias("target"), how(m).alias("how"))), lambda x: x["how"].isNotNull())
    t = t.select("session_id", "turn_index", "role", "speaker_id", F.explode(found).alias("x")).select("session_id", "turn_index", "role", "speaker_id", "x.*")
    return t.where("role = 'moderator' or target != speaker_id")


def interaction_graph(turns: DataFrame, members: DataFrame) -> DataFrame:
    """Per session with members: edges by kind of end (between members: uptake of the turn before and mentions; from and to the moderator), densities over all directed pairs of members and over members, how
    mentions were made, and `hub`: no edge between members and more than HUB_OVER from the moderator. Density between fewer than two members is 0 with status `insufficient_sample`."""
    said = turns.where("role is not null").withColumns({"target": F.lag("speaker_id").over(by_turn()), "_r": F.lag("role").over(by_turn())}).where("role = 'participant'")
    edge = lambda df, kind, source, target, how: df.select("session_id", F.lit(kind).alias("kind"), source.cast("string").alias("source"), target.cast("string").alias("target"), how.alias("how"))
    who, mod, none = F.col("speaker_id"), F.lit("MODERATOR"), F.lit(None).cast("string")
    named = mentions(turns, members)
    edges = edge(said.where("_r = 'moderator'"), "to_moderator", who, mod, none).unionByName(edge(said.where("_r = 'participant' and target != speaker_id"), "between", who, F.col("target"), none))
    edges = edges.unionByName(edge(named.where("role = 'participant'"), "between", who, F.col("target"), F.col("how"))).unionByName(edge(named.where("role = 'moderator'"), "from_moderator", mod, F.col("target"), F.col("how")))
    kinds = ("between", "from_moderator", "to_moderator")
    count = lambda k: F.count_if(F.coalesce(F.col("kind") == k, F.lit(False)))
    g = edges.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("edges"), *(count(k).alias(k) for k in kinds), *(F.count_distinct(F.when(F.col("kind") == k, F.struct("source", "target"))).alias(f"_{k}") for k in kinds),
        *(F.count_if(F.coalesce(F.col("how") == h, F.lit(False))).alias(f"{h}_mentions") for h in ("full_name", "first_name", "id")),
    )
    n = members.where("trim(name) != ''").groupBy("session_id").agg(F.count_distinct("speaker_id").alias("members"))
    j = n.join(g.hint("merge"), "session_id", "left").na.fill(0)
    m = F.col("members")
    return j.select(
        "session_id", "members", "edges", *kinds, F.col("_between").alias("pairs"), (m * (m - 1)).alias("possible"), r6(F.coalesce(ratio("_between", m * (m - 1)), F.lit(0.0))).alias("density"), F.when(m < 2, "insufficient_sample").otherwise("ok").alias("status"),
        r6(ratio("_from_moderator", m)).alias("density_from_moderator"), r6(ratio("_to_moderator", m)).alias("density_to_moderator"), "full_name_mentions", "first_name_mentions", "id_mentions", ((F.col("between") == 0) & (F.col("from_moderator") > HUB_OVER)).alias("hub"),
    )


def targeting(turns: DataFrame, log: DataFrame, roster: DataFrame) -> DataFrame:
    """Moderator decisions (session_id, turn_index, action, target) on the moderator turns that carry them: strict (aims at one member), soft (at the
    group, naming members), broad, transition or ambiguous; a strict one is honoured if the next participant is its target."""
    after = F.first(F.when(F.col("role") == "participant", F.col("speaker_id")), ignorenulls=True).over(by_turn().rowsBetween(1, W.unboundedFollowing))
    m = turns.withColumn("next_speaker", after).where("role = 'moderator'").select("session_id", "turn_index", "next_speaker", F.array_distinct(tokens("text", "[a-z]+")).alias("_t"))
    names = roster.groupBy("session_id").agg(F.collect_set("name").alias("_n"))
    m = m.join(names.hint("merge"), "session_id", "left").join(log.hint("merge"), ["session_id", "turn_index"])
    names_any = F.coalesce(F.arrays_overlap("_t", "_n"), F.lit(False))
    group, opens = F.coalesce(F.col("target") == "group", F.lit(False)), F.col("action").isin(*OPENING)
    kind = (
        F.when(F.col("action").isin(*STRICT) & F.col("target").isNotNull() & ~group, "strict").when(group & names_any, "soft").when(group & opens, "transition").when(group, "broad")
        .when(opens | (F.col("action") == "ask_initial_to_group"), "transition").otherwise("ambiguous")
    )
    m = m.withColumn("kind", kind)
    return m.select("session_id", "turn_index", "action", "target", "kind", F.when(F.col("kind") == "strict", F.coalesce(F.col("next_speaker") == F.col("target"), F.lit(False))).alias("honoured"))


def side_by_side(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Values of two sides on the same keys; the difference is NULL where a side is missing."""
    j = a.select(*on, F.col("value").alias("a")).join(b.select(*on, F.col("value").alias("b")), on, "full")
    return j.select(*on, r6("a").alias("a"), r6("b").alias("b"), r6(F.col("a") - F.col("b")).alias("difference"))


def grid_integrity(seen: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """Expected cells (the product of small dimensions) against observed (cell, run) rows: missing, unexpected, duplicate run, collision."""
    keys = list(dims)
    grid = dims[keys[0]].select(keys[0]).distinct()
    for k in keys[1:]:
        grid = with_each(grid, dims[k], k)
    n = seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("run").alias("runs"))
    j = grid.withColumn("_e", F.lit(True)).join(n, keys, "full")
    state = F.when(F.col("rows").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").when(F.col("runs") > 1, "collision").when(F.col("rows") > 1, "duplicate").otherwise("ok")
    return j.select(*keys, F.coalesce("rows", F.lit(0)).alias("rows"), state.alias("state"))


def sequence_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two label sequences (session_id, pos, label) by position: first mismatch, mismatches and lengths."""
    j = a.select("session_id", "pos", F.col("label").alias("x")).join(b.select("session_id", "pos", F.col("label").alias("y")), ["session_id", "pos"], "full")
    off = ~F.col("x").eqNullSafe(F.col("y"))
    return j.groupBy("session_id").agg(F.count("x").alias("n_a"), F.count("y").alias("n_b"), F.count_if(off).alias("mismatches"), F.min(F.when(off, F.col("pos"))).alias("first"))


#: Shingles of a protected set that is broadcast (some 60 bytes each).
PROTECTED = 500_000


def shingles(df: DataFrame, key: str, n: int = 8) -> DataFrame:
    """(key, shingle): the distinct n-word sequences of lower-cased alphanumeric words."""
    t = tokens("text", "[a-z0-9]+")
    df = df.select(key, t.alias("t")).where(F.size("t") >= n)
    return df.select(key, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("t") - n), lambda i: F.array_join(F.slice("t", i + 1, n), " ")))).alias("shingle"))


def contamination(scanned: DataFrame, protected: DataFrame, allowed: DataFrame) -> DataFrame:
    """Scanned texts that share protected shingles which the allowed corpus doesn't have: how many, of how many items, and the first three of them.

    A protected set of at most PROTECTED shingles is broadcast, so the allowed and the scanned shingles are met where they are made and only hits move; a larger one is
    joined by merging, the scanned ones on a 64-bit hash and the shingle itself."""
    few = protected.limit(PROTECTED + 1).count() <= PROTECTED
    wanted = protected.select("shingle").distinct()
    held = allowed.select("shingle").join(F.broadcast(wanted) if few else wanted.hint("merge"), "shingle", "left_semi").distinct()
    risky = protected.join(held.hint("merge"), "shingle", "left_anti").distinct()
    if few:
        hits = scanned.join(F.broadcast(risky), "shingle")
    else:
        keyed = lambda df: df.withColumn("_h", F.xxhash64("shingle"))
        hits = keyed(scanned).join(keyed(risky).hint("merge"), ["_h", "shingle"])
    found = F.collect_set("shingle")
    return hits.groupBy("doc_id").agg(F.size(found).cast("long").alias("shared"), F.count_distinct("item_id").alias("items"), F.slice(F.array_sort(found), 1, 3).alias("first_hits"))


def candidate_pairs(a: DataFrame, b: DataFrame, least: float = 0.18, top: int = 2) -> DataFrame:
    """Pairs within a block: each item's best `top` by similarity or all above `least`; the similarity is 3/4 token Jaccard and 1/4 edit
    likeness of the labels."""
    j = a.join(b, "block")
    jac = F.size(F.array_intersect("ta", "tb")) / F.size(F.array_union("ta", "tb"))
    edit = 1 - F.levenshtein("la", "lb") / F.greatest(F.char_length("la"), F.char_length("lb"))
    j = j.withColumn("sim", r6(0.75 * jac + 0.25 * edit))
    best = lambda k, o: F.row_number().over(W.partitionBy("block", k).orderBy(F.desc("sim"), o)) <= top
    return j.withColumns({"_a": best("ia", "ib"), "_b": best("ib", "ia")}).select("block", "ia", "ib", "sim", (F.col("_a") | F.col("_b") | (F.col("sim") >= least)).alias("candidate"))


def reconcile(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Ids in one or both tables, and whether their counts agree."""
    j = a.groupBy(key).agg(F.count(F.lit(1)).alias("n_a")).join(b.groupBy(key).agg(F.count(F.lit(1)).alias("n_b")), key, "full")
    return j.select(key, "n_a", "n_b", F.when(F.col("n_b").isNull(), "only_a").when(F.col("n_a").isNull(), "only_b").when(F.col("n_a") == F.col("n_b"), "match").otherwise("differs").alias("state"))


def attribute_match(targets: DataFrame, pool: DataFrame, keys: list[str], k: int = 2) -> DataFrame:
    """k pool records for each target on exact keys, without replacement: targets with the same keys take disjoint slices of the pool,
    which is ordered by hash; `short` marks targets that get fewer than k."""
    t = targets.withColumn("_j", F.row_number().over(W.partitionBy(*keys).orderBy("target_id")))
    p = pool.withColumns({"_r": F.row_number().over(W.partitionBy(*keys).orderBy(F.md5(F.col("record_id").cast("string")), "record_id")), "pool": F.count(F.lit(1)).over(W.partitionBy(*keys))})
    p = p.withColumn("_j", F.ceil(F.col("_r") / k))
    return t.join(p, [*keys, "_j"], "left").groupBy("target_id").agg(F.array_sort(F.collect_list("record_id")).alias("records"), F.max("pool").alias("pool")).withColumn("short", F.size("records") < k)


def metric_mapping(wanted: DataFrame, have: DataFrame, alias: DataFrame) -> DataFrame:
    """Each wanted metric by its exact name, else by the first alias (in priority order) that is there."""
    exact = wanted.join(have.select(F.col("metric").alias("name"), F.col("value").alias("exact")), "name", "left")
    al = alias.join(have, F.col("alias") == F.col("metric")).groupBy("name").agg(F.min_by("value", "priority").alias("aliased"), F.min_by("alias", "priority").alias("via"))
    return exact.join(al, "name", "left").select("name", r6(F.coalesce("exact", "aliased")).alias("value"), F.when(F.col("exact").isNotNull(), "exact").when(F.col("aliased").isNotNull(), F.concat(F.lit("alias:"), "via")).otherwise("none").alias("source"))
