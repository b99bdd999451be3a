"""Quality verdicts, the mixing schedule and the pipeline's stages against versions written anew in plain Python."""

import collections
import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing, quality

SPACE, D = re.compile(r"[ \t-\r]+"), "/root/testdata/sf0.001"


def words(t):
    return [w for w in SPACE.split(t or "") if w]


def rule_votes(t):
    """(base_failed, votes) of one text."""
    w, lines = words(t), [x for x in (t or "").split("\n") if SPACE.sub("", x)]
    if not w:
        return True, [0] * 7
    c = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    repeats = len({p for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for p in range(k, k + 3)})
    symbols, mean, distinct = sum(t.count(x) for x in "#*$%&|<>") / len(w), sum(map(len, w)) / len(w), len(set(w)) / len(w)
    twice, common = 1 - len(set(lines)) / len(lines), len(set(w) & set(quality.COMMON))
    ends = sum(bool(re.search(r'[.!?:;"][ \t-\r]*$', x)) for x in lines) / len(lines)
    bad = [symbols > 0.1, mean < 3 or mean > 8.5, distinct < 0.25, repeats / len(w) > 0.3, twice > 0.3 + 1e-12, common == 0, len(lines) >= 2 and ends < 0.2]
    good = [False, 3.5 <= mean <= 7.5, False, False, False, common >= 2, ends >= 0.6]
    return len(w) < 50 or 100 * repeats > 50 * len(w), [-1 if b else int(g) for b, g in zip(bad, good, strict=True)]


def posteriors(votes, prior=0.8, accuracy=0.85, abstain=0.2, weight=20.0):
    """Expectation-maximisation row by row: classes x rules x votes (-1, 0, 1)."""
    seen = np.array(votes)[:, :, None] == np.array([-1, 0, 1])
    says = (1 - abstain) * np.array([1 - accuracy, accuracy])
    start = np.repeat(np.array([[says[0], abstain, says[1]], [says[1], abstain, says[0]]])[:, None, :], seen.shape[1], axis=1)
    rate, p = start, prior

    def good():
        logs = np.log([p, 1 - p])[:, None] + np.einsum("nkv,ckv->cn", seen, np.log(rate))
        return 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -700, 700)))

    for _ in range(50):
        g = good()
        counts = weight * start + np.einsum("cn,nkv->ckv", np.stack([g, 1 - g]), seen)
        p = min(0.99, max(0.5, (g.sum() + weight * prior) / (len(g) + weight)))
        rate = counts / counts.sum(axis=2, keepdims=True)
        pooled = counts.sum(axis=0) / counts.sum(axis=(0, 2))[:, None]
        for v, wrong in ((0, rate[1, :, 0] < rate[0, :, 0]), (2, rate[0, :, 2] < rate[1, :, 2])):
            rate[:, wrong, v] = pooled[wrong, v]
        rate[:, :, 1] = np.maximum(1e-9, 1 - rate[:, :, 0] - rate[:, :, 2])
    return good()


def mix(rows):
    """rows: (key, size, source, hash as unsigned): {key: (taken words, times that its first word's block is taken)}."""
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(r[1] for r in rows if r[2] == s) for s in sources}
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(sources)}
    total, target = sum(size.values()), {}
    while len(target) < len(sources):
        open_ = [s for s in sources if s not in target]
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        capped = [s for s in open_ if weight[s] * level >= 3 * size[s]]
        target |= {s: 3.0 * size[s] for s in capped} if capped else {s: weight[s] * level for s in open_}
    length = {s: max(1, min(mixing.BLOCK, total // mixing.LEAST_SLOTS, int(min(size[s], target[s]) // mixing.LEAST_BLOCKS))) for s in sources}
    blocks = {s: -(-size[s] // length[s]) for s in sources}
    slots = [target[s] * blocks[s] / size[s] if size[s] else 0.0 for s in sources]
    edge, rank, times = list(itertools.accumulate(slots)), collections.Counter(), collections.Counter()
    for i in range(round(sum(slots))):
        point = (i + 1) * 2654435769 % 2**32 / 2**32
        s = next(s for s, e in zip(sources, edge, strict=True) if point < e / edge[-1])
        if rank[s] < 3 * blocks[s]:
            times[s, rank[s] % blocks[s]] += 1
        rank[s] += 1
    got = {}
    for s in sources:
        at, n = 0, length[s]
        for key, words_, _, _ in sorted((r for r in rows if r[2] == s), key=lambda r: (r[3], r[0])):
            taken = sum(times[s, b] * (min(at + words_, (b + 1) * n) - max(at, b * n)) for b in range(at // n, -(-(at + words_) // n)))
            got[key] = (taken, times[s, min(at // n, blocks[s] - 1)])
            at += words_
    return got


def hashed(docs):
    h = F.xxhash64(F.lit(17), "doc_id", F.char_length(F.coalesce("text", F.lit(""))))
    return [(r.doc_id, len(words(r.text)), r.source, r.h % 2**64) for r in docs.select("doc_id", "text", "source", h.alias("h")).collect()]


def ids(df):
    return collections.Counter(r.doc_id for r in df.select("doc_id").collect())


def test_quality_of_all_documents(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    rows = [(r.doc_id, *rule_votes(r.text)) for r in docs.collect()]
    want = {d: (v, failed, p) for (d, failed, v), p in zip(rows, posteriors([r[2] for r in rows]), strict=True)}
    got = quality.quality_report(docs).collect()
    assert len(got) == len(want)
    for r in got:
        v, failed, p = want[r.doc_id]
        assert [r[f"vote_{k}"] for k in quality.RULES] == v and r.base_failed == failed and r.quality == pytest.approx(p, abs=1e-6) and r.kept == (not failed and p >= 0.5)


def test_schedule_is_that_of_a_plain_walk(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 11 > 0, F.col("source")))
    want = mix(hashed(docs))
    assert {r.doc_id: r.taken for r in mixing.mix_report(docs).collect()} == {d: t for d, (t, _) in want.items()}
    assert ids(mixing.mixed_documents(docs)) == collections.Counter({d: n for d, (_, n) in want.items() if n})


def near_groups(docs):
    """doc_id: least doc_id reachable by links of 80 of 100 five-word shingles."""
    sets = {}
    for r in docs:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}
    find = lambda d: d if root[d] == d else find(root[d])
    for a, b in itertools.combinations(sorted(sets), 2):
        if (both := len(sets[a] & sets[b])) and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: find(d) for d in sets}


def test_pipeline_stages(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{D}/documents.parquet")
    stage = {name: f for name, f in c.STAGES}
    rows = docs.collect()
    votes = [rule_votes(r.text) for r in rows]
    want = {r.doc_id for r, (failed, _), p in zip(rows, votes, posteriors([v for _, v in votes]), strict=True) if not failed and p >= 0.5}
    kept = stage["quality"](spark, docs, D).cache()
    assert ids(kept) == collections.Counter(want)
    groups = collections.defaultdict(list)
    for r in kept.collect():
        groups[SPACE.sub("", r.text or "")].append((-len(r.text or ""), r.doc_id))
    one = stage["exact_dedup"](spark, kept, D).cache()
    assert ids(one) == collections.Counter(min(g)[1] for g in groups.values())
    apart = stage["near_dedup"](spark, one, D).cache()
    assert ids(apart) == collections.Counter(set(near_groups(one.collect()).values()))
    times = collections.Counter({d: n for d, (_, n) in mix(hashed(apart)).items() if n})
    mixed = stage["mixing"](spark, apart, D).cache()
    assert ids(mixed) == times
    assert ids(stage["packing"](spark, mixed, D)) == times == ids(c.run(spark, D))
    assert math.isclose(sum(times.values()), mixed.count())
