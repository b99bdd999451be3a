"""Text operators against brute force on a small fixture with nulls, empty and long texts, ties, repeated rows and clashing names."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, components, exact_dedup, language, linededup, minhash, mixing, packing, pii, quality, queries, substring, tokenfiles, weak

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, maybe string, key string, size string, bucket0 string"
TOKENIZER = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def corpus():
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base, passage = say(120), say(60)
    lines = "\n".join(say(9) for _ in range(6))
    texts = [say(80) for _ in range(12)] + [base, base, f" {base}\n", base + " tail", base.replace(base.split()[50], "swapped", 1), passage + " " + say(30), say(40) + " " + passage, lines, say(5) + "\n" + lines + "\n" + say(5)]
    texts += [None, "", " \t\n", "one", "ONE", "a b c d", passage.upper(), "x " * 300, say(9000), "émile ñ 漢字 " + say(60), "no letters 12", "123 456"]
    texts += ["mail a.b@c.example.org, 10.0.0.255 and 999.1.1.1 or 4111 1111 1111 1111 call +49 (30) 1234567", 'token = "0123456789abcdef0123456789abcdef01234567" x@y', "1.2.3.4.5.6.7.8 a@b.c_d@e.f 4111111111111112"]
    rows = [(i * 7 % 101, t, ["en", "de", None][i % 3], ["s1", "s2", None][i % 3], None, "m", "k", "z", "b") for i, t in enumerate(texts)]
    return rows + [rows[0], rows[0], (None, "null id " + say(30), "en", "s1", 1, "m", "k", "z", "b")]


ROWS = corpus()
SPACE = re.compile(r"[ \t-\r]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def words(t):
    return (t or "").encode().split()


def test_exact_groups(docs, none):
    key = lambda t: hashlib.sha256(SPACE.sub("", t or "").encode()).hexdigest()
    groups = collections.defaultdict(list)
    for r in ROWS:
        groups[key(r[1])].append((-len(r[1] or ""), r[0] is None, r[0]))
    want = sorted(((r[0], min(g := groups[key(r[1])])[2], len(g), min(g)[2] == r[0], key(r[1])) for r in ROWS), key=repr)
    assert rows_of(exact_dedup.exact_groups(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(exact_dedup, "BROADCAST_BYTES", -1)  # too large a filter to broadcast
        assert rows_of(exact_dedup.exact_groups(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want
        assert rows_of(exact_dedup.exact_dedup(docs), *docs.columns) == rows_of(kept, *docs.columns)
    edge = docs.sparkSession.createDataFrame([(-(2**63), "a b", 1), (2**63 - 1, "ab", 2), (5, "c", 3), (5, "c", 4), (None, "c", 5)], "doc_id long, text string, x int")
    assert rows_of(exact_dedup.exact_dedup(edge.union(edge)), "doc_id", "text")[0] == (-(2**63), "a b") and exact_dedup.exact_dedup(edge).where("doc_id = 5").count() == 1
    assert exact_dedup.exact_groups(none).count() == 0 and exact_dedup.exact_dedup(none).count() == 0


def brute_lines(rows, run=3):
    seen, out = {}, {}
    first = collections.OrderedDict(((r[0], r[1]), r) for r in rows)
    order = sorted(first.values(), key=lambda r: (r[0] is None, r[0]))
    for r in order:
        solid = [(i, s) for i, x in enumerate((r[1] or "").split("\n")) if (s := x.strip(" \t\x0b\x0c\r"))]
        gone = set()
        for j in range(len(solid) - run + 1):
            w = tuple(s for _, s in solid[j : j + run])
            if w in seen:
                gone.update(range(solid[j][0], solid[j + run - 1][0] + 1))
            seen.setdefault(w, r[0])
        out[r[0], r[1]] = len(gone)
    return out


def test_lines(docs, none):
    want = brute_lines(ROWS)
    assert rows_of(linededup.line_report(docs), "doc_id", "n_removed") == sorted(((r[0], want[r[0], r[1]]) for r in ROWS), key=repr)
    assert sum(want.values()) >= 6
    out = linededup.remove_repeated_lines(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS) and out.where("text is null").count() == 1
    assert linededup.line_report(none).count() == 0


def test_pii(docs, none):
    base = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def ok(kind, m):
        d = re.sub("[^0-9]", "", m)
        luhn = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0
        return {"email": True, "ip": all(int(x) <= 255 for x in m.split(".")) if kind == "ip" else None, "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]

    want = []
    for r in ROWS:
        spans = sorted((m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(base.items()) for m in re.finditer(p, r[1] or "") if ok(kind, m[0]))
        n = collections.Counter(s[3] for s in spans)
        want.append((r[0], n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans).encode()).hexdigest()))
    got = pii.span_report(docs)
    assert rows_of(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(want, key=repr)
    assert got.where("spans like '%secret:%'").count() == 1
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and clean.count() == len(ROWS) and clean.where("text like '%@c.example%'").count() == 0
    assert clean.where("text like 'mail <email>, <ip> and 999.1.1.1 or <card> call <phone>'").count() == 1
    assert pii.span_report(none).count() == 0


@pytest.mark.parametrize(("group", "share"), [(2000, 1000), (1, 3), (1, 1e9)])
def test_substrings(docs, none, group, share, monkeypatch):
    monkeypatch.setattr(common, "SHARE", share)
    count = collections.Counter()
    for r in ROWS:
        w = words(r[1])
        count.update(tuple(w[k : k + 35]) for k in range(len(w) - 34))
    want = []
    for r in ROWS:
        w = words(r[1])
        cut = {p for k in range(len(w) - 34) if count[tuple(w[k : k + 35])] > 1 for p in range(k, k + 35)}
        want.append((r[0], len(w), len(cut), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in cut)).hexdigest()))
    assert rows_of(substring.repeat_report(docs, group=group), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=repr)
    out = substring.remove_repeats(docs, group=group)
    assert out.columns == [*docs.columns, "n_words", "n_removed"] and out.count() == len(ROWS)
    assert substring.repeat_report(none).count() == 0


def test_texts_longer_than_a_slice(spark):
    """Texts above the 4 MB that are worked at a time: repeats across them are found whole."""
    rng = random.Random(8)
    say = lambda n: " ".join(f"{rng.randrange(10**9)}" for _ in range(n))
    passage = say(60)
    texts = [say(450_000), passage + " " + say(450_000), say(20) + " " + passage]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert min(map(len, texts[:2])) > 4_000_000
    assert rows_of(substring.repeat_report(docs), "doc_id", "n_words", "n_removed") == [(0, 450_000, 0), (1, 450_060, 60), (2, 80, 60)]
    assert rows_of(minhash.near_groups(docs), "doc_id", "n_shingles", "component_id") == [(0, 449_996, 0), (1, 450_056, 1), (2, 76, 2)]


def test_near_groups(docs, none, monkeypatch):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = []
    for r in ROWS:
        w = (r[1] or "").encode().translate(low).split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = {r[0]: r[0] for r in ROWS}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and None not in (ROWS[i][0], ROWS[j][0]) and 100 * len(a & b) >= 85 * len(a | b):
                x, y = find(ROWS[i][0]), find(ROWS[j][0])
                root[max(x, y)] = min(x, y)
    want = sorted(((r[0], len(s), find(r[0]), find(r[0]) == r[0]) for r, s in zip(ROWS, sets, strict=True)), key=repr)
    assert rows_of(minhash.near_groups(docs, 85), "doc_id", "n_shingles", "component_id", "kept") == want
    monkeypatch.setattr(minhash, "TILE", 1)
    assert rows_of(minhash.near_groups(docs, 85), "doc_id", "n_shingles", "component_id", "kept") == want
    assert minhash.near_dedup(docs).columns == docs.columns and minhash.near_groups(none).count() == 0


def test_one_bucket_of_look_alikes_below_the_threshold(spark, monkeypatch):
    """Texts of one long passage and an own tail, alike by 0.6, and among them pairs above 0.8 that no hub links."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage, texts = [word() for _ in range(304)], []
    for n in range(900):
        tail = [word() for _ in range(100)]
        texts.append(" ".join(passage + tail))
        if n % 90 == 0:
            texts.append(" ".join(passage + tail[:60] + [word() for _ in range(20)]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    monkeypatch.setattr(minhash, "TILE", 64)
    sets = [frozenset(zip(*(t.split()[k:] for k in range(5)))) for t in texts]  # noqa: B905
    want = {j: i for i in range(len(texts)) for j in range(i + 1, min(i + 2, len(texts))) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    got = {r.doc_id: r.component_id for r in minhash.near_groups(docs).where("not kept").collect()}
    assert len(want) == 10 and got == want


def test_sketch_agreement_estimates_similarity():
    rng = np.random.default_rng(1)
    for n, share in ((1, 1.0), (3, 1 / 3), (900, 0.5)):
        x = rng.integers(0, 2**63, n, dtype=np.uint64)
        y = np.concatenate([x[: max(1, round(n * 2 * share / (1 + share)))], rng.integers(0, 2**63, n, dtype=np.uint64)])[:n]
        j = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        assert abs((minhash.sketch(x) == minhash.sketch(y)).mean() - j) < 0.2


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (3, 4), (10, 11), (12, 11), (7, 7)], "a long, b long")
    chain = spark.range(199).selectExpr("id * 37 % 200 a", "(id + 1) * 37 % 200 b").union(spark.createDataFrame([(7, None)], "a long, b long"))
    assert {r.component for r in components.components(chain).collect()} == {0} and components.components(chain).count() == 200
    star = spark.range(1, 5000).selectExpr("if(id % 2 = 0, 0, 9999) a", "id b").union(spark.createDataFrame([(9999, 2)], "a long, b long"))
    assert components.components(star).agg(F.max("component"), F.count("*")).first() == (0, 5001)
    assert components.components(star.where("false")).count() == 0
    assert rows_of(components.components(edges), "id", "component") == sorted([(k, 1) for k in (1, 2, 3, 4)] + [(k, 10) for k in (10, 11, 12)], key=repr)


def test_language(docs, none):
    model = language.fit(language.sample(docs))
    got = language.identify(docs, model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    for r in ROWS:
        if r[1] is None or not any(c.isalpha() for c in r[1]):
            assert by[r[0]].lang_pred == "und"
        assert by[r[0]].held_out == (r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 == 2)
    assert language.language_report(none).count() == 0


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    score, step = rng.normal(size=(7, 3)).astype(np.float32), rng.normal(size=(3, 3))
    got = language.marginals(score, np.array([0, 4, 4, 7]), step)
    for a, b in ((0, 4), (4, 7)):
        want = np.zeros((b - a, 3))
        for path in np.ndindex(*[3] * (b - a)):
            p = np.exp(sum(score[a + t, k] for t, k in enumerate(path)) + sum(step[path[t], path[t + 1]] for t in range(b - a - 1)))
            for t, k in enumerate(path):
                want[t, k] += p
        assert np.allclose(got[a:b], want / want.sum(axis=1, keepdims=True), atol=1e-5)


def test_gradient_matches_enumeration_and_differences():
    rng = np.random.default_rng(1)
    score, step, first = rng.normal(size=(6, 3)), rng.normal(size=(3, 3)), np.array([0, 4, 6])
    y = np.eye(3)[rng.integers(0, 3, 6)]

    def loss(score, step):
        total = 0.0
        for a, b in ((0, 4), (4, 6)):
            of = lambda path: sum(score[a + t, k] for t, k in enumerate(path)) + sum(step[path[t], path[t + 1]] for t in range(len(path) - 1))  # noqa: B023, E731
            total += np.log(sum(np.exp(of(path)) for path in np.ndindex(*[3] * (b - a)))) - of(y[a:b].argmax(axis=1))
        return total

    by_word, moves = language._slopes(*language.pair_marginals(score, first, step), y)
    for x, slope in ((score, by_word), (step, moves)):
        for at in np.ndindex(x.shape):
            up, down = x.copy(), x.copy()
            up[at] += 1e-5
            down[at] -= 1e-5
            want = (loss(up, step) - loss(down, step) if x is score else loss(score, up) - loss(score, down)) / 2e-5
            assert slope[at] == pytest.approx(want, abs=1e-6)


def test_language_sample_is_bounded(spark):
    rows = spark.range(3000).selectExpr("id doc_id", "'some words here' text", "if(id % 3 = 0, 'a', 'b') lang")
    got = collections.Counter(lang for lang, _ in language.sample(rows, per_language=40))
    assert got == {"a": 40, "b": 40}


def test_posterior_is_that_of_the_fitted_rates():
    rng, patterns = random.Random(2), collections.Counter()
    for _ in range(4000):
        good = rng.random() < 0.7
        patterns[tuple((0 if rng.random() < q else (1 if (rng.random() < a) == good else -1)) for a, q in ((0.9, 0.3), (0.8, 0.1), (0.7, 0.6), (0.5, 0.2)))] += 1
    prior, rate = weak.expectation_maximisation(sorted(patterns.items()), 4, prior=0.8)
    assert abs(prior - 0.7) < 0.06 and rate[0, True, 1] / rate[0, False, 1] > 4 > 2 > rate[3, True, 1] / rate[3, False, 1]
    ratios = weak.log_ratios(rate, 4)
    for vote in patterns:
        odds = np.log(prior / (1 - prior)) + sum(r[v] for r, v in zip(ratios, vote, strict=True))
        joint = [p * np.prod([rate[k, y, v] for k, v in enumerate(vote)]) for p, y in ((prior, True), (1 - prior, False))]
        assert 1 / (1 + np.exp(-odds)) == pytest.approx(joint[0] / sum(joint))
    for k in range(4):
        assert all(abs(sum(rate[k, y, v] for v in (-1, 0, 1)) - 1) < 1e-6 for y in (True, False)) and rate[k, True, 1] >= rate[k, False, 1] and rate[k, True, -1] <= rate[k, False, -1]


def test_packing(docs, none):
    from tokenizers import Tokenizer

    rng = random.Random(5)
    for _ in range(5):
        hist = [(rng.randint(1, 60), rng.randint(1, 9)) for _ in range(7)]
        hist = list(dict(hist).items())
        cost = lambda bounds: sum(n * (min(b for b in bounds if b >= s) - s) for s, n in hist)
        top = max(s for s, _ in hist)
        best = min(cost([top, x, y]) for x, _ in hist for y, _ in hist)
        assert cost(packing.optimal_bounds(hist, 3)) == best
    assert packing.optimal_bounds([(7, 3)], 5) == [7] and packing.optimal_bounds([(0, 2), (9, 1)], 2) == [0, 9]
    t, rows = Tokenizer.from_file(TOKENIZER), packing.pack(docs, TOKENIZER, buckets=4, budget=500).collect()
    texts = collections.defaultdict(list)
    for r in ROWS:
        texts[r[0]].append(len(t.encode(r[1] or "", add_special_tokens=False).ids))
    assert sorted(((r.doc_id, r.n_tokens) for r in rows), key=repr) == sorted(((k, n) for k, x in texts.items() for n in x), key=repr)
    sizes = collections.Counter(r.n_tokens for r in rows)
    cost = lambda bounds: sum(n * (min(b for b in bounds if b >= s) - s) for s, n in sizes.items())
    best = min(cost([max(sizes), *x]) for x in itertools.combinations(sorted(sizes), 3))
    bounds = {r.bucket for r in rows}
    assert len(bounds) <= 4 and bounds <= set(sizes) and sum(r.padding for r in rows) == cost(bounds) == best
    for b in bounds:
        inside, fit = [r for r in rows if r.bucket == b], max(1, 500 // max(b, 1))
        assert all(r.n_tokens + r.padding == b and r.n_tokens <= b for r in inside) and all(r.n_tokens > max([x for x in bounds if x < b], default=-1) for r in inside)
        assert sorted(r.batch * fit + r.place for r in inside) == list(range(len(inside))) and all(r.place < fit for r in inside)
    assert packing.pack_ids(none, TOKENIZER).count() == 0
    clash = docs.selectExpr("*", "1 bucket", "2 batch", "3 _n", "4 place", "5 Padding", "6 n_tokens", "7 _h", "8 _id", "9 `k.x`")
    out = packing.pack(clash, length=F.char_length("text"))
    assert out.columns == [*docs.columns, "_n", "_h", "_id", "k.x", *packing.RESULT] and out.count() == len(ROWS)


def test_running_sums_of_many_slices(docs, monkeypatch):
    want = rows_of(packing.pack_ids(docs, TOKENIZER), "doc_id", "bucket", "batch", "place")
    mixed = rows_of(mixing.mix_report(docs), "doc_id", "taken")
    monkeypatch.setattr(common, "SLICE_ROWS", 1 / 64)
    assert rows_of(packing.pack_ids(docs, TOKENIZER), "doc_id", "bucket", "batch", "place") == want and rows_of(mixing.mix_report(docs), "doc_id", "taken") == mixed


def test_token_files(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    got = tokenfiles.token_report(docs, TOKENIZER).collect()
    ids = lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]
    crc = lambda x: zlib.crc32(np.array(x, dtype="<u4").tobytes())
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == sorted(((r[0], len(x := ids(r[1])), crc(x)) for r in ROWS), key=repr)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None] == sorted(r[0] for r in ROWS if r[0] is not None)
    shard = tokenfiles.write_token_files(docs, f"file://{tmp_path}/s", TOKENIZER).first()["path"]
    reader = tokenfiles.ShardReader(shard)
    texts = {r[0]: r[1] for r in ROWS}
    for i, doc in enumerate(reader.doc_ids):
        assert reader.document(i).tolist() == ids(texts[doc])
    path = shard.removeprefix("file://")
    raw = bytearray(open(path, "rb").read())
    raw[20] ^= 255
    open(path, "wb").write(raw)
    with pytest.raises(Exception):  # noqa: B017  a damaged frame is never read as ids
        tokenfiles.ShardReader(shard).frame(0)
    assert tokenfiles.token_report(none, TOKENIZER).count() == 0


def test_mixing(docs, none, monkeypatch):
    got = mixing.mix_report(docs).collect()
    assert len(got) == len(ROWS) and all(r.taken <= 3 * r["size"] for r in got)
    sums = collections.defaultdict(int)
    for r in got:
        sums[r.source_size, r.target] += r.taken
    total = sum({k: k[0] for k in sums}.values())
    assert sum(t for _, t in sums) == pytest.approx(total) and all(t <= 3 * s + 1e-6 for s, t in sums)
    assert all(abs(n - t) <= 0.02 * total for (_, t), n in sums.items())
    assert rows_of(mixing.mix_report(docs), "doc_id", "taken") == sorted(((r.doc_id, r.taken) for r in got), key=repr)
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", -1)  # too many sources to broadcast
    assert rows_of(mixing.mix_report(docs), "doc_id", "taken") == sorted(((r.doc_id, r.taken) for r in got), key=repr)
    assert mixing.mixed_documents(docs).columns == docs.columns and mixing.mix_report(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def test_token_files_with_a_special_token_in_the_text(spark):
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(TOKENIZER), "<|endoftext|>"
    texts = [f"hi {e} there", f"{e} at both ends {e}", f"a\n{e}\nb", f"{e} {e}\n{e}", f"x\n {e}. y", f"in{e}side {e}, {e}{e}", f"a  {e} \n", "plain words. here"]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert want[0] == [5303, 220, 50256, 612]
    encoder = tokenfiles.Encoder(TOKENIZER)
    assert [np.frombuffer(x, dtype=encoder.dtype).tolist() for x in encoder.encode(texts)] == want
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    crc = lambda ids: zlib.crc32(np.array([*ids, 2], dtype="<u4").tobytes())
    assert rows_of(tokenfiles.token_report(docs, TOKENIZER), "doc_id", "n_tokens", "ids_crc32") == [(n, len(x) + 1, crc(x)) for n, x in enumerate(want)]


def test_parts_of_odd_texts_have_the_ids_of_whole_texts(monkeypatch):
    from tokenizers import Tokenizer

    t, rng = Tokenizer.from_file(TOKENIZER), random.Random(1)
    bits = ["a", "b", "Wort", "é", "漢", "12", "7", " ", "  ", "\n", "\n\n", "\t", "\r\n", "'", "'s", "'ll", ".", ",", "!?", "(", "_", "$", "\xa0", "\u2003", "\x85", "\x1c", "<|endoftext|>", "\xad", "🙂", "٣", " '", "|"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + [None, ""]
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    for pieces in (1_000_000, 50):  # the second forgets all the time
        monkeypatch.setattr(tokenfiles, "_PIECES", pieces)
        monkeypatch.setattr(tokenfiles, "_BYTES", 5000)
        encoder = tokenfiles.Encoder(TOKENIZER)
        assert encoder.by_parts and [np.frombuffer(x, dtype=encoder.dtype).tolist() for x in encoder.encode(texts)] == want


def test_a_document_of_several_frames(spark, tmp_path):
    rng = random.Random(4)
    long = " ".join(rng.choice(["alpha", "beta", "gamma,", "delta\n"]) for _ in range(150_000))
    docs = spark.createDataFrame([(1, "before"), (2, long), (3, "after")], "doc_id long, text string").coalesce(1)
    path = tokenfiles.write_token_files(docs, f"file://{tmp_path}/f", TOKENIZER).where("docs = 3 or docs = 1").orderBy("shard").collect()
    encoder = tokenfiles.Encoder(TOKENIZER)
    want = {k: [*np.frombuffer(x, dtype=encoder.dtype).tolist(), 2] for k, x in zip((1, 2, 3), encoder.encode(["before", long, "after"]), strict=True)}
    assert len(want[2]) > 2 * tokenfiles.FRAME
    for r in path:
        reader = tokenfiles.ShardReader(r["path"])
        assert all(reader.document(i).tolist() == want[d] for i, d in enumerate(reader.doc_ids))


@pytest.mark.parametrize("send", [2**23, -1])
def test_mixing_small_sources(spark, monkeypatch, send):
    monkeypatch.setattr(mixing, "LEAST_SLOTS", 64)  # blocks as long as those of a large corpus
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", send)
    sizes = {"a": [1500] * 200, "b": [50] * 6, "c": [100] * 50, "d": [400], "e": [3], "f": [0]}
    rows = [(n, " ".join(["w"] * x), s) for n, (s, x) in enumerate((s, x) for s, xs in sizes.items() for x in xs)]
    small = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    source = {r[0]: r[2] for r in rows}
    taken, target = collections.Counter(), {}
    for r in mixing.mix_report(small).collect():
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert target["b"] == 900 and target["c"] == 15_000 and target["a"] < 300_000
    assert all(abs(taken[s] - t) <= 0.02 * t + 3 for s, t in target.items())
    times = collections.Counter(r.source for r in mixing.mixed_documents(small).collect())
    assert all(abs(times[s] - t / (sum(sizes[s]) / len(sizes[s]))) <= 0.02 * t / (sum(sizes[s]) / len(sizes[s])) + 1 for s, t in target.items() if t)


def test_quality(docs, none):
    want = []
    for r in ROWS:
        t = r[1] or ""
        w = [x for x in SPACE.split(t) if x]
        c = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        rep = len({p for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for p in range(k, k + 3)})
        lines = [x for x in t.split("\n") if SPACE.sub("", x)]
        want.append((r[0], len(w), len(SPACE.sub("", t)), sum(t.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), rep, len(w) < 50 or 100 * rep > 50 * len(w)))
    got = quality.quality_report(docs)
    assert rows_of(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(want, key=repr)
    assert got.where("base_failed and kept").count() == 0
    patterns = collections.Counter(tuple(r[f"vote_{k}"] for k in quality.RULES) for r in got.collect())
    prior, rate = weak.expectation_maximisation(sorted(patterns.items()), len(quality.RULES), prior=0.8, bounds=(0.5, 0.99))
    for r in got.collect():
        p = weak.posterior(tuple(r[f"vote_{k}"] for k in quality.RULES), prior, rate)
        assert r.quality == pytest.approx(p) and r.kept == (not r.base_failed and p >= 0.5)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(quality, "_LOW", 63)  # texts whose places don't fit the low bits
        assert rows_of(quality.quality_report(docs), "doc_id", "n_repeat_words") == sorted(((r[0], r[5]) for r in want), key=repr)
    assert quality.quality_filter(docs).columns == docs.columns and quality.quality_report(none).count() == 0


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    p = language.language_report(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred != 'und'")
    assert p.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, d).select(*want.columns)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())


def test_pipeline(spark):
    import corpus_pipeline as c

    docs, d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "/root/testdata/sf0.001"
    for _, stage in c.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns and 0 < out.count()
        docs = out
    assert c.run(spark, d).count() > 0
