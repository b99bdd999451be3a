"""Hashes of long words, and rows that repeat a doc_id with other texts."""

import random

import numpy as np
import pytest

from tessera.llm import minhash, pii, substring, wordhash


def hashes(words):
    raw = np.frombuffer(b" ".join(words), dtype=np.uint8)
    starts, ends, _ = wordhash.spans(raw, np.array([0, len(raw)]))
    return wordhash.word_hashes(raw, starts, ends, wordhash.TABLE, wordhash.SECOND)


def swapped(n, letters, rng=None):
    """A word of n letters with `letters` at places 256 apart."""
    x = bytearray(b"k" * n)
    for k, c in enumerate(letters):
        if 10 + 256 * k < n:
            x[10 + 256 * k] = ord(c)
    return bytes(x)


@pytest.mark.parametrize("n", [300, 600, 1024, 5000])
def test_exchanges_between_blocks_change_the_hash(n):
    words = sorted({swapped(n, x) for x in ("abba", "baab", "aabb", "bbaa", "abab", "baba")})
    for h in hashes(words):
        assert len(set(h.tolist())) == len(words)


def test_a_word_hashes_alike_wherever_it_stands():
    words = [b"a" * k for k in range(1, 1100)]
    both = hashes(words)
    assert all(len(set(h.tolist())) == len(words) for h in both) and not set(both[0].tolist()) & set(both[1].tolist())
    for k in (1, 255, 256, 257, 511, 512, 513):
        got = hashes([b"x" * 700, words[k - 1], b"z", words[k - 1]])
        assert all(g[1] == g[3] == h[k - 1] for g, h in zip(got, both, strict=True))


def test_long_words_that_differ_are_neither_repeats_nor_near_copies(spark):
    a, b = ([swapped(1024, x).decode() + str(k) for k in range(35)] for x in ("abba", "baab"))
    docs = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "doc_id long, text string")
    assert [r.n_removed for r in substring.repeat_report(docs).collect()] == [0, 0]
    assert {r.component_id for r in minhash.near_groups(docs).collect()} == {1, 2}
    twice = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(a))], "doc_id long, text string")
    assert [r.n_removed for r in substring.repeat_report(twice).collect()] == [35, 35] and {r.component_id for r in minhash.near_groups(twice).collect()} == {1}


def test_redaction_of_a_doc_id_with_several_texts(spark):
    rows = [(1, "a@b.ee x", 1), (1, "zz q@r.st and 10.0.0.1", 2), (1, "clean", 3), (None, "a@b.ee x", 4), (1, None, 5), (1, "a@b.ee x", 6)]
    out = pii.redact(spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)).collect()
    assert {r.n: r.text for r in out} == {1: "<email> x", 2: "zz <email> and <ip>", 3: "clean", 4: "<email> x", 5: None, 6: "<email> x"} and len(out) == 6


def test_added_spans_have_precision_and_recall(spark):
    """Planted secrets and phone numbers among plain numbers, dates and identifiers."""
    rng = random.Random(6)
    text = lambda k, alphabet: "".join(rng.choice(alphabet) for _ in range(k))
    rows, want = [], 0
    for n in range(600):
        kind, words = n % 6, " ".join(text(rng.randint(2, 8), "abcdefghij") for _ in range(12))
        if kind == 0:
            hit = f'api_key = "{text(40, "0123456789abcdef")}"'
        elif kind == 1:
            hit = f"phone: ({text(3, '23456789')}) {text(3, '23456789')}-{text(4, '0123456789')}"
        else:
            hit = [f"in {rng.randint(1000, 9999)}-10-{rng.randint(10, 28)}", f"of {rng.randint(10**6, 10**8)} units", f"about {rng.randint(1, 9)}.{rng.randint(100, 999)}.{rng.randint(100, 999)} people", "mail x@y.org"][kind - 2]
        want += kind < 2
        rows.append((n, f"{words} {hit} {words}"))
    got = {r.doc_id: r.n_other for r in pii.span_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    right = sum(got[n] > 0 for n in got if n % 6 < 2)
    wrong = sum(got[n] > 0 for n in got if n % 6 >= 2)
    assert right / want >= 0.95 and right / max(1, right + wrong) >= 0.95


def test_columns_that_clash_with_the_results_names(spark):
    docs = spark.createDataFrame([(1, "a b", 7, 8)], "doc_id long, text string, n_words long, N_removed long")
    out = substring.remove_repeats(docs)
    assert out.columns == ["doc_id", "text", "n_words", "n_removed"] and out.first() == (1, "a b", 2, 0)


def test_near_copies_of_an_id_with_several_texts(spark):
    rng = random.Random(3)
    say = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    a, b = say(120), say(120)
    docs = spark.createDataFrame([(1, a), (1, b), (2, b + " tail"), (3, say(80)), (1, a)], "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_groups(docs).collect())
    assert got == [(1, 116, 1), (1, 116, 1), (1, 116, 1), (2, 117, 1), (3, 76, 3)]
