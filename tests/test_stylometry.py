"""Inner products of n-gram counts, whole and in slices, against counting by hand."""

from collections import Counter

import pytest

from tessera.operators import stylometry as sty

CELLS = [(1, 0, "a", "ab abc Ab"), (1, 0, "b", "abcd x"), (1, 1, "a", "abc abc"), (1, 2, "b", "zz abcd"), (2, 0, "a", "ab"), (2, 1, "c", ""), (2, 1, "d", None)]


@pytest.mark.parametrize("size", [50_000, 2])
def test_products(spark, monkeypatch, size):
    monkeypatch.setattr(sty, "WORDS_A_SLICE", size)
    monkeypatch.setattr(sty, "WORDS_A_PART", 4)
    tf = {c[:3]: Counter(g for w in (c[3] or "").lower().split() for g in sty.char_ngrams(f" {w} ", 3, 4)) for c in CELLS}
    want = Counter()
    for a in tf:
        for b in tf:
            for g in tf[a] if a[0] == b[0] else ():
                if g in tf[b]:
                    want[*a, *b[1:], tuple(sorted(c[1] for c in tf if c[0] == a[0] and g in tf[c]))] += tf[a][g] * tf[b][g]
    cells = spark.createDataFrame(CELLS, "doc long, question int, participant string, text string")
    assert {(r.doc, r.question, r.participant, r.qb, r.pb, tuple(r["at"])): r.t for r in sty.products(cells, 3, 4).collect()} == want
