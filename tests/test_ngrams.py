"""The most frequent n-grams by their hashes, also where hashes clash."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import lexical as lx

TEXTS = ["a b c d e a b c d", "a b c d e f", "b c d e x y", "q r s t q r s t", "e f g h", "E F g h", None, "a b"]


@pytest.mark.parametrize("few", [10_000, 0])
@pytest.mark.parametrize("top", [1, 3, 25])
def test_clashing_hashes(spark, monkeypatch, top, few):
    monkeypatch.setattr(lx, "_hash", lambda c: F.length(F.regexp_replace(c, "[a-d]", "")).cast("long"))
    monkeypatch.setattr(lx, "FEW", few)
    words = [(t or "").lower().split() for t in TEXTS]
    n = Counter(" ".join(w[i : i + 4]) for w in words for i in range(len(w) - 3))
    want = sorted(((k, c) for k, c in n.items() if c >= 2), key=lambda x: (-x[1], x[0]))[:top]
    assert [tuple(r) for r in lx.recurring_ngrams(spark.createDataFrame([(t,) for t in TEXTS], "text string"), 4, 2, top).collect()] == want
