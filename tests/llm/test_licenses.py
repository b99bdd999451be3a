"""License scans against regular expressions over words."""

import random
import re

import pytest

from tessera.llm import licenses

SPLIT = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {k: k + 32 for k in range(65, 91)}
SMALL = {"x": ["aa bb [[ cc [[ dd ]] ]] {{1-2}} ee"], "y": ["aa bb cc", "bb cc {{0-3}} aa"], "z": ["ee ee [[ ff ]] ee"]}


def words(text):
    return [w for w in SPLIT.split((text or "").translate(LOW)) if w]


def brute(text, phrases, templates):
    w = words(text)
    base = sorted((i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    line = " " + "".join(f"{x} " for x in w)
    method = {label for label, of in templates.items() for m in of if re.search(" " + licenses.pattern(m), line)}
    labels = {label for _, label in base}
    at = [i for i, _ in base]
    return (len(w), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | method)), 1.0 if method else 0.5 if base else 0.0)


def texts():
    rng = random.Random(4)
    out = [" ".join(rng.choice(["aa", "bb", "cc", "dd", "ee", "ff", "CC", "é", "aa."]) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    full = {label: re.sub(r"\{\{\d+-\d+\}\}", "Some Holder", m).replace("[[ ", "").replace("]] ", "").replace(" ]]", "") for label, of in licenses.TEMPLATES.items() for m in of[-1:]}
    for label, t in full.items():
        out += [t, f"before {t.upper()} after, {t}", t.replace(" the ", " a ", 1), "\n".join(t.split()), t[: len(t) // 2], label]
    out += [re.sub(r"\[\[.*?\]\] ", "", m).replace("{{1-12}}", "them").replace("{{1-2}}", "4.0") for of in licenses.TEMPLATES.values() for m in of]
    out += [None, "", " \n", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.", "GNU General Public License, version 3. GNU General Public License", "Released under the MIT License.", "mit license mit license", "cc", "by", "émit license", "MIT LICENSE\x00cc-by"]
    return out + ["word " * 200_000 + "Apache License " + "x" * 5_000_000 + " cc by"]


ROWS = [(n if n % 50 else 7, t, "clash", 1) for n, t in enumerate(texts())]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, Labels string, n_words int").repartition(3).cache()


@pytest.mark.parametrize("templates", [SMALL, licenses.TEMPLATES])
def test_report_is_that_of_regular_expressions(docs, templates):
    phrases = licenses.PHRASES | {"aa bb": "ab", "bb bb": "b"}
    got = licenses.license_report(docs, phrases, templates)
    assert got.columns == ["doc_id", *licenses.COLUMNS]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((r[0], *brute(r[1], phrases, templates)) for r in ROWS), key=repr)


def test_matches_carry_their_wording(docs, spark):
    one = spark.createDataFrame([(1, "A. Licensed under the\nApache License, Version 2.0; and cc-by")], "doc_id long, text string")
    got = {tuple(r) for r in licenses.license_matches(one).collect()}
    assert got == {(1, False, "apache", 4, 2, "Apache License"), (1, True, "apache-2.0", 1, 8, "Licensed under the\nApache License, Version 2.0"), (1, False, "cc-by", 10, 2, "cc-by")}
    out = licenses.with_licenses(docs)
    assert out.columns == ["doc_id", "text", "n_words", "base_labels", "labels", "score"] and out.count() == len(ROWS)
    assert licenses.license_report(docs.where("false")).count() == 0


def test_longest_match_and_bad_templates():
    a = licenses.Automaton("aa bb [[ cc ]] {{0-2}}")
    assert a.longest(["aa", "bb", "cc", None, None, None]) == 5 and a.longest(["aa", "bb"]) == 2 and a.longest(["aa", "cc"]) == 0
    for bad in ("aa", "[[ aa ]] bb cc", "aa bb [[ cc", "aa bb ]]", "aa bb {{3-2}}", "aa bb C"):
        with pytest.raises(ValueError, match="."):
            licenses.parse(bad)
