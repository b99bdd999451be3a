"""Repaired conversations against recursion over all edits, and that against enumeration."""

import functools
import hashlib
import itertools
import random
import re
import sys
import zlib

import pytest

from tessera.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, at string, audit int"
BLANK = " \t\n\x0b\x0c\r"


def damage(rows):
    for conv, turn, role, text in rows:
        c = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if c:
            text = "" if c == 1 else re.sub("[.!?]", "", text) if c == 2 else text
            yield from [(conv, turn, "user" if c == 4 else role, text)] * (2 if c == 3 else 1)


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        out.append("blank" if not text.strip(BLANK) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(BLANK)[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, wrong):
    """(cost, audit, repaired rows) by recursion over suffixes: strings are compared whole."""
    sys.setrecursionlimit(50_000)

    @functools.cache
    def ahead(i, state, room):
        ways = []
        if room:
            cost, audit, _ = ahead(i, repair.NEXT[state], room - 1)
            ways.append((cost + 5, "I" + audit, ("user" if repair.NEXT[state] == "U" else "assistant", repair.NEXT[state], 0)))
        if i == len(rows):
            return min([*ways, (0, "", None)] if state in "EA" else ways or [(10**9, "", None)], key=lambda w: w[:2])
        role, bad = rows[i][0], wrong[i]
        cost, audit, _ = ahead(i + 1, state, 2)
        ways.append((cost + 2, "D" + audit, ("", state, 1)))
        if bad not in ("blank", "duplicate"):
            more = 5 if bad == "truncated" else 0
            for to, initial in (("S", "s"), (repair.NEXT[state], repair.NEXT[state].lower())):
                if role[:1] == initial and (to != "S" or state == "E"):
                    cost, audit, _ = ahead(i + 1, to, 2)
                    ways.append((cost + more, "K" + audit, (role, to, 1)))
            cost, audit, _ = ahead(i + 1, repair.NEXT[state], 2)
            ways.append((cost + 1 + more, "R" + audit, ("user" if repair.NEXT[state] == "U" else "assistant", repair.NEXT[state], 1)))
        return min(ways, key=lambda w: w[:2])

    for i in range(len(rows), -1, -1):
        for state, room in itertools.product("ESUA", (0, 1, 2)):
            ahead(i, state, room)
    cost, audit, way = ahead(0, "E", 2)
    i, state, room, out = 0, "E", 2, []
    while way:
        role, state, step = way
        if role:
            out.append((role, rows[i][1] if step else ""))
        room = 2 if step else room - 1
        i += step
        way = ahead(i, state, room)[2]
    return cost, audit, out


def report(rows, hurt=True):
    after = list(damage(rows)) if hurt else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    out = []
    for conv in {r[0] for r in rows}:
        key = lambda r: (r[1] is not None, r[1] or 0, r[2], r[3][:64], hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest())
        own = sorted((r for r in after if r[0] == conv), key=key)
        turns = {r[1] for r in own} - {None}
        said = [(r[2], r[3]) for r in own]
        wrong = faults(said)
        cost, audit, done = cheapest(said, wrong)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:], strict=False))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest()
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(wrong.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha))
    return sorted(out, key=repr)


def conversations(seed=1):
    rng, rows = random.Random(seed), []
    text = lambda: rng.choice(["Yes.", "No", "What? ", "", " \n", "Ünd so!", "a" * 90 + rng.choice("xyz"), "ok.", f"{rng.random()}."])
    role = lambda: rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "User", "ux"])
    for conv in range(150):
        for k in range(rng.randint(1, 14)):
            rows.append((conv, k, ("user", "assistant")[k % 2] if conv % 3 == 0 else role(), f"Said {k}." if conv % 2 else text()))
    rows += [(None, None, None, None), (None, 1, "user", "x."), (None, None, "assistant", "y."), (900, None, "user", "."), (901, 5, "user", None), (901, 5, "user", "a."), (901, 5, "assistant", "b."), (901, 5, "assistant", "b."), (902, -3, "system", "s!")]
    rows += [(903, k // 3, role(), text()) for k in range(700)] + [(904, k, ("user", "assistant")[k % 2], f"{k}.") for k in range(400)] + [(905, 7, "user", "long. " * 200_000)]
    return rows + rows[:3]


def data(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(4)


@pytest.mark.parametrize("segment", [2**15, 50])
def test_report_is_that_of_recursion(spark, monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rows = conversations()
    got = repair.repair_report(data(spark, rows))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == report(rows)
    assert sorted(map(tuple, repair.repair_report(data(spark, rows), damage=False).collect()), key=repr) == report(rows, False)


def test_repaired_rows_have_legal_roles(spark):
    rows = conversations(2)
    said = {}
    for r in sorted(repair.repair(data(spark, rows)).collect(), key=lambda r: (r.at, r.sub)):
        said.setdefault(r.conv_id, []).append(r)
    for of in said.values():
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in of)) and all((r.edit == "I") == (r.turn is None and r.text == "") or r.edit != "I" for r in of)
    assert repair.repair_report(data(spark, []).where("false")).count() == 0


def test_recursion_matches_enumeration():
    rng = random.Random(3)
    for _ in range(60):
        rows = [(rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b", "c.", ""])) for _ in range(rng.randint(0, 3))]
        wrong, best = faults(rows), None
        gaps = ["", "u", "a", "ua", "au"]
        for edits in itertools.product(*[["D", *(["K", "u", "a"] if f not in ("blank", "duplicate") else [])] for f in wrong]):
            for between in itertools.product(gaps, repeat=len(rows) + 1):
                cost, audit, roles = 0, "", ""
                for k, gap in enumerate(between):
                    cost, audit, roles = cost + 5 * len(gap), audit + "I" * len(gap), roles + gap
                    if k < len(rows):
                        e = edits[k]
                        cost += {"D": 2, "K": 0, "u": 1, "a": 1}[e] + 5 * (e != "D" and wrong[k] == "truncated")
                        audit += e if e in "DK" else "R"
                        roles += "" if e == "D" else rows[k][0][0] if e == "K" else e
                if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
        assert cheapest(rows, wrong)[:2] == best


@pytest.mark.parametrize("prime", [2**61 - 1, 3])
def test_audits_compare_like_their_texts_even_if_hashes_collide(prime):
    rng, a = random.Random(5), repair.Audits(prime)
    nodes, texts = [0], {0: ""}
    for _ in range(600):
        parent, edit = rng.choice(nodes[-20:] + nodes[:3]), rng.choice("DIKR")
        x = a.add(parent, edit, "E")
        nodes.append(x)
        texts[x] = texts[parent] + edit
    for x, y in ((rng.choice(nodes), rng.choice(nodes)) for _ in range(4000)):
        assert a.text(x) == texts[x] and a.less(x, y) == (texts[x] < texts[y])
        assert all(a.text(a.ancestor(x, d)) == texts[x][:d] for d in (0, len(texts[x]) // 2))
    assert (a.collided > 1000) == (prime == 3)


def test_program_with_colliding_hashes_gives_the_same_audit():
    rng = random.Random(6)
    for _ in range(100):
        rows = [(rng.choice("usat"), rng.choice(["", "", "truncated", "blank"])) for _ in range(40)]
        ends = []
        for prime in (2**61 - 1, 7):
            p = repair.Program(prime=prime)
            for r in rows:
                p.row(*r)
            cost, leave, tail = p.end()
            ends.append((cost, p.audits.text(p.best[leave][1]) + tail))
        assert ends[0] == ends[1] == cheapest([(r[0], "") for r in rows], [r[1] for r in rows])[:2]
