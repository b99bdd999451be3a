"""Conversation structure repair by a persistent audit program.

A conversation's rows are kept, given another role, deleted, or joined by inserted empty rows, at the least cost that leaves roles of the form
`(s?(ua)+)?`. The dynamic program has four states, for what has been put out so far: nothing (E), a system row (S), an open question (U), an answered one (A).
For each row and state it holds the least cost and, as a linked node, the ASCII-least audit of that cost: a node is one edit that hangs below the node of the
edits before it, so prefixes are shared. Nodes have ancestors at distances 1, 2, 4, ... and a rolling hash of the whole prefix: audits of equal cost
are compared by a search for their longest common prefix along equal hashes, and where that prefix isn't the same node the edits themselves are compared. (Of two
audits of equal cost up to one row and state, neither is a prefix of the other, as only insertions could follow and they cost; so the lesser prefix stays the lesser.)

Long conversations: rows are sorted by range, so a conversation of any share of the rows lies in consecutive parts of about SEGMENT rows. A conversation
inside a part is settled there. Of others each part gives, for each state it may be entered in and left in, cost and order of the best audits, and a chain of
parts, a few numbers each, is settled afterwards. Rows then find their edits by their place.

Faults, of which the first counts: blank (only white space), duplicate (role and text seen earlier), truncated (the last character that isn't white space isn't
`.`, `!` or `?`). Costs: Keep 0, Rerole to user or assistant 1, Delete 2 (required for blank and duplicate), Insert 5; a truncated row that stays adds 5.

Defined results: null role and text are one space; rows go by turn (nulls first), then role, the first HEAD characters and the SHA-256 of the text; a row whose role is empty or begins with another letter than s, u, a
can't be kept, only given a role; rows that repeat are duplicates; a null conv_id is a conversation of its own; texts of any length are hashed whole; extra columns are ignored; an empty table gives no
rows. The digest of a repaired conversation is one serial hash, so one task streams over its rows, holding one at a time.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, written

KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
SEGMENT, HEAD = 2**15, 64
#: What an inserted row or a new role makes of each state; what ends each state well, and its cost.
NEXT = {"E": "U", "S": "U", "U": "A", "A": "U"}
END = {"E": (0, ""), "A": (0, ""), "U": (INSERT, "I"), "S": (2 * INSERT, "II")}
STATES = "ESUA"
_PRIME, _BASE = 2**61 - 1, 1_000_003


class Audits:
    """Audits as linked nodes: `up[x]` are the ancestors of x at distances 1, 2, 4, ...; node 0 is the empty audit."""

    def __init__(self, prime: int = _PRIME) -> None:
        self.prime, self.edit, self.depth, self.hash, self.up, self.state = prime, [""], [0], [0], [()], [""]
        self.compared = self.collided = 0

    def add(self, parent: int, edit: str, state: str) -> int:
        x, up, at = len(self.edit), [], parent
        for k in range(self.depth[parent].bit_length() + 1):
            up.append(at)
            if len(self.up[at]) <= k:
                break
            at = self.up[at][k]
        self.edit.append(edit)
        self.state.append(state)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * _BASE + ord(edit)) % self.prime)
        self.up.append(tuple(up))
        return x

    def ancestor(self, x: int, depth: int) -> int:
        while self.depth[x] > depth:
            x = self.up[x][min(len(self.up[x]), (self.depth[x] - depth).bit_length()) - 1]
        return x

    def text(self, x: int) -> str:
        out = []
        while x:
            out.append(self.edit[x])
            x = self.up[x][0]
        return "".join(reversed(out))

    def states(self, x: int, first: str) -> str:
        """The states before the first row and after each edit that isn't an insertion."""
        out = []
        while x:
            if self.edit[x] != "I":
                out.append(self.state[x])
            x = self.up[x][0]
        return first + "".join(reversed(out))

    def less(self, x: int, y: int) -> bool:
        """Whether the audit of x comes before that of y."""
        self.compared += 1
        both = min(self.depth[x], self.depth[y])
        a, b = self.ancestor(x, both), self.ancestor(y, both)
        if a == b:
            return self.depth[x] < self.depth[y]
        if self.hash[a] == self.hash[b]:
            return self._plain(x, y)
        for k in range(len(self.up[a]) - 1, -1, -1):
            if k < len(self.up[a]) and k < len(self.up[b]) and self.hash[self.up[a][k]] != self.hash[self.up[b][k]]:
                a, b = self.up[a][k], self.up[b][k]
        if self.up[a][0] != self.up[b][0] or self.edit[a] == self.edit[b]:  # equal hashes of different nodes
            return self._plain(x, y)
        return self.edit[a] < self.edit[b]

    def _plain(self, x: int, y: int) -> bool:
        self.collided += 1
        return self.text(x) < self.text(y)


class Program:
    """The dynamic program from one state on: `best` has for each state that can be reached (cost, node)."""

    def __init__(self, first: str = "E", prime: int = _PRIME) -> None:
        self.audits, self.best, self.first = Audits(prime), {first: (0, 0)}, first

    def _offer(self, into: dict, state: str, cost: int, parent: int, edit: str) -> None:
        if state not in into or cost < into[state][0]:
            into[state] = (cost, self.audits.add(parent, edit, state))
        elif cost == into[state][0]:
            x = self.audits.add(parent, edit, state)
            if self.audits.less(x, into[state][1]):
                into[state] = (cost, x)

    def row(self, initial: str, fault: str) -> None:
        before = dict(self.best)
        for _ in range(2):  # insertions before the row; three in a row never pay
            for state, (cost, node) in list(before.items()):
                self._offer(before, NEXT[state], cost + INSERT, node, "I")
        after: dict[str, tuple[int, int]] = {}
        stays, extra = fault not in ("blank", "duplicate"), CUT * (fault == "truncated")
        for state, (cost, node) in before.items():
            self._offer(after, state, cost + DELETE, node, "D")
            if stays:
                if initial == "s" and state == "E":
                    self._offer(after, "S", cost + KEEP + extra, node, "K")
                if initial == NEXT[state].lower():
                    self._offer(after, NEXT[state], cost + KEEP + extra, node, "K")
                self._offer(after, NEXT[state], cost + REROLE + extra, node, "R")
        self.best = after

    def order(self) -> dict[str, int]:
        """The ranks of the states' audits in ASCII order."""
        ranked: list[str] = []
        for state, (_, node) in self.best.items():
            at = sum(not self.audits.less(node, self.best[s][1]) for s in ranked)
            ranked.insert(at, state)
        return {s: k for k, s in enumerate(ranked)}

    def end(self) -> tuple[int, str, str]:
        """Cost, state and last insertions of the cheapest whole audit, of these the ASCII-least."""
        out = None
        for state, (cost, node) in sorted(self.best.items()):
            total, tail = cost + END[state][0], node
            for edit in END[state][1]:
                tail = self.audits.add(tail, edit, state)
            if out is None or total < out[0] or total == out[0] and self.audits.less(tail, out[1]):
                out = (total, tail, state)
        return out[0], out[2], END[out[2]][1]


def damaged(conversations: DataFrame) -> DataFrame:
    """The conversations (conv_id, turn, role, text) after the damage that the registered query asks for: by crc32(conv_id:turn) % 20, 0 drops a row, 1 empties its text,
    2 removes its `.!?`, 3 repeats it and 4 makes it a user's."""
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"), (F.crc32(name) % 20).alias("_c")).where("_c != 0")
    text = F.when(F.col("_c") == 1, "").when(F.col("_c") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": text, "role": F.when(F.col("_c") == 4, "user").otherwise(F.col("role"))})
    return rows.withColumn("_n", F.explode(F.when(F.col("_c") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_c", "_n")


def with_faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, initial, fault, at): rows of conversations in order, written; `at` counts up along the order, by one inside a part."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"))
    key = F.sha2(F.concat(F.char_length("role"), F.lit(":"), "role", "text"), 256)
    rows = written(rows.withColumns({"key": key, "id": F.monotonically_increasing_id()}), "rows")
    place = F.struct(F.col("turn").isNotNull(), "turn", "id")
    first = rows.groupBy("conv_id", "key").agg(F.min(place)["id"].alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("conv_id").alias("_conv"), F.col("key").alias("_key"), "first")
    rows = rows.join(first.hint("merge"), F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("key") == F.col("_key")), "left")
    last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    fault = F.when(~F.col("text").rlike(f"[^{SPACE[1:]}"), "blank").when(F.col("id") != F.col("first"), "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    rows = rows.select("conv_id", "turn", "role", "text", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), F.substring("text", 1, HEAD).alias("head"), "key", "id")
    spark = rows.sparkSession
    total = rows.count()
    n = max(1, math.ceil(total / SEGMENT), min(spark.sparkContext.defaultParallelism, math.ceil(total / 64)))
    order = ["conv_id", "turn", "role", "head", "key", "id"]
    return written(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).drop("head", "key", "id"), "ordered")


_OUT = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("whole", pa.bool_()), ("enter", pa.string()), ("leave", pa.string()), ("cost", pa.int64()), ("place", pa.int32()), ("audit", pa.string()), ("states", pa.string()), ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64())])
_FIELDS = "conv_id long, part long, at long, n long, whole boolean, enter string, leave string, cost long, place int, audit string, states string, first string, last string, illegal long"
LEGAL = ("su", "ua", "au")


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, at, conv_id, initial, fault), sorted: for a conversation inside a part its audit; for one at an end of a part the best audit for each way through."""

    def of(key: tuple, rows: list[tuple[int, str, str]], at_start: bool, at_end: bool) -> Iterator[dict]:
        initials = [r[1] for r in rows]
        common = {"conv_id": key[1], "part": key[0], "at": rows[0][0], "n": len(rows), "first": initials[0], "last": initials[-1], "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))}
        for enter in STATES if at_start else "E":
            program = Program(enter)
            for _, initial, fault in rows:
                program.row(initial, fault)
            if not at_start and not at_end:
                cost, leave, tail = program.end()
                node = program.best[leave][1]
                yield common | {"whole": True, "enter": "E", "leave": leave, "cost": cost, "place": 0, "audit": program.audits.text(node) + tail, "states": program.audits.states(node, "E")}
                return
            order = program.order()
            for leave, (cost, node) in program.best.items():
                yield common | {"whole": False, "enter": enter, "leave": leave, "cost": cost, "place": order[leave], "audit": program.audits.text(node), "states": program.audits.states(node, enter)}

    held, key, start, out = [], None, True, []
    for batch in batches:
        for part, at, conv, initial, fault in zip(*(batch.column(k).to_pylist() for k in ("part", "at", "conv_id", "initial", "fault")), strict=True):
            if (part, conv) != key:
                if held:
                    out += of(key, held, start, part != key[0])
                start = key is None or part != key[0]
                held, key = [], (part, conv)
            held.append((at, initial, fault))
        if len(out) > 1000:
            yield pa.RecordBatch.from_pylist(out, _OUT)
            out = []
    if held:
        out += of(key, held, start, True)
    if out:
        yield pa.RecordBatch.from_pylist(out, _OUT)


def _chained(rows: pd.DataFrame) -> pd.DataFrame:
    """The way through the parts of one conversation: part, enter, leave, whole cost, last insertions, illegal pairs of the conversation. At most 16 rows of numbers a part come in."""
    by = {p: of for p, of in rows.sort_values("part").groupby("part", sort=True)}
    parts = list(by)
    ahead = {s: (cost, tail, None) for s, (cost, tail) in END.items()}
    steps = []
    for p in reversed(parts):
        here = {}
        for enter, of in by[p].groupby("enter"):
            ways = [(int(r.cost) + ahead[r.leave][0], int(r.place), r.leave) for r in of.itertuples() if r.leave in ahead]
            cost, _, leave = min(ways)
            here[enter] = (cost, ahead[leave][1], leave)
        steps.append((p, here))
        ahead = here
    state, out = "E", []
    cost, tail, _ = ahead["E"]
    for p, here in reversed(steps):
        leave = here[state][2]
        out.append((p, state, leave))
        state = leave
    ends = [by[p].iloc[0] for p in parts]
    illegal = sum(int(e.illegal) for e in ends) + sum(a["last"] + b["first"] not in LEGAL for a, b in zip(ends, ends[1:], strict=False))
    return pd.DataFrame([(rows.conv_id.iloc[0], p, a, b, cost, tail, illegal) for p, a, b in out], columns=["conv_id", "part", "enter", "leave", "total", "tail", "pairs"])


def audits(ordered: DataFrame) -> DataFrame:
    """(conv_id, part, at, n, audit, states, cost, tail, illegal), written: the edits of each stretch of rows; cost, tail (insertions after the last row) and illegal pairs are those of the conversation."""
    slim = ordered.select(F.shiftright("at", 33).alias("part"), "at", "conv_id", "initial", "fault")
    parts = ordered.select(F.shiftright("at", 33).alias("part")).agg(F.max("part")).first()[0]
    found = written(slim.repartition((parts or 0) + 1, "part").sortWithinPartitions("part", "at").mapInArrow(_segments, _FIELDS), "segments")
    tail = F.regexp_extract("audit", "I*$", 0)
    whole = found.where("whole").select("conv_id", "part", "at", "n", F.expr("left(audit, char_length(audit) - char_length(regexp_extract(audit, 'I*$', 0)))").alias("audit"), "states", "cost", tail.alias("tail"), "illegal")
    opened = found.where("not whole")
    chain = opened.drop("audit", "states", "at", "whole").groupBy("conv_id").applyInPandas(_chained, "conv_id long, part long, enter string, leave string, total long, tail string, pairs long")
    chain = written(chain, "chains").select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), F.col("enter").alias("_enter"), F.col("leave").alias("_leave"), "total", "tail", "pairs")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")) & (F.col("enter") == F.col("_enter")) & (F.col("leave") == F.col("_leave"))
    taken = opened.join(chain.hint("merge"), same).select("conv_id", "part", "at", "n", "audit", "states", F.col("total").alias("cost"), "tail", F.col("pairs").alias("illegal"))
    return written(whole.unionByName(taken), "audits")


def _role(state: str) -> str:
    return f"if({state} = 'U', 'assistant', 'user')"


def repaired(ordered: DataFrame, edits: DataFrame) -> DataFrame:
    """The rows after repair: conv_id, at, sub (their order), turn (null of inserted rows), role, text, edit (K, R or I)."""
    steps = edits.select("at", "states", F.posexplode(F.expr("regexp_extract_all(audit, 'I*[DKR]', 0)")).alias("k", "edit"))
    steps = steps.select((F.col("at") + F.col("k")).alias("_at"), "edit", F.expr("substring(states, k + 1, 1)").alias("state"))
    rows = ordered.join(steps.hint("merge"), F.col("at") == F.col("_at"))
    # with m insertions before it, a row's own place in turn-taking is m steps on
    step = "if((i + if(state = 'U', 1, 0)) % 2 = 1, 'assistant', 'user')"
    inserted = f"transform(sequence(0, char_length(edit) - 2), i -> named_struct('sub', i, 'turn', cast(null as bigint), 'role', {step}, 'text', '', 'edit', 'I'))"
    own = step.replace("i +", "char_length(edit) - 1 +")
    last = f"named_struct('sub', char_length(edit) - 1, 'turn', turn, 'role', if(right(edit, 1) = 'R', {own}, role), 'text', text, 'edit', right(edit, 1))"
    every = f"filter(concat(if(char_length(edit) > 1, {inserted}, array()), array({last})), x -> x.edit != 'D')"
    rows = rows.select("conv_id", "at", F.explode(F.expr(every)).alias("r")).select("conv_id", "at", "r.*")
    ends = edits.groupBy("conv_id").agg(F.max(F.struct("part", (F.col("at") + F.col("n")).alias("at"), F.right("states", F.lit(1)).alias("state"), "tail")).alias("e")).select("conv_id", "e.*").where("tail != ''")
    more = f"transform(sequence(0, char_length(tail) - 1), i -> named_struct('sub', i, 'turn', cast(null as bigint), 'role', {step}, 'text', '', 'edit', 'I'))"
    return rows.unionByName(ends.select("conv_id", "at", F.explode(F.expr(more)).alias("r")).select("conv_id", "at", "r.*"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's `role:text` lines, from rows sorted by conversation and order; one row is held at a time."""
    key, line, out = (), None, []
    for batch in batches:
        for conv, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text")), strict=True):
            if key != (conv,):
                if line:
                    out.append({"conv_id": key[0], "repaired_sha256": line.hexdigest()})
                key, line = (conv,), hashlib.sha256()
            else:
                line.update(b"\n")
            line.update(f"{role}:{text}".encode())
        if len(out) > 10_000:
            yield pa.RecordBatch.from_pylist(out, pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())]))
            out = []
    if line:
        out.append({"conv_id": key[0], "repaired_sha256": line.hexdigest()})
    if out:
        yield pa.RecordBatch.from_pylist(out, pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())]))


def repair(conversations: DataFrame) -> DataFrame:
    """The conversations repaired: conv_id, at, sub, turn, role, text, edit; sorting by (at, sub) gives each its order."""
    ordered = with_faults(conversations)
    return repaired(ordered, audits(ordered))


def repair_report(conversations: DataFrame, damage: bool = True) -> DataFrame:
    """One row for each conversation of the input: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    ordered = with_faults(damaged(conversations) if damage else conversations)
    edits = audits(ordered)
    counts = [F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")]
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    by_turn = ordered.groupBy("conv_id", "turn").agg(*counts)
    facts = by_turn.groupBy("conv_id").agg(gaps.alias("gaps"), *(F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")))
    whole = edits.groupBy("conv_id").agg(F.first("cost").alias("cost"), F.first("illegal").alias("illegal"), F.first("tail").alias("tail"), F.sort_array(F.collect_list(F.struct("part", "audit"))).alias("a"))
    whole = whole.select("conv_id", "cost", "illegal", F.concat(F.array_join(F.col("a.audit"), ""), "tail").alias("audit"))
    parts = ordered.sparkSession.sparkContext.defaultParallelism
    dealt = repaired(ordered, edits).select("conv_id", "at", "sub", "role", "text").repartition(max(parts, edits.select("part").distinct().count()), "conv_id")
    digests = dealt.sortWithinPartitions("conv_id", "at", "sub").mapInArrow(_digests, "conv_id long, repaired_sha256 string")
    out = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    for k, part in enumerate((facts, whole, digests)):
        named = part.withColumnRenamed("conv_id", f"_conv{k}")
        out = out.join(named.hint("merge"), F.col("conv_id").eqNullSafe(F.col(f"_conv{k}")), "left").drop(f"_conv{k}")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
