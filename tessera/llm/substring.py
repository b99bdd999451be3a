"""Substring dedup by prefix-partitioned suffix trees over words.

A window of `WINDOW` words is the first WINDOW words of a suffix; two suffixes that share them hang below one internal node of that
depth in the suffix tree of the corpus. The tree is never built whole:

1. Dead suffixes go early. Each window has an anchor: the least-hashed PREFIX-word sequence in it (the leftmost of ties). Equal
   windows have equal anchors, so windows whose anchor occurs once in the corpus can't repeat. Consecutive windows with
   the same anchor are one run. A run whose whole text occurs more than once consists of repeats: it's settled, and one
   copy of it goes on to meet the runs that overlap it only in part.
2. The other suffixes are split by prefixes of two lengths. The first prefix is the anchor; while a prefix group has no more than
   GROUP runs, it's small enough for a task. The suffixes of larger groups are split by a prefix as long as the window, at
   which depth a group needs no tree, only its count.
3. A task takes many small groups and builds their subtrees level by level (depths 8, 16, 32, then WINDOW) by prefix doubling: at
   each level a suffix alone in its node is a leaf and drops out. Nodes with two suffixes at depth WINDOW lie on maximal repeats.
4. Covered words are deleted from the texts.

Windows are judged on the input. Defined results: null and empty texts have no words; texts shorter than WINDOW lose nothing;
rows that repeat a doc_id and its text count as further occurrences, so they lose their windows like any copy; extra columns pass through `remove_repeats`; an empty table
gives no rows; very long texts are worked whole, with a few numpy arrays of their bytes. Sequences are pruned by 64-bit hashes and called equal only if a second hash
agrees, which rests on hashes of words from another table: 128 bits for whole runs, and at least 96 below (64 and 32 of each word). Words of any length are hashed whole, their
blocks of 256 bytes chained; a clashing column `n_words` or `n_removed` of the input is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, written
from .wordhash import LENGTH, SECOND, STEP, TABLE, grams, mixed, slices, spans, word_hashes

WINDOW, PREFIX, GROUP = 35, 8, 2000
_U = np.uint64


def _runs(window: int):
    """Rows (doc_id, rid, anchor, run, run2, s, n): n windows from word s on share an anchor; run and run2 hash all their words."""
    width = window - PREFIX + 1

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, off in slices(batch.column(2)):
                starts, ends, first = spans(raw, off)
                h, h2 = word_hashes(raw, starts, ends, TABLE, SECOND)
                docs, parts = [], []
                for i in range(hi - lo):
                    a, b = first[i], first[i + 1]
                    if b - a < window:
                        continue
                    w = h[a:b]
                    g = grams(w, PREFIX)
                    at = np.arange(len(w) - window + 1) + sliding_window_view(g, width).argmin(axis=1)
                    new = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                    n = np.diff(np.append(new, len(at)))
                    # a run's words are s .. s + n + window - 2; their hash: sums of word hash times a power of an odd number
                    words = n + window - 1
                    shape, run = mixed((at[new] - new).astype(_U) * LENGTH + words.astype(_U)), []
                    for base, own in zip(BASES, (w, h2[a:b]), strict=True):
                        total = np.append(_U(0), np.cumsum(own * _powers(base, len(w))[: len(w)]))
                        run.append(mixed((total[new + words] - total[new]) * _powers(-base, len(w))[new] + shape))
                    docs.append(np.full(len(new), lo + i))
                    parts.append((g[at[new]], *run, new, n))
                if docs:
                    g, run, run2, s, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                    who = pa.array(np.concatenate(docs))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(who), batch.column(1).take(who), pa.array(g.view(np.int64)), pa.array(run.view(np.int64)), pa.array(run2.view(np.int64)), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32))], ["doc_id", "rid", "anchor", "run", "run2", "s", "n"]
                    )

    return of


#: Odd multipliers of the two hashes of a run.
BASES = (int(LENGTH), int(STEP[40]))
_cache: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """Powers 0 .. n of an odd number, or for a negative one of its absolute value's inverse, modulo 2**64."""
    if len(_cache.get(base, ())) <= n:
        more = np.full(2 * n + 1, _U(base if base > 0 else pow(-base, -1, 2**64)))
        more[0] = _U(1)
        _cache[base] = np.cumprod(more)
    return _cache[base]


def _texts_of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (doc_id, rid, text, runs) rows to rows (doc_id, rid, anchor, big, s, n, words, again): word hashes of each run, packed, and 32 bits of each second one."""
    for batch in batches:
        doc, rid, runs = batch.column("doc_id"), batch.column("rid"), batch.column("runs")
        for lo, hi, raw, off in slices(batch.column("text")):
            starts, ends, first = spans(raw, off)
            h, h2 = word_hashes(raw, starts, ends, TABLE, SECOND)
            h2 = (h2 >> _U(32)).astype(np.uint32)
            who, rows = [], []
            for i in range(lo, hi):
                a = first[i - lo]
                for r in runs[i].as_py():
                    who.append(i)
                    lo_w, hi_w = a + r["s"], a + r["s"] + r["n"] + r["w"] - 1
                    rows.append((r["anchor"], r["big"], r["s"], r["n"], h[lo_w:hi_w].tobytes(), h2[lo_w:hi_w].tobytes()))
            if rows:
                anchor, big, s, n, packed, again = zip(*rows, strict=True)
                at = pa.array(who)
                yield pa.RecordBatch.from_arrays([doc.take(at), rid.take(at), pa.array(anchor, pa.int64()), pa.array(big, pa.bool_()), pa.array(s, pa.int32()), pa.array(n, pa.int32()), pa.array(packed, pa.binary()), pa.array(again, pa.binary())], ["doc_id", "rid", "anchor", "big", "s", "n", "words", "again"])


def _alone(node: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Of the live suffixes those that share their node."""
    _, back, count = np.unique(node[live], return_inverse=True, return_counts=True)
    return live[count[back] > 1]


def subtree_repeats(words: np.ndarray, second: np.ndarray, starts: np.ndarray, keys: np.ndarray, window: int) -> np.ndarray:
    """Of the suffixes at `starts`, those whose first `window` words are also those of another suffix with the same key: nodes are
    doubled in depth until they are `window` deep, and suffixes alone in a node drop out. What is left at that depth is grouped again by the `second` hashes of the words."""
    depth, node, live = PREFIX, grams(words, PREFIX), np.arange(len(starts))
    live = _alone(node[starts] ^ keys, live)
    while depth < window and len(live):
        step = min(depth, window - depth)
        deeper = np.zeros_like(node)
        n = len(node) - step
        deeper[:n] = mixed(node[:n] + mixed(node[step:] + LENGTH))
        node, depth = deeper, depth + step
        live = _alone(node[starts] ^ keys, live)
    if not len(live):
        return live
    again = grams(mixed(second.astype(_U) + LENGTH), window)
    _, one = np.unique(node[starts] ^ keys, return_inverse=True)
    _, two = np.unique(again[starts], return_inverse=True)
    return _alone(one.astype(_U) << _U(32) | two.astype(_U), live)


def _trees(window: int):
    """Groups arrive sorted by anchor; whole groups are gathered up to about 200,000 words and their subtrees built together."""

    def flush(rows: list[tuple]) -> pa.RecordBatch | None:
        doc, rid, anchor, s, n, packed, again = zip(*rows, strict=True)
        words, second = np.frombuffer(b"".join(packed), dtype=_U), np.frombuffer(b"".join(again), dtype=np.uint32)
        n, size = np.array(n), np.array([len(x) // 8 for x in packed])
        base = np.concatenate([[0], np.cumsum(size)[:-1]])
        run = np.repeat(np.arange(len(n)), n)
        inside = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
        live = subtree_repeats(words, second, base[run] + inside, mixed(np.array(anchor, dtype=np.int64).view(_U))[run], window)
        if not len(live):
            return None
        at = run[live]
        return pa.RecordBatch.from_arrays(
            [pa.array([doc[i] for i in at], pa.int64()), pa.array([rid[i] for i in at], pa.int64()), pa.array((np.array(s)[at] + inside[live]).astype(np.int32)), pa.array(np.ones(len(at), dtype=np.int32))], ["doc_id", "rid", "s", "n"]
        )

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words, last = [], 0, None
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in ("doc_id", "rid", "anchor", "s", "n", "words", "again")]
            for row in zip(*cols, strict=True):
                if words > 200_000 and row[2] != last:
                    if (out := flush(held)) is not None:
                        yield out
                    held, words = [], 0
                held.append(row)
                words, last = words + len(row[5]) // 8, row[2]
        if held and (out := flush(held)) is not None:
            yield out

    return of


def _suffixes(window: int):
    """Suffixes of large groups, one row each: (doc_id, rid, s, prefix, prefix2) with two hashes of the first `window` words."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (packed, again) in enumerate(zip(batch.column("words").to_pylist(), batch.column("again").to_pylist(), strict=True)):
                g, g2 = grams(np.frombuffer(packed, dtype=_U), window), grams(mixed(np.frombuffer(again, dtype=np.uint32).astype(_U) + LENGTH), window)
                who = pa.array(np.full(len(g), i))
                s = batch.column("s")[i].as_py()
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(who), batch.column("rid").take(who), pa.array(np.arange(s, s + len(g), dtype=np.int32)), pa.array(g.view(np.int64)), pa.array(g2.view(np.int64))], ["doc_id", "rid", "s", "prefix", "prefix2"])

    return of


def repeats(keyed: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """(doc_id, rid, s, n): the n windows from word s on are repeats. `keyed` has doc_id, rid, text."""
    runs = written(keyed.mapInArrow(_runs(window), "doc_id long, rid long, anchor long, run long, run2 long, s int, n int"), "runs")
    counts = written(runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "anchors")
    alive = written(join_counted(runs, counts, ["anchor"], "k", runs.count()), "alive")
    # equal runs: settled; the first of them goes on with those that occur once
    place, run = F.struct("doc_id", "rid", "s"), ["anchor", "run", "run2"]
    whole = alive.groupBy(*run).agg(F.min(place).alias("one"), F.count(F.lit(1)).alias("k"), F.first("n").alias("n"))
    whole = written(whole, "distinct-runs")
    settled = join_counted(alive, whole.where("k > 1").select(*run, "k"), run, "k", alive.count()).select("doc_id", "rid", "s", "n")
    sizes = written(whole.groupBy("anchor").agg(F.count(F.lit(1)).alias("m")).where("m > 1").withColumn("big", F.col("m") > group), "sizes")
    todo = join_counted(whole, sizes, ["anchor"], "m", whole.count(), "inner").select("one.*", "anchor", "big", "n")
    by_doc = todo.groupBy("doc_id", "rid").agg(F.collect_list(F.struct("anchor", "big", "s", "n", F.lit(window).alias("w"))).alias("runs"))
    by_doc = by_doc.withColumnRenamed("doc_id", "_id").withColumnRenamed("rid", "_rid").hint("merge")
    texts = keyed.join(by_doc, (keyed["doc_id"].eqNullSafe(F.col("_id"))) & (keyed["rid"] == F.col("_rid"))).dropDuplicates(["doc_id", "rid"]).select("doc_id", "rid", "text", "runs")
    packed = written(texts.mapInArrow(_texts_of_runs, "doc_id long, rid long, anchor long, big boolean, s int, n int, words binary, again binary"), "run-words")
    small = packed.where("not big").repartition(F.col("anchor")).sortWithinPartitions("anchor").mapInArrow(_trees(window), "doc_id long, rid long, s int, n int")
    deep = written(packed.where("big").mapInArrow(_suffixes(window), "doc_id long, rid long, s int, prefix long, prefix2 long"), "deep")
    twice = written(deep.groupBy("prefix", "prefix2").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "twice")
    large = join_counted(deep, twice, ["prefix", "prefix2"], "k", deep.count()).select("doc_id", "rid", "s", F.lit(1).alias("n"))
    return settled.unionByName(small).unionByName(large)


def _kept(window: int, with_text: bool):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, n, gone, out = batch.column("runs"), [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                w = (text or "").encode().split()
                cut = np.zeros(len(w) + 1, dtype=np.int32)
                for r in runs[i].as_py() or ():
                    cut[r["s"]] += 1
                    cut[r["s"] + r["n"] + window - 1] -= 1
                keep = np.cumsum(cut[:-1]) == 0
                kept = b" ".join([w[k] for k in np.flatnonzero(keep)] if not keep.all() else w)
                n.append(len(w))
                gone.append(len(w) - int(keep.sum()))
                out.append(kept.decode() if with_text else hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([*([batch.column(0)]), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.string())], [batch.schema.names[0], "n_words", "n_removed", "kept"])

    return of


def _with_repeats(docs: DataFrame, head, window: int, group: int) -> DataFrame:
    rid = F.xxhash64("doc_id", "text")
    keyed = docs.select("doc_id", rid.alias("rid"), "text")
    found = repeats(keyed, window, group).groupBy("doc_id", "rid").agg(F.collect_list(F.struct("s", "n")).alias("runs"))
    found = found.select(F.col("doc_id").alias("_id"), F.col("rid").alias("_rid"), "runs").hint("merge")
    rows = docs.select(head, F.col("doc_id").alias("_doc"), rid.alias("_key"), "text")
    return rows.join(found, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_rid")), "left").drop("_doc", "_key", "_id", "_rid")


def repeat_report(docs: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """One row for each document: doc_id, n_words, n_removed, kept_sha256."""
    rows = _with_repeats(docs, F.col("doc_id"), window, group)
    return rows.mapInArrow(_kept(window, False), "doc_id long, n_words long, n_removed long, kept string").withColumnRenamed("kept", "kept_sha256")


def remove_repeats(docs: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """The documents with n_words, n_removed and, in place of the text, the words that are left, joined by single spaces."""
    rows = _with_repeats(docs, F.struct("*").alias("_row"), window, group)
    done = rows.mapInArrow(_kept(window, True), f"_row {docs.schema.simpleString()}, n_words long, n_removed long, kept string")
    return done.withColumn("_row", F.col("_row").withField("text", F.col("kept"))).select(*(F.col(f"_row.`{c}`") for c in docs.columns if c.lower() not in ("n_words", "n_removed")), "n_words", "n_removed")
