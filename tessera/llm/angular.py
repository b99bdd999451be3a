"""Hard-negative mining by angular triangle filtering.

Vectors become integers, floor(SCALE * x), and a score is the integer inner product. REFERENCES directions are fitted on a bounded sample; every row's
angles to them are stored. For an anchor at angle a from a direction and rows at angles lo .. hi from it, the angle between them lies in
[max(0, lo - a, a - hi), min(a + hi, 2 pi - a - lo)] (the triangle inequality on the sphere), so each direction gives an interval of cosines;
the tightest, times the norms, bounds the scores. Angles are widened by SLACK and bounds by a part in a million and one whole unit, so rounding never excludes a row.

1. Rows are sorted by label, nearest direction and angle to it, cut by range into blocks of about BLOCK rows, and each block into windows of at most WINDOW rows
   of one label, packed with their least and greatest angles and norms.
2. Positives: an anchor goes to the blocks of its own label. There it meets the windows from the highest bound on; a window below the anchor's fifth best score so far is not scored.
3. Negatives: an anchor goes, with the score intervals of its positives, to the blocks whose bounds overlap one of them; there only windows of other labels
   whose bounds overlap an interval, above the third best found in it, get integer scoring.

Each block gives an anchor at most POSITIVES, or NEGATIVES a positive, rows, and a ranking over them gives the result. Bounds only skip what can't be in it, so the
result is that of scoring everything. Anchors are copied to blocks, never rows, so what moves is anchors x blocks; the driver holds one summary a block, of which there are at
most BLOCKS (blocks grow beyond that), and the sample.

Inner products run in float32 or float64 where the norms prove every partial sum exact, else in 64-bit integers.

Defined results: rows with a null label, vector, component, a non-finite component or a null id take no part; a shorter vector is filled with zeros to
the longest; rows that repeat id, label and vector are one row; rows that repeat only the id are rows of their own, but never positives or negatives of that id's anchors; ties go to the smaller id;
extra columns are ignored; scores are exact while they fit 64 bits; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

SCALE, ANCHOR_EVERY, POSITIVES, NEGATIVES = 256, 50, 5, 3
#: Percent of the positive's score between which a negative's score has to be.
LEAST, MOST = 50, 95
#: Directions, rows of the sample they are fitted on, rows a window and a block, blocks at most and at least (where there are rows for them).
REFERENCES, SAMPLE, WINDOW, BLOCK, BLOCKS, LEAST_BLOCKS = 16, 4096, 256, 2**16, 2**14, 32
SLACK = 1e-6
#: Anchors that are compared with a window at a time.
TOGETHER = 2048
ROW = "vec_id long, label long, n int, q binary, angles binary, norm double, ref int, theta double"
PACKED = "block int, kind int, ord long, label long, n int, ids binary, q binary, lo binary, hi binary, norm_lo double, norm_hi double, want binary"


def _pack(q: np.ndarray) -> bytes:
    return (q.astype(np.int16) if np.abs(q).max(initial=0) < 2**15 else q).tobytes()


def _unpack(packed: bytes, n: int, d: int) -> np.ndarray:
    """n integer vectors of d components, from 16 or 64 bits a component."""
    return np.frombuffer(packed, dtype=np.int16 if len(packed) == 2 * n * d else np.int64).reshape(n, d)


def angles(q: np.ndarray, norm: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Angles of integer vectors (rows) to the directions; a zero vector stands at right angles to all."""
    return np.arccos(np.clip(q.astype(np.float64) @ refs.T / np.maximum(norm, 1e-300)[:, None], -1, 1))


def directions(sample: np.ndarray, k: int = REFERENCES, rounds: int = 8) -> np.ndarray:
    """k unit vectors by spherical k-means, without chance: it begins with rows that lie far from those taken before."""
    norm = np.linalg.norm(sample, axis=1)
    x = sample[norm > 0] / norm[norm > 0][:, None]
    if not len(x):
        return np.eye(1, sample.shape[1] if sample.ndim == 2 else 1)
    taken, near = [0], x @ x[0]
    for _ in range(min(k, len(x)) - 1):
        taken.append(int(near.argmin()))
        near = np.maximum(near, x @ x[taken[-1]])
    c = x[taken]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (own == j).any() and (n := np.linalg.norm(m := x[own == j].mean(axis=0))) > 1e-9:
                c[j] = m / n
    return c


def bounds(a: np.ndarray, norm: np.ndarray, lo: np.ndarray, hi: np.ndarray, norm_lo: np.ndarray, norm_hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest scores of anchors (rows; angles `a`, norms) with the vectors of each group (columns; angles lo .. hi to each direction)."""
    least = np.zeros((len(a), len(lo)))
    most = np.full((len(a), len(lo)), np.pi)
    for r in range(a.shape[1]):
        x, low, high = a[:, r, None], np.maximum(lo[None, :, r] - SLACK, 0), np.minimum(hi[None, :, r] + SLACK, np.pi)
        np.maximum(least, np.maximum(low - x, x - high), out=least)
        far = np.where(x + high <= np.pi, x + high, np.where(x + low >= np.pi, 2 * np.pi - x - low, np.pi))
        np.minimum(most, far, out=most)
    top, bottom = np.cos(np.clip(least - SLACK, 0, np.pi)), np.cos(np.clip(most + SLACK, 0, np.pi))
    small, large = norm[:, None] * norm_lo, norm[:, None] * norm_hi
    room = 1 + 1e-6 * large
    return np.minimum(bottom * small, bottom * large) - room, np.maximum(top * small, top * large) + room


def products(x: np.ndarray, y: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products as integers; `most`: the greatest product of norms, which no partial sum exceeds."""
    if most < 2**24:
        return (x.astype(np.float32) @ y.astype(np.float32).T).astype(np.int64)
    if most < 2**53:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    return x.astype(np.int64) @ y.astype(np.int64).T


def _stored(refs: np.ndarray, d: int):
    """Rows (vec_id, label, v) with their integer vectors, angles to the directions, and the nearest of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("v")
            size, flat = np.diff(v.offsets.to_numpy()), v.flatten().to_numpy(zero_copy_only=False)
            q = np.zeros((batch.num_rows, d), dtype=np.int64)
            row = np.repeat(np.arange(len(size)), size)
            q[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
            norm = np.linalg.norm(q.astype(np.float64), axis=1)
            a = angles(q, norm, refs)
            ref = a.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(np.ones(len(q), dtype=np.int32)), pa.array([_pack(x) for x in q], pa.binary()), pa.array([x.tobytes() for x in a], pa.binary()), pa.array(norm), pa.array(ref.astype(np.int32)), pa.array(a[np.arange(len(q)), ref])],
                ["vec_id", "label", "n", "q", "angles", "norm", "ref", "theta"],
            )

    return run


def _windows(d: int, refs: int):
    """Sorted rows of one block as windows of one label; rows that repeat the one before are left out."""

    def of(label: int, rows: list[tuple], block: int, number: int) -> dict:
        q = np.concatenate([_unpack(r[1], 1, d) for r in rows])
        a, norm = np.frombuffer(b"".join(r[2] for r in rows)).reshape(-1, refs), np.array([r[3] for r in rows])
        return {"block": block, "kind": 0, "ord": number, "label": label, "n": len(rows), "ids": np.array([r[0] for r in rows], dtype=np.int64).tobytes(), "q": _pack(q.astype(np.int64)), "lo": a.min(axis=0).tobytes(), "hi": a.max(axis=0).tobytes(), "norm_lo": norm.min(), "norm_hi": norm.max(), "want": None}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, number, block = [], None, 0, None
        for batch in batches:
            out = []
            for row in zip(*(batch.column(k).to_pylist() for k in ("label", "vec_id", "q", "angles", "norm", "block")), strict=True):
                if row[:3] == last:
                    continue
                if held and (row[0] != last[0] or len(held) == WINDOW):
                    out.append(of(last[0], held, block, number))
                    held, number = [], number + 1
                held.append(row[1:5])
                last, block = row[:3], row[5]
            if out:
                yield pa.RecordBatch.from_pylist(out, _SCHEMA)
        if held:
            yield pa.RecordBatch.from_pylist([of(last[0], held, block, number)], _SCHEMA)

    return run


_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
_SCHEMA = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in PACKED.split(", ")])


def _sent(blocks: dict[str, np.ndarray], positives: bool):
    """Anchors, once for each block where they can find something: blocks of their label, or those whose bounds overlap a wanted interval."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            label, norm = batch.column("label").to_numpy(), batch.column("norm").to_numpy()
            if positives:
                go = (blocks["first"] <= label[:, None]) & (label[:, None] <= blocks["last"])
                want = [None] * len(label)
            else:
                a = np.frombuffer(b"".join(batch.column("angles").to_pylist())).reshape(len(label), -1)
                low, high = bounds(a, norm, blocks["lo"], blocks["hi"], blocks["norm_lo"], blocks["norm_hi"])
                go, want = np.zeros(low.shape, dtype=bool), [np.array(w, dtype=np.int64) for w in batch.column("want").to_pylist()]
                for i, w in enumerate(want):
                    for x in w:
                        go[i] |= (high[i] >= x[2]) & (low[i] <= x[3])
                want = [w.tobytes() for w in want]
                go &= ~((blocks["first"] == blocks["last"]) & (blocks["first"] == label[:, None]))
            who, where = np.nonzero(go)
            at = pa.array(who)
            q, ids, spread = batch.column("q").take(at), batch.column("vec_id").to_numpy()[who], batch.column("angles").take(at)
            aid = batch.column("aid").to_numpy()[who]
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks["block"][where].astype(np.int32)), pa.array(np.ones(len(who), dtype=np.int32)), pa.array(aid), pa.array(label[who]), pa.array(np.ones(len(who), dtype=np.int32)), pa.array([x.tobytes() for x in ids.astype(np.int64)], pa.binary()), q, spread, spread, pa.array(norm[who]), pa.array(norm[who]), pa.array([want[k] for k in who], pa.binary())],
                schema=_SCHEMA,
            )

    return run


class _Block:
    """The windows of one block, and anchors that come in."""

    def __init__(self, d: int) -> None:
        self.d, self.windows, self.scored, self.met = d, [], 0, 0

    def add(self, r: dict) -> None:
        n = r["n"]
        self.windows.append((np.frombuffer(r["ids"], dtype=np.int64), _unpack(r["q"], n, self.d), r["label"], np.frombuffer(r["lo"]), np.frombuffer(r["hi"]), r["norm_lo"], r["norm_hi"]))

    def close(self) -> None:
        self.label = np.array([w[2] for w in self.windows])
        self.lo, self.hi = (np.array([w[k] for w in self.windows]) for k in (3, 4))
        self.norm_lo, self.norm_hi = (np.array([w[k] for w in self.windows]) for k in (5, 6))

    def best(self, rows: list[dict], positives: bool) -> pa.RecordBatch:
        """(aid, anchor_id, slot, other, score, positive_id, positive_score): what the anchors find here."""
        q = np.concatenate([_unpack(r["q"], 1, self.d) for r in rows])
        a, norm = np.frombuffer(b"".join(r["lo"] for r in rows)).reshape(len(rows), -1), np.array([r["norm_lo"] for r in rows])
        label, ids, aid = (np.array(x, dtype=np.int64) for x in ([r["label"] for r in rows], [np.frombuffer(r["ids"], dtype=np.int64)[0] for r in rows], [r["ord"] for r in rows]))
        low, high = bounds(a, norm, self.lo, self.hi, self.norm_lo, self.norm_hi)
        if positives:  # one slot: any score
            keep, slot_of, least, most, more = POSITIVES, np.arange(len(rows)), np.full(len(rows), -(2**63), dtype=np.int64), np.full(len(rows), 2**63 - 1, dtype=np.int64), None
        else:
            wants = [np.frombuffer(r["want"], dtype=np.int64).reshape(-1, 4) for r in rows]
            more = np.concatenate(wants)
            keep, slot_of, least, most = NEGATIVES, np.repeat(np.arange(len(rows)), [len(w) for w in wants]), more[:, 2].copy(), more[:, 3]
        slots = np.searchsorted(slot_of, np.arange(len(rows) + 1))
        no = np.empty(0, dtype=np.int64)
        found = (no, no, no)  # slot, other, score: at most `keep` a slot
        for w in np.argsort(-high.max(axis=0), kind="stable"):
            others, x, own, *_, reach = self.windows[w]
            apply = (label == own) == positives
            self.met += int(apply.sum()) * len(others)
            # slots whose interval, above what they have already, this window can reach
            open_ = apply[slot_of] & (high[slot_of, w] >= least) & (low[slot_of, w] <= most)
            if not open_.any():
                continue
            go = np.unique(slot_of[open_])
            self.scored += len(go) * len(others)
            score = products(q[go], x, float(norm[go].max() * reach))
            floor, ceiling = np.full(len(rows), 2**63 - 1, dtype=np.int64), np.full(len(rows), -(2**63), dtype=np.int64)
            np.minimum.at(floor, slot_of[open_], least[open_])
            np.maximum.at(ceiling, slot_of[open_], most[open_])
            bottom = floor[go]
            if score.shape[1] > keep and positives:
                bottom = np.maximum(bottom, -np.partition(-np.where(others == ids[go, None], -(2**62), score), keep - 1, axis=1)[:, keep - 1])
            i, j = np.nonzero((score >= bottom[:, None]) & (score <= ceiling[go, None]) & (others != ids[go, None]))
            if not len(i):
                continue
            s, o, r = score[i, j], others[j], go[i]
            n = (slots[1:] - slots[:-1])[r]
            slot = np.repeat(slots[:-1][r], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            s, o = np.repeat(s, n), np.repeat(o, n)
            fit = (s >= least[slot]) & (s <= most[slot])
            slot, o, s = (np.concatenate([old, new[fit]]) for old, new in zip(found, (slot, o, s), strict=True))
            order = np.lexsort((o, -s, slot))
            slot, o, s = slot[order], o[order], s[order]
            rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
            full = rank == keep - 1
            least[slot[full]] = np.maximum(least[slot[full]], s[full])
            found = tuple(v[rank < keep] for v in (slot, o, s))
        slot, o, s = found
        r = slot_of[slot]
        extra = (no, no) if more is None else (more[slot, 0], more[slot, 1])
        extra = [pa.array(v) if more is not None else pa.nulls(len(slot), pa.int64()) for v in extra]
        return pa.RecordBatch.from_arrays([pa.array(aid[r]), pa.array(ids[r]), pa.array((slot - slots[r]).astype(np.int32)), pa.array(o), pa.array(s), *extra], ["aid", "anchor_id", "slot", "other", "score", "positive_id", "positive_score"])


_FOUND = "aid long, anchor_id long, slot int, other long, score long, positive_id long, positive_score long"


def _searched(d: int, positives: bool):
    """Rows of blocks, windows (kind 0) before anchors (kind 1): an anchor's best in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number, rows, closed = _Block(d), None, [], False

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal rows
            if rows and block.windows and (out := block.best(rows, positives)).num_rows:
                yield out
            rows = []

        for batch in batches:
            for r in batch.to_pylist():
                if r["block"] != number:
                    yield from flush()
                    block, number, closed = _Block(d), r["block"], False
                if r["kind"] == 0:
                    block.add(r)
                    continue
                if not closed:
                    block.close()
                    closed = True
                rows.append(r)
                if len(rows) == TOGETHER:
                    yield from flush()
        yield from flush()

    return run


def eligible(vectors: DataFrame, relabel=None) -> DataFrame:
    """(vec_id, label, v): the rows that take part, with integer components. `relabel`: an expression of the label."""
    x = F.col("embedding")
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    return vectors.where(ok).select(F.col("vec_id").cast("long"), (F.col("label") if relabel is None else relabel).cast("long").alias("label"), v.alias("v"))


_SUMMARY = "block int, first long, last long, lo binary, hi binary, norm_lo double, norm_hi double"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the windows of a block that this task reads have in common."""
    of: dict[int, list] = {}
    for batch in batches:
        for r in batch.to_pylist():
            lo, hi = np.frombuffer(r["lo"]), np.frombuffer(r["hi"])
            new = [r["label"], r["label"], lo, hi, r["norm_lo"], r["norm_hi"]]
            of[r["block"]] = _wider(of.get(r["block"]), new)
    if of:
        yield pa.RecordBatch.from_pylist([dict(zip(("block", "first", "last", "lo", "hi", "norm_lo", "norm_hi"), (b, *v[:2], v[2].tobytes(), v[3].tobytes(), *v[4:]), strict=True)) for b, v in of.items()], pa.schema([("block", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("lo", pa.binary()), ("hi", pa.binary()), ("norm_lo", pa.float64()), ("norm_hi", pa.float64())]))


def _wider(a: list | None, b: list) -> list:
    return b if a is None else [f(x, y) for f, x, y in zip((min, max, np.minimum, np.maximum, min, max), a, b, strict=True)]


def _merged(rows: list, refs: int) -> dict[str, np.ndarray]:
    """Summaries of all blocks, at most BLOCKS, as arrays."""
    of: dict[int, list] = {}
    for r in rows:
        of[r.block] = _wider(of.get(r.block), [r.first, r.last, np.frombuffer(r.lo), np.frombuffer(r.hi), r.norm_lo, r.norm_hi])
    blocks = sorted(of)
    get = lambda k: np.array([of[b][k] for b in blocks])
    return {"block": np.array(blocks, dtype=np.int64), "first": get(0), "last": get(1), "lo": get(2).reshape(-1, refs), "hi": get(3).reshape(-1, refs), "norm_lo": get(4), "norm_hi": get(5)}


def _dealt(packed: DataFrame, n: int) -> DataFrame:
    return packed.repartition(n, "block").sortWithinPartitions("block", "kind", "ord")


def hard_negatives(vectors: DataFrame, relabel=None, every: int = ANCHOR_EVERY) -> DataFrame:
    """One row for each anchor (vec_id divisible by `every`), positive and negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = vectors.sparkSession
    rows = eligible(vectors, relabel)
    d, total = rows.agg(F.max(F.size("v")), F.count(F.lit(1))).first()
    d = max(1, d or 0)
    sample = [r.v for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()]
    x = np.zeros((max(1, len(sample)), d))
    for i, v in enumerate(sample):
        x[i, : len(v)] = v
    refs = directions(x)
    stored = written(rows.mapInArrow(_stored(refs, d), ROW), "angles")
    n = max(1, min(BLOCKS, max(math.ceil(total / BLOCK), min(LEAST_BLOCKS, math.ceil(total / WINDOW)))))
    order = ["label", "ref", "theta", "vec_id", "q"]
    ranged = stored.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("block", F.spark_partition_id())
    windows = written(ranged.mapInArrow(_windows(d, len(refs)), PACKED), "windows")
    of = windows.select("block", "label", "lo", "hi", "norm_lo", "norm_hi").mapInArrow(_summed, _SUMMARY)
    blocks = _merged(of.collect(), len(refs))
    anchors = stored.where(F.col("vec_id") % every == 0).withColumn("aid", F.xxhash64("vec_id", "label", "q")).dropDuplicates(["vec_id", "label", "q"])
    anchors = written(anchors.select("vec_id", "label", "q", "angles", "norm", "aid"), "anchors")
    asked = anchors.mapInArrow(_sent(blocks, True), PACKED)
    first = _dealt(windows.unionByName(asked), n).mapInArrow(_searched(d, True), _FOUND)
    best = W.partitionBy("aid").orderBy(F.desc("score"), "other")
    first = first.withColumn("k", F.row_number().over(best)).where(F.col("k") <= POSITIVES)
    least, most = f"-((-score * {LEAST} - pmod(-score * {LEAST}, 100)) div 100)", f"(score * {MOST} - pmod(score * {MOST}, 100)) div 100"
    wanted = first.groupBy("aid").agg(F.sort_array(F.collect_list(F.struct("k", "other", "score", F.expr(least).alias("least"), F.expr(most).alias("most")))).alias("w"))
    wanted = written(wanted.select("aid", F.transform("w", lambda w: F.array(w["other"], w["score"], w["least"], w["most"])).alias("want")), "wanted")
    asked = anchors.join(wanted.hint("merge"), "aid").mapInArrow(_sent(blocks, False), PACKED)
    second = _dealt(windows.unionByName(asked), n).mapInArrow(_searched(d, False), _FOUND)
    rank = W.partitionBy("aid", "slot").orderBy(F.desc("score"), "other")
    out = second.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= NEGATIVES)
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mined(vectors: DataFrame) -> DataFrame:
    """The registered query: where vec_id is divisible by 7, the label is moved by one (of ten) before mining."""
    return hard_negatives(vectors, F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long")))
