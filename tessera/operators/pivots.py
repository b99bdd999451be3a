"""Farthest pairs and nearest earlier turns inside units of any size: rows go into blocks by their nearest pivot, angles to the pivots bound what two
blocks can hold, and only blocks whose bounds leave the answer open are compared.

Vectors have unit length. For a pivot p the triangle inequality of angles gives |pa - pb| <= ab <= min(pa + pb, 2 pi - pa - pb). The pivots are a unit's first
turns, so each row has exact angles to up to PIVOTS earlier ones from the start. A unit is cut by salt and by range, never gathered in one task; a block has
BLOCK rows at most. Light rows for pairs of blocks grow with the square of (rows of a unit / BLOCK); how many of them are compared depends
on the data: few where vectors lie in clusters, nearly all where they point in all directions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import written

PIVOTS, BLOCK, SALTED = 64, 256, 4096
#: arccos is good to about 2e-8 near 0 and pi.
SLACK = 1e-6
_BLOCK = "unit string, block long, first long, last long, turns array<long>, v binary, angles binary, best array<double>, lo array<double>, hi array<double>, open double, least double"


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array([np.asarray(x, dtype=float) for x in column])


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def _place(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
    """Each row's angles to the pivots of its unit, and its greatest cosine to an earlier pivot (-2: none)."""
    if rows.empty:
        return pd.DataFrame(columns=["unit", "turn_index", "v", "near", "angle", "angles", "best", "least"])
    cosines = _matrix(rows["v"]) @ _matrix(pivots["v"]).T
    angles, turns = _angles(cosines), rows["turn_index"].to_numpy()
    best = np.where(pivots["turn_index"].to_numpy()[None, :] < turns[:, None], cosines, -2.0).max(axis=1)
    near = angles.argmin(axis=1)
    return pd.DataFrame({"unit": rows["unit"], "turn_index": turns, "v": rows["v"], "near": near, "angle": angles[np.arange(len(near)), near], "angles": list(angles), "best": best, "least": cosines.min(axis=1)})


def _packer(size: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sorted rows to blocks of up to `size` rows of one unit, with the pairs inside a block settled. Once a block holds a quarter of that it ends where the nearest pivot changes."""
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            done = []
            for _, part in held.groupby("unit", sort=False):
                done.extend(part.iloc[i:j] for i, j in cuts(part["near"].to_numpy()))
            held = done.pop() if done else None  # the last block may go on in the next batch
            if done:
                yield pd.DataFrame([block(d) for d in done])
        if held is not None and len(held):
            yield pd.DataFrame([block(held)])

    def cuts(near: np.ndarray) -> Iterator[tuple[int, int]]:
        change, i = np.append(np.flatnonzero(near[1:] != near[:-1]) + 1, len(near)), 0
        while i < len(near):
            j = min(i + size, int(change[min(np.searchsorted(change, i + max(1, size // 4)), len(change) - 1)]))
            yield i, j
            i = j

    def block(rows: pd.DataFrame) -> dict:
        v, angles, turns = _matrix(rows["v"]), _matrix(rows["angles"]), rows["turn_index"].to_numpy()
        cosines = v @ v.T
        best = np.maximum(rows["best"].to_numpy(), np.where(turns[None, :] < turns[:, None], cosines, -2.0).max(axis=1))
        least = min(float(rows["least"].min()), float(cosines.min()))
        return {
            "unit": rows["unit"].iloc[0], "block": 0, "first": int(turns.min()), "last": int(turns.max()), "turns": turns.tolist(), "v": v.tobytes(), "angles": angles.tobytes(), "best": best.tolist(),
            "lo": angles.min(axis=0).tolist(), "hi": angles.max(axis=0).tolist(), "open": float(np.where(best < -1.5, np.pi, _angles(best)).max()), "least": least,
        }

    return pack


def blocks(u: DataFrame, pivots: int = PIVOTS, size: int = BLOCK) -> DataFrame:
    """Written blocks of rows (unit, turn_index, v) whose vectors have unit length."""
    u = u.select(F.col("unit").cast("string").alias("unit"), F.col("turn_index").cast("long").alias("turn_index"), "v")
    at = W.partitionBy("unit").orderBy("turn_index", "v")
    first = u.withColumn("_r", F.row_number().over(at)).where(F.col("_r") <= pivots).drop("_r")
    sizes = u.groupBy("unit").agg(F.ceil(F.count(F.lit(1)) / SALTED).alias("_n"))
    salted = u.join(sizes.hint("merge"), "unit").withColumn("_salt", F.pmod(F.xxhash64("turn_index", "v"), "_n"))
    first = written(first.join(sizes.hint("merge"), "unit").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))), "pivots")
    shape = "unit string, turn_index long, v array<double>, near int, angle double, angles array<double>, best double, least double"
    placed = salted.groupBy("unit", "_salt").cogroup(first.groupBy("unit", "_salt")).applyInPandas(_place, shape)
    order = ["unit", "near", "angle", "turn_index"]
    rows = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(rows.mapInPandas(_packer(size), _BLOCK).withColumn("block", F.monotonically_increasing_id()), "pivot-blocks")


def _sums(x: str, y: str, turn: str) -> Column:
    return F.expr(f"zip_with({x}, {y}, (p, q) -> {turn})")


#: Blocks of a tile. A task compares two tiles at a time, and a block is copied once for each tile that it meets.
TILE = 16


def _pairs(b: DataFrame, a_cols: list[str], b_cols: list[str], keep: Column) -> tuple[GroupedData, GroupedData]:
    """Both sides of the pairs of tiles with a pair of blocks that `keep` leaves, a light join of bounds first. A tile has blocks of one unit that one task wrote one after the other."""
    tile = F.floor(F.col("block") / TILE)  # ids of a task begin at a multiple of 2^33
    light = b.select("unit", "block", tile.alias("tile"), "first", "last", "lo", "hi", "open")
    x = light.select("unit", *(F.col(c).alias(f"a_{c}") for c in light.columns[1:]))
    y = light.select("unit", *(F.col(c).alias(f"b_{c}") for c in light.columns[1:]))
    key = ["unit", "a_tile", "b_tile"]
    pairs = written(x.join(y.hint("merge"), "unit").where(keep).groupBy(*key).agg(F.collect_set("a_block").alias("a"), F.collect_set("b_block").alias("b")), "pivot-pairs")

    def side(s: str, cols: list[str]) -> GroupedData:
        met = pairs.select(*key, F.explode(s).alias("block")).join(b.select("block", *cols).hint("merge"), "block")
        return met.select(*(F.col(c).alias(c) for c in met.columns)).groupBy(*key)  # aliases tell the two sides apart

    return side("a", a_cols), side("b", b_cols)


def nearest_earlier(b: DataFrame) -> DataFrame:
    """(unit, turn_index, m, compared): greatest cosine of each row of the blocks to an earlier turn of its unit, exact, and with how many rows of other blocks
    it was compared. Rows without an earlier turn have none; repeated turns are one row."""
    gap = F.array_max(_sums("a_lo", "b_hi", "p - q"))
    gap = F.greatest(gap, F.array_max(_sums("b_lo", "a_hi", "p - q")))
    keep = (F.col("a_block") != F.col("b_block")) & (F.col("b_first") < F.col("a_last")) & (gap <= F.col("a_open") + SLACK)

    def compare(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        others = [(y.block, np.asarray(y.turns), np.frombuffer(y.v), np.asarray(y.lo, dtype=float), np.asarray(y.hi, dtype=float)) for y in b.itertuples()]
        for x in a.itertuples():
            turns, best = np.asarray(x.turns), np.array(x.best, dtype=float)
            v, angles, compared = np.frombuffer(x.v).reshape(len(turns), -1), np.frombuffer(x.angles).reshape(len(turns), -1), np.zeros(len(turns), np.int64)
            for block, earlier, w, lo, hi in others:
                if block == x.block:
                    continue
                apart = np.maximum(angles - hi, lo - angles).max(axis=1)
                rows = np.flatnonzero((apart <= np.where(best < -1.5, np.pi, _angles(best)) + SLACK) & (turns > earlier.min()))
                if len(rows):
                    cosines = np.where(earlier[None, :] < turns[rows][:, None], v[rows] @ w.reshape(len(earlier), -1).T, -2.0)
                    best[rows] = np.maximum(best[rows], cosines.max(axis=1))
                    compared[rows] += len(earlier)
            rows = np.flatnonzero(compared)
            out.append(pd.DataFrame({"unit": key[0], "turn_index": turns[rows], "m": best[rows], "compared": compared[rows]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["unit", "turn_index", "m", "compared"])

    known = b.select("unit", F.explode(F.arrays_zip("turns", "best")).alias("_r")).select("unit", F.col("_r.turns").alias("turn_index"), F.col("_r.best").alias("m"), F.lit(0).cast("long").alias("compared"))
    a, other = _pairs(b, ["turns", "v", "angles", "best"], ["turns", "v", "lo", "hi"], keep)
    found = a.cogroup(other).applyInPandas(compare, known.schema)
    g = known.unionByName(found).groupBy("unit", "turn_index").agg(F.max("m").alias("m"), F.sum("compared").alias("compared"))
    return g.where("m >= -1.5")


def farthest(b: DataFrame) -> DataFrame:
    """(unit, least, compared): the least cosine of two rows of a unit, exact, and how many pairs of rows in different blocks were compared for it."""
    known = written(b.groupBy("unit").agg(F.min("least").alias("least"), F.sum(F.size("turns")).alias("n")), "pivot-far")
    bound = F.array_min(_sums("a_hi", "b_hi", "p + q"))
    bound = F.least(bound, F.array_min(_sums("a_lo", "b_lo", f"{2 * np.pi} - p - q")))
    far = b.drop("open").join(known.select("unit", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "least"))).alias("open")).hint("merge"), "unit")
    keep = (F.col("a_block") < F.col("b_block")) & (bound >= F.col("a_open") - SLACK)

    def compare(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        least, compared = 2.0, 0
        bounds = lambda r: (np.asarray(r.lo, dtype=float), np.asarray(r.hi, dtype=float))
        others = [(y.block, np.frombuffer(y.v).reshape(len(y.turns), -1), *bounds(y)) for y in b.itertuples()]
        for x in a.itertuples():
            v, (lo, hi) = np.frombuffer(x.v).reshape(len(x.turns), -1), bounds(x)
            for block, w, low, high in others:
                if x.block < block and min((hi + high).min(), (2 * np.pi - lo - low).min()) >= min(x.open, _angles(np.array(least))) - SLACK:
                    least, compared = min(least, float((v @ w.T).min())), compared + len(v) * len(w)
        return pd.DataFrame({"unit": [key[0]], "least": [least], "compared": [compared]})

    a, other = _pairs(far, ["turns", "v", "lo", "hi", "open"], ["turns", "v", "lo", "hi"], keep)
    found = a.cogroup(other).applyInPandas(compare, "unit string, least double, compared long")
    rows = known.select("unit", "least", F.lit(0).cast("long").alias("compared"), "n").unionByName(found, allowMissingColumns=True)
    return rows.groupBy("unit").agg(F.min("least").alias("least"), F.sum("compared").alias("compared"), F.max("n").alias("_n")).where("_n > 1").drop("_n")
