"""Near-dedup by fast similarity sketching, banding and exact verification.

A sketch has T coordinates. In round i < T every shingle is thrown into one random bin with a random value; in round T + i all
shingles go to bin i. A bin keeps the least value of the first round that reaches it, so every coordinate is filled, agreement of a
coordinate has the probability of the Jaccard similarity, and the count of agreements is concentrated like independent draws.
Rounds stop when all bins are full, which takes about T log T / n rounds for n shingles.

Equal shingle sets, by two hashes that rest on different tables of words, first become one class (its least doc_id stands for it). BANDS bands of ROWS coordinates find candidates: a
pair at the threshold is missed by all bands with a probability of about 3e-7. In a band's bucket each member is compared with
one hub, which links large groups of near copies without their pairs. Where a bucket still holds more than one component, its
members are compared in memory: the bucket is cut into tiles of about TILE members by hash, tiles of its largest component meet only those of the
other components, and a task compares two tiles at a time, by sketches alone and only in the first band that a pair shares. So no pair
becomes a row, and a task holds at most two tiles. Only members with a partner in another component whose sketch doesn't rule the threshold out (more than six
standard deviations below it) are joined to their texts, and their pairs are verified on the full shingle sets. Components: alternating stars.

Defined results: a document without words has an empty set and is linked with nothing; fewer than SHINGLE words make one
shingle; a null doc_id stands alone; rows that repeat a doc_id and its text are one document, and other texts under a doc_id that occurs with several are compared by each text, as members under that id; texts of any length
are taken whole; extra columns pass through `near_dedup`; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components
from .wordhash import LENGTH, LOWER, SECOND, STEP, TABLE, grams, mixed, slices, spans, word_hashes

SHINGLE, BANDS, ROWS = 5, 32, 6
T = BANDS * ROWS
#: Percent; pairs are linked from here on: by the registered query, and by stages and callers that ask for nothing else.
QUERY_THRESHOLD, STAGE_THRESHOLD = 85, 80
TILE = 128
_seeds = mixed(np.arange(1, 2 * T + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FULL = np.uint64(2**64 - 1)


def sketch(x: np.ndarray) -> np.ndarray:
    """The T values of a set of distinct hashes; the round is in the upper bits, so earlier rounds win."""
    bins = np.full(T, _FULL)
    done = 0
    while done < T:
        n = min(T - done, max(1, 4 * T // max(len(x), 1)))
        h = mixed(x[None, :] ^ _seeds[done : done + n, None])
        value = (h >> np.uint64(10)) | (np.arange(done, done + n, dtype=np.uint64) << np.uint64(54))[:, None]
        np.minimum.at(bins, ((mixed(h) >> np.uint64(32)) * np.uint64(T) >> np.uint64(32)).astype(np.int64).ravel(), value.ravel())
        done += n
        if (bins != _FULL).all():
            return bins
    for i in np.flatnonzero(bins == _FULL):
        bins[i] = (mixed(x ^ _seeds[T + i]) >> np.uint64(10)).min() | (np.uint64(T + i) << np.uint64(54))
    return bins


def _shingles(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Hashes of the shingles of one text from those of its words and of the 5-word sequences that start at each."""
    if len(h) >= SHINGLE:
        return g[: len(h) - SHINGLE + 1]
    return mixed((h * STEP[: len(h)]).sum(keepdims=True) + np.full(1, len(h), dtype=np.uint64) * LENGTH) if len(h) else h


def shingle_sets(texts: pa.Array, table: np.ndarray = TABLE) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles, A-Z lowered."""
    for lo, hi, raw, off in slices(texts):
        starts, ends, first = spans(raw, off)
        h = word_hashes(LOWER[raw], starts, ends, table)
        g = grams(h, SHINGLE)
        for i in range(hi - lo):
            a, b = first[i], first[i + 1]
            yield np.unique(_shingles(h[a:b], g[a:b]))


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, sig1, sig2, bands, low = [], [], [], [], []
        for x, y in zip(shingle_sets(batch.column(1)), shingle_sets(batch.column(1), SECOND), strict=True):
            n.append(len(x))
            sig1.append(int(mixed(x).sum()))
            sig2.append(int(mixed(y).sum()))
            if not len(x):
                bands.append(None)
                low.append(None)
                continue
            s = sketch(x)
            key = mixed((s.reshape(BANDS, ROWS) * STEP[:ROWS]).sum(axis=1) + np.arange(1, BANDS + 1, dtype=np.uint64) * LENGTH)
            bands.append(key.tobytes())
            low.append(s.astype(np.uint8).tobytes())
        as_long = lambda v: pa.array(np.array(v, dtype=np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), as_long(sig1), as_long(sig2), pa.array(bands, pa.binary()), pa.array(low, pa.binary())], ["doc_id", "th", "n_shingles", "sig1", "sig2", "bands", "low"])


def _least(threshold: int) -> float:
    """Agreeing coordinates under which the threshold is ruled out."""
    j = threshold / 100
    return T * (j - 6 * (j * (1 - j) / T) ** 0.5)


def _close(threshold: int):
    """Pairs (low_a, low_b) whose sketches don't rule the threshold out."""
    least = _least(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint8).reshape(-1, T) for k in ("low_a", "low_b"))
                keep = (a == b).sum(axis=1) >= least
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], ["a", "b"])

    return run


def _verified(threshold: int):
    """Pairs (a, text_a, b, text_b) whose full shingle sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, of = None, None
        for batch in batches:
            ids, keep = batch.column("a").to_pylist(), []
            hubs = batch.column("text_a")
            for i, y in enumerate(shingle_sets(batch.column("text_b"))):
                if of is None or ids[i] != hub:  # pairs come sorted by a
                    hub, of = ids[i], next(shingle_sets(hubs.slice(i, 1)))
                keep.append(_linked(of, y, threshold))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep, pa.bool_())), batch.column("b").filter(pa.array(keep, pa.bool_()))], ["a", "b"])

    return run


def _linked(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= threshold * (len(x) + len(y) - both)


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, which may span batches."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy() for c in keys])
        edges = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if held and tuple(k[:, lo]) != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = tuple(k[:, lo])
    if held:
        yield pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray, dtype: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(-1, width)


def _partners(rows: pa.Table, threshold: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of two tiles the later rows that it has to be verified with."""
    least, low, bands = _least(threshold), _matrix(rows["low"], "u1", T), _matrix(rows["bands"], "<i8", BANDS)
    c, tile, band = rows["c"].to_numpy(), rows["tile"].to_numpy(), rows["band"][0].as_py()
    across = len(set(tile.tolist())) > 1
    for k in range(len(c) - 1):
        near = np.flatnonzero(c[k + 1 :] != c[k]) + k + 1
        if across:
            near = near[tile[near] != tile[k]]
        near = near[(low[near] == low[k]).sum(axis=1) >= least]
        if len(near):
            near = near[(bands[near] == bands[k]).argmax(axis=1) == band]
        if len(near):
            yield k, near


def _close_members(threshold: int):
    """Of the rows of two tiles those with a partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ("key", "i", "j")):
            keep = np.zeros(rows.num_rows, dtype=bool)
            for k, near in _partners(rows, threshold):
                keep[k] = True
                keep[near] = True
            if keep.any():
                yield from rows.filter(pa.array(keep)).combine_chunks().to_batches()

    return run


def _tile_links(threshold: int):
    """Links (a, b) between components, as few as connect what two tiles connect."""

    def compare(rows: pa.Table) -> list[tuple[int, int]]:
        rep, c, text = rows["rep"].to_pylist(), rows["c"].to_pylist(), rows["text"]
        sets: dict[int, np.ndarray] = {}
        root = {x: x for x in c}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        def of(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = next(shingle_sets(pa.array([text[k].as_py()], pa.string())))
            return sets[k]

        found = []
        for k, near in _partners(rows, threshold):
            for m in near.tolist():
                a, b = find(c[k]), find(c[m])
                if a != b and _linked(of(k), of(m), threshold):
                    root[a] = b
                    found.append((rep[k], rep[m]))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ("key", "i", "j")):
            if rows.num_rows > 1 and (got := compare(rows)):
                a, b = zip(*got, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def bucket_links(named: DataFrame, reps: DataFrame, docs: DataFrame, threshold: int) -> DataFrame:
    """Links between components that share buckets. `named`: key, band, rep, c (its component)."""
    sizes = named.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max(F.struct("n", "c")).alias("top"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"))
    tiles = lambda n: F.ceil(n / TILE).cast("int")
    split = written(sizes.where("parts > 1").select("key", F.col("top.c").alias("main"), tiles(F.col("top.n")).alias("k_main"), tiles(F.col("n") - F.col("top.n")).alias("k_rest")), "split")
    member = named.join(split.hint("merge"), "key").withColumn("in_main", F.col("c") == F.col("main"))
    member = member.withColumn("tile", F.when(F.col("in_main"), F.col("k_rest") + F.pmod(F.xxhash64("rep"), "k_main")).otherwise(F.pmod(F.xxhash64("rep"), "k_rest")).cast("int"))
    member = written(member.select("key", "band", "rep", "c", "tile", "in_main", "k_main", "k_rest"), "members")
    # tiles of the largest component meet those of the rest; the rest's meet each other, and themselves
    pairs = member.withColumn("u", F.explode(F.sequence(F.lit(0), F.col("k_rest") - 1 + F.when(F.col("in_main"), 0).otherwise(F.col("k_main")))))
    pairs = pairs.select("key", F.least("tile", "u").alias("i"), F.greatest("tile", "u").alias("j"), "tile", "band", "rep", "c")
    pairs = pairs.join(reps.select("rep", "th", "low", "bands").hint("merge"), "rep").select("key", "i", "j", "tile", "band", "rep", "th", "c", "low", "bands")
    dealt = lambda df: df.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rep")
    close = written(dealt(pairs).mapInArrow(_close_members(threshold), pairs.schema), "close-members")
    of = ["rep", "th"]
    texts = docs.select(F.col("doc_id").alias("rep"), "th", "text").join(close.select(*of).distinct().hint("merge"), of, "left_semi").dropDuplicates(of)
    return written(dealt(close.join(texts.hint("merge"), of)).mapInArrow(_tile_links(threshold), "a long, b long"), "tile-links")


def links(pairs: DataFrame, reps: DataFrame, docs: DataFrame, threshold: int, name: str) -> DataFrame:
    """The pairs (a, b) of class representatives that are links, verified on the texts."""
    low = reps.select("rep", "low")
    pairs = pairs.distinct()
    for k in "ab":
        pairs = pairs.join(low.select(F.col("rep").alias(k), F.col("low").alias(f"low_{k}")).hint("merge"), k)
    pairs = written(pairs.select("a", "b", "low_a", "low_b").mapInArrow(_close(threshold), "a long, b long"), f"{name}-close")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = written(docs.select("doc_id", "text").join(ids.hint("merge"), "doc_id", "left_semi"), f"{name}-texts")
    for k in "ba":
        pairs = pairs.join(texts.select(F.col("doc_id").alias(k), F.col("text").alias(f"text_{k}")).hint("merge"), k)
    return written(pairs.select("a", "text_a", "b", "text_b").mapInArrow(_verified(threshold), "a long, b long").distinct(), f"{name}-links")


def _keys(bands: str) -> Column:
    """The keys of the bands as longs, from their packed form."""
    return F.expr(f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(i, substring({bands}, 8 * i + 1, 8)))")


def near_groups(docs: DataFrame, threshold: int = STAGE_THRESHOLD) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    marked = written(docs.mapInArrow(_sketched, "doc_id long, th long, n_shingles long, sig1 long, sig2 long, bands binary, low binary"), "sketches")
    sig = ["n_shingles", "sig1", "sig2"]
    reps = written(marked.where("n_shingles > 0 and doc_id is not null").groupBy(*sig).agg(F.min(F.struct("doc_id", "th")).alias("one"), F.first("bands").alias("bands"), F.first("low").alias("low")).select(*sig, F.col("one.doc_id").alias("rep"), F.col("one.th").alias("th"), "bands", "low"), "classes")
    rows = reps.select(F.posexplode(_keys("bands")).alias("band", "key"), "rep")
    hubs = rows.groupBy("key").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "hub")
    shared = written(rows.join(hubs.hint("merge"), "key"), "buckets")
    first = links(shared.where("rep != hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")), reps, docs, threshold, "star")
    found = written(components(first), "stars")
    named = shared.join(found.hint("merge"), shared["rep"] == found["id"], "left").select("key", "band", "rep", F.coalesce("component", "rep").alias("c"))
    second = bucket_links(written(named, "named"), reps, docs, threshold)
    whole = written(components(found.select(F.col("component").alias("a"), F.col("id").alias("b")).union(second)), "components")
    by_class = reps.select(*sig, "rep").join(whole.hint("merge"), F.col("rep") == F.col("id"), "left").select(*sig, F.coalesce("component", "rep").alias("component"))
    return (
        marked.join(by_class.hint("merge"), sig, "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def near_dedup(docs: DataFrame, threshold: int = STAGE_THRESHOLD) -> DataFrame:
    """One document of each component, all columns unchanged; of rows that repeat a doc_id all stay or go."""
    gone = written(near_groups(docs, threshold).where("not kept").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    rows = docs.select(F.struct("*").alias("_row"))
    return rows.join(gone.hint("merge"), F.col("_row.doc_id") == F.col("_gone"), "left_anti").select("_row.*")
