"""Operators over embedding columns (arrays of doubles, unit length), with closed forms where pairs would be quadratic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import r6, ratio
from . import pivots as pv
from .stats import spearman
from .structure import gini


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column | str) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    return F.get(F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: x / n)), 0)  # the norm once a row, not once a component


def sum_vectors(df: DataFrame, by: list[str], v: str = "v") -> DataFrame:
    """(by, n, s): component sums. Components are summed as rows, so partial sums combine before the shuffle."""
    e = df.select(*by, F.posexplode(v).alias("_d", "_x")).groupBy(*by, "_d").agg(F.sum("_x").alias("_x"), F.count(F.lit(1)).alias("_n"))
    g = e.groupBy(*by).agg(F.max("_n").alias("n"), F.array_sort(F.collect_list(F.struct("_d", "_x"))).alias("_s"))
    return g.select(*by, "n", F.transform("_s", lambda p: p["_x"]).alias("s"))


def pooled(df: DataFrame, by: list[str]) -> DataFrame:
    """Mean vector of each unit, normalised again: long rows (by, dim, value)."""
    g = sum_vectors(df, by).withColumn("_u", F.sqrt(dot("s", "s")))
    return g.select(*by, F.posexplode("s").alias("dim", "_x"), "_u").select(*by, "dim", F.round(ratio("_x", "_u"), 5).alias("value"))


def consecutive(df: DataFrame) -> DataFrame:
    """Mean cosine of neighbouring turns of different speakers, and of all neighbours."""
    w = W.partitionBy("unit").orderBy("turn_index")
    d = df.withColumns({"_p": F.lag("v").over(w), "_s": F.lag("speaker").over(w)}).withColumn("c", dot("v", "_p") / (norm("v") * norm("_p")))
    return d.groupBy("unit").agg(F.count("c").alias("pairs"), r6(F.avg("c")).alias("consecutive"), r6(F.avg(F.when(F.col("_s") != F.col("speaker"), F.col("c")))).alias("cross_speaker"))


def anchoring(df: DataFrame, turns: int = 4, others: int = 3) -> DataFrame:
    """Similarity of later turns of other speakers to the unit's first turn, and its rank correlation with position; units of fewer than `turns` turns or `others` such turns say nothing."""
    w = W.partitionBy("unit").orderBy("turn_index")
    d = df.withColumns({"_f": F.first("v").over(w), "_s": F.first("speaker").over(w), "pos": F.row_number().over(w), "_n": F.count(F.lit(1)).over(W.partitionBy("unit"))}).where((F.col("speaker") != F.col("_s")) & (F.col("_n") >= turns))
    d = d.withColumn("c", F.round(dot("v", "_f") / (norm("v") * norm("_f")), 9))
    rho = spearman(d.select("unit", F.col("pos").alias("x"), F.col("c").alias("y")), ["unit"])
    return d.groupBy("unit").agg(r6(F.avg("c")).alias("similarity"), F.count(F.lit(1)).alias("_k")).where(F.col("_k") >= others).join(rho.select("unit", "n", "rho"), "unit").drop("_k")


def displacement(df: DataFrame) -> DataFrame:
    """Per speaker: distance from the first to the last turn, and whether the last is nearer the others' centroid (sum of all less own)."""
    own = df.groupBy("unit", "speaker").agg(F.min_by("v", "turn_index").alias("a"), F.max_by("v", "turn_index").alias("b"))
    s, all_ = sum_vectors(df, ["unit", "speaker"]), sum_vectors(df, ["unit"]).withColumnsRenamed({"s": "sa", "n": "na"})
    j = own.join(s.hint("merge"), ["unit", "speaker"]).join(all_.hint("merge"), "unit").where("na > n").withColumn("o", F.zip_with("sa", "s", lambda x, y: x - y))
    cos = lambda x, y: dot(x, y) / (norm(x) * norm(y))
    return j.select("unit", "speaker", r6(1 - cos("a", "b")).alias("moved"), (cos("b", "o") > cos("a", "o")).alias("converges"))


def displacement_summary(df: DataFrame) -> DataFrame:
    d = displacement(df)
    return d.groupBy("unit").agg(r6(F.avg("moved")).alias("mean_moved"), r6(F.avg(F.col("converges").cast("double"))).alias("converging")).join(gini(d, ["unit"], "moved"), "unit")


#: Units with more rows than this go through pivots and blocks, the others are compared row by row.
SMALL = 256


def _by_size(u: DataFrame, small: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of units of at most `small` rows, and those of larger ones (None if there are none)."""
    large = u.groupBy("unit").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > small).select("unit")
    if large.isEmpty():
        return u, None
    return u.join(large.hint("merge"), "unit", "left_anti"), u.join(large.hint("merge"), "unit", "left_semi")


def dispersion(df: DataFrame, small: int = SMALL, block: int = pv.BLOCK) -> DataFrame:
    """Per unit of unit vectors: mean pairwise cosine distance in closed form, the greatest one, mean distance to the centroid, and by how much
    the last turn is nearer to it than the mean. The greatest distance of units with more than `small` turns comes from blocks of `block` rows that pivots leave open."""
    u = df.withColumn("v", unit("v"))
    s = sum_vectors(u, ["unit"])
    g = s.select("unit", "n", r6(1 - ratio(dot("s", "s") - F.col("n"), F.col("n") * (F.col("n") - 1))).alias("pairwise"), "s")
    d = u.join(g.select("unit", "s").hint("merge"), "unit").withColumn("_c", 1 - ratio(dot("v", "s"), norm("s")))
    c = d.groupBy("unit").agg(r6(F.avg("_c")).alias("to_centroid"), r6(F.avg("_c") - F.max_by("_c", "turn_index")).alias("closing"))
    few, many = _by_size(u, small)
    b = few.select("unit", F.col("turn_index").alias("_t"), F.col("v").alias("_v"))
    far = few.join(b.hint("merge"), "unit").where(F.col("_t") < F.col("turn_index")).groupBy("unit").agg(r6(1 - F.min(dot("v", "_v"))).alias("greatest"))
    if many is not None:
        far = far.unionByName(pv.farthest(pv.blocks(many, size=block)).select("unit", r6(1 - F.col("least")).alias("greatest")))
    return g.drop("s").join(c.hint("merge"), "unit").join(far.hint("merge"), "unit", "left")


def dispersion_bands(stats: DataFrame, bands: list[tuple[int, int]]) -> DataFrame:
    """Means of dispersion rows over the units whose size lies in each band, which may overlap."""
    band = F.array(*(F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for lo, hi in bands))
    b = stats.withColumn("_b", F.explode(F.filter(band, lambda x: F.col("n").between(x["lo"], x["hi"]))))
    return b.groupBy(F.col("_b.lo").alias("low"), F.col("_b.hi").alias("high")).agg(F.count(F.lit(1)).alias("units"), *(r6(F.avg(c)).alias(c) for c in ("pairwise", "greatest", "to_centroid", "closing")))


def redundancy(df: DataFrame, least: float = 0.7, small: int = SMALL, block: int = pv.BLOCK) -> DataFrame:
    """Each turn's greatest cosine to an earlier one of its unit: mean, and share at or above `least`. Units with more than `small` turns go through blocks that pivots leave open."""
    u = df.withColumn("v", unit("v"))
    u, many = _by_size(u, small)
    b = u.select("unit", F.col("turn_index").alias("_t"), F.col("v").alias("_v"))
    m = u.join(b.hint("merge"), "unit").where(F.col("_t") < F.col("turn_index")).groupBy("unit", "turn_index").agg(F.max(dot("v", "_v")).alias("m"))
    if many is not None:
        m = m.unionByName(pv.nearest_earlier(pv.blocks(many, size=block)).select("unit", "turn_index", "m"))
    return m.groupBy("unit").agg(F.count(F.lit(1)).alias("turns"), r6(F.avg("m")).alias("mean_max"), r6(F.avg((F.col("m") >= least).cast("double"))).alias("redundant"))


def differentiation(df: DataFrame) -> DataFrame:
    """Mean cosine within speakers, and mean distance between speakers, both from vector sums."""
    u = df.withColumn("v", unit("v"))
    s = sum_vectors(u, ["unit", "speaker"]).withColumn("q", dot("s", "s"))
    w = s.groupBy("unit").agg(F.sum("q").alias("q"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("n2"))
    a = sum_vectors(u, ["unit"]).select("unit", dot("s", "s").alias("_all"))
    return w.join(a.hint("merge"), "unit").select("unit", r6(ratio(F.col("q") - F.col("n"), F.col("n2") - F.col("n"))).alias("within"), r6(1 - ratio(F.col("_all") - F.col("q"), F.col("n") * F.col("n") - F.col("n2"))).alias("between"))


def paired_table(scores: DataFrame, key: str, condition: str, reference: str, others: list[str], value: str) -> DataFrame:
    """One row a key, a column a condition, and each condition's difference from the reference."""
    p = scores.groupBy(key).pivot(condition, [reference, *others]).agg(F.avg(value))
    return p.select(key, *(r6(c).alias(c) for c in (reference, *others)), *(r6(F.col(c) - F.col(reference)).alias(f"{c}_minus_{reference}") for c in others))
