"""Seeded sampling as columns: every draw is a SHA-256 uniform of its names, the same in any order of work."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.functions.columns import ColumnLike, _c, normal, uniform


def stratified(spark: SparkSession, seed: int, rows: int, cols: int, per_cell: int = 1, jitter: bool = True) -> DataFrame:
    """y, x, k, u, v: `per_cell` points of each cell of a grid over the unit square."""
    d = spark.range(rows * cols * per_cell)
    d = d.select(F.expr(f"id div {cols * per_cell}").alias("y"), F.expr(f"(id div {per_cell}) % {cols}").alias("x"), F.expr(f"id % {per_cell}").alias("k"))
    draw = lambda axis: uniform(F.lit(seed), F.lit(axis), "y", "x", "k") if jitter else F.lit(0.5)
    return d.select("y", "x", "k", ((F.col("y") + draw("v")) / rows).alias("v"), ((F.col("x") + draw("u")) / cols).alias("u"))


def disk_point(u: ColumnLike, v: ColumnLike) -> Column:
    """struct(x, y), uniform over the unit disk, of two uniforms."""
    r, a = F.sqrt(_c(u)), 2 * math.pi * _c(v)
    return F.struct((r * F.cos(a)).alias("x"), (r * F.sin(a)).alias("y"))


def square_to_disk(u: ColumnLike, v: ColumnLike) -> Column:
    """struct(x, y): the unit square mapped to the unit disk by wedges that keep areas and neighbours."""
    a, b = 2 * _c(u) - 1, 2 * _c(v) - 1
    wide = F.abs(a) > F.abs(b)
    r = F.when(wide, a).otherwise(b)
    turn = F.when(wide, math.pi / 4 * F.try_divide(b, a)).when(b != 0, math.pi / 2 - math.pi / 4 * F.try_divide(a, b)).otherwise(0.0)
    return F.struct((r * F.cos(turn)).alias("x"), (r * F.sin(turn)).alias("y"))


def weighted_choice(weights: Column, u: ColumnLike) -> Column:
    """The index, from 0, that a uniform picks from an array of weights."""
    total = F.aggregate(weights, F.lit(0.0), lambda s, w: s + w)
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("below"))
    point = _c(u) * total
    end = F.aggregate(weights, start, lambda s, w: F.struct((s["sum"] + w).alias("sum"), (s["below"] + F.when(s["sum"] + w <= point, 1).otherwise(0)).alias("below")))
    return F.least(end["below"], F.size(weights) - 1)


def noisy_choice(points: Column, scales: Column, weights: Column, low: ColumnLike, high: ColumnLike, alpha: float, *keys: ColumnLike) -> Column:
    """A weighted choice among points with normal noise of alpha times its local scale, clipped to [low, high]."""
    k = weighted_choice(weights, uniform(*keys, F.lit("choice")))
    return F.least(F.greatest(F.get(points, k) + alpha * F.get(scales, k) * normal(*keys, F.lit("noise")), _c(low)), _c(high))


def safe_uniform(low: ColumnLike, high: ColumnLike, u: ColumnLike) -> Column:
    """A number between low and high; their middle where the interval is empty."""
    lo, hi = _c(low), _c(high)
    return F.when(hi >= lo, lo + (hi - lo) * _c(u)).otherwise((lo + hi) / 2)


def affine_extent(a: ColumnLike, b: ColumnLike, height: ColumnLike, width: ColumnLike) -> Column:
    """Half the extent along one axis of a box under a row (a, b) of a linear map."""
    return (F.abs(_c(a)) * (_c(height) - 1) + F.abs(_c(b)) * (_c(width) - 1)) / 2


def patch_centre(height: ColumnLike, width: ColumnLike, patch: tuple[int, int], linear: tuple[ColumnLike, ColumnLike, ColumnLike, ColumnLike], *keys: ColumnLike) -> Column:
    """struct(y, x): a centre whose mapped patch stays inside the image; the middle if it can't."""
    ey, ex = affine_extent(linear[0], linear[1], *map(F.lit, patch)), affine_extent(linear[2], linear[3], *map(F.lit, patch))
    pick = lambda e, n, axis: safe_uniform(e, _c(n) - 1 - e, uniform(*keys, F.lit(axis)))
    return F.struct(pick(ey, height, "y").alias("y"), pick(ex, width, "x").alias("x"))


def crop_window(height: ColumnLike, width: ColumnLike, size: int, *keys: ColumnLike) -> Column:
    """struct(top, left) of a seeded crop; the same keys crop both images of a pair alike."""
    at = lambda n, axis: F.floor(uniform(*keys, F.lit(axis)) * (_c(n) - size + 1)).cast("int")
    return F.struct(at(height, "top").alias("top"), at(width, "left").alias("left"))


def augmentation(*keys: ColumnLike) -> Column:
    """struct(hflip, vflip, turn): seeded coin tosses."""
    toss = lambda name: uniform(*keys, F.lit(name)) < 0.5
    return F.struct(toss("hflip").alias("hflip"), toss("vflip").alias("vflip"), toss("turn").alias("turn"))


def rejected(candidates: DataFrame, keys: list[str], order: str, valid: Column, n: int) -> DataFrame:
    """The first n valid candidates of each group: rejection sampling as a filter and a rank."""
    w = Window.partitionBy(*keys).orderBy(order)
    return candidates.where(valid).withColumn("k_", F.row_number().over(w)).where(F.col("k_") <= n).drop("k_")


def point_scales(points: Column) -> Column:
    """Of a sorted array of distinct points each one's smaller gap to a neighbour; at the ends the only one, null for a single point."""
    gap = lambda i: F.try_element_at(points, i + 2) - F.get(points, i)
    return F.transform(points, lambda p, i: F.least(F.when(i > 0, gap(i - 1)), F.when(i < F.size(points) - 1, gap(i))))


def noisy_samples(df: DataFrame, points: str, weights: Column, low: float, high: float, alpha: float, n: int, *keys: ColumnLike) -> DataFrame:
    """`df` with k and sample: `n` weighted choices among each row's points, with normal noise of alpha times the point's own gap, clipped."""
    d = df.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return d.withColumn("sample", noisy_choice(F.col(points), F.transform(point_scales(F.col(points)), lambda s: F.coalesce(s, F.lit(0.0))), weights, F.lit(low), F.lit(high), alpha, *keys, "k"))
