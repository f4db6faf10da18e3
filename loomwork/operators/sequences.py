"""Ordered operators: greedy clusters, neighbour gaps, running sums, matrix chains, tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def greedy_centres(values: Column, eps: float) -> Column:
    """Centres of greedy clusters of a sorted array of distinct values (of one row, so a short one).

    A cluster takes values up to 2 eps from its first one; its centre is the middle of its ends. The
    state keeps the open cluster apart, so closed ones are copied only when another one closes.
    """
    start = F.expr("struct(cast(array() AS array<double>) AS done, cast(null AS double) AS first, cast(null AS double) AS last)")

    def step(s: Column, v: Column) -> Column:
        joins = v - s["first"] <= 2 * eps
        done = F.when(joins | s["first"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array((s["first"] + s["last"]) / 2)))
        return F.struct(F.coalesce(done, s["done"]).alias("done"), F.when(joins, s["first"]).otherwise(v).alias("first"), v.alias("last"))

    end = lambda s: F.when(s["first"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array((s["first"] + s["last"]) / 2)))
    return F.aggregate(values, start, step, end)


def greedy_heads(df: DataFrame, group: list[str], value: str, eps: float, name: str = "head") -> DataFrame:
    """`df` (distinct values of each group) with the first value of each value's greedy cluster.

    A chain of clusters is sequential by nature, but a gap of more than 2 eps always starts a cluster, so
    chains are cut there. Rows stream through a task in order, by Spark's sort; only the chain and its last
    head are remembered, whatever the size of a group.
    """
    w = Window.partitionBy(*group).orderBy(value)
    d = df.withColumn("cut_", F.sum(F.when(F.col(value) - F.lag(value).over(w) <= 2 * eps, 0).otherwise(1)).over(w))
    d = d.withColumn("chain_", F.concat_ws("/", F.to_json(F.struct(*group)), F.col("cut_").cast("string")))
    d = d.repartition(*group, "cut_").sortWithinPartitions("chain_", value)
    at, chain_at = d.columns.index(value), d.columns.index("chain_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, head = None, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            v, chains = batch.column(at).to_numpy(), batch.column(chain_at).to_numpy(zero_copy_only=False)
            bounds = [0, *(np.flatnonzero(chains[1:] != chains[:-1]) + 1).tolist(), len(v)]
            heads = np.empty(len(v))
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                if chains[lo] != chain:
                    chain, head = chains[lo], float(v[lo])
                while lo < hi:
                    end = lo + int(np.searchsorted(v[lo:hi] - head, 2 * eps, side="right"))
                    heads[lo:end], lo = head, end
                    if lo < hi:
                        head = float(v[lo])
            yield pa.record_batch([*batch.columns, pa.array(heads)], names=[*batch.schema.names, name])

    return d.mapInArrow(run, T.StructType([*d.schema.fields, T.StructField(name, T.DoubleType())])).drop("cut_", "chain_")


def greedy_cluster(df: DataFrame, group: list[str], value: str, eps: float) -> DataFrame:
    """group, value, centre: each distinct value with its nearest centre (of ties the lower).

    The nearest centre is that of the value's own cluster or of the one before or after it.
    """
    v = F.col(value).cast("double")
    d = greedy_heads(df.select(*group, v.alias("v_")).where("v_ IS NOT NULL").distinct(), group, "v_", eps, "head_")
    centres = d.groupBy(*group, "head_").agg(((F.min("v_") + F.max("v_")) / 2).alias("own_"))
    w = Window.partitionBy(*group).orderBy("head_")
    centres = centres.select(*[F.col(g).alias(f"g{k}_") for k, g in enumerate(group)], F.col("head_").alias("h_"), F.array_compact(F.array(F.lag("own_").over(w), "own_", F.lead("own_").over(w))).alias("near_"))
    on = [F.col(g).eqNullSafe(F.col(f"g{k}_")) for k, g in enumerate(group)] + [F.col("head_") == F.col("h_")]
    near = F.array_min(F.transform("near_", lambda c: F.struct(F.abs(c - F.col("v_")).alias("d"), c.alias("c"))))
    return d.join(centres, on).select(*group, F.col("v_").alias(value), near["c"].alias("centre"))


def local_scales(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """group, value, scale: the smaller gap to a neighbour; at the ends the only one."""
    d = df.select(*group, value).distinct()
    w = Window.partitionBy(*group).orderBy(value)
    before, after = F.col(value) - F.lag(value).over(w), F.lead(value).over(w) - F.col(value)
    return d.withColumn("scale", F.least(F.coalesce(before, after), F.coalesce(after, before)))


#: The share of all interior points at first, and how often it is halved.
INTERIOR, HALVINGS = 0.4, 50


def mixture_weights(points: Column, middle: Column, interior: float = INTERIOR) -> Column:
    """Positive weights of a sorted array of points with mean `middle`; null if 50 halvings find none.

    Interior points share a mass that is halved until both ends are positive.
    """
    n = F.size(points)
    low, high = F.element_at(points, 1), F.element_at(points, -1)
    inner = F.slice(points, 2, F.greatest(n - 2, F.lit(0)))
    mean_inner = F.when(n > 2, F.aggregate(inner, F.lit(0.0), lambda s, v: s + v) / F.when(n > 2, n - 2)).otherwise(0.0)
    tries = F.transform(F.sequence(F.lit(0), F.lit(HALVINGS - 1)), lambda k: F.when(n > 2, interior / F.pow(F.lit(2.0), k)).otherwise(0.0))
    ends = F.transform(tries, lambda m: F.struct(m.alias("m"), (((1 - m) * high - (middle - m * mean_inner)) / (high - low)).alias("p0")))
    good = F.try_element_at(F.filter(ends, lambda e: (e["p0"] > 0) & (1 - e["m"] - e["p0"] > 0)), F.lit(1))
    each = good["m"] / F.when(n > 2, n - 2).otherwise(1)
    return F.when(good.isNotNull(), F.concat(F.array(good["p0"]), F.transform(inner, lambda v: each), F.array(1 - good["m"] - good["p0"])))


def running_before(df: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """The sum of the values of the rows before, 0 at the first."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)))


def integral_image(cells: DataFrame, image: list[str], row: str, col: str, value: str, name: str = "integral") -> DataFrame:
    """Two-dimensional prefix sums of cells."""
    w = Window.partitionBy(*image, row).orderBy(col).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*image, col).orderBy(row).rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("across_", F.sum(value).over(w)).withColumn(name, F.sum("across_").over(down)).drop("across_")


def matrix_product(steps: Column, first: Column | None = None) -> Column:
    """struct(a, b, c, d) of 2x2 matrices in an array of structs, the later ones from the left."""
    start = first if first is not None else F.struct(*[F.lit(v).alias(n) for n, v in zip("abcd", (1.0, 0.0, 0.0, 1.0), strict=True)])

    def times(m: Column, s: Column) -> Column:
        return F.struct((s["a"] * m["a"] + s["b"] * m["c"]).alias("a"), (s["a"] * m["b"] + s["b"] * m["d"]).alias("b"), (s["c"] * m["a"] + s["d"] * m["c"]).alias("c"), (s["c"] * m["b"] + s["d"] * m["d"]).alias("d"))

    return F.aggregate(steps, start, times)


def surface_chain(df: DataFrame, group: list[str], order: str, ior: str, curvature: str, thickness: str) -> DataFrame:
    """group and the ray-transfer matrix of its surfaces: refraction into `ior`, then `thickness`, in order.

    The index before a surface is that after the one before, 1 at the first. Chains are lens-sized.
    """
    w = Window.partitionBy(*group).orderBy(order)
    n1, n2 = F.coalesce(F.lag(ior).over(w), F.lit(1.0)), F.col(ior).cast("double")
    c0 = F.col(curvature) * (n1 - n2) / n2
    d0 = n1 / n2
    t = F.col(thickness).cast("double")
    step = F.struct(F.col(order).alias("o"), (1 + t * c0).alias("a"), (t * d0).alias("b"), c0.alias("c"), d0.alias("d"))
    s = df.withColumn("s_", step).groupBy(*group).agg(F.array_sort(F.collect_list("s_")).alias("s_"))
    return s.select(*group, matrix_product("s_").alias("m")).select(*group, "m.a", "m.b", "m.c", "m.d")


def joined_matrices(first: Column, second: Column, gap: Column, ior: float = 1.0) -> Column:
    """The matrix of `first`, a gap, and `second`."""
    move = F.struct(F.lit(1.0).alias("a"), (gap / ior).alias("b"), F.lit(0.0).alias("c"), F.lit(1.0).alias("d"))
    return matrix_product(F.array(first, move, second))


def focal_scalars(a: Column, b: Column, c: Column, d: Column) -> Column:
    """struct of a system's power, focal length and the distances of its focal and principal planes."""
    del b
    return F.struct((-c).alias("power"), F.try_divide(F.lit(-1.0), c).alias("efl"), F.try_divide(-a, c).alias("bfd"), F.try_divide(d, c).alias("ffd"), F.try_divide(1 - a, c).alias("bpp"), F.try_divide(d - 1, c).alias("fpp"))


def period_of(value: Column, bounds: list[float]) -> Column:
    """The number, from 0, of the first bound that is at least the value; null beyond the last."""
    out = F.lit(None).cast("int")
    for k, b in reversed(list(enumerate(bounds))):
        out = F.when(value <= b, k).otherwise(out)
    return out


def tile_starts(length: Column, crop: int) -> Column:
    """Starts of overlapping tiles at even steps, the last one at the end."""
    n = F.greatest(F.ceil(length / crop), F.lit(1))
    step = F.when(n > 1, (length - crop) / F.when(n > 1, n - 1)).otherwise(0)
    starts = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.least(F.ceil(i * step), F.greatest(length - crop, F.lit(0))).cast("long"))
    return F.array_distinct(starts)


def stitched(tiles: DataFrame, image: list[str], y: str, x: str, value: str) -> DataFrame:
    """Pixels of overlapping tiles as their means."""
    return tiles.groupBy(*image, y, x).agg(F.avg(value).alias(value))


def seeded_position(df: DataFrame, group: list[str], columns: list[str], seed: int) -> DataFrame:
    """Of each group one row, picked by the smallest hash: uniform among the valid positions."""
    h = F.sha2(F.concat_ws("/", F.lit(str(seed)), *[F.col(c).cast("string") for c in [*group, *columns]]).cast("binary"), 256)
    return df.groupBy(*group).agg(F.min_by(F.struct(*columns), h).alias("p_")).select(*group, "p_.*")


def pupil_positions(front_a: Column, front_b: Column, a: Column, b: Column, c: Column, d: Column) -> Column:
    """struct(entrance, exit): where the stop's images stand, from the matrix of what is before it and of what is after it.

    Before the stop (front_a, front_b) only the ray through its centre counts; null where an image is at infinity.
    """
    del a, c
    return F.struct(F.try_divide(front_b, front_a).alias("entrance"), F.when(F.abs(d) > 1e-12, F.try_divide(-b, d)).alias("exit"))
