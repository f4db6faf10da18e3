"""Arrays as chunks, blocks and pixels; compositing; colours of pixels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chunk(x: Column | str, size: int, pad: Column | None = None) -> Column:
    """An array as an array of chunks; the last is filled up with `pad`, or with the last element."""
    x = F.col(x) if isinstance(x, str) else x
    n = F.ceil(F.size(x) / size).cast("int")
    fill = F.element_at(x, -1) if pad is None else pad
    full = F.when(F.size(x) > 0, F.concat(x, F.array_repeat(fill, n * size - F.size(x)))).otherwise(x)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(full, i * size + 1, size))).otherwise(F.slice(F.array(x), 1, 0))


def unchunk(x: Column | str, total: Column | int) -> Column:
    """Chunks as one array of `total` elements."""
    return F.slice(F.flatten(x), 1, total)


def cells(df: DataFrame, keys: list[str], array: str, width: int) -> DataFrame:
    """keys, y, x, value of arrays that hold images row by row."""
    d = df.select(*keys, F.posexplode(array).alias("p_", "value"))
    return d.select(*keys, F.expr(f"p_ div {width}").cast("int").alias("y"), (F.col("p_") % width).alias("x"), "value")


def blocks(pixels: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """Pixels by tile: keys, by, bx and the place inside."""
    d = pixels.withColumn("by", F.expr(f"y div {height}").cast("int")).withColumn("bx", F.expr(f"x div {width}").cast("int"))
    return d.select(*keys, "by", "bx", (F.col("y") % height).alias("iy"), (F.col("x") % width).alias("ix"), "value")


def unblocks(tiles: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    return tiles.select(*keys, (F.col("by") * height + F.col("iy")).alias("y"), (F.col("bx") * width + F.col("ix")).alias("x"), "value")


def stacked(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Rows of a group as arrays of their columns, in order; for bounded groups."""
    g = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("r_"))
    return g.select(*keys, *[F.expr(f"transform(r_, r -> r.`{c}`)").alias(c) for c in columns])


def taken(df: DataFrame, columns: list[str], index: int) -> DataFrame:
    """One element of every array column; null beyond its end."""
    return df.select(*[F.get(c, F.lit(index)).alias(c) if c in columns else F.col(c) for c in df.columns])


def alpha_over(df: DataFrame, keys: list[str], depth: str, color: str, alpha: str) -> DataFrame:
    """keys, color, alpha of a pixel's layers (a few) laid over each other, the largest depth first."""
    g = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(depth, color, alpha)), asc=False).alias("l_"))
    start = F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("a"))
    over = F.aggregate("l_", start, lambda s, v: F.struct((v[color] * v[alpha] + s["c"] * (1 - v[alpha])).alias("c"), (v[alpha] + s["a"] * (1 - v[alpha])).alias("a")))
    return g.select(*keys, over.alias("o_")).select(*keys, F.col("o_.c").alias("color"), F.col("o_.a").alias("alpha"))


def visible_layers(pixels: DataFrame, image: list[str], layer: str, alpha: str, eps: float = 0.0) -> DataFrame:
    """Pixels of the layers that are anywhere above eps."""
    seen = pixels.groupBy(*image, layer).agg(F.max(alpha).alias("top_")).where(F.col("top_") > eps).drop("top_")
    return pixels.join(seen, [*image, layer], "left_semi")


def scatter_add(image: DataFrame, patch: DataFrame, keys: list[str], top: int, left: int, height: int, width: int) -> DataFrame:
    """keys, y, x, value of an image with a patch added at (top, left); pixels outside are dropped."""
    moved = patch.select(*keys, (F.col("y") + top).alias("y"), (F.col("x") + left).alias("x"), "value")
    moved = moved.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))
    return image.select(*keys, "y", "x", "value").unionByName(moved).groupBy(*keys, "y", "x").agg(F.sum("value").alias("value"))


def black_to_transparent(r: Column, g: Column, b: Column) -> Column:
    return F.when((r == 0) & (g == 0) & (b == 0), 0.0).otherwise(1.0)


def gaussian_kernel(size: int, my: float, mx: float, vyy: float, vyx: float, vxx: float, spark) -> DataFrame:
    """y, x, value of a normalised Gaussian over a grid centred at 0."""
    det = vyy * vxx - vyx * vyx
    d = spark.range(size * size).select(F.expr(f"id div {size}").alias("y"), F.expr(f"id % {size}").alias("x"))
    y, x = F.col("y") - (size - 1) / 2 - my, F.col("x") - (size - 1) / 2 - mx
    d = d.withColumn("e_", F.exp(-0.5 * (y * y * vxx - 2 * y * x * vyx + x * x * vyy) / det))
    return d.join(F.broadcast(d.agg(F.sum("e_").alias("s_")))).select("y", "x", (F.col("e_") / F.col("s_")).alias("value"))  # one row


def bayer_mosaic(y: Column, x: Column, r: Column, g: Column, b: Column, pattern: tuple[int, int, int, int] = (0, 1, 1, 2)) -> Column:
    """The colour that a pixel's filter lets through."""
    site = F.pmod(y, F.lit(2)) * 2 + F.pmod(x, F.lit(2))
    own = F.lit(None).cast("double")
    for k, c in enumerate(pattern):
        own = F.when(site == k, (r, g, b)[c]).otherwise(own)
    return own


def normalized_level(v: Column, black: float, white: float) -> Column:
    return F.greatest((v - black) / (white - black), F.lit(0.0))


def white_balanced(v: Column, y: Column, x: Column, neutral: tuple[float, float, float], pattern: tuple[int, int, int, int] = (0, 1, 1, 2)) -> Column:
    n = bayer_mosaic(y, x, *[F.lit(c) for c in neutral], pattern)
    return F.least(F.greatest(v / n, F.lit(0.0)), F.lit(1.0))


def linear_combination(channels: list[Column], matrix: list[list[float]], row_normalized: bool = False) -> list[Column]:
    """A colour matrix applied to channels."""
    rows = [[v / sum(r) for v in r] if row_normalized else r for r in matrix]
    return [sum((c * v for c, v in zip(channels, r, strict=True)), F.lit(0.0)) for r in rows]


def tone_polynomial(v: Column, coefficients: list[float]) -> Column:
    """A polynomial (highest power first), clipped to [0, 1]."""
    out = F.lit(0.0)
    for c in coefficients:
        out = out * v + c
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))


def inverse_depth(depth: Column, near: float = 0.1, far: float = float("inf")) -> Column:
    """Inverse depth scaled to [0, 1], near is 1."""
    lo = 0.0 if far == float("inf") else 1 / far
    return F.least(F.greatest((F.try_divide(F.lit(1.0), depth) - lo) / (1 / near - lo), F.lit(0.0)), F.lit(1.0))


#: The published polynomial of the Turbo colour map, red, green and blue, lowest power first (within 0.02 of its table).
TURBO = (
    (0.13572138, 4.61539260, -42.66032258, 132.13108234, -152.94239396, 59.28637943),
    (0.09140261, 2.19418839, 4.84296658, -14.18503333, 4.27729857, 2.82956604),
    (0.10667330, 12.64194608, -60.58204836, 110.36276771, -89.90310912, 27.34824973),
)
#: Depths outside of these (metres) aren't told apart in a picture.
NEAR, FAR = 0.1, 250.0


def turbo(level: Column) -> Column:
    """struct(r, g, b) from 0 to 1 of a level from 0 (blue) to 1 (red); levels outside are held at the ends."""
    v = F.least(F.greatest(level, F.lit(0.0)), F.lit(1.0))
    return F.struct(*[tone_polynomial(v, list(reversed(c))).alias(n) for n, c in zip("rgb", TURBO, strict=True)])


def depth_colours(cells: DataFrame, image: list[str], depth: str) -> DataFrame:
    """`cells` with r, g, b (bytes as ints) of inverse depth, scaled to what occurs in each image between NEAR and FAR; an image of one depth is blue."""
    inverse = F.try_divide(F.lit(1.0), F.col(depth))
    ends = cells.groupBy(*[F.col(c).alias(f"{c}_e_") for c in image]).agg(F.greatest(F.min(inverse), F.lit(1 / FAR)).alias("lo_"), F.least(F.max(inverse), F.lit(1 / NEAR)).alias("hi_"))
    d = cells.join(ends, [F.col(c).eqNullSafe(F.col(f"{c}_e_")) for c in image])
    level = F.when(F.col("hi_") > F.col("lo_"), (inverse - F.col("lo_")) / F.when(F.col("hi_") > F.col("lo_"), F.col("hi_") - F.col("lo_"))).otherwise(0.0)
    d = d.withColumn("c_", turbo(level))
    return d.select(*cells.columns, *[F.floor(F.col(f"c_.{n}") * 255).cast("int").alias(n) for n in "rgb"])


def inverse_combination(channels: list[Column], matrix: list[list[float]], row_normalized: bool = False) -> list[Column]:
    """The channels from which `linear_combination` would make these."""
    m = np.asarray(matrix, np.float64)
    if row_normalized:
        m = m / m.sum(axis=1, keepdims=True)
    return linear_combination(channels, np.linalg.inv(m).tolist())
