"""Pixels by index: affine gathers, montages, padding and picks under a mask, as maps between cells and equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.columns import uniform


def patch_coordinates(patches: DataFrame, height: int, width: int, centre: tuple[str, str], linear: tuple[str, str, str, str]) -> DataFrame:
    """`patches` with i, j and the source place (sy, sx) of every pixel of a height x width patch.

    `linear` maps offsets from the patch's middle to offsets from `centre` in the source:
    sy = cy + a v + b u and sx = cx + c v + d u, for v = i - (height - 1) / 2 and u = j - (width - 1) / 2.
    """
    (cy, cx), (a, b, c, d) = centre, linear
    p = patches.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    v, u = F.col("i") - (height - 1) / 2, F.col("j") - (width - 1) / 2
    return p.withColumns({"sy": F.col(cy) + F.col(a) * v + F.col(b) * u, "sx": F.col(cx) + F.col(c) * v + F.col(d) * u})


def _bounded(at: Column, n: Column, border: str) -> Column:
    """An index outside 0 .. n - 1 by the border's rule; null where the border is constant."""
    if border == "constant":
        return F.when((at >= 0) & (at < n), at)
    if border == "nearest":
        return F.greatest(F.lit(0), F.least(at, n - 1))
    if border == "wrap":
        return F.pmod(at, n)
    if border == "mirror":  # about the middle of the last pixel
        period = F.greatest(2 * (n - 1), F.lit(1))
        m = F.pmod(at, period)
        return F.least(m, period - m)
    raise ValueError(border)


def gathered(coordinates: DataFrame, cells: DataFrame, image: list[str], height: Column | int, width: Column | int, keys: list[str], border: str = "constant", fill: float = 0.0, order: int = 1) -> DataFrame:
    """keys, i, j, value: cells (image, y, x, value) at the places (sy, sx), bilinear (order 1) or nearest (order 0).

    Each place asks for the four cells around it, with weights; they meet the cells in one equi-join on
    whole coordinates and are summed by pixel. `border`: constant (cells outside are `fill`), nearest, wrap
    or mirror.
    """
    h, w = (F.lit(x) if isinstance(x, int) else x for x in (height, width))
    if order == 0:
        corners = F.array(F.struct(F.floor(F.col("sy") + 0.5).alias("y"), F.floor(F.col("sx") + 0.5).alias("x"), F.lit(1.0).alias("weight")))
    else:
        y, x = F.floor("sy"), F.floor("sx")
        fy, fx = F.col("sy") - y, F.col("sx") - x
        corners = F.array(*[F.struct((y + dy).alias("y"), (x + dx).alias("x"), ((fy if dy else 1 - fy) * (fx if dx else 1 - fx)).alias("weight")) for dy in (0, 1) for dx in (0, 1)])
    asked = coordinates.select(*keys, *[c for c in image if c not in keys], "i", "j", h.alias("h_"), w.alias("w_"), F.inline(corners))
    asked = asked.where("weight <> 0").withColumns({"y_": _bounded(F.col("y"), F.col("h_"), border), "x_": _bounded(F.col("x"), F.col("w_"), border)})
    own = cells.select(*[F.col(c).alias(f"{c}_o_") for c in image], F.col("y").alias("oy_"), F.col("x").alias("ox_"), F.col("value").alias("value_"))
    on = [F.col(c) == F.col(f"{c}_o_") for c in image] + [F.col("y_") == F.col("oy_"), F.col("x_") == F.col("ox_")]
    return asked.join(own, on, "left").groupBy(*keys, "i", "j").agg(F.sum(F.col("weight") * F.coalesce("value_", F.lit(float(fill)))).alias("value"))


def montage(tiles: DataFrame, group: list[str], height: int, width: int, columns: int, border: int = 0, colour: float = 0.0) -> DataFrame:
    """group, y, x, value of one picture for each group: its tiles (k from 0, y, x, value) in rows of `columns`, with borders around.

    Every cell of the picture looks for its cell in a tile; borders, empty places and missing cells have the colour.
    """
    step_y, step_x = height + border, width + border
    size = tiles.groupBy(*group).agg(F.max("k").alias("last_")).withColumn("rows_", F.floor(F.col("last_") / columns) + 1)
    out = size.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows_") * step_y + border - 1)))
    out = out.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(columns * step_x + border - 1).cast("long"))))
    iy, ix = F.col("y") % step_y - border, F.col("x") % step_x - border
    k = F.floor(F.col("y") / step_y) * columns + F.floor(F.col("x") / step_x)
    inside = (iy >= 0) & (ix >= 0)
    out = out.select(*group, "y", "x", F.when(inside, k).alias("k_"), F.when(inside, iy).alias("iy_"), F.when(inside, ix).alias("ix_"))
    own = tiles.select(*[F.col(c).alias(f"{c}_o_") for c in group], F.col("k").alias("ok_"), F.col("y").alias("oy_"), F.col("x").alias("ox_"), F.col("value").alias("value_"))
    on = [F.col(c).eqNullSafe(F.col(f"{c}_o_")) for c in group] + [F.col("k_") == F.col("ok_"), F.col("iy_") == F.col("oy_"), F.col("ix_") == F.col("ox_")]
    return out.join(own, on, "left").select(*group, "y", "x", F.coalesce("value_", F.lit(float(colour))).alias("value"))


def padded_to_multiple(cells: DataFrame, image: list[str], multiple: int) -> DataFrame:
    """image, y, x, value, own: images filled up below and right to a multiple of both sides, mirrored about the last row and column.

    Each cell goes to its own place and to the mirrored ones by its image's size. `own` marks the cells of the image itself: where(own) crops a result back. A side too short to be mirrored so far raises when evaluated.
    """
    size = cells.groupBy(*[F.col(c).alias(f"{c}_o_") for c in image]).agg((F.max("y") + 1).alias("h_"), (F.max("x") + 1).alias("w_"))
    full = lambda n: F.ceil(F.col(n) / multiple) * multiple
    bad = (full("h_") > 2 * F.col("h_") - 1) | (full("w_") > 2 * F.col("w_") - 1)
    size = size.where(F.when(bad, F.raise_error(F.lit("an image is too small to be mirrored")).cast("boolean")).otherwise(True))
    own = cells.select(*image, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "value").where("y >= 0 AND x >= 0")
    # cells become more rows only behind the join, and no size of its sides makes it a broadcast
    d = own.join(size.hint("merge"), [F.col(c) == F.col(f"{c}_o_") for c in image])

    def places(at: str, n: str) -> Column:
        mirrored = 2 * (F.col(n) - 1) - F.col(at)
        return F.explode(F.when((mirrored >= F.col(n)) & (mirrored < full(n)), F.array(F.col(at), mirrored)).otherwise(F.array(at)))

    d = d.withColumn("y", places("y", "h_")).withColumn("x", places("x", "w_"))
    return d.select(*image, "y", "x", "value", ((F.col("y") < F.col("h_")) & (F.col("x") < F.col("w_"))).alias("own"))


def eroded(mask: DataFrame, image: list[str], valid: str, down: int, across: int) -> DataFrame:
    """`mask` with eroded: whether all cells within `down` rows and `across` columns are there and valid.

    Minima slide along rows, then along columns; each window is as long as its rectangle, whatever the image's size.
    """
    good = F.col(valid).cast("int")
    row = Window.partitionBy(*image, "y").orderBy("x").rangeBetween(-across, across)
    column = Window.partitionBy(*image, "x").orderBy("y").rangeBetween(-down, down)
    d = mask.withColumn("row_ok_", F.when(F.count("*").over(row) == 2 * across + 1, F.min(good).over(row)).otherwise(0))
    ok = (F.count("*").over(column) == 2 * down + 1) & (F.min("row_ok_").over(column) == 1)
    return d.withColumn("eroded", F.coalesce(ok, F.lit(False))).drop("row_ok_")


def eroded_pick(mask: DataFrame, image: list[str], valid: str, down: int, across: int, *seed: Column) -> DataFrame:
    """image, y, x, found: of each image one cell of the eroded mask, every one with the same chance; null without any.

    Each valid cell draws a number from the seed and its place, and the largest one wins.
    """
    draw = uniform(*seed, *image, "y", "x")
    d = eroded(mask, image, valid, down, across)
    g = d.groupBy(*image).agg(F.max_by(F.struct("y", "x"), F.when(F.col("eroded"), draw)).alias("p_"))
    return g.select(*image, "p_.y", "p_.x", F.col("p_").isNotNull().alias("found"))


def augmented(y: Column, x: Column, height: Column | int, width: Column | int, hflip: Column, vflip: Column, turn: Column) -> Column:
    """struct(y, x): where a pixel goes when its image is flipped left to right, upside down, and then transposed, as the flags say."""
    fy = F.when(vflip, height - 1 - y).otherwise(y)
    fx = F.when(hflip, width - 1 - x).otherwise(x)
    return F.struct(F.when(turn, fx).otherwise(fy).alias("y"), F.when(turn, fy).otherwise(fx).alias("x"))


def oriented(y: Column, x: Column, height: Column | int, width: Column | int, code: Column) -> Column:
    """struct(y, x): where a pixel goes when an image stored with an orientation code (1 to 8) is put upright; other codes change nothing.

    2 and 4 are mirrored left to right and upside down, 3 is turned by half, 5 is transposed, 6 is turned clockwise, 7 is transposed
    about the other diagonal, 8 is turned counter-clockwise.
    """
    right, down = width - 1 - x, height - 1 - y
    places = {2: (y, right), 3: (down, right), 4: (down, x), 5: (x, y), 6: (x, down), 7: (right, down), 8: (right, y)}
    oy, ox = y, x
    for k, (ny, nx) in places.items():
        oy, ox = F.when(code == k, ny).otherwise(oy), F.when(code == k, nx).otherwise(ox)
    return F.struct(oy.alias("y"), ox.alias("x"))
