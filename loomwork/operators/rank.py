"""Global numbering, normalisation and top-k without a task that sees all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PARTS = 128
_SAMPLE = 8_192
#: So many rows are numbered by one window: a fixed bound, so that small tables need no cuts.
_FEW = 32_768


def _cuts(df: DataFrame, order: list[str], parts: int, few: int = _FEW) -> list:
    """Up to parts - 1 rows that cut `df` into ranges of about equal size, in Spark's own order (nulls first, NaN last).

    A bounded sample comes to the driver; none of up to `few` rows.
    """
    n = df.count()
    if n <= few:
        return []
    rows = df.select(*order).sample(min(1.0, _SAMPLE / n), seed=1).orderBy(*order).limit(2 * _SAMPLE).distinct().orderBy(*order).collect()
    at = sorted({len(rows) * k // parts for k in range(1, parts)}) if rows else []
    return [rows[k] for k in at]


def _range_of(df: DataFrame, order: list[str], cuts: list) -> Column:
    """The number of the range of a row: a bisection over the cuts, in compiled comparisons."""
    key = F.struct(*order)
    kinds = [df.schema[c].dataType for c in order]

    def half(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        cut = F.struct(*[F.lit(v).cast(t).alias(c) for c, v, t in zip(order, cuts[mid], kinds, strict=True)])
        return F.when(key < cut, half(lo, mid)).otherwise(half(mid + 1, hi))

    return half(0, len(cuts))


def numbered(df: DataFrame, order: list[str], name: str = "rn", parts: int = _PARTS, few: int = _FEW) -> DataFrame:
    """Rows with their number, from 1, in the order of `order` (a total order; nulls first, NaN last).

    Rows are dealt to ranges; each range is numbered by a window of its own and moved by the rows of
    the ranges before it. The cuts are literals, so a lost task gives the same numbers again.
    """
    cuts = _cuts(df, order, parts, few)
    if not cuts:  # a bounded number of rows: one window
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
    d = df.withColumn("range_", _range_of(df, order, cuts))
    counts = d.groupBy("range_").agg(F.count("*").alias("in_range_"))
    before = F.coalesce(F.sum("in_range_").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("range_").alias("r_"), before.alias("before_"))
    own = F.row_number().over(Window.partitionBy("range_").orderBy(*order))
    d = d.withColumn("own_", own).join(F.broadcast(counts), F.col("range_") == F.col("r_"))  # `parts` rows at most
    return d.withColumn(name, (F.col("own_") + F.col("before_")).cast("long")).drop("range_", "r_", "own_", "before_")


def minmax_product(df: DataFrame, columns: list[str], name: str = "score") -> DataFrame:
    """The product of the columns, each scaled to [0, 1] over the whole table (a constant column is 0)."""
    ends = df.agg(*[f(c).cast("double").alias(f"{k}_{c}_") for c in columns for k, f in (("lo", F.min), ("hi", F.max))])
    scaled = [F.when(F.col(f"hi_{c}_") > F.col(f"lo_{c}_"), (F.col(c) - F.col(f"lo_{c}_")) / (F.col(f"hi_{c}_") - F.col(f"lo_{c}_"))).otherwise(F.col(c) * 0.0) for c in columns]
    out = df.join(F.broadcast(ends))  # one row
    return out.withColumn(name, reduce(lambda a, b: a * b, scaled)).drop(*ends.columns)


def top_k(df: DataFrame, score: str, ids: list[str], k: int) -> DataFrame:
    """The k rows with the largest scores; of ties the larger ids. Each task keeps k rows at most."""
    return df.orderBy(F.col(score).desc(), *[F.col(c).desc() for c in ids]).limit(k)


def ordered_cut(df: DataFrame, order: list[str], target: int, known: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """The first `target` rows in order, leaving out rows whose key is known."""
    if known is not None:
        df = df.join(known.select(key), key, "left_anti")
    return df.orderBy(*order).limit(target)


def chunked(df: DataFrame, order: list[str], size: int, name: str = "chunk") -> DataFrame:
    """The number, from 0, of the run of `size` rows that a row is in."""
    return numbered(df, order, "rn_").withColumn(name, F.floor((F.col("rn_") - 1) / size).cast("long")).drop("rn_")


def keep_newest(df: DataFrame, group: list[str], order: list[str], n: int) -> DataFrame:
    """The n last rows of each group in the order of `order`."""
    w = Window.partitionBy(*group).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("rn_", F.row_number().over(w)).where(F.col("rn_") <= n).drop("rn_")


def unique_keep_order(df: DataFrame, column: str, order: str) -> DataFrame:
    """Distinct values in the order of their first rows."""
    return df.groupBy(column).agg(F.min(order).alias("first_order")).orderBy("first_order", column)


def best_chunk_size(n: int, most: int, spark, alpha: float = 1.0) -> DataFrame:
    """The chunk size up to `most` with the least padding of n (per alpha); of ties the larger size."""
    sizes = spark.range(1, most + 1).select(F.col("id").alias("size"))
    waste = (F.ceil(F.lit(n) / F.col("size")) * F.col("size") - n) * alpha + F.ceil(F.lit(n) / F.col("size"))
    return sizes.select("size", waste.cast("double").alias("score")).orderBy("score", F.col("size").desc()).limit(1)


def best_grid(n: int, ratio: float, spark, band: float = 4.0) -> DataFrame:
    """rows, columns of a grid for n items whose shape is near `ratio` with few empty cells."""
    g = spark.range(1, n + 1).select(F.col("id").alias("rows"), F.ceil(F.lit(n) / F.col("id")).alias("columns"))
    shape = F.abs(F.ln(F.col("columns") / F.col("rows") / ratio))
    empty = F.col("rows") * F.col("columns") - n
    return g.where(shape <= F.lit(band)).select("rows", "columns", (shape + empty / n).alias("score")).orderBy("score", "rows").limit(1)


def dictionary(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """The distinct values of the columns with code (from 0, in their order), first (the least `order`) and n (rows)."""
    g = df.groupBy(*columns).agg(F.min(order).alias("first"), F.count("*").alias("n"))
    return numbered(g, columns, "code").withColumn("code", F.col("code") - 1)


def expanded(df: DataFrame, words: DataFrame, columns: list[str]) -> DataFrame:
    """`df` with what its dictionary says of its values."""
    w = words.select(*[F.col(c).alias(f"{c}_w_") for c in columns], *[c for c in words.columns if c not in columns])
    on = [F.col(c).eqNullSafe(F.col(f"{c}_w_")) for c in columns]
    return df.join(w, on).drop(*[f"{c}_w_" for c in columns])
