"""Operator 10: mix sources to target weights by a low-discrepancy schedule.

Every source's documents are shuffled into one stream of words, cut into blocks of equal length. The
schedule has as many slots as the targets hold blocks. Slot t has the point frac((t + 1) * golden
ratio), which falls into one source's share of the unit interval; the r-th slot of a source takes the
r-th block of its stream, which starts anew at its end. The points are spread so evenly that every
prefix of the schedule holds each source in its proportion, to within a few blocks. What a source
gives is what its slots take: the first words of its stream, one block for each of its slots, up to
the number of times that a document may be taken. So taken words are near the targets, within a few
blocks of BLOCK words, and a mix that is read in the order of its slots is even all along.

Ranks are counted in chunks of slots (a count for each chunk and source, a running sum over chunks, a
row number inside a chunk), so that a source with a third of all slots is never numbered by one task;
positions in a stream are found alike. A document asks the schedule only for its first and last slot.

Edge cases: a null or empty text has size 0 and is taken 0 times, without slots; a null source is a
source of its own, after all others; a null doc_id is reported as any other; an empty table gives an
empty result; repeated rows are documents of their own (rows that are equal in doc_id and size share
places at random, with equal results as a multiset); other columns of the input are ignored, whatever
their names.
"""

from __future__ import annotations

import math
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.shared import fresh, numbered, written

WORD = r"[^\x20\x09-\x0D]+"

#: Weights of the sources in order of their names, repeated.
WEIGHTS = (3, 1, 2)
#: The mix holds this share of all words, and a source at most so many times its own words.
SHARE, REPEATS = 1.5, 2.0
#: Words in a block; slots of a chunk.
BLOCK, CHUNK = 32, 1 << 16
_GOLDEN = (Decimal(5).sqrt() - 1) / 2
#: The golden ratio, and the fraction of 2**20 times it: slots far out keep their precision.
GOLDEN, FAR = float(_GOLDEN), float(_GOLDEN * (1 << 20) % 1)


def sized(docs: DataFrame, row: Column) -> DataFrame:
    """row, doc_id, source and the number of words of each text (null: 0)."""
    return docs.select(
        row.alias("row"),
        "doc_id",
        "source",
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """source, source_size, target: the shares by weight, limited to `repeats` times a source's size.

    Resharing what the limited sources leave, again and again, ends where every source has
    min(limit, weight * level) for one level. In order of limit / weight the level is where the
    running sums meet. One row for each source; the table of sources is small by nature.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("w", w)
    s = s.withColumn("lim", F.col("source_size") * F.lit(repeats))
    order = Window.orderBy(F.col("lim") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = s.withColumn("left", F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("lim").over(before), F.lit(0.0)))
    s = s.withColumn("open", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("fair", F.col("w") * F.col("left") / F.col("open"))
    # the first source in this order whose fair part is within its limit sets the level for it and all after it
    level = F.when(F.col("fair") <= F.col("lim"), F.col("left") / F.col("open"))
    s = s.withColumn("level", F.first(level, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.coalesce(F.least(F.col("lim"), F.col("w") * F.col("level")), F.col("lim"))
    return s.select("source", "source_size", target.cast("double").alias("target"))


def _running(df: DataFrame, key: list[str], chunk: str, order: list, value: F.Column, name: str) -> DataFrame:
    """A running sum of `value` before each row, within `key` in the order of chunk and then `order`."""
    sums = df.groupBy(*key, chunk).agg(F.sum(value).alias("in_chunk"))
    over = Window.partitionBy(*key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"k_{k}") for k in (*key, chunk)], F.coalesce(F.sum("in_chunk").over(over), F.lit(0)).alias("before"))
    on = [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in (*key, chunk)]
    inside = Window.partitionBy(*key, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return df.join(sums, on).withColumn(name, F.col("before") + F.col("inside")).drop("inside", "before", *[f"k_{k}" for k in (*key, chunk)])


def points(targets: DataFrame, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """slot, chunk, source: the source in whose share the point of each slot falls."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    t = targets.withColumn("hi", F.sum("target").over(order)).withColumn("lo", F.col("hi") - F.col("target")).withColumn("total", F.sum("target").over(Window.partitionBy()))
    n = int(targets.agg(F.coalesce(F.ceil(F.sum("target") / block), F.lit(0))).first()[0])
    rows = t.where("target > 0").select("source", (F.col("lo") / F.col("total")).alias("lo"), (F.col("hi") / F.col("total")).alias("hi"))
    point = F.expr(f"pmod(((id + 1) div 1048576) * {FAR!r}D + ((id + 1) % 1048576) * {GOLDEN!r}D, 1.0D)")
    slots = targets.sparkSession.range(n).select(F.col("id").alias("slot"), point.alias("point"), F.floor(F.col("id") / chunk).alias("chunk"))
    # equal-width cells of the unit interval turn the search for a share into an equi-join; the last share is open above
    cells = 256
    spread = rows.withColumn("hi", F.when(F.col("hi") > 1 - 1e-12, 2.0).otherwise(F.col("hi")))
    spread = spread.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.floor(F.least(F.col("hi"), F.lit(0.9999999999)) * cells))))
    return slots.withColumn("cell", F.floor(F.col("point") * cells)).join(spread, "cell").where("point >= lo AND point < hi").select("slot", "chunk", "source")


def schedule(targets: DataFrame, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """slot, source, rank: the source of each slot and how many slots that source had before."""
    ranked = _running(points(targets, block, chunk), ["source"], "chunk", ["slot"], F.lit(1), "rank")
    return ranked.select("slot", "source", F.col("rank").cast("long").alias("rank"))


def streamed(sizes: DataFrame, targets: DataFrame, repeats: float = REPEATS, block: int = BLOCK, seed: int = 17) -> DataFrame:
    """The columns of `sizes` and source_size, target, place (in the source's stream; of size 0: null), words (that the source's slots take)."""
    given = points(targets, block).groupBy("source").agg(F.count("*").alias("n")).select(F.col("source").alias("g_source"), "n")
    t = targets.withColumnRenamed("source", "t_source").join(given, F.col("t_source").eqNullSafe(F.col("g_source")), "left")
    t = t.select("t_source", "source_size", "target", F.least(F.coalesce("n", F.lit(0)) * block, F.floor(F.col("source_size") * F.lit(repeats))).alias("words"))
    d = sizes.where("size > 0").withColumn("h", F.xxhash64("doc_id", F.lit(seed))).withColumn("bucket", F.shiftright("h", 52))
    d = _running(d, ["source"], "bucket", ["h", "doc_id", "size", "row"], F.col("size"), "place").drop("h", "bucket")
    d = d.unionByName(sizes.where("size = 0").withColumn("place", F.lit(None).cast("long")))
    return d.join(t, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")


def _copies(repeats: float, body) -> Column:
    """An array of body(first word in the stream of the document's e-th copy), e = 0, 1 ..."""
    return F.array(*[body(F.col("place") + e * F.col("source_size")) for e in range(math.ceil(repeats))])


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words that the mix takes) and first_slot, last_slot of every document."""
    d, targets = _taken(sized(docs, F.monotonically_increasing_id()), weights, share, repeats, block)
    d, slots = written(d, "mix-taken"), schedule(targets, block)
    asked = d.where("taken > 0").select("row", F.col("source").alias("a_source"), F.explode(F.array(F.expr(f"place div {block}"), F.expr(f"last div {block}"))).alias("a_rank"))
    found = asked.join(slots, F.col("a_source").eqNullSafe(F.col("source")) & (F.col("a_rank") == F.col("rank")))
    found = found.groupBy(F.col("row").alias("f_row")).agg(F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"))
    out = d.join(found, F.col("row") == F.col("f_row"), "left")
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", "first_slot", "last_slot")


def _taken(sizes: DataFrame, weights: tuple[int, ...], share: float, repeats: float, block: int) -> tuple[DataFrame, DataFrame]:
    """`streamed` with taken, last (the last word taken, by its place) and copies (those of which half is taken), and the targets."""
    sizes = written(sizes, "mix-sizes")
    targets = written(source_targets(sizes, weights, share, repeats), "mix-targets")
    d = streamed(sizes, targets, repeats, block)
    part = lambda at: F.greatest(F.lit(0), F.least(F.col("words") - at, F.col("size")))
    taken = F.coalesce(reduce(lambda a, b: a + b, [part(F.col("place") + e * F.col("source_size")) for e in range(math.ceil(repeats))]), F.lit(0)).cast("long")
    last = F.array_max(_copies(repeats, lambda at: F.when(at < F.col("words"), F.least(at + F.col("size"), F.col("words")) - 1)))
    copies = F.size(F.filter(_copies(repeats, lambda at: 2 * part(at) >= F.col("size")), lambda x: x))
    return d.withColumns({"taken": taken, "last": last, "copies": F.when(F.col("size") > 0, copies).otherwise(0)}), targets


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS, block: int = BLOCK) -> DataFrame:
    """The documents of the mix, with the columns of the input: each row as often as its source's slots take half of it or more.

    Only one document of each source is cut, so the words of the copies stay near the targets.
    """
    docs, row = numbered(docs, "mix-rows")
    taken, _ = _taken(sized(docs, F.col(row)), weights, share, repeats, block)
    own, times, copy = fresh(docs, "own_"), fresh(docs, "times_"), fresh(docs, "copy_")
    taken = taken.where("copies > 0").select(F.col("row").alias(own), F.col("copies").alias(times))
    out = docs.join(taken, F.col(row) == F.col(own))
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).drop(row, own, times, copy)
