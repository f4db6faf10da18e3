"""Work units that produce items: a generator for each (unit, cycle), and sources that stop at a target and can be resumed."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from loomwork.operators.rank import numbered
from loomwork.sources.shared import stored

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def unit_items(units: DataFrame, arguments: list[str], make: Callable[..., Iterator[tuple]], schema: str, arrow: bool = True) -> DataFrame:
    """The columns of `units` with each row that make(*arguments of the unit) yields.

    The generator runs once for each unit, keeps any state of its own and yields as many rows as it
    likes; a unit for which it yields nothing gives no row. It must give the same rows for the same
    arguments, since a lost task asks again. `arrow`: rows pass in Arrow batches.
    """

    class Produce:
        def eval(self, *given):
            yield from make(*given)

    table = F.udtf(Produce, returnType=schema, useArrow=arrow)
    return units.lateralJoin(table(*[F.col(a).outer() for a in arguments]))


def produce_until(units: DataFrame, key: str, arguments: list[str], make: Callable[..., Iterator[tuple]], schema: str, target: int, most_cycles: int = 100, most_failures: int = 3) -> tuple[DataFrame, DataFrame]:
    """Items, and failures, of units that are worked on cycle after cycle until there are `target` items.

    Within a cycle all units are computed side by side by make(*arguments, cycle) and committed in the
    order of `key`: the items are key, cycle, k (from 0) and the columns of `schema`, cut at the target in
    the order of (cycle, key, k), whichever task was first. A unit that raises commits nothing in that
    cycle, is a row (key, cycle, error) of the failures, and is tried again in the next one; one that
    fails `most_failures` times in a row ends the run with its error. Cycles are written one by one;
    after `most_cycles` what there is is returned. A unit's rows of one cycle must fit a task.
    """
    width = len(T.StructType.fromDDL(schema))

    class Produce:
        def eval(self, *given):
            try:
                rows = list(make(*given))
            except Exception as e:  # noqa: BLE001  a unit's failure is a result
                yield None, f"{type(e).__name__}: {e}", *[None] * width
                return
            for k, row in enumerate(rows):
                yield k, None, *row

    table = F.udtf(Produce, returnType=f"k int, error string, {schema}", useArrow=True)
    items, failures, total = [], [], 0
    own = units.select(key, *[c for c in arguments if c != key])
    streak = own.select(F.col(key).alias("s_key"), F.lit(0).alias("times"), F.lit("").alias("last")).where("false")
    for cycle in range(most_cycles):
        d = own.withColumn("cycle", F.lit(cycle))
        made = stored(d.lateralJoin(table(*[F.col(a).outer() for a in (*arguments, "cycle")])).drop(*[c for c in arguments if c != key]), "units-cycle")
        done, bad = made.where("error IS NULL").drop("error"), made.where("error IS NOT NULL").select(key, "cycle", "error")
        failures.append(bad)
        streak = stored(bad.join(streak.drop("last"), F.col(key) == F.col("s_key"), "left").select(F.col(key).alias("s_key"), (F.coalesce("times", F.lit(0)) + 1).alias("times"), F.col("error").alias("last")), "units-failed")
        gone = streak.where(F.col("times") >= most_failures).orderBy("s_key").first()
        if gone is not None:
            raise RuntimeError(f"unit {gone.s_key} failed {gone.times} times in a row: {gone.last}")
        n = done.count()
        if total + n >= target:
            items.append(numbered(done, [key, "k"], "rn_").where(F.col("rn_") <= target - total).drop("rn_"))
            break
        items.append(done)
        total += n
    return reduce(DataFrame.unionByName, items), reduce(DataFrame.unionByName, failures)


def item_id(unit: str, cycle: int, kind: str, k: int) -> str:
    """A name that is stable and unique over all units and cycles."""
    return f"c{cycle:03d}__{unit}__{kind}__{k:04d}"


def spaced_draws(unit: int, cycle: int, gap: float, most: int, tries: int) -> Iterator[tuple[str, int, float]]:
    """item, draw, value of pseudo-random draws from 0 to 100 that stand at least `gap` apart from the one accepted before."""
    x, last, n = (unit * 1009 + cycle * 9176 + 12345) % (1 << 31), None, 0
    for k in range(1, tries + 1):
        x = (1103515245 * x + 12345) % (1 << 31)
        value = x / (1 << 31) * 100
        if last is None or abs(value - last) >= gap:
            yield item_id(f"u{unit}", cycle, "draw", n), k, value
            last, n = value, n + 1
            if n == most:
                return


class UntilTarget(StatefulProcessor):
    """Takes what the units of a source produce, in the order of (cycle, unit), until the source's target is reached.

    The state of a source is its last cycle and unit and how many items it has accepted. Units that
    stand at or before that place were handled already (a file that is read again) and give no row.
    """

    def __init__(self, target: int):
        self.target = target

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "cycle int, unit long, accepted long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        cycle, unit, accepted = self.place.get() or (-1, -1, 0)
        if accepted >= self.target:
            return
        work = pd.concat(list(rows), ignore_index=True).sort_values(["cycle", "unit"])
        out = []
        for c, u, n in zip(work["cycle"].tolist(), work["unit"].tolist(), work["produced"].tolist(), strict=True):
            if (c, u) <= (cycle, unit) or accepted >= self.target:
                continue
            taken = min(n, self.target - accepted)
            cycle, unit, accepted = c, u, accepted + taken
            out.append((key[0], c, u, taken, accepted))
        self.place.update((cycle, unit, accepted))
        if out:
            yield pd.DataFrame(out, columns=["source", "cycle", "unit", "taken", "accepted"])

    def close(self) -> None:
        pass


def run_until_target(spark: SparkSession, folder: str, sink: str, checkpoint: str, target: int, files: int = 1) -> StreamingQuery:
    """Go on with the Parquet files of `folder` (source string, cycle int, unit long, produced long) that came since the last run.

    Writes source, cycle, unit, taken, accepted to `sink`. Where a run stopped is in the checkpoint: a
    new run takes the next files with the places and counts of all sources. Files hold whole cycles or
    later parts of one, in order; sources are handled side by side.
    """
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        units = spark.readStream.schema("source string, cycle int, unit long, produced long").option("maxFilesPerTrigger", files).parquet(folder)
        taken = units.groupBy("source").transformWithStateInPandas(UntilTarget(target), "source string, cycle int, unit long, taken long, accepted long", "Append", "None")

        def write(df: DataFrame, batch: int) -> None:
            df.write.mode("overwrite").parquet(f"{sink}/batch={batch}")

        return taken.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
