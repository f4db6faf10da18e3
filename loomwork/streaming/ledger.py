"""The item ledger and incremental runs: an append-only log of events, and the latest of each item counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "stage string, item string, status string, error string, at long"
STATUSES = ("done", "skipped", "failed")


def latest(log: DataFrame) -> DataFrame:
    """One row per stage and item: its last event. A done or skipped item has no error any more."""
    g = log.groupBy("stage", "item").agg(F.max_by(F.struct("status", "error"), "at").alias("l_"), F.max("at").alias("at"))
    return g.select("stage", "item", "l_.status", F.when(F.col("l_.status") == "failed", F.col("l_.error")).alias("error"), "at")


def marked(items: DataFrame, stage: str, status: str, at: int, error: str | None = None) -> DataFrame:
    """Events to append for the items."""
    if status not in STATUSES:
        raise ValueError(status)
    return items.select(F.lit(stage).alias("stage"), F.col("item").cast("string").alias("item"), F.lit(status).alias("status"), F.lit(error).cast("string").alias("error"), F.lit(at).cast("long").alias("at"))


def processable(log: DataFrame, stage: str) -> DataFrame:
    """Items that the next stages can take: done or skipped."""
    return latest(log.where(F.col("stage") == stage)).where(F.col("status").isin("done", "skipped")).select("item")


def skip_all_failed(log: DataFrame, stage: str, at: int) -> DataFrame:
    """Events that turn every failed item into a skipped one."""
    return marked(latest(log.where(F.col("stage") == stage)).where("status = 'failed'"), stage, "skipped", at)


def counts(log: DataFrame) -> DataFrame:
    """stage, done, skipped, failed."""
    return latest(log).groupBy("stage").agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def ready(log: DataFrame, needs: list[str], stage: str) -> DataFrame:
    """Items that all needed stages have done and this one has not handled (a failed one is tried again)."""
    now = latest(log.where(F.col("stage").isin([*needs, stage])))
    g = now.groupBy("item").agg(F.count_if(F.col("stage").isin(needs) & (F.col("status") == "done")).alias("n"), F.count_if((F.col("stage") == stage) & F.col("status").isin("done", "skipped")).alias("h"))
    return g.where((F.col("n") == len(set(needs))) & (F.col("h") == 0)).select("item").orderBy("item")


def is_complete(log: DataFrame, needs: list[str], stage: str) -> DataFrame:
    return ready(log, needs, stage).limit(1).agg((F.count("*") == 0).alias("complete"))


def run_once(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Process the files that came since the last run, once each, and append the results.

    The stream's checkpoint is the ledger of files. A batch that is run again after a failure writes
    to its own folder again, so nothing is doubled.
    """

    def write(df: DataFrame, batch: int) -> None:
        work(df).write.mode("overwrite").parquet(f"{sink}/batch={batch}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, window: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums of values by event-time window and type; works on streams and tables. An addition of ours."""
    ts = F.col("ts").cast("timestamp")
    d = events.withColumn("ts", ts)
    if d.isStreaming:
        d = d.withWatermark("ts", late)
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    g = d.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


def until_target(units: DataFrame, order: list[str], produced: str, cycles: int, target: int) -> DataFrame:
    """Cycles over units in order until the sum of what they produce reaches the target: cycle, unit columns, taken.

    The unit that passes the target is cut. What was produced before each (cycle, unit) is a running
    sum within one cycle plus the whole cycles before, so nothing is scanned once for each cycle.
    """
    from loomwork.operators.rank import numbered

    total = units.agg(F.coalesce(F.sum(produced), F.lit(0)).alias("t_"))
    u = numbered(units, order, "rn_")
    u = u.withColumn("part_", F.floor((F.col("rn_") - 1) / 65536))
    sums = u.groupBy("part_").agg(F.sum(produced).alias("in_")).select(F.col("part_").alias("p_"), F.coalesce(F.sum("in_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("off_"))
    inside = F.coalesce(F.sum(produced).over(Window.partitionBy("part_").orderBy("rn_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    u = u.withColumn("in_part_", inside).join(sums, F.col("part_") == F.col("p_")).join(F.broadcast(total))  # one row
    u = u.withColumn("cycle", F.explode(F.sequence(F.lit(0), F.lit(cycles - 1)))).withColumn("before_", F.col("cycle") * F.col("t_") + F.col("off_") + F.col("in_part_"))
    return u.where(F.col("before_") < target).select("cycle", *units.columns, F.least(F.col(produced), F.lit(target) - F.col("before_")).alias("taken"))


def cycles(units: DataFrame, n: str, name: str = "cycle") -> DataFrame:
    """Each unit once for each of its cycles 0 .. n - 1; a unit without cycles gives no row."""
    numbers = F.when(F.col(n) > 0, F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
    return units.withColumn(name, F.explode(numbers))
