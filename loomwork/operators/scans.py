"""Prefix scans with a carried state, for any associative combination: no group is scanned by one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.operators.rank import _cuts, _range_of

Values = list[np.ndarray]
Combine = Callable[[Values, Values], Values]


def matrix_combine(later: Values, earlier: Values) -> Values:
    """2x2 matrices (a, b, c, d): the later one from the left."""
    a, b, c, d = later
    p, q, r, s = earlier
    return [a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s]


def sum_combine(later: Values, earlier: Values) -> Values:
    return [x + y for x, y in zip(later, earlier, strict=True)]


def _scan(values: Values, first: np.ndarray, combine: Combine) -> Values:
    """Prefixes within runs, by doubling: `first` has the place of each row's run. A row of ones counts its own place."""
    n, step = len(first), 1
    values = [v.copy() for v in values]
    at = np.arange(n)
    while step < n:
        i = np.flatnonzero(at - step >= first)
        if not len(i):
            break
        new = combine([v[i] for v in values], [v[i - step] for v in values])
        for v, x in zip(values, new, strict=True):
            v[i] = x
        step *= 2
    return values


def _scanned(d: DataFrame, runs: list[str], columns: list[str], combine: Combine) -> DataFrame:
    """`d`, whose partitions are in order, with each column replaced by its prefix within the run of equal `runs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last = None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            change = np.zeros(n, bool)
            for c in runs:
                codes = batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                change[1:] |= codes[1:] != codes[:-1]
            first = np.maximum.accumulate(np.where(change, np.arange(n), 0))
            values = _scan([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in columns], first, combine)
            if last is not None and last_key == [batch.column(c)[0].as_py() for c in runs]:
                i = np.flatnonzero(first == 0)
                new = combine([v[i] for v in values], [np.full(len(i), x) for x in last])
                for v, x in zip(values, new, strict=True):
                    v[i] = x
            last_key, last = [batch.column(c)[n - 1].as_py() for c in runs], [v[-1] for v in values]
            yield pa.record_batch([pa.array(values[columns.index(f.name)]) if f.name in columns else batch.column(f.name) for f in batch.schema], names=batch.schema.names)

    kinds = T.StructType([T.StructField(f.name, T.DoubleType()) if f.name in columns else f for f in d.schema])
    return d.mapInArrow(run, kinds)


def prefix_scan(df: DataFrame, keys: list[str], order: list[str], columns: list[str], combine: Combine, parts: int = 128, few: int = 32_768) -> DataFrame:
    """`df` with each of `columns` (doubles) replaced by the combination of its rows up to this one, in `order` within `keys`.

    Two levels: rows are cut into ranges of (keys, order) of about equal size, wherever groups begin,
    and each range is scanned on its own; the last rows of the ranges, at most one for each range and
    key, are scanned in the same way; then each range takes in what stands before it. So the largest
    group is spread over as many tasks as it fills ranges. (keys, order) must be a total order, without nulls in keys.
    """
    place = [*keys, *order]
    cuts = _cuts(df, place, parts, few)
    d = df.withColumn("range_", _range_of(df, place, cuts) if cuts else F.lit(0))
    local = d.repartition(max(1, len(cuts) + 1), "range_").sortWithinPartitions("range_", *place)
    local = _scanned(local, ["range_", *keys], columns, combine)
    if not cuts:
        return local.drop("range_")
    totals = local.groupBy("range_", *keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("t_")).select("range_", *keys, "t_.*")
    totals = _scanned(totals.repartition(*keys).sortWithinPartitions(*keys, "range_"), keys, columns, combine)
    # what stands before a range is the prefix of the range before it in which the key occurs
    before = Window.partitionBy(*keys).orderBy("range_")
    carry = totals.select(F.col("range_").alias("r_"), *[F.col(k).alias(f"k{i}_") for i, k in enumerate(keys)], *[F.lag(c).over(before).alias(f"c{i}_") for i, c in enumerate(columns)])
    on = [F.col("range_") == F.col("r_"), *[F.col(k) == F.col(f"k{i}_") for i, k in enumerate(keys)]]
    joined = local.join(F.broadcast(carry.where("c0_ IS NOT NULL")), on, "left")  # at most one row a range beside those that begin in it

    own = df.columns

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = np.flatnonzero(batch.column("c0_").is_valid().to_numpy(zero_copy_only=False))
            values = [batch.column(c).to_numpy(zero_copy_only=False).copy() for c in columns]
            new = combine([v[i] for v in values], [batch.column(f"c{k}_").to_numpy(zero_copy_only=False)[i] for k in range(len(columns))])
            for v, x in zip(values, new, strict=True):
                v[i] = x
            yield pa.record_batch([pa.array(values[columns.index(c)]) if c in columns else batch.column(c) for c in own], names=own)

    kinds = T.StructType([T.StructField(f.name, T.DoubleType()) if f.name in columns else f for f in df.schema])
    return joined.mapInArrow(carried, kinds)
