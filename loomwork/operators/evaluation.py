"""Metrics of pairs of rows, where a pair that cannot be measured is NaN, and criteria that a row must meet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.operators.stats import summary


def evaluated(pairs: DataFrame, a: str, b: str, metrics: dict[str, Column]) -> DataFrame:
    """The rows with a column for each metric. Pairs of arrays that are missing, empty or of different sizes get NaN."""
    fits = F.coalesce((F.size(a) == F.size(b)) & (F.size(a) > 0), F.lit(False))
    nan = F.lit(float("nan"))
    return pairs.withColumns({n: F.when(fits, F.coalesce(m.cast("double"), nan)).otherwise(nan) for n, m in metrics.items()})


def evaluation_summary(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """metric, mean, std, count over the pairs that could be measured."""
    return summary(rows, metrics)


def meets(*criteria: tuple[Column, float | None, float | None]) -> Column:
    """Whether every value is known, no NaN, and within its bounds (None: no bound)."""

    def holds(value: Column, low: float | None, high: float | None) -> Column:
        v = value.cast("double")
        okay = v.isNotNull() & ~F.isnan(v)
        if low is not None:
            okay = okay & (v >= low)
        return okay & (v <= high) if high is not None else okay

    return F.coalesce(reduce(lambda x, y: x & y, [holds(*c) for c in criteria], F.lit(True)), F.lit(False))
