"""Aggregates: finite-only summaries, weighted moments, image errors, status counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(c: str | Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def long_form(df: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    """ids, metric, value."""
    return df.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(ids, metrics, "metric", "value")


def summary(df: DataFrame, metrics: list[str]) -> DataFrame:
    """metric, mean, std (population), count over finite values; NaN, NaN, 0 without any."""
    long = long_form(df, [], metrics)
    v = finite("value")
    nan = F.lit(float("nan"))
    return long.groupBy("metric").agg(F.coalesce(F.avg(v), nan).alias("mean"), F.coalesce(F.stddev_pop(v), nan).alias("std"), F.count(v).alias("count"))


def metric_means(df: DataFrame, keys: list[str], metric: str, value: str) -> DataFrame:
    """keys, metric, value: means of the finite values; groups without any are left out."""
    return df.groupBy(*keys, metric).agg(F.avg(finite(F.col(value).cast("double"))).alias("value")).where("value IS NOT NULL")


def parsed_means(df: DataFrame, metrics: list[str]) -> DataFrame:
    """metric, value: means over the cells that are finite numbers; text cells are tried as numbers."""
    long = df.select(*[F.col(m).cast("string").try_cast("double").alias(m) for m in metrics]).unpivot([], metrics, "metric", "value")
    return long.groupBy("metric").agg(F.avg(finite("value")).alias("value")).where("value IS NOT NULL")


def weighted_mean(x: str | Column, w: str | Column) -> Column:
    """Aggregate: sum(x w) / sum(w), and sum(x w) where all weights are 0."""
    x, w = (F.col(c) if isinstance(c, str) else c for c in (x, w))
    return F.sum(x * w) / F.when(F.sum(w) == 0, 1.0).otherwise(F.sum(w))


def weighted_rms(d2: str | Column, w: str | Column) -> Column:
    """Aggregate: the root of the weighted mean of squared distances."""
    return F.sqrt(weighted_mean(d2, w))


def best_focus(df: DataFrame, keys: list[str], pos: list[str], direction: list[str], weight: str) -> DataFrame:
    """keys, z: the plane in which rays pos + t * direction are closest together, by weighted moments.

    One pass of centred sums: with slopes s = d / d_z, the variance of x + z s is least at
    z = -cov(x, s) / var(s).
    """
    w = F.col(weight)
    sums = []
    for k in (0, 1):
        s, x = F.col(direction[k]) / F.col(direction[2]), F.col(pos[k]) - F.col(pos[2]) * F.col(direction[k]) / F.col(direction[2])
        sums += [F.sum(w * x * s).alias(f"xs{k}"), F.sum(w * x).alias(f"x{k}"), F.sum(w * s).alias(f"s{k}"), F.sum(w * s * s).alias(f"ss{k}")]
    g = df.groupBy(*keys).agg(F.sum(w).alias("w_"), *sums)
    cov = sum(F.col(f"xs{k}") - F.col(f"x{k}") * F.col(f"s{k}") / F.col("w_") for k in (0, 1))
    var = sum(F.col(f"ss{k}") - F.col(f"s{k}") * F.col(f"s{k}") / F.col("w_") for k in (0, 1))
    return g.select(*keys, F.try_divide(-cov, var).alias("z"))


def line_intersection(df: DataFrame, keys: list[str], point: list[str], unit: list[str], weight: str | None = None, ridge: float = 0.0) -> DataFrame:
    """keys, x, y, z: the point nearest to all lines in least squares, from the sums of the normal equations."""
    w = F.col(weight) if weight else F.lit(1.0)
    p, u = [F.col(c) for c in point], [F.col(c) for c in unit]
    m = lambda i, j: (1.0 if i == j else 0.0) - u[i] * u[j]
    sums = [F.sum(w * m(i, j)).alias(f"a{i}{j}") for i in range(3) for j in range(i, 3)]
    sums += [F.sum(w * (m(i, 0) * p[0] + m(i, 1) * p[1] + m(i, 2) * p[2])).alias(f"b{i}") for i in range(3)]
    g = df.groupBy(*keys).agg(*sums)
    a = {(i, j): F.col(f"a{min(i, j)}{max(i, j)}") + (ridge if i == j else 0.0) for i in range(3) for j in range(3)}
    b = [F.col(f"b{i}") for i in range(3)]
    minor = lambda c: c[0][0] * (c[1][1] * c[2][2] - c[1][2] * c[2][1]) - c[0][1] * (c[1][0] * c[2][2] - c[1][2] * c[2][0]) + c[0][2] * (c[1][0] * c[2][1] - c[1][1] * c[2][0])
    det = minor([[a[i, j] for j in range(3)] for i in range(3)])
    solved = [F.try_divide(minor([[b[i] if j == k else a[i, j] for j in range(3)] for i in range(3)]), det) for k in range(3)]
    return g.select(*keys, *[s.alias(n) for s, n in zip(solved, "xyz", strict=True)])


def centroid(cells: DataFrame, keys: list[str], y: str, x: str, value: str) -> DataFrame:
    """keys, cy, cx: the centre of intensity; 0, 0 without mass."""
    mass = F.sum(value)
    at = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c) * F.col(value)), mass), F.lit(0.0))
    return cells.groupBy(*keys).agg(at(y).alias("cy"), at(x).alias("cx"))


def mean_squared_error(a: Column, b: Column) -> Column:
    """Of two arrays of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, v: s + v) / F.size(a)


def psnr(mse: Column, peak: float = 1.0) -> Column:
    """Decibels; infinite for no error."""
    return F.when(mse == 0, float("inf")).otherwise(20 * F.log10(peak / F.sqrt(F.when(mse > 0, mse))))


def l1_loss(a: str, b: str) -> Column:
    return F.avg(F.abs(F.col(a) - F.col(b)))


def mse_loss(a: str, b: str) -> Column:
    return F.avg((F.col(a) - F.col(b)) ** 2)


def charbonnier_loss(a: str, b: str, eps: float = 1e-12) -> Column:
    return F.avg(F.sqrt((F.col(a) - F.col(b)) ** 2 + eps))


def psnr_loss(df: DataFrame, image: str, a: str, b: str, small: float = 1e-8) -> DataFrame:
    """One row: the mean over images of 10 / ln 10 * ln(mse + small)."""
    per = df.groupBy(image).agg(mse_loss(a, b).alias("m"))
    return per.agg(F.avg(F.ln(F.col("m") + small) * (10 / 2.302585092994046)).alias("loss"))


def status_counts(df: DataFrame, stage: str, status: str, values: list[str]) -> DataFrame:
    """stage and the number of items in each status."""
    return df.groupBy(stage).agg(*[F.count_if(F.col(status) == v).alias(v) for v in values])


def laps(df: DataFrame, name: str, seconds: str) -> DataFrame:
    return df.groupBy(name).agg(F.count("*").alias("n"), F.avg(seconds).alias("avg"), F.min(seconds).alias("min"), F.max(seconds).alias("max"))


def running_best(df: DataFrame, keys: list[str], score: str, iteration: str) -> DataFrame:
    """The best score and the first iteration that reached it."""
    return df.groupBy(*keys).agg(F.max(score).alias("best"), F.max_by(F.col(iteration), F.struct(F.col(score), -F.col(iteration))).alias("at"))


def expected_total(df: DataFrame, own: str, source: str, needs: str) -> Column:
    """own, else source, else the least of the needs (array), unknown if any need is unknown."""
    n = F.col(needs)
    return F.coalesce(F.col(own), F.col(source), F.when((F.size(n) > 0) & ~F.exists(n, lambda v: v.isNull()), F.array_min(n)))


def global_minmax(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))


def reduced_loss(df: DataFrame, keys: list[str], loss: str, reduction: str = "mean", weight: str | None = None, channels: int = 1) -> DataFrame:
    """keys, loss: the sum or mean of weighted losses; none: the rows with their weighted losses.

    A weighted mean divides by the sum of the weights, times the channels that share one weight.
    """
    value = F.col(loss) * F.col(weight) if weight else F.col(loss)
    if reduction == "none":
        return df.withColumn(loss, value)
    if reduction == "sum":
        return df.groupBy(*keys).agg(F.sum(value).alias(loss))
    if reduction != "mean":
        raise ValueError(reduction)
    return df.groupBy(*keys).agg((F.try_divide(F.sum(value), F.sum(F.col(weight)) * channels) if weight else F.avg(value)).alias(loss))
