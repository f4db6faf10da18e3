"""What a run leaves on disk: stale files, versions to keep, expected pairs. Listings in, listings out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.operators.joins import argmax_candidate


def stale_files(found: DataFrame, expected: DataFrame, path: str = "path") -> DataFrame:
    """Files that the new run does not expect."""
    return found.join(expected.select(path), path, "left_anti")


def versions_to_drop(runs: DataFrame, name: str, keep: int, current: str | None = None) -> DataFrame:
    """All but the `keep` newest runs by name; never the current one."""
    newest = runs.orderBy(F.col(name).desc()).limit(keep).select(name)
    out = runs.join(newest, name, "left_anti")
    return out if current is None else out.where(F.col(name) != current)


def missing_outputs(jobs: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Jobs without a result: what a run with --skip-existing has left to do."""
    return jobs.join(found.select(key), key, "left_anti")


def resolved_pairs(inputs: DataFrame, candidates: DataFrame, key: str, item: str, order: str, score: str, threshold: float) -> DataFrame:
    """item, outcome, pick: inputs with their truth by key, the best-scored one where several match.

    Outcomes: missing (no candidate), unique, resolved (one candidate reaches the threshold) and
    uncertain (none or several do; the best is still picked).
    """
    j = inputs.join(candidates, key, "left")
    best = argmax_candidate(j.where(F.col(order).isNotNull()), [item], score, order, threshold)
    out = inputs.select(item).distinct().join(best, item, "left")
    outcome = F.when(F.col("n").isNull(), "missing").when(F.col("n") == 1, "unique").when(F.col("confident"), "resolved").otherwise("uncertain")
    return out.select(item, outcome.alias("outcome"), "pick")


def outcome_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("outcome").agg(F.count("*").alias("n"))
