"""Operator 11: hard negatives by norm-bucketed search.

Components become whole numbers, floor(256 x), so scores (inner products) are exact. Candidates are
sorted by length and cut into buckets of BUCKET rows, whose longest row bounds all their scores with an
anchor a: |a . c| <= |a| |c|. A search goes down the buckets in waves of growing size. After each wave
every window (a range of wanted scores) knows its k best so far; its limit is the lower end of its
range, or its k-th best score once it has k. An anchor asks a bucket of the next wave only if the bound
reaches the lowest limit of its windows; a bucket that can hold a tie is still asked. Two searches run:

1. positives: the first rows of the anchor's own label. Candidates are sorted by label and length, so
   an anchor asks only buckets that hold its label, one window without a lower limit.
2. negatives: rows of other labels, one window for each positive, from 30 to 90 percent of its score.

Anchors meet buckets in blocks of ANCHORS anchors and one bucket, so no task holds more than a block,
and a hot label or a vector with very many copies is spread over buckets by its length, then by row.
Each block gives at most k rows for a window. All tables between waves are written.

Edge cases: rows with a null label, a null vector or a component that is null or not finite take no
part; components are held within LIMIT (65,536 before scaling); missing components of a shorter vector
count as 0; a row without vec_id is no anchor and comes after all others of its score; rows repeated
with one vec_id are rows of their own (each an anchor, and a positive of the other), whose ties are
broken by an arbitrary but fixed order; a positive with a negative score has no negatives; an empty table
gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.shared import written
from loomwork.operators.rank import numbered

SCALE, LIMIT = 256, 1 << 24
EVERY, MOVED, LABELS = 100, 7, 10  # anchors; rows whose label moves on, and the number of labels
POSITIVES, NEGATIVES = 5, 10
BUCKET, ANCHORS = 1024, 256
FIRST, GROWTH = 4, 4  # buckets of the first wave; how much larger each next wave is
_LOWEST = -(1 << 62)
_ROUNDING = 1 + 1e-9


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """row, vec_id, label, vec (whole numbers), norm of the rows that take part. Written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2)
            flat = x.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            n = pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(n)
            own = np.repeat(np.arange(len(n)), n)
            good = np.bincount(own, ~np.isfinite(flat), len(n)) == 0
            v = np.clip(np.floor(SCALE * np.where(np.isfinite(flat), flat, 0.0)), -LIMIT, LIMIT)
            vec = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(v.astype(np.int32)))
            norm = np.sqrt(np.bincount(own, v * v, len(n)))
            out = pa.record_batch([batch.column(0), batch.column(1), vec, pa.array(norm, pa.float64())], names=["vec_id", "label", "vec", "norm"])
            yield out.filter(pa.array(good))

    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % MOVED == 0, (label + 1) % LABELS).otherwise(label)
    d = vectors.where("label IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), "embedding")
    d = d.mapInArrow(run, "vec_id long, label long, vec array<int>, norm double")
    return written(d.withColumn("row", F.monotonically_increasing_id()), "negatives-rows")


def bucketed(rows: DataFrame, by_label: bool, size: int) -> tuple[DataFrame, DataFrame]:
    """The rows with their bucket, and place (number of a bucket among those of its label, or of all), label, bucket, longest.

    Within a label (or in all) places go from long rows to short ones.
    """
    order = [*["label"] * by_label, "down", "row"]
    d = numbered(rows.withColumn("down", -F.col("norm")), order, "rn").withColumn("bucket", F.floor((F.col("rn") - 1) / size).cast("long"))
    d = written(d.drop("rn", "down"), "negatives-buckets")
    if not by_label:
        return d, d.groupBy("bucket").agg(F.max("norm").alias("longest")).withColumn("place", F.col("bucket"))
    ends = d.groupBy("label", "bucket").agg(F.max("norm").alias("longest"))
    first = ends.groupBy(F.col("label").alias("f_label")).agg(F.min("bucket").alias("f_bucket"))
    ends = ends.join(first, F.col("label") == F.col("f_label"))
    return d, ends.select("label", "bucket", "longest", (F.col("bucket") - F.col("f_bucket")).alias("place"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    x = column.combine_chunks()
    n = pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(n), width), np.int64)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(np.arange(len(n)), n), at] = x.flatten().to_numpy(zero_copy_only=False)
    return out


def _products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows; floating point where no sum can reach 2**53."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(c).max(initial=0)) * a.shape[1] < 2.0**53:
        return (a.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return a @ c.T


def _scored(same: bool, k: int):
    """The k best rows of one bucket for each window of a block of anchors."""

    def run(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int | None, int]] = []
        if candidates.num_rows and asked.num_rows:
            width = max(pc.max(pc.list_value_length(t.column("vec"))).as_py() for t in (candidates, asked))
            ids = candidates.column("vec_id").combine_chunks()
            none = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            rows = candidates.column("row").to_numpy()
            order = np.lexsort((rows, ids, none))  # of equal scores the first of this order comes first
            ids, none, rows = ids[order], none[order], rows[order]
            label = candidates.column("label").to_numpy()[order]
            c = _matrix(candidates.column("vec"), width)[order]
            a, own, q, q_row = _matrix(asked.column("vec"), width), *(asked.column(x).to_numpy() for x in ("label", "q", "q_row"))
            score = _products(a, c)
            for i, windows in enumerate(asked.column("windows").to_pylist()):
                fits = (label == own[i]) & (rows != q_row[i]) if same else label != own[i]
                for w in windows:
                    hit = np.flatnonzero(fits & (score[i] >= w["lo"]) & (score[i] <= w["hi"]))
                    s = score[i, hit]
                    if len(hit) > k:
                        go = s >= np.partition(s, len(s) - k)[len(s) - k]
                        hit, s = hit[go], s[go]
                    best = hit[np.argsort(-s, kind="stable")[:k]]
                    out += [(int(q[i]), w["w"], int(score[i, j]), None if none[j] else int(ids[j]), int(rows[j])) for j in best]
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        return pa.table({n: pa.array(x, t) for n, x, t in zip(("q", "w", "score", "id", "row"), columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)})

    return run


def search(anchors: DataFrame, windows: DataFrame, rows: DataFrame, same: bool, k: int, size: int = BUCKET, block: int = ANCHORS) -> DataFrame:
    """q, w, score, id, row, rank: the first k rows of each window (q, w, lo, hi) of `anchors` (q, q_row, label, vec, norm).

    `same`: rows of the anchor's own label without itself, else rows of other labels.
    """
    table, ends = bucketed(rows, same, size)
    ends = written(ends, "negatives-ends")
    last = ends.agg(F.max("place")).first()[0]
    ranking = Window.partitionBy("q", "w").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")
    lo, wave, top = 0, FIRST, None
    while last is not None and lo <= last:
        limits = windows
        if top is not None:
            full = top.groupBy(F.col("q").alias("t_q"), F.col("w").alias("t_w")).agg(F.count("*").alias("many"), F.min("score").alias("least"))
            limits = windows.join(full, (F.col("q") == F.col("t_q")) & (F.col("w") == F.col("t_w")), "left")
            limits = limits.select("q", "w", F.when(F.col("many") >= k, F.greatest("least", "lo")).otherwise(F.col("lo")).alias("lo"), "hi")
        limits = written(limits, "negatives-limits")
        need = limits.groupBy(F.col("q").alias("n_q")).agg(F.min("lo").alias("need"))
        asking = anchors.join(need, F.col("q") == F.col("n_q")).select("q", "label", "norm", "need", F.floor((F.col("q") - 1) / block).cast("long").alias("block"))
        asking = asking.withColumn("place", F.explode(F.sequence(F.lit(lo).cast("long"), F.lit(min(last, lo + wave - 1)).cast("long"))))
        reach = asking.join(ends, ["place", *["label"] * same]).where(F.col("norm") * F.col("longest") * _ROUNDING >= F.col("need"))
        asked = written(reach.select("q", "block", "bucket"), "negatives-asked")
        wanted = asked.select(F.col("block").alias("c_block"), F.col("bucket").alias("c_bucket")).distinct()
        sides = limits.groupBy(F.col("q").alias("s_q")).agg(F.collect_list(F.struct("w", "lo", "hi")).alias("windows"))  # POSITIVES windows at most
        asked = asked.join(anchors.select(F.col("q").alias("a_q"), "q_row", "label", "vec"), F.col("q") == F.col("a_q")).join(sides, F.col("q") == F.col("s_q"))
        asked = asked.select("block", "bucket", "q", "q_row", "label", "vec", "windows")
        held = table.join(wanted, F.col("bucket") == F.col("c_bucket")).select("c_block", "c_bucket", "vec_id", "label", "vec", "row")
        found = held.groupBy("c_block", "c_bucket").cogroup(asked.groupBy("block", "bucket")).applyInArrow(_scored(same, k), "q long, w int, score long, id long, row long")
        if top is not None:
            found = found.unionByName(top.drop("rank"))
        top = written(found.withColumn("rank", F.row_number().over(ranking)).where(F.col("rank") <= k), "negatives-top")
        lo, wave = lo + wave, wave * GROWTH
    return top if top is not None else rows.sparkSession.createDataFrame([], "q long, w int, score long, id long, row long, rank int")


def mined(vectors: DataFrame, size: int = BUCKET, block: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = whole_vectors(vectors)
    anchors = rows.where(F.col("vec_id") % EVERY == 0).withColumn("down", -F.col("norm"))
    anchors = written(numbered(anchors, ["down", "row"], "q").withColumnRenamed("row", "q_row").drop("down"), "negatives-anchors")
    every = anchors.select("q", F.lit(0).alias("w"), F.lit(_LOWEST).alias("lo"), F.lit(-_LOWEST).alias("hi"))
    positives = search(anchors, every, rows, True, POSITIVES, size, block)
    windows = positives.where("score >= 0").select("q", F.col("rank").alias("w"), F.expr("(3 * score + 9) div 10").alias("lo"), F.expr("(9 * score) div 10").alias("hi"))
    found = search(anchors, written(windows.where("lo <= hi"), "negatives-windows"), rows, False, NEGATIVES, size, block)
    known = positives.select(F.col("q").alias("p_q"), F.col("rank").alias("p_w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    known = known.join(anchors.select(F.col("q").alias("a_q"), F.col("vec_id").alias("anchor_id")), F.col("p_q") == F.col("a_q"))
    out = found.join(known, (F.col("q") == F.col("p_q")) & (F.col("w") == F.col("p_w")))
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ORACLE = """
    WITH v AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
    ),
    scored AS (
        SELECT a.vec_id AS anchor_id, a.label AS own, c.vec_id AS id, c.label,
               CAST(list_inner_product(CAST(a.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
        FROM v a, v c WHERE a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id
    ),
    positives AS (
        SELECT anchor_id, own, id AS positive_id, score AS positive_score FROM scored WHERE label = own
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
    ),
    ranked AS (
        SELECT p.anchor_id, p.positive_id, p.positive_score, s.id AS negative_id, s.score AS negative_score,
               row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS r
        FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND s.label <> p.own
         AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
    )
    SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE r <= 10
"""
