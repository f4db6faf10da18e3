"""The pipeline against its plain version: the network's verdicts are taken from the operator."""

import collections

import pytest
from pyspark.sql import functions as F

from loomwork.llm import source_mix, toxicity
from tests.llm import brute
from tests.llm.test_operators import SCHEMA, labels, toxic_rows

P = pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_run(spark, tmp_path):
    rows, marks = toxic_rows()
    rows += [(2_000 + k, rows[4 * k + 1][1] + "  ", "en", f"s{k % 3}", 0) for k in range(20)]
    rows += [(3_000 + k, rows[4 * k + 1][1] + f" more{k}", "en", f"s{k % 3}", 0) for k in range(20)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    labels(spark, marks).write.parquet(str(tmp_path / "labels.parquet"))
    got = collections.Counter((r.doc_id, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    verdict = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, spark.read.parquet(str(tmp_path / "labels.parquet"))).collect()}
    left = [(i, t) for i, t, *_ in rows if not verdict[i]]
    assert len(left) < len(rows)
    stays = {i for i, *_, in ((r[0], r[3]) for r in brute.exact(left) if r[3])}
    left = [(i, t) for i, t in left if i in stays]
    stays = {r[0] for r in brute.near(left) if r[3]}
    left = [(i, t) for i, t in left if i in stays]
    source = {r[0]: r[3] for r in rows}
    order = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("doc_id", F.lit(17)).alias("h")).collect()}
    copies = brute.mixed_copies([(i, t, source[i]) for i, t in left], order, source_mix.BLOCK)
    want = collections.Counter({(i, brute.sha(t)): copies[i] for i, t in left})
    assert got == +want


def test_stages_keep_the_columns(spark):
    rows, marks = toxic_rows()
    docs = spark.createDataFrame(rows[:40], SCHEMA)
    for name, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, docs, "").columns == docs.columns, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "source_mix", "byte_bpe"]


def test_stages_take_odd_tables(spark, tmp_path):
    """No rows; null and repeated doc_ids, null and empty texts, equal rows."""
    _, marks = toxic_rows()
    labels(spark, marks).write.parquet(str(tmp_path / "labels.parquet"))
    odd = [(None, "a b c d e f", "en", "s", 0), (None, "a b c d e f", "en", "s", 0), (1, None, None, None, 0), (1, "", "en", "s", 0), (2, "g h i j k l", "en", "s", 0), (2, "m n o p q r", "en", "t", 0), (2, "m n o p q r", "en", "t", 0)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, SCHEMA)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            docs = spark.createDataFrame(docs.collect(), docs.schema)
            assert (docs.count() > 0) == bool(rows), name
