"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is set, a folder of our own on a single machine; a cluster must set one."""
    base = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError(f"set {SETTING} to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="loomwork-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write `df` once to the shared folder and read it back: later steps restart from the files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomwork/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path, partitionBy=partition_by)
    return spark.read.schema(df.schema).parquet(path)



def fresh(docs: DataFrame, name: str) -> str:
    """`name`, with as many more underscores as keep it apart from the columns of `docs` (whatever their case)."""
    used = {c.lower() for c in docs.columns}
    while name.lower() in used:
        name += "_"
    return name


def numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """`docs` written once with a number for each row, and the name of that column."""
    row = fresh(docs, "row_")
    return written(docs.withColumn(row, F.monotonically_increasing_id()), name), row


def kept_rows(docs: DataFrame, row: str, stays: DataFrame) -> DataFrame:
    """The rows of `docs` whose number is in `stays` (one column), without the number; other columns may have any name."""
    (other,) = stays.columns
    stays = stays.withColumnRenamed(other, own := fresh(docs, "stays_"))
    return docs.join(stays, F.col(row) == F.col(own), "left_semi").drop(row)
