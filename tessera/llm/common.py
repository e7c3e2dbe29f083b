"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Partitions of a sample that had to be cut: the tasks that read its texts.
SAMPLE_PARTS = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir).

    Where the session names none, as in some tests, a temporary folder is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir() or os.path.join(tempfile.gettempdir(), "tessera-checkpoints")
    # a path without a scheme is on the cluster's default file system
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    base = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut, stored in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """df written as Parquet to the shared folder and read back."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remainder(column, modulus: int):
    """crc32 of a column as text, modulo modulus; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, bound: int) -> DataFrame:
    """(doc_id, text, y) of at most `bound` rows whose label may be learnt from.

    The ids are those with the smallest hash; documents with several labels count by the largest. Of
    repeated ids each row stands, as long as there are not more than `bound`; then those of the smallest hash do.
    """
    ids = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .where(remainder("doc_id", modulus) != held_out)
        .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    )
    # at most `bound` pairs of an id and a label, so the broadcast has a fixed limit
    rows = written(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"))
    if rows.count() <= bound:
        return rows
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(bound).repartition(SAMPLE_PARTS)
