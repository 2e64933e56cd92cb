"""The index as a stream: documents arrive, a delta of (term, doc_id, version) rows is appended a batch, and now and then compacted.

A document that arrives again replaces its old terms: the rows of its newest version count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import terms


def delta(docs: DataFrame, version: int) -> DataFrame:
    """term, doc_id, version; a document without terms leaves a row without term, so that its old terms go."""
    held = docs.select("doc_id", F.explode_outer(terms("text")).alias("term"))
    return held.select("term", "doc_id", F.lit(version).cast("bigint").alias("version"))


def append_stream(docs: DataFrame, root: str, checkpoint: str):
    """A query that writes one delta folder a batch; a batch that is run again overwrites its own."""

    def write(batch: DataFrame, n: int) -> None:
        newest = batch.dropDuplicates(["doc_id"])
        delta(newest, n).write.mode("overwrite").parquet(f"{root}/batch={n}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, root: str) -> DataFrame:
    """term, doc_id of the newest version of each document."""
    rows = spark.read.parquet(root).select("term", "doc_id", "version")
    newest = rows.groupBy("doc_id").agg(F.max("version").alias("version"))
    return rows.join(newest, ["doc_id", "version"]).where("term is not null").select("term", "doc_id")


def compact(spark: SparkSession, root: str, to: str) -> None:
    """The current rows as one delta, in term order."""
    current(spark, root).withColumn("version", F.lit(-1).cast("bigint")).repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{to}/batch=-1")
