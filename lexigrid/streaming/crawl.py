"""The crawl as a stream: fetch results arrive, state per norm_url moves on.

Two forms: apply_stream() folds each micro-batch into a versioned state table by a join, exactly once a batch;
CrawlProcessor keeps the state in the state store and emits the changed rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from ..operators.crawl import CrawlConfig, apply_results, seeds, upsert

RESULTS = "norm_url string, status int, html string, etag string, last_modified string, error string, at bigint"


def version_path(root: str, version: int) -> str:
    return f"{root}/v{version:010d}"


def latest(spark: SparkSession, root: str) -> int:
    """The newest finished version of a state table, -1 if there is none. Works on any store that Spark can list."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return -1
    names = [s.getPath().getName() for s in fs.listStatus(path) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return max((int(n[1:]) for n in names if n.startswith("v")), default=-1)


def read_state(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(version_path(root, latest(spark, root)))


def fold(batch: DataFrame, root: str, version: int, config: CrawlConfig | None = None) -> None:
    """Write version `version` from the one before it and a batch of results; a batch that is run again overwrites its own version.

    Of a batch's results for one norm_url the latest stands.
    """
    spark = batch.sparkSession
    state = spark.read.parquet(version_path(root, version - 1))
    last = batch.groupBy("norm_url").agg(F.max(F.struct("at", "status", "html", "etag", "last_modified", "error")).alias("r")).select("norm_url", "r.*")
    now = batch.agg(F.max("at")).first()[0]
    out = apply_results(state, last, now, config) if now is not None else state
    out.write.mode("overwrite").parquet(version_path(root, version))


def apply_stream(results: DataFrame, root: str, checkpoint: str, config: CrawlConfig | None = None):
    """A query that folds a stream of RESULTS into the state table under root, whose version 0 must be there."""
    return results.writeStream.foreachBatch(lambda batch, n: fold(batch, root, n + 1, config)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def import_seeds(spark: SparkSession, records: DataFrame, root: str, now: int, path: str = "") -> None:
    """The next version with the seeds put in; importing them again changes updated_at alone."""
    version = latest(spark, root)
    upsert(spark.read.parquet(version_path(root, version)), seeds(records, path), now).write.parquet(version_path(root, version + 1))


CHANGES = StructType([StructField("norm_url", StringType()), StructField("status_code", IntegerType()), StructField("content_hash", StringType()), StructField("fetched_at", LongType()), StructField("next_refetch_at", LongType()), StructField("next_retry_at", LongType()), StructField("fail_count", LongType()), StructField("changed", StringType())])
_HELD = StructType([StructField("content_hash", StringType()), StructField("fetched_at", LongType()), StructField("fail_count", LongType())])


class CrawlProcessor(StatefulProcessor):
    """Per norm_url: the hash of the last content, when it was fetched and how often fetching failed."""

    def __init__(self, refetch_after: int, retry_after: int):
        self.refetch_after, self.retry_after = refetch_after, retry_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", _HELD)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803  names of the interface
        import hashlib

        found, fetched, fails = self.held.get() if self.held.exists() else (None, None, 0)
        out = []
        for pdf in rows:
            for r in pdf.sort_values("at").itertuples(index=False):
                now = int(r.at)
                error = isinstance(r.error, str) or pd.isna(r.status) or not (200 <= int(r.status) < 400)
                changed = None
                if error:
                    fails += 1
                elif int(r.status) != 304 and isinstance(r.html, str):
                    new = hashlib.sha256(r.html.encode()).hexdigest()
                    changed = None if found is None else str(new != found).lower()
                    if new != found:
                        found, fetched = new, now
                out.append((key[0], None if error else int(r.status), found, fetched, None if error else now + self.refetch_after, now + self.retry_after if error else None, fails, changed))
        self.held.update((found, fetched, fails))
        yield pd.DataFrame(out, columns=CHANGES.fieldNames())

    def close(self) -> None:
        pass


def change_stream(results: DataFrame, config: CrawlConfig | None = None) -> DataFrame:
    """The changed rows (CHANGES) of a stream of RESULTS, with state in the state store."""
    c = config or CrawlConfig()
    return results.groupBy("norm_url").transformWithStateInPandas(CrawlProcessor(c.refetch_after_sec, c.retry_after_sec), CHANGES, "Append", "None")
