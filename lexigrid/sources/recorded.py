"""A data source of recorded responses: what a page API or a crawl would have fetched, from JSON-lines files.

`spark.read.format("recorded").option("path", folder)` gives kind, key, status, body, etag, last_modified. Live network
access is no part of the engine.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "kind string, key string, status int, body string, etag string, last_modified string"
#: Waits between attempts, in seconds, of a client that retries: growing by 1.8, at most 20. Fixed values.
ATTEMPTS, FIRST_WAIT, GROWTH, MOST_WAIT = 7, 1.0, 1.8, 20.0


def waits() -> list[float]:
    """The waits before each further attempt, without the random part."""
    return [min(MOST_WAIT, FIRST_WAIT * GROWTH**n) for n in range(ATTEMPTS - 1)]


class Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class RecordedReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Part]:
        if os.path.isdir(self.path):
            return [Part(os.path.join(self.path, f)) for f in sorted(os.listdir(self.path)) if f.endswith(".jsonl")]
        return [Part(self.path)]

    def read(self, partition: Part) -> Iterator[tuple]:
        with open(partition.path, encoding="utf-8") as lines:
            for line in lines:
                if line.strip():
                    r = json.loads(line)
                    yield tuple(r.get(k) for k in ("kind", "key", "status", "body", "etag", "last_modified"))


class Recorded(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recorded"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordedReader:
        return RecordedReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Recorded)
