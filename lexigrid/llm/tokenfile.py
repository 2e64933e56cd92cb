"""Token-ID files: Parquet list columns of ids in ascending doc_id order, with their place in the whole stream.

The texts are range-partitioned by doc_id and sorted, each partition is encoded and written as one file: ids as a
dictionary-encoded list column, in row groups and pages of set size, with Parquet's page index, so a reader can fetch
the metadata columns, or the ids of a range of doc_ids, without the rest. Every row keeps its start inside its file;
the totals of the files (one row a file) give the start in the stream.

Defined results: null and empty texts have the end id alone; rows that share a doc_id stay separate rows, next to each
other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, new_table, parallelism, slices

ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 16 << 20, 256 << 10, 1000
#: Pieces of text whose ids a worker keeps; beyond it the worker starts afresh.
CACHE_PIECES = 1_300_000
#: ASCII white space never takes part in a token or in a composed character, so any text may be cut there.
PIECE = re.compile("[^ \t\n\r\x0b\x0c]+")
#: In a text of these characters alone (no apostrophe, so no contraction; no combining mark), and without the opening of
#: a special token, the tokenizer's own cuts always fall between a run of letters and what stands beside it.
LETTERS = "a-z\u00df-\u00f6\u00f8-\u012f\u0131-\u024f"
PLAIN = re.compile(f"[\t-\r\x20-\x26\x28-\x7e{LETTERS}]*")
LETTER_RUN = re.compile(f"[{LETTERS}]+")
RUN = re.compile(f"[{LETTERS}]+|[^\\s{LETTERS}]+")


def pieces(text: str) -> list[str]:
    """The text cut where no token can span; lower-cased if that leaves the ids the same."""
    if "\u0130" not in text and PLAIN.fullmatch(low := text.lower()) and "<|" not in low:
        return RUN.findall(low)
    return PIECE.findall(text)


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[n for token, n in vocabulary.items() if token.endswith("</w>")]] = True

    def _learn(self, new: list[str]) -> None:
        """Put the ids of these pieces in the cache. Runs of letters are one word each, so many go to the tokenizer as
        one text, and the marks of a word's end tell their ids apart; other pieces go one by one."""
        words = [p for p in new if LETTER_RUN.fullmatch(p)]
        single = [p for p in new if not LETTER_RUN.fullmatch(p)]
        for at in range(0, len(words), 4000):
            part = words[at : at + 4000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<i4")
            edges = np.concatenate(([0], 4 * (np.flatnonzero(self.ends[ids]) + 1))).tolist()
            if len(edges) != len(part) + 1:
                single += part
                continue
            raw = ids.tobytes()
            self.cache.update(zip(part, (raw[a:b] for a, b in itertools.pairwise(edges)), strict=True))
        for p, e in zip(single, self.tokenizer.encode_batch_fast(single, add_special_tokens=False), strict=True):
            self.cache[p] = np.array(e.ids, "<i4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers; equal pieces are encoded once."""
        cut = [pieces(t) for t in texts]
        if len(self.cache) > CACHE_PIECES:
            self.cache.clear()
        unknown: set[str] = set()
        for found in cut:
            unknown.update(itertools.filterfalse(self.cache.__contains__, found))
        if unknown:
            self._learn(list(unknown))
        return [b"".join(map(self.cache.__getitem__, found)) for found in cut]


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def place(value: Column, edges: list[int]) -> Column:
    """The number of edges that are not above the value, by binary search in a constant array."""
    steps = max(1, len(edges).bit_length())
    padded = F.lit([*edges, *[(1 << 63) - 1] * ((1 << steps) - len(edges))]).cast("array<bigint>")
    found = F.aggregate(F.lit([1 << k for k in reversed(range(steps))]), F.lit(0), lambda low, step: F.when(F.get(padded, low + step - 1) <= value, low + step).otherwise(low))
    return F.least(found, F.lit(len(edges)))


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = 1, text: str = "text", partitions: int | None = None) -> None:
    """Write doc_id, n_tokens, local_start (long), file_no (int), tokens (array of int) of every row of docs."""
    spark = docs.sparkSession
    bound_batches(spark)
    tokenizer_path = tokenizer_path or public_tokenizers.path("word_bpe_49k.json")
    end = np.array([end_id], "<i4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, start = encoder(tokenizer_path), 0
        for batch in slices(batches, "text", 2 << 20):
            ids = [x + end for x in own.encode([x or "" for x in batch.column("text").to_pylist()])]
            sizes = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
            ends = np.cumsum(sizes)
            tokens = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(start + ends - sizes), tokens], ["doc_id", "n_tokens", "local_start", "tokens"])
            start += int(ends[-1])

    ids = F.col("doc_id").cast("bigint").alias("doc_id")
    parts = partitions or parallelism(spark)
    # Quantiles of doc_id from a scan of that column alone; repartitionByRange would read the texts twice.
    edges = docs.select(ids).agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10_000)).first()[0] if parts > 1 else None
    edges = sorted(set(edges or []))
    (
        docs.select(ids, F.col(text).alias("text"))
        .repartitionById(parts, F.coalesce(place(F.col("doc_id"), edges), F.lit(0)))
        .sortWithinPartitions("doc_id")
        .mapInArrow(run, "doc_id bigint, n_tokens bigint, local_start bigint, tokens array<int>")
        .withColumn("file_no", F.spark_partition_id())
        .write.option("compression", "zstd").option("parquet.enable.dictionary", "true").option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES).option("parquet.page.row.count.limit", PAGE_ROWS).parquet(path)
    )


def starts(spark: SparkSession, path: str) -> DataFrame:
    """file_no and file_start, the number of ids in all files before. One row a file, so one task may put them in order."""
    files = spark.read.parquet(path).groupBy("file_no").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("file_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("file_start"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, tokens from the files. Filters on doc_id and unread columns reach the scan."""
    files = F.broadcast(starts(spark, path))  # a row for each file: bounded by the partitions that wrote it
    return spark.read.parquet(path).join(files, "file_no").select("doc_id", (F.col("local_start") + F.col("file_start")).alias("start"), "n_tokens", "tokens")


def digest(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens as counted in the list, ids_crc32 of the ids as little-endian unsigned 32-bit integers."""
    bound_batches(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            flat, offsets = lists.values.to_numpy().astype("<u4"), lists.offsets.to_numpy()
            raw = memoryview(flat.tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "tokens").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_digest(docs: DataFrame) -> DataFrame:
    """Write the ids of docs in the shared folder and describe what is read back."""
    path = new_table(docs.sparkSession, "tokens")
    write_tokens(docs, path)
    return digest(read_tokens(docs.sparkSession, path))
