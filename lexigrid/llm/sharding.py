"""Shards of near-equal size: sampled splitters, exact running sums.

Records are ordered by (hash of the text, doc_id), so equal texts stand together and yet any group of them can be
divided. A size-weighted sample of keys gives quantile boundaries, which cut the order into many ranges of about equal
bytes; a range that comes out overfull is sampled again and subdivided. The exact totals of the ranges (one row each)
and a running sum inside each range give every record its place in the whole order; a shard is an equal stretch of
bytes of that order.

Defined results: a null text has 0 bytes; records whose key and doc_id are equal are placed in either order; shards
without records are possible when there are fewer records than shards; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Ranges that the splitters aim at, sampled keys a range, and times a range's fair share from which it is overfull.
RANGES, KEYS_PER_RANGE, OVERFULL, ROUNDS = 1024, 8, 3, 3


def record_key(text: Column, doc_id: Column) -> Column:
    part = lambda x: F.lpad(F.hex(x), 16, "0")
    return F.concat(part(F.xxhash64(text)), part(F.coalesce(doc_id, F.lit(-1))))


def range_of(key: Column, bounds: list[str]) -> Column:
    """The number of bounds that are not above the key, by binary search in a constant array."""
    steps = max(1, len(bounds).bit_length())
    padded = F.lit([*bounds, *["~"] * ((1 << steps) - len(bounds))])
    search = F.aggregate(
        F.lit([1 << s for s in reversed(range(steps))]), F.lit(0),
        lambda low, step: F.when(F.get(padded, low + step - 1) <= key, low + step).otherwise(low),
    )
    return search


def _sample(records: DataFrame, rate: float) -> list[tuple[str, float]]:
    """Keys drawn with chance size x rate (at most 1), with their weight in bytes. About total bytes x rate of them."""
    chance = F.col("size") * F.lit(rate)
    lot = F.pmod(F.xxhash64("key", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = records.where(lot < chance).select("key", F.greatest(F.col("size").cast("double"), F.lit(1.0 / rate)).alias("weight"))
    return sorted((r["key"], r["weight"]) for r in drawn.collect())


def _quantiles(keys: list[tuple[str, float]], parts: int) -> list[str]:
    total, seen, out = sum(w for _, w in keys), 0.0, []
    for key, weight in keys:
        seen += weight
        if seen * parts >= total * (len(out) + 1) and len(out) < parts - 1:
            out.append(key)
    return out


def splitters(records: DataFrame, total: int, ranges: int = RANGES) -> tuple[list[str], list]:
    """Boundaries and, for each range that has rows, its number, bytes and rows."""
    rate = ranges * KEYS_PER_RANGE / max(total, 1)
    bounds = sorted(set(_quantiles(_sample(records, rate), ranges)))
    for n in range(ROUNDS):
        held = records.groupBy(range_of(F.col("key"), bounds).alias("range")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
        over = [r for r in held if r["bytes"] > OVERFULL * total / ranges and r["rows"] > 1]
        if not over or n == ROUNDS - 1:
            break
        inside = records.where(range_of(F.col("key"), bounds).isin([r["range"] for r in over]))
        finer = _sample(inside, rate * 4 ** (n + 1))
        within: dict[int, list] = {}
        for key, weight in finer:
            within.setdefault(sum(b <= key for b in bounds), []).append((key, weight))
        parts = {r["range"]: -(-r["bytes"] * ranges // total) for r in over}
        more = {key for k, keys in within.items() if k in parts for key in _quantiles(keys, parts[k] + 1)}
        if not more - set(bounds):
            break
        bounds = sorted({*bounds, *more})
    return bounds, sorted(held, key=lambda r: r["range"])


def shard(docs: DataFrame, shards: int = 40, text: str = "text", overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row of docs."""
    records = cut(docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"), record_key(F.col(text), F.col("doc_id").cast("bigint")).alias("key"),
    ))
    total = records.agg(F.sum("size")).first()[0] or 0
    bounds, held = splitters(records, total)
    offsets, rows = [], 0
    before = 0
    for r in held:
        offsets.append((r["range"], before, rows))
        before, rows = before + r["bytes"], rows + r["rows"]
    spark = docs.sparkSession
    starts = spark.createDataFrame(offsets, "range int, bytes_before bigint, rows_before bigint")  # a row for each range
    inside = Window.partitionBy("range").orderBy("key", "doc_id")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        records.withColumn("range", range_of(F.col("key"), bounds).cast("int"))
        .withColumn("run", F.sum("size").over(upto)).withColumn("row", F.row_number().over(inside))
        .join(F.broadcast(starts), "range")
        .withColumn("middle", F.col("bytes_before") + F.col("run") - F.col("size") / 2)
        .withColumn("shard", F.least(F.floor(F.col("middle") * shards / F.lit(max(total, 1))), F.lit(shards - 1)).cast("int"))
        .withColumn("place", F.col("rows_before") + F.col("row") - 1)
    )
    placed = cut(placed.select("doc_id", "size", "text_crc32", "shard", "place"))
    first = F.broadcast(placed.groupBy("shard").agg(F.min("place").alias("first")))  # a row for each shard
    return placed.join(first, "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
