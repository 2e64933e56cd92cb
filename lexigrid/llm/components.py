"""Connected components by alternating large-star and small-star steps. DataFrame functions only.

Every step joins and aggregates; no vertex's neighbours are gathered in one row, and nothing goes to the driver but
two counters a round. Lineage is cut by a checkpoint in the shared folder each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release

MOST_ROUNDS = 60


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every vertex that has an edge; component is the smallest id that its edges reach.

    Loops, repeated and reversed edges do no harm; no edges give no rows.
    """
    pairs = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    pairs, before = cut(pairs), None
    for _ in range(MOST_ROUNDS):
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
        del both, least, large, small
        release(edges.sparkSession)
    else:
        raise RuntimeError("the components did not settle")
    ids = pairs.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ids.union(pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
