"""Token statistics, term frequencies, ranks and the rank-frequency law."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import body_bytes, column, tokens


def token_rows(docs: DataFrame, text: str = "text", grammar: str = "index", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each token: the kept columns, pos from 0, token."""
    return docs.select(*keep, F.posexplode(tokens(text, grammar)).alias("pos", "token"))


def token_stats(docs: DataFrame, text: str = "text", grammar: str = "wide") -> DataFrame:
    """One row: docs, bytes, tokens, chars, avg_len (0 without tokens). No shuffle but that of the partial sums."""
    counted = docs.select(body_bytes(text).alias("bytes"), tokens(text, grammar).alias("t")).select("bytes", F.size("t").alias("n"), F.length(F.array_join("t", "")).alias("chars"))
    sums = counted.agg(F.count("*").alias("docs"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.greatest("n", F.lit(0))), F.lit(0)).alias("tokens"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"))
    return sums.withColumn("avg_len", F.when(F.col("tokens") > 0, F.col("chars") / F.col("tokens")).otherwise(0.0))


def term_counts(docs: DataFrame, text: str = "text", grammar: str = "index") -> DataFrame:
    """term, count."""
    return docs.select(F.explode(tokens(text, grammar)).alias("term")).groupBy("term").agg(F.count("*").alias("count"))


def in_order(counts: DataFrame, limit: int | None = None) -> DataFrame:
    """Most frequent first, equals by the bytes of the term."""
    ordered = counts.orderBy(F.desc("count"), "term")
    return ordered if limit is None else ordered.limit(limit)


def unique_terms(docs: DataFrame, text: str = "text", grammar: str = "index") -> DataFrame:
    return term_counts(docs, text, grammar).agg(F.count("*").alias("unique_terms"))


def ranked(counts: DataFrame, min_freq: int = 1) -> DataFrame:
    """term, count, rank from 1.

    Ranks are global: terms are dealt out by count, each count's number of terms (few distinct counts) gives where its
    ranks begin, and the order inside a count is by term. So no task sorts the whole vocabulary.
    """
    kept = counts.where(F.col("count") >= min_freq)
    sizes = kept.groupBy("count").agg(F.count("*").alias("n"))
    before = Window.orderBy(F.desc("count")).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("count", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("count", "head").orderBy("term")
    # A count that many terms share (1, above all) is divided by the terms' first characters.
    head = F.substring("term", 1, 2)
    split = kept.withColumn("head", head)
    heads = split.groupBy("count", "head").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("count").orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
    offsets = heads.select("count", "head", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("offset")).join(starts, "count")
    return split.withColumn("at", F.row_number().over(inside)).join(offsets, ["count", "head"]).select("term", "count", (F.col("start") + F.col("offset") + F.col("at")).cast("bigint").alias("rank"))


def fit_window(ranks: DataFrame, fit_from: int = 10, fit_to: int = 50_000) -> DataFrame:
    """The ranked terms that take part in the fit: a window of ranks, or all up to the end if it is empty."""
    size = ranks.agg(F.count("*").alias("n"))
    rows = ranks.join(F.broadcast(size))  # one row
    inside = F.col("rank").between(fit_from, fit_to)
    return rows.where(F.when(F.col("n") >= fit_from, inside).otherwise(F.col("rank") <= F.least(F.lit(fit_to), F.col("n")))).drop("n")


def zipf_fit(ranks: DataFrame, fit_from: int = 10, fit_to: int = 50_000) -> DataFrame:
    """One row: s, c, points of frequency = c / rank ** s, by least squares over the logarithms."""
    x, y = F.log(F.col("rank").cast("double")), F.log(F.col("count").cast("double"))
    fit = fit_window(ranks, fit_from, fit_to).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count("*").alias("points"))
    return fit.select((-F.col("slope")).alias("s"), F.exp("intercept").alias("c"), "points")


def zipf_curve(ranks: DataFrame, fit: DataFrame) -> DataFrame:
    """rank, count, fitted: the points and the law's value at each, for a plot."""
    return ranks.join(F.broadcast(fit)).select("rank", "count", (F.col("c") / F.pow(F.col("rank").cast("double"), F.col("s"))).alias("fitted"))


def zipf_report(docs: DataFrame, text: str = "text", min_freq: int = 1, fit_from: int = 10, fit_to: int = 50_000) -> DataFrame:
    """One row: docs, bytes, tokens, unique_terms, s, c and the 20 most frequent terms as `term:count` in one string."""
    counts = term_counts(docs, text, "plain")
    ranks = ranked(counts, min_freq)
    totals = docs.agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.octet_length(column(text))), F.lit(0)).alias("bytes"))
    sums = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("tokens"), F.count("*").alias("unique_terms"))
    top = in_order(counts, 20).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("minus"), "term"))), lambda x: F.concat_ws(":", x["term"], -x["minus"])), " ").alias("top"))
    one = lambda a, b: a.join(F.broadcast(b))  # noqa: E731  single rows
    return one(one(one(totals, sums), zipf_fit(ranks, fit_from, fit_to)), top)


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)
