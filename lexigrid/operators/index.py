"""The inverted index: (term, doc_id) rows as the base form, posting lists, dictionary and lookups as views of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stem import stem
from ..functions.text import body_bytes, terms, tokens

POSTING_BYTES = 4


def posting_rows(docs: DataFrame, text: str = "text", grammar: str = "index", stemmed: str | None = None) -> DataFrame:
    """term, doc_id, each pair once. A document's terms are made distinct before they become rows, so no shuffle is needed.

    stemmed: a stemmer's language (en, ru, auto) to index stems instead of tokens.
    """
    if stemmed is None:
        return docs.select(F.explode(terms(text, grammar)).alias("term"), "doc_id")
    rows = docs.select(F.explode(terms(text, grammar)).alias("token"), "doc_id")
    return rows.select(stem("token", stemmed).alias("term"), "doc_id").distinct()


def posting_lists(rows: DataFrame) -> DataFrame:
    """term, df, postings (ascending). A term's list is as long as its documents: for terms of bounded df; the rows serve the rest."""
    return rows.groupBy("term").agg(F.sort_array(F.collect_set("doc_id")).alias("postings")).select("term", F.size("postings").cast("bigint").alias("df"), "postings")


def document_frequency(rows: DataFrame) -> DataFrame:
    """term, df. rows hold each pair once."""
    return rows.groupBy("term").agg(F.count("*").alias("df"))


def dictionary(rows: DataFrame) -> DataFrame:
    """term, df, offset, bytes_len: where each posting list begins in a file of the lists in term order.

    Offsets run over ranges of first characters, each summed by itself, so no task goes through the whole vocabulary.
    """
    sized = document_frequency(rows).withColumns({"bytes_len": F.col("df") * POSTING_BYTES, "head": F.substring("term", 1, 2)})
    inside = Window.partitionBy("head").orderBy("term").rowsBetween(Window.unboundedPreceding, -1)
    heads = sized.groupBy("head").agg(F.sum("bytes_len").alias("n"))
    starts = heads.select("head", F.coalesce(F.sum("n").over(Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return sized.withColumn("run", F.coalesce(F.sum("bytes_len").over(inside), F.lit(0))).join(starts, "head").select("term", "df", (F.col("start") + F.col("run")).alias("offset"), "bytes_len")


def index_totals(docs: DataFrame, text: str = "text", grammar: str = "index") -> DataFrame:
    """One row: docs, unique_terms, postings, bytes, tokens."""
    sums = docs.agg(F.count("*").alias("docs"), F.coalesce(F.sum(body_bytes(text)), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.size(tokens(text, grammar))), F.lit(0)).alias("tokens"))
    frequencies = document_frequency(posting_rows(docs, text, grammar))
    terms_ = frequencies.agg(F.count("*").alias("unique_terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("postings"))
    return sums.join(F.broadcast(terms_)).select("docs", "unique_terms", "postings", "bytes", "tokens")


def lookup(rows: DataFrame, asked: list[str], shown: int = 30) -> DataFrame:
    """term, df, preview of each asked term: its first doc_ids and how many more there are, or `NOT FOUND`."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(t,) for t in asked], "term string")
    found = rows.where(F.col("term").isin(asked))
    order = Window.partitionBy("term").orderBy("doc_id")
    few = found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= shown).groupBy("term").agg(F.array_join(F.transform(F.sort_array(F.collect_list("doc_id")), lambda x: x.cast("string")), " ").alias("ids"))
    counts = document_frequency(found).join(few, "term")
    more = F.when(F.col("df") > shown, F.concat(F.lit(" ... ("), (F.col("df") - shown).cast("string"), F.lit(" more)"))).otherwise("")
    return wanted.join(counts, "term", "left").select("term", F.coalesce("df", F.lit(0).cast("bigint")).alias("df"), F.coalesce(F.concat("ids", more), F.lit("NOT FOUND")).alias("preview"))


def save_index(docs: DataFrame, path: str, text: str = "text", grammar: str = "index") -> None:
    """docs, rows and terms as Parquet under path; rows and terms are sorted by term, so a term's filter skips row groups."""
    shown = [c for c in ("lang", "title", "url") if c in docs.columns]
    docs.select("doc_id", *shown).write.mode("overwrite").parquet(f"{path}/docs")
    posting_rows(docs, text, grammar).repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/rows")
    rows = docs.sparkSession.read.parquet(f"{path}/rows")
    dictionary(rows).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(docs, rows, terms) of a saved index."""
    return tuple(spark.read.parquet(f"{path}/{x}") for x in ("docs", "rows", "terms"))


def export_tsv(path: str, to: str, spark: SparkSession) -> None:
    """docs and terms of a saved index as tab-separated text."""
    docs, _, terms_ = load_index(spark, path)
    docs.orderBy("doc_id").write.mode("overwrite").option("sep", "\t").csv(f"{to}/docs")
    terms_.orderBy("term").write.mode("overwrite").option("sep", "\t").option("quote", "").csv(f"{to}/terms")
