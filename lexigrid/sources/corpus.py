"""Reading and writing corpora: header + body text files, metadata, token lists, frequency tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER_LINES = 6
#: Added to the file number of Russian documents. Fixed value.
RU_OFFSET = 30_000


def body_of(value: Column) -> Column:
    """The text after the header lines; empty if there are no more lines."""
    return F.array_join(F.slice(F.split(value, "\n", -1), HEADER_LINES + 1, (1 << 31) - 1), "\n")


def header_field(value: Column, name: str) -> Column:
    """The last header line that starts with the name, without one leading space; empty if none does."""
    lines = F.filter(F.slice(F.split(value, "\n", -1), 1, HEADER_LINES), lambda x: x.startswith(f"{name}:"))
    return F.coalesce(F.regexp_replace(F.try_element_at(lines, F.lit(-1)), f"^{name}: ?", ""), F.lit(""))


def language_of(path: Column) -> Column:
    return F.when(path.contains("/enwiki/"), "en").when(path.contains("/ruwiki/"), "ru").otherwise("unk")


def file_number(path: Column) -> Column:
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_replace(stem, "[^0-9]", ""), F.lit("")), F.lit("9" * 18)).cast("bigint"), F.lit(0).cast("bigint"))


def doc_id_of(path: Column) -> Column:
    return file_number(path) + F.when(language_of(path) == "ru", RU_OFFSET).otherwise(0)


def file_name(doc_id: Column, ending: str) -> Column:
    return F.format_string(f"%05d.{ending}", doc_id)


def read_corpus(spark: SparkSession, root: str, layout: str = "index", limit: int = 0) -> DataFrame:
    """doc_id, lang, title, url, path, body of the text files under root.

    layout: `all` takes every .txt file, `index` those in a folder `text`, `ranks` those at <root>/*/text/. limit: the
    first files by path (0: all).
    """
    files = f"{root}/*/text/*.txt" if layout == "ranks" else root
    found = spark.read.text(files, wholetext=True, recursiveFileLookup=layout != "ranks", pathGlobFilter="*.txt").select("value", F.col("_metadata.file_path").alias("path"))
    if layout == "index":
        found = found.where(F.col("path").contains("/text/"))
    if limit:
        found = found.orderBy("path").limit(limit)
    path, value = F.col("path"), F.col("value")
    return found.select(doc_id_of(path).alias("doc_id"), language_of(path).alias("lang"), header_field(value, "Title").alias("title"), header_field(value, "URL").alias("url"), "path", body_of(value).alias("body"))


def write_corpus(docs: DataFrame, path: str) -> None:
    """Documents as Parquet, a folder a language."""
    docs.write.mode("overwrite").partitionBy("lang").parquet(path)


def with_header(title: Column, pageid: Column, url: Column, length_bytes: Column, words: Column, text: Column) -> Column:
    """A text file's content: the header lines and the body."""
    line = lambda name, x: F.concat(F.lit(f"{name}: "), F.coalesce(x.cast("string"), F.lit("")))
    return F.concat_ws("\n", line("Title", title), line("PageID", pageid), line("URL", url), line("LengthBytes", length_bytes), line("Words", words), F.lit(""), text)


def read_metadata(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Records of a JSON file: an array, or an object whose `items` is one. What isn't a record is left out."""
    reader = spark.read.option("multiLine", True).option("mode", "PERMISSIVE")
    if schema:
        reader = reader.schema(schema)
    found = reader.json(path)
    if "items" in found.columns and found.schema["items"].dataType.typeName() == "array":
        found = found.select(F.explode("items").alias("_r")).where("_r is not null").select("_r.*")
    return found.drop("_corrupt_record")


def write_metadata(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").json(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One token a line; line ends are stripped and empty lines left out."""
    return spark.read.text(path).select(F.regexp_replace("value", "[\r\n]+$", "").alias("token")).where("token <> ''")


def write_frequencies(counts: DataFrame, path: str) -> None:
    """term and count, separated by a tab, most frequent first."""
    counts.select("term", "count").orderBy(F.desc("count"), "term").write.mode("overwrite").option("sep", "\t").option("quote", "").csv(path)
