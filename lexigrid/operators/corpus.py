"""Building and checking corpora: acceptance, numbering, category walks, integrity checks, statistics, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import word_count
from ..shared import cut

#: Least words of an accepted document, and depth of the category walk, by language. Fixed values.
MIN_WORDS, DEPTH = {"en": 450, "ru": 350}, {"en": 4, "ru": 3}


def by_lang(lang: Column, values: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(lang == k, v).otherwise(out)
    return out


def accept(pages: DataFrame, seen: DataFrame | None = None, min_words: dict[str, int] | None = None, default: int = 0) -> DataFrame:
    """pages (pageid, lang, extract, ...) that become documents, with `words`.

    Out go pages that are missing, without a pageid, blank, too short for their language, or already in `seen`; of rows
    that share a pageid one stays.
    """
    rows = pages.where(F.coalesce(F.col("pageid"), F.lit(0)) != 0)
    if "missing" in pages.columns:
        rows = rows.where("missing is null or not missing")
    rows = rows.withColumn("extract", F.regexp_replace("extract", r"^[\s\x1c-\x1f\x{85}\x{a0}]+|[\s\x1c-\x1f\x{85}\x{a0}]+$", "")).where("extract <> ''")
    rows = rows.withColumn("words", word_count("extract")).where(F.col("words") >= by_lang(F.col("lang"), MIN_WORDS if min_words is None else min_words, default))
    if seen is not None:
        rows = rows.join(seen.select("pageid").distinct(), "pageid", "left_anti")
    return rows.dropDuplicates(["pageid"])


def number(accepted: DataFrame, start: int = 0) -> DataFrame:
    """docid from start + 1 in order of pageid, within each language; a language's batch is numbered by one task."""
    return accepted.withColumn("docid", (F.row_number().over(Window.partitionBy("lang").orderBy("pageid")) + start).cast("bigint"))


def walk(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """category, depth: the categories reached from the seeds (category) over edges (parent, child), each at its least depth.

    One join a level, against the frontier alone; categories met before are not expanded again. Each level is written to
    the shared folder once, so the plan has one part a level and nothing is worked out twice.
    """
    frontier = cut(seeds.select("category").distinct().withColumn("depth", F.lit(0)))
    reached = frontier
    for level in range(1, depth + 1):
        nearby = frontier.join(edges, frontier["category"] == edges["parent"]).select(F.col("child").alias("category")).distinct()
        frontier = cut(nearby.join(reached, "category", "left_anti").withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def members(reached: DataFrame, pages: DataFrame, target: int | None = None) -> DataFrame:
    """pageid of the pages (parent, pageid) of the reached categories, each once, nearest categories first, at most target."""
    found = pages.join(reached, pages["parent"] == reached["category"]).groupBy("pageid").agg(F.min("depth").alias("depth"))
    return found if target is None else found.orderBy("depth", "pageid").limit(target)


def check(part: str, metadata: DataFrame, texts: DataFrame, raws: DataFrame) -> DataFrame:
    """part, check, value of each failed check; no rows: all is well.

    metadata: pageid, text_file, raw_file; texts and raws: path of each file that is there.
    """
    counts = metadata.agg(F.count("*").alias("n"))
    row = lambda name, value: value.select(F.lit(part).alias("part"), F.lit(name).alias("check"), F.col("value").cast("bigint").alias("value"))

    def files(name: str, listed: DataFrame) -> DataFrame:
        return row(name, listed.agg(F.count("*").alias("value")).join(F.broadcast(counts)).where("value <> n"))

    there = lambda listed: listed.select("path").distinct()
    whole = metadata.join(there(texts), metadata["text_file"] == F.col("path"), "left_semi").join(there(raws), metadata["raw_file"] == F.col("path"), "left_semi")
    missing = counts.join(F.broadcast(whole.agg(F.count("*").alias("ok")))).select((F.col("n") - F.col("ok")).alias("value")).where("value > 0")
    twice = metadata.groupBy(F.coalesce(F.col("pageid"), F.lit(-1)).alias("pageid")).count().where("count > 1").agg(F.count("*").alias("value")).where("value > 0")
    return files("text files", texts).unionByName(files("raw files", raws)).unionByName(row("missing refs", missing)).unionByName(row("duplicate pageid groups", twice))


def verdict(problems: DataFrame) -> DataFrame:
    """One row: OK, or FAIL with the problems in one string."""
    lines = F.array_join(F.sort_array(F.collect_list(F.concat_ws(" ", "part", "check", F.col("value").cast("string")))), "; ")
    return problems.agg(F.when(F.count("*") == 0, "OK").otherwise("FAIL").alias("verdict"), lines.alias("problems"))


def upper_median(groups: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, median: the value at place n // 2 (from 0) in ascending order, from counts of the distinct values."""
    counted = groups.groupBy(*keys, value).agg(F.count("*").alias("c"))
    order = Window.partitionBy(*keys).orderBy(value)
    run = counted.withColumns({"upto": F.sum("c").over(order), "n": F.sum("c").over(Window.partitionBy(*keys))})
    return run.where((F.col("upto") > F.floor(F.col("n") / 2)) & (F.col("upto") - F.col("c") <= F.floor(F.col("n") / 2))).select(*keys, F.col(value).alias("median"))


def statistics(docs: DataFrame, raw: str = "raw", text: str = "text", words: str = "words") -> DataFrame:
    """A row a language: docs, sizes in MiB and bytes a document of raw and text, words: average, upper median, least, most.

    Texts are read once, into sums for each language and number of words; all figures come from these.
    """
    part = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.octet_length(raw).alias("raw_bytes"), F.octet_length(text).alias("text_bytes"), F.col(words).cast("bigint").alias("words"))
    groups = part.groupBy("lang", "words").agg(F.count("*").alias("c"), F.count("words").alias("worded"), F.sum("raw_bytes").alias("raw_bytes"), F.sum("text_bytes").alias("text_bytes"))
    whole = Window.partitionBy("lang")
    run = groups.withColumns({"upto": F.sum("worded").over(whole.orderBy("words")), "half": F.floor(F.sum("worded").over(whole) / 2)})
    middle = (F.col("worded") > 0) & (F.col("upto") > F.col("half")) & (F.col("upto") - F.col("worded") <= F.col("half"))
    mib = lambda x: F.round(F.sum(x) / 1048576, 2)
    return run.groupBy("lang").agg(
        F.sum("c").alias("docs"), mib("raw_bytes").alias("raw_size_mb"), mib("text_bytes").alias("text_size_mb"), F.round(F.sum("raw_bytes") / F.sum("c"), 2).alias("avg_raw_bytes_per_doc"),
        F.round(F.sum("text_bytes") / F.sum("c"), 2).alias("avg_text_bytes_per_doc"), F.round(F.try_divide(F.sum(F.col("words") * F.col("worded")), F.sum("worded")), 2).alias("avg_words_per_doc"),
        F.min("words").alias("min_words"), F.max("words").alias("max_words"), F.max(F.when(middle, F.col("words"))).alias("median_words_per_doc"),
    )


def totals(docs: DataFrame, raw: str = "raw", text: str = "text") -> DataFrame:
    """One row: docs and sizes in MiB over all languages, summed first and rounded once."""
    mib = lambda x: F.round(F.coalesce(F.sum(F.octet_length(x)), F.lit(0)) / 1048576, 2)
    return docs.agg(F.count("*").alias("docs"), mib(raw).alias("raw_size_mb"), mib(text).alias("text_size_mb"))


def sample(docs: DataFrame, per_lang: int = 12) -> DataFrame:
    """A fixed pseudo-random sample: the rows of each language with the smallest MD5 of doc_id. Top-k a language; Spark prunes with partial limits."""
    order = Window.partitionBy("lang").orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id")
    return docs.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= per_lang).drop("_at")
