"""Benchmark decontamination over a distributed positional inverted index. DataFrame functions only.

Training texts become postings (term, document, position). Corpus counts of the benchmark's terms tell, for every
window of an item, its ANCHORS rarest terms; the stored index holds the postings of those. Offset-adjusted postings of
one item (position minus offset in the item) meet at the same alignment of a document; an alignment at which all
anchors of some window meet is a candidate, and the candidate's whole alignment is then compared with the document's
words, which gives exact phrase matches. Proximity matches ask for the anchors of an item within a span, in any order.

Defined results: a null or word-free text has no words and no hits; an item without words occurs nowhere; an item of
fewer words than a window is one window; repeated rows are judged alike, each by itself; ties between equally rare
terms go to the smaller term; empty tables give no rows or no hits; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_table, new_table, numbered, parallelism, small
from .quality import let

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words. Splitting on it is ten times as fast as extracting its complement.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, ANCHORS = 10, 2
#: Terms that a proximity match asks for.
NEAR_ANCHORS = 3


def terms(text: Column) -> Column:
    """The words of a text, A-Z lower-cased. lower() does it for texts of ASCII alone; others keep their other capitals."""
    t = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))
    return F.array_remove(F.split(low, BETWEEN, -1), "")


def items_of(benchmark: DataFrame) -> DataFrame:
    """item, item_id, words, n: items that have words; a row that is there twice counts once. item is a hash of item_id and words, so
    rows that share an item_id keep apart and a null one is an item as well."""
    rows = benchmark.select("item_id", terms(F.col("text")).alias("words")).distinct().withColumn("n", F.size("words")).where("n > 0")
    return cut(rows.withColumn("item", F.xxhash64(F.col("item_id").isNull(), "item_id", "words")))


#: Stands for a null doc_id in d, which with h only tells texts apart; results take the row's own doc_id.
NO_ID = -(1 << 63)


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, and d and h by which postings name a text: doc_id and a hash of the text, so rows that share a doc_id keep apart."""
    own = F.col(doc_id).cast("bigint")
    return docs.select(own.alias("doc_id"), F.coalesce(own, F.lit(NO_ID).cast("bigint")).alias("d"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))


def postings(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, d, h, pos), pos from 0, for the terms in wanted. docs: from keyed()."""
    rows = docs.select("d", "h", F.posexplode(terms(F.col("text"))).alias("pos", "term"))
    return rows.join(wanted, "term").select("term", "d", "h", "pos")


def term_counts(docs: DataFrame, items: DataFrame) -> DataFrame:
    """term, cf: how often the corpus holds each term of the items that it holds at all."""
    vocabulary = items.select(F.explode("words").alias("term")).distinct()
    return docs.select(F.explode(terms(F.col("text"))).alias("term")).join(small(vocabulary), "term").groupBy("term").agg(F.count("*").alias("cf"))


def anchors_of(docs: DataFrame, items: DataFrame, window: int = WINDOW, anchors: int = ANCHORS) -> DataFrame:
    """item, start, and `at`, the places in the item of the rarest terms of the window that starts there.

    A window with a term that no document holds can't occur and has no row.
    """
    counts = term_counts(docs, items)
    width = F.least(F.col("n"), F.lit(window))
    places = (
        items.withColumn("width", width).withColumn("start", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("width"))))
        .withColumn("q", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("width") - 1)))
        .select("item", "start", "width", "q", F.get("words", F.col("q")).alias("term"))
    )
    found = places.join(small(cut(counts)), "term")
    in_order = F.sort_array(F.collect_list(F.struct("cf", "term", "q")))  # at most `window` of them
    windows = found.groupBy("item", "start", "width").agg(in_order.alias("rare")).where(F.size("rare") == F.col("width"))
    return windows.select("item", "start", F.transform(F.slice("rare", 1, anchors), lambda r: r["q"]).alias("at"))


def build_index(docs: DataFrame, wanted: DataFrame, path: str) -> DataFrame:
    """Store the postings of the wanted terms, each term's dealt over all files by document and in order in each, and read them back."""
    spark = docs.sparkSession
    postings(docs, small(wanted)).repartition(parallelism(spark), "term", "d").sortWithinPartitions("term", "d", "h", "pos").write.parquet(path)
    return spark.read.parquet(path)


def alignments(index: DataFrame, items: DataFrame, windows: DataFrame) -> DataFrame:
    """(d, h, item, shift): the item's word 0 would stand at the document's word `shift`, and some window's anchors all agree."""
    places = windows.select("item", F.explode("at").alias("q")).distinct().join(items, "item").select("item", "q", F.get("words", F.col("q")).alias("term"))
    met = index.join(small(cut(places)), "term").select("d", "h", "item", (F.col("pos") - F.col("q")).alias("shift"), "q")
    met = met.groupBy("d", "h", "item", "shift").agg(F.collect_set("q").alias("qs"))  # at most an item's length
    per_item = windows.groupBy("item").agg(F.collect_set("at").alias("windows"))
    whole = F.exists("windows", lambda at: F.size(F.array_except(at, F.col("qs"))) == 0)
    return met.join(small(cut(per_item)), "item").where(whole).select("d", "h", "item", "shift")


def _matches(words: Column, c: Column, window: int) -> Column:
    """The stretches (from, to) of the document in which windows of candidate c really occur: what lies between two words that
    don't agree, if it is as long as a window."""
    n = F.size(c["words"])
    differs = F.transform(c["words"], lambda w, q: F.when(F.coalesce(F.get(words, c["shift"] + q) == w, F.lit(False)), F.lit(None)).otherwise(q))
    edges = F.concat(F.array(F.lit(-1)), F.filter(differs, lambda q: q.isNotNull()), F.array(n))
    spans = let(edges, lambda e: F.transform(F.sequence(F.lit(0), F.size(e) - 2), lambda k: F.struct((c["shift"] + F.get(e, k) + 1).alias("a"), (c["shift"] + F.get(e, k + 1)).alias("b"))))
    return F.filter(spans, lambda s: s["b"] - s["a"] >= F.least(n, F.lit(window)))


def verified(docs: DataFrame, candidates: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs' doc_id, d, h, n_words and hits: an array of (item_id, spans) of the exact phrase matches.

    Only texts that have a candidate meet the items; all others give their numbers of words, and no text of theirs is shuffled.
    """
    with_words = candidates.join(small(items.select("item", "item_id", "words")), "item")
    of_doc = with_words.groupBy("d", "h").agg(F.collect_list(F.struct("item_id", "shift", "words")).alias("c"))  # at most a document's words times the items
    texts = docs.join(small(cut(candidates.select("d", "h").distinct())), ["d", "h"], "left_semi").dropDuplicates(["d", "h"])
    checked = lambda w: F.filter(F.transform("c", lambda c: F.struct(c["item_id"].alias("item_id"), _matches(w, c, window).alias("spans"))), lambda m: F.size(m["spans"]) > 0)
    hits = cut(texts.join(of_doc, ["d", "h"]).select("d", "h", let(terms(F.col("text")), checked).alias("hits")).where(F.size("hits") > 0))
    numbers = docs.select("doc_id", "d", "h", F.size(terms(F.col("text"))).cast("bigint").alias("n_words"))
    return numbers.join(small(hits), ["d", "h"], "left").withColumn("hits", F.coalesce("hits", F.array().cast(hits.schema["hits"].dataType)))


def union_length(spans: Column) -> Column:
    """Places that a sorted array of (a, b) covers."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("reach"))
    step = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(s["reach"], x["a"]))).cast("bigint").alias("n"), F.greatest(s["reach"], x["b"]).alias("reach"))
    return F.aggregate(spans, start, step, lambda s: s["n"])


def phrase_hits(rows: DataFrame, benchmark: DataFrame, window: int = WINDOW, anchors: int = ANCHORS) -> DataFrame:
    """doc_id, d, h, n_words, hits of every row. rows: from keyed()."""
    items = items_of(benchmark)
    windows = cut(anchors_of(rows, items, window, anchors))
    wanted = windows.select("item", F.explode("at").alias("q")).join(items, "item").select(F.get("words", F.col("q")).alias("term")).distinct()
    table = new_table(rows.sparkSession, "postings")
    candidates = cut(alignments(build_index(rows, cut(wanted), table), items, windows))
    drop_table(rows.sparkSession, table)
    return verified(rows, candidates, items, window)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of docs."""
    hits = phrase_hits(keyed(docs), benchmark)
    spans = F.sort_array(F.flatten(F.transform("hits", lambda m: m["spans"])))
    items = F.sort_array(F.array_distinct(F.transform("hits", lambda m: m["item_id"].cast("string"))))
    return hits.select(
        "doc_id", "n_words", union_length(spans).alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no window of the benchmark occurs."""
    own, at = numbered(docs)
    hits = cut(phrase_hits(keyed(own, at["doc_id"], at["text"]), benchmark).where(F.size("hits") > 0).select("d", "h").distinct())
    key = {"d": F.coalesce(F.col(at["doc_id"]).cast("bigint"), F.lit(NO_ID).cast("bigint")), "h": F.xxhash64(at["text"])}
    return own.withColumns(key).join(small(hits), ["d", "h"], "left_anti").select(*at.values()).toDF(*docs.columns)


def proximity(docs: DataFrame, benchmark: DataFrame, slack: int = 10, anchors: int = NEAR_ANCHORS) -> DataFrame:
    """(doc_id, item_id): documents that hold an item's `anchors` rarest terms, in any order, within the item's width plus slack.

    The terms are chosen among those that some document holds, so unknown words of an item don't count; an item with fewer
    known terms asks for those it has, and one without any occurs nowhere.

    Postings of the rarest term meet the others in blocks of that span, so no list is paired with a whole other list. Null and
    empty texts match nothing, repeated rows give one pair, empty tables none; a doc_id of -2**63 reads as null.
    """
    rows, items = keyed(docs), items_of(benchmark)
    known = items.select("item", "n", F.explode(F.array_distinct("words")).alias("term")).join(small(cut(term_counts(rows, items))), "term")
    in_order = F.sort_array(F.collect_list(F.struct("cf", "term")))  # at most an item's length
    rarest = known.groupBy("item", "n").agg(F.slice(in_order, 1, anchors).alias("rare"))
    named = cut(rarest.select("item", (F.col("n") + slack).alias("span"), F.transform("rare", lambda r: r["term"]).alias("terms")))
    index = build_index(rows, named.select(F.explode("terms").alias("term")).distinct(), new_table(docs.sparkSession, "postings"))
    flat = small(cut(named.select("item", "span", F.size("terms").alias("n_terms"), F.posexplode("terms").alias("k", "term"))))
    found = index.join(flat, "term").withColumn("block", F.floor(F.col("pos") / F.col("span")))
    first = found.where("k = 0").select("d", "h", "item", "span", "n_terms", F.col("pos").alias("p"), F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)).alias("block"))
    near = first.join(found.where("k > 0").select("d", "h", "item", "block", "k", "pos"), ["d", "h", "item", "block"], "left").where("pos is null or abs(pos - p) < span")
    # All terms lie in a stretch of `span` that holds p: for one of the two ends, every term has a place on the right side.
    ends = near.groupBy("d", "h", "item", "span", "n_terms", "p").agg(F.sort_array(F.collect_set(F.struct("pos", "k"))).alias("ps"))
    at = F.transform(F.sequence(F.lit(0), F.col("span") - 1), lambda s: F.col("p") - s)
    fits = F.exists(at, lambda a: F.size(F.array_distinct(F.transform(F.filter("ps", lambda x: (x["pos"] >= a) & (x["pos"] < a + F.col("span"))), lambda x: x["k"]))) == F.col("n_terms") - 1)
    return ends.where(fits).join(small(items.select("item", "item_id")), "item").select(F.when(F.col("d") != F.lit(NO_ID).cast("bigint"), F.col("d")).alias("doc_id"), "item_id").distinct()


def oracle() -> str:
    """DuckDB SQL for decontaminate()."""
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
pieces AS (SELECT item_id, least(len(w), {WINDOW}) AS width, w, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS s FROM items WHERE len(w) > 0),
wanted AS (SELECT DISTINCT item_id, width, array_to_string(w[s:s + width - 1], ' ') AS g FROM pieces),
places AS (SELECT id, width, w, unnest(range(1, len(w) - width + 2)) AS s FROM docs, (SELECT DISTINCT width FROM wanted) WHERE len(w) >= width),
found AS (SELECT p.id, p.s, p.width, x.item_id FROM places p JOIN wanted x ON x.width = p.width AND x.g = array_to_string(p.w[p.s:p.s + p.width - 1], ' ')),
hit AS (SELECT id, count(DISTINCT i) AS n FROM (SELECT id, unnest(range(s, s + width)) AS i FROM (SELECT DISTINCT id, s, width FROM found)) GROUP BY id),
named AS (SELECT id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT id, item_id::VARCHAR AS item FROM found) GROUP BY id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items, sha256(coalesce(named.items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit ON hit.id = docs.id LEFT JOIN named ON named.id = docs.id
"""
