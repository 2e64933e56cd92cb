"""Fuzzy line dedup over a corpus. DataFrame functions only.

Lines are normalised; equal ones become one. Every distinct line gets a SimHash fingerprint, made of blocks: its features
stand in the order of their hashes, and a block is the SimHash (the majority of the bits) of VOTERS features that follow
one another in that order, from the first on. So a feature votes in VOTERS blocks at most, and by the pigeonhole two lines
of which fewer than (number of blocks) / (2 * VOTERS - 1) features differ have a block in common: lines are joined on equal
blocks. (In a SimHash in which every feature votes for every bit, one changed word of ten moves 9 of 63 bits, which no
number of blocks worth joining on survives.) Features are words, and 4-grams of characters for lines that are short or have
few words; a line near a limit has both kinds. Up to DELETED characters, where one edit is allowed, the blocks are the line
and what is left of it without each one character, which every such pair shares. Lines that meet are linked if the edit
similarity of their normalised texts is at least SIMILAR, and by nothing else. Only the first WORD_BLOCKS and GRAM_BLOCKS
blocks of a line are made, so similar lines that share none of them are missed. Connected lines are a group, of which the
occurrence with the smallest (doc_id, line number) stays.

A list of lines under one block is tied as a star and a chain first; whole pairs are formed only where a list still holds
lines of several groups, and only for lines of different groups, so large groups of copies cost their size, not its square.

Defined results: null and empty texts have no lines; lines without a letter or digit are in no group and stay; rows that
share a doc_id and a text are one document; a null doc_id sorts before all; ties can't arise; empty tables give no rows;
extra columns, whatever their names, don't matter. Lines of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_table, new_table, numbered, parallelism, release
from .components import components
from .quality import let

#: The least edit similarity, 1 - distance / longer length, of linked lines. At 0.75, numbers of four digits that differ in
#: one are similar, and by them nearly all such lines (years, pages) would be one group; at 0.85 an edit needs 7 characters.
SIMILAR = 0.85
#: Features that vote in a block, and blocks of a line.
VOTERS, WORD_BLOCKS, GRAM_BLOCKS = 5, 13, 28
#: Lengths: one edit at most is allowed up to DELETED; words are features from WORDY characters on, 4-grams below SHORT
#: characters and of lines of less than FEW_WORDS different words. 4-grams of lines of LONG characters are made of a list.
DELETED, GRAMS_FROM, WORDY, SHORT, LONG, FEW_WORDS = 13, 12, 72, 84, 120, 16
BROADCAST_ROWS = 300_000
#: Bits of the table that says which lines are compared: 2**20 rows of 64 bits.
MARKS = 1 << 26


#: What stands between words: all but letters, marks and digits.
BETWEEN = r"[\P{L}&&\P{M}&&\P{N}]+"
WORD = r"[\p{L}\p{M}\p{N}]"
#: The same for lines in lower case in which all else than letters, marks and digits is ASCII (it costs less); what other lines have.
BETWEEN_ASCII, OTHER = r"[^a-z0-9\x{80}-\x{10ffff}]+", r"[^\x00-\x7f\p{L}\p{M}\p{N}]"


def words_of(line: Column) -> Column:
    """The words of a line in lower case; numbers are words."""
    return let(F.lower(line), lambda x: F.array_remove(F.when(x.rlike(OTHER), F.split(x, BETWEEN, -1)).otherwise(F.split(x, BETWEEN_ASCII, -1)), ""))


def normal(line: Column) -> Column:
    return F.array_join(words_of(line), " ")


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(-(1 << 63)).cast("bigint")).alias("d"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))


def simhash(s: Column, i: Column) -> Column:
    """The SimHash of the five hashes from place i on, the last two of which vote twice: bits that four of the seven votes are for."""
    a, b, c, d, e = (F.get(s, i + k if k else i) for k in range(VOTERS))
    three = a.bitwiseAND(b).bitwiseOR(c.bitwiseAND(a.bitwiseOR(b)))
    return d.bitwiseAND(e).bitwiseOR(three.bitwiseAND(d.bitwiseOR(e)))


def word_hash(word: Column) -> Column:
    """62 bits of the word's hash, behind two that put long words first (of 7 letters, of 5, of 4, shorter ones): words that
    many lines have are mostly short, and blocks of such words alone make lists of lines that have nothing else in common."""
    n = F.length(word)
    return F.shiftrightunsigned(F.xxhash64(word), 2) + F.when(n >= 7, F.lit(-(1 << 63))).when(n >= 5, F.lit(-(1 << 62))).when(n >= 4, F.lit(0)).otherwise(F.lit(1 << 62))


def first_features(hashes: Column, most: int) -> Column:
    """The features that vote in the first `most` blocks, in the order of their hashes."""
    return F.slice(F.array_distinct(F.sort_array(hashes)), 1, most + VOTERS - 1)


def _grams(line: Column, n: Column) -> Column:
    """Hashes of the 4-grams of characters. (A place in a string is found by counting, so long lines are cut into characters first.)"""
    short = lambda l: F.transform(F.sequence(F.lit(1), n + 1), lambda i: F.xxhash64(F.substring(l, i, F.lit(4))))
    at = lambda c, i, k: F.coalesce(F.get(c, i + k), F.lit(" "))
    long = let(F.split(line, ""), lambda c: F.transform(F.sequence(F.lit(-2), F.size(c) - 2), lambda i: F.xxhash64(F.concat(*[at(c, i, k) for k in range(4)]))))
    return F.when(n < LONG, let(F.concat(F.lit("  "), line, F.lit("  ")), short)).otherwise(long)


def alike_long(n: Column, m: Column) -> Column:
    """False only for lines (of n and m characters) whose lengths differ by more than similar lines may."""
    return F.abs(n - m) <= F.floor(F.greatest(n, m) * (1 - SIMILAR))


def hashed_lines(docs: DataFrame) -> DataFrame:
    """d, h, line_no, k1, k2 (hashes of the line), n (its length when normalised), and what its blocks
    are made of: by_words, by_grams, by_deletion, of every line with a word. docs: from keyed(). Lines of any length are
    normalised first."""
    lines = docs.select("d", "h", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    lines = lines.where(F.col("line").rlike(WORD)).withColumn("line", normal(F.col("line")))
    n, line = F.length("line"), F.col("line")
    words = first_features(F.transform(F.split(line, " ", -1), word_hash), WORD_BLOCKS)
    lines = lines.select("d", "h", "line_no", "line", n.cast("int").alias("n"), F.when(n >= WORDY, words).alias("by_words"))
    n = F.col("n")
    without = F.transform(F.sequence(F.lit(0), n), lambda i: F.xxhash64(F.lit(2), F.when(i == 0, line).otherwise(F.concat(F.substring(line, F.lit(1), i - 1), F.substring(line, i + 1, n)))))
    few_words = F.coalesce(F.size("by_words") < FEW_WORDS, F.lit(True))
    return lines.select(
        "d", "h", "line_no", F.xxhash64(line).alias("k1"), F.xxhash64(F.lit(1), line).alias("k2"), "n", "by_words",
        F.when((n >= GRAMS_FROM) & ((n < SHORT) | few_words), first_features(_grams(line, n), GRAM_BLOCKS)).alias("by_grams"),
        F.when((n >= 6) & (n <= DELETED), F.array_distinct(without)).alias("by_deletion"),
    )


def entered_blocks(distinct: DataFrame) -> DataFrame:
    """id, key for each block of each line. Fewer than VOTERS features make one block together."""
    count = lambda x: F.when(F.col(x).isNull(), 0).otherwise(F.greatest(F.size(x) - VOTERS + 1, F.least(F.size(x), F.lit(1))))
    nw, ng = count("by_words"), count("by_grams")
    total = nw + ng + F.coalesce(F.size("by_deletion"), F.lit(0))
    rows = distinct.where(total > 0).select("id", "by_words", "by_grams", "by_deletion", nw.alias("nw"), ng.alias("ng"), F.explode(F.sequence(F.lit(0), total - 1)).alias("i"))
    block = lambda x, kind, i: F.when(F.size(x) >= VOTERS, F.xxhash64(F.lit(kind), simhash(F.col(x), i))).otherwise(F.xxhash64(F.lit(kind), x))
    i, nw, ng = F.col("i"), F.col("nw"), F.col("ng")
    key = F.when(i < nw, block("by_words", 0, i)).when(i < nw + ng, block("by_grams", 1, i - nw)).otherwise(F.get("by_deletion", i - nw - ng))
    return rows.select("id", key.alias("key"))


def marked(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows (d, h, line_no and others) of all places in wanted and a few of other places, found without a shuffle of rows:
    places are bits of a table, about 16 bits a place and MARKS bits at most, which is broadcast."""
    bits = 1 << min(MARKS.bit_length() - 1, max(10, (16 * wanted.count()).bit_length()))
    slot = F.xxhash64("d", "h", "line_no").bitwiseAND(F.lit(bits - 1))
    marks = wanted.select(slot.alias("slot")).selectExpr("slot >> 6 AS word", "1L << cast(slot & 63 AS int) AS bit").groupBy("word").agg(F.bit_or("bit").alias("marks"))
    return rows.withColumn("slot", slot).withColumn("word", F.expr("slot >> 6")).join(F.broadcast(marks), "word").where("marks >> cast(slot & 63 AS int) & 1 = 1").drop("slot", "word", "marks")


def verified(docs: DataFrame, pairs: DataFrame, firsts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose normalised lines are similar, cut. firsts: id, d, h, line_no, n of each line."""
    spark = docs.sparkSession
    ends = lambda x: x.select(F.col("a").alias("id")).union(x.select("b")).distinct()
    met = cut(ends(pairs).join(firsts, "id"))
    few = F.broadcast if met.count() <= BROADCAST_ROWS else lambda x: x
    end = lambda x: few(met.select(F.col("id").alias(x), F.col("n").alias(f"n{x}")))
    pairs = cut(pairs.join(end("a"), "a").join(end("b"), "b").where(alike_long(F.col("na"), F.col("nb"))).select("a", "b").repartition(parallelism(spark), "a", "b"))
    wanted = cut(met.drop("n").join(few(ends(pairs)), "id"))
    many = wanted.count() > BROADCAST_ROWS
    del met
    few = (lambda x: x) if many else F.broadcast
    # Many lines: a shuffle of the lines alone; one of the documents before it would put the texts on disk twice.
    rows = docs if many else docs.join(few(wanted.select("d", "h").distinct()), ["d", "h"], "left_semi")
    rows = rows.select("d", "h", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    rows = marked(rows, wanted) if many else rows
    at = new_table(spark, "compared-lines")
    place = ["d", "h", "line_no"]
    rows.join(few(wanted), place).dropDuplicates(place).select("id", normal(F.col("line")).alias("line")).write.parquet(at)
    texts = spark.read.parquet(at)
    del wanted, rows
    release(spark)
    side = lambda x: texts.select(F.col("id").alias(x), F.col("line").alias(f"l{x}"))
    longer, shorter = F.greatest(F.length("la"), F.length("lb")), F.least(F.length("la"), F.length("lb"))
    allowed = F.floor(longer * (1 - SIMILAR)).cast("int")
    # The exact distance costs most. Two upper bounds of it, by what stands between the equal beginning and end and by words
    # at equal places, settle nearly all pairs that are similar. Each part is worked out once.
    equal_run = lambda x, y: F.coalesce(F.array_position(F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False))), False) - 1, F.lit(-1)).cast("int")
    by_place = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 0).otherwise(F.greatest(F.length(x), F.length(y)))), F.lit(0), lambda n, x: n + x)

    def middles(w: Column) -> Column:
        """What both begin and end with adds nothing to the distance; an empty middle (and its space) is settled by its length."""
        na, nb = F.size(w["a"]), F.size(w["b"])
        run = lambda r: F.struct(r.alias("start"), F.least(equal_run(F.reverse(w["a"]), F.reverse(w["b"])), F.least(na, nb) - r).alias("end"))
        cut_out = lambda x, n, r: F.slice(x, r["start"] + 1, F.greatest(n - r["start"] - r["end"], F.lit(0)))
        return let(let(equal_run(w["a"], w["b"]), run), lambda r: F.struct(cut_out(w["a"], na, r).alias("a"), cut_out(w["b"], nb, r).alias("b")))

    def judged(m: Column) -> Column:
        placed = F.when(F.size(m["a"]) == F.size(m["b"]), by_place(m["a"], m["b"]))
        return F.struct(allowed.alias("allowed"), F.coalesce(placed <= allowed, F.lit(False)).alias("close"), F.array_join(m["a"], " ").alias("a"), F.array_join(m["b"], " ").alias("b"))

    parts = F.when(F.col("la") == F.col("lb"), F.struct(allowed.alias("allowed"), F.lit(True).alias("close"), F.lit("").alias("a"), F.lit("").alias("b"))).otherwise(
        let(let(F.struct(F.split("la", " ").alias("a"), F.split("lb", " ").alias("b")), middles), judged)
    )
    # (The struct goes through a generator, below which no filter is pushed.)
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(longer - shorter <= allowed).select("a", "b", F.explode(F.array(parts)).alias("m"))
    between = F.greatest(F.length("m.a"), F.length("m.b")) + 1
    exact = (F.length("m.a") > 0) & (F.length("m.b") > 0) & (F.expr("levenshtein(m.a, m.b, m.allowed)") >= 0)
    # (Written first, as a checkpoint works its rows out twice.)
    similar = new_table(spark, "similar-lines")
    both.where(F.when(F.col("m.close") | (between <= F.col("m.allowed")), True).otherwise(exact)).select("a", "b").write.parquet(similar)
    links = cut(spark.read.parquet(similar))
    for path in (at, similar):
        drop_table(spark, path)
    release(spark)
    return links


def line_groups(docs: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """docs: from keyed(). (lines, groups, tables): d, h, line_no, k1, k2 of each line; k1, k2, stays (d, h, line_no) of each distinct
    normalised line; and the paths of the tables that the two are read from."""
    spark, rows = docs.sparkSession, docs
    by = ["by_words", "by_grams", "by_deletion"]
    whole, thin = [new_table(spark, f"{x}-blocks") for x in ("lines", "distinct-lines")], [new_table(spark, x) for x in ("lines", "distinct-lines")]
    hashed_lines(rows).write.parquet(whole[0])
    lines = spark.read.parquet(whole[0])
    # Lists name a line by k1 alone: a second line of the same k1 only adds to what is compared.
    distinct = lines.groupBy("k1", "k2").agg(F.min(F.struct("d", "h", "line_no")).alias("first"), *[F.first(x).alias(x) for x in ["n", *by]])
    distinct.write.parquet(whole[1])
    # What blocks are made of is most of both tables, and goes as soon as it has been used.
    lines.drop("n", *by).write.parquet(thin[0])
    drop_table(spark, whole[0])
    lines, distinct = spark.read.parquet(thin[0]), spark.read.parquet(whole[1])
    release(spark)
    in_order = Window.partitionBy("key").orderBy("id")
    table = new_table(spark, "line-lists")
    entered = entered_blocks(distinct.withColumnRenamed("k1", "id"))
    met = entered.withColumns({"before": F.lag("id").over(in_order), "after": F.lead("id").over(in_order), "star": F.first("id").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    met.where("before is not null or after is not null").drop("after").write.parquet(table)
    del entered, met
    release(spark)
    met = spark.read.parquet(table)
    distinct.drop(*by).write.parquet(thin[1])
    drop_table(spark, whole[1])
    distinct = spark.read.parquet(thin[1])

    near = met.where("before is not null").select(F.explode(F.array("before", "star")).alias("p"), F.col("id").alias("q"))
    ordered = lambda x: cut(x.where("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct())
    firsts = distinct.select(F.col("k1").alias("id"), "first.*", "n")
    links = verified(rows, ordered(near), firsts)

    # Lists whose lines are not all of one group: pairs of lines of different groups that the ties have missed.
    groups = components(links)
    named = met.select("key", "id").join(groups, "id", "left").withColumn("group", F.coalesce("component", "id")).drop("component")
    named = cut(named)
    mixed = named.groupBy("key").agg(F.min("group").alias("x"), F.max("group").alias("y")).where("x <> y").select("key")
    left = cut(named.join(mixed, "key", "left_semi").join(firsts.select("id", "n"), "id"))
    other = left.select("key", F.col("id").alias("q"), F.col("group").alias("other_group"), F.col("n").alias("m"))
    possible = (F.col("group") < F.col("other_group")) & alike_long(F.col("n"), F.col("m"))
    missed = left.withColumnRenamed("id", "p").join(other, "key").where(possible).select("p", "q")
    missed = ordered(missed).join(links, ["a", "b"], "left_anti")
    more = verified(rows, cut(missed), firsts)
    drop_table(spark, table)
    release(spark)
    groups = cut(components(links.union(more)))
    few = F.broadcast if groups.count() <= BROADCAST_ROWS else lambda x: x
    # Only lines with a link need their group's smallest occurrence; all others stay at their own first.
    linked = distinct.select("k1", "k2", "first", F.col("k1").alias("id")).join(few(groups), "id")
    stays = linked.groupBy("component").agg(F.min("first").alias("stays"))
    linked = cut(linked.join(stays, "component").select("k1", "k2", "stays"))
    release(spark)
    few = F.broadcast if linked.count() <= BROADCAST_ROWS else lambda x: x
    return lines, distinct.join(few(linked), ["k1", "k2"], "left").select("k1", "k2", F.coalesce("stays", "first").alias("stays")), thin


def line_verdicts(lines: DataFrame, groups: DataFrame) -> DataFrame:
    """d, h, line_no, stays (the occurrence of the line's group that stays), kept."""
    return lines.join(groups, ["k1", "k2"]).select("d", "h", "line_no", "stays", (F.struct("d", "h", "line_no") == F.col("stays")).alias("kept"))


def dedup_report(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), first_doc_id, first_line_no, kept of every line with a letter or digit."""
    real = lambda x: F.when(x != F.lit(-(1 << 63)).cast("bigint"), x)
    lines, groups, _ = line_groups(keyed(docs))
    return line_verdicts(lines, groups).select(real(F.col("d")).alias("doc_id"), "line_no", real(F.col("stays.d")).alias("first_doc_id"), F.col("stays.line_no").alias("first_line_no"), "kept")


def drop_lines(docs: DataFrame) -> DataFrame:
    """docs with repeated lines taken out of text and n_chars (if there) counted anew; a document that keeps no line with a word goes."""
    own, at = numbered(docs)
    lines, groups, tables = line_groups(keyed(own, at["doc_id"], at["text"]))
    out = cut(line_verdicts(lines, groups).where("not kept").groupBy("d", "h").agg(F.collect_set("line_no").alias("out")))  # at most a document's lines
    for table in tables:
        drop_table(docs.sparkSession, table)
    text = F.col(at["text"])
    joined = own.withColumns({"d": F.coalesce(F.col(at["doc_id"]).cast("bigint"), F.lit(-(1 << 63)).cast("bigint")), "h": F.xxhash64(text)}).join(out, ["d", "h"], "left")
    rest = let(F.split(text, "\n", -1), lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("out")), lambda i: F.get(ls, i)), "\n"))
    result = joined.withColumn(at["text"], F.when(F.col("out").isNull(), text).otherwise(rest)).where(F.col("out").isNull() | (F.size(words_of(text)) > 0))
    if "n_chars" in at:
        result = result.withColumn(at["n_chars"], F.when(F.col("out").isNull(), F.col(at["n_chars"])).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType)))
    return result.select(*at.values()).toDF(*docs.columns)
