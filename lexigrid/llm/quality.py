"""Quality rules whose cutoffs are chosen under risk control. DataFrame functions only.

Every text gets counts and, from them, the rates of RULES. Labelled documents that pass the base rule are divided by
doc_id into a tuning and a holdout half. In each stratum (lang), tuning proposes for every level of LEVELS a cutoff a
rule: the value that as many of a thousand good documents exceed as the level says; only rules that reject bad
documents at LIFT times the rate of good ones take part. A level is accepted if, at confidence 1 - DELTA divided by the
number of (stratum, level) pairs tested (Bonferroni), the exact binomial upper bound of its false rejection on the
holdout is at most RISK. Among accepted levels the one that rejects most bad tuning documents is used, the lower level
at a tie; a stratum without an accepted level rejects nothing beyond the base rule.

Defined results: null and empty texts have counts of 0 and fail the base rule; a null or unlabelled lang is a stratum
by itself or has no cutoffs; a doc_id labelled more than once counts by its lowest label; repeated documents are judged
alike; an empty documents or labels table gives no rows or base verdicts alone; extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, new_table, numbered, small

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
#: Rates by name, as (numerator, denominator) among the counted columns.
RULES = {
    "symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"),
    "capitals": ("n_capitals", "word_chars"), "marks": ("n_marks", "word_chars"), "digits": ("n_digits", "word_chars"), "word_length": ("word_chars", "n_words"),
}
#: Good tuning documents in a thousand that may exceed a cutoff.
LEVELS = (0, 1, 2, 5, 10)
RISK, DELTA, LIFT = 0.02, 0.05, 5
#: Rates are counted by so many buckets to 1 at first, and the rest in one.
BUCKETS, MOST_BUCKETS = 4096, 1 << 16
CAPITALS, MARKS = r"[^A-Z\x{C0}-\x{D6}\x{D8}-\x{DE}]+", r"[^!?]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once a row, wherever the optimiser moves the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _left(text: Column, removed: str) -> Column:
    return F.length(F.regexp_replace(text, removed, "")).cast("bigint")


def _repeated(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)))

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("reach"))
        step = lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(a["reach"], p)).cast("bigint").alias("n"), (p + 3).alias("reach"))
        return F.aggregate(places, start, step, lambda a: a["n"])

    def twice(h: Column) -> Column:
        in_order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        same = lambda s, i, j: F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
        again = lambda s: F.filter(s, lambda x, i: same(s, i, i - 1) | same(s, i, i + 1))
        return let(in_order, lambda s: covered(F.sort_array(F.transform(again(s), lambda x: x["p"]))))

    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), twice(h)).otherwise(F.lit(0).cast("bigint")))
    return F.when(n >= 4, some).otherwise(F.lit(0).cast("bigint"))


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts and base_failed, in one pass over the texts and without a shuffle."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_extract_all(t, F.lit(f"({WORD})"), F.lit(1))
    lines = let(F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0), lambda x: F.struct(F.size(x).cast("bigint").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("dup")))
    counts = let(words, lambda w: F.struct(F.size(w).cast("bigint").alias("n"), _repeated(w).alias("again")))
    return (
        docs.withColumn("_w", counts).withColumn("_l", lines)
        .withColumns({
            "n_words": F.col("_w.n"), "word_chars": _left(t, r"[\x20\x09-\x0D]+"), "n_symbols": _left(t, r"[^#*$%&|<>]+"),
            "n_dup_lines": F.col("_l.dup"), "n_repeat_words": F.col("_w.again"), "n_lines": F.col("_l.n"),
            "n_capitals": _left(t, CAPITALS), "n_marks": _left(t, MARKS), "n_digits": _left(t, "[^0-9]+"),
        }).drop("_w", "_l")
        .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    )


def rate(rule: str) -> Column:
    above, below = RULES[rule]
    return F.when(F.col(below) > 0, F.col(above) / F.col(below)).otherwise(0.0)


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Bin(n, p), summed exactly from the log of each term."""
    start = F.struct((n * F.log(F.lit(1 - p))).alias("log_term"), F.exp(n * F.log(F.lit(1 - p))).alias("total"))

    def step(a: Column, i: Column) -> Column:
        term = a["log_term"] + F.log((n - i + 1) / i) + F.log(F.lit(p / (1 - p)))
        return F.struct(term.alias("log_term"), (a["total"] + F.exp(term)).alias("total"))

    return F.when(k >= n, 1.0).when(k < 1, F.exp(n * F.log(F.lit(1 - p)))).otherwise(F.aggregate(F.sequence(F.lit(1).cast("bigint"), k), start, step, lambda a: a["total"]))


def _policies(tuning: DataFrame) -> DataFrame:
    """A row for each stratum and level: the cutoff of each rule that is of use, else null."""
    rates = F.array(*[F.struct(F.lit(r).alias("rule"), rate(r).alias("x")) for r in RULES])
    long = cut(tuning.select("stratum", "quality", F.explode(rates).alias("r")).select("stratum", "quality", "r.rule", "r.x"))
    good = long.where("quality = 1").withColumn("bucket", F.least(F.floor(F.col("x") * BUCKETS), F.lit(MOST_BUCKETS)).cast("int"))
    # The (n * level / 1000 + 1)-th largest value: first the bucket that holds it, then its place among the values of that bucket
    # alone, so no task holds the values of a stratum.
    down = Window.partitionBy("stratum", "rule").orderBy(F.desc("bucket"))
    sums = good.groupBy("stratum", "rule", "bucket").agg(F.count("*").alias("c")).withColumns({"upto": F.sum("c").over(down), "n": F.sum("c").over(Window.partitionBy("stratum", "rule"))})
    nth = sums.withColumn("level", F.explode(F.lit(list(LEVELS)))).withColumn("nth", F.floor(F.col("n") * F.col("level") / 1000) + 1)
    nth = cut(nth.where("nth <= upto and nth > upto - c").select("stratum", "rule", "level", "bucket", (F.col("nth") - F.col("upto") + F.col("c")).alias("nth")))
    values = good.groupBy("stratum", "rule", "bucket", "x").agg(F.count("*").alias("c")).join(small(nth), ["stratum", "rule", "bucket"])
    in_bucket = Window.partitionBy("stratum", "rule", "level").orderBy(F.desc("x"))
    cutoffs = values.withColumn("upto", F.sum("c").over(in_bucket)).where("nth <= upto and nth > upto - c").select("stratum", "rule", "level", F.col("x").alias("cutoff"))
    cutoffs = small(cut(cutoffs))
    caught = long.join(cutoffs, ["stratum", "rule"]).groupBy("stratum", "rule", "level", "cutoff").agg(
        F.count_if((F.col("quality") == 1) & (F.col("x") > F.col("cutoff"))).alias("good_out"), F.count_if(F.col("quality") == 1).alias("good"),
        F.count_if((F.col("quality") == 0) & (F.col("x") > F.col("cutoff"))).alias("bad_out"), F.count_if(F.col("quality") == 0).alias("bad"),
    )
    useful = (F.col("bad_out") > 0) & (F.col("bad_out") * F.col("good") >= LIFT * F.col("good_out") * F.col("bad"))
    return caught.groupBy("stratum", "level").agg(*[F.max(F.when((F.col("rule") == r) & useful, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES])


def rejects() -> Column:
    """Whether a rule of the policy on the row rejects it."""
    out = F.lit(False)
    for r in RULES:
        out = out | F.coalesce(rate(r) > F.col(f"cut_{r}"), F.lit(False))
    return out


def calibrate(features: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """A row for each stratum that has an accepted level: its cutoffs. features: from counted(), with doc_id."""
    marks = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = sorted({c for pair in RULES.values() for c in pair})
    half = F.pmod(F.col("doc_id"), F.lit(2147483647)) * 48271 % 2147483647 % 2
    labelled = cut(features.where("not base_failed").withColumn("stratum", F.coalesce(F.col(stratum), F.lit(""))).select("doc_id", "stratum", *counts).join(marks, "doc_id").withColumn("half", half))
    tuning, holdout = labelled.where("half = 0"), labelled.where("half <> 0")
    policies = cut(_policies(tuning))
    few = small(policies)
    tried = lambda rows: rows.join(few, "stratum").withColumn("out", rejects())
    held = tried(holdout.where("quality = 1")).groupBy("stratum", "level").agg(F.count("*").alias("n"), F.count_if("out").alias("k"))
    tests = held.agg(F.count("*").alias("tests"))
    caught = tried(tuning.where("quality = 0")).groupBy("stratum", "level").agg(F.count_if("out").alias("caught"))
    accepted = (
        held.join(F.broadcast(tests)).where(binomial_cdf(F.col("k"), F.col("n"), RISK) <= DELTA / F.col("tests"))
        .join(caught, ["stratum", "level"]).where("caught > 0")
    )
    best = accepted.groupBy("stratum").agg(F.max(F.struct("caught", (-F.col("level")).alias("minus"))).alias("best")).select("stratum", (-F.col("best.minus")).alias("level"))
    return policies.join(best, ["stratum", "level"])


def judge(features: DataFrame, policy: DataFrame, stratum: str = "lang") -> DataFrame:
    """features with `kept`. policy: from calibrate(), a row a stratum."""
    named = policy.drop("level").withColumnRenamed("stratum", "_stratum")
    joined = features.join(small(named), F.coalesce(F.col(stratum), F.lit("")) == F.col("_stratum"), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~rejects()).drop(*named.columns)


BASE_COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The counts, base verdict and verdict of each row of docs."""
    features = cut(counted(docs.select("doc_id", "lang", "text")).drop("text"))
    return judge(features, cut(calibrate(features, labels))).select(*BASE_COLUMNS)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with their own columns. The texts are counted once: rows and counts are written to a
    table in the shared folder, from which the cutoffs are chosen and the kept rows are read."""
    own, at = numbered(docs)
    table = new_table(docs.sparkSession, "counted")
    counted(own.withColumns({"doc_id": F.col(at["doc_id"]), "lang": F.col(at["lang"])}), at["text"]).write.parquet(table)
    rows = docs.sparkSession.read.parquet(table)
    policy = cut(calibrate(rows, labels))
    return judge(rows, policy).where("kept").select(*at.values()).toDF(*docs.columns)


def oracle() -> str:
    """DuckDB SQL for quality()."""
    ratio = lambda r: "CASE WHEN {1} > 0 THEN {0}::DOUBLE / {1} ELSE 0.0 END".format(*RULES[r])
    out = " OR ".join(f"coalesce({ratio(r)} > cut_{r}, false)" for r in RULES)
    cuts = ", ".join(f"max(CASE WHEN rule = '{r}' AND bad_out > 0 AND bad_out * good >= {LIFT} * good_out * bad THEN cutoff END) AS cut_{r}" for r in RULES)
    values = " UNION ALL ".join(f"SELECT stratum, quality, '{r}' AS rule, {ratio(r)} AS x FROM tuning" for r in RULES)
    return rf"""
WITH base AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t, row_number() OVER () AS id FROM documents),
split_words AS (SELECT id, regexp_extract_all(t, '{WORD}') AS w, string_split(t, chr(10)) AS l FROM base),
windows AS (SELECT id, unnest(range(1, len(w) - 1)) AS i, w FROM split_words WHERE len(w) >= 4),
grams AS (SELECT id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM windows),
again AS (SELECT id, i FROM grams QUALIFY count(*) OVER (PARTITION BY id, g) > 1),
covered AS (SELECT id, count(DISTINCT i + j) AS n FROM again, range(0, 3) s(j) GROUP BY id),
ll AS (SELECT id, list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l, len(w) AS n_words FROM split_words),
features AS (
  SELECT b.doc_id, b.stratum, ll.n_words::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
    length(regexp_replace(t, '{CAPITALS}', '', 'g')) AS n_capitals, length(regexp_replace(t, '{MARKS}', '', 'g')) AS n_marks,
    length(regexp_replace(t, '[^0-9]+', '', 'g')) AS n_digits
  FROM base b JOIN ll ON ll.id = b.id LEFT JOIN covered c ON c.id = b.id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM features),
labelled AS (
  SELECT f.*, q.quality, ((f.doc_id % 2147483647 + 2147483647) % 2147483647 * 48271) % 2147483647 % 2 AS half
  FROM f JOIN (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IN (0, 1) GROUP BY doc_id) q ON q.doc_id = f.doc_id WHERE NOT base_failed),
tuning AS (SELECT * FROM labelled WHERE half = 0),
long AS ({values}),
ranked AS (SELECT stratum, rule, x, row_number() OVER (PARTITION BY stratum, rule ORDER BY x DESC) AS nth, count(*) OVER (PARTITION BY stratum, rule) AS n FROM long WHERE quality = 1),
cutoffs AS (SELECT stratum, rule, level, x AS cutoff FROM ranked, (VALUES {", ".join(f"({x})" for x in LEVELS)}) v(level) WHERE nth = n * level // 1000 + 1),
caught AS (
  SELECT stratum, rule, level, cutoff, count(*) FILTER (quality = 1 AND x > cutoff) AS good_out, count(*) FILTER (quality = 1) AS good,
    count(*) FILTER (quality = 0 AND x > cutoff) AS bad_out, count(*) FILTER (quality = 0) AS bad
  FROM long JOIN cutoffs USING (stratum, rule) GROUP BY ALL),
policies AS (SELECT stratum, level, {cuts} FROM caught GROUP BY ALL),
held AS (SELECT stratum, level, count(*) AS n, count(*) FILTER ({out}) AS k FROM labelled JOIN policies USING (stratum) WHERE half <> 0 AND quality = 1 GROUP BY ALL),
bad_out AS (SELECT stratum, level, count(*) FILTER ({out}) AS caught FROM tuning JOIN policies USING (stratum) WHERE quality = 0 GROUP BY ALL),
accepted AS (
  SELECT stratum, level, caught FROM held JOIN bad_out USING (stratum, level)
  WHERE caught > 0 AND list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK}) + (n - i) * ln(1 - {RISK})))) <= {DELTA} / (SELECT count(*) FROM held)),
chosen AS (SELECT * FROM policies JOIN (SELECT stratum, level FROM accepted QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY caught DESC, level) = 1) USING (stratum, level))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({out}) AS kept
FROM f LEFT JOIN chosen USING (stratum)
"""
