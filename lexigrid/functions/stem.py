"""Suffix stemmers for English and Russian as Column -> Column functions. Lengths are in bytes, as the rules are stated."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import column, has_cyrillic, let

# Suffixes in the order in which they are tried.
REFLEXIVE = "ся сь".split()
ADJECTIVE = "ыми ими ого ему ому ее ие ое ая яя ый ий ой ые ие ых их ую юю".split()
VERB = "ившись ывшись вшись иться ать ять еть ить ыть нуть ала яла ела ила ыла али яли ели или ылы ает яет еет ит ют уют яют ешь ишь ем им ете ите ал ял ел ил ыл".split()
NOUN = "иями ями ами ов ев ей ам ям ах ях ом ем ой ей ою ею а я у ю е о ы и ь".split()
LEAST_LEFT = 4

VOWEL = "[aeiou]|.y"


def _drop(s: Column, n: int) -> Column:
    return F.substring(s, F.lit(1), F.length(s) - n)


def _voiced(s: Column) -> Column:
    """A vowel anywhere, or a y that isn't first."""
    return s.rlike(VOWEL)


def _plural(s: Column) -> Column:
    return (
        F.when(s.endswith("sses") | s.endswith("ies"), _drop(s, 2)).when(s.endswith("ss"), s)
        .when(s.endswith("s") & (F.octet_length(s) > 3) & _voiced(_drop(s, 1)), _drop(s, 1)).otherwise(s)
    )


def _past(s: Column) -> Column:
    return (
        F.when(s.endswith("eed"), F.when(F.octet_length(s) > 4, _drop(s, 1)).otherwise(s))
        .when(s.endswith("ed"), F.when(_voiced(_drop(s, 2)), _drop(s, 2)).otherwise(s))
        .when(s.endswith("ing") & _voiced(_drop(s, 3)), _drop(s, 3)).otherwise(s)
    )


def _restore(s: Column) -> Column:
    return F.when(s.rlike("(at|bl|iz)$"), F.concat(s, F.lit("e"))).otherwise(s)


def _undouble(s: Column) -> Column:
    return F.when(s.rlike(r"(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx)$"), _drop(s, 1)).otherwise(s)


def _final_y(s: Column) -> Column:
    return F.when(s.endswith("y") & _voiced(_drop(s, 1)), F.concat(_drop(s, 1), F.lit("i"))).otherwise(s)


def stem_en(token: Column | str) -> Column:
    def rest(s: Column) -> Column:
        return F.when(F.octet_length(s) < 3, s).otherwise(let(_past(s), lambda a: let(_restore(a), lambda b: let(_undouble(b), _final_y))))

    whole = column(token)
    return F.when(F.octet_length(whole) < 3, whole).otherwise(let(_plural(whole), rest))


def _strip(s: Column, suffixes: list[str]) -> Column:
    """The token without the first listed suffix that leaves LEAST_LEFT bytes; null if there is none."""
    first = lambda chain, x: chain.when(s.endswith(x) & (F.octet_length(s) - len(x.encode()) >= LEAST_LEFT), _drop(s, len(x)))
    return reduce(first, suffixes, F.when(F.lit(False), s))


def stem_ru(token: Column | str) -> Column:
    def rest(s: Column) -> Column:
        noun = lambda x: F.coalesce(_strip(x, NOUN), x)
        return let(_strip(s, ADJECTIVE), lambda adj: F.when(adj.isNotNull(), noun(adj)).otherwise(F.coalesce(_strip(s, VERB), _strip(s, NOUN), s)))

    whole = column(token)
    return let(F.coalesce(_strip(whole, REFLEXIVE), whole), rest)


def stem(token: Column | str, lang: str = "auto") -> Column:
    """lang: en or ru; anything else looks for Cyrillic letters in the token."""
    if lang == "en":
        return stem_en(token)
    if lang == "ru":
        return stem_ru(token)
    return F.when(has_cyrillic(token), stem_ru(token)).otherwise(stem_en(token))


def stem_table(tokens: DataFrame, lang: str = "auto", name: str = "token") -> DataFrame:
    """token, stem of each distinct token: the rules run once a word of the vocabulary, not once an occurrence."""
    return tokens.select(F.col(name).alias("token")).distinct().withColumn("stem", stem("token", lang))


def stem_counts(tokens: DataFrame, lang: str = "auto", name: str = "token") -> DataFrame:
    """tokens_in, changed: occurrences, and those whose stem differs."""
    counted = tokens.groupBy(F.col(name).alias("token")).agg(F.count("*").alias("n")).withColumn("stem", stem("token", lang))
    return counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum(F.when(F.col("stem") != F.col("token"), F.col("n"))), F.lit(0)).alias("changed"))


def _sql_strip(s: str, suffixes: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN ends_with({s}, '{x}') AND strlen({s}) - {len(x.encode())} >= {LEAST_LEFT} THEN left({s}, length({s}) - {len(x)})" for x in suffixes) + " END"


def sql_stem_en(source: str, keep: str = "token") -> str:
    """DuckDB SQL: source (a query with column `keep`) with its stem in column `stem`."""
    return f"""
WITH s0 AS ({source}),
s1 AS (SELECT *, CASE WHEN strlen({keep}) < 3 THEN {keep} WHEN ends_with({keep}, 'sses') OR ends_with({keep}, 'ies') THEN left({keep}, length({keep}) - 2)
  WHEN ends_with({keep}, 'ss') THEN {keep} WHEN ends_with({keep}, 's') AND strlen({keep}) > 3 AND regexp_matches(left({keep}, length({keep}) - 1), '{VOWEL}') THEN left({keep}, length({keep}) - 1) ELSE {keep} END AS a FROM s0),
s2 AS (SELECT *, CASE WHEN strlen(a) < 3 THEN a WHEN ends_with(a, 'eed') THEN CASE WHEN strlen(a) > 4 THEN left(a, length(a) - 1) ELSE a END
  WHEN ends_with(a, 'ed') THEN CASE WHEN regexp_matches(left(a, length(a) - 2), '{VOWEL}') THEN left(a, length(a) - 2) ELSE a END
  WHEN ends_with(a, 'ing') AND regexp_matches(left(a, length(a) - 3), '{VOWEL}') THEN left(a, length(a) - 3) ELSE a END AS b FROM s1),
s3 AS (SELECT *, CASE WHEN strlen(a) >= 3 AND regexp_matches(b, '(at|bl|iz)$') THEN b || 'e' ELSE b END AS c FROM s2),
s4 AS (SELECT *, CASE WHEN strlen(a) >= 3 AND regexp_matches(c, '(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx)$') THEN left(c, length(c) - 1) ELSE c END AS d FROM s3)
SELECT * EXCLUDE (a, b, c, d), CASE WHEN strlen(a) >= 3 AND ends_with(d, 'y') AND regexp_matches(left(d, length(d) - 1), '{VOWEL}') THEN left(d, length(d) - 1) || 'i' ELSE d END AS stem FROM s4"""


def sql_stem_ru(source: str, keep: str = "token") -> str:
    return f"""
WITH r0 AS ({source}),
r1 AS (SELECT *, coalesce({_sql_strip(keep, REFLEXIVE)}, {keep}) AS a FROM r0),
r2 AS (SELECT *, {_sql_strip("a", ADJECTIVE)} AS b, {_sql_strip("a", VERB)} AS c, {_sql_strip("a", NOUN)} AS d FROM r1)
SELECT * EXCLUDE (a, b, c, d), CASE WHEN b IS NOT NULL THEN coalesce({_sql_strip("b", NOUN)}, b) ELSE coalesce(c, d, a) END AS stem FROM r2"""
