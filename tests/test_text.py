"""Golden vectors of tokens, stems and URLs."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexigrid.functions import stem, text, urls

BODY = "COVID-19 affects CD4+ T-cells. Alzheimer's disease. Человек-нейрон 3.14 is pi, U.S.A. β-amyloid and μ-opioid receptors"
GOLDEN = {
    "wide": "covid-19 affects cd4 t-cells alzheimer's disease человек-нейрон 3.14 is pi u s a β-amyloid and μ-opioid receptors",
    "index": "covid-19 affects cd4 t-cells alzheimer's disease человек-нейрон 3.14 is pi u s a amyloid and opioid receptors",
    "plain": "covid-19 affects cd4 t-cells alzheimer s disease человек-нейрон 3 14 is pi u s a amyloid and opioid receptors",
}
EDGES = [
    ("a--b", "wide", "a b"), ("a--b", "index", "a b"), ("a--b", "plain", "a b"), ("x+y", "wide", "x+y"), ("x+y", "index", "x+y"), ("x+y", "plain", "x y"), ("5'3", "wide", "5 3"), ("5'3", "index", "5'3"),
    ("don’t", "wide", "don’t"), ("don’t", "index", "don t"), ("v1.2.3a", "wide", "v1.2.3a"), ("v1.2.3a", "plain", "v1 2 3a"), ("Δ9", "wide", "Δ9"), ("Δ9", "index", "9"), ("a_b", "index", "a b"), ("a_b", "plain", "a_b"), ("Ёж", "wide", "ёж"), ("", "index", ""),
]
STEMS = {
    "covid-19": "covid-19", "t-cells": "t-cell", "modeling": "model", "studies": "studi", "memory": "memori", "alzheimer's": "alzheimer'", "that": "thate", "cats": "cate", "running": "run", "falling": "fall",
    "enabling": "enable", "sized": "size", "add": "ad", "day": "dai", "played": "plai", "sky": "sky", "by": "by", "gas": "gas", "bed": "bed", "being": "be", "sing": "sing", "feed": "feed", "seeds": "seed", "agreed": "agree",
    "classes": "class", "boss": "boss", "analysis": "analysi", "ies": "i", "нейронауки": "нейронаук", "психических": "психическ", "исследования": "исследовани", "лечиться": "леч", "мозга": "мозг", "дом": "дом",
    "красивого": "красив", "новыми": "нов", "синее": "син", "читают": "чита", "учились": "уч", "боюсь": "бо",
}


def tokens(spark, pairs):
    rows = [(n, t) for n, (t, _) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "n int, t string")
    out = [[] for _ in pairs]
    for g in text.GRAMMARS:
        for r in df.select("n", text.tokens("t", g).alias("x")).collect():
            if pairs[r.n][1] == g:
                out[r.n] = r.x
    return out


def test_golden_tokens(spark):
    pairs = [(BODY, g) for g in GOLDEN] + [(t, g) for t, g, _ in EDGES]
    expected = [x.split() for x in [*GOLDEN.values(), *[e for _, _, e in EDGES]]]
    assert tokens(spark, pairs) == expected


def test_long_tokens(spark):
    """Tokens of any length, with and without connectors."""
    long = ["x" * 60_000, "a-" * 30_000 + "b", "1.2" * 20_000]
    df = spark.createDataFrame([(t,) for t in long], "t string")
    for g in text.GRAMMARS:
        got = [r.x for r in df.select(text.tokens("t", g).alias("x")).collect()]
        assert all(len(x) == 1 for x in got[:2])
        assert got[2] == (long[2:] if g != "plain" else long[2].split("."))


def test_null_text(spark):
    row = spark.createDataFrame([(None,)], "t string").select(text.tokens("t").alias("x"), text.word_count("t").alias("n")).first()
    assert row.x is None and row.n == 0


def test_body_bytes(spark):
    got = spark.createDataFrame([("",), ("a",), ("a\n",), ("é\nb",)], "t string").select(text.body_bytes("t").alias("n")).collect()
    assert [r.n for r in got] == [0, 2, 2, 5]


def test_stems(spark):
    df = stem.stem_table(spark.createDataFrame([(w,) for w in STEMS], "token string"))
    assert {r.token: r.stem for r in df.collect()} == STEMS


def test_stem_counts(spark):
    df = spark.createDataFrame([("cats",), ("cats",), ("sky",)], "token string")
    assert tuple(stem.stem_counts(df, "en").first()) == (3, 2)


URLS = [
    ("HTTP://Ex.com:80/a%20b?b=2&a=&a=1+x#frag", "http://ex.com/a%20b?a=&a=1+x&b=2"), ("https://ex.com:443", "https://ex.com/"), ("https://ex.com:8443/x", "https://ex.com:8443/x"), ("  ", ""),
    ("https://ru.wikipedia.org/wiki/Мозг", "https://ru.wikipedia.org/wiki/%D0%9C%D0%BE%D0%B7%D0%B3"), ("example.com/a", "http:example.com/a"), ("http://e.com/a;p=1?x=1", "http://e.com/a;p=1?x=1"), (None, None),
]


@pytest.mark.parametrize("url,expected", URLS)
def test_urls(url, expected):
    assert urls.normalized(url) == expected


def test_urls_in_spark(spark):
    df = spark.createDataFrame([(u,) for u, _ in URLS], "u string")
    assert [r.x for r in df.select(urls.normalize_url("u").alias("x")).collect()] == [e for _, e in URLS]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abc/?&=#:.;%20 AB", max_size=25).map(lambda x: "http://h.org/" + x))
def test_normalizing_again_changes_nothing(url):
    once = urls.normalized(url)
    assert urls.normalized(once) == once


def test_source_name(spark):
    df = spark.createDataFrame([(" EN ", "/x/ruwiki/m.json"), (None, "/x/enwiki/ruwiki/m.json"), ("", "/x/m.json")], "lang string, path string")
    assert [r.x for r in df.select(urls.source_name(F.col("lang"), F.col("path")).alias("x")).collect()] == ["en", "ruwiki", "unknown"]
