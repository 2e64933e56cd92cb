"""Corpus files, checks, statistics, walks, index files, and the rank order."""

import json
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from lexigrid.operators import corpus, frequency, index
from lexigrid.sources import corpus as files
from lexigrid.sources import recorded


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    at = tmp_path_factory.mktemp("corpus")
    for lang, n, title in (("enwiki", 1, "One"), ("enwiki", 2, "Two"), ("ruwiki", 1, "Один")):
        folder = at / lang / "text"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{n:05d}.txt").write_text(f"Title: {title}\nPageID: 7\nURL:  u{n}\nLengthBytes: 3\nWords: 2\n\nfirst line\nsecond {title}\n", encoding="utf-8")
    (at / "enwiki" / "notes.txt").write_text("short\n")
    (at / "enwiki" / "text" / "x.md").write_text("no\n")
    return str(at)


def test_layouts(spark, root):
    got = {r.doc_id: r for r in files.read_corpus(spark, root).collect()}
    assert sorted(got) == [1, 2, 30001]
    assert got[1].title == "One" and got[1].url == " u1" and got[1].lang == "en" and got[1].body == "first line\nsecond One\n"
    assert got[30001].lang == "ru"
    assert files.read_corpus(spark, root, "all").count() == 4
    assert files.read_corpus(spark, root, "ranks").count() == 3
    assert files.read_corpus(spark, root, "all", limit=2).count() == 2
    assert files.read_corpus(spark, root, "all").where("path like '%notes%'").first().body == ""


def test_metadata(spark, tmp_path):
    records = [{"pageid": 1, "lang": "en"}, {"pageid": 2, "lang": "ru"}]
    (tmp_path / "a.json").write_text(json.dumps(records))
    (tmp_path / "b.json").write_text(json.dumps({"items": records}))
    for name in ("a", "b"):
        assert sorted(r.pageid for r in files.read_metadata(spark, str(tmp_path / f"{name}.json")).collect()) == [1, 2]


def test_tokens_and_frequencies(spark, tmp_path):
    (tmp_path / "t.txt").write_text("b\n\na\r\nb\n")
    tokens = files.read_tokens(spark, str(tmp_path / "t.txt"))
    assert sorted(r.token for r in tokens.collect()) == ["a", "b", "b"]
    files.write_frequencies(tokens.groupBy(F.col("token").alias("term")).count(), str(tmp_path / "f"))
    assert [tuple(r) for r in spark.read.option("sep", "\t").csv(str(tmp_path / "f")).collect()] == [("b", "2"), ("a", "1")]


def test_header_round_trip(spark):
    row = spark.createDataFrame([("T", 5, "u", 9, 2, "a b")], "title string, pageid int, url string, n int, w int, text string")
    whole = row.select(files.with_header(*[F.col(c) for c in row.columns]).alias("v")).select(files.body_of(F.col("v")).alias("body"), files.header_field(F.col("v"), "Title").alias("title")).first()
    assert tuple(whole) == ("a b", "T")


def test_recorded(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text(json.dumps({"kind": "page", "key": "1", "status": 200, "body": "x"}) + "\n")
    recorded.register(spark)
    assert spark.read.format("recorded").option("path", str(tmp_path)).load().first().body == "x"
    assert recorded.waits()[0] == 1.0 and max(recorded.waits()) <= 20.0


def test_accept_and_number(spark):
    pages = spark.createDataFrame([(1, "en", "w " * 450), (2, "en", "w"), (None, "en", "w " * 999), (3, "ru", "w " * 350), (3, "ru", "w " * 350), (4, "en", "  "), (5, "en", "w " * 900)], "pageid bigint, lang string, extract string")
    seen = spark.createDataFrame([(5,)], "pageid bigint")
    got = corpus.number(corpus.accept(pages, seen), 10).orderBy("pageid").collect()
    assert [(r.pageid, r.words, r.docid) for r in got] == [(1, 450, 11), (3, 350, 11)]


def test_walk(spark):
    edges = spark.createDataFrame([("r", "a"), ("a", "b"), ("b", "r"), ("b", "c"), ("c", "d")], "parent string, child string")
    seeds = spark.createDataFrame([("r",)], "category string")
    reached = corpus.walk(edges, seeds, 3)
    assert {r.category: r.depth for r in reached.collect()} == {"r": 0, "a": 1, "b": 2, "c": 3}
    pages = spark.createDataFrame([("r", 5), ("c", 5), ("c", 1), ("d", 2)], "parent string, pageid bigint")
    assert [(r.pageid, r.depth) for r in corpus.members(reached, pages, 5).collect()] == [(5, 0), (1, 3)]


def test_checks(spark):
    meta = spark.createDataFrame([(1, "text/1", "raw/1"), (1, "text/2", "raw/2"), (None, "text/3", "raw/3")], "pageid bigint, text_file string, raw_file string")
    listed = lambda kind, ids: spark.createDataFrame([(f"{kind}/{n}",) for n in ids], "path string")
    fine = corpus.check("en", meta.where("text_file <> 'text/2'"), listed("text", [1, 3]), listed("raw", [1, 3]))
    assert corpus.verdict(fine).first().verdict == "OK"
    bad = corpus.check("en", meta, listed("text", [1, 3]), listed("raw", [1, 2, 3]))
    assert {r.check: r.value for r in bad.collect()} == {"text files": 2, "missing refs": 1, "duplicate pageid groups": 1}


def test_upper_median(spark):
    df = spark.createDataFrame([("x", v) for v in (1, 2, 3, 10)] + [("y", 4)], "k string, v int")
    assert {r.k: r.median for r in corpus.upper_median(df, ["k"], "v").collect()} == {"x": 3, "y": 4}


def test_index_files(spark, tmp_path):
    docs = spark.createDataFrame([(n, f"common t{n} é") for n in range(40)], "doc_id bigint, text string")
    index.save_index(docs, str(tmp_path))
    _, rows, terms = index.load_index(spark, str(tmp_path))
    got = index.lookup(rows, ["common", "none"]).collect()
    assert {r.term: r.df for r in got} == {"common": 40, "none": 0}
    assert [r.preview for r in got if r.term == "common"][0].endswith("29 ... (10 more)")
    ordered = terms.orderBy("term").collect()
    assert [r.offset for r in ordered] == [sum(x.bytes_len for x in ordered[:n]) for n in range(len(ordered))]
    index.export_tsv(str(tmp_path), str(tmp_path / "tsv"), spark)
    assert "isnotnull(term" in rows.where("term = 'common'")._jdf.queryExecution().toString() and sum(r.df for r in ordered) == rows.count()


def test_ranks_and_empty_fit(spark):
    counts = spark.createDataFrame([("b", 5), ("a", 5), ("c", 9), ("z", 1)], "term string, count bigint")
    assert [r.term for r in frequency.ranked(counts).orderBy("rank").collect()] == ["c", "a", "b", "z"]
    assert frequency.zipf_fit(frequency.ranked(counts), 10, 50).first().points == 4
    assert frequency.token_stats(spark.createDataFrame([], "doc_id bigint, text string")).first().avg_len == 0.0


def test_engine_without_training_operators():
    """The entry still lists the engine's queries if the other subpackage is gone."""
    code = "import importlib.util as u; f = u.find_spec; u.find_spec = lambda n, *a: None if n.startswith(('lexigrid.llm', 'corpus_pipeline')) else f(n, *a); import __spark_entry__ as e; q = e.queries(); assert q and not any(x.startswith('op') or x == 'pipeline' for x in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/", 2)[0])
