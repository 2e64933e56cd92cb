"""The engine from the command line: python -m lexigrid.cli COMMAND ...

verify, stats, tokenize, stem, zipf, index build, index lookup, search (one query, or a batch from standard input), web.
"""

from __future__ import annotations

import argparse
import html
import os
import sys
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import stem as stems
from .operators import corpus, frequency, index
from .plans import boolean
from .session import session
from .sources import corpus as files


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="lexigrid")
    parser.add_argument("--master", default=None)
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("verify", "stats"):
        sub.add_parser(name).add_argument("root", nargs="?", default=".")
    p = sub.add_parser("tokenize")
    p.add_argument("--input", required=True)
    p.add_argument("--print", action="store_true", dest="shown")
    p.add_argument("--limit", type=int, default=0)
    p.add_argument("--freq-out")
    p = sub.add_parser("stem")
    p.add_argument("--lang", default="auto")
    p.add_argument("--input", required=True)
    p = sub.add_parser("zipf")
    p.add_argument("--corpus", required=True)
    p.add_argument("--out", help="folder for rank, count, fitted")
    p.add_argument("--stats", help="folder for the report as JSON")
    for name, value in (("--max_docs", 0), ("--fit_from", 10), ("--fit_to", 50_000), ("--min_freq", 1)):
        p.add_argument(name, type=int, default=value)
    p = sub.add_parser("index")
    p.add_argument("action", choices=["build", "lookup"])
    p.add_argument("--corpus")
    p.add_argument("--out")
    p.add_argument("--limit", type=int, default=0)
    p.add_argument("--index")
    p.add_argument("--term")
    for name in ("search", "web"):
        p = sub.add_parser(name)
        p.add_argument("--index", required=True)
        p.add_argument("--top", type=int, default=20)
        p.add_argument("--query" if name == "search" else "--port", **({} if name == "search" else {"type": int, "default": 8080}))
    return parser


def part(spark, root: str, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(metadata, text files, raw files) of one part of a corpus, with paths relative to it."""
    def listed(kind: str, ending: str) -> DataFrame:
        found = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{ending}").load(f"{root}/{name}/{kind}").select("path", F.col("length").alias("size"))
        return found.withColumn("path", F.concat(F.lit(f"{kind}/"), F.element_at(F.split("path", "/"), -1)))

    return files.read_metadata(spark, f"{root}/{name}/metadata.json"), listed("text", "txt"), listed("raw", "wiki")


def parts(root: str) -> Iterator[str]:
    return (p for p in ("enwiki", "ruwiki") if os.path.isdir(f"{root}/{p}"))


def search(spark, path: str, query: str, top: int) -> Iterator[str]:
    docs, rows, _ = index.load_index(spark, path)
    began = time.perf_counter()
    found = boolean.search_rows(rows, docs, query).cache()
    hits = found.count()
    for r in boolean.top(found, docs, top).orderBy("doc_id").collect():
        yield "\t".join(str(x) for x in r)
    found.unpersist()
    print(f"{query}: {hits} hits, {1000 * (time.perf_counter() - began):.0f} ms", file=sys.stderr)


def web(spark, path: str, port: int, top: int) -> None:
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from urllib.parse import parse_qs, urlsplit

    class Form(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802  name of the interface
            query = parse_qs(urlsplit(self.path).query).get("q", [""])[0]
            try:
                shown = "\n".join(search(spark, path, query, top)) if query else ""
            except boolean.QueryError as e:
                shown = str(e)
            page = f"<form><input name=q value=\"{html.escape(query)}\"><button>Search</button></form><pre>{html.escape(shown)}</pre>"
            self.send_response(200)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.end_headers()
            self.wfile.write(page.encode())

    HTTPServer(("127.0.0.1", port), Form).serve_forever()


def main(given: list[str] | None = None) -> int:
    a = arguments().parse_args(given)
    spark = session("lexigrid", a.master)
    if a.command == "verify":
        checks = [corpus.check(p, *part(spark, a.root, p)) for p in parts(a.root)]
        problems = [tuple(r) for c in checks for r in c.collect()]
        print("FAIL" if problems else "OK", *(" ".join(map(str, p)) for p in problems), sep="\n- ")
        return int(bool(problems))
    if a.command == "stats":
        for p in parts(a.root):
            meta, texts, raws = part(spark, a.root, p)
            words = meta.select(F.lit(p).alias("part"), F.col("words").cast("bigint").alias("words"))
            sums = words.agg(F.count("*").alias("docs"), F.round(F.avg("words"), 2).alias("avg_words_per_doc"), F.min("words").alias("min_words"), F.max("words").alias("max_words"))
            for kind, listed in (("raw", raws), ("text", texts)):
                size = listed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
                sums = sums.join(F.broadcast(size.select(F.round(F.col("bytes") / 1048576, 2).alias(f"{kind}_size_mb"), F.col("bytes").alias(f"{kind}_bytes"))))
            median = corpus.upper_median(words, ["part"], "words")
            print(sums.join(F.broadcast(median)).toJSON().first())
        return 0
    if a.command == "tokenize":
        docs = files.read_corpus(spark, a.input, "all", a.limit)
        if a.shown:
            for r in frequency.token_rows(docs, "body", "wide", ("path",)).orderBy("path", "pos").toLocalIterator():
                print(r.token)
        print(frequency.token_stats(docs, "body").toJSON().first(), file=sys.stderr)
        if a.freq_out:
            files.write_frequencies(frequency.term_counts(docs, "body", "wide"), a.freq_out)
        return 0
    if a.command == "stem":
        tokens = files.read_tokens(spark, a.input)
        for r in tokens.select("token", stems.stem("token", a.lang).alias("stem")).toLocalIterator():
            print(r.token, r.stem, sep="\t")
        print(stems.stem_counts(tokens, a.lang).toJSON().first(), file=sys.stderr)
        return 0
    if a.command == "zipf":
        docs = files.read_corpus(spark, a.corpus, "ranks", a.max_docs)
        report = frequency.zipf_report(docs, "body", a.min_freq, a.fit_from, a.fit_to)
        print(report.toJSON().first())
        if a.stats:
            report.write.mode("overwrite").json(a.stats)
        if a.out:
            ranks = frequency.ranked(frequency.term_counts(docs, "body", "plain"), a.min_freq)
            frequency.zipf_curve(ranks, frequency.zipf_fit(ranks, a.fit_from, a.fit_to)).write.mode("overwrite").csv(a.out)
        return 0
    if a.command == "index" and a.action == "build":
        docs = files.read_corpus(spark, a.corpus, "index", a.limit)
        index.save_index(docs, a.out, "body")
        print(index.index_totals(docs, "body").toJSON().first())
        return 0
    if a.command == "index":
        print(*index.lookup(index.load_index(spark, a.index)[1], [a.term]).first(), sep="\t")
        return 0
    if a.command == "web":
        web(spark, a.index, a.port, a.top)
        return 0
    if a.query is not None:
        try:
            print(*search(spark, a.index, a.query, a.top), sep="\n")
        except boolean.QueryError as e:
            print(e, file=sys.stderr)
            return 2
        return 0
    for query in boolean.batch_lines(sys.stdin):
        try:
            print(*search(spark, a.index, query, a.top), "----", sep="\n")
        except boolean.QueryError as e:
            print(e, file=sys.stderr)
            print("----")
    return 0


if __name__ == "__main__":
    sys.exit(main())
