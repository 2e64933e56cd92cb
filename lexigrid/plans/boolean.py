"""The Boolean query language, compiled to one predicate over per-document flags.

    expr := and (OR and)* ;  and := unary (AND unary)* ;  unary := NOT unary | primary ;  primary := TERM | '(' expr ')'

Words are separated by white space; parentheses always stand alone; `-` at a word's start is NOT; and, or, not are read
in any case. There is no implicit AND: two terms side by side are an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LOWER, UPPER, let, terms

_FOLD = str.maketrans(UPPER, LOWER)
_SPACE = " \t\n\v\f\r"


@dataclass(frozen=True)
class Term:
    word: str


@dataclass(frozen=True)
class Not:
    of: Node


@dataclass(frozen=True)
class And:
    left: Node
    right: Node


@dataclass(frozen=True)
class Or:
    left: Node
    right: Node


Node = Term | Not | And | Or


class QueryError(ValueError):
    """A query that the grammar doesn't allow."""


def lex(query: str) -> list[tuple[str, str]]:
    """(kind, word): kind is `(`, `)`, AND, OR, NOT or TERM."""
    out, at = [], 0
    while at < len(query):
        c = query[at]
        if c in _SPACE:
            at += 1
        elif c in "()":
            out.append((c, c))
            at += 1
        elif c == "-":
            out.append(("NOT", c))
            at += 1
        else:
            end = at
            while end < len(query) and query[end] not in _SPACE and query[end] not in "()":
                end += 1
            word, at = query[at:end], end
            kind = word.upper() if word.isascii() and word.upper() in ("AND", "OR", "NOT") else "TERM"
            out.append((kind, word))
    return out


class _Reader:
    def __init__(self, words: list[tuple[str, str]]):
        self.words, self.at = words, 0

    def kind(self) -> str:
        return self.words[self.at][0] if self.at < len(self.words) else "END"

    def next(self) -> str:
        self.at += 1
        return self.words[self.at - 1][1]

    def joined(self, part: Callable[[], Node], kind: str, made: type) -> Node:
        node = part()
        while self.kind() == kind:
            self.next()
            node = made(node, part())
        return node

    def any_of(self) -> Node:
        return self.joined(self.all_of, "OR", Or)

    def all_of(self) -> Node:
        return self.joined(self.unary, "AND", And)

    def unary(self) -> Node:
        negations = 0
        while self.kind() == "NOT":
            self.next()
            negations += 1
        return reduce(lambda node, _: Not(node), range(negations), self.primary())

    def primary(self) -> Node:
        if self.kind() == "TERM":
            return Term(self.next())
        if self.kind() != "(":
            raise QueryError("expected term or '('")
        self.next()
        node = self.any_of()
        if self.kind() != ")":
            raise QueryError("unexpected token")
        self.next()
        return node


def parse(query: str) -> Node:
    reader = _Reader(lex(query))
    node = reader.any_of()
    if reader.kind() != "END":
        raise QueryError("trailing tokens")
    return node


def simplified(node: Node) -> Node:
    """The same query with folded terms and without double negation."""
    if isinstance(node, Term):
        return Term(node.word.translate(_FOLD))
    if isinstance(node, Not):
        inner = simplified(node.of)
        return inner.of if isinstance(inner, Not) else Not(inner)
    return type(node)(simplified(node.left), simplified(node.right))


def words_of(node: Node) -> list[str]:
    """The distinct terms, in order of first use."""
    if isinstance(node, Term):
        return [node.word]
    if isinstance(node, Not):
        return words_of(node.of)
    return list(dict.fromkeys(words_of(node.left) + words_of(node.right)))


def evaluate(node: Node, value: Callable, true=True):
    """The query's value, given the value of a term; works for booleans and for Columns."""
    if isinstance(node, Term):
        return value(node.word)
    if isinstance(node, Not):
        inner = evaluate(node.of, value)
        return not inner if isinstance(inner, bool) else ~inner
    a, b = evaluate(node.left, value), evaluate(node.right, value)
    if isinstance(a, bool):
        return (a and b) if isinstance(node, And) else (a or b)
    return a & b if isinstance(node, And) else a | b


def needs_universe(node: Node) -> bool:
    """Whether a document without any of the terms fits."""
    return evaluate(node, lambda _: False)


def predicate(node: Node, text: Column | str = "text", grammar: str = "index") -> Column:
    """Whether the document's text fits: its distinct tokens are worked out once and tested for each term."""
    return let(F.coalesce(terms(text, grammar), F.array().cast("array<string>")), lambda held: evaluate(node, lambda w: F.array_contains(held, w)))


def search_texts(docs: DataFrame, query: str, text: str = "text") -> DataFrame:
    """The documents that fit, in one scan and without a shuffle."""
    return docs.where(predicate(simplified(parse(query)), text))


def search_rows(rows: DataFrame, docs: DataFrame, query: str) -> DataFrame:
    """doc_id of the fitting documents, from the index rows (term, doc_id): the terms are pushed into the scan, one shuffle
    makes a flag a term and document, and the universe takes part only if a document without any of the terms fits."""
    node = simplified(parse(query))
    words = words_of(node)
    names = {w: f"f{n}" for n, w in enumerate(words)}
    hits = rows.where(F.col("term").isin(words))
    flags = hits.groupBy("doc_id").agg(*[F.bool_or(F.col("term") == w).alias(names[w]) for w in words])
    if needs_universe(node):
        flags = docs.select("doc_id").distinct().join(flags, "doc_id", "left").fillna(False, list(names.values()))
    return flags.where(evaluate(node, lambda w: F.col(names[w]))).select("doc_id")


def top(found: DataFrame, docs: DataFrame, n: int = 20) -> DataFrame:
    """doc_id, lang, title, url of the first n found by doc_id; `?` for what isn't known. The n are taken before the join."""
    first = found.orderBy("doc_id").limit(n)
    known = lambda c: F.coalesce(F.col(c), F.lit("?")).alias(c) if c in docs.columns else F.lit("?").alias(c)
    return first.join(docs.select("doc_id", *[c for c in ("lang", "title", "url") if c in docs.columns]), "doc_id", "left").select("doc_id", known("lang"), known("title"), known("url"))


def batch_lines(lines: Iterable[str]) -> list[str]:
    """The queries of a batch: one a line, `#` lines left out."""
    return [line.rstrip("\r\n") for line in lines if not line.startswith("#")]


def search_batch(docs: DataFrame, queries: list[str], text: str = "text") -> DataFrame:
    """query_id (from 0), doc_id of all queries' hits in one scan; a query that can't be read has no hits (see batch_errors)."""
    held = docs.select("doc_id", F.coalesce(terms(text), F.array().cast("array<string>")).alias("held"))
    tests = []
    for n, q in enumerate(queries):
        try:
            node = simplified(parse(q))
        except QueryError:
            continue
        tests.append(F.when(evaluate(node, lambda w: F.array_contains("held", w)), F.lit(n)))
    if not tests:
        return docs.sparkSession.createDataFrame([], "query_id int, doc_id bigint")
    return held.select(F.explode(F.array_compact(F.array(*tests))).alias("query_id"), "doc_id")


def batch_errors(queries: list[str]) -> dict[int, str]:
    """query_id -> message of the queries that can't be read."""
    out = {}
    for n, q in enumerate(queries):
        try:
            parse(q)
        except QueryError as e:
            out[n] = str(e)
    return out


def sql_predicate(node: Node, held: str = "held") -> str:
    """DuckDB SQL for the query over a list column of terms."""
    if isinstance(node, Term):
        return "list_contains({}, '{}')".format(held, node.word.replace("'", "''"))
    if isinstance(node, Not):
        return f"(NOT {sql_predicate(node.of, held)})"
    return f"({sql_predicate(node.left, held)} {'AND' if isinstance(node, And) else 'OR'} {sql_predicate(node.right, held)})"
