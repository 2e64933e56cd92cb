"""The query language: reading, errors, laws, evaluation."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexigrid.operators import index
from lexigrid.plans.boolean import And, Not, Or, QueryError, Term, batch_errors, batch_lines, evaluate, needs_universe, parse, search_batch, search_rows, search_texts, simplified, top, words_of

a, b, c = Term("a"), Term("b"), Term("c")


@pytest.mark.parametrize("query,tree", [
    ("a OR b AND c", Or(a, And(b, c))), ("NOT a AND b", And(Not(a), b)), ("not(a)", Not(a)), ("-a", Not(a)), ("- a", Not(a)), ("--a", Not(Not(a))), ("(a or b) AND -c", And(Or(a, b), Not(c))),
    ("covid-19", Term("covid-19")), ("a AND b AND c", And(And(a, b), c)), ('"brain"', Term('"brain"')),
])
def test_trees(query, tree):
    assert parse(query) == tree


@pytest.mark.parametrize("query,message", [("a b", "trailing"), ("a -b", "trailing"), ("a)", "trailing"), ("a AND", "expected term"), ("AND", "expected term"), ("()", "expected term"), ("  ", "expected term"), ("(a", "unexpected token"), ("", "expected term")])
def test_errors(query, message):
    with pytest.raises(QueryError, match=message):
        parse(query)


def test_simplified():
    assert simplified(parse("NOT NOT COVID-19")) == Term("covid-19")
    assert words_of(parse("a AND b OR a")) == ["a", "b"]


DOCS = [(1, "brain neuroscience"), (2, "brain disorder neuroscience"), (3, "disorder"), (4, ""), (5, None)]
CASES = {
    "neuroscience": [1, 2], "neuroscience AND brain": [1, 2], "neuroscience AND NOT disorder": [1], "NOT brain": [3, 4, 5], "missing": [], "NOT missing": [1, 2, 3, 4, 5], "disorder OR brain AND neuroscience": [1, 2, 3],
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id bigint, text string").cache()


@pytest.mark.parametrize("query", CASES)
def test_small_corpus(docs, query):
    rows = index.posting_rows(docs)
    assert sorted(r.doc_id for r in search_rows(rows, docs, query).collect()) == CASES[query]
    assert sorted(r.doc_id for r in search_texts(docs, query).collect()) == CASES[query]


def test_batch(docs):
    queries = [*CASES, "two terms"]
    got = {}
    for r in search_batch(docs, queries).collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert {n: sorted(got.get(n, [])) for n in range(len(CASES))} == dict(enumerate(CASES.values()))
    assert batch_errors(queries) == {len(CASES): "trailing tokens"}
    assert batch_lines(["a\n", "# note\n", "b"]) == ["a", "b"]


def test_top(docs):
    shown = docs.selectExpr("doc_id", "'en' AS lang", "'t' AS title").where("doc_id <> 2")
    got = top(docs.select("doc_id").where("doc_id < 4"), shown, 2).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, "en", "t", "?"), (2, "?", "?", "?")]
    assert top(docs.select("doc_id"), shown, 0).count() == 0


nodes = st.recursive(st.sampled_from("abc").map(Term), lambda x: st.one_of(x.map(Not), st.builds(And, x, x), st.builds(Or, x, x)), max_leaves=8)


@settings(max_examples=200, deadline=None)
@given(nodes, nodes, st.sets(st.sampled_from("abc")))
def test_laws(x, y, held):
    value = lambda n: evaluate(n, lambda w: w in held)
    assert value(simplified(x)) == value(x) == value(Not(Not(x)))
    assert value(And(x, y)) == value(And(y, x)) and value(Or(x, y)) == value(Or(y, x))
    assert value(Not(And(x, y))) == value(Or(Not(x), Not(y)))
    assert needs_universe(x) == evaluate(x, lambda w: False)
