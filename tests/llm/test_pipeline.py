"""The pipeline against its stages' brute-force forms, one after the other."""

import hashlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from helpers import DATA
from test_pairs import brute_lines, line_words

import corpus_pipeline
from lexigrid.llm import bytebpe, decontam, ngramjoin, quality

SF = f"{DATA}/sf0.001"


def on(documents, sql):
    db = duckdb.connect()
    db.register("documents", documents)
    for name in ("labels", "benchmark"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return db.sql(sql).df()


def brute():
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    kept = on(docs, quality.oracle())
    docs = docs[docs.doc_id.isin(kept[kept.kept].doc_id)]
    stays = brute_lines(list(zip(docs.doc_id, docs.text, strict=True)))
    rest = lambda d, t: "\n".join(x for n, x in enumerate(t.split("\n")) if stays.get((d, n), (d, n)) == (d, n))
    docs = docs.assign(text=[rest(d, t) for d, t in zip(docs.doc_id, docs.text, strict=True)])
    docs = docs[[bool(line_words(t)) for t in docs.text]]
    classes = on(docs, ngramjoin.oracle())
    docs = docs[docs.doc_id.isin(classes[classes.doc_id == classes.component_id].doc_id)]
    hits = on(docs, decontam.oracle())
    return docs[docs.doc_id.isin(hits[~hits.contaminated].doc_id)]


def test_run(spark):
    codec = bytebpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    expected = {}
    for d, t in brute()[["doc_id", "text"]].itertuples(index=False):
        ids = library.encode_ordinary(t)
        expected[d] = (len(ids), ids, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == expected and 100 < len(got) < 200


def test_stages_take_odd_rows(spark, odd, none):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for given in (docs, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, given, SF)
            assert out.columns == given.columns, name
            assert out.count() <= given.count()
        assert corpus_pipeline.STAGES[-1][1](spark, given, SF).count() == given.count()


def test_entry_lists_all():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= names
