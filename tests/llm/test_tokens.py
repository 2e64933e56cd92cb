"""Token counts, shards, byte-level BPE and token files against the libraries and brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexigrid.llm import bytebpe, sharding, tokenfile, wordpiece


@pytest.fixture(scope="module")
def codec():
    return bytebpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_bpe_equals_library(codec, library, texts):
    ids = codec.encode(texts)
    assert ids == [np.array(library.encode_ordinary(t), "<u4").tobytes() for t in texts]
    assert codec.decode(ids) == [t.encode() for t in texts]


def test_bpe_long_words(codec, library):
    rng = random.Random(1)
    texts = ["x" * 5000, "".join(rng.choice("abcdeé") for _ in range(3000)), " " * 900 + "a", "a" * bytebpe.LONG_WORD, "ab" * bytebpe.LONG_WORD]
    assert codec.encode(texts) == [np.array(library.encode_ordinary(t), "<u4").tobytes() for t in texts]


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="ab", min_size=49, max_size=400) | st.text(alphabet="theinrs", min_size=49, max_size=300) | st.text(alphabet="漢字é-", min_size=49, max_size=200))
def test_bpe_long_words_of_few_letters(codec, library, text):
    assert codec.encode([text])[0] == np.array(library.encode_ordinary(text), "<u4").tobytes()


def test_bpe_bounded(codec, library, monkeypatch):
    """Many long words, a very long one and a long text: whole, and equal to the library's, within the memory that DuckDB has."""
    rng = random.Random(4)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    han = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(2000))
    texts = [
        " ".join(word(han, rng.randint(10, 40)) for _ in range(4000)), " ".join(word("etaoinshrdlu", 300) for _ in range(20)), "etaoin" * 30_000, "a" * 1_000_000,
        " ".join(word("abcdefghijklmnopqrstuvwxyz", rng.randint(4, 12)) for _ in range(120_000)),
    ]
    ids = codec.encode(texts)
    assert ids == [np.array(library.encode_ordinary(t), "<u4").tobytes() for t in texts]
    assert codec.decode(ids) == [t.encode() for t in texts]
    assert codec.held <= 2 * bytebpe.CACHE_BYTES


def test_bpe_odd(spark, odd, none, library):
    got = bytebpe.encode(odd).collect()
    assert len(got) == odd.count()
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.ids, r.n_tokens) == (ids, len(ids))
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert bytebpe.encode(none).count() == 0
    back = {r.doc_id: r.text for r in bytebpe.decode(bytebpe.encode(odd)).collect()}
    assert back == texts


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def brute_stream(tokenizer, texts):
    out, start = [], 0
    for t in texts:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_odd(odd, none, tokenizer):
    single = odd.where("doc_id is not null and doc_id <> 2")
    rows = sorted(((r.doc_id, r.text) for r in single.collect()), key=lambda x: x[0])
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokenfile.token_digest(single).collect())
    assert got == [(d, *x) for (d, _), x in zip(rows, brute_stream(tokenizer, [t for _, t in rows]), strict=True)]
    whole = tokenfile.token_digest(odd).collect()
    assert len(whole) == odd.count()
    ordered = sorted(whole, key=lambda r: r.start)
    assert [r.start for r in ordered] == [sum(x.n_tokens for x in ordered[:n]) for n in range(len(ordered))]
    assert tokenfile.token_digest(none).count() == 0


def test_token_file_layout(spark, tmp_path):
    docs = spark.createDataFrame([(n, f"some words number {n} and more of them") for n in range(3000)], "doc_id bigint, text string")
    tokenfile.write_tokens(docs, str(tmp_path / "t"), partitions=2)
    files = sorted((tmp_path / "t").glob("*.parquet"))
    meta = pq.ParquetFile(files[0]).metadata.row_group(0)
    column = [meta.column(i) for i in range(meta.num_columns) if meta.column(i).path_in_schema.startswith("tokens")][0]
    assert column.has_dictionary_page and column.has_offset_index and column.has_column_index
    read = tokenfile.read_tokens(spark, str(tmp_path / "t")).where("doc_id between 10 and 12").select("doc_id", "n_tokens")
    plan = read._jdf.queryExecution().toString()
    assert read.count() == 3 and "tokens" not in plan.split("ReadSchema")[1].split("\n")[0].replace("n_tokens", "")


letters = st.text(alphabet="aAbzé ,.!?'\"<|>İ́ß=12\n\t—Σσ漢 ", max_size=40)


@settings(max_examples=60, deadline=None)
@given(st.lists(letters, max_size=5))
def test_pieces_equal_library(tokenizer, texts):
    own = tokenfile.encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert own.encode(texts) == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<i4").tobytes() for t in texts]


def greedy(pieces, word):
    n, at = 0, 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if tuple(word[at:e]) in pieces), None)
        if end is None:
            return 1
        n, at = n + 1, end
    return n


@settings(max_examples=200, deadline=None)
@given(st.sets(st.lists(st.integers(0, 2), min_size=1, max_size=4).map(tuple), max_size=12), st.lists(st.lists(st.integers(0, 2), max_size=12), max_size=6))
def test_automaton(pieces, words):
    machine = wordpiece.Automaton(pieces)
    assert [machine.length(w) for w in words] == [greedy(pieces, w) for w in words]


def test_counts_odd(odd, none):
    pieces = {tuple(p) for p in wordpiece.read_pieces(public_tokenizers.path("word_bpe_49k.json"))}
    got = wordpiece.count_pieces(odd).collect()
    texts = {r.doc_id: r.text for r in odd.collect()}
    assert len(got) == odd.count()
    for r in got:
        if r.doc_id in (9, 10):
            continue
        words = wordpiece.words(texts[r.doc_id])
        assert (r.n_words, r.n_pieces) == (len(words), sum(greedy(pieces, [*w.encode(), wordpiece.END]) for w in words))
    assert wordpiece.count_pieces(none).count() == 0


def check_shards(got, rows, shards):
    assert sorted((r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted((d or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in got:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    share, largest = sum(sizes.values()) / shards, max(r.size for r in got)
    assert all(abs(sizes[k] - share) <= largest for k in range(shards))


def test_shards(spark):
    rng = random.Random(2)
    rows = [(n, "same text again " * 20 if n % 3 == 0 else "x" * rng.choice([1, 50, 400, 3000])) for n in range(3000)]
    check_shards(sharding.shard(spark.createDataFrame(rows, "doc_id bigint, text string")).collect(), rows, 40)


def test_shards_subdivide(spark, monkeypatch):
    """Few sampled keys leave overfull ranges; they are divided, and the result is the same law."""
    monkeypatch.setattr(sharding, "KEYS_PER_RANGE", 1)
    monkeypatch.setattr(sharding, "RANGES", 16)
    rows = [(n, "hot" if n % 3 else f"t{n}" * (n % 50)) for n in range(2000)]
    check_shards(sharding.shard(spark.createDataFrame(rows, "doc_id bigint, text string"), 7).collect(), rows, 7)


def test_shards_odd(odd, none):
    got = sharding.shard(odd).collect()
    assert len(got) == odd.count() and all(r.slot >= 0 for r in got)
    assert sharding.shard(none).count() == 0
