"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie. Every node has a failure link, the node that the same unread symbols lead to once the longest
matches inside the node's string are taken off, and the number of pieces taken off on the way. A word is read symbol by
symbol; on a mismatch the count grows by the node's number and the failure link is followed. Pieces are never built,
and each word takes time linear in its length.

Defined results: null, empty and blank texts have 0 words and 0 pieces; a word that the vocabulary cannot cover counts
as one unknown piece; repeated rows count alike; extra columns are ignored.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections import deque
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, slices

#: How texts are cut into words before the match: fixed values of the vocabulary file's own format.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: The symbol after a word's last byte.
END = 256
#: Words whose lengths a worker keeps.
CACHE_WORDS = 1_000_000


class Automaton:
    """pieces: sequences of symbols; a word is split into pieces, each the longest that fits at its place."""

    def __init__(self, pieces):
        self.goto: list[dict[int, int]] = [{}]
        ends: set[int] = set()
        for piece in pieces:
            node = 0
            for symbol in piece:
                step = self.goto[node]
                if symbol not in step:
                    step[symbol] = len(self.goto)
                    self.goto.append({})
                node = step[symbol]
            if node:
                ends.add(node)
        self.fail: list[int] = [-1] * len(self.goto)
        self.pops: list[int] = [0] * len(self.goto)
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for symbol, child in self.goto[node].items():
                queue.append(child)
                if child in ends:
                    self.fail[child], self.pops[child] = 0, 1
                    continue
                at, popped = self.fail[node], self.pops[node]
                while at >= 0 and symbol not in self.goto[at]:
                    popped += self.pops[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[child], self.pops[child] = self.goto[at][symbol], popped

    def length(self, word) -> int:
        """The number of pieces of the word; 1, for the unknown piece, if it can't be covered."""
        node, count, goto, fail, pops = 0, 0, self.goto, self.fail, self.pops
        for symbol in word:
            while symbol not in goto[node]:
                if fail[node] < 0:
                    return 1
                count += pops[node]
                node = fail[node]
            node = goto[node][symbol]
        while node:
            if fail[node] < 0:
                return 1
            count += pops[node]
            node = fail[node]
        return count


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabulary files: printable ones for themselves, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


def read_pieces(path: str) -> list[list[int]]:
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    suffix, alphabet = model["end_of_word_suffix"], byte_alphabet()
    bare = [(p.removesuffix(suffix), [END] * p.endswith(suffix)) for p in model["vocab"]]
    return [[alphabet[c] for c in p] + end for p, end in bare if p and all(c in alphabet for c in p)]


class Lengths(dict):
    """Word -> number of pieces, worked out when first asked for."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        n = self.automaton.length([*word.encode(), END])
        self[word] = n
        return n


@functools.cache
def lengths(path: str) -> Lengths:
    return Lengths(Automaton(read_pieces(path)))


def words(text: str | None) -> list[str]:
    return WORD.findall(unicodedata.normalize("NFC", text or "").lower())


def count_pieces(docs: DataFrame, vocabulary_path: str | None = None, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_pieces of each row of docs."""
    vocabulary_path = vocabulary_path or public_tokenizers.path("word_bpe_49k.json")
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lengths(vocabulary_path)
        for batch in slices(batches, "text"):
            if len(own) > CACHE_WORDS:
                own.clear()
            cut = [words(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, cut), pa.int64()), pa.array((sum(map(own.__getitem__, x)) for x in cut), pa.int64())], ["doc_id", "n_words", "n_pieces"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id bigint, n_words bigint, n_pieces bigint")
