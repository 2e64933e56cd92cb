"""Byte-level BPE encoding and decoding with DuckDB recursive queries inside each partition.

Encoding: the pattern cuts a text into words; the distinct words of a batch become token-position rows in DuckDB; a
recursive query joins neighbouring rows with the merge table and contracts each word's leftmost pair of least rank
until no pair is left. Decoding: the ids, with their positions, are joined with the vocabulary and put together by an
ordered aggregate.

Long words are first cut where no token of the vocabulary can span, as no contraction crosses such a place. Pieces that
stay long are contracted by a second recursive query, which takes the occurrences of the pair of least rank in one step,
from the left up to the first whose contraction brings forth a pair of lower rank, which is what the plain rule does one by
one; it runs for a bounded number of steps and goes on from where it ended. Words are dealt to the queries in groups
bounded by the rows that all their steps can have, so memory doesn't grow with a text or a word.

Defined results: null and empty texts have no ids and decode to no bytes; ties between pairs go to the leftmost;
repeated rows are encoded alike; extra columns, whatever their names, are ignored; texts and words of any length are
encoded whole. decode() gives null and empty lists the empty text, and bytes that are not UTF-8 replacement characters.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
from collections.abc import Iterator

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, slices

#: Bytes from which on words are cut where no token spans, and up to which a piece is contracted pair by pair.
LONG_WORD = 48
#: Rows that all steps of a recursive query may have together; tokens that are decoded at once; matches held at once.
STEP_ROWS, DECODED, MATCHES = 2_000_000, 400_000, 200_000
#: Megabytes that DuckDB may hold, which is enough for pieces of so many tokens.
MEMORY, ROWS_HELD = 256, 250_000
#: Bytes of words and their ids that a worker keeps, each with ENTRY bytes for the table; beyond them it starts afresh.
CACHE_BYTES, ENTRY = 96 << 20, 200

CONTRACT = """
WITH RECURSIVE state(step, word, pos, token, right_pos, right_token) AS (
    SELECT 0, word, pos, token, right_pos, right_token FROM start
  UNION ALL
    (WITH held AS MATERIALIZED (SELECT * FROM state),
    best AS (
        SELECT word, min((m.merged::BIGINT << 32) + (h.pos::BIGINT << 16) + h.right_pos) AS code
        FROM held h JOIN merges m ON m.left_token = h.token AND m.right_token = h.right_token GROUP BY word),
    joined AS (
        SELECT b.word, (code >> 32)::INTEGER AS merged, ((code >> 16) & 65535)::INTEGER AS at, h.pos AS gone, h.right_pos, h.right_token
        FROM best b JOIN held h ON h.word = b.word AND h.pos = (code & 65535)::INTEGER)
    SELECT h.step + 1, h.word, h.pos, CASE WHEN h.pos = j.at THEN j.merged ELSE h.token END, CASE WHEN h.pos = j.at THEN j.right_pos ELSE h.right_pos END,
      CASE WHEN h.pos = j.at THEN j.right_token WHEN h.right_pos = j.at THEN j.merged ELSE h.right_token END
    FROM held h JOIN joined j ON j.word = h.word WHERE h.pos <> j.gone)
)
SELECT word, list(token ORDER BY pos) AS ids
FROM state JOIN (SELECT word, max(step) AS step FROM state GROUP BY word) USING (word, step) GROUP BY word
"""

CONTRACT_RUNS = """
WITH RECURSIVE state(step, word, pos, token) AS (
    SELECT 0, word, pos, token FROM start
  UNION ALL
    (WITH pairs AS (
        SELECT step, word, pos, token, lead(token) OVER by_pos AS right_token, row_number() OVER by_pos AS place
        FROM state WHERE step < $steps WINDOW by_pos AS (PARTITION BY word ORDER BY pos)),
    ranked AS (
        SELECT p.*, m.merged, min(m.merged) OVER (PARTITION BY word) AS least
        FROM pairs p LEFT JOIN merges m ON m.left_token = p.token AND m.right_token = p.right_token),
    hits AS (
        SELECT word, place, merged, row_number() OVER (PARTITION BY word ORDER BY place) AS nth, left_token, after_token
        FROM (SELECT *, lag(token) OVER by_place AS left_token, lead(token, 2) OVER by_place AS after_token FROM ranked WINDOW by_place AS (PARTITION BY word ORDER BY place))
        WHERE merged = least),
    apart AS (
        SELECT *, lag(place) OVER (PARTITION BY word ORDER BY place) AS last_place
        FROM (SELECT *, row_number() OVER (PARTITION BY word, place - nth ORDER BY place) AS in_run FROM hits) WHERE in_run % 2 = 1),
    judged AS (
        SELECT a.word, a.place, a.merged, min(a.place) FILTER (least(x.merged, y.merged) < a.merged) OVER (PARTITION BY a.word) AS first_lower
        FROM apart a
        LEFT JOIN merges x ON x.left_token = CASE WHEN a.last_place = a.place - 2 THEN a.merged ELSE a.left_token END AND x.right_token = a.merged
        LEFT JOIN merges y ON y.left_token = a.merged AND y.right_token = a.after_token),
    chosen AS (SELECT word, place, merged FROM judged WHERE first_lower IS NULL OR place <= first_lower)
    SELECT r.step + 1, r.word, r.pos, coalesce(c.merged, r.token)::INTEGER
    FROM ranked r LEFT JOIN chosen c ON c.word = r.word AND c.place = r.place LEFT JOIN chosen d ON d.word = r.word AND d.place = r.place - 1
    WHERE r.least IS NOT NULL AND d.word IS NULL)
)
SELECT word, list(token ORDER BY pos) AS ids, any_value(step) AS step
FROM state JOIN (SELECT word, max(step) AS step FROM state GROUP BY word) USING (word, step) GROUP BY word
"""

DECODE = """
SELECT d.doc AS doc, array_to_string(list(v.piece ORDER BY d.pos), '') AS text
FROM encoded d JOIN vocabulary v ON v.token = d.token GROUP BY d.doc
"""


def _is_text(word: bytes) -> bool:
    try:
        return bool(word.decode())
    except UnicodeDecodeError:
        return False


class Codec:
    """One vocabulary of ranks in a DuckDB connection of its own: one thread, no files."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.pattern = regex.compile(pattern)
        #: Words that are in the vocabulary as a whole are never contracted.
        self.whole = {w.decode(): np.uint32(rank).tobytes() for w, rank in self.ranks.items() if _is_text(w)}
        self.cache: dict[str, bytes] = dict(self.whole)
        self.held = 0
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": f"{MEMORY}MB", "temp_directory": ""})
        merges = [(self.ranks[w[:i]], self.ranks[w[i:]], rank) for w, rank in self.ranks.items() for i in range(1, len(w)) if w[:i] in self.ranks and w[i:] in self.ranks]
        left, right, merged = (pa.array(x, pa.int32()) for x in zip(*merges, strict=True))
        self._table("merges", left_token=left, right_token=right, merged=merged)
        # A byte stands as the character of the same number, so an ordered aggregate of strings puts bytes together.
        self._table("vocabulary", token=pa.array(self.ranks.values(), pa.int32()), piece=pa.array([w.decode("latin-1") for w in self.ranks], pa.string()))
        self.single = np.zeros(256, np.int32)
        for b in range(256):
            self.single[b] = self.ranks[bytes([b])]
        #: Tokens of two bytes, and the runs of three bytes that occur in tokens: what stands over a place that a token spans.
        self.twos = np.zeros(1 << 16, bool)
        self.twos[[w[0] << 8 | w[1] for w in self.ranks if len(w) == 2]] = True
        self.threes = np.array(sorted({w[i] << 16 | w[i + 1] << 8 | w[i + 2] for w in self.ranks for i in range(len(w) - 2)}), np.int32)

    def _table(self, name: str, **columns: pa.Array) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _pieces(self, word: bytes) -> list[bytes]:
        """The word cut where no token spans: a token over a place is those two bytes, or has three bytes in a row over it."""
        x = np.frombuffer(word, np.uint8).astype(np.int32)
        spanned = self.twos[x[:-1] << 8 | x[1:]]
        three = x[:-2] << 16 | x[1:-1] << 8 | x[2:]
        at = np.searchsorted(self.threes, three)
        found = self.threes[np.minimum(at, len(self.threes) - 1)] == three
        spanned[:-1] |= found
        spanned[1:] |= found
        edges = [0, *(np.flatnonzero(~spanned) + 1).tolist(), len(word)]
        return [word[i:j] for i, j in itertools.pairwise(edges)]

    def _contract(self, query: str, sizes: np.ndarray, tokens: np.ndarray, **given: int) -> Iterator[tuple[int, bytes, int]]:
        """(number, ids as bytes, step) of each word. sizes: tokens of each word; tokens: all of them, one word after the other."""
        ends = np.cumsum(sizes)
        pos = (np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)).astype(np.int32)
        right_pos, right_token = pos + 1, np.append(tokens[1:], np.int32(-1))
        right_pos[ends - 1] = right_token[ends - 1] = -1  # no neighbour
        word = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.db.register("start", pa.table({"word": word, "pos": pos, "token": tokens, "right_pos": right_pos, "right_token": right_token}))
        # A single piece of over ROWS_HELD tokens needs more than the usual memory, in proportion to its length.
        self.db.execute(f"SET memory_limit = '{max(MEMORY, MEMORY * int(ends[-1]) // ROWS_HELD)}MB'")
        found = self.db.sql(query, params=given or None).to_arrow_table()
        self.db.unregister("start")
        ids = found.column("ids").combine_chunks()
        flat, places = ids.values.to_numpy().astype("<u4").tobytes(), (4 * ids.offsets.to_numpy()).tolist()
        steps = found.column("step").to_pylist() if given else itertools.repeat(0)
        return ((w, flat[i:j], step) for w, (i, j), step in zip(found.column("word").to_pylist(), itertools.pairwise(places), steps, strict=False))

    def _short(self, pieces: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """The ids of pieces, which come in the order of their lengths."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        rows, start = np.cumsum(sizes**2), 0
        while start < len(pieces):
            end = max(start + 1, int(np.searchsorted(rows, (rows[start - 1] if start else 0) + STEP_ROWS, "right")))
            group = pieces[start:end]
            yield from ((group[w], ids) for w, ids, _ in self._contract(CONTRACT, sizes[start:end], self.single[np.frombuffer(b"".join(group), np.uint8)]))
            start = end

    def _long(self, pieces: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        left = [(p, self.single[np.frombuffer(p, np.uint8)]) for p in pieces]
        while left:
            rows, n = 0, 0
            while n < len(left) and (not n or rows + len(left[n][1]) <= STEP_ROWS // 32):
                rows += len(left[n][1])
                n += 1
            group, left = left[:n], left[n:]
            steps = max(4, STEP_ROWS // rows)
            sizes = np.array([len(tokens) for _, tokens in group])
            for w, ids, step in self._contract(CONTRACT_RUNS, sizes, np.concatenate([tokens for _, tokens in group]), steps=steps):
                if step < steps:
                    yield group[w][0], ids
                else:
                    left.insert(0, (group[w][0], np.frombuffer(ids, "<u4").astype(np.int32)))

    def _learn(self, words: list[str]) -> None:
        """Put the ids of these words, none of which is in the vocabulary, in the cache."""
        encoded = [n.encode() for n in words]
        cut = [(n, self._pieces(w)) for n, w in zip(words, encoded, strict=True) if len(w) > LONG_WORD]
        pieces = {p for _, ps in cut for p in ps}
        known = {p: self.ranks[p].to_bytes(4, "little") for p in pieces if p in self.ranks}
        new = sorted(pieces.difference(known).union(w for w in encoded if len(w) <= LONG_WORD), key=len)  # words of a length take as many steps
        known.update(self._short([p for p in new if len(p) <= LONG_WORD]))
        known.update(self._long([p for p in new if len(p) > LONG_WORD]))
        learnt = {n: known[w] for n, w in zip(words, encoded, strict=True) if len(w) <= LONG_WORD}
        learnt.update((n, b"".join(map(known.__getitem__, ps))) for n, ps in cut)
        self.cache.update(learnt)
        self.held += sum(len(n) + len(ids) + ENTRY for n, ids in learnt.items())

    def _words(self, text: str) -> Iterator[list[str]]:
        """The words of a text, at most MATCHES at a time."""
        if len(text) <= MATCHES:
            yield self.pattern.findall(text)
            return
        found = self.pattern.finditer(text)
        while some := [m.group() for m in itertools.islice(found, MATCHES)]:
            yield some

    def _encode(self, cut: list[list[str]]) -> list[bytes]:
        if self.held > CACHE_BYTES:
            self.cache, self.held = dict(self.whole), 0
        new: set[str] = set()
        for words in cut:
            new.update(itertools.filterfalse(self.cache.__contains__, words))
        if new:
            self._learn(sorted(new))
        return [b"".join(map(self.cache.__getitem__, words)) for words in cut]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        short = iter(self._encode([self.pattern.findall(t) for t in texts if len(t) <= MATCHES]))
        return [next(short) if len(t) <= MATCHES else b"".join(self._encode([words])[0] for words in self._words(t)) for t in texts]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of each row of ids, at most DECODED of them in one query."""
        out: list[list[bytes]] = [[] for _ in ids]
        group: list[tuple[int, bytes]] = []
        held = 0
        for n, x in enumerate(ids):
            for at in range(0, len(x), 4 * DECODED):
                part = x[at : at + 4 * DECODED]
                if held + len(part) > 4 * DECODED and group:
                    self._decode(group, out)
                    group, held = [], 0
                group.append((n, part))
                held += len(part)
        self._decode(group, out)
        return [b"".join(x) for x in out]

    def _decode(self, group: list[tuple[int, bytes]], out: list[list[bytes]]) -> None:
        sizes = np.fromiter((len(x) // 4 for _, x in group), np.int64, len(group))
        tokens = np.frombuffer(b"".join(x for _, x in group), "<u4").astype(np.int32)
        self.db.register("encoded", pa.table({"doc": np.repeat(np.arange(len(group), dtype=np.int32), sizes), "pos": np.arange(len(tokens)), "token": tokens}))
        found = dict(self.db.execute(DECODE).fetchall())
        self.db.unregister("encoded")
        for k, (n, _) in enumerate(group):
            out[n].append(found.get(k, "").encode("latin-1"))


@functools.cache
def codec(ranks_path: str, pattern: str) -> Codec:
    """One codec for a worker process, kept for all its tasks."""
    return Codec(ranks_path, pattern)


def encode(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, text: str = "text", with_ids: bool = True, verify: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array of long) of each row of docs.

    with_ids: give the ids themselves. verify: decode the ids again; else decoded_sha256 is null.
    """
    ranks_path, pattern = ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in slices(batches, "text", 2 << 20):
            ids = own.encode([x or "" for x in batch.column("text").to_pylist()])
            columns = [
                batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(x).hexdigest() for x in own.decode(ids)] if verify else [None] * len(ids), pa.string()),
            ]
            if with_ids:
                columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in ids], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<bigint>" * with_ids
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def decode(tokens: DataFrame, ranks_path: str | None = None, pattern: str | None = None, ids: str = "ids") -> DataFrame:
    """doc_id and the text of each row's ids; a null or empty list has the empty text; bytes that are not UTF-8 become replacement
    characters; an id that is not in the vocabulary adds nothing; repeated rows are decoded alike; extra columns are ignored."""
    ranks_path, pattern = ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    bound_batches(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            texts = own.decode([np.array(x or [], "<u4").tobytes() for x in batch.column("ids").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.decode("utf-8", "replace") for x in texts], pa.string())], ["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(ids).cast("array<bigint>").alias("ids")).mapInArrow(run, "doc_id bigint, text string")
