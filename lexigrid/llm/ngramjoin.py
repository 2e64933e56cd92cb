"""N-gram Jaccard join: a size-aware heavy-light join of word-shingle sets.

Equal sets become one first. A small set is entered under each of its subsets of a fixed size: sets of sizes a and b
with Jaccard similarity t share at least c = t (a + b) / (1 + t) shingles, so they share a subset of c, and two sets
that share one are similar without further check. A large set is looked up in inverted lists: in one order of all
shingles, rare before frequent, similar sets share one of their first n - tn + 1. The size up to which a set is small is
where the estimated cost of its subsets passes that of its lists.

Light lists give the pairs that pass the bounds of size and place; parity bitmaps of the sets (an exact upper bound of
the overlap) drop most others, and the rest are compared shingle by shingle. Sets of heavy lists (over LIGHT sets) are
dealt out in blocks; each pair of blocks is compared by one task as a product of 0/1 matrices, and gives a spanning
forest of its links rather than all of them. Components of the links are the classes.

Defined results: null, blank and word-free texts have the empty set and are linked with nothing; a text of fewer words
than a shingle has its whole sequence as its one shingle; rows that share a doc_id count as one document; rows without a
doc_id are ignored by the join and are their own class (null); ties don't arise; an empty table gives no rows; extra
columns are ignored. Texts are whole: no list, set or class is cut short.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, cut, drop_table, new_table, numbered, parallelism, slices, trim
from .components import components
from .shingles import folded, mixed, shingle_sets

#: Similarity as a fraction.
NUM, DEN = 3, 4
WIDTH = 5
#: A shingle that so many documents hold is placed behind rarer ones; the HOT_KEPT most frequent are told apart (16 bytes
#: each on the driver and in every task). Shingles are counted by COUNT_BITS bits of their hashes, enough for some 2 ** 34
#: shingles. The order never changes the result, only the work.
HOT, HOT_KEPT, COUNT_BITS = 64, 400_000, 32
#: Sets of a list that is compared pair by pair; longer lists go by blocks of about BLOCK_SHINGLES, BLOCK_SETS sets at most.
LIGHT, BLOCK_SHINGLES, BLOCK_SETS = 256, 200_000, 256
#: Estimated candidates of a set in inverted lists, for the boundary.
CANDIDATES = 3
#: Sizes that the boundary may take; subsets of larger sets are too many in any case.
MOST_SMALL = 12
#: Bytes of text that are hashed at once: numpy's temporaries take some 40 times as much.
SLICE = 1 << 19
#: doc_ids that are broadcast up to so many (16 bytes each), and joined by a shuffle beyond.
BROADCAST_ROWS = 1_000_000


def need(a: int, b: int) -> int:
    """The least overlap of similar sets of sizes a and b."""
    return -(-NUM * (a + b) // (NUM + DEN))


def prefix_length(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def subset_sizes(n: int) -> list[int]:
    return sorted({need(n, b) for b in range(-(-NUM * n // DEN), DEN * n // NUM + 1)})


def boundary(sizes: dict[int, int]) -> int:
    """The largest size of a small set, by the estimated cost over the sizes that occur: rows of subsets against rows of lists and candidates to compare."""
    subsets = lambda n: sum(math.comb(n, c) for c in subset_sizes(n))
    lists = lambda n: prefix_length(n) + CANDIDATES * n
    cost = lambda x: sum(k * (subsets(n) if n <= x else lists(n)) for n, k in sizes.items() if n <= MOST_SMALL)
    return min(range(MOST_SMALL + 1), key=lambda x: (cost(x), -x))


def bitmap(s: np.ndarray) -> bytes:
    """Parity of the shingles that fall on each bit; about as many bits as shingles."""
    bits = max(64, 1 << (len(s) - 1).bit_length()) if len(s) else 64
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """A lower bound of the symmetric difference: the larger bitmap folds to the size of the smaller."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(a) > len(b):
        a, b = b, a
    return int(np.bitwise_count(np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0) ^ a).sum())


def packed(values: np.ndarray) -> bytes:
    """Sorted 32-bit numbers as 16-bit steps; a step of 65535 goes on without standing for a number."""
    steps = np.diff(values.astype(np.int64), prepend=0)
    marks = steps // 65535
    out = np.full(len(values) + int(marks.sum()), 65535, np.uint16)
    out[np.cumsum(marks + 1) - 1] = steps % 65535
    return out.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, np.uint16)
    return np.cumsum(steps.astype(np.int64))[steps != 65535]


def hot_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles' hash bits, sorted, and how many documents hold them. All shingles of all documents count.

    A task sorts what it has read and sends one packed run to each range of hashes; a range is counted by one task.
    """
    ranges = 4 * parallelism(docs.sparkSession)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def send() -> pa.RecordBatch:
            values = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint32)
            edges = np.searchsorted(values, (np.arange(ranges + 1) << COUNT_BITS) // ranges)
            parts = [(r, packed(values[a:b])) for r, (a, b) in enumerate(itertools.pairwise(edges.tolist())) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())], ["range", "run"])

        for batch in slices(batches, "text", SLICE):
            for s in shingle_sets(batch.column("text").to_pylist(), WIDTH):
                held.append((s >> np.uint64(64 - COUNT_BITS)).astype(np.uint32))
                n += len(s)
            if n > 3_000_000:
                yield send()
                held, n = [], 0
        yield send()

    def count(table: pa.Table) -> pa.Table:
        values, times = np.unique(np.concatenate([unpacked(x) for x in table.column("run").to_pylist()]), return_counts=True)
        often = times >= HOT
        trim()
        return pa.table({"shingle": values[often], "times": times[often].astype(np.int64)})

    counted = docs.select("text").mapInArrow(runs, "range int, run binary").groupBy("range").applyInArrow(count, "shingle bigint, times bigint")
    found = counted.orderBy(F.desc("times"), "shingle").limit(HOT_KEPT).toArrow()
    h, t = found.column("shingle").to_numpy().astype(np.uint64), found.column("times").to_numpy()
    order = np.argsort(h)
    return h[order], t[order]


def _keys(s: np.ndarray, hot: np.ndarray, heat: np.ndarray, small: int) -> tuple[np.ndarray, int]:
    """The keys of a set: its prefix, unless no partner can be large, and its subsets, with their size in the lowest bits, if it is small."""
    n = len(s)
    prefix = s[:0]
    if n > small or DEN * n // NUM > small:
        order = s
        if len(hot):
            bits = s >> np.uint64(64 - COUNT_BITS)
            at = np.searchsorted(hot, bits)
            at[at == len(hot)] = 0
            order = s[np.lexsort((s, np.where(hot[at] == bits, heat[at], 0)))]
        prefix = order[: prefix_length(n)]
    if n > small:
        return prefix, len(prefix)
    subsets = []
    for c in subset_sizes(n):
        subsets += [(folded(c, s[list(chosen)]) & ~np.uint64(31)) | np.uint64(c) for chosen in itertools.combinations(range(n), c)]
    return np.concatenate((prefix, *subsets)), len(prefix)


def described(docs: DataFrame) -> DataFrame:
    """doc_id, n, f1, f2 (a fingerprint of the set) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            sets = shingle_sets(batch.column("text").to_pylist(), WIDTH)
            f1 = [int(s.sum(dtype=np.uint64).astype(np.int64)) for s in sets]
            f2 = [int(mixed(s).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, sets), pa.int32()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64())], ["doc_id", "n", "f1", "f2"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n int, f1 bigint, f2 bigint")


def entered(docs: DataFrame, hot: np.ndarray, heat: np.ndarray, small: int) -> DataFrame:
    """doc_id, n, keys, n_prefix, bitmap of every document that has shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            sets = shingle_sets(batch.column("text").to_pylist(), WIDTH)
            found = [(d, s, *_keys(s, hot, heat, small)) for d, s in zip(batch.column("doc_id").to_pylist(), sets, strict=True) if len(s)]
            yield pa.RecordBatch.from_arrays([
                pa.array([x[0] for x in found], pa.int64()), pa.array([len(x[1]) for x in found], pa.int32()), pa.array([x[2].astype(np.int64) for x in found], pa.list_(pa.int64())),
                pa.array([x[3] for x in found], pa.int32()), pa.array([bitmap(x[1]) for x in found], pa.binary()),
            ], ["doc_id", "n", "keys", "n_prefix", "bitmap"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null").mapInArrow(run, "doc_id bigint, n int, keys array<bigint>, n_prefix int, bitmap binary")


def _scan_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, n, doc): links of small sets, candidate pairs of light lists, and the members of heavy lists tied to the list's first.

    A list is read once; at most LIGHT + 1 of its rows are held.
    """
    out: tuple[list, list, list] = ([], [], [])
    key, held, heavy, first = None, [], False, None

    def put(kind: int, a: int, b: int) -> None:
        if a != b:
            out[0].append(kind), out[1].append(min(a, b)), out[2].append(max(a, b))

    def close() -> None:
        if heavy:
            return
        for y in range(1, len(held)):
            n, doc, pos = held[y]
            for x in range(y - 1, -1, -1):
                m, other, at = held[x]
                if DEN * m < NUM * n:
                    break
                if min(m - at, n - pos) >= need(m, n):
                    put(1, other, doc)

    for batch in batches:
        keys, ns, docs, poss = (batch.column(c).to_numpy() for c in ("key", "n", "doc", "pos"))
        if not len(keys):
            continue
        again = keys[1:] == keys[:-1]
        many = np.zeros(len(keys), bool)
        many[1:] |= again
        many[:-1] |= again
        many[0] = many[-1] = True
        for i in np.flatnonzero(many).tolist():
            k, row = keys[i], (int(ns[i]), int(docs[i]), int(poss[i]))
            if k != key:
                close()
                key, held, heavy, first = k, [], False, row
            if row[2] < 0:  # a subset of c shingles: the smallest set that has it is similar to all that are similar to any of the list
                heavy = True
                if need(first[0], row[0]) <= -row[2]:
                    put(0, first[1], row[1])
            elif heavy:
                put(2, first[1], row[1])
            else:
                held.append(row)
                if len(held) > LIGHT:
                    heavy = True
                    for x in held:
                        put(2, first[1], x[1])
                    held = []
        if len(out[0]) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], ["kind", "a", "b"])
            out = ([], [], [])
    close()
    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], ["kind", "a", "b"])


def _may_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        na, nb = batch.column("na").to_pylist(), batch.column("nb").to_pylist()
        keep = [least_difference(x, y) <= m + n - 2 * need(m, n) for x, y, m, n in zip(batch.column("xa").to_pylist(), batch.column("xb").to_pylist(), na, nb, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * both >= NUM * (len(a) + len(b) - both)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (a, b): the set of a (b null), then the sets of its candidates b."""
    own, of = None, None
    for batch in batches:
        links: tuple[list, list] = ([], [])
        lists = batch.column("set")
        flat, offsets = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
        for i, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)):
            s = flat[offsets[i] : offsets[i + 1]]
            if b is None:
                own, of = s.copy(), a
            elif a == of and similar(own, s):
                links[0].append(a), links[1].append(b)
        yield pa.RecordBatch.from_arrays([pa.array(links[0], pa.int64()), pa.array(links[1], pa.int64())], ["a", "b"])


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, set (sorted shingle hashes) of the documents in ids."""
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(wanted, "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            sets = shingle_sets(batch.column("text").to_pylist(), WIDTH)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))], ["doc_id", "set"])

    return rows.mapInArrow(run, "doc_id bigint, set array<bigint>")


def _forest(ids: list[int], sides: np.ndarray, sets: list[np.ndarray], same: bool) -> list[tuple[int, int]]:
    """A spanning forest of the links between the sets of side 0 and side 1, or among all if they are the same block."""
    tokens = np.concatenate(sets)
    names, column = np.unique(tokens, return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    n, overlap = np.array([len(s) for s in sets]), np.zeros((len(sets), len(sets)), np.float32)
    step = max(1, (8 << 20) // max(1, len(sets)))
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    for low in range(0, len(names), step):
        i, j = np.searchsorted(column, (low, low + step))
        dense = np.zeros((len(sets), min(step, len(names) - low)), np.float32)
        dense[row[i:j], column[i:j] - low] = 1
        overlap += dense @ dense.T
    both = overlap.astype(np.int64)
    linked = DEN * both >= NUM * (n[:, None] + n[None, :] - both)
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    found = []
    for x, y in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
        if same or sides[x] != sides[y]:
            p, q = find(int(x)), find(int(y))
            if p != q:
                root[p] = q
                found.append((ids[x], ids[y]))
    return found


def _block_pair(table: pa.Table) -> pa.Table:
    lists = table.column("set").combine_chunks()
    flat, offsets = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
    sets = [flat[i:j] for i, j in itertools.pairwise(offsets.tolist())]
    same = table.column("i")[0].as_py() == table.column("j")[0].as_py()
    found = _forest(table.column("doc_id").to_pylist(), table.column("side").to_numpy(), sets, same)
    trim()
    return pa.table({"a": pa.array([min(x) for x in found], pa.int64()), "b": pa.array([max(x) for x in found], pa.int64())})


def heavy_links(docs: DataFrame, ties: DataFrame, sizes: DataFrame) -> DataFrame:
    """Links among the members of heavy lists. Members that share heavy lists, directly or by others, form a cluster; a
    cluster's members, in order of size, are cut into blocks, and blocks meet whose sizes allow similar sets."""
    members = components(ties).withColumnRenamed("id", "doc_id").join(sizes, "doc_id")
    # Blocks by hash inside a band of sizes: a band is a factor of 4/3 wide, so similar sets lie in the same or in neighbouring bands.
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(DEN / NUM)))
    members = members.withColumn("band", band.cast("int"))
    per_band = members.groupBy("component", "band").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_SETS)).cast("int").alias("blocks"))
    members = cut(members.join(per_band, ["component", "band"]).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).drop("blocks"))
    # A block goes to every pair of blocks that it belongs to: those of its own band and of the bands beside it.
    listed = per_band.select("component", F.col("band").alias("other_band"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    near = members.select("component", "doc_id", "band", "block", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("other_band"))
    own, far = F.struct("band", "block"), F.struct(F.col("other_band").alias("band"), F.col("other").alias("block"))
    dealt = near.join(listed, ["component", "other_band"]).select("component", "doc_id", F.least(own, far).alias("i"), F.greatest(own, far).alias("j"), (own > far).cast("int").alias("side"))
    with_sets = cut(dealt).join(sets_of(docs, members.select("doc_id").distinct()), "doc_id")
    return with_sets.groupBy("component", "i", "j").applyInArrow(_block_pair, "a bigint, b bigint")


def ngram_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs."""
    spark: SparkSession = docs.sparkSession
    bound_batches(spark)
    hot, heat = hot_shingles(docs)
    facts = cut(described(docs))
    kinds = facts.where("n > 0 and doc_id is not null").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"))
    kinds = cut(kinds)
    histogram = {r["n"]: r["k"] for r in kinds.where(F.col("n") <= MOST_SMALL).groupBy("n").agg(F.count("*").alias("k")).collect()}
    small = boundary(histogram)
    copies = cut(facts.where("n > 0 and doc_id is not null").join(kinds, ["f1", "f2", "n"]).where("doc_id <> rep").select("doc_id").distinct().join(kinds.select(F.col("rep").alias("doc_id")), "doc_id", "left_anti"))
    table = new_table(spark, "sets")
    entered(docs, hot, heat, small).join(F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies, "doc_id", "left_anti").write.parquet(table)
    entries = spark.read.parquet(table)
    flat = entries.select(F.col("doc_id").alias("doc"), "n", "n_prefix", F.posexplode("keys").alias("i", "key"))
    place = F.when(F.col("i") < F.col("n_prefix"), F.col("i")).otherwise(-(F.col("key").bitwiseAND(31)).cast("int"))
    lists = flat.select("key", "n", "doc", place.alias("pos")).repartition(parallelism(spark), "key").sortWithinPartitions("key", "n", "doc")
    found = cut(lists.mapInArrow(_scan_lists, "kind int, a bigint, b bigint").distinct())
    facts_of = entries.select(F.col("doc_id"), "n", "bitmap")
    side = lambda x: facts_of.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("bitmap").alias(f"x{x}"))
    maybe = cut(found.where("kind = 1").select("a", "b").join(side("a"), "a").join(side("b"), "b").mapInArrow(_may_link, "a bigint, b bigint"))
    sets = sets_of(docs, maybe.select(F.col("a").alias("doc_id")).union(maybe.select("b")).distinct())
    firsts = sets.join(maybe.select(F.col("a").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.lit(None).cast("bigint").alias("b"), "set")
    seconds = maybe.join(sets.withColumnRenamed("doc_id", "b"), "b").select("a", "b", "set")
    verified = firsts.union(seconds).repartition(parallelism(spark), "a").sortWithinPartitions("a", "b").mapInArrow(_verify, "a bigint, b bigint")
    ties = found.where("kind = 2").select("a", "b")
    links = found.where("kind = 0").select("a", "b").union(verified)
    if not ties.isEmpty():
        links = links.union(heavy_links(docs, ties, entries.select("doc_id", "n")))
    links = cut(links.distinct())
    drop_table(spark, table)
    classes = components(links)
    known = kinds.join(classes, kinds["rep"] == classes["id"], "left").select("f1", "f2", "n", F.coalesce("component", "rep").alias("component_id"))
    return facts.join(known, ["f1", "f2", "n"], "left").select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its class; of rows that share it, all."""
    own, at = numbered(docs)
    kept = ngram_classes(own.select(F.col(at["doc_id"]).alias("doc_id"), F.col(at["text"]).alias("text"))).where("component_id = doc_id or doc_id is null").select(F.col("doc_id").alias("kept")).distinct()
    return own.join(kept, F.col(at["doc_id"]).cast("bigint").eqNullSafe(F.col("kept")), "left_semi").toDF(*docs.columns)


def oracle() -> str:
    """DuckDB SQL for ngram_classes()."""
    return r"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM docs),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * k >= 75 * (na + nb - k)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM docs UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM sets JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""
