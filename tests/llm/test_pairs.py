"""Line dedup and the n-gram Jaccard join against brute force."""

import random

import duckdb
import numpy as np
import pytest
import regex
from helpers import DATA, assert_same, connection
from hypothesis import given, settings
from hypothesis import strategies as st

from lexigrid.llm import components, linededup, ngramjoin, queries, shingles

# Line dedup


def line_words(line):
    return [w for w in regex.split(r"[^\p{L}\p{M}\p{N}]+", line.lower()) if w]


def single_bytes(a, b):
    """The pair with every other character as an unused byte: DuckDB's distance counts bytes. Lines are in lower case."""
    others = sorted({c for c in a + b if ord(c) > 127})
    unused = [chr(k) for k in range(1, 128) if chr(k) not in a and chr(k) not in b]
    table = {ord(c): unused[k] for k, c in enumerate(others)}
    return a.translate(table), b.translate(table)


def distances(pairs):
    pairs = [single_bytes(*p) for p in pairs]
    table = duckdb.connect()
    table.execute("CREATE TABLE p (n BIGINT, a VARCHAR, b VARCHAR)")
    if pairs:
        import pyarrow as pa

        given = pa.table({"n": range(len(pairs)), "a": [x for x, _ in pairs], "b": [y for _, y in pairs]})  # noqa: F841
        table.execute("INSERT INTO p SELECT * FROM given")
    return [r[0] for r in table.sql("SELECT levenshtein(a, b) FROM p ORDER BY n").fetchall()]


def distance(a, b):
    return distances([(a, b)])[0]


def brute_lines(rows):
    """(doc_id, line_no) -> the occurrence that stays, by edit similarity alone."""
    occurrences = {}
    for doc, text in rows:
        for n, line in enumerate((text or "").split("\n") if text is not None else []):
            if words := line_words(line):
                occurrences.setdefault(" ".join(words), set()).add((-(1 << 63) if doc is None else doc, n))
    names = list(occurrences)
    root = list(range(len(names)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    allowed = lambda x, y: int(max(len(x), len(y)) * (1 - linededup.SIMILAR))
    pairs = [(i, j) for i in range(len(names)) for j in range(i) if abs(len(names[i]) - len(names[j])) <= allowed(names[i], names[j])]
    for (i, j), d in zip(pairs, distances([(names[i], names[j]) for i, j in pairs]), strict=True):
        if d <= allowed(names[i], names[j]):
            root[find(i)] = find(j)
    groups = {}
    for n, name in enumerate(names):
        groups.setdefault(find(n), set()).update(occurrences[name])
    return {x: min(g) for g in groups.values() for x in g}


def reported(df):
    low = lambda x: -(1 << 63) if x is None else x
    return {(low(r.doc_id), r.line_no): (low(r.first_doc_id), r.first_line_no) for r in df.collect()}


def near_lines(seed=3):
    rng = random.Random(seed)
    base = [["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(120)] for _ in range(12)]
    rows = []
    for n in range(90):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = "new"
        rows.append((n, "\n".join([" ".join(words), "Common line 5!", f"only {chr(97 + n % 26) * 3} here"])))
    return rows


def test_lines_brute_force(spark):
    rows = near_lines()
    got = reported(linededup.dedup_report(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert got == brute_lines(rows)
    assert len(set(got.values())) < len(got) / 2


def test_lines_recall(spark):
    """Groups by edit similarity alone, whatever the hashes: one word of 10, 20 or 50 replaced, or one character of a short line."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    rows = []
    for n in [10, 20, 50] * 40:
        words = [word() for _ in range(n)]
        at = rng.randrange(n)
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join([*words[:at], "new", *words[at + 1 :]]))]
    for _ in range(40):
        line = "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(7, 14)))
        rows += [(len(rows), line), (len(rows) + 1, line[:3] + "z" + line[4:])]
    got = reported(linededup.dedup_report(spark.createDataFrame(rows, "doc_id bigint, text string")))
    pairs = [(a, b) for (a, x), (b, y) in zip(rows[::2], rows[1::2], strict=True) if distance(x, y) <= int(max(len(x), len(y)) * (1 - linededup.SIMILAR))]
    found = [got[b, 0] == (a, 0) for a, b in pairs]
    assert len(pairs) > 140 and sum(found) >= 0.97 * len(found) and all(f for f, (a, _) in zip(found, pairs, strict=True) if a >= 240)


def test_lines_numbers(spark):
    """A repeated line of numbers is one line; lines that differ in numbers are linked by edit similarity alone."""
    rows = [(1, "12 | 345 | 6789"), (2, "12, 345, 6789"), (3, "Total 12"), (4, "Total 3 4"), (5, "Chapter 1"), (6, "Chapter 2"), (7, "1987"), (8, "1988")]
    got = reported(linededup.dedup_report(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert {k[0]: v[0] for k, v in got.items()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7, 8: 8}
    kept = linededup.drop_lines(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5, 7, 8]


def test_lines_odd(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect() if r.doc_id not in (9, 10)]
    assert reported(linededup.dedup_report(odd.where("doc_id is null or doc_id not in (9, 10)"))) == brute_lines(rows)
    assert linededup.dedup_report(odd.where("doc_id in (9, 10)")).where("kept").count() == 1
    assert linededup.dedup_report(none).count() == 0


def test_drop_lines(odd, none):
    got = {r.doc_id: r for r in linededup.drop_lines(odd.where("doc_id = 11 or doc_id = 15")).collect()}
    assert got[11].text == "a\nb\nLine number 17 of the text" and got[11].n_chars == len(got[11].text) and got[11].key == "y"
    whole = linededup.drop_lines(odd)
    assert whole.columns == odd.columns and {4, 5, 6} <= {r.doc_id for r in whole.collect()}
    assert linededup.drop_lines(none).count() == 0


def test_blocks_are_simhashes(spark):
    """A block is the majority of the bits of five hashes that follow one another; a changed feature leaves the blocks it doesn't vote in."""
    from pyspark.sql import functions as F

    rng = random.Random(2)
    features = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(12)]
    other = sorted(features)
    other[-1] = (1 << 63) - 1
    df = spark.createDataFrame([(1, sorted(features)), (2, other), (3, features[:3])], "id bigint, by_words array<bigint>").selectExpr("*", "cast(null as array<bigint>) by_grams", "cast(null as array<bigint>) by_deletion")
    got = {}
    for r in linededup.entered_blocks(df).collect():
        got.setdefault(r.id, set()).add(r.key)
    in_order, mask = sorted(features), (1 << 64) - 1
    votes = lambda x, k: sum(n * ((h & mask) >> k & 1) for h, n in zip(x, (1, 1, 1, 2, 2), strict=True))
    hashes = [sum(1 << k for k in range(64) if votes(in_order[i : i + 5], k) >= 4) for i in range(8)]
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    assert got[1] == {r.x for r in spark.createDataFrame([(h,) for h in signed], "h bigint").select(F.xxhash64(F.lit(0), "h").alias("x")).collect()}
    assert len(got[1]) == 8 and len(got[1] & got[2]) == 7 and len(got[3]) == 1


def test_lines_recall_by_length(spark):
    """One word in 25, one at least, replaced in lines of 8 to 160 words: of the pairs that are similar, nine in ten are found at any length."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    rows, lengths = [], (8, 10, 12, 16, 20, 30, 40, 80, 160)
    for n in lengths:
        for _ in range(60):
            words = [word() for _ in range(n)]
            changed = list(words)
            for at in rng.sample(range(n), max(1, n // 25)):
                changed[at] = word()
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(changed))]
    got = reported(linededup.dedup_report(spark.createDataFrame(rows, "doc_id bigint, text string")))
    both = [(x, y) for (_, x), (_, y) in zip(rows[::2], rows[1::2], strict=True)]
    near = [d <= int(max(len(x), len(y)) * (1 - linededup.SIMILAR)) for (x, y), d in zip(both, distances(both), strict=True)]
    for k, n in enumerate(lengths):
        pairs = [p for p in range(60 * k, 60 * k + 60) if near[p]]
        assert len(pairs) > 25 and sum(got[2 * p + 1, 0] == (2 * p, 0) for p in pairs) >= 0.9 * len(pairs), n


def test_long_lines_that_differ_in_marks(spark):
    """Lines whose normal forms are equal, or differ in one word, meet at any length, whatever stands between their words."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopé") for _ in range(rng.randrange(3, 9)))
    rows = []
    for between in (", ", " - ", "; ", "…", " «", "\u00a0", "_", "\t"):
        for n in (30, 80):
            words = [word() for _ in range(n)]
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, between.join(words).upper() + between), (len(rows) + 2, between.join([*words[:-1], "new"]))]
    got = reported(linededup.dedup_report(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert got == brute_lines(rows) and set(got.values()) == {(n, 0) for n in range(0, len(rows), 3)}


def test_lines_leave_no_features_on_disk(spark, monkeypatch, tmp_path):
    """When lines are compared, no table of theirs holds what the blocks were made of."""
    monkeypatch.setattr(linededup, "new_table", lambda _, kind: f"file://{tmp_path}/lexigrid-{kind}-{random.random()}")
    seen, own = [], linededup.verified

    def watched(*a):
        seen.append({c for p in tmp_path.glob("lexigrid-*") for c in spark.read.parquet(str(p)).columns})
        return own(*a)

    monkeypatch.setattr(linededup, "verified", watched)
    rows = near_lines(4)
    got = reported(linededup.dedup_report(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert got == brute_lines(rows)
    assert len(seen) == 2 and all("k1" in x and not x & {"by_words", "by_grams", "by_deletion"} for x in seen)


def test_lines_of_common_words_do_not_meet(spark):
    """Lines that share many short words, and are not similar, have no block in common."""
    rng = random.Random(9)
    common = ["the", "of", "and", "a", "to", "in", "is", "was", "on", "as", "for", "he"]
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(6, 10)))
    lines = []
    for _ in range(400):
        words = common + [word() for _ in range(18)]
        rng.shuffle(words)
        lines.append(" ".join(words))
    docs = linededup.keyed(spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string"))
    blocks = linededup.entered_blocks(linededup.hashed_lines(docs).withColumnRenamed("k1", "id"))
    assert blocks.groupBy("key").count().where("count > 1").count() == 0


def test_many_lines_without_others(spark, monkeypatch):
    """Beyond the limit of broadcasts, of all lines only those that are compared (and one in eight of the others) are shuffled, with the same result."""
    lines = [(n, n % 7, k) for n in range(3000) for k in range(4)]
    rows = spark.createDataFrame(lines, "d bigint, h bigint, line_no int")
    wanted = rows.where("d % 20 = 0")
    got = {tuple(r) for r in linededup.marked(rows, wanted).select("d", "h", "line_no").collect()}
    assert {x for x in lines if x[0] % 20 == 0} <= got and len(got) < len(lines) * (1 / 20 + 1 / 8)
    monkeypatch.setattr(linededup, "MARKS", 64)
    assert {x for x in lines if x[0] % 20 == 0} <= {tuple(r) for r in linededup.marked(rows, wanted).select("d", "h", "line_no").collect()}
    monkeypatch.setattr(linededup, "BROADCAST_ROWS", 0)
    given, shuffled = near_lines(11), []
    own = linededup.marked
    monkeypatch.setattr(linededup, "marked", lambda rows, wanted: shuffled.append(1) or own(rows, wanted))
    assert reported(linededup.dedup_report(spark.createDataFrame(given, "doc_id bigint, text string"))) == brute_lines(given) and len(shuffled) == 2


def test_lines_clashing_names(spark):
    """Names that the operator uses itself, names with dots and names that differ in case alone do no harm."""
    rows = [(1, "one line here\nsecond line there", "x", 1, "q", 2), (2, "one line here\nthird of them", "y", 3, "r", 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, `_d` string, `a.b` int, `out` string, `D` int")
    got = {r[0]: tuple(r) for r in linededup.drop_lines(docs).collect()}
    assert got == {1: rows[0], 2: (2, "third of them", "y", 3, "r", 4)}


def test_long_document_of_repeated_lines(spark):
    lines = [f"line {n} holds {n * 7} and {n * 13} of them" for n in range(40_000)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(lines[:20_000] + ["something else entirely"]))], "doc_id bigint, text string")
    monkey = {r.doc_id: r.text for r in linededup.drop_lines(docs).collect()}
    assert monkey[2] == "something else entirely" and monkey[1].split("\n")[0] == lines[0]


# N-gram join


def sql_classes(rows):
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    return {(r[0], r[1], r[2]) for r in db.sql(ngramjoin.oracle()).fetchall()}


def copies(seed, n, lengths, vocabulary=400):
    rng = random.Random(seed)
    base = [[f"v{rng.randrange(vocabulary)}" for _ in range(rng.choice(lengths))] for _ in range(max(2, n // 8))]
    rows = []
    for k in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            words[rng.randrange(len(words))] = f"n{rng.randrange(9)}"
        rows.append((k, " ".join(words[: len(words) - rng.choice([0, 0, 0, 1])])))
    return rows


def classes(df):
    return {(r.doc_id, r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("light", [256, 2])
def test_classes_brute_force(spark, monkeypatch, light):
    monkeypatch.setattr(ngramjoin, "LIGHT", light)
    monkeypatch.setattr(ngramjoin, "BLOCK_SHINGLES", 2000)
    monkeypatch.setattr(ngramjoin, "HOT", 5)
    rows = copies(1, 80, [5, 6, 7, 8, 9, 10, 12]) + [(1000 + a, b) for a, b in copies(2, 80, [60, 120, 200])]
    assert classes(ngramjoin.ngram_classes(spark.createDataFrame(rows, "doc_id bigint, text string"))) == sql_classes(rows)


def test_classes_odd(odd, none):
    rows = sorted({(r.doc_id, r.text) for r in odd.where("doc_id is not null and doc_id not in (9, 10)").collect()}, key=str)
    assert classes(ngramjoin.ngram_classes(odd.where("doc_id is not null and doc_id not in (9, 10)"))) == sql_classes(rows)
    got = {r.doc_id: r.component_id for r in ngramjoin.ngram_classes(odd).collect()}
    assert got[10] == 9 and got[None] is None and got[16] == 16
    assert ngramjoin.ngram_classes(none).count() == 0
    assert sorted(r.doc_id or 0 for r in ngramjoin.keep_one(odd).collect()) == [0, 1, 4, 5, 6, 7, 9, 11, 12, 13, 14, 15, 16]


def test_classes_sql(spark):
    db = connection("sf0.001")
    assert_same(queries.queries()["op2_ngram_jaccard"](spark, f"{DATA}/sf0.001").toPandas(), db.sql(queries.oracle_sql()["op2_ngram_jaccard"]).df())


sets = st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=60).map(lambda x: np.array(sorted(x), np.uint64))


@settings(max_examples=100, deadline=None)
@given(sets, sets, st.integers(0, 60))
def test_bounds(a, b, shared):
    b = np.unique(np.concatenate((b, a[:shared])))
    apart = len(np.setxor1d(a, b))
    assert ngramjoin.least_difference(ngramjoin.bitmap(a), ngramjoin.bitmap(b)) <= apart
    both = len(np.intersect1d(a, b))
    assert ngramjoin.similar(a, b) == (both >= ngramjoin.need(len(a), len(b)))


@given(st.lists(st.integers(0, 2**32 - 1), max_size=50).map(sorted))
def test_packed(values):
    assert ngramjoin.unpacked(ngramjoin.packed(np.array(values, np.uint32))).tolist() == values


def test_boundary():
    assert ngramjoin.boundary({}) == ngramjoin.MOST_SMALL
    assert 3 <= ngramjoin.boundary({n: 100 for n in range(1, 13)}) < ngramjoin.MOST_SMALL
    assert ngramjoin.subset_sizes(4) == [3, 4]


def test_shingles():
    texts = ["a b c d e f", "A  b\tc d e\nf", "a b", None, "", "é b c d e"]
    s = shingles.shingle_sets(texts)
    assert [len(x) for x in s] == [2, 2, 1, 0, 0, 1] and (s[0] == s[1]).all()
    assert (shingles.shingle_sets(["zz yy", "a b c d e f"])[1] == s[0]).all()


def test_components(spark):
    rng = random.Random(8)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(n, n + 1) for n in range(1000, 1040)] + [(5000, 5000 + n) for n in range(1, 300)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    got = {r.id: r.component for r in components.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in list(root)}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
