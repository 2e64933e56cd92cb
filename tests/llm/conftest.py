import pytest

LONG = " ".join("".join(chr(97 + n // 26**k % 26) for k in range(4)) for n in range(30_000))
P1 = "the quick brown fox jumps over the lazy dog and runs far away from the old mill by the river"
ROWS = [
    (1, P1, "en", "s", 1), (2, P1, "en", "s", 1), (2, P1, "en", "s", 1), (3, P1 + " today", None, "s", 1), (4, None, "en", None, None), (5, "", "de", "s", 0), (6, "  \n\t ", "de", "s", 5), (7, "one two", "en", "s", 7),
    (8, "One\ttwo", "en", "s", 7), (9, LONG, "en", "s", 1), (10, LONG + " end", "en", "s", 1), (None, P1, "en", "s", 1), (11, "a\nb\na\nLine number 17 of the text\nline NUMBER 5 of the text!", "en", "s", 9), (12, "x" * 3000, "fr", "s", 1),
    (13, "Das ist ein schöner Tag und die Sonne scheint über dem alten Haus am Fluss", "de", "s", 1), (14, "don't <|endoftext|> İstanbul 123 ½ 漢字 é ='", "xx", "s", 1), (15, "w1 w2 w3", "en", "s", 1), (16, "w1 w2 w3 w4", "en", "s", 1),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd(spark):
    """Rows of every awkward kind, with extra columns whose names operators might use themselves."""
    return spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "'x' AS d", "0 AS h", "1 AS n", "'y' AS key", "'z' AS shard", "2 AS size", "'q' AS words", "false AS kept").repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 0, 0), (9, 0, 1), (99, 1, 0)], "doc_id bigint, quality int, toxic int")
