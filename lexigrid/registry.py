"""Queries of the engine over the driver's tables, and the DuckDB SQL that each must equal."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import stem, text, urls
from .functions.text import sql_tokens
from .operators import corpus, crawl, frequency, index
from .plans import boolean
from .shared import shared_dir
from .sources.corpus import file_name
from .streaming import crawl as crawl_stream
from .streaming import index as index_stream

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

FLAGSHIP = "(the AND of) OR NOT les"
SAMPLE = "COVID-19 affects CD4+ T-cells; Alzheimer's disease. Человек-нейрон 3.14 is pi. U.S.A. β-amyloid and μ-opioid receptors; Δ9 don’t v1.2.3a a_b x+y Ёж 5'3 a--b"
RUSSIAN = "нейронауки психических исследования лечиться мозга дом красивого новыми синее читают учились боюсь человек".split()
MIXED = "covid-19 t-cells modeling studies memory alzheimer's нейронауки that cats running falling enabling sized add day played sky by gas bed being sing feed seeds agreed classes boss analysis ies мозга".split()
EDGES = [("root", "a"), ("root", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "a"), ("x", "y")]
NOW = 2_000_000


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boolean.search_texts(_docs(spark, sf_dir), FLAGSHIP).select("doc_id", "lang", "source")


# Tokens and words


def _stats_sql(grammar: str) -> str:
    return f"""
WITH t AS (SELECT strlen(text) + CASE WHEN text <> '' AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END AS bytes, {sql_tokens("text", grammar)} AS toks FROM documents)
SELECT count(*) AS docs, sum(bytes)::BIGINT AS bytes, sum(len(toks))::BIGINT AS tokens, sum(length(array_to_string(toks, '')))::BIGINT AS chars,
  round(sum(length(array_to_string(toks, ''))) / sum(len(toks)), 6) AS avg_len FROM t"""


def _stats(grammar: str) -> Query:
    return lambda spark, sf_dir: frequency.token_stats(_docs(spark, sf_dir), grammar=grammar).withColumn("avg_len", F.round("avg_len", 6))


for _name, _grammar in (("tok_t3_stats", "wide"), ("tok_t6_stats", "index"), ("tok_t5_stats", "plain")):
    _QUERIES[_name], _SQL[_name] = _stats(_grammar), _stats_sql(_grammar)


@query(f"SELECT doc_id, len({sql_tokens('text', 'words')})::BIGINT AS words FROM documents")
def word_count_ws(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.word_count("text").cast("bigint").alias("words"))


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


@query("\nUNION ALL ".join(f"SELECT '{g}' AS grammar, array_to_string({sql_tokens(_quoted(SAMPLE), g)}, ' ') AS tokens" for g in ("wide", "index", "plain", "words")))
def tok_golden_inline(spark, sf_dir):
    one = spark.createDataFrame([(SAMPLE,)], "text string")
    parts = [one.select(F.lit(g).alias("grammar"), F.array_join(text.tokens("text", g), " ").alias("tokens")) for g in ("wide", "index", "plain", "words")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


_TERMS = f"SELECT unnest({sql_tokens('text', 'index')}) AS term FROM documents"
_PLAIN = f"SELECT unnest({sql_tokens('text', 'plain')}) AS term FROM documents"


@query(f"SELECT term, count(*) AS count FROM ({_TERMS}) GROUP BY term ORDER BY count DESC, term LIMIT 20")
def term_freq_top(spark, sf_dir):
    return frequency.in_order(frequency.term_counts(_docs(spark, sf_dir)), 20)


@query(f"SELECT term, count(*) AS count FROM ({_TERMS}) GROUP BY term")
def term_freq_full(spark, sf_dir):
    return frequency.term_counts(_docs(spark, sf_dir))


@query(f"SELECT count(DISTINCT term) AS unique_terms FROM ({_TERMS})")
def unique_terms(spark, sf_dir):
    return frequency.unique_terms(_docs(spark, sf_dir))


_RANKS = f"SELECT term, count, row_number() OVER (ORDER BY count DESC, term) AS rank FROM (SELECT term, count(*) AS count FROM ({_PLAIN}) GROUP BY term) WHERE count >= 2"
_FIT = f"""
WITH ranks AS ({_RANKS}), n AS (SELECT count(*) AS n FROM ranks),
used AS (SELECT ln(rank) AS x, ln(count) AS y FROM ranks, n WHERE CASE WHEN n >= 10 THEN rank BETWEEN 10 AND 50000 ELSE rank <= least(50000, n) END)
SELECT -regr_slope(y, x) AS s, exp(regr_intercept(y, x)) AS c, count(*) AS points FROM used"""


def _ranks(spark, sf_dir):
    return frequency.ranked(frequency.term_counts(_docs(spark, sf_dir), grammar="plain"), min_freq=2)


@query(_RANKS)
def zipf_ranks(spark, sf_dir):
    return _ranks(spark, sf_dir)


@query(f"SELECT round(s, 6) AS s, round(ln(c), 6) AS ln_c, points FROM ({_FIT})")
def zipf_fit(spark, sf_dir):
    return frequency.zipf_fit(_ranks(spark, sf_dir)).select(F.round("s", 6).alias("s"), F.round(F.log("c"), 6).alias("ln_c"), "points")


@query(f"WITH fit AS ({_FIT}) SELECT rank, count, round(ln(c / pow(rank, s)), 6) AS ln_fitted FROM ({_RANKS}), fit")
def zipf_curve(spark, sf_dir):
    ranks = _ranks(spark, sf_dir)
    return frequency.zipf_curve(ranks, frequency.zipf_fit(ranks)).select("rank", "count", F.round(F.log("fitted"), 6).alias("ln_fitted"))


@query(f"""
WITH counts AS (SELECT term, count(*) AS count FROM ({_PLAIN}) GROUP BY term), top AS (SELECT * FROM counts ORDER BY count DESC, term LIMIT 20)
SELECT (SELECT count(*) FROM documents) AS docs, (SELECT sum(strlen(text))::BIGINT FROM documents) AS bytes, (SELECT sum(count)::BIGINT FROM counts) AS tokens,
  (SELECT count(*) FROM counts) AS unique_terms, (SELECT string_agg(term || ':' || count, ' ' ORDER BY count DESC, term) FROM top) AS top""")
def zipf_report(spark, sf_dir):
    return frequency.zipf_report(_docs(spark, sf_dir)).select("docs", "bytes", "tokens", "unique_terms", "top")


# Index

_ROWS = f"SELECT DISTINCT doc_id, unnest({sql_tokens('text', 'index')}) AS term FROM documents"


@query(f"SELECT term, count(*) AS df FROM ({_ROWS}) GROUP BY term")
def postings_df(spark, sf_dir):
    return index.document_frequency(index.posting_rows(_docs(spark, sf_dir)))


@query(_ROWS)
def postings_rows(spark, sf_dir):
    return index.posting_rows(_docs(spark, sf_dir))


@query(f"SELECT term, count(*) AS df, string_agg(doc_id::VARCHAR, ' ' ORDER BY doc_id) AS postings FROM ({_ROWS}) GROUP BY term")
def postings_lists(spark, sf_dir):
    return index.posting_lists(index.posting_rows(_docs(spark, sf_dir))).withColumn("postings", F.array_join(F.col("postings").cast("array<string>"), " "))


@query(f"""
WITH d AS (SELECT term, count(*) AS df FROM ({_ROWS}) GROUP BY term)
SELECT term, df, coalesce(sum(4 * df) OVER (ORDER BY term ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", 4 * df AS bytes_len FROM d""")
def dict_offsets(spark, sf_dir):
    return index.dictionary(index.posting_rows(_docs(spark, sf_dir)))


@query(f"""
WITH t AS (SELECT strlen(text) + CASE WHEN text <> '' AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END AS bytes, len({sql_tokens("text", "index")}) AS n FROM documents), r AS ({_ROWS})
SELECT (SELECT count(*) FROM t) AS docs, (SELECT count(DISTINCT term) FROM r) AS unique_terms, (SELECT count(*) FROM r) AS postings, (SELECT sum(bytes)::BIGINT FROM t) AS bytes, (SELECT sum(n)::BIGINT FROM t) AS tokens""")
def index_totals(spark, sf_dir):
    return index.index_totals(_docs(spark, sf_dir))


_ASKED = ["the", "idiot", "nowhere-at-all"]


@query(f"""
WITH r AS ({_ROWS}), asked(term) AS (VALUES {", ".join(f"('{t}')" for t in _ASKED)}), l AS (SELECT term, list(doc_id ORDER BY doc_id) AS ids FROM r SEMI JOIN asked USING (term) GROUP BY term)
SELECT term, coalesce(len(ids), 0)::BIGINT AS df, CASE WHEN ids IS NULL THEN 'NOT FOUND' ELSE array_to_string(ids[1:30], ' ') || CASE WHEN len(ids) > 30 THEN ' ... (' || (len(ids) - 30) || ' more)' ELSE '' END END AS preview
FROM asked LEFT JOIN l USING (term)""")
def term_lookup(spark, sf_dir):
    return index.lookup(index.posting_rows(_docs(spark, sf_dir)), _ASKED)


# Boolean search

BOOLEAN = {
    "bool_term": "the", "bool_and": "the AND idiot", "bool_or": "les OR idiot", "bool_not": "NOT the", "bool_and_not": "the AND NOT of", "bool_paren": "(les OR der) AND -la",
    "bool_precedence": "idiot OR the AND les", "bool_missing": "nowhere-at-all OR NOT nowhere-at-all AND les", "bool_double_not": "NOT NOT THE", "bool_flagship": FLAGSHIP,
}
_HELD = f"SELECT doc_id, list_distinct({sql_tokens('text', 'index')}) AS held FROM documents"


def _hits_sql(q: str) -> str:
    return f"SELECT doc_id FROM ({_HELD}) WHERE {boolean.sql_predicate(boolean.simplified(boolean.parse(q)))}"


def _hits(q: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = _docs(spark, sf_dir)
        return boolean.search_rows(index.posting_rows(docs), docs, q)

    return run


for _name, _q in BOOLEAN.items():
    _QUERIES[_name], _SQL[_name] = _hits(_q), _hits_sql(_q)


@query(_hits_sql(FLAGSHIP))
def bool_scan(spark, sf_dir):
    return flagship(spark, sf_dir).select("doc_id")


_BATCH = list(BOOLEAN.values())


@query("\nUNION ALL ".join(f"SELECT {n}::INTEGER AS query_id, doc_id FROM ({_hits_sql(q)})" for n, q in enumerate(_BATCH)))
def bool_batch(spark, sf_dir):
    return boolean.search_batch(_docs(spark, sf_dir), [*_BATCH, "two terms"])


def _shown(spark, sf_dir):
    return _docs(spark, sf_dir).withColumns({"title": F.concat(F.lit("document "), F.col("doc_id")), "url": F.concat(F.lit("doc:"), F.col("source"), F.lit("/"), F.col("doc_id"))})


@query(f"""
WITH hits AS ({_hits_sql("the AND NOT les")} ORDER BY doc_id LIMIT 20)
SELECT doc_id, coalesce(lang, '?') AS lang, 'document ' || doc_id AS title, 'doc:' || source || '/' || doc_id AS url FROM hits LEFT JOIN documents USING (doc_id)""")
def search_topn_decorated(spark, sf_dir):
    docs = _shown(spark, sf_dir)
    return boolean.top(boolean.search_rows(index.posting_rows(docs), docs, "the AND NOT les"), docs, 20)


# Set operations on postings


def _term_ids(term: str) -> str:
    return f"SELECT doc_id FROM ({_ROWS}) WHERE term = '{term}'"


@query(f"({_term_ids('the')} INTERSECT {_term_ids('of')}) UNION (SELECT doc_id FROM documents EXCEPT {_term_ids('in')})")
def postings_set_ops(spark, sf_dir):
    rows = index.posting_rows(_docs(spark, sf_dir))
    ids = lambda t: rows.where(F.col("term") == t).select("doc_id")
    return ids("the").intersect(ids("of")).union(_docs(spark, sf_dir).select("doc_id").subtract(ids("in"))).distinct()


# Stems


@query(stem.sql_stem_en(f"SELECT DISTINCT term AS token FROM ({_TERMS})"))
def stem_en_vocab(spark, sf_dir):
    return stem.stem_table(frequency.term_counts(_docs(spark, sf_dir)).select(F.col("term").alias("token")), "en")


def _values(words: list[str]) -> str:
    return f"SELECT token FROM (VALUES {', '.join(f'({_quoted(w)})' for w in words)}) v(token)"


@query(stem.sql_stem_ru(_values(RUSSIAN)))
def stem_ru_inline(spark, sf_dir):
    return stem.stem_table(spark.createDataFrame([(w,) for w in RUSSIAN], "token string"), "ru")


@query(f"SELECT token, stem FROM ({stem.sql_stem_ru(_values([w for w in MIXED if not w.isascii()]))}) UNION ALL SELECT token, stem FROM ({stem.sql_stem_en(_values([w for w in MIXED if w.isascii()]))})")
def stem_auto_inline(spark, sf_dir):
    return stem.stem_table(spark.createDataFrame([(w,) for w in MIXED], "token string"))


@query(f"SELECT sum(n)::BIGINT AS tokens_in, sum(CASE WHEN stem <> token THEN n ELSE 0 END)::BIGINT AS changed FROM ({stem.sql_stem_en(f'SELECT term AS token, count(*) AS n FROM ({_TERMS}) GROUP BY term')})")
def stem_change_stats(spark, sf_dir):
    return stem.stem_counts(frequency.token_rows(_docs(spark, sf_dir)))


@query(f"SELECT stem AS term, sum(n)::BIGINT AS count FROM ({stem.sql_stem_en(f'SELECT term AS token, count(*) AS n FROM ({_TERMS}) GROUP BY term')}) GROUP BY stem")
def stemmed_term_freq(spark, sf_dir):
    counts = frequency.term_counts(_docs(spark, sf_dir)).withColumn("stem", stem.stem_en("term"))
    return counts.groupBy(F.col("stem").alias("term")).agg(F.sum("count").alias("count"))


@query(f"SELECT DISTINCT stem AS term, doc_id FROM ({stem.sql_stem_en(f'SELECT term AS token, doc_id FROM ({_ROWS})')})")
def stemmed_postings(spark, sf_dir):
    return index.posting_rows(_docs(spark, sf_dir), stemmed="en")


# Corpora

_WORDED = f"SELECT *, len({sql_tokens('text', 'words')})::BIGINT AS words FROM documents"


def _worded(spark, sf_dir):
    return _docs(spark, sf_dir).withColumn("words", text.word_count("text").cast("bigint"))


@query(f"""
WITH d AS (SELECT lang, text, words, row_number() OVER (PARTITION BY lang ORDER BY words) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM ({_WORDED}))
SELECT lang, count(*) AS docs, round(sum(strlen(text)) / 1048576, 2) AS raw_size_mb, round(sum(strlen(text)) / 1048576, 2) AS text_size_mb, round(sum(strlen(text)) / count(*), 2) AS avg_raw_bytes_per_doc,
  round(sum(strlen(text)) / count(*), 2) AS avg_text_bytes_per_doc, round(avg(words), 2) AS avg_words_per_doc, min(words) AS min_words, max(words) AS max_words, max(words) FILTER (WHERE place = n // 2) AS median_words_per_doc FROM d GROUP BY lang""")
def corpus_stats_by_lang(spark, sf_dir):
    return corpus.statistics(_worded(spark, sf_dir), raw="text")


@query("SELECT count(*) AS docs, round(sum(strlen(text)) / 1048576, 2) AS raw_size_mb, round(sum(strlen(text)) / 1048576, 2) AS text_size_mb FROM documents")
def corpus_stats_total(spark, sf_dir):
    return corpus.totals(_docs(spark, sf_dir), raw="text")


@query(f"SELECT doc_id AS pageid, lang, words::INTEGER AS words FROM ({_WORDED}) WHERE doc_id <> 0 AND trim(text) <> '' AND words >= CASE lang WHEN 'en' THEN 450 ELSE 350 END AND doc_id NOT IN (SELECT doc_id FROM labels)")
def corpus_accept_filter(spark, sf_dir):
    pages = _docs(spark, sf_dir).select(F.col("doc_id").alias("pageid"), "lang", F.col("text").alias("extract"))
    return corpus.accept(pages, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("pageid")), {"en": 450}, 350).select("pageid", "lang", "words")


@query(f"SELECT doc_id AS pageid, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) + 100 AS docid, printf('%05d.txt', row_number() OVER (PARTITION BY lang ORDER BY doc_id) + 100) AS text_file FROM ({_WORDED}) WHERE doc_id <> 0 AND words >= 450")
def corpus_numbering(spark, sf_dir):
    pages = _docs(spark, sf_dir).select(F.col("doc_id").alias("pageid"), "lang", F.col("text").alias("extract"))
    return corpus.number(corpus.accept(pages, min_words={}, default=450), 100).select("pageid", "lang", "docid", file_name(F.col("docid"), "txt").alias("text_file"))


@query("SELECT count(*) AS groups FROM (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)")
def verify_duplicates(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy(F.sha2("text", 256)).count().where("count > 1").agg(F.count("*").alias("groups"))


def _metadata(spark, sf_dir):
    return _docs(spark, sf_dir).select((F.col("doc_id") - F.col("doc_id") % 7 % 2).alias("pageid"), F.concat(F.lit("text/"), F.col("doc_id")).alias("text_file"), F.concat(F.lit("raw/"), F.col("doc_id")).alias("raw_file"))


_CHECKS = """
WITH m AS (SELECT doc_id - doc_id % 7 % 2 AS pageid, doc_id FROM documents), checks AS (
SELECT 'en' AS part, 'text files' AS "check", (SELECT count(*) FROM labels) AS value WHERE (SELECT count(*) FROM labels) <> (SELECT count(*) FROM documents)
UNION ALL SELECT 'en', 'missing refs', (SELECT count(*) FROM documents) - (SELECT count(*) FROM documents SEMI JOIN labels USING (doc_id))
UNION ALL SELECT 'en', 'duplicate pageid groups', (SELECT count(*) FROM (SELECT pageid FROM m GROUP BY pageid HAVING count(*) > 1)))
"""


def _checks(spark, sf_dir):
    there = table(spark, sf_dir, "labels").select(F.concat(F.lit("text/"), F.col("doc_id")).alias("path"))
    raws = _docs(spark, sf_dir).select(F.concat(F.lit("raw/"), F.col("doc_id")).alias("path"))
    return corpus.check("en", _metadata(spark, sf_dir), there, raws)


@query(_CHECKS + "SELECT * FROM checks WHERE value > 0")
def verify_counts(spark, sf_dir):
    return _checks(spark, sf_dir)


@query(_CHECKS + """SELECT CASE WHEN count(*) = 0 THEN 'OK' ELSE 'FAIL' END AS verdict, coalesce(string_agg(part || ' ' || "check" || ' ' || value, '; ' ORDER BY part || ' ' || "check" || ' ' || value), '') AS problems FROM checks WHERE value > 0""")
def verify_verdict(spark, sf_dir):
    return corpus.verdict(_checks(spark, sf_dir))


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def verify_missing_refs(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("SELECT doc_id, lang, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) <= 12")
def lang_sample(spark, sf_dir):
    return corpus.sample(_docs(spark, sf_dir)).select("doc_id", "lang", "n_chars")


@query(f"""
WITH RECURSIVE e(parent, child) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in EDGES)}), walk(category, depth) AS (SELECT 'root', 0 UNION SELECT e.child, w.depth + 1 FROM walk w JOIN e ON e.parent = w.category WHERE w.depth < 3)
SELECT category, min(depth)::INTEGER AS depth FROM walk GROUP BY category""")
def bfs_depth(spark, sf_dir):
    return corpus.walk(spark.createDataFrame(EDGES, "parent string, child string"), spark.createDataFrame([("root",)], "category string"), 3)


@query("""
SELECT 'region ' || r_regionkey AS category, 0::INTEGER AS depth FROM region
UNION ALL SELECT 'nation ' || n_nationkey, 1 FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT 'customer ' || c_custkey, 2 FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""")
def bfs_tables(spark, sf_dir):
    name = lambda kind, c: F.concat(F.lit(f"{kind} "), F.col(c))
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    edges = nation.select(name("region", "n_regionkey").alias("parent"), name("nation", "n_nationkey").alias("child")).union(customer.select(name("nation", "c_nationkey"), name("customer", "c_custkey")))
    return corpus.walk(edges, table(spark, sf_dir, "region").select(name("region", "r_regionkey").alias("category")), 4)


# Crawl

_NORM = r"""
SELECT *, scheme || '://' || CASE scheme WHEN 'http' THEN regexp_replace(host, ':80$', '') WHEN 'https' THEN regexp_replace(host, ':443$', '') ELSE host END || CASE WHEN path = '' THEN '/' ELSE path END ||
  CASE WHEN query = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(query, '&')), '&') END AS norm_url
FROM (SELECT *, lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, lower(regexp_extract(trim(url), '^[^:/?#]+://([^/?#]*)', 1)) AS host,
  regexp_extract(trim(url), '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(trim(url), '\?([^#]*)', 1) AS query FROM pages)"""


@query(f"SELECT page_id, norm_url FROM ({_NORM})")
def url_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.normalize_url("url").alias("norm_url"))


@query(f"SELECT page_id, norm_url FROM ({_NORM})")
def url_normalize_native(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.normalize_plain_url(F.col("url")).alias("norm_url"))


@query("SELECT page_id, sha256(html) AS content_hash FROM pages")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.content_hash(F.col("html")).alias("content_hash"))


@query("SELECT page_id, page_id % 3 = 0 AS changed FROM pages")
def change_detect(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    old = pages.select("page_id", urls.content_hash(F.col("html")).alias("before"))
    new = pages.select("page_id", urls.content_hash(F.when(F.col("page_id") % 3 == 0, F.concat("html", F.lit("!"))).otherwise(F.col("html"))).alias("after"))
    return old.join(new, "page_id").select("page_id", (F.col("before") != F.col("after")).alias("changed"))


#: One page for each address.
_PAGES = f"(SELECT * FROM ({_NORM}) QUALIFY row_number() OVER (PARTITION BY norm_url ORDER BY page_id) = 1)"


def _pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    first = pages.groupBy(urls.normalize_plain_url(F.col("url")).alias("norm_url")).agg(F.min("page_id").alias("page_id"))
    return pages.join(first, "page_id")


def _state(spark, sf_dir):
    """State of all pages in every situation: never fetched, due, waiting, leased."""
    pages = _pages(spark, sf_dir)
    k = F.col("page_id")
    when = lambda test, value: F.when(test, value).cast("bigint")
    known = {
        "norm_url": F.col("norm_url"), "url": F.col("url"), "source": F.lit("en"), "created_at": k % 50, "updated_at": k % 50, "fetched_at": when(k % 2 == 0, k + 1000), "next_refetch_at": when(k % 2 == 0, NOW - 500 + k % 1000),
        "next_retry_at": when(k % 5 == 0, NOW - 100 + k % 200), "fail_count": k % 4, "html": F.when(k % 2 == 0, F.col("html")), "content_hash": F.when(k % 2 == 0, urls.content_hash(F.col("html"))),
        "lock": F.when(k % 11 == 0, F.struct(F.lit("other").alias("owner"), (NOW - 10 + k % 20).alias("until"), k.alias("taken_at"))),
    }
    schema = crawl.empty_state(spark).schema
    return pages.select(*[(known.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in schema])


_STATE_SQL = f"""
state AS (SELECT norm_url, k % 50 AS created_at, CASE WHEN k % 2 = 0 THEN k + 1000 END AS fetched_at, CASE WHEN k % 2 = 0 THEN {NOW} - 500 + k % 1000 END AS next_refetch_at, CASE WHEN k % 5 = 0 THEN {NOW} - 100 + k % 200 END AS next_retry_at, k % 4 AS fail_count,
  CASE WHEN k % 2 = 0 THEN sha256(html) END AS content_hash, CASE WHEN k % 11 = 0 THEN {NOW} - 10 + k % 20 END AS until FROM (SELECT norm_url, page_id AS k, html FROM {_PAGES})),
due AS (SELECT *, CASE WHEN fetched_at IS NULL THEN 'first_fetch' WHEN next_refetch_at <= {NOW} THEN 'refetch' END AS job FROM state WHERE (until IS NULL OR until <= {NOW}) AND (next_retry_at IS NULL OR next_retry_at <= {NOW}))
"""


@query(f"WITH {_STATE_SQL} SELECT norm_url, job FROM due WHERE job IS NOT NULL")
def due_jobs(spark, sf_dir):
    return crawl.due(_state(spark, sf_dir), NOW).select("norm_url", "job")


@query(f"WITH {_STATE_SQL} SELECT norm_url, job, ({NOW} + 600)::BIGINT AS lock_until FROM due WHERE job IS NOT NULL ORDER BY job, CASE job WHEN 'first_fetch' THEN created_at ELSE next_refetch_at END, norm_url LIMIT 10")
def take_jobs(spark, sf_dir):
    return crawl.take(_state(spark, sf_dir), NOW, 10, "me").select("norm_url", "job", F.col("lock.until").alias("lock_until"))


@query(f"""
WITH {_STATE_SQL}, taken AS (SELECT norm_url FROM due WHERE job IS NOT NULL ORDER BY job, CASE job WHEN 'first_fetch' THEN created_at ELSE next_refetch_at END, norm_url LIMIT 10)
SELECT norm_url, CASE WHEN taken.norm_url IS NOT NULL THEN 'me' WHEN until IS NOT NULL THEN 'other' END AS owner, CASE WHEN taken.norm_url IS NOT NULL THEN {NOW} + 600 ELSE until END::BIGINT AS lock_until FROM state LEFT JOIN taken USING (norm_url)""")
def crawl_lease(spark, sf_dir):
    state = _state(spark, sf_dir)
    return crawl.lease(state, crawl.take(state, NOW, 10, "me")).select("norm_url", F.col("lock.owner").alias("owner"), F.col("lock.until").alias("lock_until"))


@query(f"WITH {_STATE_SQL} SELECT norm_url, CASE WHEN until > {NOW} + 5 THEN NULL ELSE until END::BIGINT AS lock_until FROM state")
def crawl_release(spark, sf_dir):
    late = F.col("lock.until") > NOW + 5
    mine = _state(spark, sf_dir).withColumn("lock", F.when(F.coalesce(late, F.lit(False)), F.struct(F.lit("me").alias("owner"), "lock.until", "lock.taken_at")).otherwise(F.col("lock")))
    return crawl.release(mine, "me").select("norm_url", F.col("lock.until").alias("lock_until"))


@query(f"""
WITH {_STATE_SQL}, p AS (SELECT norm_url, page_id AS k, html FROM {_PAGES}),
f AS (SELECT norm_url, k, html, CASE WHEN k % 7 = 2 THEN NULL WHEN k % 7 = 1 THEN 404 WHEN job = 'refetch' AND k % 8 = 0 THEN 304 ELSE 200 END::INTEGER AS status FROM due JOIN p USING (norm_url) WHERE job IS NOT NULL)
SELECT norm_url, status, CASE WHEN status <> 304 THEN sha256(html) END AS body_hash, CASE WHEN k % 7 = 2 THEN 'no response' END AS error FROM f""")
def fetch_recorded(spark, sf_dir):
    k = F.col("page_id")
    kind = F.when(k % 7 == 2, "category").otherwise("page")
    responses = _pages(spark, sf_dir).select(
        kind.alias("kind"), F.col("norm_url").alias("key"), F.when(k % 7 == 1, 404).otherwise(200).alias("status"), F.col("html").alias("body"),
        F.when(k % 8 == 0, "v1").otherwise("v2").alias("etag"), F.lit(None).cast("string").alias("last_modified"),
    )
    state = _state(spark, sf_dir).withColumn("etag", F.when(F.col("fail_count") == 0, "v1"))
    out = crawl.fetched(crawl.due(state, NOW), responses)
    return out.select("norm_url", "status", urls.content_hash(F.col("html")).alias("body_hash"), "error")


@query(f"WITH s AS (SELECT norm_url, page_id AS k FROM {_PAGES}) SELECT norm_url, CASE WHEN k % 3 = 2 THEN {NOW} ELSE k % 50 END::BIGINT AS created_at, {NOW}::BIGINT AS updated_at, CASE WHEN k % 3 = 2 THEN 0 ELSE k % 4 END::INTEGER AS fail_count, k::VARCHAR AS pageid FROM s")
def seed_upsert(spark, sf_dir):
    """Seeds of all pages; a third of them are new to the state."""
    pages = _pages(spark, sf_dir)
    records = pages.select("url", F.col("page_id").alias("pageid"), F.lit("en").alias("lang"))
    known = _state(spark, sf_dir).join(pages.where("page_id % 3 <> 2").select("norm_url"), "norm_url", "left_semi")
    out = crawl.upsert(known, crawl.seeds(records), NOW)
    return out.select("norm_url", "created_at", "updated_at", "fail_count", F.col("meta.pageid").alias("pageid"))


def _results(spark, sf_dir):
    """Outcomes of every kind for the due rows."""
    pages = _pages(spark, sf_dir)
    k = F.col("page_id")
    rows = pages.select(
        "norm_url", F.when(k % 7 == 0, 304).when(k % 7 == 1, 404).when(k % 7 == 2, None).otherwise(200).cast("int").alias("status"),
        F.when(k % 7 > 2, F.when(k % 4 == 0, F.concat("html", F.lit("!"))).otherwise(F.col("html"))).alias("html"), F.lit(None).cast("string").alias("etag"), F.lit(None).cast("string").alias("last_modified"),
        F.when(k % 7 == 2, F.repeat(F.lit("timeout "), 100)).alias("error"),
    )
    return rows.join(crawl.due(_state(spark, sf_dir), NOW).select("norm_url"), "norm_url", "left_semi")


_RESULTS_SQL = f"""
r AS (SELECT norm_url, CASE k % 7 WHEN 0 THEN 304 WHEN 1 THEN 404 WHEN 2 THEN NULL ELSE 200 END AS status, CASE WHEN k % 7 > 2 THEN CASE WHEN k % 4 = 0 THEN sha256(html || '!') ELSE sha256(html) END END AS hash
  FROM (SELECT norm_url, page_id AS k, html FROM {_PAGES}) SEMI JOIN (SELECT norm_url FROM due WHERE job IS NOT NULL) USING (norm_url)),
j AS (SELECT s.*, r.norm_url IS NOT NULL AS there, status, hash, status BETWEEN 200 AND 399 AS good, content_hash IS NOT NULL AND hash = content_hash AS same FROM state s LEFT JOIN r USING (norm_url)),
after AS (SELECT norm_url, CASE WHEN good THEN status END::INTEGER AS status_code, CASE WHEN good AND status <> 304 AND NOT same THEN {NOW} ELSE fetched_at END AS fetched_at,
  CASE WHEN good AND status <> 304 AND NOT same THEN hash ELSE content_hash END AS content_hash, CASE WHEN good THEN {NOW} + 604800 ELSE next_refetch_at END AS next_refetch_at,
  CASE WHEN good THEN NULL WHEN there THEN {NOW} + 900 ELSE next_retry_at END AS next_retry_at, (fail_count + CASE WHEN there AND NOT coalesce(good, false) THEN 1 ELSE 0 END)::INTEGER AS fail_count,
  CASE WHEN there AND status IS NULL THEN left(repeat('timeout ', 100), 500) WHEN there AND NOT good THEN 'HTTP ' || status END AS last_error FROM j)
"""
_AFTER = ["norm_url", "status_code", "fetched_at", "content_hash", "next_refetch_at", "next_retry_at", "fail_count", "last_error"]


@query(f"WITH {_STATE_SQL}, {_RESULTS_SQL} SELECT * FROM after")
def apply_results(spark, sf_dir):
    return crawl.apply_results(_state(spark, sf_dir), _results(spark, sf_dir), NOW).select(*_AFTER)


@query(f"""
WITH {_STATE_SQL}, {_RESULTS_SQL}
SELECT count(*) AS processed, count(*) FILTER (status = 200 AND job = 'first_fetch') AS fetched, count(*) FILTER (status = 200 AND job = 'refetch' AND hash <> content_hash) AS changed,
  count(*) FILTER (status = 304) AS unchanged_304, count(*) FILTER (status IS NULL OR status >= 400) AS errors FROM r JOIN due USING (norm_url)""")
def crawl_counters(spark, sf_dir):
    return crawl.counters(crawl.due(_state(spark, sf_dir), NOW), _results(spark, sf_dir))


# Streams: run to the end of what is there, in a folder that the session shares


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder for a stream's files in the shared folder."""
    return f"{shared_dir(spark)}/lexigrid-{kind}-{uuid.uuid4().hex}"


@query(f"WITH {_STATE_SQL}, {_RESULTS_SQL} SELECT * FROM after")
def crawl_stream_query(spark, sf_dir):
    root = scratch(spark, "crawl")
    _state(spark, sf_dir).write.parquet(crawl_stream.version_path(f"{root}/state", 0))
    _results(spark, sf_dir).withColumn("at", F.lit(NOW).cast("bigint")).write.parquet(f"{root}/results")
    arriving = spark.readStream.schema(crawl_stream.RESULTS).parquet(f"{root}/results")
    crawl_stream.apply_stream(arriving, f"{root}/state", f"{root}/checkpoint").awaitTermination()
    return crawl_stream.read_state(spark, f"{root}/state").select(*_AFTER)


@query(f"SELECT term, count(*) AS df FROM ({_ROWS}) GROUP BY term")
def index_stream_query(spark, sf_dir):
    root = scratch(spark, "index")
    docs = _docs(spark, sf_dir)
    arriving = spark.readStream.schema(docs.schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/documents.parquet*")
    index_stream.append_stream(arriving, f"{root}/rows", f"{root}/checkpoint").awaitTermination()
    return index.document_frequency(index_stream.current(spark, f"{root}/rows"))


for _old, _new in (("crawl_stream_query", "crawl_stream"), ("index_stream_query", "index_stream")):
    _QUERIES[_new], _SQL[_new] = _QUERIES.pop(_old), _SQL.pop(_old)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
