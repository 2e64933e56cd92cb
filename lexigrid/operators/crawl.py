"""Crawl state as a table keyed by norm_url: seed upserts, due work, outcomes of fetches, counters. `now` is always given."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import content_hash, normalize_url, source_name


@dataclass(frozen=True)
class CrawlConfig:
    """Waits in seconds. Defaults are fixed values."""

    delay_sec: float = 0.3
    timeout_sec: float = 20
    lock_ttl_sec: int = 600
    refetch_after_sec: int = 7 * 24 * 3600
    retry_after_sec: int = 900
    metadata_paths: list[str] = field(default_factory=list)

    @staticmethod
    def read(path: str) -> CrawlConfig:
        """From a YAML file with sections `logic` and `seeds`; what isn't set keeps its default."""
        import yaml

        with open(path, encoding="utf-8") as f:
            given = yaml.safe_load(f) or {}
        logic = {k: v for k, v in (given.get("logic") or {}).items() if k in CrawlConfig.__dataclass_fields__}
        return CrawlConfig(**logic, metadata_paths=list((given.get("seeds") or {}).get("metadata_paths") or []))


META = "struct<lang:string,docid:string,pageid:string,title:string>"
STATE = (
    f"norm_url string, url string, source string, meta {META}, created_at bigint, updated_at bigint, fetched_at bigint, last_checked_at bigint, "
    "next_refetch_at bigint, next_retry_at bigint, status_code int, fail_count int, last_error string, etag string, last_modified string, "
    "html string, content_hash string, changed boolean, lock struct<owner:string,until:bigint,taken_at:bigint>"
)


def empty_state(spark) -> DataFrame:
    return spark.createDataFrame([], STATE)


def seeds(records: DataFrame, path: str = "", url_column: Column | None = None) -> DataFrame:
    """norm_url, source, meta of metadata records with a url; of records with one norm_url the greatest meta stands.

    url_column: another expression for the normalised url, to stay out of Python.
    """
    valid = records.where(F.length(F.trim("url")) > 0)
    text = lambda c: (F.col(c) if c in records.columns else F.lit(None)).cast("string").alias(c)
    rows = valid.select((normalize_url("url") if url_column is None else url_column).alias("norm_url"), source_name(text("lang"), F.lit(path)).alias("source"), F.struct(*[text(c) for c in ("lang", "docid", "pageid", "title")]).alias("meta"))
    return rows.groupBy("norm_url").agg(F.max(F.struct("meta", "source")).alias("m")).select("norm_url", "m.source", "m.meta")


def upsert(state: DataFrame, found: DataFrame, now: int) -> DataFrame:
    """State with the seeds: new ones are put in, known ones get their meta and updated_at, and nothing else."""
    s, f = state.alias("s"), found.withColumnRenamed("norm_url", "key").alias("f")
    joined = s.join(f, F.col("s.norm_url") == F.col("f.key"), "full_outer")
    new, given = F.col("s.norm_url").isNull(), F.col("f.key").isNotNull()
    at = F.lit(now).cast("bigint")
    made = {"norm_url": F.col("f.key"), "url": F.col("f.key"), "source": F.col("f.source"), "created_at": at, "fail_count": F.lit(0)}
    columns = [F.when(new, made[c]).otherwise(F.col(f"s.{c}")) if c in made else F.when(given, F.col("f.meta").cast(META)).otherwise(F.col("s.meta")) if c == "meta" else F.when(given, at).otherwise(F.col("s.updated_at")) if c == "updated_at" else F.col(f"s.{c}") for c in state.columns]
    return joined.select(*[x.alias(c) for x, c in zip(columns, state.columns, strict=True)])


def unlocked(now: Column) -> Column:
    return F.col("lock.until").isNull() | (F.col("lock.until") <= now)


def retry_due(now: Column) -> Column:
    """No retry is set, or its time has come."""
    return F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now)


def due(state: DataFrame, now: int) -> DataFrame:
    """The rows that are due, with `job`: first_fetch, or refetch."""
    at = F.lit(now).cast("bigint")
    ready = unlocked(at) & retry_due(at)
    job = F.when(ready & F.col("fetched_at").isNull(), "first_fetch").when(ready & (F.col("next_refetch_at") <= at), "refetch")
    return state.withColumn("job", job).where("job is not null")


def take(state: DataFrame, now: int, n: int, owner: str, config: CrawlConfig | None = None) -> DataFrame:
    """The next n due rows, first fetches by created_at before refetches by next_refetch_at, each with its lease set."""
    lease = F.struct(F.lit(owner).alias("owner"), F.lit(now + (config or CrawlConfig()).lock_ttl_sec).cast("bigint").alias("until"), F.lit(now).cast("bigint").alias("taken_at"))
    key = F.when(F.col("job") == "first_fetch", F.col("created_at")).otherwise(F.col("next_refetch_at"))
    return due(state, now).orderBy("job", key, "norm_url").limit(n).withColumn("lock", lease)


def lease(state: DataFrame, taken: DataFrame) -> DataFrame:
    """State with the leases of the rows that take() gave."""
    rows = state.join(taken.select("norm_url", F.col("lock").alias("_lease")), "norm_url", "left")
    return rows.withColumn("lock", F.coalesce("_lease", "lock")).select(*state.columns)


def release(state: DataFrame, owner: str) -> DataFrame:
    """State without the owner's leases, so what it took is due again."""
    mine = F.coalesce(F.col("lock.owner") == owner, F.lit(False))
    return state.withColumn("lock", F.when(~mine, F.col("lock")))


def fetched(jobs: DataFrame, responses: DataFrame) -> DataFrame:
    """What apply_results() takes, from recorded responses (sources/recorded.py) to the jobs of due() or take().

    A refetch whose etag, or last_modified if it has none, is the response's gives 304 without a body; a job without a
    response of kind `page` is an error; of several responses to one address the greatest stands.
    """
    r = responses.where("kind = 'page'").groupBy(F.col("key").alias("norm_url")).agg(F.max(F.struct("status", "body", "etag", "last_modified")).alias("r"))
    rows = jobs.select("norm_url", "job", "etag", "last_modified").join(r, "norm_url", "left")
    equal = F.when(F.col("etag").isNotNull(), F.col("etag") == F.col("r.etag")).otherwise(F.col("last_modified") == F.col("r.last_modified"))
    same = (F.col("job") == "refetch") & (F.col("r.status") == 200) & F.coalesce(equal, F.lit(False))
    same = F.coalesce(same, F.lit(False))
    return rows.select(
        "norm_url", F.when(same, 304).otherwise(F.col("r.status")).cast("int").alias("status"), F.when(~same, F.col("r.body")).alias("html"),
        F.col("r.etag").alias("etag"), F.col("r.last_modified").alias("last_modified"), F.when(F.col("r").isNull(), "no response").alias("error"),
    )


def outcome(status: Column, error: Column) -> Column:
    """unchanged, success or error."""
    return F.when(error.isNotNull(), "error").when(status == 304, "unchanged").when(status.between(200, 399), "success").otherwise("error")


def apply_results(state: DataFrame, results: DataFrame, now: int, config: CrawlConfig | None = None, owner: str | None = None) -> DataFrame:
    """State after fetches. results: norm_url (once), status, html, etag, last_modified, error.

    A refetch with equal content keeps body, hash and fetched_at. owner: apply only where the lease is this owner's.
    """
    c = config or CrawlConfig()
    r = results.select("norm_url", *[F.col(x).alias(f"r_{x}") for x in ("status", "html", "etag", "last_modified", "error")])
    rows = state.join(r, "norm_url", "left").withColumn("_there", F.col("r_status").isNotNull() | F.col("r_error").isNotNull())
    if owner is not None:
        rows = rows.withColumn("_there", F.col("_there") & F.coalesce(F.col("lock.owner") == owner, F.lit(False)))
    kind, at = outcome(F.col("r_status"), F.col("r_error")), F.lit(now).cast("bigint")
    rows = rows.withColumn("_kind", F.when(F.col("_there"), kind))
    ok, bad = F.col("_kind").isin("success", "unchanged"), F.col("_kind") == "error"
    new_hash = content_hash(F.col("r_html"))
    changed = F.when(F.col("content_hash").isNull(), F.lit(None).cast("boolean")).otherwise(new_hash != F.col("content_hash"))
    same = F.col("fetched_at").isNotNull() & F.coalesce(~changed, F.lit(False))
    store = (F.col("_kind") == "success") & F.col("r_html").isNotNull() & ~same
    error = F.coalesce(F.col("r_error"), F.concat(F.lit("HTTP "), F.coalesce(F.col("r_status"), F.lit(0)).cast("string")))
    pick = lambda test, value, name: F.when(test, value).otherwise(F.col(name))
    new = {
        "status_code": pick(ok, F.col("r_status"), "status_code"), "last_checked_at": pick(ok, at, "last_checked_at"), "next_refetch_at": pick(ok, at + c.refetch_after_sec, "next_refetch_at"),
        "updated_at": pick(ok | bad, at, "updated_at"), "last_error": F.when(ok, F.lit(None)).when(bad, F.left(error, F.lit(500))).otherwise(F.col("last_error")),
        "next_retry_at": F.when(ok, F.lit(None)).when(bad, at + c.retry_after_sec).otherwise(F.col("next_retry_at")), "fail_count": F.when(bad, F.col("fail_count") + 1).otherwise(F.col("fail_count")),
        "etag": pick(ok & F.col("r_etag").isNotNull(), F.col("r_etag"), "etag"), "last_modified": pick(ok & F.col("r_last_modified").isNotNull(), F.col("r_last_modified"), "last_modified"),
        "html": pick(store, F.col("r_html"), "html"), "content_hash": pick(store, new_hash, "content_hash"), "fetched_at": pick(store, at, "fetched_at"), "changed": pick(store, changed, "changed"),
        "lock": F.when(ok | bad, F.lit(None)).otherwise(F.col("lock")),
    }
    return rows.select(*[(new[x] if x in new else F.col(x)).cast(state.schema[x].dataType).alias(x) for x in state.columns])


def counters(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """One row: processed, fetched, changed, unchanged_304, errors. jobs: norm_url, job, content_hash before the fetch."""
    rows = jobs.select("norm_url", "job", "content_hash").join(results, "norm_url").withColumn("kind", outcome(F.col("status"), F.col("error")))
    success = F.col("kind") == "success"
    differs = F.coalesce(content_hash(F.col("html")) != F.col("content_hash"), F.lit(False))
    return rows.agg(F.count("*").alias("processed"), F.count_if(success & (F.col("job") == "first_fetch")).alias("fetched"), F.count_if(success & (F.col("job") == "refetch") & differs).alias("changed"), F.count_if(F.col("kind") == "unchanged").alias("unchanged_304"), F.count_if(F.col("kind") == "error").alias("errors"))
