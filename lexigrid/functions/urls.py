"""URL normalisation: an Arrow UDF over the standard library for any input, and JVM-side helpers."""

from __future__ import annotations

from urllib.parse import parse_qsl, quote, unquote, urlencode, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Characters that a path keeps as they are. Fixed value.
PATH_SAFE = "/:@-._~!$&'()*+,;="
DEFAULT_PORTS = {"http": "80", "https": "443"}


def normalized(url: str | None) -> str | None:
    """One spelling for equal addresses: lower-case scheme and host, no default port or fragment, sorted query, requoted path.

    null stays null and blank is empty; a missing scheme is http, so `example.com/a`, which has no host, becomes `http:example.com/a`.
    """
    if url is None or not url.strip():
        return None if url is None else ""
    parts = urlsplit(url.strip())
    scheme, host = (parts.scheme or "http").lower(), parts.netloc.lower()
    name, colon, port = host.rpartition(":")
    if colon and DEFAULT_PORTS.get(scheme) == port:
        host = name
    path = "".join(quote(unquote(x), safe=PATH_SAFE) for x in _without_params(parts.path or "/"))
    query = urlencode(sorted(parse_qsl(parts.query, keep_blank_values=True)))
    return f"{scheme}:{'//' + host if host else ''}{path}{'?' + query if query else ''}"


def _without_params(path: str) -> tuple[str, str]:
    """The path and the `;params` of its last segment, which are quoted by themselves."""
    head, slash, last = path.rpartition("/")
    name, semicolon, params = last.partition(";")
    return head + slash + name, semicolon + params if params else ""


@F.pandas_udf(StringType())
def normalize_url(urls: pd.Series) -> pd.Series:
    return urls.map(lambda x: normalized(x) if isinstance(x, str) else None)


def normalize_plain_url(url: Column) -> Column:
    """The same without Python, for addresses with scheme and host whose path and query need no quoting."""
    t = F.trim(url)
    scheme = F.lower(F.regexp_extract(t, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(t, r"^[^:/?#]+://([^/?#]*)", 1))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.regexp_extract(t, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    query = F.array_join(F.sort_array(F.filter(F.split(F.regexp_extract(t, r"\?([^#]*)", 1), "&"), lambda x: x != "")), "&")
    return F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def content_hash(text: Column) -> Column:
    """SHA-256 of the UTF-8 text, in hexadecimal."""
    return F.sha2(text, 256)


def source_name(lang: Column, path: Column) -> Column:
    """The record's language, else the last part of the path that names a corpus, else `unknown`."""
    parts = F.filter(F.transform(F.split(path, "/"), F.lower), lambda x: x.isin("enwiki", "ruwiki", "en", "ru"))
    return F.coalesce(F.when(F.length(lang) > 0, F.lower(F.trim(lang))), F.try_element_at(parts, F.lit(-1)), F.lit("unknown"))
