"""URL Column functions.

``parse_url`` of Spark rejects many phishing URLs (``|``, spaces, ``_`` in
hosts), so parts come from the RFC 3986 split regex, with the rules of
Python's ``urlparse`` on top: tab/CR/LF removed, ``;params`` cut from the
last path segment, user info dropped, host lower-cased, bracket checks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import SUSPICIOUS_KEYWORDS, USES_PARAMS_SCHEMES
from .text import blank_to_empty, py_strip

URL_SPLIT = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
IPV4_LIKE = r"^\p{Nd}{1,3}(\.\p{Nd}{1,3}){3}$"
# Accepted inside brackets: an IPv6 literal (optionally with a zone) or IPvFuture.
BRACKET_HOST_OK = r"^(?:[0-9A-Fa-f]{0,4}:){2,7}(?:[0-9A-Fa-f]{0,4}|\d{1,3}(?:\.\d{1,3}){3})(?:%.+)?$|^v[0-9A-Fa-f]+\..+$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_url(x) -> Column:
    """Strip; '' stays ''; prefix ``http://`` unless the URL starts (any
    case) with ``http://``, ``https://`` or ``www.``."""
    u = py_strip(blank_to_empty(x))
    lu = F.lower(u)
    keep = lu.startswith("http://") | lu.startswith("https://") | lu.startswith("www.")
    return F.when(u == "", F.lit("")).when(keep, u).otherwise(F.concat(F.lit("http://"), u))


def url_parts(x) -> dict[str, Column]:
    """Scheme, netloc, path, query, hostname and ``error`` of a URL."""
    u = F.regexp_replace(F.regexp_replace(blank_to_empty(x), r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    scheme = F.lower(F.regexp_extract(u, URL_SPLIT, 1))
    netloc = F.regexp_extract(u, URL_SPLIT, 2)
    raw_path = F.regexp_extract(u, URL_SPLIT, 3)
    query = F.regexp_extract(u, URL_SPLIT, 4)
    path = F.when(
        scheme.isin(*USES_PARAMS_SCHEMES), F.regexp_replace(raw_path, ";[^/]*$", "")
    ).otherwise(raw_path)
    hostinfo = F.regexp_replace(netloc, "^.*@", "")
    has_open = hostinfo.contains("[")
    bracketed = F.regexp_extract(hostinfo, r"\[([^\]]*)", 1)
    host = F.lower(F.when(has_open, bracketed).otherwise(F.regexp_extract(hostinfo, "^([^:]*)", 1)))
    unbalanced = netloc.contains("[") != netloc.contains("]")
    bad_bracket = has_open & ~bracketed.rlike(BRACKET_HOST_OK)
    error = F.when(unbalanced | bad_bracket, F.lit("ValueError('Invalid IPv6 URL')"))
    return {"scheme": scheme, "netloc": netloc, "path": path, "query": query, "host": host, "error": error}


def apex(host) -> Column:
    """Last two dot labels of the lower-cased host (fewer: the host)."""
    return F.substring_index(F.lower(blank_to_empty(host)), ".", -2)


def is_ip_host(host) -> Column:
    """U4: contains ':' or looks like a dotted quad (no 0-255 check)."""
    h = blank_to_empty(host)
    return (h != "") & (h.contains(":") | h.rlike(IPV4_LIKE))


def keyword_count(x, keywords=SUSPICIOUS_KEYWORDS) -> Column:
    """Number of distinct keywords present as substrings."""
    t = blank_to_empty(x)
    total = None
    for k in keywords:
        term = t.contains(F.lit(k)).cast("bigint")
        total = term if total is None else total + term
    return total if total is not None else F.lit(0).cast("bigint")


PART_COLUMNS = ["scheme", "netloc", "path", "query", "host", "error"]


def with_url_parts(df, url_col: str = "url", prefix: str = "_u_"):
    """Stage U2 in its own projection: ``<prefix><part>`` columns, computed
    once per row and shared by the features and the mask."""
    p = url_parts(F.col(url_col))
    return df.select("*", *[p[k].alias(prefix + k) for k in PART_COLUMNS])


def _parts_of(prefix: str) -> dict[str, Column]:
    return {k: F.col(prefix + k) for k in PART_COLUMNS}


def url_features(u, keywords=SUSPICIOUS_KEYWORDS, parts: dict[str, Column] | None = None) -> dict[str, Column]:
    """The 14 URL features of a normalised URL, plus ``error``.

    On a URL that does not parse (the reference would stop there) the
    features are 0 / '' and ``error`` says why. Pass ``parts`` (from
    ``with_url_parts``) to reuse a staged parse.
    """
    u = blank_to_empty(u)
    p = parts or url_parts(u)
    host = p["host"]
    pathq = F.concat(p["path"], F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise(F.lit("")))
    digits = F.regexp_count(host, F.lit(r"\p{Nd}"))
    alnum = F.regexp_count(host, F.lit(r"[\p{Nd}\p{L}]"))
    labels = F.regexp_count(host, F.lit(r"[^.]+"))
    ok = p["error"].isNull()

    def g(c: Column) -> Column:
        return F.when(ok, c.cast("bigint")).otherwise(F.lit(0).cast("bigint"))

    return {
        "host": F.when(ok, host).otherwise(F.lit("")),
        "apex": F.when(ok, apex(host)).otherwise(F.lit("")),
        "uses_https": g((p["scheme"] == "https")),
        "has_ip_host": g(is_ip_host(host)),
        "has_punycode": g(host.rlike(r"(^|\.)xn--")),
        "at_symbol": g(u.contains("@")),
        "subdomain_count": g(F.greatest(labels - 2, F.lit(0))),
        "hyphen_count": g((F.length(host) - F.length(F.replace(host, F.lit("-"), F.lit(""))))),
        "digit_ratio_host": F.when(ok, F.bround(digits / F.greatest(alnum, F.lit(1)), 3)).otherwise(F.lit(0.0))
        .cast("double"),
        "url_length": g(F.length(u)),
        "path_length": g(F.length(p["path"])),
        "query_length": g(F.length(p["query"])),
        "sus_kw_host": g(keyword_count(host, keywords)),
        "sus_kw_path": g(keyword_count(pathq, keywords)),
        "error": p["error"],
    }


def mask_url(x, parts: dict[str, Column] | None = None) -> Column:
    """``apex:/first-path-segment`` (``apex:/`` without one);
    ``[redacted]`` when the URL does not parse."""
    p = parts or url_parts(x)
    path = py_strip(p["path"])
    seg1 = F.try_element_at(F.split(path, "/"), F.lit(2))
    first = F.when(
        (path != "") & (path != "/") & seg1.isNotNull() & (seg1 != ""), F.concat(F.lit("/"), seg1)
    ).otherwise(F.lit("/"))
    return F.when(p["error"].isNotNull(), F.lit("[redacted]")).otherwise(
        F.concat(apex(p["host"]), F.lit(":"), first)
    )
