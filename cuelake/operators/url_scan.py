"""URL scan: URL list (S5), apex de-duplication (D-1), sampling (L3) with
row numbers (W4), the stored-crawl join (J2/S7), page text (T11), text
source choice (C5), URL features (U1-U7) and merged cue totals (C4).

Scale notes: de-duplication is one ``groupBy(apex)`` with an algebraic
``min(struct)`` (map-side combine, a hot apex costs nothing); sampling is a
distributed top-k (TakeOrderedAndProject); with a limit the crawl side is
semi-joined against the sample (broadcast up to ``SMALL_SAMPLE`` rows)
before the left join, so a 100 TB crawl is never shuffled for 50 URLs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.cues import add_category_totals
from ..functions.lexicon import DEFAULT_LEXICON, DEFAULT_URL_SEED, Lexicon
from ..functions.pages import page_text
from ..plans.indexing import dense_index

FEATURES = [
    "host", "apex", "uses_https", "has_ip_host", "has_punycode", "at_symbol",
    "subdomain_count", "hyphen_count", "digit_ratio_host", "url_length", "path_length",
    "query_length", "sus_kw_host", "sus_kw_path",
]


def url_table(df: DataFrame, url_col: str = "url", order_col: str = "row_idx") -> DataFrame:
    """(row_idx, url) with every value through U1 and empties dropped."""
    return (
        df.select(F.col(order_col).alias("row_idx"), U.normalize_url(F.col(url_col)).alias("url"))
        .where(F.col("url") != "")
    )


def with_features(urls: DataFrame, url_col: str = "url", mask: bool = False) -> DataFrame:
    """Add the 14 U5 features, ``parse_error`` and optionally ``url_masked``;
    the URL is parsed once in a preceding projection."""
    staged = U.with_url_parts(urls, url_col, "_u_")
    parts = {k: F.col("_u_" + k) for k in U.PART_COLUMNS}
    f = U.url_features(F.col(url_col), parts=parts)
    extra = [U.mask_url(None, parts=parts).alias("url_masked")] if mask else []
    return staged.select(*urls.columns, *[f[k].alias(k) for k in FEATURES], f["error"].alias("parse_error"), *extra)


def dedupe_by_apex(urls: DataFrame, mode: str = "apex") -> DataFrame:
    """D-1: the first URL (by row_idx) of every apex; host-less URLs share
    apex ''. A URL that does not parse is kept as its own group."""
    if (mode or "none").lower() != "apex":
        return urls
    p = U.url_parts(F.col("url"))
    key = F.when(p["error"].isNull(), U.apex(p["host"])).otherwise(
        F.concat(F.lit("\u0000err:"), F.col("row_idx").cast("string"))
    )
    first = urls.groupBy(key.alias("_apex")).agg(F.min(F.struct("row_idx", "url")).alias("_first"))
    return first.select("_first.row_idx", "_first.url")


def sample_urls(urls: DataFrame, limit: int | None = None, random_pick: bool = True,
                seed: int = DEFAULT_URL_SEED) -> DataFrame:
    """L3 + W4: up to ``limit`` URLs with their 1-based number ``n``.

    ``limit`` falsy or >= the number of URLs: all URLs in row order.
    Otherwise the first ``limit`` by row order, or by the seeded hash order.
    """
    if not limit:
        return dense_index(urls, "row_idx", "n")
    total = urls.select(F.count(F.lit(1))).scalar()
    hash_key = F.md5(F.concat(F.lit(str(seed)), F.lit(":"), F.col("url")))
    use_hash = F.lit(bool(random_pick)) & (total > F.lit(limit))
    keyed = urls.select("row_idx", "url", F.when(use_hash, hash_key).otherwise(F.lit("")).alias("_k"))
    picked = keyed.orderBy("_k", "row_idx").limit(int(limit))
    if limit > SMALL_SAMPLE:
        return dense_index(picked.withColumn("_o", F.struct("_k", "row_idx")), "_o", "n").select("n", "row_idx", "url")
    w = Window.orderBy("_k", "row_idx")
    return picked.select(F.row_number().over(w).cast("bigint").alias("n"), "row_idx", "url")


def crawl_table(pages: DataFrame) -> DataFrame:
    """A stored crawl with defaults for missing metadata columns."""
    cols = set(pages.columns)

    def opt(name, default, dtype):
        return (F.col(name).cast(dtype) if name in cols else F.lit(default).cast(dtype)).alias(name)

    return pages.select(
        "url",
        opt("status", 200, "bigint"),
        opt("redirects", 0, "bigint"),
        (F.coalesce(F.col("final_url"), F.col("url")) if "final_url" in cols else F.col("url")).alias("final_url"),
        opt("content_type", "text/html", "string"),
        opt("error", "", "string"),
        F.col("html").cast("string").alias("html"),
    )


#: Sampled URLs up to this number are broadcast and numbered in one task.
SMALL_SAMPLE = 10_000


def attach_pages(urls: DataFrame, crawl: DataFrame | None, fetch: str = "get",
                 limit: int | None = None) -> DataFrame:
    """URL rows left-joined to their stored page (first row per URL).

    Only pages of listed URLs go on: with a ``limit`` of at most
    ``SMALL_SAMPLE`` URLs these are broadcast into the crawl's scan. The first
    page of a URL is picked by a window limit (before the shuffle as well) on
    the narrow columns; HTML is in no aggregate and moves once at most, as
    semi-join, window and left join share one partitioning.

    Adds status, redirects, final_url, error and page text (T11; only for
    'get' and an html content type). ``fetch='off'`` joins nothing.
    """
    fetch = (fetch or "get").lower()
    if fetch in ("off", "0", "false") or crawl is None:
        return urls.select(
            "*",
            F.lit("").alias("status"),
            F.lit(0).cast("bigint").alias("redirects"),
            F.lit("").alias("final_url"),
            F.lit("skipped (offline)").alias("fetch_error"),
            F.lit("").alias("page_text"),
        )
    c = crawl_table(crawl)
    listed = urls.select("url").distinct()
    c = c.join(F.broadcast(listed) if limit and limit <= SMALL_SAMPLE else listed, "url", "left_semi")
    # Ties of final_url go by the other columns, so the order of rows doesn't matter.
    rest = [x for x in c.columns if x not in ("url", "html")]
    first = Window.partitionBy("url").orderBy(*rest, F.md5(F.coalesce("html", F.lit("")).cast("binary")))
    one = (c.withColumn("_rank", F.row_number().over(first)).where("_rank = 1")
           .select("url", F.struct(*rest, "html").alias("pg")))
    j = urls.join(one, "url", "left")
    is_html = F.lower(F.coalesce(F.col("pg.content_type"), F.lit(""))).contains("text/html")
    text = page_text(F.col("pg.html"), F.col("pg.final_url")) if fetch == "get" else F.lit("")
    found = F.col("pg").isNotNull()
    return j.select(
        *urls.columns,
        F.when(found, F.coalesce(F.col("pg.status").cast("string"), F.lit(""))).otherwise(F.lit("")).alias("status"),
        F.when(found, F.col("pg.redirects")).otherwise(F.lit(0).cast("bigint")).alias("redirects"),
        F.when(found, F.col("pg.final_url")).otherwise(F.lit("")).alias("final_url"),
        F.when(found, F.coalesce(F.col("pg.error"), F.lit("")))
        .otherwise(F.lit("ConnectionError('not in stored crawl')")).alias("fetch_error"),
        F.when(found & is_html, F.coalesce(text, F.lit(""))).otherwise(F.lit("")).alias("page_text"),
    )


def score_urls(fetched: DataFrame, lexicon: Lexicon = DEFAULT_LEXICON) -> DataFrame:
    """U5/U7 + C5 + C4 on fetched URL rows: one redacted output row each."""
    feats = with_features(fetched, mask=True)
    fin = U.with_url_parts(feats, "final_url", "_f_")
    fin_parts = {k: F.col("_f_" + k) for k in U.PART_COLUMNS}
    feats = fin.select(
        *feats.columns,
        F.when(F.col("final_url") != "", U.mask_url(None, parts=fin_parts)).otherwise(F.lit("")).alias("final_url_masked"),
    )
    src = feats.select(
        "*", F.when(F.col("page_text") != "", F.col("page_text")).otherwise(F.col("url")).alias("_src")
    )
    scored = add_category_totals(src, "_src", lexicon, merged=True)
    error = F.coalesce(F.col("parse_error"), F.col("fetch_error"), F.lit(""))
    lead = ["n"] if "n" in fetched.columns else []
    return scored.select(
        *lead,
        "row_idx",
        "url_masked",
        "final_url_masked",
        "status",
        "redirects",
        error.alias("error"),
        *FEATURES,
        *lexicon.sum_columns(),
    )


def url_scan(url_rows: DataFrame, crawl: DataFrame | None, limit: int | None = None,
             random_pick: bool = True, seed: int = DEFAULT_URL_SEED, dedupe: str = "apex",
             fetch: str = "get", lexicon: Lexicon = DEFAULT_LEXICON) -> DataFrame:
    """The whole URL job over (row_idx, url) rows of a URL list (after S5)."""
    picked = sample_urls(dedupe_by_apex(url_rows, dedupe), limit, random_pick, seed)
    fetched = attach_pages(picked, crawl, fetch, limit)
    return score_urls(fetched, lexicon)
