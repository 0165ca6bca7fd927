"""Registered queries: one Spark builder and one DuckDB oracle SQL per name.

Each builder takes (spark, sf_dir) and returns a DataFrame over the whole
driver tables (or views Spark derives from them, see ``derived``). Column
names and types match the oracle's (BIGINT / DOUBLE / VARCHAR).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.cues import add_category_totals, phrase_counts_long
from ..functions.lexicon import DEFAULT_LEXICON, EXTRA_COLUMNS
from ..operators.mail import decode_mime
from . import derived as D
from . import oracle as O

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}

LEX = DEFAULT_LEXICON
SUMS = LEX.sum_columns()


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def _sum_select_sql(text_expr: str, merged: bool) -> list[str]:
    raw = O.category_sums(O.doubled(O.fold(text_expr)), alias=False)
    if not merged:
        return [f"{r} AS {s}" for r, s in zip(raw, SUMS)]
    norm = O.category_sums(O.doubled(O.normalize_text(text_expr)), alias=False)
    return [f"CAST({r} + {n} AS BIGINT) AS {s}" for r, n, s in zip(raw, norm, SUMS)]


# --- C1/C2: phrase counts, long form -----------------------------------------
def _phrase_unnest_sql(doubled_text: str) -> str:
    items = ", ".join(
        f"{{'category': {O.q(c)}, 'phrase': {O.q(p)}, 'n': CAST({O.phrase_count(doubled_text, p)} AS BIGINT)}}"
        for c, _, p, _ in LEX.rows()
    )
    return f"unnest([{items}], recursive := true)"


@register("cue_phrase_counts", f"""
WITH {D.SALTED_DOCUMENTS_SQL},
dd AS (SELECT doc_id, {O.doubled(O.fold('text'))} AS t FROM salted),
lc AS (SELECT doc_id, {_phrase_unnest_sql('t')} FROM dd)
SELECT doc_id, category, phrase, n FROM lc WHERE n > 0
""")
def cue_phrase_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = D.salted_documents(spark, sf_dir)
    return phrase_counts_long(docs, ["doc_id"], "text", LEX, merged=False)


# --- C3: category totals, raw pass -------------------------------------------
@register("cue_totals_raw", f"""
WITH {D.SALTED_DOCUMENTS_SQL}
SELECT doc_id, {', '.join(_sum_select_sql('text', merged=False))} FROM salted
""")
def cue_totals_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = D.salted_documents(spark, sf_dir).select("doc_id", "text")
    return add_category_totals(docs, "text", LEX, merged=False).drop("text")


# --- C4: raw + normalised passes ---------------------------------------------
@register("cue_totals_merged", f"""
WITH {D.SALTED_DOCUMENTS_SQL}
SELECT doc_id, {', '.join(_sum_select_sql('text', merged=True))} FROM salted
""")
def cue_totals_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = D.salted_documents(spark, sf_dir).select("doc_id", "text")
    return add_category_totals(docs, "text", LEX, merged=True).drop("text")


# --- T4 / T9 / T10 -------------------------------------------------------------
@register("text_heuristics", f"""
WITH {D.SALTED_DOCUMENTS_SQL},
d AS (SELECT doc_id, text, {O.deobfuscate('text')} AS t FROM salted)
SELECT doc_id, CAST(length(text) AS BIGINT) AS text_len, {', '.join(O.heuristics('t'))} FROM d
""")
def text_heuristics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = D.salted_documents(spark, sf_dir)
    staged = docs.select("doc_id", "text", T.deobfuscate(F.col("text")).alias("t"))
    h = T.heuristics(F.col("t"))
    return staged.select("doc_id", T.text_length(F.col("text")).alias("text_len"), *[h[k].alias(k) for k in EXTRA_COLUMNS])


@register("deobfuscate", f"""
WITH {D.SALTED_DOCUMENTS_SQL}
SELECT doc_id, {O.deobfuscate('text')} AS text FROM salted
""")
def deobfuscate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = D.salted_documents(spark, sf_dir)
    return docs.select("doc_id", T.deobfuscate(F.col("text")).alias("text"))


# --- T2 ------------------------------------------------------------------------
@register("normalize_text", f"""
SELECT doc_id, {O.normalize_text('text')} AS norm FROM documents
""")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = D.table(spark, sf_dir, "documents")
    return d.select("doc_id", T.normalize_text(F.col("text")).alias("norm"))


# --- T1 ------------------------------------------------------------------------
@register("html_text", f"""
SELECT page_id, {O.html_to_text('html')} AS text FROM pages
""")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.table(spark, sf_dir, "pages")
    return p.select("page_id", T.html_to_text(F.col("html")).alias("text"))


# --- T5 ------------------------------------------------------------------------
_CONTACT = "' Contact: Bob <bob.' || CAST(doc_id AS VARCHAR) || '+x@mail.example.co.uk>, a@b'"


@register("redact_contacts", f"""
SELECT doc_id, {O.redact_emails('text || ' + _CONTACT)} AS text FROM documents
""")
def redact_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = D.table(spark, sf_dir, "documents")
    t = F.concat(F.col("text"), F.lit(" Contact: Bob <bob."), F.col("doc_id").cast("string"),
                 F.lit("+x@mail.example.co.uk>, a@b"))
    return d.select("doc_id", T.redact_emails(t).alias("text"))


# --- URLs: U1-U6, U7, D-1 + L3 + W4 ---------------------------------------------
from ..operators import url_scan as US  # noqa: E402
from ..functions import urls as UF  # noqa: E402

_URLS_NORM_SQL = f"""urls AS (
  SELECT url_id AS row_idx, {O.normalize_url('url')} AS url FROM url_list
)"""
_URLS_PARSED_SQL = f"""parsed AS ({O.url_stage_sql("(SELECT * FROM urls WHERE url <> '')", 'row_idx')})"""


def _url_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return US.url_table(D.url_list(spark, sf_dir), "url", "url_id")


@register("url_features", f"""
WITH {D.URL_LIST_SQL}, {_URLS_NORM_SQL}, {_URLS_PARSED_SQL}
SELECT row_idx, url, {', '.join(O.url_feature_list())}, coalesce(error, '') AS error FROM parsed
""")
def url_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats = US.with_features(_url_rows(spark, sf_dir))
    return feats.withColumn("error", F.coalesce(F.col("parse_error"), F.lit(""))).drop("parse_error")


@register("url_mask", f"""
WITH {D.URL_LIST_SQL}, {_URLS_NORM_SQL}, {_URLS_PARSED_SQL}
SELECT row_idx, {O.mask_expr()} AS url_masked FROM parsed
""")
def url_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _url_rows(spark, sf_dir).select("row_idx", UF.mask_url(F.col("url")).alias("url_masked"))


_DEDUPE_SQL = f"""dedup AS (
  SELECT min_by(url, row_idx) AS url, min(row_idx) AS row_idx FROM (
    SELECT row_idx, url, CASE WHEN error IS NULL THEN {O.apex('host')} ELSE chr(0) || 'err:' || CAST(row_idx AS VARCHAR) END AS k
    FROM parsed) GROUP BY k
)"""

URL_SAMPLE_LIMIT = 50
URL_SAMPLE_SEED = 2025


@register("url_dedupe_sample", f"""
WITH {D.URL_LIST_SQL}, {_URLS_NORM_SQL}, {_URLS_PARSED_SQL}, {_DEDUPE_SQL},
keyed AS (SELECT row_idx, url,
  CASE WHEN (SELECT count(*) FROM dedup) > {URL_SAMPLE_LIMIT} THEN md5('{URL_SAMPLE_SEED}' || ':' || url) ELSE '' END AS k FROM dedup)
SELECT CAST(row_number() OVER (ORDER BY k, row_idx) AS BIGINT) AS n, row_idx, url
FROM keyed ORDER BY k, row_idx LIMIT {URL_SAMPLE_LIMIT}
""")
def url_dedupe_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    deduped = US.dedupe_by_apex(_url_rows(spark, sf_dir), "apex")
    return US.sample_urls(deduped, URL_SAMPLE_LIMIT, True, URL_SAMPLE_SEED)


@register("url_dedupe_all", f"""
WITH {D.URL_LIST_SQL}, {_URLS_NORM_SQL}, {_URLS_PARSED_SQL}, {_DEDUPE_SQL}
SELECT CAST(row_number() OVER (ORDER BY row_idx) AS BIGINT) AS n, row_idx, url FROM dedup
""")
def url_dedupe_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    deduped = US.dedupe_by_apex(_url_rows(spark, sf_dir), "apex")
    return US.sample_urls(deduped, None)


# --- T11 page text ------------------------------------------------------------------
@register("page_text", f"""
WITH {D.SITE_PAGES_SQL}, {D.CRAWL_SQL}
SELECT url, {O.page_text('html', 'final_url')} AS page_text FROM crawl
""")
def page_text_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.pages import page_text

    c = D.crawl(spark, sf_dir)
    return c.select("url", page_text(F.col("html"), F.col("final_url")).alias("page_text"))


# --- J2 + S7 + T11 + C5 + U5/U7 + C4: the URL scan over every URL -------------------
def _url_scan_sql(src: str, lead_n: bool, fetch: bool = True) -> str:
    """URL scan rows over CTE ``src`` (row_idx, url[, n]) after the URL CTEs."""
    n = "n, " if lead_n else ""
    if fetch:
        joined = f"""joined AS (
  SELECT {n}p.row_idx, p.url, c.url IS NOT NULL AS found, c.status AS c_status, c.final_url AS c_final,
         c.error AS c_error, c.content_type, c.html
  FROM sparsed p LEFT JOIN crawl c ON p.url = c.url
)"""
    else:
        joined = f"""joined AS (
  SELECT {n}row_idx, url, false AS found, CAST(NULL AS BIGINT) AS c_status, '' AS c_final,
         'skipped (offline)' AS c_error, '' AS content_type, '' AS html FROM sparsed
)"""
    fetch_err = ("CASE WHEN found THEN coalesce(c_error, '') ELSE 'ConnectionError(''not in stored crawl'')' END"
                 if fetch else "'skipped (offline)'")
    return f"""sparsed AS ({O.url_stage_sql(src, n + 'row_idx')}),
feat AS (SELECT row_idx, {O.mask_expr()} AS url_masked, {', '.join(O.url_feature_list())}, error AS perr FROM sparsed),
{joined},
fin AS ({O.url_stage_sql("(SELECT row_idx, CASE WHEN found THEN c_final ELSE '' END AS f FROM joined)", 'row_idx', 'f')}),
finm AS (SELECT row_idx, CASE WHEN url <> '' THEN {O.mask_expr()} ELSE '' END AS final_url_masked FROM fin),
texted AS (
  SELECT *, CASE WHEN found AND contains(lower(coalesce(content_type, '')), 'text/html')
                 THEN coalesce({O.page_text('html', 'c_final')}, '') ELSE '' END AS ptext
  FROM joined
),
scored_src AS (SELECT {n}row_idx, found, c_status, c_error, CASE WHEN ptext <> '' THEN ptext ELSE url END AS s FROM texted)
SELECT {('scored_src.n, ' if lead_n else '')}feat.row_idx, url_masked, final_url_masked,
       CASE WHEN found THEN coalesce(CAST(c_status AS VARCHAR), '') ELSE '' END AS status,
       CAST(0 AS BIGINT) AS redirects,
       coalesce(perr, {fetch_err}, '') AS error,
       {', '.join(US.FEATURES)},
       {', '.join(_sum_select_sql('s', merged=True))}
FROM feat JOIN finm ON feat.row_idx = finm.row_idx JOIN scored_src ON feat.row_idx = scored_src.row_idx"""


_PAGE_CUES_SQL = f"""
WITH {D.URL_LIST_SQL}, {_URLS_NORM_SQL}, {D.CRAWL_SQL},
{_url_scan_sql("(SELECT * FROM urls WHERE url <> '')", lead_n=False)}
"""


@register("page_cues", _PAGE_CUES_SQL)
def page_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = _url_rows(spark, sf_dir)
    fetched = US.attach_pages(urls, D.crawl(spark, sf_dir), "get")
    return US.score_urls(fetched, LEX).drop("url")


# --- C6: e-mail scan, S4/T7/T8 column roles ---------------------------------------------
from ..operators import census as CS  # noqa: E402
from ..operators import images as IM  # noqa: E402
from ..operators import mail as ML  # noqa: E402

_MAIL_COLUMNS = ["subject", "from", "from_domain", "to", "date", "body_snippet", "sanitized_body"]


def _mail_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.emails(spark, sf_dir)
    path = F.concat(F.col("file"), F.lit("#row="), F.col("row_idx").cast("string"))
    return e.select(path.alias("path"), *[F.col(f"`{c}`") for c in _MAIL_COLUMNS])


_MAIL_FRAME_SQL = f"""mframe AS (
  SELECT file || '#row=' || CAST(row_idx AS VARCHAR) AS path,
         coalesce(CASE WHEN coalesce(subject, '') <> '' THEN subject END, '') AS subject_raw,
         coalesce("from", '') AS "from", coalesce("to", '') AS "to", coalesce(date, '') AS date,
         concat_ws(chr(10), CASE WHEN coalesce(body_snippet, '') <> '' THEN body_snippet END,
                   CASE WHEN coalesce(sanitized_body, '') <> '' THEN {O.html_to_text('sanitized_body')} END) AS raw_text
  FROM emails
)"""


@register("column_roles", f"""
WITH {D.EMAILS_SQL}, {_MAIL_FRAME_SQL}
SELECT path, subject_raw, "from", "to", date, raw_text FROM mframe
""")
def column_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ML.scan_frame(_mail_input(spark, sf_dir))


@register("mail_scan", f"""
WITH {D.EMAILS_SQL}, {_MAIL_FRAME_SQL},
m AS (SELECT *, {O.deobfuscate('raw_text')} AS t FROM mframe)
SELECT path, 'ok' AS status, CAST(0 AS BIGINT) AS bytes, CAST(length(raw_text) AS BIGINT) AS text_len,
       {O.redact_emails('subject_raw')} AS subject, {O.redact_emails('"from"')} AS "from",
       {O.redact_emails('"to"')} AS "to", date,
       {', '.join(_sum_select_sql('t', merged=False))}, {', '.join(O.heuristics('t'))},
       '' AS error
FROM m
""")
def mail_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ML.mail_scan(_mail_input(spark, sf_dir), lexicon=LEX)


# --- C7: screenshot scan ------------------------------------------------------------------
_SHOTS_SCAN_SQL = f"""shots_scan AS (
  SELECT path,
         CASE WHEN coalesce(error, '') <> '' THEN 'error' ELSE 'ok' END AS status,
         CASE WHEN coalesce(error, '') <> '' THEN 0 ELSE CAST(length(coalesce(ocr_text, '')) AS BIGINT) END AS text_len,
         {', '.join(f"CASE WHEN coalesce(error, '') <> '' THEN 0 ELSE {e.rsplit(' AS ', 1)[0]} END AS {e.rsplit(' AS ', 1)[1]}" for e in _sum_select_sql('ocr_text', merged=True) + O.heuristics('ocr_text'))},
         CASE WHEN coalesce(error, '') <> '' THEN error ELSE '' END AS error
  FROM screenshots
)"""


@register("screenshot_scan", f"""
WITH {D.SCREENSHOTS_SQL}, {_SHOTS_SCAN_SQL}
SELECT * FROM shots_scan
""")
def screenshot_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return IM.screenshot_scan(D.screenshots(spark, sf_dir), LEX)


# --- census: T12-T15, A1-A8, W2, W3, L1, L2, J3, J4 --------------------------------------------
def _census_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.emails(spark, sf_dir)


def _ordered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed rows with a numeric scan order, so that the signature aggregate hashes."""
    rows = _census_rows(spark, sf_dir)
    return CS.shared(CS.with_scan_order(CS.signed_rows(rows), rows.select("file")))


_SIGNED_SQL = f"""sg0 AS (
  SELECT file, file_name, row_idx,
         {O.first_present(['subject'])} AS subj, {O.first_present(['sanitized_body'])} AS html,
         {O.first_present(['body_snippet'])} AS body,
         coalesce(from_domain, '') AS fdom, coalesce(date, '') AS dte
  FROM emails
),
sg1 AS (
  SELECT *, (subj <> '' OR html <> '' OR body <> '') AS email_like,
         CASE WHEN html <> '' THEN {O.html_to_text('html')} ELSE body END AS content,
         {O.first_year('dte')} AS dy, {O.first_year('file_name')} AS fy
  FROM sg0
),
sg2 AS (SELECT *, {O.year_ok('dy')} AS dy_ok, {O.year_ok('fy')} AS fy_ok, {O.normalize_text('content')} AS cnorm FROM sg1),
signed AS (
  SELECT file, file_name, row_idx, string_split(file, '/') AS file_key, email_like,
         CASE WHEN email_like THEN lower({O.py_strip('fdom')}) END AS from_domain,
         CASE WHEN email_like THEN {O.normalize_subject('subj')} END AS normalized_subject,
         CASE WHEN email_like THEN {O.sha1_sig('cnorm')} END AS content_sig,
         CASE WHEN email_like THEN (CASE WHEN dy_ok THEN dy WHEN fy_ok THEN fy ELSE '' END) END AS year,
         CASE WHEN email_like THEN (CASE WHEN dy_ok THEN 'date_valid' WHEN fy_ok THEN 'fallback_file' ELSE 'unknown' END) END AS year_source,
         CASE WHEN email_like THEN (dy <> '' AND NOT dy_ok) END AS date_out_of_range,
         substr(subj, 1, 200) AS example_subject
  FROM sg2
),
sigs AS (
  SELECT from_domain, normalized_subject, content_sig, count(*) AS count,
         min(CASE WHEN year <> '' THEN year END) AS earliest_year,
         min(struct_pack(k := file_key, r := row_idx)) AS first_seen
  FROM signed WHERE email_like GROUP BY from_domain, normalized_subject, content_sig
)"""


def _examples_sql(chosen: str, render: str) -> str:
    return f"""SELECT s.from_domain, s.normalized_subject, s.content_sig,
         string_agg(ex, ' | ' ORDER BY rn) AS examples FROM (
    SELECT g.from_domain, g.normalized_subject, g.content_sig, {render} AS ex,
           row_number() OVER (PARTITION BY g.from_domain, g.normalized_subject, g.content_sig
                              ORDER BY g.file_key, g.row_idx) AS rn
    FROM signed g SEMI JOIN {chosen} c
      ON g.from_domain = c.from_domain AND g.normalized_subject = c.normalized_subject AND g.content_sig = c.content_sig
    WHERE g.email_like
  ) s WHERE rn <= 3 GROUP BY s.from_domain, s.normalized_subject, s.content_sig"""


@register("census_overall", f"""
WITH {D.EMAILS_SQL}, {_SIGNED_SQL},
t AS (SELECT count(DISTINCT file) AS files_scanned, count(*) AS rows_total, count_if(email_like) AS e,
             count_if(year_source = 'date_valid') AS date_valid, count_if(year_source = 'fallback_file') AS fallback_file,
             count_if(year_source = 'unknown') AS unknown, count_if(coalesce(date_out_of_range, false)) AS date_out_of_range
      FROM signed),
u AS (SELECT count(*) AS unique_emails FROM sigs)
SELECT CAST(files_scanned AS BIGINT) AS files_scanned, CAST(rows_total AS BIGINT) AS rows_total,
       CAST(e AS BIGINT) AS email_like_rows, CAST(unique_emails AS BIGINT) AS unique_emails,
       CAST(greatest(e - unique_emails, 0) AS BIGINT) AS estimated_duplicates,
       CAST(CASE WHEN e > 0 THEN round_even(greatest(e - unique_emails, 0) / e * 100.0, 2) ELSE 0.0 END AS DOUBLE) AS duplicate_rate_percent,
       CAST(date_valid AS BIGINT) AS date_valid, CAST(fallback_file AS BIGINT) AS fallback_file,
       CAST(unknown AS BIGINT) AS unknown, CAST(date_out_of_range AS BIGINT) AS date_out_of_range
FROM t, u
""")
def census_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = CS.signed_rows(_census_rows(spark, sf_dir))
    return CS.overall(signed, CS.signatures(signed))


@register("census_per_year", f"""
WITH {D.EMAILS_SQL}, {_SIGNED_SQL},
r AS (SELECT year, count(*) AS n FROM signed WHERE email_like AND year <> '' GROUP BY year),
u AS (SELECT earliest_year AS year, count(*) AS n FROM sigs WHERE earliest_year IS NOT NULL GROUP BY earliest_year)
SELECT coalesce(r.year, u.year) AS year, CAST(coalesce(r.n, 0) AS BIGINT) AS email_like_rows,
       CAST(coalesce(u.n, 0) AS BIGINT) AS unique_emails,
       CAST(greatest(coalesce(r.n, 0) - coalesce(u.n, 0), 0) AS BIGINT) AS estimated_duplicates
FROM r FULL OUTER JOIN u ON r.year = u.year
""")
def census_per_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = CS.signed_rows(_census_rows(spark, sf_dir))
    return CS.per_year(signed, CS.signatures(signed))


@register("census_per_file", f"""
WITH {D.EMAILS_SQL}, {_SIGNED_SQL}
SELECT file, CAST(count(*) AS BIGINT) AS rows_total, CAST(count_if(email_like) AS BIGINT) AS email_like_rows,
       CAST(count(DISTINCT CASE WHEN email_like THEN struct_pack(a := from_domain, b := normalized_subject, c := content_sig) END) AS BIGINT)
         AS unique_signatures_in_file
FROM signed GROUP BY file
""")
def census_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CS.per_file(CS.signed_rows(_census_rows(spark, sf_dir)))


@register("census_top_duplicates", f"""
WITH {D.EMAILS_SQL}, {_SIGNED_SQL},
chosen AS (SELECT * FROM sigs WHERE count >= 2 ORDER BY count DESC, first_seen LIMIT 50),
ex AS ({_examples_sql('chosen', "g.file_name || ' :: ' || g.example_subject")})
SELECT CAST(c.count AS BIGINT) AS count,
       CASE WHEN c.from_domain = '' THEN '-' ELSE c.from_domain END AS from_domain,
       CASE WHEN c.normalized_subject = '' THEN '-' ELSE c.normalized_subject END AS normalized_subject,
       substr(c.content_sig, 1, 10) AS content_hash_prefix, coalesce(c.earliest_year, '') AS earliest_year,
       coalesce(ex.examples, '') AS examples
FROM chosen c LEFT JOIN ex ON c.from_domain = ex.from_domain AND c.normalized_subject = ex.normalized_subject
                          AND c.content_sig = ex.content_sig
""")
def census_top_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = _ordered_rows(spark, sf_dir)
    return CS.top_duplicates(signed, CS.signatures(signed))


@register("census_unique_examples", f"""
WITH {D.EMAILS_SQL}, {_SIGNED_SQL},
chosen AS (SELECT * FROM sigs ORDER BY first_seen LIMIT 200),
ex AS ({_examples_sql('chosen', 'g.example_subject')})
SELECT CASE WHEN c.from_domain = '' THEN '-' ELSE c.from_domain END AS from_domain,
       CASE WHEN c.normalized_subject = '' THEN '-' ELSE c.normalized_subject END AS normalized_subject,
       substr(c.content_sig, 1, 10) AS content_hash_prefix, coalesce(c.earliest_year, '') AS earliest_year,
       coalesce(ex.examples, '') AS example_subjects
FROM chosen c LEFT JOIN ex ON c.from_domain = ex.from_domain AND c.normalized_subject = ex.normalized_subject
                          AND c.content_sig = ex.content_sig
""")
def census_unique_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = _ordered_rows(spark, sf_dir)
    return CS.unique_examples(signed, CS.signatures(signed))


@register("year_audit", f"""
WITH {D.EMAILS_SQL}, {_SIGNED_SQL}
SELECT year, year_source, date_out_of_range, CAST(count(*) AS BIGINT) AS rows
FROM signed WHERE email_like GROUP BY year, year_source, date_out_of_range
""")
def year_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CS.year_audit(CS.signed_rows(_census_rows(spark, sf_dir)))


# --- T12 on order references --------------------------------------------------------------
_ORDER_REF_SQL = ("'ref ' || o_orderstatus || '-' || CAST(year(o_orderdate) + o_custkey % 25 AS VARCHAR) "
                  "|| '/' || o_orderpriority")


@register("extract_year", f"""
SELECT o_orderkey, {_ORDER_REF_SQL} AS ref,
       CASE WHEN {O.year_ok(O.first_year(_ORDER_REF_SQL))} THEN {O.first_year(_ORDER_REF_SQL)} ELSE '' END AS year
FROM orders
""")
def extract_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = D.table(spark, sf_dir, "orders")
    ref = F.concat(F.lit("ref "), F.col("o_orderstatus"), F.lit("-"),
                   (F.year("o_orderdate") + F.col("o_custkey") % 25).cast("string"), F.lit("/"), F.col("o_orderpriority"))
    return o.select("o_orderkey", ref.alias("ref"), T.extract_year(ref).alias("year"))


# --- T3 ------------------------------------------------------------------------------------
@register("normalize_subject", f"""
WITH {D.EMAILS_SQL}
SELECT row_idx, {O.normalize_subject('subject')} AS normalized_subject FROM emails
""")
def normalize_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.emails(spark, sf_dir)
    return e.select("row_idx", T.normalize_subject(F.col("subject")).alias("normalized_subject"))


# --- summary: T16, A9, A10, S11, X2 -----------------------------------------------------------
from ..operators import summary as SM  # noqa: E402
from ..sources.tables import reusable  # noqa: E402

_CORRUPT_COLS = ("sum_urgency", "all_caps_words")


def _as_text(df: DataFrame, source: str, run_id: str, key: str) -> DataFrame:
    """A scan output as its CSV would read back: every value text, with
    malformed numbers in two columns (decimals, padding, words, exponents,
    blanks) picked by ``key``."""
    k = F.col(key)

    def txt(c: str):
        v = F.col(c).cast("string")
        if c not in _CORRUPT_COLS:
            return v.alias(c)
        return (
            F.when(k % 11 == 0, F.concat(v, F.lit(".0")))
            .when(k % 13 == 0, F.concat(F.lit(" "), v, F.lit(" ")))
            .when(k % 17 == 0, F.lit("n/a"))
            .when(k % 19 == 0, F.concat(v, F.lit("e0")))
            .when(k % 23 == 0, F.lit(""))
            .otherwise(v).alias(c)
        )

    return df.select(F.lit(source).alias("source"), F.lit(run_id).alias("run_id"),
                     *[txt(c) for c in df.columns])


def _corrupt_sql(c: str, key: str) -> str:
    v = f"CAST({c} AS VARCHAR)"
    return (f"CASE WHEN {key} % 11 = 0 THEN {v} || '.0' WHEN {key} % 13 = 0 THEN ' ' || {v} || ' ' "
            f"WHEN {key} % 17 = 0 THEN 'n/a' WHEN {key} % 19 = 0 THEN {v} || 'e0' "
            f"WHEN {key} % 23 = 0 THEN '' ELSE {v} END")


_NUMERIC_SQL = r"^[+-]?(?:(?:\d(?:_?\d)*)(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?$"


def _tolerant_int_sql(x: str) -> str:
    s = O.py_strip(f"coalesce({x}, '')")
    d = f"TRY_CAST(replace({s}, '_', '') AS DOUBLE)"
    return (f"(CASE WHEN regexp_matches({s}, {O.q(_NUMERIC_SQL)}) AND NOT isnan({d}) AND abs({d}) < 9.2e18 "
            f"THEN CAST(trunc({d}) AS BIGINT) ELSE 0 END)")


def _source_rows_sql(name: str, cte: str, run: str, key: str, extras: bool, where: str = "") -> str:
    cols = []
    for c in SUMS + (EXTRA_COLUMNS if extras else []):
        v = _tolerant_int_sql(_corrupt_sql(c, key)) if c in _CORRUPT_COLS else c
        cols.append(f"{v} AS {c}")
    cols += [f"0 AS {c}" for c in ([] if extras else EXTRA_COLUMNS)]
    return f"SELECT '{name}' AS source, '{run}' AS run_id, error, {', '.join(cols)} FROM {cte} {where}"


_RUNS = {"emails": ("20250102_090000", "20240101_120000"), "images": ("20250103_080000",),
         "urls": ("20250101_100000",)}


def _summary_sql() -> str:
    def inner(name: str) -> str:
        return ORACLE[name].strip()

    sums = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in SUMS + EXTRA_COLUMNS)
    return f"""
WITH nz0 AS ({inner('mail_scan')}),
im0 AS ({inner('screenshot_scan')}),
us0 AS ({inner('page_cues')}),
allrows AS (
  {_source_rows_sql('emails', 'nz0', _RUNS['emails'][0], 'text_len', True)}
  UNION ALL {_source_rows_sql('emails', 'nz0', _RUNS['emails'][1], 'text_len', True, "WHERE path LIKE '%-1999.csv#%'")}
  UNION ALL {_source_rows_sql('images', 'im0', _RUNS['images'][0], 'text_len', True)}
  UNION ALL {_source_rows_sql('urls', 'us0', _RUNS['urls'][0], 'row_idx', False)}
),
latest AS (SELECT source, max(run_id) AS run_id FROM allrows GROUP BY source),
cur AS (SELECT a.* FROM allrows a SEMI JOIN latest l ON a.source = l.source AND a.run_id = l.run_id)
SELECT CASE WHEN grouping(source) = 1 THEN 'TOTAL' ELSE source END AS source,
       CASE WHEN grouping(source) = 1 THEN '—' ELSE max(run_id) END AS timestamp,
       CAST(count(*) AS BIGINT) AS n_items,
       CAST(count_if(NOT {O.is_blank('error')}) AS BIGINT) AS errors,
       {sums}
FROM cur GROUP BY ROLLUP (source)
"""


@register("summary_totals", _summary_sql())
def summary_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The older run re-reads part of the e-mail scan: one shared exchange of
    # the (text-free) scan rows serves both branches.
    nz = reusable(QUERIES["mail_scan"](spark, sf_dir))
    im = QUERIES["screenshot_scan"](spark, sf_dir)
    us = QUERIES["page_cues"](spark, sf_dir)
    old_nz = nz.where(F.col("path").like("%-1999.csv#%"))
    frames = [
        _as_text(nz, "emails", _RUNS["emails"][0], "text_len"),
        _as_text(old_nz, "emails", _RUNS["emails"][1], "text_len"),
        _as_text(im, "images", _RUNS["images"][0], "text_len"),
        _as_text(us, "urls", _RUNS["urls"][0], "row_idx"),
    ]
    return SM.rollup_sources(SM.union_sources(frames), LEX)


# --- the whole URL job: D-1 + L3 + W4 + J2 (bounded, broadcast sample) + U + C4 ------------
_SAMPLE_SQL = f"""{_DEDUPE_SQL},
keyed AS (SELECT row_idx, url,
  CASE WHEN (SELECT count(*) FROM dedup) > {URL_SAMPLE_LIMIT} THEN md5('{URL_SAMPLE_SEED}' || ':' || url) ELSE '' END AS k FROM dedup),
sample AS (SELECT CAST(row_number() OVER (ORDER BY k, row_idx) AS BIGINT) AS n, row_idx, url
           FROM keyed ORDER BY k, row_idx LIMIT {URL_SAMPLE_LIMIT})"""


@register("url_scan", f"""
WITH {D.URL_LIST_SQL}, {_URLS_NORM_SQL}, {_URLS_PARSED_SQL}, {D.CRAWL_SQL}, {_SAMPLE_SQL},
{_url_scan_sql('sample', lead_n=True)}
""")
def url_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return US.url_scan(_url_rows(spark, sf_dir), D.crawl(spark, sf_dir), URL_SAMPLE_LIMIT, True,
                       URL_SAMPLE_SEED, "apex", "get", LEX)


@register("url_scan_offline", f"""
WITH {D.URL_LIST_SQL}, {_URLS_NORM_SQL}, {_URLS_PARSED_SQL}, {_SAMPLE_SQL},
{_url_scan_sql('sample', lead_n=True, fetch=False)}
""")
def url_scan_offline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return US.url_scan(_url_rows(spark, sf_dir), None, URL_SAMPLE_LIMIT, True, URL_SAMPLE_SEED, "apex", "off", LEX)


# --- C4 at phrase level: merged raw + normalised phrase maps (screenshot texts) --------------
def _merged_unnest_sql(raw_doubled: str, norm_doubled: str) -> str:
    items = ", ".join(
        f"{{'category': {O.q(c)}, 'phrase': {O.q(p)}, "
        f"'n': CAST({O.phrase_count(raw_doubled, p)} + {O.phrase_count(norm_doubled, p)} AS BIGINT)}}"
        for c, _, p, _ in LEX.rows()
    )
    return f"unnest([{items}], recursive := true)"


@register("cue_phrase_counts_merged", f"""
WITH {D.SCREENSHOTS_SQL},
dd AS (SELECT path, {O.doubled(O.fold('ocr_text'))} AS r, {O.doubled(O.normalize_text('ocr_text'))} AS m
       FROM screenshots WHERE ocr_text IS NOT NULL),
lc AS (SELECT path, {_merged_unnest_sql('r', 'm')} FROM dd)
SELECT path, category, phrase, n FROM lc WHERE n > 0
""")
def cue_phrase_counts_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    shots = D.screenshots(spark, sf_dir).where(F.col("ocr_text").isNotNull())
    return phrase_counts_long(shots, ["path"], "ocr_text", LEX, merged=True)


# --- T6: encoded words; the oracle knows the plain text that was encoded ------------------------
@register("mime_subjects", r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, CAST(doc_id AS VARCHAR) AS id FROM documents)
SELECT doc_id, CASE doc_id % 8
    WHEN 0 THEN text
    WHEN 1 THEN 'Re: ' || text
    WHEN 2 THEN text
    WHEN 3 THEN 'a ' || regexp_replace(text, '[^\x{00}-\x{ff}]', '', 'g') || ' b'
    WHEN 4 THEN 'x ' || chr(8364) || ' ' || id || ' y'
    WHEN 5 THEN text
    WHEN 6 THEN 'Привет ' || id
    ELSE '=?no-such-charset?Q?a?= ' || id END AS subject
FROM t
""")
def mime_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, doc = F.coalesce("text", F.lit("")), F.col("doc_id").cast("string")
    utf8 = F.encode(text, "UTF-8")
    half = F.expr("int(octet_length(coalesce(text, '')) / 2)")
    latin = F.encode(F.regexp_replace(text, r"[^\x{00}-\x{ff}]", ""), "ISO-8859-1")

    def b64(charset: str, data: Column) -> Column:
        return F.concat(F.lit(f"=?{charset}?B?"), F.regexp_replace(F.base64(data), "[\r\n]", ""), F.lit("?="))

    subject = (F.when(F.col("doc_id") % 8 == 0, b64("utf-8", utf8))
               .when(F.col("doc_id") % 8 == 1, F.concat(F.lit("Re: =?UTF-8?q?"), F.regexp_replace(F.hex(utf8), "(..)", "=$1"), F.lit("?=")))
               .when(F.col("doc_id") % 8 == 2, F.concat(b64("utf-8", F.substring(utf8, F.lit(1), half)), F.lit("  "),
                                                        b64("UTF-8", F.substring(utf8, half + 1, F.lit(2**31 - 1)))))
               .when(F.col("doc_id") % 8 == 3, F.concat(F.lit("a "), b64("iso-8859-1", latin), F.lit(" b")))
               .when(F.col("doc_id") % 8 == 4, F.concat(F.lit("x=?windows-1252?Q?=80_"), doc, F.lit("?=y")))
               .when(F.col("doc_id") % 8 == 5, text)
               .when(F.col("doc_id") % 8 == 6, F.concat(F.lit("=?koi8-r?B?8NLJ18XU?= "), doc))
               .otherwise(F.concat(F.lit("=?no-such-charset?Q?a?= "), doc)))
    docs = D.table(spark, sf_dir, "documents").select("doc_id", subject.alias("subject"))
    return docs.select("doc_id", decode_mime(F.col("subject")).alias("subject"))


from . import stored  # noqa: E402, F401  (registers its queries)
