"""Inputs derived from the driver tables, written twice: as Spark DataFrames
and as DuckDB SQL. Both sides compute the same rows from the same tables.

The raw tables hold almost no lexicon phrase, years or links, so texts are
*salted* deterministically (phrases picked by id, case and separator traps
appended); e-mail, screenshot, URL and crawl views are built from documents,
conversations and pages. Every row of every table is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lexicon import DEFAULT_LEXICON
from ..session import ensure_checkpoint_dir
from ..sources.tables import read_parquet
from .oracle import phrase_list_literal

N_PHRASES = len(DEFAULT_LEXICON.phrases())


TEXT_TABLES = {"documents", "pages", "conversations", "benchmark"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; text tables are spread over the cores (see ``spread``)."""
    return read_parquet(spark, f"{sf_dir.rstrip('/')}/{name}.parquet", spread_rows=name in TEXT_TABLES)


def _phrase_at(idx: Column) -> Column:
    arr = F.array(*[F.lit(p) for p in DEFAULT_LEXICON.phrases()])
    return F.element_at(arr, (idx % N_PHRASES + 1).cast("int"))


def _phrase_at_sql(idx: str) -> str:
    return f"({phrase_list_literal()})[({idx}) % {N_PHRASES} + 1]"


def salt(text: Column, key: Column) -> Column:
    """Append three lexicon phrases picked by ``key`` plus boundary traps."""
    p1 = _phrase_at(key)
    p2 = _phrase_at(key * 7 + 3)
    p3 = _phrase_at(key * 13 + 5)
    return F.concat(
        F.coalesce(text, F.lit("")), F.lit(" "), p1, F.lit(". "), F.upper(p2), F.lit(" ("), p3,
        F.lit("_x) sign\nin NOW!! nowé now_ hxxps://secure[.]example[.]com/Verify "),
        p1, F.lit(" $5 www."), F.regexp_replace(p2, " ", "-"), F.lit(".com"),
    )


def salt_sql(text: str, key: str) -> str:
    p1 = _phrase_at_sql(key)
    p2 = _phrase_at_sql(f"({key}) * 7 + 3")
    p3 = _phrase_at_sql(f"({key}) * 13 + 5")
    return (
        f"concat(coalesce({text}, ''), ' ', {p1}, '. ', upper({p2}), ' (', {p3}, "
        f"'_x) sign' || chr(10) || 'in NOW!! nowé now_ hxxps://secure[.]example[.]com/Verify ', "
        f"{p1}, ' $5 www.', replace({p2}, ' ', '-'), '.com')"
    )


# --- salted documents -------------------------------------------------------
def salted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", salt(F.col("text"), F.col("doc_id")).alias("text"), "lang", "source")


SALTED_DOCUMENTS_SQL = f"""salted AS (
  SELECT doc_id, {salt_sql('text', 'doc_id')} AS text, lang, source FROM documents
)"""


# --- e-mail view (census + mail scan) ---------------------------------------
def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> e-mail rows: file, row_idx and the usual CSV columns."""
    d = salted_documents(spark, sf_dir)
    i = F.col("doc_id")
    file_name = F.concat(
        F.col("source"),
        F.when(F.col("lang") == "en", F.lit("-2011.csv"))
        .when(F.col("lang") == "de", F.lit("_2012.csv"))
        .when(F.col("lang") == "fr", F.lit("-1999.csv"))
        .otherwise(F.lit(".csv")),
    )
    first_line = F.substring_index(F.col("text"), "\n", 1)
    prefix = (
        F.when(i % 4 == 0, F.lit("RE: ")).when(i % 4 == 1, F.lit("Fwd:  "))
        .when(i % 4 == 2, F.lit("")).otherwise(F.lit("FW : "))
    )
    subject = F.concat(
        prefix, first_line,
        F.when(i % 9 == 0, F.concat(F.lit(" <alert."), i.cast("string"), F.lit("@mail.example.co.uk>")))
        .otherwise(F.lit("")),
    )
    return d.select(
        F.concat(F.lit("mail/"), file_name).alias("file"),
        file_name.alias("file_name"),
        i.alias("row_idx"),
        subject.alias("subject"),
        F.concat(F.lit("Support Team <support"), (i % 17).cast("string"), F.lit("@"), F.col("lang"),
                 F.lit("-bank.example.com>")).alias("from"),
        F.when(i % 5 == 0, F.concat(F.upper(F.col("lang")), F.lit("-Bank.Example.com ")))
        .otherwise(F.concat(F.col("lang"), F.lit("-bank.example.com"))).alias("from_domain"),
        F.concat(F.lit("user"), i.cast("string"), F.lit("@corp.example.org")).alias("to"),
        F.when(i % 7 == 0, F.lit(""))
        .otherwise(F.concat(F.lit("Mon, 3 Mar "), (i % 30 + 2000).cast("string"), F.lit(" 10:00:00 +0000")))
        .alias("date"),
        F.when(i % 6 == 1, F.lit("   ")).otherwise(F.col("text")).alias("body_snippet"),
        F.when(i % 3 == 0, F.concat(F.lit("<div><style>p{x}</style><p>"), F.col("text"), F.lit("</p></div>")))
        .when(i % 3 == 1, F.lit("<br/>")).otherwise(F.lit(None).cast("string")).alias("sanitized_body"),
    )


EMAILS_SQL = SALTED_DOCUMENTS_SQL + """,
emails AS (
  SELECT
    'mail/' || fname AS file, fname AS file_name, doc_id AS row_idx,
    concat(CASE doc_id % 4 WHEN 0 THEN 'RE: ' WHEN 1 THEN 'Fwd:  ' WHEN 2 THEN '' ELSE 'FW : ' END,
           split_part(text, chr(10), 1),
           CASE WHEN doc_id % 9 = 0 THEN ' <alert.' || CAST(doc_id AS VARCHAR) || '@mail.example.co.uk>' ELSE '' END) AS subject,
    'Support Team <support' || CAST(doc_id % 17 AS VARCHAR) || '@' || lang || '-bank.example.com>' AS "from",
    CASE WHEN doc_id % 5 = 0 THEN upper(lang) || '-Bank.Example.com ' ELSE lang || '-bank.example.com' END AS from_domain,
    'user' || CAST(doc_id AS VARCHAR) || '@corp.example.org' AS "to",
    CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'Mon, 3 Mar ' || CAST(doc_id % 30 + 2000 AS VARCHAR) || ' 10:00:00 +0000' END AS date,
    CASE WHEN doc_id % 6 = 1 THEN '   ' ELSE text END AS body_snippet,
    CASE doc_id % 3 WHEN 0 THEN '<div><style>p{x}</style><p>' || text || '</p></div>'
                    WHEN 1 THEN '<br/>' ELSE NULL END AS sanitized_body
  FROM (SELECT *, source || CASE lang WHEN 'en' THEN '-2011.csv' WHEN 'de' THEN '_2012.csv'
                                      WHEN 'fr' THEN '-1999.csv' ELSE '.csv' END AS fname FROM salted)
)"""


# --- screenshot text (images) -----------------------------------------------
def screenshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations -> (path, ocr_text, error): one 'screenshot' per turn;
    the first turn of every tenth conversation is an unreadable image."""
    c = table(spark, sf_dir, "conversations")
    key = F.col("conv_id") * 31 + F.col("turn")
    bad = (F.col("conv_id") % 10 == 3) & (F.col("turn") == 0)
    return c.select(
        F.concat(F.lit("shots/conv"), F.col("conv_id").cast("string"), F.lit("_"),
                 F.col("turn").cast("string"), F.lit(".png")).alias("path"),
        F.when(bad, F.lit(None).cast("string")).otherwise(salt(F.col("text"), key)).alias("ocr_text"),
        F.when(bad, F.lit("OSError('cannot identify image file')")).alias("error"),
    )


SCREENSHOTS_SQL = f"""screenshots AS (
  SELECT 'shots/conv' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) || '.png' AS path,
         CASE WHEN conv_id % 10 = 3 AND turn = 0 THEN NULL ELSE {salt_sql('text', 'conv_id * 31 + turn')} END AS ocr_text,
         CASE WHEN conv_id % 10 = 3 AND turn = 0 THEN 'OSError(''cannot identify image file'')' END AS error
  FROM conversations
)"""


# --- URL list (pages.url and mutated variants) ------------------------------
URL_VARIANTS = 10


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages with a registrable domain of its own per page, so that apex
    de-duplication keeps one URL of every page."""
    p = table(spark, sf_dir, "pages")
    own = F.concat(F.lit(".example"), F.col("page_id").cast("string"), F.lit("."))
    return p.withColumn("url", F.replace(F.col("url"), F.lit(".example."), own))


SITE_PAGES_SQL = """site_pages AS (
  SELECT * REPLACE (replace(url, '.example.', '.example' || CAST(page_id AS VARCHAR) || '.') AS url) FROM pages
)"""


def url_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site_pages -> (url_id, url): every page URL plus nine variants (no scheme,
    IP host, user info, port, www. without scheme, upper-case scheme with
    padding and punycode, IPv6, an unbalanced bracket, a blank)."""
    p = site_pages(spark, sf_dir).select("page_id", "url")
    k = F.col("page_id")
    u = F.col("url")
    no_scheme = F.regexp_replace(u, "^https?://", "")
    variants = [
        u,
        no_scheme,
        F.concat(F.lit("http://10."), (k % 250).cast("string"), F.lit("."), (k % 7).cast("string"),
                 F.lit(".1/Login/x;p=1?q=verify&id="), k.cast("string")),
        F.regexp_replace(u, "://", "://admin@"),
        F.regexp_replace(u, "^(https?://[^/?#]+)", "$1:8080"),
        F.concat(F.lit("www."), no_scheme),
        F.concat(F.lit("  HTTPS://xn--pypal-4ve."), F.regexp_replace(no_scheme, "[/?#].*$", ""),
                 F.lit("/secure-login/update?acct="), k.cast("string"), F.lit(" ")),
        F.concat(F.lit("http://[fe80::"), (k % 9).cast("string"), F.lit("]:8/a/b;c")),
        F.concat(F.lit("http://[bad"), (k % 5).cast("string"), F.lit(".example.com/x")),
        F.lit("   "),
    ]
    arr = F.array(*[F.struct(F.lit(i).alias("v"), c.alias("url")) for i, c in enumerate(variants)])
    return p.select(k, F.inline(arr)).select(
        (F.col("page_id") * URL_VARIANTS + F.col("v")).alias("url_id"), "url"
    )


URL_LIST_SQL = f"""{SITE_PAGES_SQL},
url_list AS (
  SELECT page_id * {URL_VARIANTS} + v AS url_id, url FROM (
    SELECT page_id, 0 AS v, url FROM site_pages
    UNION ALL SELECT page_id, 1, regexp_replace(url, '^https?://', '') FROM site_pages
    UNION ALL SELECT page_id, 2, 'http://10.' || CAST(page_id % 250 AS VARCHAR) || '.' || CAST(page_id % 7 AS VARCHAR)
                                  || '.1/Login/x;p=1?q=verify&id=' || CAST(page_id AS VARCHAR) FROM site_pages
    UNION ALL SELECT page_id, 3, replace(url, '://', '://admin@') FROM site_pages
    UNION ALL SELECT page_id, 4, regexp_replace(url, '^(https?://[^/?#]+)', '\\1:8080') FROM site_pages
    UNION ALL SELECT page_id, 5, 'www.' || regexp_replace(url, '^https?://', '') FROM site_pages
    UNION ALL SELECT page_id, 6, '  HTTPS://xn--pypal-4ve.' || regexp_replace(regexp_replace(url, '^https?://', ''), '[/?#].*$', '')
                                  || '/secure-login/update?acct=' || CAST(page_id AS VARCHAR) || ' ' FROM site_pages
    UNION ALL SELECT page_id, 7, 'http://[fe80::' || CAST(page_id % 9 AS VARCHAR) || ']:8/a/b;c' FROM site_pages
    UNION ALL SELECT page_id, 8, 'http://[bad' || CAST(page_id % 5 AS VARCHAR) || '.example.com/x' FROM site_pages
    UNION ALL SELECT page_id, 9, '   ' FROM site_pages
  )
)"""


# --- stored crawl ------------------------------------------------------------
LONG_LIST = '<a href="/r">read <i>more</i> &amp; more</a>' * 220


def crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site_pages as a stored crawl: one row per URL (the first page_id). Every
    title ends in, and a last anchor holds, lexicon phrases; every 25th page
    has 220 anchors before it, every 17th is no HTML."""
    p = site_pages(spark, sf_dir)
    first = p.groupBy("url").agg(F.min_by(F.struct("page_id", "html"), F.col("page_id")).alias("p"))
    k = F.col("p.page_id")
    phrases = salt(F.lit(""), k)
    html = F.concat(
        F.replace(F.coalesce(F.col("p.html"), F.lit("")), F.lit("</title>"), F.concat(F.lit(" "), phrases, F.lit("</title>"))),
        F.when(k % 25 == 0, F.lit(LONG_LIST)).otherwise(F.lit("")),
        F.lit('<a href="/s">' + "long " * 50 + "<b>"), phrases, F.lit("</b></a>"))
    return first.select(
        "url",
        F.lit(200).alias("status"),
        F.lit(0).alias("redirects"),
        F.col("url").alias("final_url"),
        F.when(k % 17 == 5, F.lit("application/pdf")).otherwise(F.lit("text/html; charset=utf-8")).alias("content_type"),
        F.lit("").alias("error"),
        html.alias("html"),
    )


#: Follows URL_LIST_SQL or SITE_PAGES_SQL.
CRAWL_SQL = f"""first_pages AS (
  SELECT url, min(page_id) AS k, coalesce(arg_min(html, page_id), '') AS h FROM site_pages GROUP BY url
),
phrased AS (SELECT *, {salt_sql("''", 'k')} AS phrases FROM first_pages),
crawl AS (
  SELECT url, 200 AS status, 0 AS redirects, url AS final_url,
         CASE WHEN k % 17 = 5 THEN 'application/pdf' ELSE 'text/html; charset=utf-8' END AS content_type, '' AS error,
         replace(h, '</title>', ' ' || phrases || '</title>') || CASE WHEN k % 25 = 0 THEN '{LONG_LIST}' ELSE '' END
         || '<a href="/s">{"long " * 50}<b>' || phrases || '</b></a>' AS html
  FROM phrased
)"""


# --- the e-mail rows as a CSV corpus of four kinds of header ---------------------------------
#: kind -> (header cells, e-mail columns of the cells). A BOM, padded and repeated names, and a
#: header without a body name occur; of repeated names the last column holds the value.
CSV_HEADERS = [
    (["subject", "from", "from_domain", "to", "date", "body_snippet", "sanitized_body"],
     ["subject", "from", "from_domain", "to", "date", "body_snippet", "sanitized_body"]),
    ([" Title ", "from", "date", "Message", "BODY_HTML"], ["subject", "from", "date", "body_snippet", "sanitized_body"]),
    (["id", "date", "from", "subject", "notes", "extra"], ["row_idx", "date", "from", "subject", "body_snippet", "to"]),
    (["﻿subj", "payload", "from", "payload"], ["subject", "to", "from", "body_snippet"]),
]


def box_name(file_name: Column) -> Column:
    return F.concat(F.regexp_replace(file_name, "[.]csv$", ""), F.lit(" é+box"))


#: Bytes of cells in a file, about: one task writes and reads a file, so a box's records go on in further files.
FILE_BYTES = 32 << 20


def record_ranges(rows: DataFrame, n_bytes: Column, file_bytes: int = FILE_BYTES) -> DataFrame:
    """The files of every (kind, box): ``lo``, the least ``_o`` of a file, and
    ``before``, the records of the box in the files before it.

    The keys alone are range-partitioned in about as many parts as the rows
    have ``file_bytes``; a part's rows of a box make one file. Records of one
    ``_o`` stay together. One row per file, kept in the checkpoint folder, as
    sampled ranges may differ between two runs."""
    ensure_checkpoint_dir(rows.sparkSession)
    total = rows.agg(F.sum(n_bytes.cast("bigint"))).first()[0] or 0
    keys = rows.select("kind", "box", "_o").repartitionByRange(total // file_bytes + 1, "kind", "box", "_o")
    files = (keys.select("*", F.spark_partition_id().alias("_pid")).groupBy("kind", "box", "_pid")
             .agg(F.min("_o").alias("lo"), F.count(F.lit(1)).alias("n")).checkpoint(eager=True))
    earlier = Window.partitionBy("kind", "box").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("kind", "box", "lo", F.coalesce(F.sum("n").over(earlier), F.lit(0)).cast("bigint").alias("before"))


def write_records(cells: DataFrame, files: DataFrame, header: list[str], path: str, by: list[str]) -> None:
    """``cells`` (kind, box, _o, c0, c1, ...) as CSV files in folders of ``by``
    and ``from=<records of the box before the file>``, in the order of ``_o``.
    The header is each file's first record."""
    names = [f"c{i}" for i in range(len(header))]
    ranges = files.groupBy("kind", "box").agg(F.sort_array(F.collect_list(F.struct("lo", "before"))).alias("_files"))
    ranges = ranges.withColumnsRenamed({"kind": "_kind", "box": "_box"})
    at = F.element_at(F.filter("_files", lambda f: f["lo"] <= F.col("_o")), -1)["before"]
    rows = (cells.join(F.broadcast(ranges), F.col("kind").eqNullSafe(F.col("_kind")) & F.col("box").eqNullSafe(F.col("_box")))
            .select("kind", "box", at.alias("from"), F.lit(1).alias("_h"), "_o", *names))
    first = files.select("kind", "box", F.col("before").alias("from"), F.lit(0).alias("_h"), F.col("lo").alias("_o"),
                         *[F.lit(h).alias(n) for h, n in zip(header, names)])
    folders = [*by, "from"]
    (first.union(rows).repartition("kind", "box", "from").sortWithinPartitions(*folders, "_h", "_o").select(*folders, *names)
     .write.partitionBy(*folders).option("escape", '"').option("ignoreLeadingWhiteSpace", "false")
     .option("ignoreTrailingWhiteSpace", "false").csv(path))


def write_mail_corpus(spark: SparkSession, sf_dir: str, root: str, file_bytes: int = FILE_BYTES) -> None:
    """The e-mail rows as CSV files by kind (``row_idx % 4``) and box, see
    ``write_records``."""
    e = emails(spark, sf_dir).select("*", box_name(F.col("file_name")).alias("box"), F.col("row_idx").alias("_o"),
                                     (F.col("row_idx") % len(CSV_HEADERS)).alias("kind"))
    files = record_ranges(e, F.octet_length("body_snippet") + F.coalesce(F.octet_length("sanitized_body"), F.lit(0)), file_bytes)
    for kind, (header, columns) in enumerate(CSV_HEADERS):
        cells = e.where(F.col("kind") == kind).select(
            "kind", "box", "_o", *[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(columns)])
        write_records(cells, files.where(F.col("kind") == kind), header, f"{root}/kind={kind}", ["box"])


MAIL_CORPUS_SQL = EMAILS_SQL + """,
corpus AS (
  SELECT doc_kind AS kind, box, CAST(row_number() OVER (PARTITION BY doc_kind, box ORDER BY doc) AS BIGINT) AS row_idx, *
    EXCLUDE (doc_kind, box)
  FROM (SELECT row_idx AS doc, row_idx % 4 AS doc_kind, replace(file_name, '.csv', '') || ' é+box' AS box, * EXCLUDE (row_idx) FROM emails)
)"""


def write_url_csv(spark: SparkSession, sf_dir: str, path: str) -> None:
    """The URL list as one CSV file whose padded ``Url`` header is repeated."""
    u = url_list(spark, sf_dir)
    text = lambda c: F.col(c).cast("string")
    rows = u.select(text("url_id").alias("c0"), F.concat(F.lit("not this: "), text("url_id")).alias("c1"), F.lit("-").alias("c2"),
                    F.col("url").alias("c3"), F.col("url_id").alias("_o"))
    header = spark.range(1).select(*[F.lit(h).alias(f"c{i}") for i, h in enumerate(["id", " Url ", "note", " Url "])],
                                   F.lit(-1).cast("bigint").alias("_o"))
    (header.union(rows).coalesce(1).sortWithinPartitions("_o").drop("_o").write.option("escape", '"')
     .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path))


#: Documents of this remainder have an oversized field in their record.
OVERSIZED = (50, 3)


def write_oversized_corpus(spark: SparkSession, sf_dir: str, root: str, limit: int, file_bytes: int = FILE_BYTES) -> None:
    """The salted documents as CSV files ``kind=<doc_id % 8>/box=all``, see
    ``write_records``; some have a body of more than ``limit``
    characters, or a note of more, which no role reads."""
    mod, rest = OVERSIZED
    d = salted_documents(spark, sf_dir).select(
        (F.col("doc_id") % 8).alias("kind"), F.lit("all").alias("box"), F.col("doc_id").alias("_o"), F.coalesce("text", F.lit("")).alias("t"))
    long = F.col("_o") % mod == rest
    own = F.when(long & (F.col("_o") % 4 != 1), F.concat("t", F.repeat(F.lit("verify now "), limit // 11 + 1))).otherwise(F.col("t"))
    note = F.when(long & (F.col("_o") % 4 == 1), F.repeat(F.lit("n"), limit + 1)).otherwise(F.lit("n" * 10))
    cells = d.select("kind", "box", "_o", F.col("_o").cast("string").alias("c0"), own.alias("c1"), note.alias("c2"))
    n_bytes = F.octet_length("t") + F.when(long, F.lit(limit)).otherwise(F.lit(0))
    write_records(cells, record_ranges(d, n_bytes, file_bytes), ["subject", "body", "note"], root, ["kind", "box"])
