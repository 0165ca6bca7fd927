"""E-mail scan (C6): column roles (S4), text assembly (T8), MIME subjects
(T6), de-obfuscation, cue totals, heuristics and redaction (T4, C2/C3, T9,
T5) in one narrow projection -- no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import mime
from ..functions import text as T
from ..functions.cues import add_category_totals
from ..functions.lexicon import (
    DEFAULT_LEXICON, EXTRA_COLUMNS, SCAN_BODY_KEYS, SCAN_HTML_KEYS, SCAN_META_KEYS,
    SCAN_SUBJECT_KEYS, Lexicon,
)


@dataclass(frozen=True)
class Roles:
    subject: list[str]
    body: list[str]
    html: list[str]


def scan_roles(columns: list[str]) -> Roles:
    """Roles from header names (stripped, lower-cased); original spelling
    kept. Without a body and an html column every non-meta column is body."""
    low = [c.strip().lower() for c in columns]
    subj = [c for c, lc in zip(columns, low) if lc in SCAN_SUBJECT_KEYS]
    body = [c for c, lc in zip(columns, low) if lc in SCAN_BODY_KEYS]
    html = [c for c, lc in zip(columns, low) if lc in SCAN_HTML_KEYS]
    if not body and not html:
        body = [c for c, lc in zip(columns, low) if lc not in SCAN_META_KEYS]
    return Roles(subj, body, html)


def _nonempty(c: Column) -> Column:
    return F.when(T.blank_to_empty(c) != "", c)


def first_nonempty(cols: list[Column]) -> Column:
    """First value that is not '' (``if val:``), or ''."""
    if not cols:
        return F.lit("")
    return F.coalesce(*[_nonempty(c) for c in cols], F.lit(""))


def assemble_text(body: list[Column], html: list[Column]) -> Column:
    """Non-empty body values in header order, then every non-empty html
    value through T1 (kept even when it strips to ''), joined by newlines."""
    parts = [_nonempty(c) for c in body] + [F.when(T.blank_to_empty(c) != "", T.html_to_text(c)) for c in html]
    if not parts:
        return F.lit("")
    return F.concat_ws("\n", *parts)


@F.pandas_udf(StringType())
def _decode_mime_udf(s: pd.Series) -> pd.Series:
    from email.header import decode_header, make_header

    def one(v):
        if v is None:
            return None
        try:
            return str(make_header(decode_header(v)))
        except Exception:
            return v

    return s.map(one)


def decode_mime(subject: Column) -> Column:
    """RFC 2047 words decoded.

    Column functions decode UTF-8, ASCII and the single-byte charsets. The
    Python library sees what they don't cover: multi-byte East Asian charsets,
    folded headers, malformed words. A Python UDF is evaluated for every row of
    its batch, whatever condition surrounds it, so all other rows send a NULL
    (one bit in the Arrow batch) and keep their value JVM-side."""
    encoded = subject.contains("=?") & subject.rlike(mime.WORD)
    direct = encoded & mime.covered(subject)
    rest = encoded & ~mime.covered(subject)
    return (F.when(direct, mime.decode_words(subject)).when(rest, _decode_mime_udf(F.when(rest, subject)))
            .otherwise(subject))


def scan_frame(df: DataFrame, roles: Roles | None = None, path: Column | None = None) -> DataFrame:
    """Project named e-mail columns to (path, subject_raw, from, to, date, raw_text)."""
    roles = roles or scan_roles([c for c in df.columns if c not in ("path",)])
    cols = set(df.columns)
    return df.select(
        (path if path is not None else F.col("path")).alias("path"),
        first_nonempty([F.col(f"`{c}`") for c in roles.subject]).alias("subject_raw"),
        (T.blank_to_empty(F.col("`from`")) if "from" in cols else F.lit("")).alias("from"),
        (T.blank_to_empty(F.col("`to`")) if "to" in cols else F.lit("")).alias("to"),
        (T.blank_to_empty(F.col("`date`")) if "date" in cols else F.lit("")).alias("date"),
        assemble_text([F.col(f"`{c}`") for c in roles.body], [F.col(f"`{c}`") for c in roles.html]).alias("raw_text"),
    )


def finish_scan(frame: DataFrame, lexicon: Lexicon = DEFAULT_LEXICON, mime: bool = True) -> DataFrame:
    """From (path, subject_raw, from, to, date, raw_text) to the scan rows:
    path, status, bytes, text_len, subject, from, to, date, sum_*, heuristics,
    error. A record with a ``record_error`` keeps its path, status ``error``
    and that text; all else of it is null."""
    failed = F.col("record_error") != "" if "record_error" in frame.columns else None

    def ok(c: Column) -> Column:
        return c if failed is None else F.when(~failed, c)

    staged = frame.select(
        "*",
        T.deobfuscate(F.col("raw_text")).alias("_text"),
        (decode_mime(F.col("subject_raw")) if mime else F.col("subject_raw")).alias("_subject"),
    )
    with_sums = add_category_totals(staged, "_text", lexicon, merged=False)
    h = T.heuristics(F.col("_text"))
    return with_sums.select(
        "path",
        (F.lit("ok") if failed is None else F.when(failed, F.lit("error")).otherwise(F.lit("ok"))).alias("status"),
        ok(F.lit(0).cast("bigint")).alias("bytes"),
        ok(T.text_length(F.col("raw_text"))).alias("text_len"),
        ok(T.redact_emails(F.col("_subject"))).alias("subject"),
        ok(T.redact_emails(F.col("from"))).alias("from"),
        ok(T.redact_emails(F.col("to"))).alias("to"),
        ok(F.col("date")).alias("date"),
        *(lexicon.sum_columns() if failed is None else [ok(F.col(c)).alias(c) for c in lexicon.sum_columns()]),
        *[ok(h[k]).alias(k) for k in EXTRA_COLUMNS],
        (F.lit("") if failed is None else F.col("record_error")).alias("error"),
    )


def mail_scan(df: DataFrame, path: Column | None = None, lexicon: Lexicon = DEFAULT_LEXICON,
              mime: bool = True) -> DataFrame:
    """C6 over a DataFrame of named e-mail columns (one header group)."""
    return finish_scan(scan_frame(df, path=path), lexicon, mime)
