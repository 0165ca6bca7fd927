"""Duplicate census of an e-mail corpus (T12-T15, A1-A8, W2, W3, L1, L2,
J3, J4).

Input: one row per CSV record with ``file`` (path key), ``file_name``,
``row_idx`` (1-based within the file) and the CSV columns under their exact
header names. Everything is grouped aggregation:

* signatures: one ``groupBy(from_domain, subject, content_sig)`` with
  algebraic aggregates (count, min year, min first-seen) -- partial
  aggregation before the shuffle, so a signature holding a third of all rows
  costs one row per map task;
* examples: only for the <= 250 reported signatures (broadcast semi-join),
  then ``row_number() <= 3`` which Catalyst turns into a map-side
  ``WindowGroupLimit``; no ``collect_list`` over an unbounded group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import reusable
from ..functions.lexicon import (
    CENSUS_BODY_KEYS, CENSUS_HTML_KEYS, CENSUS_SUBJECT_KEYS, EXAMPLE_SUBJECT_CHARS,
    MAX_EXAMPLES_PER_SIG, MIN_CONTENT_CHARS, TOP_DUP_CLUSTERS, UNIQUE_EXAMPLES, YEAR_MAX, YEAR_MIN,
)

SIG = ["from_domain", "normalized_subject", "content_sig"]


def _present(df: DataFrame, names: list[str]) -> list[Column]:
    cols = set(df.columns)
    return [F.col(f"`{n}`") for n in names if n in cols]


def _get(df: DataFrame, name: str) -> Column:
    return T.blank_to_empty(F.col(f"`{name}`")) if name in df.columns else F.lit("")


def signed_rows(df: DataFrame, lo: int = YEAR_MIN, hi: int = YEAR_MAX,
                min_content: int = MIN_CONTENT_CHARS) -> DataFrame:
    """Per-row census fields: email_like (T14), the signature (T15, NULL on
    rows that are not e-mail-like), year / year_source / date_out_of_range
    (T13, only on e-mail-like rows), the raw example subject, the sort key."""
    subj = T.first_present(_present(df, CENSUS_SUBJECT_KEYS))
    html = T.first_present(_present(df, CENSUS_HTML_KEYS))
    body = T.first_present(_present(df, CENSUS_BODY_KEYS))
    staged = df.select(
        "file", "file_name", "row_idx",
        subj.alias("_subj"), html.alias("_html"), body.alias("_body"),
        _get(df, "from_domain").alias("_from_domain"), _get(df, "date").alias("_date"),
    )
    email_like = (F.col("_subj") != "") | (F.col("_html") != "") | (F.col("_body") != "")
    content = F.when(F.col("_html") != "", T.html_to_text(F.col("_html"))).otherwise(F.col("_body"))
    # The normalised content in its own projection: it is read twice below
    # (length check, hash), and html strip + normalise must run once per row.
    staged = staged.select("*", T.normalize_text(content).alias("_norm"))
    norm = F.col("_norm")
    sig_hash = F.when(F.length(norm) < min_content, F.lit("")).otherwise(F.sha1(norm.cast("binary")))
    y = T.guess_year(F.col("_date"), F.col("file_name"), lo, hi)

    def on_email(c: Column) -> Column:
        return F.when(F.col("email_like"), c)

    return staged.select(
        "file", "file_name", "row_idx",
        F.split(F.col("file"), "/").alias("file_key"),
        email_like.alias("email_like"),
        on_email(F.lower(T.py_strip(F.col("_from_domain")))).alias("from_domain"),
        on_email(T.normalize_subject(F.col("_subj"))).alias("normalized_subject"),
        on_email(sig_hash).alias("content_sig"),
        on_email(y["year"]).alias("year"),
        on_email(y["year_source"]).alias("year_source"),
        on_email(y["date_out_of_range"]).alias("date_out_of_range"),
        F.substring(F.col("_subj"), 1, EXAMPLE_SUBJECT_CHARS).alias("example_subject"),
    )


def _year_int() -> Column:
    """The kept year as INT (NULL when none)."""
    return F.when(F.col("year") != "", F.col("year").try_cast("int"))


def shared(signed: DataFrame) -> DataFrame:
    """Pass the per-row table through one round-robin shuffle so several
    reports can read it: their plans then contain the same exchange and Spark
    reuses it, so the per-row work (html strip, normalise, sha1) runs once.
    The rows are small (no text), so this shuffle is cheap next to a second
    pass of per-row work."""
    return reusable(signed)


BROADCAST_FILES = 200_000


def with_scan_order(signed: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Replace the (file path components, row) scan order by one BIGINT
    ``order_key = file_rank << 32 | row_idx``.

    Files are ranked once by path components (``dense_index`` over the table
    of one row per file: range partitioned, no single-partition window) and
    joined back; the rank table is broadcast up to ``BROADCAST_FILES`` files
    (counted), a shuffle join beyond. With a numeric key the signature
    aggregate is hash-based instead of sorting every row by a struct.
    """
    from ..plans.indexing import dense_index

    f = (files if files is not None else signed).select("file").distinct()
    ranked = dense_index(f.select("file", F.split(F.col("file"), "/").alias("file_key")), "file_key", "file_rank")
    side = ranked.select("file", "file_rank")
    if side.count() <= BROADCAST_FILES:
        side = F.broadcast(side)
    order = F.shiftleft(F.col("file_rank").cast("bigint"), 32) + F.col("row_idx")
    return signed.join(side, "file").select(*signed.columns, order.alias("order_key"))


def _order_cols(df: DataFrame) -> list[str]:
    return ["order_key"] if "order_key" in df.columns else ["file_key", "row_idx"]


def signatures(signed: DataFrame) -> DataFrame:
    """A1 + A2 + W3: count, earliest year and first-seen position per signature."""
    first = (F.min("order_key") if "order_key" in signed.columns
             else F.min(F.struct("file_key", "row_idx")))
    return (
        signed.where("email_like")
        .groupBy(*SIG)
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.min(_year_int()).cast("string").alias("earliest_year"),
            first.alias("first_seen"),
        )
    )


def per_year(signed: DataFrame, sigs: DataFrame | None = None) -> DataFrame:
    """A3 + A4 + A5 + J4: raw rows, unique signatures (by earliest year) and
    estimated duplicates per year; years with either count.

    Both counts derive from one (signature, year) partial aggregate; its
    shuffle appears twice in the plan and Spark reuses it (one pass)."""
    sy = signed.where("email_like").groupBy(*SIG, "year").agg(F.count(F.lit(1)).alias("_n"))
    # No filter below the shared aggregate (it would be pushed into it and
    # break the reuse); the '' year is dropped after the join instead.
    raw = sy.groupBy("year").agg(F.sum("_n").alias("email_like_rows"))
    # sum(_n), used by the filter, keeps the aggregate over `sy` (a min-only
    # aggregate would let the optimizer drop `sy` here and the shuffle could
    # not be shared). Years are 4 ASCII digits: min over INT is exact and
    # hash-aggregates (a string min needs a sort-based aggregate).
    first = sy.groupBy(*SIG).agg(F.min(_year_int()).alias("_y"), F.sum("_n").alias("_rows"))
    uniq = first.where(F.col("_y").isNotNull() & (F.col("_rows") > 0)).groupBy(
        F.col("_y").cast("string").alias("year")).agg(F.count(F.lit(1)).alias("unique_emails"))
    j = raw.join(uniq, "year", "full")
    r = F.coalesce(F.col("email_like_rows"), F.lit(0)).cast("bigint")
    u = F.coalesce(F.col("unique_emails"), F.lit(0)).cast("bigint")
    return j.select(
        "year", r.alias("email_like_rows"), u.alias("unique_emails"),
        F.greatest(r - u, F.lit(0)).cast("bigint").alias("estimated_duplicates"),
    ).where(F.col("year") != "")


def per_file(signed: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Rows, e-mail-like rows and distinct signatures per file; files of
    the listing without rows get zeros (S15)."""
    sig = F.when(F.col("email_like"), F.struct(*SIG))
    agg = signed.groupBy("file").agg(
        F.count(F.lit(1)).alias("rows_total"),
        F.count_if(F.col("email_like")).alias("email_like_rows"),
        F.count_distinct(sig).alias("unique_signatures_in_file"),
    )
    if files is not None:
        agg = files.select("file").distinct().join(agg, "file", "left")
    return agg.select(
        "file",
        *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
          for c in ("rows_total", "email_like_rows", "unique_signatures_in_file")],
    )


def overall(signed: DataFrame, sigs: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """A7 + A8: one row of corpus totals and the year audit (one pass over
    the per-row table; the distinct signature count is a two-phase distinct
    aggregate)."""
    rows = signed.agg(
        F.count(F.lit(1)).alias("rows_total"),
        F.count_if(F.col("email_like")).alias("email_like_rows"),
        F.count_if(F.col("year_source") == "date_valid").alias("date_valid"),
        F.count_if(F.col("year_source") == "fallback_file").alias("fallback_file"),
        F.count_if(F.col("year_source") == "unknown").alias("unknown"),
        F.count_if(F.coalesce(F.col("date_out_of_range"), F.lit(False))).alias("date_out_of_range"),
        F.count_distinct(F.col("file")).alias("_files_with_rows"),
        F.count_distinct(F.when(F.col("email_like"), F.struct(*SIG))).alias("_unique"),
    )
    unique = F.col("_unique")
    n_files = files.select(F.count_distinct(F.col("file"))).scalar() if files is not None else F.col("_files_with_rows")
    e = F.col("email_like_rows")
    dup = F.greatest(e - unique, F.lit(0))
    rate = F.when(e > 0, F.bround(dup / e * 100.0, 2)).otherwise(F.lit(0.0))
    return rows.select(
        n_files.cast("bigint").alias("files_scanned"),
        F.col("rows_total").cast("bigint"),
        e.cast("bigint").alias("email_like_rows"),
        unique.cast("bigint").alias("unique_emails"),
        dup.cast("bigint").alias("estimated_duplicates"),
        rate.cast("double").alias("duplicate_rate_percent"),
        *[F.col(c).cast("bigint") for c in ("date_valid", "fallback_file", "unknown", "date_out_of_range")],
    )


def _with_examples(signed: DataFrame, chosen: DataFrame, render: Column, order: list[Column],
                   per_sig: int = MAX_EXAMPLES_PER_SIG) -> DataFrame:
    """W2 + J3: the chosen signatures (<= 250 rows, broadcast) joined to their
    rows, the first three examples of each in scan order (``row_number <= 3``
    becomes a map-side WindowGroupLimit) joined by ' | '. ``chosen`` is used
    once, so the signature aggregate is computed once."""
    attrs = ["count", "earliest_year", "first_seen"]
    rows = signed.where("email_like").join(F.broadcast(chosen.select(*SIG, *attrs)), SIG, "inner")
    scan_order = _order_cols(signed)
    w = Window.partitionBy(*SIG).orderBy(*scan_order)
    firsts = rows.select(*SIG, *attrs, *scan_order, render.alias("_ex"), F.row_number().over(w).alias("_rn"))
    firsts = firsts.where(F.col("_rn") <= per_sig)
    out = firsts.groupBy(*SIG).agg(
        *[F.first(c).alias(c) for c in attrs],
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("_rn", "_ex"))), lambda x: x["_ex"]), " | "
        ).alias("examples"),
    )
    # <= 250 rows: the final sort is bounded.
    return out.orderBy(*order)


def _show(c: str) -> Column:
    return F.when(F.col(c) == "", F.lit("-")).otherwise(F.col(c))


def top_duplicates(signed: DataFrame, sigs: DataFrame, top: int = TOP_DUP_CLUSTERS) -> DataFrame:
    """L1: the largest clusters (count >= 2; count desc, first seen)."""
    chosen = sigs.where(F.col("count") >= 2).orderBy(F.col("count").desc(), F.col("first_seen")).limit(top)
    ex = _with_examples(signed, chosen, F.concat(F.col("file_name"), F.lit(" :: "), F.col("example_subject")),
                        [F.col("count").desc(), F.col("first_seen")])
    return ex.select(
        F.col("count").cast("bigint"),
        _show("from_domain").alias("from_domain"),
        _show("normalized_subject").alias("normalized_subject"),
        F.substring(F.col("content_sig"), 1, 10).alias("content_hash_prefix"),
        F.coalesce(F.col("earliest_year"), F.lit("")).alias("earliest_year"),
        F.coalesce(F.col("examples"), F.lit("")).alias("examples"),
    )


def unique_examples(signed: DataFrame, sigs: DataFrame, n: int = UNIQUE_EXAMPLES) -> DataFrame:
    """L2: the first ``n`` signatures in first-seen order with example subjects."""
    chosen = sigs.orderBy("first_seen").limit(n)
    ex = _with_examples(signed, chosen, F.col("example_subject"), [F.col("first_seen")])
    return ex.select(
        _show("from_domain").alias("from_domain"),
        _show("normalized_subject").alias("normalized_subject"),
        F.substring(F.col("content_sig"), 1, 10).alias("content_hash_prefix"),
        F.coalesce(F.col("earliest_year"), F.lit("")).alias("earliest_year"),
        F.coalesce(F.col("examples"), F.lit("")).alias("example_subjects"),
    )


def year_audit(signed: DataFrame) -> DataFrame:
    """A8 in long form: e-mail-like rows per (year, year_source, date_out_of_range)."""
    return (
        signed.where("email_like")
        .groupBy("year", "year_source", "date_out_of_range")
        .agg(F.count(F.lit(1)).cast("bigint").alias("rows"))
    )


def overall_record(overall_df: DataFrame, per_year_df: DataFrame, input_dir: str = "", output_dir: str = "",
                   lo: int = YEAR_MIN, hi: int = YEAR_MAX) -> DataFrame:
    """A7 as the nested overall record: the folders, the totals, the sorted year list,
    per-year raw and unique maps, the year window and the year audit. The
    maps hold at most one entry per year of the window (a proven bound)."""
    years = per_year_df.select(F.struct(
        F.array_sort(F.collect_list("year")).alias("years"),
        F.map_from_entries(F.collect_list(F.struct("year", "email_like_rows"))).alias("per_year_raw"),
        F.map_from_entries(F.collect_list(F.struct("year", "unique_emails"))).alias("per_year_unique"),
    )).scalar()
    audit = ["date_valid", "fallback_file", "unknown", "date_out_of_range"]
    return overall_df.select(
        F.lit(input_dir).alias("input_dir"), F.lit(output_dir).alias("output_dir"),
        *[c for c in overall_df.columns if c not in audit],
        *[years[k].alias(k) for k in ("years", "per_year_raw", "per_year_unique")],
        F.struct(F.lit(lo).alias("min"), F.lit(hi).alias("max")).alias("year_window"),
        F.struct(*audit).alias("year_audit"),
    )


@dataclass
class CensusReport:
    per_year: DataFrame
    per_file: DataFrame
    top_duplicates: DataFrame
    unique_examples: DataFrame
    overall: DataFrame


def census(rows: DataFrame, files: DataFrame | None = None, stage: bool = False,
           lo: int = YEAR_MIN, hi: int = YEAR_MAX, top: int = TOP_DUP_CLUSTERS,
           unique: int = UNIQUE_EXAMPLES, numeric_order: bool = False) -> CensusReport:
    """All five census reports. ``stage=True`` checkpoints the per-row table
    and the signature table into the session's checkpoint folder first, so
    the five reports read them once instead of re-parsing the corpus.
    ``lo``/``hi`` is the year window, ``top``/``unique`` the report sizes;
    ``numeric_order`` ranks files once so the signature aggregate hashes."""
    signed = signed_rows(rows, lo, hi)
    if numeric_order:
        signed = with_scan_order(signed, files)
    if stage:
        signed = signed.checkpoint(eager=True)
    sigs = signatures(signed)
    if stage:
        sigs = sigs.checkpoint(eager=True)
    return CensusReport(
        per_year=per_year(signed, sigs),
        per_file=per_file(signed, files),
        top_duplicates=top_duplicates(signed, sigs, top),
        unique_examples=unique_examples(signed, sigs, unique),
        overall=overall(signed, sigs, files),
    )
