"""Screenshot scan (C7) over already extracted text.

OCR itself is not built (see README): the source is a table
``(path, ocr_text, error)``. Cue totals use the merged raw + normalised
semantics (C4); heuristics and text length use the raw text. Rows with an
``error`` stay in the output with zero counts, so one bad image never stops
the run and the summary counts it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.cues import add_category_totals
from ..functions.lexicon import DEFAULT_LEXICON, EXTRA_COLUMNS, Lexicon


def screenshot_scan(df: DataFrame, lexicon: Lexicon = DEFAULT_LEXICON) -> DataFrame:
    """(path, ocr_text, error) -> path, status, text_len, sum_*, heuristics, error."""
    failed = T.blank_to_empty(F.col("error")) != ""
    staged = df.select("path", F.col("ocr_text").alias("_t"), failed.alias("_failed"), F.col("error").alias("_err"))
    scored = add_category_totals(staged, "_t", lexicon, merged=True)
    h = T.heuristics(F.col("_t"))

    def ok(c):
        return F.when(F.col("_failed"), F.lit(0).cast("bigint")).otherwise(c)

    return scored.select(
        "path",
        F.when(F.col("_failed"), F.lit("error")).otherwise(F.lit("ok")).alias("status"),
        ok(T.text_length(F.col("_t"))).alias("text_len"),
        *[ok(F.col(c)).alias(c) for c in lexicon.sum_columns()],
        *[ok(h[k]).alias(k) for k in EXTRA_COLUMNS],
        F.when(F.col("_failed"), F.col("_err")).otherwise(F.lit("")).alias("error"),
    )
