"""SQL-callable versions of the Column functions.

Each SQL function is derived from the Column function itself: the Column is
resolved against a one-column frame and Catalyst's SQL text of the resolved
expression becomes the body of a temporary SQL function. There is one
definition, and the function inlines into the caller's plan (JVM-side,
whole-stage codegen, subexpression elimination), with no Python involved.

    register_sql_functions(spark)
    spark.sql("SELECT c.*, h.* FROM (SELECT cue_totals(text) c, cue_heuristics(text) h FROM documents)")
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import text as T
from . import urls as U
from .cues import category_totals, cue_source
from .lexicon import DEFAULT_LEXICON, EXTRA_COLUMNS, Lexicon


def _sql_of(spark: SparkSession, fn: Callable[[Column], Column]) -> tuple[str, str]:
    base = spark.createDataFrame([], "x string")
    analyzed = base.select(fn(F.col("x")).alias("r"))._jdf.queryExecution().analyzed()
    expr = analyzed.projectList().apply(0).child()
    return expr.sql(), expr.dataType().sql()


def _cue_struct(lexicon: Lexicon, merged: bool) -> Callable[[Column], Column]:
    def build(x: Column) -> Column:
        sums = category_totals(cue_source(x, merged), lexicon)
        return F.struct(*[v.alias(k) for k, v in sums.items()])

    return build


def _heuristics_struct(x: Column) -> Column:
    h = T.heuristics(x)
    return F.struct(*[h[k].alias(k) for k in EXTRA_COLUMNS])


def sql_functions(lexicon: Lexicon = DEFAULT_LEXICON) -> dict[str, Callable[[Column], Column]]:
    return {
        "cue_normalize_text": T.normalize_text,
        "cue_html_to_text": T.html_to_text,
        "cue_normalize_subject": T.normalize_subject,
        "cue_deobfuscate": T.deobfuscate,
        "cue_redact_emails": T.redact_emails,
        "cue_extract_year": T.extract_year,
        "cue_text_length": T.text_length,
        "cue_tolerant_int": T.tolerant_int,
        "cue_normalize_url": U.normalize_url,
        "cue_mask_url": U.mask_url,
        "cue_url_apex": lambda x: U.apex(U.url_parts(x)["host"]),
        "cue_totals": _cue_struct(lexicon, merged=False),
        "cue_totals_merged": _cue_struct(lexicon, merged=True),
        "cue_heuristics": _heuristics_struct,
    }


def register_sql_functions(spark: SparkSession, lexicon: Lexicon = DEFAULT_LEXICON) -> list[str]:
    """Create the temporary SQL functions in ``spark``; returns their names."""
    names = []
    for name, fn in sql_functions(lexicon).items():
        body, rtype = _sql_of(spark, fn)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS {rtype} RETURN {body}")
        names.append(name)
    return names
