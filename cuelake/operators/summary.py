"""Summary over scan outputs.

Input: the stored scan tables of several sources, as text (like the CSVs
the jobs write), each with ``source`` and ``run_id`` (``YYYYmmdd_HHMMSS``).
Only the latest run of every source counts (S11). Numbers are read tolerantly
(T16) and summed per run; one ``rollup`` over the latest runs gives the
per-source rows and the TOTAL row (A9 + A10).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicon import DEFAULT_LEXICON, EXTRA_COLUMNS, Lexicon

#: Sources in the order of the report.
SOURCES = ("images", "emails", "urls")
TOTAL_LABEL = "TOTAL"
TOTAL_TIMESTAMP = "—"


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """Stack scan outputs with different column sets by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def rollup_sources(rows: DataFrame, lexicon: Lexicon = DEFAULT_LEXICON) -> DataFrame:
    """A9 + A10: per source n_items, errors, sums of the category columns and
    the heuristics (a column a source lacks counts 0), then a TOTAL row."""
    cols = set(rows.columns)
    wanted = lexicon.sum_columns() + EXTRA_COLUMNS

    def num(c):
        return T.tolerant_int(F.col(c)) if c in cols else F.lit(0).cast("bigint")

    err = T.is_blank(F.col("error")) if "error" in cols else F.lit(True)
    # All runs are summed in one pass over the rows (one row per run and file,
    # hash-aggregated); the choice of the latest run (S11) and the rollup see
    # those few rows only.
    place = ["run_file"] if "run_file" in cols else []
    per_file = rows.where(F.col("source").isNotNull() & F.col("run_id").isNotNull()).groupBy("source", "run_id", *place).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_items"),
        F.count_if(~err).cast("bigint").alias("errors"),
        *[F.sum(num(c)).cast("bigint").alias(c) for c in wanted],
    )
    newest = Window.partitionBy("source").orderBy(F.col("run_id").desc())
    latest = per_file.select("*", F.rank().over(newest).alias("_n")).where(F.col("_n") == 1)
    agg = latest.rollup("source").agg(
        F.max("run_id").alias("_ts"), *[F.max(c).alias("_file") for c in place],
        *[F.sum(c).cast("bigint").alias(c) for c in ["n_items", "errors", *wanted]],
        F.grouping("source").alias("_g"),
    )
    total = F.col("_g") == 1
    return agg.select(
        F.when(total, F.lit(TOTAL_LABEL)).otherwise(F.col("source")).alias("source"),
        *([F.when(total, F.lit(TOTAL_TIMESTAMP)).otherwise(F.col("_file")).alias("file")] if place else []),
        F.when(total, F.lit(TOTAL_TIMESTAMP)).otherwise(F.col("_ts")).alias("timestamp"),
        "n_items",
        "errors",
        *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in wanted],
    )


def _place(source: Column) -> Column:
    known = F.array_position(F.array(*[F.lit(s) for s in SOURCES]), source)
    return F.when(source == TOTAL_LABEL, len(SOURCES) + 2).when(known > 0, known).otherwise(len(SOURCES) + 1)


def ordered(summary: DataFrame) -> DataFrame:
    """The summary (one row per source and TOTAL) in one file: sources in
    their order, then TOTAL."""
    return summary.coalesce(1).sortWithinPartitions(_place(F.col("source")), "source")


def summary_record(summary: DataFrame, lexicon: Lexicon = DEFAULT_LEXICON) -> DataFrame:
    """The same as one nested record: ``sources`` (array) and ``overall``."""
    body = [F.col("n_items"), F.col("errors"), F.struct(*[F.col(f"sum_{c}").alias(c) for c in lexicon.names]).alias("totals"),
            F.struct(*EXTRA_COLUMNS).alias("extras")]
    one = F.struct("source", *(["file"] if "file" in summary.columns else []), "timestamp", *body)
    total = F.col("source") == TOTAL_LABEL
    placed = F.struct(_place(F.col("source")).alias("p"), one.alias("r"))
    return summary.agg(
        F.transform(F.array_sort(F.collect_list(F.when(~total, placed))), lambda x: x["r"]).alias("sources"),
        F.first(F.when(total, F.struct(*body)), ignorenulls=True).alias("overall"),
    )
