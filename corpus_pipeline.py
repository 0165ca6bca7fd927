"""Corpus pipeline: language identification, quality rules, near-duplicate
removal, packing. ``run(spark, sf_dir)`` applies the stages to ``documents``;
each result is written as Parquet to the shared folder and read again as the
next stage's documents.

Every stage works on all rows it gets. A row that a stage keeps has all its
columns, whatever their names. Null, empty and wordless texts are rejected by
the language stage; an empty table passes every stage as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm import jaccard_join, language_id, packing, quality_rules
from cuelake.llm.common import held_out, scratch, stage

#: A document whose language is less certain goes.
LEAST_LANGUAGE_SCORE = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of undetermined or too uncertain language (operator 2)."""
    model = language_id.fit(docs.filter(~held_out("doc_id", 4)).select("doc_id", "text", "lang"))
    seen = docs.select(F.struct("*").alias("row"), language_id.language(model)("text").alias("p"))
    return seen.filter((F.col("p.lang_pred") != language_id.UNDETERMINED) & (F.col("p.score") >= LEAST_LANGUAGE_SCORE)).select("row.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base rules or are outliers (operator 5)."""
    return quality_rules.kept_rows(docs, scratch(spark))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate class (operator 3)."""
    return jaccard_join.join(docs, scratch(spark)).filter("kept").select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the remaining documents into sequences (operator 10)."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language_stage), ("quality", quality_stage), ("dedup", dedup_stage), ("packing", packing_stage)]

#: SQL can't express the language model or the tokenizer: tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch(spark)
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), folder, name)
    return docs
