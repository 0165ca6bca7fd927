"""Registered queries of the training-data operators: each applies its
operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, hmm_lm, jaccard_join, language_id, nn_descent, packing, phrase_graph, quality_rules, secret_scan,
               tool_calls, toxicity, vector_trie, warc)
from .common import held_out, scratch
from .oracle import ORACLE  # noqa: F401


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", held_out("doc_id", 7).alias("held_out"))
    return hmm_lm.score(docs, scratch(spark))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out("doc_id", 4).alias("held_out"))
    model = language_id.fit(docs.filter("not held_out").select("doc_id", "text", "lang"))
    return docs.select("doc_id", "held_out", language_id.language(model)("text").alias("p")).select("doc_id", "held_out", "p.*")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_table(spark, sf_dir, "documents").select("doc_id", "text"), scratch(spark)).select(
        "doc_id", "class_id", "n_links")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", held_out("doc_id", 4).alias("held_out"))
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit_joined(docs.filter("not held_out"), labels, scratch(spark))
    return docs.select("doc_id", "held_out", toxicity.toxicity(model)("text").alias("score")).withColumn(
        "predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(_table(spark, sf_dir, "documents"), scratch(spark))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_table(spark, sf_dir, "pages"), scratch(spark)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# The tools that the turns of ``conversations`` are read as calls of.
SCHEMAS = {
    "search": {"query": ("string", True), "limit": ("integer", True), "strict": ("boolean", False)},
    "summarise": {"query": ("string", True), "limit": ("integer", False)},
}


def derived_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results in the turns: a user turn calls a tool (by its
    length: unknown tools, missing fields and wrong types occur), the next
    assistant turn is the result. A call depends on the user turn two before
    within blocks of eight turns."""
    n = F.length("text")
    user = conversations.filter("role = 'user'")
    args = F.when(n % 7 == 0, F.to_json(F.struct(F.col("text").alias("query")))).when(
        n % 11 == 0, F.to_json(F.struct(F.col("text").alias("query"), F.col("text").alias("limit")))).when(
        n % 13 == 0, F.to_json(F.struct((n % 2 == 0).alias("strict"), F.col("text").alias("query"), n.alias("limit"), n.alias("depth")))
    ).otherwise(F.to_json(F.struct((n % 2 == 0).alias("strict"), F.col("text").alias("query"), n.alias("limit"))))
    calls = user.select(
        "conv_id", F.concat(F.lit("c"), F.col("turn").cast("string")).alias("call_id"), "turn",
        F.when(n % 5 == 0, "summarise").when(n % 17 == 0, "browse").otherwise("search").alias("name"), args.alias("arguments"),
        F.when(F.col("turn") % 8 >= 2, F.array(F.concat(F.lit("c"), (F.col("turn") - 2).cast("string"))))
        .otherwise(F.array().cast("array<string>")).alias("depends"))
    results = conversations.filter("role = 'assistant'").select(
        "conv_id", F.concat(F.lit("c"), (F.col("turn") - 1).cast("string")).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def op8_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = derived_calls(_table(spark, sf_dir, "conversations"))
    return tool_calls.link(calls, results, SCHEMAS, scratch(spark))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicates(_table(spark, sf_dir, "embeddings"), scratch(spark)).select(
        "vec_id", "n_links", "component_id", "kept")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op11_vector_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_trie.compress(_table(spark, sf_dir, "embeddings"), scratch(spark))
    return codes.select("vec_id", "code", "error", "label_error", F.lit(vector_trie.digest(books)).alias("codebooks_sha256"))


def op12_phrase_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_graph.phrases(_table(spark, sf_dir, "documents"), scratch(spark))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_lm_scoring, op2_language_id, op3_ngram_jaccard_join, op4_toxicity, op5_quality_rules, op6_byte_bpe, op7_warc,
    op8_tool_calls, op9_embedding_near_dedup, op10_packing, op11_vector_trie, op12_phrase_graph, op13_secret_scan)}
