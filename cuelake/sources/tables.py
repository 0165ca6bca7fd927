"""Table sources: parquet tables, the screenshot-text table (S6) and the
stored-crawl table (S7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parallelism(spark: SparkSession) -> int:
    """Cores of the cluster (default parallelism), or the shuffle partition
    count where the context is not reachable (Spark Connect)."""
    try:
        return int(spark.sparkContext.defaultParallelism)
    except Exception:
        return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Make sure CPU-heavy per-row work (the phrase regexes) gets at least one
    task per core.

    Small inputs (a parquet file of one row group is one split) would run on a
    single task; they are round-robin repartitioned to the default
    parallelism. Large inputs already have more splits than cores and are
    returned unchanged, so no shuffle is added at scale.
    """
    if df.isStreaming:
        return df
    spark = df.sparkSession
    target = min_partitions or parallelism(spark)
    try:
        splits = df.rdd.getNumPartitions()
    except Exception:      # no RDD view (Spark Connect): leave it to the planner
        return df
    return df.repartition(target) if splits < target else df


def reusable(df: DataFrame) -> DataFrame:
    """Pass a narrow, expensive-to-compute table through one round-robin
    shuffle so that several branches of one plan read the same exchange
    (Spark reuses it) instead of recomputing the per-row work."""
    spark = df.sparkSession
    n = max(parallelism(spark), int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    return df.repartition(n)


def read_parquet(spark: SparkSession, path: str, spread_rows: bool = True) -> DataFrame:
    df = spark.read.parquet(path)
    return spread(df) if spread_rows else df


# --- fixed values: image suffixes of the screenshot folder (any case) ---
IMAGE_SUFFIXES = [".png", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff", ".webp"]


def _ci_glob(suffixes: list[str]) -> str:
    pats = ["".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s) for s in suffixes]
    return "*{" + ",".join(pats) + "}"


def list_images(spark: SparkSession, root: str) -> DataFrame:
    """S2 for screenshots: every image file under ``root`` (7 suffixes, any
    case), without reading the bytes (the content column is pruned)."""
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
          .option("pathGlobFilter", _ci_glob(IMAGE_SUFFIXES)).load(root))
    return df.select(F.col("path"), F.col("length").cast("bigint"))


def screenshot_text(spark: SparkSession, path: str, images_root: str | None = None) -> DataFrame:
    """S6 (re-aimed): extracted screenshot text ``(path, ocr_text, error)``.

    With ``images_root``, every listed image without a text row becomes an
    error row (S14), so a failed extraction is counted, not lost.
    """
    df = spark.read.parquet(path).select("path", "ocr_text", "error")
    if images_root is None:
        return df
    missing = list_images(spark, images_root).join(df.select("path"), "path", "left_anti")
    return df.unionByName(missing.select(
        "path", F.lit(None).cast("string").alias("ocr_text"), F.lit("no extracted text").alias("error")))
