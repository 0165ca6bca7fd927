"""Sinks (S8, S9, S10, S12, S13).

Outputs are written per run under ``<root>/<source>_<kind>/run_id=<YYYYmmdd_HHMMSS>``
so a later job finds every run by partition discovery (S11).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.lexicon import DEFAULT_LEXICON, EXTRA_COLUMNS, Lexicon


def run_path(root: str, source: str, run_id: str, kind: str = "csv") -> str:
    """``<root>/<source>_<kind>/run_id=<run_id>``: one folder per output kind,
    so reading ``<root>/<source>_csv`` discovers ``run_id`` as a column."""
    return f"{root.rstrip('/')}/{source}_{kind}/run_id={run_id}"


def staged(scan: DataFrame, path: str) -> tuple[DataFrame, dict[str, int]]:
    """Write a scan once and read it back, so that any number of sinks share
    one pass over the inputs; rows and errors are counted in that pass."""
    seen = Observation()
    error = F.coalesce(F.col("error"), F.lit(""))
    scan.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(error != "").alias("errors")).write.parquet(path)
    return scan.sparkSession.read.schema(scan.schema).parquet(path), seen.get


def latest_run(spark: SparkSession, base: str) -> str | None:
    """The greatest run id among the folders ``<base>/run_id=...``."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return None
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return max((n.removeprefix("run_id=") for n in names if n.startswith("run_id=")), default=None)


def read_latest(spark: SparkSession, root: str, source: str) -> DataFrame | None:
    """The flat CSV of a source's latest run, all columns as text, with
    ``run_id`` and ``run_file`` (the run's folder). No older run is read."""
    base = f"{root.rstrip('/')}/{source}_csv"
    run = latest_run(spark, base)
    if run is None:
        return None
    path = run_path(root, source, run)
    df = spark.read.option("header", "true").option("escape", '"').option("multiLine", "true").csv(path)
    return df.select("*", F.lit(run).alias("run_id"), F.lit(path).alias("run_file"))


def flat_csv(df: DataFrame, path: str, clean_newlines: bool = True) -> None:
    """A flat CSV with header; CR and LF inside text values become one
    space each (e-mail and image tables; the URL table keeps them)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if clean_newlines and isinstance(f.dataType, StringType):
            c = F.translate(c, "\r\n", "  ")
        cols.append(c.alias(f.name))
    df.select(*cols).write.mode("overwrite").option("header", "true").option("escape", '"') \
        .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)


def nested_json(df: DataFrame, path: str) -> None:
    """Full records as JSON lines (nested structs kept)."""
    df.write.mode("overwrite").json(path)


def text_lines(df: DataFrame, col: str, path: str) -> None:
    """One value per line, no header (the unredacted URL audit list)."""
    df.select(F.col(col).cast("string")).write.mode("overwrite").text(path)


def scan_records(scan: DataFrame, lexicon: Lexicon = DEFAULT_LEXICON, meta: bool = True) -> DataFrame:
    """Flat scan rows -> nested records: cues_total and extras (and meta)
    as structs, as the JSON output carries them."""
    cols = ["path", "status"]
    if "bytes" in scan.columns:
        cols.append("bytes")
    nested = [
        F.struct(*[F.col(f"sum_{c}").alias(c) for c in lexicon.names]).alias("cues_total"),
        F.struct(*[F.col(c) for c in EXTRA_COLUMNS]).alias("extras"),
    ]
    if meta:
        nested.insert(0, F.struct("subject", "from", "to", "date").alias("meta"))
    return scan.select(*cols, *nested[:1] if meta else [], "text_len", *nested[-2:], "error")
