"""Structured Streaming form of the per-item scans.

The scans (C6 e-mails, C7 screenshots, the URL features) are stateless
Column projections, so they run unchanged on a streaming DataFrame: new files
landing in a folder are scanned incrementally and appended to a sink. The
stream's checkpoint lives under the session's shared checkpoint folder, so a
restarted query (or a lost executor) resumes without re-emitting rows.

Aggregating reports (census, summary) stay batch jobs: they need the whole
corpus and are cheap to re-run over the stored scan outputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.lexicon import DEFAULT_LEXICON, Lexicon
from ..operators.images import screenshot_scan
from ..operators.mail import mail_scan
from ..session import ensure_checkpoint_dir


def read_stream(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.load(path)


def scan_of(source: DataFrame, kind: str, lexicon: Lexicon = DEFAULT_LEXICON) -> DataFrame:
    """``kind`` is 'mail' (named e-mail columns plus ``path``) or
    'screenshots' (path, ocr_text, error)."""
    if kind == "mail":
        return mail_scan(source, lexicon=lexicon)
    if kind == "screenshots":
        return screenshot_scan(source, lexicon)
    raise ValueError(f"unknown scan kind: {kind}")


def run_available(spark: SparkSession, source: DataFrame, kind: str, sink_path: str, checkpoint: str,
                  sink_format: str = "parquet", lexicon: Lexicon = DEFAULT_LEXICON) -> None:
    """Scan what has arrived since the last run with this checkpoint, then end.
    Interrupted, the next run goes on where the checkpoint stands; a file
    sink's log shows every row once."""
    query = (scan_of(source, kind, lexicon).writeStream.outputMode("append").format(sink_format)
             .option("checkpointLocation", checkpoint).option("path", sink_path).trigger(availableNow=True).start())
    query.awaitTermination()


def start_scan(spark: SparkSession, source: DataFrame, kind: str, sink_path: str, name: str,
               sink_format: str = "parquet", lexicon: Lexicon = DEFAULT_LEXICON,
               trigger_seconds: int | None = None) -> StreamingQuery:
    """Start an append-mode scan that runs until it is stopped."""
    out = scan_of(source, kind, lexicon)
    ckpt = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}"
    w = (out.writeStream.queryName(name).outputMode("append").format(sink_format)
         .option("checkpointLocation", ckpt))
    if trigger_seconds:
        w = w.trigger(processingTime=f"{trigger_seconds} seconds")
    if sink_format != "memory":
        w = w.option("path", sink_path)
    return w.start()
