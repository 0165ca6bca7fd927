"""E-mail CSV corpus.

Every CSV under a root is read with an all-string schema as wide as the widest
header and ``header=False``: the first record of each file is its header. Headers are
collected per file (one small row per file) and joined back, so files with
different headers need no driver-side loop and no per-header-group read.
A multi-line CSV file is not split, so ``monotonically_increasing_id`` gives
file order within a partition and ``mid - mid(header)`` is the 1-based row
index (blank lines skipped, as Python's csv module does).

Dialect: double quotes, ``""`` escape, quoted newlines; undecodable bytes
(U+FFFD) are dropped; a leading BOM is removed from the header.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions import text as T
from ..session import ensure_checkpoint_dir
from .tables import reusable
from ..functions.lexicon import SCAN_BODY_KEYS, SCAN_HTML_KEYS, SCAN_META_KEYS, SCAN_SUBJECT_KEYS

SCAN_GLOB = "*.[cC][sS][vV]"   # the scan: suffix compared case-insensitively
CENSUS_GLOB = "*.csv"          # the census: case-sensitive glob
BROADCAST_FILES = 200_000      # per-file header table broadcast up to this many files
FIELD_LIMIT = 131_072          # characters of a field beyond which a scanned record is an error


def _exists(spark: SparkSession, root: str) -> bool:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(path)


def list_files(spark: SparkSession, root: str, glob: str = SCAN_GLOB) -> DataFrame:
    """Every matching file, zero-byte ones included: file, file_name,
    length. A missing root gives an empty table.

    A scan leaves files without bytes out, so the paths come from the file
    index that the driver holds for any read, the lengths from a scan of the
    files' metadata."""
    schema = StructType([StructField("file", StringType()), StructField("file_name", StringType()),
                         StructField("length", LongType())])
    if not _exists(spark, root):
        return spark.createDataFrame([], schema)

    def files(fmt: str) -> DataFrame:
        return spark.read.format(fmt).option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)

    listed = spark.createDataFrame([(p,) for p in files("text").inputFiles()], "value string")
    # The index writes local paths as file:///, the scans as file:/.
    path = F.regexp_replace(F.url_decode(F.replace(F.col("value"), F.lit("+"), F.lit("%2B"))), "^file:///", "file:/")
    lengths = files("binaryFile").select(F.col("path").alias("file"), "length")
    return (listed.select(path.alias("file")).join(lengths, "file", "left")
            .select("file", F.regexp_extract("file", "[^/]*$", 0).alias("file_name"),
                    F.coalesce("length", F.lit(0)).cast("bigint").alias("length")))


def _raw(spark: SparkSession, root: str, glob: str, width: int) -> DataFrame:
    schema = StructType([StructField(f"_c{i}", StringType()) for i in range(width)])
    return (
        spark.read.schema(schema)
        .option("header", "false").option("multiLine", "true")
        .option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE")
        .option("encoding", "UTF-8").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob).option("ignoreCorruptFiles", "true")
        .option("maxCharsPerColumn", "-1").option("maxColumns", str(max(20480, 2 * width)))
        .csv(root)
    )


def header_width(spark: SparkSession, root: str, glob: str) -> int:
    """Number of columns of the widest header under ``root``.

    The commas of each file's first line bound it (an aggregate of one row per
    file over the first split of each file). Only if a header goes on over
    several lines is the bound doubled until no header fills its last column.
    Cells beyond its header's width belong to no column of a record.
    """
    lines = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
             .option("ignoreCorruptFiles", "true").text(root)
             .where((F.col("_metadata.file_block_start") == 0) & (F.trim("value") != "")))
    seen = lambda ch: F.length("value") - F.length(F.replace(F.col("value"), F.lit(ch), F.lit("")))
    mid = F.monotonically_increasing_id()
    first = (lines.select(F.col("_metadata.file_path").alias("file"), mid.alias("mid"), (seen(",") + 1).alias("n"),
                          (seen('"') % 2 == 1).alias("open"))
             .groupBy("file").agg(F.min_by(F.struct("n", "open"), "mid").alias("h"))
             .agg(F.max("h.n").alias("n"), F.max("h.open").alias("open")).first())
    width = first["n"] or 1
    if not first["open"]:
        return width
    while True:
        width *= 2
        last = F.col(f"_c{width - 1}")
        headers = (_raw(spark, root, glob, width).select(F.col("_metadata.file_path").alias("file"), mid.alias("mid"),
                                                         last.isNotNull().alias("full"))
                   .groupBy("file").agg(F.min_by("full", "mid").alias("full")))
        if headers.filter("full").isEmpty():
            return width


def _records(spark: SparkSession, root: str, glob: str, max_columns: int) -> DataFrame:
    raw = _raw(spark, root, glob, max_columns)
    # A literal replace per column (generated code), not a lambda over every slot.
    vals = F.array(*[F.replace(F.col(f"_c{i}"), F.lit("\ufffd"), F.lit("")) for i in range(max_columns)])
    # The metadata path is URI-encoded, the listing's is plain: decode, so both
    # spell a file alike ('+' stands for itself in a path).
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return raw.select(
        path.alias("file"),
        F.regexp_extract(path, "[^/]*$", 0).alias("file_name"),
        F.monotonically_increasing_id().alias("_mid"),
        vals.alias("vals"),
    )


def corpus_rows(spark: SparkSession, root: str, glob: str = SCAN_GLOB,
                max_columns: int | None = None, balance: bool = True) -> DataFrame:
    """S1 + S3: data records of every CSV with file, file_name, row_idx
    (1-based), the file's header array and the value array."""
    return read_corpus(spark, root, glob, max_columns, balance)[0]


def read_corpus(spark: SparkSession, root: str, glob: str = SCAN_GLOB,
                max_columns: int | None = None, balance: bool = True,
                columns: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows, headers): the data records and the per-file header table
    (``file`` and ``columns``).

    A multi-line CSV file is parsed by one task, so one file holding a third
    of the corpus would make that task do a third of all the regex work
    downstream. ``balance=True`` (default) round-robins the parsed records
    over the cluster once, after the row numbers are fixed; the shuffle costs
    far less than the per-row scan it spreads. Pass ``balance=False`` for a
    corpus of many similar files. ``max_columns`` saves the look at the headers
    where their greatest width is known.
    """
    schema = StructType([
        StructField("file", StringType()), StructField("file_name", StringType()),
        StructField("row_idx", LongType()), StructField("header", StringType()),
    ])
    if not _exists(spark, root):
        return spark.createDataFrame([], schema).select(
            "file", "file_name", "row_idx", F.array().cast("array<string>").alias("header"),
            F.array().cast("array<string>").alias("vals"),
            *[F.array().cast("array<int>").alias(c) for c in ("subj_pos", "body_pos", "html_pos")],
        ), spark.createDataFrame([], "file string, header array<string>").select("file", *columns)
    rec = _records(spark, root, glob, max_columns or header_width(spark, root, glob))
    hdr = rec.groupBy("file").agg(F.min_by("vals", "_mid").alias("_h"), F.min("_mid").alias("_mid0"))
    hdr = hdr.select(
        "file", "_mid0",
        # Header width = last non-null cell; a leading BOM is not part of the name.
        F.slice("_h", 1, F.greatest(F.size("_h") + 1 - F.array_position(
            F.reverse(F.transform("_h", lambda x: x.isNotNull())), F.lit(True)), F.lit(1))).alias("header"),
    ).select("file", "_mid0", F.transform("header", lambda h, i: F.when(
        i == 0, F.regexp_replace(h, "^\ufeff", "")).otherwise(h)).alias("header"))
    # Column roles (S4) once per file, on the one-row-per-file table.
    body = _positions(SCAN_BODY_KEYS)
    html = _positions(SCAN_HTML_KEYS)
    hdr = hdr.select(
        "file", "_mid0", "header",
        _positions(SCAN_SUBJECT_KEYS).alias("subj_pos"),
        F.when((F.size(body) == 0) & (F.size(html) == 0), _positions(exclude=SCAN_META_KEYS))
        .otherwise(body).alias("body_pos"),
        html.alias("html_pos"),
    )
    # One row per file, read by every user of the corpus: parsed for once.
    ensure_checkpoint_dir(spark)
    hdr = hdr.checkpoint(eager=True)
    n_files = len(rec._jdf.inputFiles())
    hdr_side = F.broadcast(hdr) if n_files <= BROADCAST_FILES else hdr
    rows = rec.join(hdr_side, "file").where(F.col("_mid") > F.col("_mid0")).select(
        "file", "file_name", (F.col("_mid") - F.col("_mid0")).alias("row_idx"), "header", "vals",
        "subj_pos", "body_pos", "html_pos")
    if balance:
        rows = reusable(rows)
    return rows, hdr.select("file", *columns)


def _last(name: Column) -> Column:
    """Position of the last header cell that spells ``name`` (0: none): of
    repeated headers the last one gives the value, as in a dict per record."""
    back = F.array_position(F.reverse(F.col("header")), name)
    return F.when(back > 0, F.size("header") + 1 - back).otherwise(0).cast("int")


def value_of(name: str) -> Column:
    """Value under the exact header ``name`` (NULL when absent, '' in a short row)."""
    pos = _last(F.lit(name))
    return F.when(pos > 0, F.coalesce(F.try_element_at(F.col("vals"), pos), F.lit("")))


def first_like(name: str) -> Column:
    """Position of the value under the first header equal to ``name`` after
    strip and lower-casing (NULL when there is none)."""
    return F.try_element_at(_positions([name]), F.lit(1))


def named_columns(rows: DataFrame, names: list[str]) -> DataFrame:
    """Exact-name view of the records (census): one column per wanted name."""
    return rows.select("file", "file_name", "row_idx", *[value_of(n).alias(n) for n in names])


def _positions(keys: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    idx = F.sequence(F.lit(1), F.greatest(F.size("header"), F.lit(1)))
    at = lambda i: F.try_element_at(F.col("header"), i)
    low = lambda i: F.lower(T.py_strip(at(i)))
    if keys is not None:
        found = F.filter(idx, lambda i: low(i).isin(*keys))
    else:
        found = F.filter(idx, lambda i: ~F.coalesce(low(i).isin(*exclude), F.lit(True)))
    return F.transform(found, lambda i: _last(at(i)))


def _pick(pos: Column) -> Column:
    return F.transform(pos, lambda i: F.coalesce(F.try_element_at(F.col("vals"), i), F.lit("")))


def field_error(limit: int) -> Column:
    """S14 per record: what is wrong with it ('' when nothing is). Any cell
    counts, whether or not a column role reads it."""
    too_long = F.exists(F.col("vals"), lambda v: F.length(v) > limit)
    return F.when(too_long, F.lit(f"field larger than field limit ({limit})")).otherwise(F.lit(""))


def scan_frame(rows: DataFrame, field_limit: int | None = None) -> DataFrame:
    """S4 + T8 per file header: (path, subject_raw, from, to, date, raw_text).
    The role positions come from the per-file header table.

    With a ``field_limit``, ``record_error`` follows: a record with a longer
    cell is marked and its cells are not taken up, the file's other records
    are as they would be without it."""
    checked = [] if field_limit is None else [field_error(field_limit).alias("record_error")]
    if checked:
        rows = rows.select("*", *checked)
        rows = rows.withColumn("vals", F.when(F.col("record_error") == "", F.col("vals")).otherwise(F.array().cast("array<string>")))
    subj, body, html = F.col("subj_pos"), F.col("body_pos"), F.col("html_pos")
    subj_vals = F.filter(_pick(subj), lambda v: v != "")
    body_vals = F.filter(_pick(body), lambda v: v != "")
    html_vals = F.transform(F.filter(_pick(html), lambda v: v != ""), lambda h: T.html_to_text(h))
    return rows.select(
        F.concat(F.col("file"), F.lit("#row="), F.col("row_idx").cast("string")).alias("path"),
        F.coalesce(F.try_element_at(subj_vals, F.lit(1)), F.lit("")).alias("subject_raw"),
        *[F.coalesce(value_of(k), F.lit("")).alias(k) for k in ("from", "to", "date")],
        F.concat_ws("\n", body_vals, html_vals).alias("raw_text"),
        *(["record_error"] if checked else []),
    )


def unreadable_files(spark: SparkSession, root: str, headers: DataFrame, glob: str = SCAN_GLOB) -> DataFrame:
    """Listed files with bytes that gave no record at all -> error rows
    (``headers`` is the per-file table of ``read_corpus``)."""
    files = list_files(spark, root, glob)
    seen = headers.select("file")
    return files.where(F.col("length") > 0).join(seen, "file", "left_anti").select(
        F.col("file").alias("path"), F.lit("error").alias("status"),
        F.lit("Failed to read CSV with utf-8 or latin-1").alias("error"))
