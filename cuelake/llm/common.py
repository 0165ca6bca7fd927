"""Helpers that several training-data operators share: staging on shared
storage, split columns, and connected components."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder; removed when the
    driver process ends normally."""
    path = f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder by Spark's file system layer. At exit the JVM
    may be gone already; the folder then stays for the cluster's clean-up."""
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception as e:  # noqa: BLE001
        print(f"scratch folder {path} not removed: {type(e).__name__}")


def stage(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write ``df`` once to shared storage and read it back: cuts the lineage,
    so a lost executor costs a reread and never a recomputation."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(),
          "binary": pa.binary(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64()),
          "array<int>": pa.list_(pa.int32()), "array<float>": pa.list_(pa.float32())}


def map_batches(df: DataFrame, fn: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` over plain lists: ``fn`` gets an iterator of
    ``{column: list}`` (nulls are None, 64-bit ids stay exact) and yields the
    same for ``schema`` (``name type, ...``). A partition streams batch by batch."""
    fields = [f.strip().split(" ", 1) for f in schema.split(",")]
    out = pa.schema([(n, _ARROW[t]) for n, t in fields])

    def run(batches):
        for cols in fn({c: b.column(c).to_pylist() for c in b.schema.names} for b in batches):
            yield pa.record_batch([pa.array(cols[f.name], type=f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


class Cache(dict):
    """A bounded cache. Full, it takes nothing new until ``capacity`` more
    misses show that its content is out of date; then it starts again."""

    def __init__(self, capacity: int):
        super().__init__()
        self.capacity, self.refused = capacity, 0

    def keep(self, key, value):
        if len(self) < self.capacity:
            self[key] = value
        else:
            self.refused += 1
            if self.refused > self.capacity:
                self.clear()
                self.refused = 0
        return value


def held_out(doc_id: Column | str, mod: int, remainder: int = 2) -> Column:
    """crc32 of the id as text, modulo ``mod``, equals ``remainder``. A null
    id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % mod == remainder


def components(edges: DataFrame, folder: str, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list (BIGINT columns):
    ``(id, component)`` for every id that has an edge, component = least id.

    Min-label propagation with pointer jumping; a round halves the remaining
    distance along label chains, so long chains need few rounds. Each round is
    written to shared storage. The driver sees one count per round.
    """
    both = stage(edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
                 .union(edges.select(F.col(b), F.col(a))).distinct(), folder, "edges")
    state = stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component"))
                  .withColumnRenamed("a", "id"), folder, "label-0")
    n = 0
    while True:
        n += 1
        s = state.select(F.col("id").alias("b"), F.col("component").alias("_c"))
        near = both.join(s, "b").groupBy(F.col("a").alias("id")).agg(F.min("_c").alias("_n"))
        low = state.join(near, "id").select("id", "component", F.least("component", "_n").alias("_l"))
        up = state.select(F.col("id").alias("_l"), F.col("component").alias("_u"))
        new = stage(low.join(up, "_l").select("id", F.col("component").alias("_old"),
                                              F.least("_l", "_u").alias("component")), folder, f"label-{n}")
        if new.filter("component <> _old").isEmpty():
            return new.select("id", "component")
        state = new.select("id", "component")
