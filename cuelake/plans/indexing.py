"""Dense 1-based numbering of a whole DataFrame without a single-partition
window (W4 without a limit).

The rows are range-partitioned and sorted by the order key, written to the
session's checkpoint folder (so partition ids are stable across the two
jobs that follow and survive executor loss), counted per partition (one
row per partition), and numbered as partition offset + position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def dense_index(df: DataFrame, order_col: str, name: str = "n") -> DataFrame:
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    tagged = (
        df.repartitionByRange(order_col)
        .sortWithinPartitions(order_col)
        .select("*", F.spark_partition_id().alias("_pid"), F.monotonically_increasing_id().alias("_mid"))
        .checkpoint(eager=True)
    )
    per_part = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    # One row per partition: a global window over it is tiny.
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("_pid", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    return (
        tagged.join(F.broadcast(offsets), "_pid")
        .select((F.col("_off") + local + 1).cast("bigint").alias(name), *df.columns)
    )
