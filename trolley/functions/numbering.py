"""Row numbers within a key that never put one key's rows into a single task.

``Window.partitionBy(key).orderBy(...)`` sorts all rows of a key in one task; a key holding a
third of all rows makes that task a third of the job. Here the rows are range-partitioned on
(key, order...), so a large key spans several partitions. Each partition numbers its own rows of
the key, and a small table of per-(partition, key) counts, at most one row per partition a key
touches, gives each partition the number of the key's rows in earlier partitions.

The partition id is taken once and materialised with the rows, which fixes the assignment that
both consumers read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trolley.session import materialize


def row_numbers(df: DataFrame, key: str, order: list[str | Column], name: str = "position") -> DataFrame:
    """``df`` plus ``name`` = 1-based row number of each row within its key, by ``order``.

    The number of ranges follows ``spark.sql.shuffle.partitions`` and adaptive execution.
    """
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = materialize(df.repartitionByRange(F.col(key), *order_cols)
                         .withColumn("_pid", F.spark_partition_id()))
    local = ranged.withColumn("_local", F.row_number().over(
        Window.partitionBy("_pid", key).orderBy(*order_cols)))
    counts = ranged.groupBy("_pid", key).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", key, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (local.join(offsets, ["_pid", key])
            .withColumn(name, (F.col("_local") + F.col("_off")).cast("long"))
            .drop("_pid", "_local", "_off"))
