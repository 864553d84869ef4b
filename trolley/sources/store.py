"""Versioned table store and S5 (save / load the neighbour index) as parquet folders.

Each table version is an immutable parquet folder ``<root>/<table>/v=<n>``; a new state is
written as a new version, so lineage is cut by the write and an executor loss only re-runs the
tasks of the current version. Writing ``v=<n>`` with overwrite makes a replayed batch harmless.
Tables that a stream changes for a few keys at a time are delta tables (``sources.delta``). The root lives under the cluster's shared ``spark.checkpoint.dir`` unless a caller names another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INDEX_PARTS = ("interactions", "norms", "neighbors")


def version_path(root: str, table: str, version: int) -> str:
    return f"{root.rstrip('/')}/{table}/v={int(version)}"


def write_version(df: DataFrame, root: str, table: str, version: int) -> str:
    path = version_path(root, table, version)
    df.write.mode("overwrite").parquet(path)
    return path


def read_version(spark: SparkSession, root: str, table: str, version: int) -> DataFrame:
    return spark.read.parquet(version_path(root, table, version))


def filesystem(spark: SparkSession, path: str):
    """Hadoop file system and path object; works for any store that Spark can write to."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def version_exists(spark: SparkSession, root: str, table: str, version: int) -> bool:
    """Whether the version was committed. An unreachable store raises; it is not an absent version."""
    fs, path = filesystem(spark, f"{version_path(root, table, version)}/_SUCCESS")
    return bool(fs.exists(path))


def save_index(index: dict[str, DataFrame], k: int, path: str) -> None:
    """Write interactions, squared norms and neighbour lists, plus a one-row meta table."""
    spark = index["neighbors"].sparkSession
    for part in INDEX_PARTS:
        index[part].write.mode("overwrite").parquet(f"{path}/{part}")
    spark.createDataFrame([(int(k),)], "k int").write.mode("overwrite").parquet(f"{path}/meta")


def load_index(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], int]:
    parts = {part: spark.read.parquet(f"{path}/{part}") for part in INDEX_PARTS}
    k = spark.read.parquet(f"{path}/meta").first()["k"]
    return parts, int(k)
