"""Session helpers: a local session for tests/bench and the shared checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "trolley",
                  event_log_dir: str | None = None) -> SparkSession:
    """Session for tests and the local benchmark. On a cluster, build the session there instead.

    AQE stays on so that joins against cohort tables turn into broadcasts only when the runtime
    size is under ``autoBroadcastJoinThreshold`` and skewed join keys get split.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.default.parallelism", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TROLLEY_DRIVER_MEMORY", "8g"))
        .config("spark.python.unix.domain.socket.enabled", "true")
    )
    if event_log_dir:   # stage and task times without the UI: Spark's event log in a scratch folder
        builder = builder.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", event_log_dir)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for written versions and streaming checkpoints.

    Reads ``spark.checkpoint.dir`` from the session (the cluster names a shared folder there), else
    the folder set on the context. Where both are unset, a local master gets a scratch folder, as in
    tests; on a cluster that is an error, since executors would not see it.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="trolley-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def parallelism(spark: SparkSession) -> int:
    """Number of task slots the plan should at least fill."""
    try:
        return int(spark.sparkContext.defaultParallelism)
    except Exception:  # pragma: no cover - connect sessions have no SparkContext
        return int(spark.conf.get("spark.sql.shuffle.partitions", "8"))


ROWS_PER_PARTITION = 250_000
INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
TASK_BYTES = 8 << 20
ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def _bytes_of(size: str) -> int:
    """A size of Spark's configuration (``64MB``, ``65536b``, ``1g``; a bare number is bytes) in bytes."""
    number, unit = re.fullmatch(r"(\d+)\s*([a-z]*)", size.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit.rstrip("b")[:1] or " ")


def size_shuffles(spark: SparkSession, rows: int) -> int:
    """Let shuffles start with a partition per ``ROWS_PER_PARTITION`` of the input, at least the session's number.

    With a fixed number a task's sort and hash memory grows with the input. Adaptive execution joins small
    partitions up to its advisory size, so the tables of a small input keep their few tasks. Never lowered.
    The advisory size is held to ``TASK_BYTES``: rows of two or three ids shuffle at some ten bytes and take
    200 and more in a hash table, so tasks of the default 64 MB hold gigabytes. Never raised.
    """
    if _bytes_of(spark.conf.get(ADVISORY)) > TASK_BYTES:
        spark.conf.set(ADVISORY, str(TASK_BYTES))
    now = int(spark.conf.get(INITIAL_PARTITIONS, None) or spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = -(-rows // ROWS_PER_PARTITION)
    if wanted > now:
        spark.conf.set(INITIAL_PARTITIONS, str(wanted))
    return max(now, wanted)


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Within, Spark deletes the shuffle files of an action when it ends: a written table needs none of them."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


_written: WeakKeyDictionary = WeakKeyDictionary()     # the folder of each table that is written here


def write_parts(spark: SparkSession, parts: Iterator[DataFrame]) -> DataFrame:
    """Write frames of one schema, one after the other, as one table in the shared checkpoint folder.

    The shuffles behind a part are gone before the next one starts.
    """
    path = f"{checkpoint_root(spark)}/tables/{uuid.uuid4().hex}"
    schema = None
    with shuffles_end(spark):
        for part in parts:
            part.write.mode("append").parquet(path)
            schema = part.schema
    out = spark.read.schema(schema).parquet(path)
    _written[out] = path
    return out


def materialize(df: DataFrame) -> DataFrame:
    """Write a reused intermediate as Parquet to the shared checkpoint folder and read it back.

    Cuts the lineage (an executor loss rereads the files instead of recomputing upstream), keeps
    several consumers from recomputing the same plan, and lets each read only its columns. The shuffles
    behind it are deleted. A table written here is not written again.
    """
    return df if df in _written else write_parts(df.sparkSession, iter([df]))


def discard(*tables: DataFrame) -> None:
    """Delete tables written here whose last reader has written its own."""
    from trolley.sources.store import filesystem
    for t in tables:
        fs, where = filesystem(t.sparkSession, _written.pop(t))
        fs.delete(where, True)
