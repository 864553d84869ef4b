"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from trolley.session import checkpoint_root, shuffles_end
from trolley.sources.store import filesystem

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _written(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    with shuffles_end(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a reused intermediate to the shared checkpoint folder and read it back.

    The files cut the lineage: a lost executor makes Spark reread them, not recompute upstream.
    """
    return _written(df, f"{checkpoint_root(df.sparkSession)}/llm/{name}-{uuid.uuid4().hex}")


class Scratch:
    """Written intermediates with an owner: ``drop`` deletes a table when its last reader has written its own."""

    def __init__(self, spark: SparkSession, name: str):
        self.root = f"{checkpoint_root(spark)}/llm/{name}-{uuid.uuid4().hex}"
        self.held: dict[int, tuple[DataFrame, str]] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        out = _written(df, path)
        self.held[id(out)] = out, path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _, path = self.held.pop(id(t))
            fs, where = filesystem(t.sparkSession, path)
            fs.delete(where, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII text takes the fast built-in; other text keeps its É as É."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, ASCII_UPPER, ASCII_UPPER.lower()))


def words_of(text: Column, separators: str) -> Column:
    """The words between runs of separator characters; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), separators), lambda w: w != "")


def digest128(*cols: Column) -> Column:
    """Two independently seeded 64-bit hashes as one struct: the identity of a text."""
    return F.struct(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit("second"), *cols).alias("b"))


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint only after counting the rows; a larger side is joined by shuffling.

    ``df`` must be written (see ``materialize``) so that counting is cheap and the size is final.
    """
    return F.broadcast(df) if df.count() <= max_rows else df


def slices(batch: pa.RecordBatch, text_col: str, max_chars: int) -> Iterator[pa.RecordBatch]:
    """Consecutive pieces of an Arrow batch: each holds one row or up to ``max_chars`` of text."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.utf8_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    piece = size.cumsum() // max_chars
    cuts = np.flatnonzero(np.diff(piece)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        yield batch.slice(lo, hi - lo)


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, max_chars: int = 8_000_000,
                text_col: str = "text") -> DataFrame:
    """``fn`` over bounded pieces of each Arrow batch: a piece holds one row or up to ``max_chars``.

    Long columns reach ``fn`` as pandas ``Int64``, so ids beside a null and ids over 2^53 stay exact.
    """
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, max_chars):
                out = fn(part.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get))
                yield pa.RecordBatch.from_pandas(out, schema=target, preserve_index=False)

    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, mask: Callable[[list], np.ndarray], max_chars: int = 8_000_000,
              text_col: str = "text") -> DataFrame:
    """Rows whose text ``mask`` accepts; every column passes as Arrow, so no value is converted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, max_chars):
                yield part.filter(pa.array(mask(part.column(text_col).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def bitmap(keys: DataFrame, hash_col: str, log2_bits: int = 22) -> DataFrame:
    """``(word, bits)``: a bitmap of 64-bit hashes. Its size is fixed: at most 2^(log2_bits-6) rows."""
    at = F.pmod(F.col(hash_col), F.lit(1 << log2_bits))
    return (keys.select((at / 64).cast("long").alias("word"), (at % 64).cast("int").alias("bit"))
            .groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")))


def split_by_bitmap(df: DataFrame, hash_col: str, bits: DataFrame, log2_bits: int = 22) -> DataFrame:
    """``df`` plus boolean ``maybe``: false only for hashes that were not among the bitmap's keys.

    The bitmap is broadcast; its size does not depend on the data.
    """
    at = F.pmod(F.col(hash_col), F.lit(1 << log2_bits))
    side = F.broadcast(bits.withColumnRenamed("word", "bitmap_word").withColumnRenamed("bits", "bitmap_bits"))
    hit = F.expr(f"coalesce((shiftrightunsigned(bitmap_bits, cast(pmod({hash_col}, {1 << log2_bits}L) % 64 as int)) & 1) = 1, false)")
    return (df.join(side, (at / 64).cast("long") == F.col("bitmap_word"), "left")
            .withColumn("maybe", hit).drop("bitmap_word", "bitmap_bits"))
