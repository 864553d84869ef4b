"""Column-expression factories shared by the operators (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

# Reported doubles and ranking keys are snapped to a binary grid (2^-30 and 2^-34). Model weights are
# often short decimals (0.9^a * 0.7^b / 2), so a decimal rounding digit would sit exactly on a half
# and two engines that add in a different order would round to different sides; a binary grid point
# is never such a value, and x * 2^n is exact.
REPORT_SCALE = float(2 ** 30)
RANK_SCALE = float(2 ** 34)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def report(c: str | Column, scale: float = REPORT_SCALE) -> Column:
    """Snap a reported double to the 2^-30 grid so that engines that add in another order agree."""
    return F.round(col(c) * F.lit(scale)) / F.lit(scale)


def rank_key(c: str | Column) -> Column:
    """Sort key for scores that are sums of floats: equal up to 2^-34 counts as a tie."""
    return F.round(col(c) * F.lit(RANK_SCALE)) / F.lit(RANK_SCALE)


def top_n_window(partition: list[str], order: list[Column]):
    return Window.partitionBy(*partition).orderBy(*order)


def top_n(df, partition: list[str], order: list[Column], n: int, rank_col: str = "rank"):
    """Per-group top-n with a total order; Spark plans a ``WindowGroupLimit`` below the shuffle."""
    w = top_n_window(partition, order)
    return (df.withColumn(rank_col, F.row_number().over(w))
              .where(F.col(rank_col) <= n)
              .withColumn(rank_col, F.col(rank_col).cast("long")))


def change_label(old: str | Column, new: str | Column) -> Column:
    """Insert / Update / Delete for a full-outer-joined pair of values (null = absent)."""
    return (F.when(col(old).isNull(), F.lit("Insert"))
             .when(col(new).isNull(), F.lit("Delete"))
             .otherwise(F.lit("Update")))
