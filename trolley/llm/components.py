"""Connected components by alternating star contraction, fully distributed.

Each round connects every node to the smallest node it knows: first its larger neighbours
(large star), then its smaller ones (small star). Only aggregates and joins are used, so a hub with
a third of all links is summed map-side and its join partition is split by adaptive execution.
Every round is written to the shared checkpoint folder, and the round before deleted; only two
numbers come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trolley.llm.common import Scratch


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    return (low.select("u", F.col("m").alias("v"))
            .unionByName(down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))))


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``links(u, v)``; root is the component's smallest node.

    Nodes are any orderable type. Self links and repeated links change nothing; nodes without a
    link to another node are absent (their root is themselves). An empty table gives no rows.
    """
    scratch = Scratch(links.sparkSession, "components")
    e = scratch.write(links.where("u is not null and v is not null and u <> v").select("u", "v").distinct(), "links")
    before = None
    for _ in range(max_rounds):
        state = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (state["n"], state["x"]) == before or state["n"] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        before = (state["n"], state["x"])
        big = _large_star(e).where("u <> v").distinct()
        last, e = e, scratch.write(_small_star(big).where("u <> v").distinct(), "links")
        scratch.drop(last)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
