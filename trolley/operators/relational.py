"""The relational questions asked of the purchase tables, set-oriented.

Where the reference formats a user list into ``IN (...)``, these take a DataFrame of users or of
``(cohort_id, user_id)`` rows and use a semi join; AQE turns it into a broadcast only when its
runtime size is under the broadcast threshold. Scenario aisle sets come from the fixed catalogue
(a handful of literals), so they are plain ``IN`` filters on the product side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trolley.functions.expressions import top_n
from trolley.schema import TEST_SCENARIOS
from trolley.sources.purchases import Purchases, lines


def _aisles(scenario: str | tuple[int, ...], catalogue) -> list[int]:
    """A scenario is a name in the catalogue of the purchase tables, or its aisles themselves."""
    if isinstance(scenario, str):
        return list(catalogue[scenario])
    return [int(a) for a in scenario]


def _restrict(df: DataFrame, users: DataFrame | None, key: str = "user_id") -> DataFrame:
    if users is None:
        return df
    return df.join(users.select(F.col("user_id").alias(key)), key, "left_semi")


def purchase_history(p: Purchases, users: DataFrame | None = None, ordered: bool = False) -> DataFrame:
    """Every purchased line of the users: day, hour, basket and item.

    ``ordered`` adds the global ``ORDER BY user_id, order_id`` (a range-partitioned sort); leave it
    off when the consumer does not need it.
    """
    o = _restrict(p.orders, users)
    out = (p.order_products.join(o, "order_id")
           .join(p.products.select("product_id"), "product_id")
           .select("user_id", "order_id", "order_dow", "order_hour_of_day",
                   F.col("order_id").alias("basket_id"), F.col("product_id").alias("item_id")))
    return out.orderBy("user_id", "order_id", "item_id") if ordered else out


def category_lines(p: Purchases, scenario, users: DataFrame | None = None, catalogue=None) -> DataFrame:
    """Lines whose product lies in the scenario's aisles: ``(user_id, order_id, product_id)``."""
    prods = p.products.where(F.col("aisle_id").isin(_aisles(scenario, catalogue or p.scenarios))).select("product_id")
    o = _restrict(p.orders, users).select("order_id", "user_id")
    return p.order_products.join(prods, "product_id").join(o, "order_id")


def category_purchases(p: Purchases, scenario, users: DataFrame | None = None, catalogue=None) -> DataFrame:
    """R2: scenario purchases of the users as ``(user_id, basket_id, item_id)``."""
    return category_lines(p, scenario, users, catalogue).select(
        "user_id", F.col("order_id").alias("basket_id"), F.col("product_id").alias("item_id"))


def category_listing(p: Purchases, scenario, users: DataFrame | None = None, ordered: bool = False,
                     catalogue=None) -> DataFrame:
    """As R2 with the product name, ordered by user and order when asked."""
    prods = p.products.where(F.col("aisle_id").isin(_aisles(scenario, catalogue or p.scenarios)))
    o = _restrict(p.orders, users).select("order_id", "user_id")
    out = (p.order_products.join(prods.select("product_id", "product_name"), "product_id")
           .join(o, "order_id")
           .select("user_id", "order_id", "product_id", "product_name"))
    return out.orderBy("user_id", "order_id", "product_id") if ordered else out


def category_buyers(p: Purchases, scenario, lower: int, upper: int, limit: int | None,
                    catalogue=None) -> DataFrame:
    """Users whose number of scenario lines lies strictly between the bounds.

    The count is a map-side combined hash aggregate, so a user with a huge history only adds to
    one partial row per task. ``limit`` keeps the first users by id (the report size).
    """
    counts = (category_lines(p, scenario, catalogue=catalogue)
              .groupBy("user_id").agg(F.count(F.lit(1)).alias("num_items")))
    out = counts.where((F.col("num_items") > lower) & (F.col("num_items") < upper))
    if limit is not None:
        out = out.orderBy("user_id").limit(int(limit))
    return out


def sensitive_users(p: Purchases, scenario, users: DataFrame | None = None, catalogue=None) -> DataFrame:
    """Distinct users (of ``users``) with at least one scenario purchase."""
    return category_lines(p, scenario, users, catalogue).select("user_id").distinct()


def user_aisle_counts(p: Purchases, users: DataFrame | None = None) -> DataFrame:
    """Lines per ``(user_id, aisle_id)``: the pre-aggregate every cohort query starts from.

    A cohort query then joins cohort rows with at most (#aisles) rows per member instead of with
    every purchase line, which bounds the join by cohort size x aisles.
    """
    o = _restrict(p.orders, users).select("order_id", "user_id")
    return (p.order_products.join(p.products.select("product_id", "aisle_id"), "product_id")
            .join(o, "order_id")
            .groupBy("user_id", "aisle_id").agg(F.count(F.lit(1)).alias("cnt")))


def top_aisles(p: Purchases, cohorts: DataFrame, n: int = 10, counts: DataFrame | None = None) -> DataFrame:
    """Per cohort, the aisles with the largest share of the members' purchase lines.

    ``cohorts(cohort_id, user_id)``; membership is a set (duplicates are ignored, as with ``IN``).
    Share = lines in aisle / lines of the cohort, as double. Ties: aisle id ascending. Only the
    members' lines are counted: the semi join stands before the aggregate.
    """
    members = cohorts.select("cohort_id", "user_id").distinct()
    counts = counts if counts is not None else user_aisle_counts(p, members.select("user_id").distinct())
    per_aisle = (members.join(counts, "user_id")
                 .groupBy("cohort_id", "aisle_id").agg(F.sum("cnt").alias("cnt")))
    total = F.sum("cnt").over(Window.partitionBy("cohort_id"))
    shares = per_aisle.withColumn("normalized_count", F.col("cnt").cast("double") / total.cast("double"))
    return top_n(shares, ["cohort_id"], [F.col("normalized_count").desc(), F.col("aisle_id")], n) \
        .select("cohort_id", "aisle_id", "normalized_count", "rank")


def baskets_of(p: Purchases, deletions: DataFrame) -> DataFrame:
    """For each ``(user_id, item_id)`` the baskets that hold the item (distinct order ids)."""
    d = deletions.select("user_id", F.col("item_id").alias("product_id")).distinct()
    return (lines(p).join(d, ["user_id", "product_id"])
            .select("user_id", F.col("product_id").alias("item_id"), "order_id").distinct())


def purchase_stats(p: Purchases, users: DataFrame | None = None) -> DataFrame:
    """Distinct baskets and distinct items per user."""
    o = _restrict(p.orders, users).select("order_id", "user_id")
    l = p.order_products.join(o, "order_id")
    return l.groupBy("user_id").agg(F.countDistinct("order_id").alias("num_baskets"),
                                     F.countDistinct("product_id").alias("num_items"))


def flag_sensitive(df: DataFrame, scenario, aisle_col: str = "aisle_id", catalogue=None,
                   name: str = "sensitive") -> DataFrame:
    """Add a boolean: the row's aisle belongs to the scenario."""
    return df.withColumn(name, F.coalesce(F.col(aisle_col).isin(_aisles(scenario, catalogue or TEST_SCENARIOS)), F.lit(False)))


def flag_items(p: Purchases, df: DataFrame, scenario, item_col: str = "item_id", catalogue=None) -> DataFrame:
    """R12 for item rows: look up the item's aisle, then flag it."""
    prods = p.products.select(F.col("product_id").alias(item_col), "aisle_id")
    return flag_sensitive(df.join(prods, item_col, "left"), scenario, catalogue=catalogue or p.scenarios)


def top_aisles_named(p: Purchases, shares: DataFrame, aisles: DataFrame) -> DataFrame:
    """R9 rows with the aisle's display name and the share in percent."""
    name = F.concat(F.upper(F.substring("aisle", 1, 1)), F.expr("substring(aisle, 2)"))
    names = aisles.select("aisle_id", name.alias("aisle_name"))
    return (shares.join(names, "aisle_id", "left")
            .select("cohort_id", "rank", "aisle_id", "aisle_name",
                    F.round(F.col("normalized_count") * 100.0, 2).alias("percentage")))


def aisles_dimension(sf_part: DataFrame) -> DataFrame:
    """Aisle dimension of the test tables: the aisle is the brand, its name the brand text."""
    return (sf_part.select(F.substring("p_brand", 7, 8).cast("int").alias("aisle_id"),
                           F.col("p_brand").alias("aisle"))
            .distinct())
