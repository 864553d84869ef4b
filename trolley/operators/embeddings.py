"""Baskets, interactions and decayed basket embeddings ("TIFU" user vectors).

Model (group size g, basket decay r_b, group decay r_g). A user's baskets get positions 1..n;
basket at position p falls into group ceil(p / g); a group with s baskets gives each basket the
in-group index ((p - 1) mod g) + 1 + (g - s) (short groups are shifted right) and the item weight
r_b^(g - index) / s. A user with m groups sums the group vectors with factor r_g^(m - i) / m.

Two callers of the same operator:
  * ``order_by=None``   every basket has position 1, which is what the reference's maintained view
                        computes. It has the closed form weight = (baskets holding i / n) * r_b^(n-1).
  * ``order_by=[...]``  positions follow the basket order (library semantics of the model).

All steps are hash aggregates with map-side partial combine and joins on per-user tables; basket
positions are numbered over range partitions, so no step sorts one user's history in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trolley.functions.numbering import row_numbers
from trolley.schema import DEFAULT_PARAMS, DISCRETISATION_FACTOR, PRESETS, HyperParams
from trolley.session import materialize
from trolley.sources.purchases import Purchases


# ------------------------------------------------------------------------------ E1, E2

def basket_items(p: Purchases, with_time: bool = False) -> DataFrame:
    """Distinct ``(user_id, basket_id, item_id)``: a basket's items are a set (duplicates count once).

    ``with_time`` adds the orders columns that give the basket order (``p.order_by``).
    """
    extra = list(p.order_by) if with_time else []
    bi = p.order_products.join(p.orders.select("order_id", "user_id", *extra), "order_id")
    out = bi.select("user_id", F.col("order_id").alias("basket_id"),
                    F.col("product_id").alias("item_id"), *extra)
    return out.distinct()


def baskets(p: Purchases) -> DataFrame:
    """``(user_id, basket_id, items array<long>)`` with sorted items; one row per non-empty basket."""
    return (basket_items(p).groupBy("user_id", "basket_id")
            .agg(F.sort_array(F.collect_list("item_id")).alias("items")))


def interactions(p: Purchases) -> DataFrame:
    """The binary user x item matrix in long form ``(user_id, item_id, value=1.0)``."""
    return (p.order_products.join(p.orders.select("order_id", "user_id"), "order_id")
            .select("user_id", F.col("product_id").alias("item_id")).distinct()
            .withColumn("value", F.lit(1.0)))


# ------------------------------------------------------------------------------ E3-E6

def basket_positions(bi: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """E3 part 1: ``(user_id, basket_id, position)``.

    Unordered: position 1 for every basket. Ordered: 1-based rank of the basket in the user's
    history, numbered over range partitions (``functions.numbering``) so that a user with a huge
    history is split across tasks.
    """
    cols = list(dict.fromkeys(["user_id", "basket_id", *(order_by or [])]))
    b = bi.select(*cols).distinct()
    if not order_by:
        return b.select("user_id", "basket_id", F.lit(1).cast("long").alias("position"))
    return row_numbers(b, "user_id", list(order_by)).select("user_id", "basket_id", "position")


def basket_groups(positions: DataFrame, group_size: int) -> DataFrame:
    """Add ``grp = ceil(position / g)``."""
    return positions.withColumn("grp", F.ceil(F.col("position") / F.lit(group_size)).cast("long"))


def basket_contributions(groups: DataFrame, params: HyperParams) -> DataFrame:
    """Per basket the weight it adds to each of its items: r_b^(g - index) / s."""
    g = params.group_size
    sizes = groups.groupBy("user_id", "grp").agg(F.count(F.lit(1)).alias("s"))
    idx = F.pmod(F.col("position") - 1, F.lit(g)) + 1 + (F.lit(g) - F.col("s"))
    return (groups.join(sizes, ["user_id", "grp"])
            .select("user_id", "basket_id", "grp",
                    (F.pow(F.lit(params.r_basket), (F.lit(g) - idx).cast("double")) / F.col("s"))
                    .alias("contribution")))


def group_vectors(bi: DataFrame, groups: DataFrame, params: HyperParams) -> DataFrame:
    """E5: ``(user_id, grp, item_id, weight)`` = sum of the contributions of the group's baskets."""
    contrib = basket_contributions(groups, params)
    return (bi.select("user_id", "basket_id", "item_id").join(contrib, ["user_id", "basket_id"])
            .groupBy("user_id", "grp", "item_id").agg(F.sum("contribution").alias("weight")))


def user_vectors(gv: DataFrame, params: HyperParams) -> DataFrame:
    """``(user_id, item_id, weight)`` = sum over groups of r_g^(m - i) / m x group vector."""
    m = gv.groupBy("user_id").agg(F.max("grp").alias("m"))
    factor = F.pow(F.lit(params.r_group), (F.col("m") - F.col("grp")).cast("double")) / F.col("m")
    return (gv.join(m, "user_id")
            .groupBy("user_id", "item_id").agg(F.sum(factor * F.col("weight")).alias("weight")))


def embeddings_general(bi: DataFrame, params: HyperParams = DEFAULT_PARAMS,
                       order_by: list[str] | None = None) -> DataFrame:
    """E3 -> E5 -> E6 for either basket order (E8 when ``order_by`` is given)."""
    groups = basket_groups(basket_positions(bi, order_by), params.group_size)
    return user_vectors(group_vectors(bi, groups, params), params)


def embeddings_unordered(bi: DataFrame, params: HyperParams = DEFAULT_PARAMS) -> DataFrame:
    """The reference view in closed form: (baskets of u holding i / n_u) * r_b^(n_u - 1)."""
    bi = bi.select("user_id", "basket_id", "item_id")
    counts = bi.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("c"))
    n = bi.select("user_id", "basket_id").distinct().groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    w = (F.col("c").cast("double") / F.col("n")) * F.pow(F.lit(params.r_basket), (F.col("n") - 1).cast("double"))
    return counts.join(n, "user_id").select("user_id", "item_id", w.alias("weight"))


def embeddings(p: Purchases, params: HyperParams = DEFAULT_PARAMS, ordered: bool = False) -> DataFrame:
    """User embeddings from the purchase tables; ``ordered`` orders baskets by (time, id)."""
    if ordered:
        return embeddings_general(basket_items(p, with_time=True), params, [*p.order_by, "basket_id"])
    return embeddings_unordered(basket_items(p), params)


def preset_sweep(p: Purchases, ordered: bool = True) -> DataFrame:
    """The model under every preset, tagged by name.

    Baskets and their positions are the same under all presets; they are made and written once.
    """
    bi = materialize(basket_items(p, with_time=ordered))
    positions = materialize(basket_positions(bi, [*p.order_by, "basket_id"])) if ordered else None
    out = None
    for name, params in PRESETS.items():
        e = (user_vectors(group_vectors(bi, basket_groups(positions, params.group_size), params), params) if ordered
             else embeddings_unordered(bi, params)).withColumn("preset", F.lit(name))
        out = e if out is None else out.unionByName(e)
    return out.select("preset", "user_id", "item_id", "weight")


# ------------------------------------------------------------------------------ E10-E14

def discretise(e: DataFrame, col: str = "weight") -> DataFrame:
    """Fixed point ``trunc(w * 1e15)`` as long (values below 9.2e3 fit)."""
    return e.withColumn(col, F.floor(F.col(col) * F.lit(DISCRETISATION_FACTOR)).cast("long"))


def restore(e: DataFrame, col: str = "weight") -> DataFrame:
    return e.withColumn(col, F.col(col).cast("double") / F.lit(DISCRETISATION_FACTOR))


def linear_combine(terms: list[tuple[float, DataFrame]], key: str = "user_id", col: str = "weight") -> DataFrame:
    """Sum of scaled sparse vectors in long form (``mult``, ``plus``, ``plus_mult``).

    One union of scaled rows and one grouped sum; entries that cancel to exactly 0 are dropped.
    """
    out = None
    for c, v in terms:
        scaled = v.select(key, "item_id", (F.lit(float(c)) * F.col(col)).alias(col))
        out = scaled if out is None else out.unionByName(scaled)
    return out.groupBy(key, "item_id").agg(F.sum(col).alias(col)).where(F.col(col) != 0.0)


def render_vectors(e: DataFrame, key: str = "user_id", decimals: int = 9) -> DataFrame:
    """``item:weight;...`` sorted by item. The list is bounded by the item catalogue size.

    Weights are snapped to the reporting grid before printing, so the text is engine independent.
    """
    from trolley.functions.expressions import report
    entry = F.struct(F.col("item_id"), report("weight").alias("weight"))
    fmt = f"%d:%.{int(decimals)}f"
    return (e.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("v"))
            .select(key, F.array_join(F.transform(
                "v", lambda x: F.format_string(fmt, x["item_id"], x["weight"])), ";").alias("vector")))


def embeddings_of(e: DataFrame, users: DataFrame, as_array: bool = False) -> DataFrame:
    """The embedding rows of the requested users; optionally one sorted array per user."""
    out = e.join(users.select("user_id").distinct(), "user_id", "left_semi")
    if not as_array:
        return out
    return (out.groupBy("user_id")
            .agg(F.array_sort(F.collect_list(F.struct("item_id", "weight"))).alias("weights")))


def changed_users(old: DataFrame, new: DataFrame, key: str = "user_id", col: str = "weight") -> DataFrame:
    """Users whose vector differs between two versions (a value difference per item).

    Equal vectors never count as changed, whatever their storage order; values are compared on the
    reporting grid so that another summation order is not reported as a change.
    """
    from trolley.functions.expressions import report

    def v(c: Column) -> Column:
        return report(c)
    j = old.select(key, "item_id", F.col(col).alias("old")).join(
        new.select(key, "item_id", F.col(col).alias("new")), [key, "item_id"], "full_outer")
    diff = j.where(F.col("old").isNull() | F.col("new").isNull() | (v(F.col("old")) != v(F.col("new"))))
    return diff.select(key).distinct()
