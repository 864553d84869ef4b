"""Independent from-scratch SQL (DuckDB dialect) for every catalogued query.

Each text starts from the raw test tables and re-derives the purchase schema in CTEs, so it checks
the Spark plan end to end, including the incremental paths (their SQL is a full recomputation on
the surviving rows).
"""

from __future__ import annotations

import re

from trolley.schema import BUYER_RANGES, DEFAULT_PARAMS, aisle_list_sql

PURCHASE_CTES = """
po AS (SELECT o_orderkey AS order_id, o_custkey AS user_id,
              CAST(dayofweek(o_orderdate) AS INTEGER) AS order_dow,
              CAST(hour(o_orderdate) AS INTEGER) AS order_hour_of_day,
              o_orderdate AS order_ts FROM orders),
op AS (SELECT l_orderkey AS order_id, l_partkey AS product_id FROM lineitem),
pr AS (SELECT p_partkey AS product_id, p_name AS product_name,
              CAST(substr(p_brand, 7) AS INTEGER) AS aisle_id, p_type AS department FROM part),
ln AS (SELECT op.order_id, po.user_id, op.product_id FROM op JOIN po ON op.order_id = po.order_id)"""


def q(expr: str) -> str:
    """Same binary-grid snapping as ``functions.expressions.report``."""
    return f"(round(({expr}) * 1073741824.0) / 1073741824.0)"


def rk(expr: str) -> str:
    """Same ranking key as ``functions.expressions.rank_key``."""
    return f"(round(({expr}) * 17179869184.0) / 17179869184.0)"


def with_ctes(body: str, *extra: str) -> str:
    """Every named table is computed once, whatever the planner would inline."""
    ctes = ",\n".join([PURCHASE_CTES.strip()] + [e.strip() for e in extra if e])
    return "WITH " + re.sub(r"\b(\w+) AS \((?=\s*SELECT)", r"\1 AS MATERIALIZED (", ctes) + "\n" + body.strip()


def aisles_in(scenario: str) -> str:
    return f"({aisle_list_sql(scenario)})"


def buyers_sql(scenario: str) -> str:
    lo, hi, n = BUYER_RANGES[scenario]
    return with_ctes(f"""
SELECT user_id, num_items FROM (
  SELECT ln.user_id, COUNT(*) AS num_items
  FROM ln JOIN pr ON pr.product_id = ln.product_id
  WHERE pr.aisle_id IN {aisles_in(scenario)}
  GROUP BY ln.user_id) s
WHERE num_items > {lo} AND num_items < {hi}
ORDER BY user_id LIMIT {n}""")


# Interactions, squared norms, the neighbour table (item self join), embeddings: CTE blocks that the
# model-level texts share.
def interactions_cte(lines: str = "ln", name: str = "inter") -> str:
    return f"{name} AS (SELECT DISTINCT user_id, product_id AS item_id, 1.0::DOUBLE AS value FROM {lines})"


COSINE_SQL = "d.dot / (sqrt(na.nsq) * sqrt(nb.nsq))"
TANIMOTO_SQL = "d.dot / (na.nsq + nb.nsq - d.dot)"


def neighbors_cte(k: int, inter: str = "inter", name: str = "nbr", similarity: str = COSINE_SQL) -> str:
    return f"""
{name}_nsq AS (SELECT user_id, SUM(value * value) AS nsq FROM {inter} GROUP BY user_id),
{name}_dot AS (SELECT a.user_id AS user_id, b.user_id AS neighbor_id, SUM(a.value * b.value) AS dot
           FROM {inter} a JOIN {inter} b ON a.item_id = b.item_id AND a.user_id <> b.user_id
           GROUP BY a.user_id, b.user_id),
{name}_sim AS (SELECT d.user_id, d.neighbor_id, {similarity} AS similarity
           FROM {name}_dot d JOIN {name}_nsq na ON na.user_id = d.user_id
                          JOIN {name}_nsq nb ON nb.user_id = d.neighbor_id
           WHERE d.dot > 0),
{name} AS (SELECT user_id, neighbor_id, similarity, rank FROM (
           SELECT *, CAST(row_number() OVER (PARTITION BY user_id
                                             ORDER BY similarity DESC, neighbor_id) AS BIGINT) AS rank
           FROM {name}_sim) WHERE rank <= {k})"""


def embeddings_cte(lines: str = "ln", name: str = "emb", r_basket: float = DEFAULT_PARAMS.r_basket) -> str:
    """Closed form of the unordered model: (baskets holding i / n) * r_basket^(n-1)."""
    return f"""
{name}_bi AS (SELECT DISTINCT user_id, order_id, product_id FROM {lines}),
{name}_n AS (SELECT user_id, COUNT(DISTINCT order_id) AS n FROM {name}_bi GROUP BY user_id),
{name}_c AS (SELECT user_id, product_id AS item_id, COUNT(*) AS c FROM {name}_bi GROUP BY user_id, product_id),
{name} AS (SELECT c.user_id, c.item_id,
                  (c.c::DOUBLE / n.n) * pow({r_basket}, n.n - 1) AS weight
           FROM {name}_c c JOIN {name}_n n ON n.user_id = c.user_id)"""


def recommendations_cte(nbr: str = "nbr", emb: str = "emb", alpha: float = 0.1, n: int = 20,
                        name: str = "rec") -> str:
    return f"""
{name}_parts AS (
  SELECT x.user_id, e.item_id, (1 - {alpha}) * x.similarity * e.weight AS s
  FROM {nbr} x JOIN {emb} e ON e.user_id = x.neighbor_id
  UNION ALL
  SELECT e.user_id, e.item_id, {alpha} * e.weight AS s FROM {emb} e),
{name}_score AS (SELECT user_id, item_id, SUM(s) AS score FROM {name}_parts GROUP BY user_id, item_id),
{name} AS (SELECT user_id, item_id, score, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY user_id
                                    ORDER BY {rk('score')} DESC, item_id) AS BIGINT) AS rank
  FROM {name}_score WHERE score > 0) WHERE rank <= {n})"""


def ordered_embeddings_cte(group_size: int, r_basket: float, r_group: float, name: str = "oemb",
                           lines: str = "ln") -> str:
    """E3 -> E5 -> E6 with positions by (order time, basket id)."""
    g = int(group_size)
    return f"""
{name}_bi AS (SELECT DISTINCT user_id, order_id AS basket_id, product_id AS item_id FROM {lines}),
{name}_bk AS (SELECT DISTINCT b.user_id, b.basket_id, po.order_ts FROM {name}_bi b JOIN po ON po.order_id = b.basket_id),
{name}_pos AS (SELECT user_id, basket_id,
                      row_number() OVER (PARTITION BY user_id ORDER BY order_ts, basket_id) AS position FROM {name}_bk),
{name}_grp AS (SELECT user_id, basket_id, position, CAST(ceil(position / {g}.0) AS BIGINT) AS grp FROM {name}_pos),
{name}_sz AS (SELECT user_id, grp, COUNT(*) AS s FROM {name}_grp GROUP BY user_id, grp),
{name}_con AS (SELECT g.user_id, g.basket_id, g.grp,
                      pow({r_basket}, {g} - (((g.position - 1) % {g}) + 1 + ({g} - z.s))) / z.s AS contribution
               FROM {name}_grp g JOIN {name}_sz z ON z.user_id = g.user_id AND z.grp = g.grp),
{name}_gv AS (SELECT b.user_id, c.grp, b.item_id, SUM(c.contribution) AS weight
              FROM {name}_bi b JOIN {name}_con c ON c.user_id = b.user_id AND c.basket_id = b.basket_id
              GROUP BY b.user_id, c.grp, b.item_id),
{name}_m AS (SELECT user_id, MAX(grp) AS m FROM {name}_gv GROUP BY user_id),
{name} AS (SELECT v.user_id, v.item_id, SUM(pow({r_group}, m.m - v.grp) / m.m * v.weight) AS weight
           FROM {name}_gv v JOIN {name}_m m ON m.user_id = v.user_id GROUP BY v.user_id, v.item_id)"""
