"""The query catalogue behind ``__spark_entry__``: one Spark plan (and, where SQL can say it, one
independent DuckDB text) per operator of the inventory.

Every entry reads the whole test tables; cohorts, scenarios and deletion sets are derived from the
data (customer nations, scenario aisles), never from id lists, id ranges or row caps.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trolley.operators import relational as R
from trolley.plans import sql as S
from trolley.schema import BUYER_RANGES
from trolley.sources.purchases import load_purchases, purchase_edges, sql_over_path, table


@dataclass(frozen=True)
class Entry:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOG: dict[str, Entry] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        CATALOG[name] = Entry(name, fn, sql)
        return fn
    return wrap


def nation_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohorts taken from the data: every customer's nation is a cohort of users."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("long").alias("cohort_id"), F.col("c_custkey").cast("long").alias("user_id"))


NATION_COHORTS_CTE = "coh AS (SELECT CAST(c_nationkey AS BIGINT) AS cohort_id, c_custkey AS user_id FROM customer)"


def scenario_deletions(p, scenario: str = "carbon") -> DataFrame:
    """Deletion requests derived from the data: every user forgets their purchases in the scenario."""
    return R.category_purchases(p, scenario).select("user_id", "item_id").distinct()


def deletions_cte(scenario: str = "carbon", name: str = "del") -> str:
    return (f"{name} AS (SELECT DISTINCT ln.user_id, ln.product_id AS item_id FROM ln "
            f"JOIN pr ON pr.product_id = ln.product_id WHERE pr.aisle_id IN {S.aisles_in(scenario)})")


# ------------------------------------------------------------------------------------- sources

@register("src_purchases", S.with_ctes(
    "SELECT order_id, user_id, order_dow, order_hour_of_day FROM po"))
def q_src_purchases(spark, d):
    return load_purchases(spark, d).orders.select("order_id", "user_id", "order_dow", "order_hour_of_day")


PATH_QUERY = """
WITH sold AS (
  SELECT l_partkey, COUNT(*) AS n FROM parquet.`{dir}/lineitem.parquet`
  WHERE l_orderkey IN (SELECT o_orderkey FROM parquet.`{dir}/orders.parquet`) GROUP BY l_partkey
), by_aisle AS (
  SELECT CAST(substr(p_brand, 7) AS INT) AS aisle_id, SUM(n) AS n
  FROM sold JOIN parquet.`{dir}/part.parquet` ON p_partkey = l_partkey GROUP BY ALL
)
SELECT aisle_id, CAST(n AS DOUBLE) / CAST(SUM(n) OVER () AS DOUBLE) AS normalized_count
FROM by_aisle ORDER BY normalized_count DESC, aisle_id LIMIT 10"""


@register("src_parquet_path", S.with_ctes("""
SELECT pr.aisle_id, CAST(COUNT(*) AS DOUBLE) / CAST(SUM(COUNT(*)) OVER () AS DOUBLE) AS normalized_count
FROM ln JOIN pr ON pr.product_id = ln.product_id
GROUP BY pr.aisle_id ORDER BY normalized_count DESC, aisle_id LIMIT 10"""))
def q_src_parquet_path(spark, d):
    return sql_over_path(spark, d, PATH_QUERY)


@register("src_registered", S.with_ctes("""
SELECT part.p_brand AS aisle, COUNT(*) AS num_lines, COUNT(DISTINCT ln.user_id) AS num_users,
       (SELECT COUNT(DISTINCT p_type) FROM part) AS num_departments
FROM ln JOIN part ON part.p_partkey = ln.product_id GROUP BY part.p_brand"""))
def q_src_registered(spark, d):
    """S3: SQL over the five registered tables."""
    load_purchases(spark, d).register("shop_")
    return spark.sql("""
        SELECT aisle, COUNT(*) AS num_lines, COUNT(DISTINCT user_id) AS num_users,
               (SELECT COUNT(*) FROM shop_departments) AS num_departments
        FROM shop_order_products JOIN shop_orders USING (order_id) JOIN shop_products USING (product_id)
             JOIN shop_aisles USING (aisle_id)
        GROUP BY aisle""")


@register("src_edges", S.with_ctes("""
SELECT 'basket_user' AS edge, order_id, user_id AS other_id FROM po
UNION ALL
SELECT 'basket_item' AS edge, order_id, product_id AS other_id FROM op"""))
def q_src_edges(spark, d):
    baskets, items = purchase_edges(load_purchases(spark, d))
    return (baskets.select(F.lit("basket_user").alias("edge"), "order_id", F.col("user_id").alias("other_id"))
            .unionByName(items.select(F.lit("basket_item").alias("edge"), "order_id",
                                      F.col("product_id").alias("other_id"))))


# ---------------------------------------------------------------------------------- relational

@register("rel_history", S.with_ctes("""
SELECT po.user_id, po.order_id, po.order_dow, po.order_hour_of_day,
       op.order_id AS basket_id, op.product_id AS item_id
FROM op JOIN po ON po.order_id = op.order_id JOIN pr ON pr.product_id = op.product_id"""))
def q_rel_history(spark, d):
    return R.purchase_history(load_purchases(spark, d))


@register("rel_category", S.with_ctes(f"""
SELECT ln.user_id, ln.order_id AS basket_id, ln.product_id AS item_id
FROM ln JOIN pr ON pr.product_id = ln.product_id WHERE pr.aisle_id IN {S.aisles_in('alcohol')}"""))
def q_rel_category(spark, d):
    return R.category_purchases(load_purchases(spark, d), "alcohol")


@register("rel_category_named", S.with_ctes(f"""
SELECT ln.user_id, ln.order_id, ln.product_id, pr.product_name
FROM ln JOIN pr ON pr.product_id = ln.product_id WHERE pr.aisle_id IN {S.aisles_in('alcohol')}
ORDER BY ln.user_id, ln.order_id, ln.product_id"""))
def q_rel_category_named(spark, d):
    return R.category_listing(load_purchases(spark, d), "alcohol", ordered=True)


def _buyers(scenario):
    lo, hi, n = BUYER_RANGES[scenario]
    return lambda spark, d: R.category_buyers(load_purchases(spark, d), scenario, lo, hi, n)


for _scn in ("alcohol", "meat", "carbon", "obesity"):
    register(f"rel_buyers_{_scn}", S.buyers_sql(_scn))(_buyers(_scn))


@register("rel_sensitive", S.with_ctes(f"""
SELECT DISTINCT ln.user_id FROM ln JOIN pr ON pr.product_id = ln.product_id
WHERE pr.aisle_id IN {S.aisles_in('obesity')} AND ln.user_id IN (SELECT user_id FROM coh)""",
                                       NATION_COHORTS_CTE))
def q_rel_sensitive(spark, d):
    return R.sensitive_users(load_purchases(spark, d), "obesity", users=nation_cohorts(spark, d))


def top_aisles_sql(cohorts: str = "coh", key: str = "cohort_id", n: int = 10, lines: str = "ln") -> str:
    return f"""
SELECT {key}, aisle_id, normalized_count, rank FROM (
  SELECT {key}, aisle_id, normalized_count,
         CAST(row_number() OVER (PARTITION BY {key} ORDER BY normalized_count DESC, aisle_id) AS BIGINT) AS rank
  FROM (SELECT c.{key}, pr.aisle_id,
               CAST(COUNT(*) AS DOUBLE) / CAST(SUM(COUNT(*)) OVER (PARTITION BY c.{key}) AS DOUBLE)
                 AS normalized_count
        FROM {lines} l JOIN pr ON pr.product_id = l.product_id
                JOIN (SELECT DISTINCT {key}, user_id FROM {cohorts}) c ON c.user_id = l.user_id
        GROUP BY c.{key}, pr.aisle_id) s) r
WHERE rank <= {n}"""


TOP_AISLES_BODY = top_aisles_sql()


@register("rel_top_aisles", S.with_ctes(TOP_AISLES_BODY, NATION_COHORTS_CTE))
def q_rel_top_aisles(spark, d):
    return R.top_aisles(load_purchases(spark, d), nation_cohorts(spark, d), n=10)


@register("rel_baskets_of", S.with_ctes("""
SELECT DISTINCT ln.user_id, ln.product_id AS item_id, ln.order_id
FROM ln JOIN del ON del.user_id = ln.user_id AND del.item_id = ln.product_id""", deletions_cte()))
def q_rel_baskets_of(spark, d):
    p = load_purchases(spark, d)
    return R.baskets_of(p, scenario_deletions(p))


@register("rel_stats", S.with_ctes("""
SELECT user_id, COUNT(DISTINCT order_id) AS num_baskets, COUNT(DISTINCT product_id) AS num_items
FROM ln GROUP BY user_id"""))
def q_rel_stats(spark, d):
    return R.purchase_stats(load_purchases(spark, d))


@register("rel_flag", S.with_ctes(f"""
SELECT product_id, aisle_id, COALESCE(aisle_id IN {S.aisles_in('alcohol')}, FALSE) AS sensitive FROM pr"""))
def q_rel_flag(spark, d):
    p = load_purchases(spark, d)
    return R.flag_sensitive(p.products.select("product_id", "aisle_id"), "alcohol")


@register("rel_top_aisles_named", S.with_ctes("""
SELECT t.cohort_id, t.rank, t.aisle_id, a.aisle_name, round(t.normalized_count * 100.0, 2) AS percentage
FROM top t LEFT JOIN aisl a ON a.aisle_id = t.aisle_id""",
    NATION_COHORTS_CTE,
    "top AS (" + TOP_AISLES_BODY + ")",
    "aisl AS (SELECT DISTINCT CAST(substr(p_brand, 7) AS INTEGER) AS aisle_id, "
    "upper(substr(p_brand, 1, 1)) || substr(p_brand, 2) AS aisle_name FROM part)"))
def q_rel_top_aisles_named(spark, d):
    p = load_purchases(spark, d)
    shares = R.top_aisles(p, nation_cohorts(spark, d), n=10)
    return R.top_aisles_named(p, shares, R.aisles_dimension(table(spark, d, "part")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next-basket recommendations (top 20 items) for every user."""
    return CATALOG["rec_topn"].build(spark, sf_dir)


# ---------------------------------------------------------------------------------- embeddings

from trolley.functions.expressions import report  # noqa: E402
from trolley.operators import embeddings as EM  # noqa: E402
from trolley.schema import DEFAULT_PARAMS, PRESETS  # noqa: E402

_P = DEFAULT_PARAMS


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, report(c))
    return df


@register("emb_baskets", S.with_ctes("""
SELECT user_id, basket_id, CAST(COUNT(*) AS BIGINT) AS num_items,
       string_agg(CAST(item_id AS VARCHAR), ' ' ORDER BY item_id) AS items
FROM (SELECT DISTINCT user_id, order_id AS basket_id, product_id AS item_id FROM ln) b
GROUP BY user_id, basket_id"""))
def q_emb_baskets(spark, d):
    b = EM.baskets(load_purchases(spark, d))
    return b.select("user_id", "basket_id", F.size("items").cast("long").alias("num_items"),
                    F.array_join(F.col("items").cast("array<string>"), " ").alias("items"))


@register("emb_interactions", S.with_ctes("SELECT * FROM inter", S.interactions_cte()))
def q_emb_interactions(spark, d):
    return EM.interactions(load_purchases(spark, d))


@register("emb_groups", S.with_ctes(f"""
SELECT user_id, basket_id, position, grp FROM oemb_grp""",
    S.ordered_embeddings_cte(_P.group_size, _P.r_basket, _P.r_group)))
def q_emb_groups(spark, d):
    bi = EM.basket_items(load_purchases(spark, d), with_time=True)
    return EM.basket_groups(EM.basket_positions(bi, ["order_ts", "basket_id"]), _P.group_size)


@register("emb_group_vectors", S.with_ctes("""
SELECT user_id, grp, item_id, (round((weight) * 1073741824.0) / 1073741824.0) AS weight FROM oemb_gv""",
    S.ordered_embeddings_cte(_P.group_size, _P.r_basket, _P.r_group)))
def q_emb_group_vectors(spark, d):
    bi = EM.basket_items(load_purchases(spark, d), with_time=True)
    groups = EM.basket_groups(EM.basket_positions(bi, ["order_ts", "basket_id"]), _P.group_size)
    return _rounded(EM.group_vectors(bi, groups, _P), "weight")


@register("emb_user_vectors", S.with_ctes("""
SELECT user_id, item_id, (round((weight) * 1073741824.0) / 1073741824.0) AS weight FROM oemb""",
    S.ordered_embeddings_cte(_P.group_size, _P.r_basket, _P.r_group)))
def q_emb_user_vectors(spark, d):
    bi = EM.basket_items(load_purchases(spark, d), with_time=True)
    groups = EM.basket_groups(EM.basket_positions(bi, ["order_ts", "basket_id"]), _P.group_size)
    return _rounded(EM.user_vectors(EM.group_vectors(bi, groups, _P), _P), "weight")


@register("emb_model", S.with_ctes("SELECT user_id, item_id, (round((weight) * 1073741824.0) / 1073741824.0) AS weight FROM emb",
                                   S.embeddings_cte()))
def q_emb_model(spark, d):
    return _rounded(EM.embeddings(load_purchases(spark, d)), "weight")


@register("emb_model_ordered", S.with_ctes(
    "SELECT user_id, item_id, (round((weight) * 1073741824.0) / 1073741824.0) AS weight FROM oemb",
    S.ordered_embeddings_cte(_P.group_size, _P.r_basket, _P.r_group)))
def q_emb_model_ordered(spark, d):
    return _rounded(EM.embeddings(load_purchases(spark, d), ordered=True), "weight")


@register("emb_presets", S.with_ctes(
    "\nUNION ALL\n".join(
        f"SELECT '{n}' AS preset, user_id, item_id, (round((weight) * 1073741824.0) / 1073741824.0) AS weight FROM o_{n}" for n in PRESETS),
    *[S.ordered_embeddings_cte(p.group_size, p.r_basket, p.r_group, name=f"o_{n}") for n, p in PRESETS.items()]))
def q_emb_presets(spark, d):
    return _rounded(EM.preset_sweep(load_purchases(spark, d), ordered=True), "weight")


@register("emb_discretised", S.with_ctes(f"""
SELECT user_id, item_id, CAST(floor({S.q('weight')} * 1e15) AS BIGINT) AS weight FROM emb""", S.embeddings_cte()))
def q_emb_discretised(spark, d):
    return EM.discretise(_rounded(EM.embeddings(load_purchases(spark, d)), "weight"))


@register("vec_combine", S.with_ctes("""
SELECT user_id, item_id, (round((SUM(w)) * 1073741824.0) / 1073741824.0) AS weight FROM (
  SELECT user_id, item_id, 0.5 * weight AS w FROM emb
  UNION ALL SELECT user_id, item_id, 0.5 * weight AS w FROM oemb) t
GROUP BY user_id, item_id HAVING SUM(w) <> 0""",
    S.embeddings_cte(), S.ordered_embeddings_cte(_P.group_size, _P.r_basket, _P.r_group)))
def q_vec_combine(spark, d):
    p = load_purchases(spark, d)
    mixed = EM.linear_combine([(0.5, EM.embeddings(p)), (0.5, EM.embeddings(p, ordered=True))])
    return _rounded(mixed, "weight")


@register("vec_render", S.with_ctes(f"""
SELECT user_id, string_agg(printf('%d:%.9f', item_id, {S.q('weight')}), ';' ORDER BY item_id) AS vector
FROM emb GROUP BY user_id""", S.embeddings_cte()))
def q_vec_render(spark, d):
    return EM.render_vectors(EM.embeddings(load_purchases(spark, d)))


@register("emb_lookup", S.with_ctes("""
SELECT user_id, item_id, (round((weight) * 1073741824.0) / 1073741824.0) AS weight FROM emb WHERE user_id IN (SELECT user_id FROM coh)""",
    NATION_COHORTS_CTE, S.embeddings_cte()))
def q_emb_lookup(spark, d):
    e = EM.embeddings(load_purchases(spark, d))
    return _rounded(EM.embeddings_of(e, nation_cohorts(spark, d)), "weight")


# ---------------------------------------------------------------------------------- similarity

from trolley.operators import similarity as K  # noqa: E402
from trolley.plans.state import build_state  # noqa: E402


def _neighbors(spark, d, k=50):
    from trolley.session import materialize
    p = load_purchases(spark, d)
    return K.build_neighbors(materialize(EM.interactions(p)), k)


@register("sim_norms", S.with_ctes("""
SELECT user_id, SUM(value * value) AS nsq, sqrt(SUM(value * value)) AS norm FROM inter GROUP BY user_id""",
                                   S.interactions_cte()))
def q_sim_norms(spark, d):
    return K.norms(EM.interactions(load_purchases(spark, d)))


@register("sim_dots", S.with_ctes("""
SELECT a.user_id, SUM(a.value * b.value) AS dot_total
FROM inter a JOIN inter b ON a.item_id = b.item_id AND a.user_id <> b.user_id
GROUP BY a.user_id
UNION ALL
SELECT user_id, 0.0 AS dot_total FROM inter GROUP BY user_id
HAVING user_id NOT IN (SELECT a.user_id FROM inter a JOIN inter b ON a.item_id = b.item_id AND a.user_id <> b.user_id)""",
                                  S.interactions_cte()))
def q_sim_dots(spark, d):
    return K.pair_dot_totals(EM.interactions(load_purchases(spark, d)))


@register("sim_pairs", S.with_ctes("""
SELECT n.user_id, n.neighbor_id, d.dot, d.dot / (sqrt(a.nsq) * sqrt(b.nsq)) AS similarity
FROM nbr n JOIN nbr_dot d ON d.user_id = n.user_id AND d.neighbor_id = n.neighbor_id
           JOIN nbr_nsq a ON a.user_id = n.user_id JOIN nbr_nsq b ON b.user_id = n.neighbor_id""",
                                   S.interactions_cte(), S.neighbors_cte(50)))
def q_sim_pairs(spark, d):
    from trolley.session import materialize
    p = load_purchases(spark, d)
    I = materialize(EM.interactions(p))
    return K.pair_similarities(I, K.build_neighbors(I, 50))


@register("sim_topk", S.with_ctes("SELECT * FROM nbr", S.interactions_cte(), S.neighbors_cte(10)))
def q_sim_topk(spark, d):
    return _neighbors(spark, d, 10)


@register("sim_index", S.with_ctes("SELECT * FROM nbr", S.interactions_cte(), S.neighbors_cte(50)))
def q_sim_index(spark, d):
    return _neighbors(spark, d, 50)


@register("sim_index_tanimoto", S.with_ctes("SELECT * FROM nbr", S.interactions_cte(),
                                             S.neighbors_cte(50, similarity=S.TANIMOTO_SQL)))
def q_sim_index_tanimoto(spark, d):
    from trolley.functions.measures import TANIMOTO
    from trolley.session import materialize
    return K.build_neighbors(materialize(EM.interactions(load_purchases(spark, d))), 50, measure=TANIMOTO)


@register("sim_out", S.with_ctes("SELECT * FROM nbr WHERE user_id IN (SELECT user_id FROM coh)",
                                 NATION_COHORTS_CTE, S.interactions_cte(), S.neighbors_cte(50)))
def q_sim_out(spark, d):
    return K.neighbors_of(_neighbors(spark, d), nation_cohorts(spark, d))


@register("sim_in", S.with_ctes("""
SELECT neighbor_id AS user_id, user_id AS in_neighbor_id, similarity FROM nbr
WHERE neighbor_id IN (SELECT user_id FROM coh)""", NATION_COHORTS_CTE, S.interactions_cte(), S.neighbors_cte(50)))
def q_sim_in(spark, d):
    return K.in_neighbors_of(_neighbors(spark, d), nation_cohorts(spark, d))


# ----------------------------------------------------------------------------- recommendation

from trolley.operators import graph as G  # noqa: E402
from trolley.operators import recommend as P  # noqa: E402

MODEL_CTES = (S.interactions_cte(), S.neighbors_cte(50), S.embeddings_cte())


def _model(spark, d):
    p = load_purchases(spark, d)
    st = build_state(p)
    return p, st


@register("rec_neighbor_scores", S.with_ctes(f"""
SELECT x.user_id, e.item_id, {S.q('SUM((1 - 0.1) * x.similarity * e.weight)')} AS score
FROM nbr x JOIN emb e ON e.user_id = x.neighbor_id GROUP BY x.user_id, e.item_id""", *MODEL_CTES))
def q_rec_neighbor_scores(spark, d):
    _, st = _model(spark, d)
    return _rounded(P.neighbor_scores(st.neighbors, st.embeddings), "score")


@register("rec_blend", S.with_ctes(f"SELECT user_id, item_id, {S.q('score')} AS score FROM rec_score",
                                   *MODEL_CTES, S.recommendations_cte()))
def q_rec_blend(spark, d):
    _, st = _model(spark, d)
    return _rounded(P.blended_scores(st.neighbors, st.embeddings), "score")


@register("rec_topn", S.with_ctes(f"SELECT user_id, item_id, {S.q('score')} AS score, rank FROM rec",
                                  *MODEL_CTES, S.recommendations_cte()))
def q_rec_topn(spark, d):
    _, st = _model(spark, d)
    return _rounded(P.recommend(st.neighbors, st.embeddings), "score")


@register("rec_sensitive", S.with_ctes(f"""
SELECT r.user_id, COUNT(*) AS num_items,
       CAST(SUM(CASE WHEN pr.aisle_id IN {S.aisles_in('alcohol')} THEN 1 ELSE 0 END) AS BIGINT) AS num_sensitive
FROM rec r JOIN pr ON pr.product_id = r.item_id GROUP BY r.user_id""", *MODEL_CTES, S.recommendations_cte()))
def q_rec_sensitive(spark, d):
    p, st = _model(spark, d)
    return P.sensitive_share(p, P.recommend(st.neighbors, st.embeddings), "alcohol")


# ----------------------------------------------------------------------------------- graph views

EGO_CTES = (NATION_COHORTS_CTE,) + MODEL_CTES + (
    "egos AS (SELECT DISTINCT user_id AS ego_id FROM coh)",
    "gv AS (SELECT ego_id, ego_id AS user_id FROM egos UNION "
    "SELECT n.neighbor_id AS ego_id, n.user_id FROM nbr n WHERE n.neighbor_id IN (SELECT ego_id FROM egos))",
    "ge AS (SELECT v.ego_id, n.user_id AS src, n.neighbor_id AS dst FROM gv v JOIN nbr n ON n.user_id = v.user_id "
    "JOIN gv w ON w.ego_id = v.ego_id AND w.user_id = n.neighbor_id)",
    "sens AS (SELECT DISTINCT ln.user_id FROM ln JOIN pr ON pr.product_id = ln.product_id "
    f"WHERE pr.aisle_id IN {S.aisles_in('alcohol')})",
    "gs AS (SELECT ego_id, user_id, user_id IN (SELECT user_id FROM sens) AS sensitive FROM gv)",
)


def _egos(spark, d):
    from trolley.session import materialize
    return G.ego_networks(load_purchases(spark, d), materialize(_neighbors(spark, d)), nation_cohorts(spark, d), "alcohol")


@register("graph_vertices", S.with_ctes("SELECT ego_id, user_id FROM gv", *EGO_CTES))
def q_graph_vertices(spark, d):
    return _egos(spark, d)["vertices"]


@register("graph_edges", S.with_ctes("SELECT ego_id, src, dst FROM ge", *EGO_CTES))
def q_graph_edges(spark, d):
    return _egos(spark, d)["edges"]


@register("graph_sensitive", S.with_ctes("SELECT ego_id, user_id, sensitive FROM gs", *EGO_CTES))
def q_graph_sensitive(spark, d):
    return _egos(spark, d)["sensitive"]


@register("graph_sensitive_edges", S.with_ctes("""
SELECT ge.ego_id, src, dst, gs.sensitive FROM ge JOIN gs ON gs.ego_id = ge.ego_id AND gs.user_id = ge.dst""", *EGO_CTES))
def q_graph_sensitive_edges(spark, d):
    return _egos(spark, d)["sensitive_edges"]


@register("graph_ego", S.with_ctes(top_aisles_sql("gv", "ego_id"), *EGO_CTES))
def q_graph_ego(spark, d):
    return _egos(spark, d)["top_aisles"]


@register("graph_ego_stats", S.with_ctes("""
SELECT ego_id, COUNT(*) AS num_users, CAST(SUM(CAST(sensitive AS BIGINT)) AS BIGINT) AS num_sensitive
FROM gs GROUP BY ego_id""",
                                         *EGO_CTES))
def q_graph_ego_stats(spark, d):
    return G.ego_stats(_egos(spark, d)["sensitive"])


@register("graph_neighborhood", S.with_ctes(top_aisles_sql("nm", "ego_id"), *EGO_CTES,
    "nm AS (SELECT user_id AS ego_id, neighbor_id AS user_id FROM nbr WHERE user_id IN (SELECT ego_id FROM egos) "
    "UNION SELECT neighbor_id AS ego_id, user_id FROM nbr WHERE neighbor_id IN (SELECT ego_id FROM egos))"))
def q_graph_neighborhood(spark, d):
    from trolley.session import materialize
    return G.neighborhoods(load_purchases(spark, d), materialize(_neighbors(spark, d)), nation_cohorts(spark, d))["top_aisles"]


# ----------------------------------------------------------------------------------- unlearning

from trolley.operators import diff as DF  # noqa: E402
from trolley.operators import unlearn as U  # noqa: E402
from trolley.streaming import maintain as MT  # noqa: E402

# Deletion set of the unlearning queries: every purchase of the most-bought product (a recall).
RECALL_CTES = (
    "top_item AS (SELECT product_id FROM ln GROUP BY product_id "
    "ORDER BY COUNT(DISTINCT user_id) DESC, product_id LIMIT 1)",
    "del AS (SELECT DISTINCT user_id, product_id AS item_id FROM ln "
    "WHERE product_id IN (SELECT product_id FROM top_item))",
    "ln2 AS (SELECT ln.* FROM ln WHERE NOT EXISTS "
    "(SELECT 1 FROM del WHERE del.user_id = ln.user_id AND del.item_id = ln.product_id))",
    "chg AS (SELECT DISTINCT user_id FROM del)",
)
# Deletion set of the single-entry query: the item of the most recent order line.
LATEST_CTES = (
    "del AS (SELECT l.user_id, l.product_id AS item_id FROM ln l JOIN po ON po.order_id = l.order_id "
    "ORDER BY po.order_ts DESC, l.order_id DESC, l.product_id DESC LIMIT 1)",
    "ln2 AS (SELECT ln.* FROM ln WHERE NOT EXISTS "
    "(SELECT 1 FROM del WHERE del.user_id = ln.user_id AND del.item_id = ln.product_id))",
)
NEW_MODEL_CTES = (S.interactions_cte("ln2", "inter2"), S.neighbors_cte(50, "inter2", "nbr2"),
                  S.embeddings_cte("ln2", "emb2"), S.recommendations_cte("nbr2", "emb2", name="rec2"))
UNL_CTES = MODEL_CTES + (S.recommendations_cte(),) + RECALL_CTES + NEW_MODEL_CTES


def forget_run(spark, d, which: str = "recall"):
    """The state before and after forgetting the data-derived deletion set, built for the calling key alone."""
    p = load_purchases(spark, d)
    st = build_state(p)
    return st, U.forget(st, U.most_bought_item_deletions(p) if which == "recall" else U.latest_line(p))


def _deleted(spark, d):
    """The purchases before and after the recall deletion, and its requests: enough for the keys that need no model."""
    p = load_purchases(spark, d)
    dels = U.most_bought_item_deletions(p)
    return p, U.apply_deletions(p, dels), dels


def _keyed_sql(old: str, new: str, keys: list[str], value: str, where: str = "") -> str:
    on = " AND ".join(f"o.{k} = n.{k}" for k in keys)
    sel = ", ".join(f"COALESCE(o.{k}, n.{k}) AS {k}" for k in keys)
    return f"""
SELECT * FROM (
  SELECT {sel},
         COALESCE({S.q('n.' + value)}, 0.0) - COALESCE({S.q('o.' + value)}, 0.0) AS delta,
         CASE WHEN o.{keys[0]} IS NULL THEN 'Insert' WHEN n.{keys[0]} IS NULL THEN 'Delete' ELSE 'Update' END
           AS change
  FROM (SELECT * FROM {old} {where}) o FULL OUTER JOIN (SELECT * FROM {new} {where}) n ON {on}) t
WHERE delta <> 0"""


@register("del_apply", S.with_ctes("SELECT order_id, product_id FROM ln2", *RECALL_CTES))
def q_del_apply(spark, d):
    return _deleted(spark, d)[1].order_products


@register("unl_vanished", S.with_ctes("""
SELECT user_id, item_id FROM inter EXCEPT SELECT user_id, item_id FROM inter2""",
                                      S.interactions_cte(), *RECALL_CTES, S.interactions_cte("ln2", "inter2")))
def q_unl_vanished(spark, d):
    old, new, _ = _deleted(spark, d)
    return U.vanished(EM.interactions(old), EM.interactions(new))


@register("unl_embeddings", S.with_ctes(f"SELECT user_id, item_id, {S.q('weight')} AS weight FROM emb2",
                                        *RECALL_CTES, S.embeddings_cte("ln2", "emb2")))
def q_unl_embeddings(spark, d):
    st, res = forget_run(spark, d)
    return _rounded(res.state.embeddings, "weight")


@register("unl_norms", S.with_ctes("""
SELECT user_id, SUM(value * value) AS nsq, sqrt(SUM(value * value)) AS norm FROM inter2
WHERE user_id IN (SELECT user_id FROM chg) GROUP BY user_id""", *RECALL_CTES, S.interactions_cte("ln2", "inter2")))
def q_unl_norms(spark, d):
    _, new, dels = _deleted(spark, d)
    return U.updated_norms(EM.interactions(new), dels.select("user_id").distinct())


AFFECTED_CTE = ("aff AS (SELECT DISTINCT user_id FROM inter WHERE item_id IN "
                "(SELECT item_id FROM inter WHERE user_id IN (SELECT user_id FROM chg)) "
                "AND user_id NOT IN (SELECT user_id FROM chg))")


@register("unl_affected", S.with_ctes("SELECT user_id FROM aff", *UNL_CTES, AFFECTED_CTE))
def q_unl_affected(spark, d):
    old, _, dels = _deleted(spark, d)
    return U.affected_users(EM.interactions(old), dels.select("user_id").distinct())


# The merge rule of the incremental maintenance written out in SQL:
# kept = old list minus changed users, cand = best 50 changed users by new similarity, merged =
# top 50 of both; exact when the old list was short, or when merged is full and its last entry does
# not rank after the old last one.
LABEL_CTES = (
    AFFECTED_CTE,
    "nsq2 AS (SELECT user_id, SUM(value * value) AS nsq FROM inter2 GROUP BY user_id)",
    """cand AS (SELECT user_id, neighbor_id, similarity FROM (
         SELECT s.*, row_number() OVER (PARTITION BY user_id ORDER BY similarity DESC, neighbor_id) AS r FROM (
           SELECT a.user_id, c.user_id AS neighbor_id,
                  SUM(a.value * c.value) / (sqrt(na.nsq) * sqrt(nc.nsq)) AS similarity
           FROM inter2 a JOIN inter2 c ON a.item_id = c.item_id
                JOIN nsq2 na ON na.user_id = a.user_id JOIN nsq2 nc ON nc.user_id = c.user_id
           WHERE a.user_id IN (SELECT user_id FROM aff) AND c.user_id IN (SELECT user_id FROM chg)
           GROUP BY a.user_id, c.user_id, na.nsq, nc.nsq) s) t WHERE r <= 50)""",
    """merged AS (SELECT user_id, neighbor_id, similarity, rank FROM (
         SELECT u.*, row_number() OVER (PARTITION BY user_id ORDER BY similarity DESC, neighbor_id) AS rank FROM (
           SELECT user_id, neighbor_id, similarity FROM nbr
           WHERE user_id IN (SELECT user_id FROM aff) AND neighbor_id NOT IN (SELECT user_id FROM chg)
           UNION ALL SELECT user_id, neighbor_id, similarity FROM cand) u) t WHERE rank <= 50)""",
    """lab AS (SELECT a.user_id,
         CASE WHEN NOT (COALESCE(o.n, 0) < 50 OR (COALESCE(m.n, 0) = 50 AND (m.s > o.s OR (m.s = o.s AND m.v <= o.v))))
              THEN 'recompute'
              WHEN COALESCE(x.same, 0) = COALESCE(o.n, 0) AND COALESCE(m.n, 0) = COALESCE(o.n, 0) THEN 'unchanged'
              ELSE 'updated' END AS label
       FROM aff a
       LEFT JOIN (SELECT user_id, COUNT(*) AS n, MAX(CASE WHEN rank = 50 THEN similarity END) AS s,
                         MAX(CASE WHEN rank = 50 THEN neighbor_id END) AS v
                  FROM nbr WHERE user_id IN (SELECT user_id FROM aff) GROUP BY user_id) o ON o.user_id = a.user_id
       LEFT JOIN (SELECT user_id, COUNT(*) AS n, MAX(CASE WHEN rank = 50 THEN similarity END) AS s,
                         MAX(CASE WHEN rank = 50 THEN neighbor_id END) AS v
                  FROM merged GROUP BY user_id) m ON m.user_id = a.user_id
       LEFT JOIN (SELECT m.user_id, COUNT(*) AS same FROM merged m JOIN nbr n
                  ON n.user_id = m.user_id AND n.neighbor_id = m.neighbor_id AND n.similarity = m.similarity
                  GROUP BY m.user_id) x ON x.user_id = a.user_id)""",
)


@register("unl_classify", S.with_ctes("SELECT user_id, label FROM lab", *UNL_CTES, *LABEL_CTES))
def q_unl_classify(spark, d):
    st, res = forget_run(spark, d)
    return res.maintenance.labels


@register("unl_recompute", S.with_ctes("""
SELECT * FROM nbr2 WHERE user_id IN (SELECT user_id FROM lab WHERE label = 'recompute' UNION SELECT user_id FROM chg)""",
                                       *UNL_CTES, *LABEL_CTES))
def q_unl_recompute(spark, d):
    st, res = forget_run(spark, d)
    return res.maintenance.recomputed


@register("unl_forget_one", S.with_ctes("SELECT * FROM nbr2", *LATEST_CTES,
                                        S.interactions_cte("ln2", "inter2"), S.neighbors_cte(50, "inter2", "nbr2")))
def q_unl_forget_one(spark, d):
    st, res = forget_run(spark, d, "latest")
    return res.state.neighbors


@register("unl_forget_many", S.with_ctes("SELECT * FROM nbr2", *UNL_CTES))
def q_unl_forget_many(spark, d):
    st, res = forget_run(spark, d)
    return res.state.neighbors


@register("unl_forget", S.with_ctes(f"SELECT user_id, item_id, {S.q('score')} AS score, rank FROM rec2", *UNL_CTES))
def q_unl_forget(spark, d):
    st, res = forget_run(spark, d)
    new = res.state
    return _rounded(P.recommend(new.neighbors, new.embeddings), "score")


@register("unl_counters", S.with_ctes("SELECT label, COUNT(*) AS num_users FROM lab GROUP BY label",
                                      *LATEST_CTES, S.interactions_cte(), S.neighbors_cte(50),
                                      S.interactions_cte("ln2", "inter2"),
                                      "chg AS (SELECT DISTINCT user_id FROM del)", *LABEL_CTES))
def q_unl_counters(spark, d):
    st, res = forget_run(spark, d, "latest")
    return U.counters(res.maintenance.labels)


def _rec_diff(st, res):
    c = res.changed
    old = P.recommend(st.neighbors, st.embeddings, users=c)
    new = P.recommend(res.state.neighbors, res.state.embeddings, users=c)
    return DF.keyed_diff(old, new, ["user_id", "item_id"], "score")


REC_DIFF_SQL = _keyed_sql("rec", "rec2", ["user_id", "item_id"], "score",
                          "WHERE user_id IN (SELECT user_id FROM chg)")


@register("diff_recs", S.with_ctes(f"SELECT user_id, item_id, delta, change FROM ({REC_DIFF_SQL}) r", *UNL_CTES))
def q_diff_recs(spark, d):
    st, res = forget_run(spark, d)
    return _rec_diff(st, res).select("user_id", "item_id", "delta", "change")


@register("diff_embedding", S.with_ctes(f"""
SELECT o.user_id, o.item_id, COALESCE({S.q('n.weight')}, 0.0) - {S.q('o.weight')} AS delta
FROM emb o LEFT JOIN emb2 n ON n.user_id = o.user_id AND n.item_id = o.item_id
WHERE o.user_id IN (SELECT user_id FROM chg)
  AND COALESCE({S.q('n.weight')}, 0.0) - {S.q('o.weight')} <> 0""", *UNL_CTES))
def q_diff_embedding(spark, d):
    st, res = forget_run(spark, d)
    return DF.embedding_diff(st.embeddings, res.state.embeddings, res.changed)


OUT_DIFF_SQL = _keyed_sql("nbr", "nbr2", ["user_id", "neighbor_id"], "similarity",
                          "WHERE user_id IN (SELECT user_id FROM chg)")


@register("diff_out", S.with_ctes(f"SELECT user_id, neighbor_id, delta, change FROM ({OUT_DIFF_SQL}) t", *UNL_CTES))
def q_diff_out(spark, d):
    st, res = forget_run(spark, d)
    old = K.neighbors_of(st.neighbors, res.changed)
    new = K.neighbors_of(res.state.neighbors, res.changed)
    return DF.keyed_diff(old, new, ["user_id", "neighbor_id"], "similarity") \
        .select("user_id", "neighbor_id", "delta", "change")


IN_DIFF_SQL = _keyed_sql(
    "(SELECT neighbor_id AS user_id, user_id AS in_neighbor_id, similarity FROM nbr)",
    "(SELECT neighbor_id AS user_id, user_id AS in_neighbor_id, similarity FROM nbr2)",
    ["user_id", "in_neighbor_id"], "similarity", "WHERE user_id IN (SELECT user_id FROM chg)")


@register("diff_in", S.with_ctes(f"SELECT user_id, in_neighbor_id, delta, change FROM ({IN_DIFF_SQL}) t",
                                 *UNL_CTES))
def q_diff_in(spark, d):
    st, res = forget_run(spark, d)
    old = K.in_neighbors_of(st.neighbors, res.changed)
    new = K.in_neighbors_of(res.state.neighbors, res.changed)
    return DF.keyed_diff(old, new, ["user_id", "in_neighbor_id"], "similarity") \
        .select("user_id", "in_neighbor_id", "delta", "change")


NBH_CTES = (
    "nm1 AS (SELECT user_id AS ego_id, neighbor_id AS user_id FROM nbr WHERE user_id IN (SELECT user_id FROM chg) "
    "UNION SELECT neighbor_id AS ego_id, user_id FROM nbr WHERE neighbor_id IN (SELECT user_id FROM chg))",
    "nm2 AS (SELECT user_id AS ego_id, neighbor_id AS user_id FROM nbr2 WHERE user_id IN (SELECT user_id FROM chg) "
    "UNION SELECT neighbor_id AS ego_id, user_id FROM nbr2 WHERE neighbor_id IN (SELECT user_id FROM chg))",
    "ta1 AS (" + top_aisles_sql("nm1", "ego_id") + ")",
    "ta2 AS (" + top_aisles_sql("nm2", "ego_id", lines="ln2") + ")",
)


@register("diff_aisles", S.with_ctes(
    "SELECT ego_id, aisle_id, delta, change FROM ("
    + _keyed_sql("ta1", "ta2", ["ego_id", "aisle_id"], "normalized_count") + ") t", *UNL_CTES, *NBH_CTES))
def q_diff_aisles(spark, d):
    st, res = forget_run(spark, d)
    old = G.neighborhoods(st.purchases, st.neighbors, res.changed)["top_aisles"]
    new = G.neighborhoods(res.state.purchases, res.state.neighbors, res.changed)["top_aisles"]
    return DF.keyed_diff(old, new, ["ego_id", "aisle_id"], "normalized_count") \
        .select("ego_id", "aisle_id", "delta", "change")


@register("diff_counts", S.with_ctes(f"""
SELECT user_id, SUM(CASE WHEN change = 'Delete' THEN 1 ELSE 0 END)::BIGINT AS num_delete,
       SUM(CASE WHEN change = 'Update' THEN 1 ELSE 0 END)::BIGINT AS num_update,
       SUM(CASE WHEN change = 'Insert' THEN 1 ELSE 0 END)::BIGINT AS num_insert
FROM ({OUT_DIFF_SQL}) t GROUP BY user_id""", *UNL_CTES))
def q_diff_counts(spark, d):
    return DF.change_counts(q_diff_out(spark, d))


@register("diff_report", S.with_ctes(f"""
SELECT r.user_id, r.item_id, r.delta, r.change, pr.aisle_id,
       COALESCE(pr.aisle_id IN {S.aisles_in('alcohol')}, FALSE) AS sensitive, pr.product_name,
       CASE WHEN r.delta > 0 THEN 'up' ELSE 'down' END AS direction
FROM ({REC_DIFF_SQL}) r LEFT JOIN pr ON pr.product_id = r.item_id""", *UNL_CTES))
def q_diff_report(spark, d):
    st, res = forget_run(spark, d)
    diff = _rec_diff(st, res).select("user_id", "item_id", "delta", "change")
    return DF.change_report(res.state.purchases, diff, "alcohol")


EMB_DIFF_SQL = f"""
SELECT o.user_id, o.item_id, COALESCE({S.q('n.weight')}, 0.0) - {S.q('o.weight')} AS delta
FROM emb o LEFT JOIN emb2 n ON n.user_id = o.user_id AND n.item_id = o.item_id
WHERE o.user_id IN (SELECT user_id FROM chg)
  AND COALESCE({S.q('n.weight')}, 0.0) - {S.q('o.weight')} <> 0"""


AISLE_DIFF_SQL = ("SELECT ego_id AS user_id, aisle_id, delta, change FROM ("
                  + _keyed_sql("ta1", "ta2", ["ego_id", "aisle_id"], "normalized_count") + ") t")


def _changes_of(sql: str, name: str) -> str:
    return f"LEFT JOIN (SELECT user_id, COUNT(*) AS n FROM ({sql}) t GROUP BY user_id) {name} ON {name}.user_id = del.user_id"


@register("unl_impact", S.with_ctes(f"""
SELECT del.user_id, del.item_id, b.basket_ids,
       COALESCE(e.n, 0) AS num_embedding_changes, COALESCE(r.n, 0) AS num_recommendation_changes,
       COALESCE(j.n, 0) AS num_adjacent_changes, COALESCE(i.n, 0) AS num_incident_changes,
       COALESCE(a.n, 0) AS num_aisle_changes,
       (SELECT COUNT(*) FROM lab) AS num_inspected_lists,
       (SELECT COUNT(*) FROM lab WHERE label <> 'unchanged') AS num_updated_lists
FROM del
LEFT JOIN (SELECT user_id, product_id, list_sort(list(DISTINCT order_id)) AS basket_ids FROM ln
           GROUP BY user_id, product_id) b ON b.user_id = del.user_id AND b.product_id = del.item_id
{_changes_of(EMB_DIFF_SQL, "e")}
{_changes_of(REC_DIFF_SQL, "r")}
{_changes_of(OUT_DIFF_SQL, "j")}
{_changes_of(IN_DIFF_SQL, "i")}
{_changes_of(AISLE_DIFF_SQL, "a")}""", *UNL_CTES, *NBH_CTES, *LABEL_CTES))
def q_unl_impact(spark, d):
    st, res = forget_run(spark, d)
    diffs = MT.impact_diffs(st, res.state, res.changed)
    return U.impact_summary(res, {**diffs, "recommendation": _rec_diff(st, res)}, with_timings=False)


@register("diff_counts_in", S.with_ctes(f"""
SELECT user_id, SUM(CASE WHEN change = 'Delete' THEN 1 ELSE 0 END)::BIGINT AS num_delete,
       SUM(CASE WHEN change = 'Update' THEN 1 ELSE 0 END)::BIGINT AS num_update,
       SUM(CASE WHEN change = 'Insert' THEN 1 ELSE 0 END)::BIGINT AS num_insert
FROM ({IN_DIFF_SQL}) t GROUP BY user_id""", *UNL_CTES))
def q_diff_counts_in(spark, d):
    return DF.change_counts(q_diff_in(spark, d))


@register("diff_report_aisles", S.with_ctes(f"""
SELECT user_id, aisle_id, delta, change, aisle_id IN {S.aisles_in('alcohol')} AS sensitive,
       CASE WHEN delta > 0 THEN 'up' ELSE 'down' END AS direction
FROM ({AISLE_DIFF_SQL}) t""", *UNL_CTES, *NBH_CTES))
def q_diff_report_aisles(spark, d):
    st, res = forget_run(spark, d)
    diff = MT.impact_diffs(st, res.state, res.changed)["aisle"].select("user_id", "aisle_id", "delta", "change")
    return DF.aisle_report(st.purchases, diff, "alcohol")


# ------------------------------------------------------------------------------------- streaming

from trolley.plans.model_store import ModelStore  # noqa: E402
from trolley.streaming import changes as CH  # noqa: E402
from trolley.streaming import maintain as MT  # noqa: E402
from trolley.streaming import requests as RQ  # noqa: E402


def _recall_lines(p):
    """Order lines ``(order_id, user_id, product_id)`` of the recall deletion set (every line)."""
    from trolley.sources.purchases import lines as _lines
    dels = U.most_bought_item_deletions(p).withColumnRenamed("item_id", "product_id")
    return _lines(p).join(dels, ["user_id", "product_id"], "left_semi")


def _request_files(spark, d, folder):
    p = load_purchases(spark, d)
    RQ.to_request_json(U.most_bought_item_deletions(p)).write.mode("overwrite").text(folder)
    return f"{folder}/*.txt"


@register("stream_requests", S.with_ctes(
    "SELECT 'PurchaseDeletion' AS kind, user_id, item_id FROM del", *RECALL_CTES))
def q_stream_requests(spark, d):
    root = CH.run_folder(spark, "requests")
    glob = _request_files(spark, d, f"{root}/in")
    parsed = RQ.parse_requests(spark.readStream.format("text").load(glob))
    q = (parsed.writeStream.format("parquet").option("path", f"{root}/out")
         .option("checkpointLocation", f"{root}/_checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out").select("kind", "user_id", "item_id")


def _change_log(spark, d):
    from trolley.sources.purchases import lines as _lines
    p = load_purchases(spark, d)
    root = CH.run_folder(spark, "changes")
    glob = CH.write_change_files([CH.in_files(MT.line_changes(_lines(p), +1)),
                                  CH.in_files(MT.line_changes(_recall_lines(p), -1))], f"{root}/in")
    return p, root, glob


@register("stream_changes", S.with_ctes("""
SELECT order_id AS basket_id, user_id, product_id AS item_id, COUNT(*) AS mult FROM ln2
GROUP BY order_id, user_id, product_id""", *RECALL_CTES))
def q_stream_changes(spark, d):
    p, root, glob = _change_log(spark, d)
    v = CH.run_change_log(spark, glob, root, max_files=2)
    return CH.live_lines(CH.lines_at(spark, root, v)).select(*CH.KEYS, "mult")


@register("stream_interactions", S.with_ctes("SELECT DISTINCT user_id, product_id AS item_id FROM ln2",
                                             *RECALL_CTES))
def q_stream_interactions(spark, d):
    p, root, glob = _change_log(spark, d)
    v = CH.run_change_log(spark, glob, root, max_files=2)
    return CH.live_interactions(CH.lines_at(spark, root, v))


@register("stream_maintain", S.with_ctes("SELECT * FROM nbr2", *UNL_CTES))
def q_stream_maintain(spark, d):
    p = load_purchases(spark, d)
    root = CH.run_folder(spark, "maintain")
    glob = _request_files(spark, d, f"{root}/in")
    st = build_state(p)
    v = MT.maintain_stream(spark, st, glob, root, max_files=1)
    return ModelStore.at(st, f"{root}/model").read("neighbors", v)


@register("stream_maintain_changes", S.with_ctes("SELECT * FROM nbr2", *UNL_CTES))
def q_stream_maintain_changes(spark, d):
    """From a model without purchases: all order lines as insertions, then the removals of the recall."""
    p, root, glob = _change_log(spark, d)
    empty = build_state(p.with_(orders=p.orders.where(F.lit(False)), order_products=p.order_products.where(F.lit(False))))
    v = MT.maintain_changes(spark, empty, glob, root, orders=p.orders, max_files=1)
    return ModelStore.at(empty, f"{root}/model").read("neighbors", v)


@register("sim_in_maintained", S.with_ctes("""
SELECT neighbor_id AS user_id, user_id AS in_neighbor_id, similarity FROM nbr2
WHERE neighbor_id IN (SELECT user_id FROM coh)""", NATION_COHORTS_CTE, *UNL_CTES))
def q_sim_in_maintained(spark, d):
    """K7 from the reverse lists of a lasting store after a forget."""
    p = load_purchases(spark, d)
    st = build_state(p)
    store = ModelStore.at(st, CH.run_folder(spark, "reverse"))
    res = U.forget(store.state(st, 0), U.most_bought_item_deletions(p))
    return res.state.in_neighbors(nation_cohorts(spark, d))


@register("stream_embeddings", S.with_ctes(f"SELECT user_id, item_id, {S.q('weight')} AS weight FROM emb2",
                                           *RECALL_CTES, S.embeddings_cte("ln2", "emb2")))
def q_stream_embeddings(spark, d):
    p, root, glob = _change_log(spark, d)
    v = MT.embedding_stream(spark, glob, root, p.orders, max_files=2)
    return _rounded(MT.vector_table(spark, root).read(v), "weight")


# ------------------------------------------------------------------------- index store, changes

from trolley.sources.store import load_index, save_index  # noqa: E402


@register("idx_roundtrip", S.with_ctes("SELECT * FROM nbr", S.interactions_cte(), S.neighbors_cte(50)))
def q_idx_roundtrip(spark, d):
    from trolley.session import materialize
    p = load_purchases(spark, d)
    I = materialize(EM.interactions(p))
    N = K.build_neighbors(I, 50)
    path = CH.run_folder(spark, "index")
    save_index({"interactions": I, "norms": K.norms(I), "neighbors": N}, 50, path)
    parts, k = load_index(spark, path)
    return parts["neighbors"].where(F.col("rank") <= k)


@register("emb_changed", S.with_ctes(f"""
SELECT DISTINCT COALESCE(o.user_id, n.user_id) AS user_id
FROM emb o FULL OUTER JOIN emb2 n ON o.user_id = n.user_id AND o.item_id = n.item_id
WHERE o.user_id IS NULL OR n.user_id IS NULL OR {S.q('o.weight')} <> {S.q('n.weight')}""", *UNL_CTES))
def q_emb_changed(spark, d):
    st, res = forget_run(spark, d)
    return EM.changed_users(st.embeddings, res.state.embeddings)


@register("stream_embeddings_keyed", S.with_ctes(f"SELECT user_id, item_id, {S.q('weight')} AS weight FROM emb2",
                                                 *RECALL_CTES, S.embeddings_cte("ln2", "emb2")))
def q_stream_embeddings_keyed(spark, d):
    from trolley.streaming.keyed import keyed_embedding_stream, vectors_at
    p, root, glob = _change_log(spark, d)
    v = keyed_embedding_stream(spark, glob, root, max_files=2)
    return _rounded(vectors_at(spark, root, v), "weight")


@register("stream_embeddings_ordered", S.with_ctes(
    f"SELECT user_id, item_id, {S.q('weight')} AS weight FROM oemb2",
    *RECALL_CTES, S.ordered_embeddings_cte(_P.group_size, _P.r_basket, _P.r_group, "oemb2", "ln2")))
def q_stream_embeddings_ordered(spark, d):
    from trolley.streaming.ordered import ordered_embedding_stream, vectors_at
    p, root, glob = _change_log(spark, d)
    v = ordered_embedding_stream(spark, glob, root, p.orders, order_by=p.order_by, max_files=2)
    return _rounded(vectors_at(spark, root, v), "weight")
