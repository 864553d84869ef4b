"""Forgetting purchases and maintaining the model incrementally.

``forget(state, deletions)`` takes a *set* of ``(user_id, item_id)`` requests and returns the new
state plus its impact; the result equals a rebuild on the surviving rows:

  1. S4   delete every order line of the user holding the item (anti join); absent pairs are
          rejected, repeated requests collapse.
  2. U2   embeddings of the changed users C are recomputed from their remaining lines; every
          other user's rows are kept.
  3. U8   affected users A = users that shared a pre-deletion item with C (a semi join through
          the touched items, linear in their rows), minus C.
  4. U9   for v in A: kept = L(v) minus C, cand = best k of {(c, new sim(c, v)) : c in C, sim > 0},
          merged = top-k(kept + cand) under (similarity desc, id asc). If L(v) was not full, or
          merged has k entries and its last does not rank after the old last, merged is exact
          ("unchanged" when equal to L(v), else "updated"); otherwise v is recomputed.
  5. U10  recompute the lists of C and of flagged users from the new rows (left side = those
          users, right side = all rows). The same steps run for one request and for many.

A user that lost all rows disappears from every list (it has no norm); an emptied basket simply
has no lines. Nothing is collected to the driver except row counts used to size blocks. Every table
that later steps read more than once is written to the shared checkpoint folder first.
"""

from __future__ import annotations

import math
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trolley.functions.measures import COSINE, Measure
from trolley.operators import embeddings as EM
from trolley.operators import similarity as K
from trolley.operators.relational import baskets_of
from trolley.plans.model_store import ModelStore
from trolley.plans.state import ModelState
from trolley.schema import EMBEDDINGS, INTERACTIONS, NEIGHBORS, check_columns
from trolley.session import checkpoint_root, materialize, parallelism
from trolley.sources.purchases import Purchases

# ------------------------------------------------------------------------------ S4, U3, U5

def split_requests(I_old: DataFrame, deletions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted requests (present interactions, distinct) and rejected ones with a reason."""
    d = deletions.select(F.col("user_id").cast("long"), F.col("item_id").cast("long")).distinct()
    present = I_old.select("user_id", "item_id")
    accepted = d.join(present, ["user_id", "item_id"], "left_semi")
    rejected = (d.join(present, ["user_id", "item_id"], "left_anti")
                .withColumn("reason", F.lit("not purchased")))
    return accepted, rejected


def apply_deletions(p: Purchases, deletions: DataFrame) -> Purchases:
    """Remove every order line of a user holding a requested item; other tables unchanged."""
    gone = baskets_of(p, deletions).select("order_id", F.col("item_id").alias("product_id"))
    op = p.order_products.join(gone, ["order_id", "product_id"], "left_anti")
    return p.with_(order_products=op)


def vanished(I_old: DataFrame, I_new: DataFrame) -> DataFrame:
    """``(user_id, item_id)`` pairs that left the distinct interaction set."""
    return I_old.select("user_id", "item_id").join(I_new.select("user_id", "item_id"),
                                                   ["user_id", "item_id"], "left_anti")


def updated_norms(I_new: DataFrame, changed: DataFrame, measure: Measure = COSINE) -> DataFrame:
    """Exact masses of the changed users from their remaining rows (no sqrt drift)."""
    return K.norms(I_new.join(changed, "user_id", "left_semi"), measure)


# ------------------------------------------------------------------------------ U2

def refresh_embeddings(E_old: DataFrame, p_new: Purchases, changed: DataFrame, state: ModelState) -> DataFrame:
    """Recompute the changed users' vectors from their remaining lines; keep all other rows."""
    return E_old.join(changed, "user_id", "left_anti").unionByName(fresh_embeddings(p_new, changed, state))


def lines_of_users(p: Purchases, users: DataFrame) -> Purchases:
    """The purchases of some users alone."""
    o = p.orders.join(users, "user_id", "left_semi")
    return p.with_(orders=o, order_products=p.order_products.join(o.select("order_id"), "order_id", "left_semi"))


def fresh_embeddings(p_new: Purchases, changed: DataFrame, state: ModelState) -> DataFrame:
    """The vectors of the changed users alone, from their remaining lines."""
    return EM.embeddings(lines_of_users(p_new, changed), state.params, state.ordered)


# ------------------------------------------------------------------------------ U8-U11

def affected_users(I_old: DataFrame, changed: DataFrame) -> DataFrame:
    """U8: users outside C that shared any item of ``I_old`` (before a deletion; before or after other changes) with a user of C."""
    items = I_old.join(changed, "user_id", "left_semi").select("item_id").distinct()
    return (I_old.join(items, "item_id", "left_semi").select("user_id").distinct()
            .join(changed, "user_id", "left_anti"))


def _rows_blocks(n_rows: int, spark=None) -> int:
    per = K.rows_per_block(spark) if spark is not None else K.ROWS_PER_BLOCK
    return max(1, math.ceil(n_rows / per))


def merge_candidates(N_old: DataFrame, I_new: DataFrame, changed: DataFrame, affected: DataFrame,
                     k: int, left_blocks: int, longest_row: int | None = None,
                     measure: Measure = COSINE) -> DataFrame:
    """U9 part 1: ``top-k(L(v) minus C  +  best k changed users by new similarity)`` per affected v."""
    rows_a = I_new.join(affected, "user_id", "left_semi")
    rows_c = I_new.join(changed, "user_id", "left_semi")
    cand = K.neighbors_for(rows_a, rows_c, k, left_blocks=left_blocks, longest_row=longest_row, measure=measure)
    return merge_lists(N_old.join(affected, "user_id", "left_semi"), changed, cand, k)


def merge_lists(old_lists: DataFrame, changed: DataFrame, cand: DataFrame, k: int) -> DataFrame:
    """``top-k((old list minus changed users) + candidate entries of changed users)`` per list owner.

    ``cand`` holds the new ``(user_id, neighbor_id, similarity)`` of changed neighbours with a
    positive similarity; a changed neighbour absent from ``cand`` left the list (similarity 0).
    """
    kept = old_lists.join(changed.select(F.col("user_id").alias("neighbor_id")), "neighbor_id", "left_anti")
    return K.top_k(kept.select("user_id", "neighbor_id", "similarity")
                   .unionByName(cand.select("user_id", "neighbor_id", "similarity")), k)


def label_lists(N_old: DataFrame, merged: DataFrame, affected: DataFrame, k: int) -> DataFrame:
    """U9 part 2: ``(user_id, label)`` with label unchanged / updated / recompute (rule in the module doc)."""
    old_a = N_old.join(affected, "user_id", "left_semi")
    last = F.struct("similarity", "neighbor_id")
    old_stats = old_a.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("old_len"), F.max(F.when(F.col("rank") == k, last)).alias("old_last"))
    new_stats = merged.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("new_len"), F.max(F.when(F.col("rank") == k, last)).alias("new_last"))
    same = (merged.join(old_a, ["user_id", "neighbor_id", "similarity"])
            .groupBy("user_id").agg(F.count(F.lit(1)).alias("same")))
    s = (affected.join(old_stats, "user_id", "left").join(new_stats, "user_id", "left")
         .join(same, "user_id", "left").fillna(0, ["old_len", "new_len", "same"]))
    # merged last ranks no later than the old last: higher similarity, or equal and smaller id
    not_later = ((F.col("new_last.similarity") > F.col("old_last.similarity")) |
                 ((F.col("new_last.similarity") == F.col("old_last.similarity")) &
                  (F.col("new_last.neighbor_id") <= F.col("old_last.neighbor_id"))))
    exact = (F.col("old_len") < k) | ((F.col("new_len") == k) & F.coalesce(not_later, F.lit(False)))
    unchanged = (F.col("same") == F.col("old_len")) & (F.col("new_len") == F.col("old_len"))
    label = (F.when(~exact, F.lit("recompute"))
              .when(unchanged, F.lit("unchanged")).otherwise(F.lit("updated")))
    return s.select("user_id", label.alias("label"))


def recompute(I_new: DataFrame, users: DataFrame, k: int, num_blocks: int, n_rows: int | None = None,
              longest_row: int | None = None, measure: Measure = COSINE) -> DataFrame:
    """Full top-k lists of the given users against all rows."""
    left = I_new.join(users, "user_id", "left_semi")
    lb = K.choose_blocks(I_new.sparkSession, n_rows) if n_rows is not None else max(1, num_blocks)
    return K.neighbors_for(left, I_new, k, left_blocks=lb, longest_row=longest_row, measure=measure)


@dataclass
class Maintenance:
    neighbors: DataFrame
    labels: DataFrame        # user_id, label (affected users only)
    affected: DataFrame
    recomputed: DataFrame    # the lists of the changed users and of those labelled recompute
    rewritten: DataFrame     # user_id of every list that is not provably unchanged, the changed users' included
    rows: DataFrame          # the new rows of the rewritten lists


def maintain_neighbors(N_old: DataFrame, I_old: DataFrame, I_new: DataFrame, changed: DataFrame,
                       k: int, num_blocks: int, measure: Measure = COSINE) -> Maintenance:
    """U6/U7 generalised to many users at once: the neighbour table after the deletions.

    ``I_new`` should be a written table; row counts only size the blocks. Affected users, merged
    lists, labels and recomputed lists are materialised, each being read by several steps.
    """
    spark = N_old.sparkSession
    affected = materialize(affected_users(I_old, changed))
    touched = (affected.withColumn("is_changed", F.lit(0))
               .unionByName(changed.select("user_id").withColumn("is_changed", F.lit(1))))
    # one aggregation sizes the blocks and tells whether a row is too long for them
    sizes = (I_new.groupBy("user_id").agg(F.count(F.lit(1)).alias("len")).join(touched, "user_id", "left")
             .agg(F.sum(F.when(F.col("is_changed").isNotNull(), F.col("len"))).alias("n_touched"),
                  F.max("len").alias("longest")).first())
    n_touched, longest = (int(sizes[x] or 0) for x in ("n_touched", "longest"))
    touched = touched.select("user_id")
    merged = materialize(merge_candidates(N_old, I_new, changed, affected, k,
                                          left_blocks=max(parallelism(spark), _rows_blocks(n_touched, spark)),
                                          longest_row=longest, measure=measure))
    labels = materialize(label_lists(N_old, merged, affected, k))
    redo = labels.where(F.col("label") == "recompute").select("user_id").unionByName(changed).distinct()
    n_redo = I_new.join(redo, "user_id", "left_semi").count()
    fresh = materialize(recompute(I_new, redo, k, num_blocks, n_redo, longest, measure))
    updated = merged.join(labels.where(F.col("label") == "updated"), "user_id", "left_semi")
    rewritten = labels.where(F.col("label") != "unchanged").select("user_id").unionByName(changed).distinct()
    cols = ["user_id", "neighbor_id", "similarity", "rank"]
    rows = updated.select(*cols).unionByName(fresh.select(*cols))
    new_n = N_old.join(rewritten, "user_id", "left_anti").select(*cols).unionByName(rows)
    return Maintenance(new_n, labels, affected, fresh, rewritten, rows)


def counters(labels: DataFrame) -> DataFrame:
    """Number of affected lists per outcome."""
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("num_users"))


# ------------------------------------------------------------------------------ U1, U16

@dataclass
class ForgetResult:
    state: ModelState
    accepted: DataFrame
    rejected: DataFrame
    changed: DataFrame
    maintenance: Maintenance
    durations_ms: dict
    baskets: DataFrame | None = None   # (user_id, item_id, order_id) of the deleted lines
    previous_neighbors: DataFrame | None = None


def forget(state: ModelState, deletions: DataFrame) -> ForgetResult:
    """Forget a set of purchases; the new state equals a rebuild on the remaining lines.

    Each table gets a delta (see ``plans.model_store``): order lines and interactions by tombstones, the
    changed users' vectors and the lists that are not provably unchanged as a whole. Nothing else is written
    again, whatever the size of the tables. The given state stays readable. Each duration is the wall
    clock around a table's commit.
    """
    checkpoint_root(state.interactions.sparkSession)
    check_columns(state.interactions, INTERACTIONS, "interactions")
    check_columns(state.embeddings, EMBEDDINGS, "embeddings")
    check_columns(state.neighbors, NEIGHBORS, "neighbors")
    t0 = time.time()
    store = state.store if state.store is not None else ModelStore.over(state)
    v = state.version + 1
    p_old = state.purchases
    accepted, rejected = split_requests(state.interactions, deletions)
    accepted = materialize(accepted)
    gone = materialize(baskets_of(p_old, accepted))
    p_new = p_old.with_(order_products=store.commit(
        "order_products", v, gone=gone.select("order_id", F.col("item_id").alias("product_id"))))
    I_new = store.commit("interactions", v, gone=accepted)
    changed = accepted.select("user_id").distinct()
    p_new = p_new.with_(orders=store.commit("orders", v))
    new_state, m, ms = _refresh(state, store, v, p_new, state.interactions, I_new, changed, t0)
    return ForgetResult(new_state, accepted, rejected, changed, m, ms, gone, state.neighbors)


def _refresh(state: ModelState, store: ModelStore, v: int, p_new: Purchases, I_seen: DataFrame, I_new: DataFrame,
             changed: DataFrame, t0: float) -> tuple[ModelState, Maintenance, dict]:
    """Vectors, lists and norms after the changed users' lines and interactions are committed as version ``v``.

    ``I_seen``: the interactions through which a list can hold a changed user, before or after.
    """
    t1 = time.time()
    E_new = store.commit("embeddings", v, gone=changed, rows=fresh_embeddings(p_new, changed, state))
    t2 = time.time()
    m = maintain_neighbors(state.neighbors, I_seen, I_new, changed, state.k, state.num_blocks, state.measure)
    m.neighbors = store.commit_lists(v, m.rewritten, m.rows)
    norms = state.norms.join(changed, "user_id", "left_anti").unionByName(updated_norms(I_new, changed, state.measure))
    store.seal(v)
    t3 = time.time()
    new_state = state.with_(purchases=p_new, interactions=I_new, embeddings=E_new, neighbors=m.neighbors, norms=norms,
                            store=store, version=v)
    return new_state, m, {"database_update": int((t1 - t0) * 1000), "embedding_update": int((t2 - t1) * 1000),
                          "topk_index_update": int((t3 - t2) * 1000)}


def forget_in_turn(state: ModelState, deletions: DataFrame) -> Iterator[tuple[ModelState, ForgetResult]]:
    """U1 with one version per request of a user: the state before each turn and the result of the turn.

    A user's accepted requests take turns by item id, and turn r forgets the r-th request of every user
    that has one. So each request has its own differences, also where a batch holds several of one user;
    there are as many turns as the user with the most requests has (at least one). The last state equals
    that of one ``forget`` of all.
    """
    accepted, _ = split_requests(state.interactions, deletions)
    turns = materialize(accepted.withColumn("turn", F.row_number().over(Window.partitionBy("user_id").orderBy("item_id"))))
    last = turns.agg(F.max("turn").alias("n")).first()["n"] or 1
    for turn in range(1, last + 1):
        res = forget(state, turns.where(F.col("turn") == turn))
        yield state, res
        state = res.state


# ------------------------------------------------------------------------------ U1 for insertions and removals

@dataclass
class LinesResult:
    state: ModelState
    changed: DataFrame       # users with a line that came or went
    rejected: DataFrame      # records without effect, and why
    maintenance: Maintenance
    durations_ms: dict


def change_lines(state: ModelState, changes: DataFrame, orders: DataFrame | None = None) -> LinesResult:
    """New and removed order lines through one input; the new state equals a rebuild on the resulting lines.

    ``changes``: ``(op, order_id, user_id, product_id)``, op = +1 (a line more) or -1 (one less); records of
    one line are summed first. Lines are a bag, so a line has a count, never below zero: what is removed
    beyond it is rejected, as are records with a null and records that name another user than the
    basket's (the stored one; of a new basket, the smallest named). ``orders``: the other columns of new
    baskets by ``order_id`` (time, number), null where it has none. Every table gets a delta, as in ``forget``.
    """
    spark = state.interactions.sparkSession
    t0 = time.time()
    store = state.store if state.store is not None else ModelStore.over(state)
    v, p = state.version + 1, state.purchases
    line = ["order_id", "product_id"]
    record = ["order_id", "user_id", "product_id"]
    net = changes.groupBy(*record).agg(F.sum(F.col("op").cast("long")).alias("op")).where(F.col("op") != 0)
    whole = net.dropna(subset=record)
    named = whole.groupBy("order_id").agg(F.min("user_id").alias("named"))
    stored = store.read("orders", v - 1, only=named).select("order_id", F.col("user_id").alias("stored"))
    owners = named.join(stored, "order_id", "left").select(
        "order_id", F.coalesce("stored", "named").alias("owner"), F.col("stored").isNull().alias("new"))
    have = store.read("order_products", v - 1, only=whole).groupBy(*line).agg(F.count(F.lit(1)).alias("have"))
    counted = materialize(
        net.join(owners, "order_id", "left").join(have, line, "left").fillna(0, ["have"])
        .withColumn("reason", F.when(F.col("order_id").isNull() | F.col("user_id").isNull() | F.col("product_id").isNull(), "null id")
                    .when(F.col("user_id") != F.col("owner"), "basket of another user")
                    .when(F.col("have") + F.col("op") < 0, "not that many lines"))
        .withColumn("keep", F.greatest(F.col("have") + F.col("op"), F.lit(0))))
    valid = counted.where((F.col("reason").isNull() | (F.col("reason") == "not that many lines")) & (F.col("keep") != F.col("have")))
    rejected = counted.where(F.col("reason").isNotNull()).select("op", *record, "reason")
    changed = materialize(valid.select("user_id").distinct())
    # a basket is new with its first line
    fresh = valid.where(F.col("new") & (F.col("keep") > 0)).select("order_id", "user_id").distinct()
    rest = [f for f in p.orders.schema.fields if f.name not in ("order_id", "user_id")]
    if orders is not None:
        extra = [f.name for f in rest if f.name in orders.columns]
        fresh = fresh.join(orders.select("order_id", *extra).dropDuplicates(["order_id"]), "order_id", "left")
    for f in rest:
        fresh = fresh if f.name in fresh.columns else fresh.withColumn(f.name, F.lit(None).cast(f.dataType))
    p_new = p.with_(
        orders=store.commit("orders", v, rows=fresh.select(*p.orders.columns)),
        order_products=store.commit("order_products", v, gone=valid, rows=valid.select(
            *line, F.explode(F.array_repeat(F.lit(0), F.col("keep").cast("int")))).select(*line)))
    mine = materialize(EM.interactions(lines_of_users(p_new, changed)))
    before = store.read("interactions", v - 1, only=changed)
    pair = ["user_id", "item_id"]
    I_new = store.commit("interactions", v, gone=before.join(mine, pair, "left_anti"), rows=mine.join(before, pair, "left_anti"))
    seen = state.interactions.select(*pair).unionByName(I_new.select(*pair))
    blocks = max(state.num_blocks, K.choose_blocks(spark, I_new.count()))
    new_state, m, ms = _refresh(state.with_(num_blocks=blocks), store, v, p_new, seen, I_new, changed, t0)
    return LinesResult(new_state, changed, rejected, m, ms)


def changed_lists(N_old: DataFrame, m: Maintenance) -> DataFrame:
    """The users whose list differs, by comparing a digest of each rewritten list before and after."""
    digest = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("neighbor_id", "similarity")).alias("x")]
    old = N_old.join(m.rewritten, "user_id", "left_semi").groupBy("user_id").agg(*digest)
    new = m.rows.groupBy("user_id").agg(*digest)
    same = old.join(new, ["user_id", "n", "x"], "left_semi").select("user_id")
    return old.select("user_id").unionByName(new.select("user_id")).distinct().join(same, "user_id", "left_anti")


def recommendation_users(result: "ForgetResult") -> DataFrame:
    """Users whose recommendations can differ after a forget: their list changed, a neighbour's
    (or their own) embedding changed."""
    via_neighbor = result.state.neighbors.join(result.changed.select(F.col("user_id").alias("neighbor_id")), "neighbor_id",
                                               "left_semi").select("user_id")
    return (changed_lists(result.previous_neighbors, result.maintenance).unionByName(via_neighbor)
            .unionByName(result.changed.select("user_id")).distinct())


def refresh_recommendations(old_recs: DataFrame, result: "ForgetResult", alpha: float, n: int) -> DataFrame:
    """New top-n lists: recomputed for the users that can change, kept for everybody else."""
    from trolley.operators.recommend import recommend
    st = result.state
    users = recommendation_users(result)
    fresh = recommend(st.neighbors, st.embeddings, alpha, n, users=users)
    return old_recs.join(users, "user_id", "left_anti").unionByName(fresh.select(*old_recs.columns))


def latest_line(p: Purchases) -> DataFrame:
    """A one-row deletion set from the data: the item of the most recent order line."""
    l = p.order_products.join(p.orders.select("order_id", "user_id", *p.order_by), "order_id")
    order = [F.col(c).desc() for c in p.order_by] + [F.col("order_id").desc(), F.col("product_id").desc()]
    return (l.orderBy(*order)
            .limit(1).select("user_id", F.col("product_id").alias("item_id")))


def most_bought_item_deletions(p: Purchases) -> DataFrame:
    """Deletion set from the data: every purchase of the product with the most distinct buyers
    (a recall); ties go to the smaller product id."""
    l = p.order_products.join(p.orders.select("order_id", "user_id"), "order_id")
    top = (l.groupBy("product_id").agg(F.countDistinct("user_id").alias("buyers"))
           .orderBy(F.col("buyers").desc(), F.col("product_id")).limit(1).select("product_id"))
    return (l.join(top, "product_id").select("user_id", F.col("product_id").alias("item_id")).distinct())


IMPACT_DIFFS = ("embedding", "recommendation", "adjacent", "incident", "aisle")


def impact_summary(result: ForgetResult, diffs: dict[str, DataFrame], with_timings: bool = True) -> DataFrame:
    """U16: one record per forgotten ``(user_id, item_id)``.

    Its deleted baskets, the size of each difference set of its user (``diffs`` by name, see
    ``IMPACT_DIFFS``; each has a ``user_id``), and the batch's counters of inspected (affected) and
    updated (not unchanged) lists. With timings, the batch's durations too.
    """
    out = result.accepted.select("user_id", "item_id").join(
        result.baskets.groupBy("user_id", "item_id").agg(F.sort_array(F.collect_set("order_id")).alias("basket_ids")),
        ["user_id", "item_id"], "left")
    for name, d in diffs.items():
        counted = d.groupBy("user_id").agg(F.count(F.lit(1)).alias(f"num_{name}_changes"))
        out = out.join(counted, "user_id", "left").fillna(0, [f"num_{name}_changes"])
    totals = result.maintenance.labels.agg(
        F.count(F.lit(1)).alias("num_inspected_lists"),
        F.count(F.when(F.col("label") != "unchanged", 1)).alias("num_updated_lists")).first()   # two numbers
    for name, value in totals.asDict().items():
        out = out.withColumn(name, F.lit(value).cast("long"))
    if with_timings:
        for name, ms in result.durations_ms.items():
            out = out.withColumn(f"{name}_ms", F.lit(int(ms)))
    return out
