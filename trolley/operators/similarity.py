"""K1-K7: norms, the sparse self-product, cosine, per-row top-k and the neighbour table.

Exact all-pairs top-k is built by routing the entries of an item to the users that can meet them. An item
self join emits one row per pair of users that share an item: an item bought by a third of all users
alone yields (n/3)^2 rows in a single task. Sending every user block to every other one copies the whole
input once per block, although two blocks of a large catalogue share few items. Here the left users are
hashed into blocks and an item's entries go, as arrays, to the left blocks that hold the item (to several
parts of such a block where they are many). One task per group computes the products locally and emits
only the top-k per user (``functions.blockdot``). So what crosses the network is at most the number of
products, and at most nnz per left block; ``choose_routing`` picks the blocks from the item counts. The
entries of a group travel packed: compressed columns of many items, a few bytes an entry. Where the routed
entries are many times the input, the entries of each item are written once ("shelves") and the blocks
are done in waves, each written and its shuffle deleted before the next: disk follows the input, not the products.
The shelves are written in passes over ranges of the items, so that a pass's share of the shuffles is on disk at once.

A user's mass is taken from its whole row before routing and travels with its entries.
Values must not be negative (they are 1 by default): a negative one is an error, since lists keep
positive products only. Pairs with a zero product take no part.

Hot rows: a user whose row is longer than ``hot_threshold`` (a reseller account can hold a third of
all rows) would make every task of its block large. Such users leave the block path; their dot
products with everybody come from a join on item_id (linear in the data per hot user, AQE splits
skewed items) and enter the final top-k in both directions. The result is the same exact table.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trolley.functions import blockdot
from trolley.functions.expressions import top_n
from trolley.functions.measures import COSINE, Measure
from trolley.session import discard, materialize, parallelism, write_parts

PAIR_SCHEMA = "user_id long, neighbor_id long, similarity double, rank long"
PACKED_SCHEMA = "gid int, items int, lefts int, rights int, data binary"
ROWS_PER_BLOCK = 250_000
ROWS_PER_BLOCK_CONF = "trolley.similarity.rowsPerBlock"
MIN_BLOCK_ROWS = 10_000
GROUP_ENTRIES = 2_000_000    # right entries of a group
CHUNK_ENTRIES = 4_096        # entries of an item in one row
LOT_ENTRIES = 16_384         # left entries of an item in one row of the shelves
WAVE_SHARE = 4               # entries that a wave routes, as a multiple of those given
SHELF_PASSES = 4             # ranges of the items in which the shelves are written
DOUBLINGS = 16
PARTS_OF_ONE_BLOCK = 2       # of the right side where all rows are one block, so that tasks share it
NULL_KEY = -(1 << 63)        # a null id counts as one id of its own


def rows_per_block(spark) -> int:
    """Rows of one user block: session conf ``trolley.similarity.rowsPerBlock`` or 250k.

    A task holds the block and the entries routed to it, so this is bounded by executor memory.
    """
    try:
        return int(spark.conf.get(ROWS_PER_BLOCK_CONF, str(ROWS_PER_BLOCK)))
    except Exception:  # noqa: BLE001
        return ROWS_PER_BLOCK


def norms(I: DataFrame, measure: Measure = COSINE) -> DataFrame:
    """K1: ``(user_id, nsq, norm)``; the mass ``nsq`` is kept exact (for cosine: the sum of squares)."""
    return (I.groupBy("user_id").agg(F.sum(measure.term(F.col("value"))).alias("nsq"))
            .withColumn("norm", measure.finish(F.col("nsq"), F.sqrt)))


def pair_dot_totals(I: DataFrame) -> DataFrame:
    """K2 row sums without pairs: sum over v != u of dot(u, v) = sum_i x_ui * (col_i - x_ui).

    One aggregate per item and one join: linear in the number of interactions.
    """
    col_sum = I.groupBy("item_id").agg(F.sum("value").alias("col_sum"))
    return (I.join(col_sum, "item_id")
            .groupBy("user_id")
            .agg(F.sum(F.col("value") * (F.col("col_sum") - F.col("value"))).alias("dot_total")))


def choose_blocks(spark, nnz: int, rows: int | None = None) -> int:
    """Left blocks of at most ``rows_per_block`` rows that fill every slot of the cluster about twice."""
    by_size = math.ceil(max(1, nnz) / (rows or rows_per_block(spark)))
    by_slots = min(2 * parallelism(spark), math.ceil(max(1, nnz) / MIN_BLOCK_ROWS))   # no blocks of a few rows
    return max(1, by_size, by_slots)


def choose_routing(counts: DataFrame, left_blocks: int, right_blocks: int | None = None) -> tuple[int, int]:
    """``(left blocks, parts of the right side)`` that route the fewest entries, from ``counts(item_id, l, r)``.

    An item with l left and r right entries sends its r entries to at most min(l, blocks) blocks. The
    blocks are doubled while that lets the right side stay in fewer parts of about ``GROUP_ENTRIES``.
    """
    return _routing(counts, left_blocks, right_blocks)[:2]


def _routing(counts: DataFrame, left_blocks: int, right_blocks: int | None) -> tuple[int, int, int]:
    """``choose_routing`` and the waves in which the blocks are done (see ``_waves``)."""
    options = [left_blocks << i for i in range(DOUBLINGS)]
    sums = counts.agg(F.sum("l").alias("nnz"), F.sum("r").alias("met"),
                      *[F.sum(F.col("r") * F.least("l", F.lit(b))).cast("double").alias(f"v{b}") for b in options]).first()
    found = []
    for b in options:
        routed = sums[f"v{b}"] or 0.0
        parts = max(right_blocks or 1, math.ceil(routed / b / GROUP_ENTRIES))
        found.append((routed + (sums["nnz"] or 0) * parts, b, parts))
    # a wave fills every slot about twice
    wave = max(WAVE_SHARE * ((sums["nnz"] or 0) + (sums["met"] or 0)) // 2, 2 * parallelism(counts.sparkSession) * GROUP_ENTRIES, 1)
    cost, blocks, parts = min(found)
    if cost > wave:     # waves bound what is routed at once; each part copies the left entries into the shelves
        cost, blocks, parts = min(found, key=lambda x: (x[2], x[0]))
    return blocks, parts, min(blocks, max(1, math.ceil(cost / wave)))


def _with_mass(I: DataFrame, measure: Measure) -> DataFrame:
    """Written rows ``(user_id, item_id, value, mass)``; the masses are those of the rows given, which must be whole."""
    I = I.select(*[F.coalesce(F.col(c), F.lit(NULL_KEY)).alias(c) for c in ("user_id", "item_id")],
                 F.col("value").cast("double").alias("value"))
    return materialize(I.join(norms(I, measure).select("user_id", F.col("nsq").cast("double").alias("mass")), "user_id"))


def _arrays(rows: DataFrame, keys: list[str], side: str) -> DataFrame:
    """One row per key with the entries as arrays of the same order, by user."""
    e = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("user_id", "value", "mass"))).alias("e"))
    return e.select(*keys, *[F.col(f"e.{c}").alias(f"{side}_{name}")
                             for c, name in (("user_id", "users"), ("value", "values"), ("mass", "masses"))])


def routed_rows(I_left: DataFrame, I_right: DataFrame, left_blocks: int, right_blocks: int | None = None,
                measure: Measure = COSINE) -> tuple[DataFrame, int]:
    """``(rows, groups)``: per group ``gid`` and item the entries of a left block and of the right users they meet."""
    r = _routed(I_left, I_right, left_blocks, right_blocks, measure)
    return r.rows(), r.blocks * r.parts


class _routed:
    """The two sides with masses, to be dealt by item and chunk: ``held``, with the left block ``a``, and ``met``."""

    def __init__(self, I_left: DataFrame, I_right: DataFrame, left_blocks: int, right_blocks: int | None, measure: Measure):
        left = _with_mass(I_left, measure)
        right = left if I_right is I_left else _with_mass(I_right, measure)
        counts = materialize(left.groupBy("item_id").agg(F.count(F.lit(1)).alias("l")).join(
            right.groupBy("item_id").agg(F.count(F.lit(1)).alias("r")), "item_id"))
        self.blocks, self.parts, self.waves = _routing(counts, int(left_blocks), right_blocks)
        parts = self.parts
        # chunks are a multiple of the parts; only items of several times as many are listed, the others are few entries
        self.several = materialize(counts.where((F.col("r") > parts * CHUNK_ENTRIES) | (F.col("l") > LOT_ENTRIES)).select(
            "item_id", (F.ceil(F.col("r") / F.lit(parts * CHUNK_ENTRIES)) * parts).cast("long").alias("chunks"),
            F.ceil(F.col("l") / F.lit(LOT_ENTRIES)).cast("long").alias("lots")))
        self.left, self.right = left, right
        self.tables = [left, counts, self.several] + ([right] if right is not left else [])

    def _sides(self, left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``held`` and ``met`` of rows of the left and of the right side."""
        chunks = F.coalesce("chunks", F.lit(self.parts).cast("long"))

        def chunked(rows: DataFrame, chunk, keys: list[str], side: str) -> DataFrame:
            # dealt by the keys of the join, so that grouping and join need no other exchange
            rows = rows.join(self.several, "item_id", "left").withColumn("lot", F.pmod(F.col("a"), F.coalesce("lots", F.lit(1))) if keys else F.lit(0)) \
                .withColumn("chunk", chunk).repartition("item_id", "chunk")
            return _arrays(rows, ["item_id", "chunk", *keys], side)

        held = chunked(left.withColumn("a", F.pmod(F.xxhash64("user_id"), F.lit(self.blocks)).cast("int")),
                       F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)), ["lot", "a"], "l")
        return held, chunked(right, F.pmod(F.xxhash64(F.lit("right"), "user_id"), chunks), [], "r")

    def _of_groups(self, rows: DataFrame, first: int = 0) -> DataFrame:
        """Rows with the number of their group, from the group of block ``first`` on."""
        gid = (F.col("a") - F.lit(first)) * self.parts + F.pmod(F.col("chunk"), F.lit(self.parts))
        return rows.withColumn("gid", gid.cast("int")).drop("item_id", "chunk", "lot", "a")

    def rows(self) -> DataFrame:
        held, met = self._sides(self.left, self.right)
        return self._of_groups(held.join(met, ["item_id", "chunk"]))

    def shelves(self) -> DataFrame:
        """Written once for all waves, a range of items at a time: per item, chunk and lot the left entries by
        block, and the right ones."""
        def of_range(i: int) -> DataFrame:
            # the seed keeps the ranges apart from the hash that deals the items to tasks
            own = F.pmod(F.xxhash64(F.lit("shelf"), "item_id"), F.lit(SHELF_PASSES)) == i
            held, met = self._sides(self.left.where(own), self.right.where(own))
            held = held.groupBy("item_id", "chunk", "lot").agg(
                F.collect_list(F.struct("a", "l_users", "l_values", "l_masses")).alias("held"))
            return held.join(met, ["item_id", "chunk"])
        out = write_parts(self.left.sparkSession, map(of_range, range(SHELF_PASSES)))
        discard(*self.tables)
        return out

    def wave_rows(self, shelves: DataFrame, first: int, end: int) -> DataFrame:
        """``rows`` of the blocks from ``first`` to before ``end``; groups are numbered from 0."""
        own = F.filter("held", lambda h: (h["a"] >= first) & (h["a"] < end))
        rows = shelves.select("chunk", F.explode(own).alias("h"), "r_users", "r_values", "r_masses")
        return self._of_groups(rows.select("chunk", "h.*", "r_users", "r_values", "r_masses"), first)


def routed_candidates(I_left: DataFrame, I_right: DataFrame, k: int, left_blocks: int, right_blocks: int | None = None,
                      measure: Measure = COSINE) -> tuple[DataFrame, bool]:
    """The k best of each left user in each part of the right side (K2 + K3 + K4 per group), and whether
    there is one part only: then these are the lists."""
    r = _routed(I_left, I_right, left_blocks, right_blocks, measure)

    def best(rows: DataFrame, groups: int) -> DataFrame:
        packed = rows.mapInArrow(blockdot.pack_task(), PACKED_SCHEMA)
        return _one_task_per_group(packed, groups).applyInArrow(blockdot.routed_task(k, measure), PAIR_SCHEMA)
    if r.waves == 1:
        return best(r.rows(), r.blocks * r.parts), r.parts == 1
    return _waves(r, best, k), True


def _waves(r: _routed, best, k: int) -> DataFrame:
    """The lists, written a range of blocks at a time: only one range's routed entries are on disk at once.

    A range has all parts of its users' right side, so its lists are whole.
    """
    shelves = r.shelves()
    step = math.ceil(r.blocks / r.waves)

    def lists(first: int) -> DataFrame:
        end = min(first + step, r.blocks)
        cands = best(r.wave_rows(shelves, first, end), (end - first) * r.parts)
        return cands if r.parts == 1 else top_k(cands.drop("rank"), k)
    out = write_parts(shelves.sparkSession, map(lists, range(0, r.blocks, step)))
    discard(shelves)
    return out


def routed_top_k(I_left: DataFrame, I_right: DataFrame, k: int, left_blocks: int, right_blocks: int | None = None,
                 measure: Measure = COSINE) -> DataFrame:
    """The lists ``(user_id, neighbor_id, similarity, rank)`` of the left users."""
    cands, whole = routed_candidates(I_left, I_right, k, left_blocks, right_blocks, measure)
    return cands if whole else top_k(cands.drop("rank"), k)


def _one_task_per_group(rows: DataFrame, n_groups: int):
    """Group by ``gid`` (0 to ``n_groups`` - 1) with one partition per group: hash partitioning would stack
    some groups on one task; the grouping reuses that partitioning, so there is a single exchange."""
    return rows.repartitionById(max(1, n_groups), "gid").groupBy("gid")


def top_k(pairs: DataFrame, k: int) -> DataFrame:
    """K4: k best neighbours per user under (similarity desc, neighbor_id asc), with ``rank``."""
    return top_n(pairs, ["user_id"], [F.col("similarity").desc(), F.col("neighbor_id")], k) \
        .select("user_id", "neighbor_id", "similarity", "rank")


def non_negative(I: DataFrame) -> DataFrame:
    """Interactions whose use fails on a negative value instead of losing its pairs."""
    bad = F.raise_error(F.lit("interaction values must not be negative")).cast("double")
    return I.withColumn("value", F.when(F.col("value") >= 0, F.col("value").cast("double")).otherwise(bad))


def row_stats(I: DataFrame) -> tuple[int, int]:
    """``(nnz, longest row)`` in one aggregation: sizes the blocks and tells whether a hot-row path
    is needed."""
    r = (non_negative(I).groupBy("user_id").agg(F.count("value").alias("len"))
         .agg(F.sum("len").alias("nnz"), F.max("len").alias("longest")).first())
    return int(r["nnz"] or 0), int(r["longest"] or 0)


def hot_users(I: DataFrame, hot_threshold: int) -> DataFrame:
    """Users with more than ``hot_threshold`` interactions (at most nnz / threshold of them)."""
    return (I.groupBy("user_id").agg(F.count(F.lit(1)).alias("len"))
            .where(F.col("len") > hot_threshold).select("user_id"))


def joined_similarities(left: DataFrame, right: DataFrame, measure: Measure = COSINE,
                        left_mass: DataFrame | None = None, right_mass: DataFrame | None = None) -> DataFrame:
    """``(user_id, neighbor_id, similarity)`` of every left user with every right user that shares an item.

    A join on the item, summed map-side per pair; adaptive execution splits skewed items. For a bounded
    number of users on one side. The masses default to those of the rows given, which then must be whole.
    """
    l_mass = (norms(left, measure) if left_mass is None else left_mass).select("user_id", F.col("nsq").alias("mass_l"))
    r_mass = (norms(right, measure) if right_mass is None else right_mass).select(
        F.col("user_id").alias("neighbor_id"), F.col("nsq").alias("mass_r"))
    dots = (left.select("user_id", "item_id", F.col("value").alias("x"))
            .join(right.select(F.col("user_id").alias("neighbor_id"), "item_id", F.col("value").alias("y")), "item_id")
            .where(F.col("user_id") != F.col("neighbor_id"))
            .groupBy("user_id", "neighbor_id").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
            .where(F.col("dot") > 0))
    return (dots.join(l_mass, "user_id").join(r_mass, "neighbor_id")
            .select("user_id", "neighbor_id", measure.column("dot", "mass_l", "mass_r").alias("similarity")))


def hot_candidates(I: DataFrame, hot: DataFrame, k: int, measure: Measure = COSINE) -> DataFrame:
    """Candidates that involve a hot user: its own top-k, and its entry in every other list."""
    sims = joined_similarities(I.join(hot, "user_id", "left_semi"), I, measure)
    own = top_k(sims, k)
    mirrored = (sims.select(F.col("neighbor_id").alias("user_id"), F.col("user_id").alias("neighbor_id"), "similarity")
                .join(hot, "user_id", "left_anti"))
    return own.select("user_id", "neighbor_id", "similarity").unionByName(mirrored)


def build_neighbors(I: DataFrame, k: int = 50, num_blocks: int | None = None,
                    nnz: int | None = None, hot_threshold: int | None = None,
                    longest_row: int | None = None, measure: Measure = COSINE) -> DataFrame:
    """K5: the neighbour table ``(user_id, neighbor_id, similarity, rank)`` for every user.

    ``num_blocks`` (left blocks, at least) defaults from ``nnz``; rows longer than ``hot_threshold`` (default: a fifth of a
    block) take the join path described above. Without ``longest_row`` (and ``nnz``) one
    aggregation over the row lengths finds them.
    """
    right_blocks = None
    if num_blocks is None or longest_row is None:
        nnz, longest_row = row_stats(I)
        if num_blocks is None:
            num_blocks = choose_blocks(I.sparkSession, nnz)
            right_blocks = PARTS_OF_ONE_BLOCK if num_blocks == 1 else None
    threshold = hot_threshold if hot_threshold is not None else rows_per_block(I.sparkSession) // 5
    if longest_row <= threshold:
        return routed_top_k(I, I, k, num_blocks, right_blocks, measure)
    hot = hot_users(I, threshold)
    cold = I.join(hot, "user_id", "left_anti")
    cands = routed_candidates(cold, cold, k, num_blocks, measure=measure)[0].drop("rank").unionByName(hot_candidates(I, hot, k, measure))
    return top_k(cands, k)


def neighbors_for(I_left: DataFrame, I_right: DataFrame, k: int, left_blocks: int = 1,
                  right_blocks: int | None = None, hot_threshold: int | None = None,
                  longest_row: int | None = None, measure: Measure = COSINE) -> DataFrame:
    """Top-k neighbours of the users in ``I_left`` among the users of ``I_right``.

    Used by maintenance: recomputing flagged lists (left = flagged users' rows, right = all rows)
    and the best changed users for each affected list (left = affected rows, right = changed
    users' rows). Right entries go to the left blocks that hold their item. ``left_blocks`` and
    ``right_blocks`` are the least numbers of left blocks and of parts of the right side.

    The rule of the build holds here too: users with more rows than ``hot_threshold`` (default: a fifth of
    a block) on either side leave the blocks, and their pairs come from joins on the item. Without
    ``longest_row`` one aggregation over the row lengths tells whether there are any.
    """
    spark = I_left.sparkSession
    threshold = hot_threshold if hot_threshold is not None else rows_per_block(spark) // 5
    if longest_row is None:
        longest_row = max(row_stats(I_left)[1], row_stats(I_right)[1])
    if longest_row <= threshold:
        return routed_top_k(I_left, I_right, k, left_blocks, right_blocks, measure)
    hot_left, hot_right = hot_users(I_left, threshold), hot_users(I_right, threshold)
    light_left, light_right = (I_left.join(hot_left, "user_id", "left_anti"), I_right.join(hot_right, "user_id", "left_anti"))
    heavy_left, heavy_right = (I_left.join(hot_left, "user_id", "left_semi"), I_right.join(hot_right, "user_id", "left_semi"))
    cands = (routed_candidates(light_left, light_right, k, left_blocks, right_blocks, measure)[0].drop("rank")
             .unionByName(joined_similarities(heavy_left, I_right, measure))
             .unionByName(joined_similarities(light_left, heavy_right, measure)))
    return top_k(cands, k)


def pair_similarities(I: DataFrame, pairs: DataFrame, nsq: DataFrame | None = None, measure: Measure = COSINE) -> DataFrame:
    """K3 on given pairs: ``(user_id, neighbor_id, dot, similarity)`` by joins only.

    The dot of each listed pair is recomputed from the two rows (join on (neighbor, item)), so the
    work is linear in |pairs| x row length; used to cross-check the kernel.
    """
    nsq = nsq if nsq is not None else norms(I, measure)
    left = pairs.select("user_id", "neighbor_id").join(I.select("user_id", "item_id", F.col("value").alias("x")),
                                                        "user_id")
    right = I.select(F.col("user_id").alias("neighbor_id"), "item_id", F.col("value").alias("y"))
    dots = (left.join(right, ["neighbor_id", "item_id"])
            .groupBy("user_id", "neighbor_id").agg(F.sum(F.col("x") * F.col("y")).alias("dot")))
    na = nsq.select("user_id", F.col("nsq").alias("nsq_u"))
    nb = nsq.select(F.col("user_id").alias("neighbor_id"), F.col("nsq").alias("nsq_v"))
    return (dots.join(na, "user_id").join(nb, "neighbor_id")
            .select("user_id", "neighbor_id", "dot", measure.column("dot", "nsq_u", "nsq_v").alias("similarity")))


def neighbors_of(N: DataFrame, users: DataFrame) -> DataFrame:
    """K6: the out-lists of the given users."""
    return N.join(users.select("user_id").distinct(), "user_id", "left_semi")


def in_neighbors_of(N: DataFrame, users: DataFrame) -> DataFrame:
    """K7: for each given user, the users whose lists contain it: ``(user_id, in_neighbor_id, similarity)``."""
    target = users.select(F.col("user_id").alias("neighbor_id")).distinct()
    return (N.join(target, "neighbor_id", "left_semi")
            .select(F.col("neighbor_id").alias("user_id"), F.col("user_id").alias("in_neighbor_id"),
                    "similarity"))
