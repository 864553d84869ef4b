"""Hard negatives by a BOND scan: vertical search over columnar vectors.

Rows are dealt into blocks by a hash of the whole row, and a block is held by dimension (a dense
column of whole numbers each). An anchor reads the columns in descending magnitude of its own
components. After every few columns each row has a partial score, and the rest of its score lies between
the sums of the smallest and largest contributions that the unread columns can make (their minimum and
maximum in the block). Rows that these bounds rule out leave the candidate bitmap; once few are left, or
all columns are read, the remaining scores are exact.

First pass: an anchor's best rows of its label (its positives); a row goes when its highest possible score
is under the lowest possible score of as many rows as are wanted. Second pass: for each positive a window of
scores; a row goes when it cannot fall into any window, or when enough rows certainly inside a window beat it
there. Blocks are searched independently and their few best rows are ranked again per anchor. Anchors
are copied to every block, in groups of bounded size; no pair of rows is ever shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from trolley.llm.common import materialize

POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = (50, 100), (95, 100)     # a negative's score lies between these parts of the positive's
STEP = 8                             # columns read between two prunings
FEW = 128                            # candidates at which the rest is computed at once
ROWS_PER_BLOCK = 32_768
ANCHORS_PER_GROUP = 16_384
SCALE = 256.0
POSITIVE = "anchor_key long, anchor_id long, positive_key long, positive_id long, positive_score long"
NEGATIVE = POSITIVE + ", negative_key long, negative_id long, negative_score long"


def prepared(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(vec_id, label, vector array<double>, key)`` of the rows that take part; components are whole numbers.

    Rows with a null id, label or vector, or with a null or non-finite component take no part; nor do rows
    whose scores could pass 63 bits. ``key`` is a hash of the row.
    """
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
                             F.col(vector_col).cast("array<double>").alias("vector"))
    whole = F.transform("vector", lambda x: F.floor(x * SCALE).cast("double"))
    limit = F.lit(2.0 ** 31) / F.sqrt(F.greatest(F.size("vector"), F.lit(1)))
    sound = F.forall("vector", lambda x: F.coalesce(F.abs(x) < limit / SCALE, F.lit(False)) & ~F.isnan(x))
    return (rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()).where(sound)
            .withColumn("vector", whole).withColumn("key", F.xxhash64("vec_id", "label", "vector")))


class Block:
    """Rows by dimension, with the least and greatest value of each; repeated rows count once."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, keys: np.ndarray, vectors: list[np.ndarray], width: int,
                 anchors: np.ndarray | None = None):
        _, first = np.unique(np.stack([ids, labels, keys]), axis=1, return_index=True)
        order = first[np.lexsort((keys[first], ids[first]))]
        self.ids, self.labels, self.keys = ids[order], labels[order], keys[order]
        rows = matrix([vectors[i] for i in order], width)
        peak = float(np.abs(rows).max(initial=0))
        bound = width * peak * max(peak, float(np.abs(anchors).max(initial=0)) if anchors is not None else 0.0)
        self.columns = np.ascontiguousarray(rows.T) if bound < 2 ** 53 else np.ascontiguousarray(rows.T).astype(np.int64)
        self.least, self.greatest = self.columns.min(axis=1), self.columns.max(axis=1)

    def order(self, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Columns by descending magnitude, and the least and greatest sum of contributions from each place on."""
        by = np.argsort(-np.abs(anchor), kind="stable")
        a, b = anchor[by] * self.least[by], anchor[by] * self.greatest[by]
        after = lambda x: np.concatenate([np.cumsum(x[::-1])[::-1], [0]])
        return by, after(np.minimum(a, b)), after(np.maximum(a, b))

    def scan(self, anchor: np.ndarray, rows: np.ndarray, prune) -> tuple[np.ndarray, np.ndarray]:
        """(rows, exact scores) of the candidates that ``prune(partial, least rest, greatest rest)`` leaves."""
        anchor = anchor.astype(self.columns.dtype)
        by, low, high = self.order(anchor)
        partial = np.zeros(len(rows), self.columns.dtype)
        everything = len(rows) == len(self.ids)
        at = 0
        while at < len(by) and len(rows):
            end = len(by) if len(rows) <= FEW else min(len(by), at + STEP)
            take = by[at:end]
            part = self.columns[take] if everything else self.columns[np.ix_(take, rows)]
            partial = partial + anchor[take] @ part
            at = end
            if at < len(by):
                stays = prune(rows, partial, low[at], high[at])
                if not stays.all():
                    rows, partial, everything = rows[stays], partial[stays], False
        return rows, partial.astype(np.int64)


def matrix(vectors: list[np.ndarray], width: int) -> np.ndarray:
    """Rows of equal width; a shorter vector's missing components count as zero."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def _best(rows: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
    """Places of the n highest scores; rows are in id order, so the first of equal ones has the smaller id."""
    if len(scores) > 4 * n:
        enough = np.partition(scores, len(scores) - n)[len(scores) - n]
        kept = np.flatnonzero(scores >= enough)
        return kept[np.argsort(-scores[kept], kind="stable")[:n]]
    return np.argsort(-scores, kind="stable")[:n]


def positives_in(block: Block, anchor: np.ndarray, anchor_id: int, label: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The block's n best other rows of the anchor's label."""
    rows = np.flatnonzero((block.labels == label) & (block.ids != anchor_id))

    def prune(rows, partial, low, high):
        if len(partial) <= n:
            return np.ones(len(partial), bool)
        sure = np.partition(partial, len(partial) - n)[len(partial) - n] + low
        return partial + high >= sure

    rows, scores = block.scan(anchor, rows, prune)
    top = _best(rows, scores, n)
    return rows[top], scores[top]


def negatives_in(block: Block, anchor: np.ndarray, label: int, windows: list[tuple[int, int]], n: int):
    """For each window of scores (both ends in it): the block's n best rows of other labels inside it."""
    lows, highs = np.array([w[0] for w in windows]), np.array([w[1] for w in windows])
    real = lows <= highs
    if not real.any():
        return [(np.empty(0, np.int64),) * 2] * len(windows)
    rows = np.flatnonzero(block.labels != label)

    windows_left = sorted(set(zip(lows[real].tolist(), highs[real].tolist())))

    def prune(rows, partial, low, high):
        spans: list[list] = []                      # partial scores that can still end in a window, as disjoint spans
        for lo, hi in windows_left:
            least = lo - high
            if lo - low <= hi - high:               # narrow enough bounds for a row to be certainly inside
                sure = partial[(partial >= lo - low) & (partial <= hi - high)]
                if len(sure) >= n:                  # as many as are wanted: what cannot reach the last of them goes
                    least = max(least, np.partition(sure, len(sure) - n)[len(sure) - n] + low - high)
            spans.append([least, hi - low])
        spans.sort()
        merged = spans[:1]
        for least, most in spans[1:]:
            if least <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], most)
            else:
                merged.append([least, most])
        stays = (partial >= merged[0][0]) & (partial <= merged[0][1])
        for least, most in merged[1:]:
            stays |= (partial >= least) & (partial <= most)
        return stays

    rows, scores = block.scan(anchor, rows, prune)
    out = []
    for lo, hi in windows:
        inside = np.flatnonzero((scores >= lo) & (scores <= hi))
        top = inside[_best(rows[inside], scores[inside], n)]
        out.append((rows[top], scores[top]))
    return out


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(x).to_numpy() for x in names]


def _vectors(table: pa.Table) -> list[np.ndarray]:
    return [np.asarray(v, np.float64) for v in table.column("vector").to_numpy()]


def _empty(schema: pa.Schema) -> pa.Table:
    return schema.empty_table()


def _frame(parts: list[list], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*parts)) if parts else [[]] * len(schema)
    return pa.table([np.concatenate(c) if len(c) else np.empty(0, np.int64) for c in columns], schema=schema)


def _sides(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, Block]:
    """The anchors as rows and the block by dimension, of one width."""
    own, theirs = _vectors(left), _vectors(right)
    width = max(1, max(map(len, own)), max(map(len, theirs)))
    anchors = matrix(own, width)
    return anchors, Block(*_columns(right, "vec_id", "label", "key"), theirs, width, anchors)


def _positives(n: int):
    schema = to_arrow_schema(StructType.fromDDL(POSITIVE))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """left: anchors, right: the rows of one block."""
        if not left.num_rows or not right.num_rows:
            return _empty(schema)
        anchors, block = _sides(left, right)
        parts = []
        for a, i, label, key in zip(anchors, *(x.tolist() for x in _columns(left, "vec_id", "label", "key"))):
            rows, scores = positives_in(block, a, i, label, n)
            if len(rows):
                same = np.ones(len(rows), np.int64)
                parts.append([key * same, i * same, block.keys[rows], block.ids[rows], scores])
        return _frame(parts, schema)

    return run


def _negatives(n: int, low: tuple[int, int], high: tuple[int, int]):
    schema = to_arrow_schema(StructType.fromDDL(NEGATIVE))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """left: anchors with their positives, right: the rows of one block."""
        if not left.num_rows or not right.num_rows:
            return _empty(schema)
        anchors, block = _sides(left, right)
        parts = []
        for a, i, label, key, found in zip(anchors, *(x.tolist() for x in _columns(left, "vec_id", "label", "key")),
                                           left.column("positives").to_pylist()):
            windows = [(-(-low[0] * p["score"] // low[1]), high[0] * p["score"] // high[1]) for p in found]
            for p, (rows, scores) in zip(found, negatives_in(block, a, label, windows, n)):
                if len(rows):
                    same = np.ones(len(rows), np.int64)
                    parts.append([key * same, i * same, p["key"] * same, p["id"] * same, p["score"] * same,
                                  block.keys[rows], block.ids[rows], scores])
        return _frame(parts, schema)

    return run


def _dealt(rows: DataFrame, anchors: DataFrame, rows_per_block: int, anchors_per_group: int) -> tuple[int, int]:
    """Number of blocks and of anchor groups: bounded sizes, and two tasks or more a task slot."""
    n, m = rows.count(), anchors.count()
    slots = rows.sparkSession.sparkContext.defaultParallelism
    groups = max(1, -(-m // anchors_per_group))
    blocks = max(1, -(-n // rows_per_block), min(-(-2 * slots // groups), -(-n // 2048)))
    return blocks, groups


def _search(rows: DataFrame, anchors: DataFrame, blocks: int, groups: int, task, schema: str) -> DataFrame:
    """``task`` over every (block, anchor group); a block's rows go to each group, an anchor to each block."""
    deal = lambda df, by, n: F.pmod(F.col(by), F.lit(n)).cast("int")
    left = (anchors.withColumn("anchor_group", deal(anchors, "key", groups))
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    right = (rows.withColumn("block", deal(rows, "key", blocks))
             .withColumn("anchor_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))))
    by = ["block", "anchor_group"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(task, schema)


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES,
         low: tuple[int, int] = LOW, high: tuple[int, int] = HIGH, rows_per_block: int = ROWS_PER_BLOCK,
         anchors_per_group: int = ANCHORS_PER_GROUP) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` for ``prepared`` tables.

    Scores are inner products; higher ones come first, ties by smaller id (rows of one id by their hash).
    An anchor's positives are its first other rows of its label; a positive's negatives are the first rows of
    other labels with low * positive_score <= score <= high * positive_score. Repeated rows count once; rows
    of one id with other contents are rows of their own, but never an anchor's positives. Vectors of unequal
    width are compared over the shorter. Anchors without positives, and positives without negatives, give
    no row, and so do empty tables.
    """
    anchors = anchors.dropDuplicates(["vec_id", "label", "key"])
    blocks, groups = _dealt(rows, anchors, rows_per_block, anchors_per_group)
    near = _search(rows, anchors, blocks, groups, _positives(positives), POSITIVE)
    ranked = Window.partitionBy("anchor_key", "anchor_id").orderBy(F.desc("positive_score"), "positive_id", "positive_key")
    near = near.withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= positives)
    found = near.groupBy("anchor_key", "anchor_id").agg(F.collect_list(F.struct(      # at most ``positives`` of them
        F.col("positive_key").alias("key"), F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))).alias("positives"))
    with_positives = anchors.join(found, (anchors["key"] == found["anchor_key"]) & (anchors["vec_id"] == found["anchor_id"])) \
        .select("vec_id", "label", "vector", "key", "positives")
    with_positives = materialize(with_positives, "anchors")
    far = _search(rows, with_positives, blocks, groups, _negatives(negatives, low, high), NEGATIVE)
    ranked = (Window.partitionBy("anchor_key", "anchor_id", "positive_key", "positive_id")
              .orderBy(F.desc("negative_score"), "negative_id", "negative_key"))
    return (far.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
