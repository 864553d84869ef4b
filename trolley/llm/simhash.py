"""SimHash near-duplicates by segment popcounts.

A 64-bit fingerprint is embedded as the bit counts of its 2-bit segments. The Manhattan distance of
two such vectors never exceeds the number of differing bits, so a range join on it finds every link.
The grid: the segments form ``max_bits + 2`` groups; if all segments together differ by at most
``max_bits``, at least two groups do not differ at all, so linked vectors share the grid cell
(pair of groups, their counts). Inside a cell, the Manhattan distance filters and the exact
Hamming distance decides. Only distinct fingerprints enter the grid, and each task hands on a
spanning forest of its links, never all pairs. Cells of many members are cut into blocks, and every
pair of blocks becomes a task of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trolley.llm.common import map_batches, materialize
from trolley.llm.components import components

SHINGLE = 3
MAX_BITS = 3
SEED = 42
BLOCK = 2048
SMALL = 32
_ONES = np.uint64(0x5555555555555555)


def fingerprint(words: list[bytes], shingle: int = SHINGLE) -> int:
    """Bit i is 1 if it is set in over half of the shingles' hashes; no words: zero."""
    import xxhash

    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return h(b" ".join(words), SEED)
    runs = zip(*(words[i:] for i in range(shingle)))
    hashes = np.fromiter((h(b" ".join(r), SEED) for r in runs), np.uint64, len(words) - shingle + 1)
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at:at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int64)
    value = 0
    for bit in 2 * total > len(hashes):
        value = value << 1 | int(bit)
    return value


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp long)`` per input row; the long has the fingerprint's 64 bits."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fps = [fingerprint(t.encode().lower().split(), shingle) if isinstance(t, str) else 0
               for t in pdf["text"].array]
        return pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"),
                             "fp": np.array(fps, np.uint64).view(np.int64)})

    rows = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")
    return map_batches(rows, run, "doc_id long, fp long")


def segment_counts(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 two-bit segments, each count in the two bits of its segment."""
    return (fp & _ONES) + ((fp >> np.uint64(1)) & _ONES)


def _masks(max_bits: int) -> list[np.uint64]:
    """For every choice of two of ``max_bits + 2`` segment groups: the bits of both groups."""
    groups = np.array_split(np.arange(32), max_bits + 2)
    bits = [sum(3 << (2 * int(s)) for s in g) for g in groups]
    return [np.uint64(a | b) for a, b in combinations(bits, 2)]


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of count vectors in two-bit lanes; differences 0, 1 or 2 a lane.

    Counts are 0, 1, 2, so equal lanes xor to 0, lanes that differ by one to 1 or 3, and 0 against 2 to 2.
    """
    x = a ^ b
    low, high = x & _ONES, (x >> np.uint64(1)) & _ONES
    return np.bitwise_count(low) + 2 * np.bitwise_count(high & ~low)


def _forest(left: np.ndarray, right: np.ndarray | None, max_bits: int) -> list[tuple[int, int]]:
    """Spanning forest of the links within ``left``, or between ``left`` and ``right``."""
    nodes = left if right is None else np.concatenate([left, right])
    counts = segment_counts(nodes)
    parent = np.arange(len(nodes))
    links = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    start = 0 if right is None else len(left)
    for i in range(len(left)):
        lo = max(start, i + 1)
        near = np.flatnonzero(manhattan(counts[lo:], counts[i]) <= max_bits) + lo
        if len(near):
            near = near[np.bitwise_count(nodes[near] ^ nodes[i]) <= max_bits]
            for j in near:
                a, b = root(i), root(int(j))
                if a != b:
                    parent[b] = a
                    links.append((i, int(j)))
    signed = nodes.view(np.int64)
    return [(int(signed[a]), int(signed[b])) for a, b in links]


def _cells(max_bits: int):
    masks = _masks(max_bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = pdf["fp"].to_numpy(np.int64)
            counts = segment_counts(fp.view(np.uint64))
            for i, m in enumerate(masks):
                yield pd.DataFrame({"grid": np.int32(i), "cell": (counts & m).view(np.int64), "fp": fp})

    return run


def _task_links(pdf: pd.DataFrame, group: np.ndarray, max_bits: int) -> pd.DataFrame:
    """Links of the whole groups in ``pdf`` (sorted by group number): small groups all at once, row
    against the row d further on; each larger group by a forest of its own."""
    fp = pdf["fp"].to_numpy(np.int64).view(np.uint64)
    counts, mine = segment_counts(fp), pdf["mine"].to_numpy()
    cross = (pdf["a"] != pdf["b"]).to_numpy()
    size = np.bincount(group)[group]
    u, v = [], []
    for d in range(1, int(size[size <= SMALL].max(initial=0))):
        at = np.flatnonzero((group[:-d] == group[d:]) & (size[:-d] <= SMALL))
        at = at[~cross[at] | (mine[at] != mine[at + d])]
        at = at[manhattan(counts[at], counts[at + d]) <= max_bits]
        at = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= max_bits]
        u.append(fp[at].view(np.int64))
        v.append(fp[at + d].view(np.int64))
    for g in np.unique(group[size > SMALL]):
        at = np.flatnonzero(group == g)
        if cross[at[0]]:
            first = mine[at] == pdf["a"].iloc[at[0]]
            found = _forest(fp[at[first]], fp[at[~first]], max_bits)
        else:
            found = _forest(fp[at], None, max_bits)
        pairs = np.array(found, np.int64).reshape(-1, 2)
        u.append(pairs[:, 0])
        v.append(pairs[:, 1])
    none = [np.empty(0, np.int64)]
    return pd.DataFrame({"u": np.concatenate(u or none), "v": np.concatenate(v or none)})


def _scan(max_bits: int):
    """Walks a partition sorted by task and joins each task's rows; holds one task's rows over a batch end."""
    key = ["grid", "cell", "a", "b"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            k = pdf[key].to_numpy(np.int64)
            group = np.concatenate([[0], (k[1:] != k[:-1]).any(axis=1).cumsum()])
            whole = group < group[-1]
            held = pdf[~whole]
            if whole.any():
                yield _task_links(pdf[whole], group[whole], max_bits)
        if held is not None and len(held):
            yield _task_links(held, np.zeros(len(held), np.int64), max_bits)

    return run


def links(distinct_fps: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """``(u, v)`` fingerprints with at most ``max_bits`` differing bits: forests whose union connects
    exactly what all links connect.

    Cells of one member are dropped by an aggregate. A cell of m members is dealt into
    ceil(m / block) blocks, and a task sees two blocks at most.
    """
    cells = materialize(distinct_fps.select("fp").mapInPandas(_cells(max_bits), "grid int, cell long, fp long"), "cells")
    full = cells.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    members = (cells.join(full, ["grid", "cell"])
               .withColumn("blocks", F.ceil(F.col("m") / block).cast("int"))
               .withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")))
    # a block meets every block, itself included: task (a, b) with a <= b gets both
    tasks = (members.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
             .select("grid", "cell", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"),
                     "mine", "fp"))

    dealt = tasks.repartition("grid", "cell", "a", "b").sortWithinPartitions("grid", "cell", "a", "b")
    return dealt.mapInPandas(_scan(max_bits), "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` per input row; component_id is the smallest doc_id reachable.

    Null and wordless texts have fingerprint zero and link like any other. Rows with a null id keep
    it and take part; a component of such rows only has a null component_id. Repeated rows repeat.
    """
    fps = materialize(fingerprints(docs, shingle, id_col, text_col), "fps")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    roots = components(links(distinct, max_bits))
    labelled = (distinct.join(roots, distinct["fp"] == roots["node"], "left")
                .select("fp", "low", F.coalesce("root", "fp").alias("root")))
    lowest = labelled.groupBy("root").agg(F.min("low").alias("component_id"))
    of_fp = labelled.join(lowest, "root").select("fp", "component_id")
    return fps.join(of_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                                        "component_id")


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """One document of each group stays: the rows whose doc_id is their component's smallest.

    Documents without an id cannot stand for a group; they stay only where the group has no id.
    """
    near = near_duplicates(docs, **settings)
    keep = near.where("doc_id <=> component_id").select("doc_id").distinct()
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep["doc_id"]), "left_semi")
