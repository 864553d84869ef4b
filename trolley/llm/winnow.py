"""Document fingerprints by winnowing.

Every ``GRAM`` consecutive code points have a rolling hash (a polynomial modulo 2^64 over mixed code
points, mixed again, its top 44 bits kept). Of every ``WINDOW`` consecutive hashes the smallest is
kept, the rightmost of equal ones, with its position. So texts that share ``GRAM + WINDOW - 1`` or more
consecutive code points share a kept hash, at the same place of that passage, and a fingerprint
holds about 2 / (WINDOW + 1) of all hashes. A text with fewer grams than a window keeps the smallest of them;
one shorter than a gram keeps the hash of the whole.

Fingerprints depend on the text alone: equal texts have equal ones. Long texts are hashed in pieces
that overlap by a window, which changes nothing in what is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from trolley.llm.common import map_batches, materialize

GRAM = 16
WINDOW = 64
PIECE = 1 << 16                    # grams of a piece
_PLACE = np.uint64(20)             # low bits of a sort key: the place in the piece, rightmost smallest
_BASE = 0x9E3779B97F4A7C15         # odd, so that it has an inverse modulo 2^64
SCHEMA = "doc_id long, n_chars long, hashes array<long>, positions array<long>"
NEXT_SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, hashes array<long>, positions array<long>, "
               "edited_hashes array<long>, edited_positions array<long>, near_edited double, near_next double")
ROWS_PER_RANGE = 8_000
MAX_RANGES = 20_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed one-to-one mixing of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(size: int, inverse: bool) -> np.ndarray:
    base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def gram_hashes(codes: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Rolling hash (44 bits) of every ``gram`` consecutive codes: sum of code * base^place, moved to place 0."""
    size = PIECE + WINDOW + gram if len(codes) <= PIECE + WINDOW + gram else len(codes) + 1
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_mix(codes.astype(np.uint64) + np.uint64(_BASE)) * _powers(size, False)[:len(codes)], out=sums[1:])
    rolled = (sums[gram:] - sums[:-gram]) * _powers(size, True)[:len(codes) - gram + 1]
    return _mix(rolled) >> _PLACE


def winnow(text: str, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(kept hashes, their positions), by position. The empty text has none."""
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    gram = min(gram, len(codes))
    total = len(codes) - gram + 1
    hashes, positions = [], []
    for lo in range(0, max(1, total - window + 1), PIECE):
        hi = min(total, lo + PIECE + window - 1)            # the windows that start in [lo, lo + PIECE)
        h = gram_hashes(codes[lo:hi + gram - 1], gram)
        least = (h << _PLACE) | np.arange(hi - lo - 1, -1, -1, dtype=np.uint64)
        span, want = 1, min(window, hi - lo)
        while span < want:
            step = min(span, want - span)
            least = np.minimum(least[:-step], least[step:])
            span += step
        kept = least[np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))]
        place = (hi - lo - 1) - (kept & np.uint64((1 << int(_PLACE)) - 1)).astype(np.int64)
        hashes.append((kept >> _PLACE).astype(np.int64))
        positions.append(place + lo)
    if len(hashes) == 1:
        return hashes[0], positions[0]
    position, first = np.unique(np.concatenate(positions), return_index=True)   # a piece's edge may be kept twice
    return np.concatenate(hashes)[first], position


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of hashes; two empty ones are alike."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``(doc_id, n_chars, hashes, positions)`` per input row, over whole texts; n_chars counts code points.

    Null and empty texts have empty fingerprints. Null ids stay null, repeated rows repeat, other
    columns are not read. No shuffle.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = [winnow(t, gram, window) for t in pdf["text"].array]
        return pd.DataFrame({"doc_id": pdf["doc_id"], "n_chars": pdf["text"].str.len(),
                             "hashes": [h for h, _ in kept], "positions": [p for _, p in kept]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return map_batches(rows, run, SCHEMA)


def as_text(hashes: str, positions: str) -> Column:
    """A fingerprint as text: ``hash@position`` in hexadecimal and decimal, joined by commas."""
    return F.array_join(F.zip_with(hashes, positions, lambda h, p: F.concat(F.lower(F.hex(h)), F.lit("@"), p.cast("string"))), ",")


def _number_of(bounds: list[int], holds) -> Column:
    """How many of the ascending ``bounds`` hold; they are looked up in two steps of about sqrt(n) each."""
    if not bounds:
        return F.lit(0)
    size = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i:i + size] for i in range(0, len(bounds), size)]
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    first = F.size(F.filter(longs([g[0] for g in groups]), holds)) - 1      # the last group that begins with one that holds
    last = F.get(F.array(*[longs(g) for g in groups]), F.greatest(first, F.lit(0)))
    return F.when(first < 0, 0).otherwise(first * size + F.size(F.filter(last, holds)))


def _in_ranges(rows: DataFrame, rows_per_range: int) -> tuple[DataFrame, int]:
    """``rows(doc_id, text)`` plus ``key`` (order within an id) and ``range``: consecutive ids, about evenly many.

    Bounds are approximate percentiles of all ids: at most ``MAX_RANGES`` numbers. An id that holds
    several bounds is dealt over its ranges by the key, and so are the rows without an id, after all
    others. Which bounds are met changes the dealing only, never the order.
    """
    keyed = rows.withColumn("key", F.xxhash64("text"))
    found = rows.agg(F.count("doc_id").alias("n"), F.count(F.lit(1)).alias("all")).first()
    n_null = found["all"] - found["n"]
    parts = min(MAX_RANGES, max(rows.sparkSession.sparkContext.defaultParallelism, -(-found["n"] // rows_per_range)))
    bounds: list[int] = []
    if found["n"]:
        shares = [i / parts for i in range(1, parts)]
        bounds = rows.agg(F.percentile_approx("doc_id", shares, 10 * parts + 10_000).alias("b")).first()["b"] if shares else []
    nulls = min(MAX_RANGES, max(1, -(-n_null // rows_per_range)))
    share = F.col("key") / F.lit(2.0 ** 64) + F.lit(0.5)      # of the key's way through all keys
    below = _number_of(bounds, lambda b: b < F.col("doc_id"))
    equal = _number_of(bounds, lambda b: b <= F.col("doc_id")) - below
    at = F.when(F.col("doc_id").isNull(), parts + F.least(F.floor(share * nulls), F.lit(nulls - 1))).otherwise(
        below + F.when(equal > 1, F.least(F.floor(share * equal), equal - 1)).otherwise(0))
    return keyed.withColumn("range", at.cast("int")), parts + nulls


def with_next(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
              rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness to it and to the next document.

    Documents come in ascending id; rows of one id by a hash of their text, rows without an id last;
    after the last comes the first (alone it is its own next). The edited text has its last
    floor(n_chars / 4) code points replaced by the next text's first as many, or all it has. Null texts
    are empty. ``near_edited`` and ``near_next`` are the Jaccard similarity of the sets of kept hashes.

    Texts are shuffled once, into ranges of consecutive ids that tasks read in order, one row at a time.
    The first row of each range is sent once more, to the end of the range before it.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt, n_ranges = _in_ranges(rows, rows_per_range)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    heads = materialize(dealt.groupBy("range").agg(F.min(order).alias("head")), "range-heads")    # a row a range
    ranges = sorted(r["range"] for r in heads.select("range").collect())                          # at most 2 * MAX_RANGES
    before = {r: ranges[i - 1] for i, r in enumerate(ranges)}                                     # the first's is the last
    side = dealt.sparkSession.createDataFrame(sorted(before.items()), "range int, to int")
    edge = (dealt.join(F.broadcast(heads.join(side, "range")), "range")          # one small row a range
            .where(F.col("head.none").eqNullSafe(F.col("doc_id").isNull()) & F.col("head.doc_id").eqNullSafe(F.col("doc_id"))
                   & (F.col("head.key") == F.col("key")))
            .dropDuplicates(["range"]).select("doc_id", "text", "key", F.col("to").alias("range"), F.lit(1).alias("edge")))
    every = dealt.select("doc_id", "text", "key", "range", F.lit(0).alias("edge")).unionByName(edge)
    every = (every.withColumn("none", F.col("doc_id").isNull()).repartitionById(n_ranges, "range")
             .sortWithinPartitions("range", "edge", "none", "doc_id", "key").select("doc_id", "text", "range", "edge"))
    target = to_arrow_schema(StructType.fromDDL(NEXT_SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None                       # (range, id, text, hashes, positions) that waits for its next
        out: list[tuple] = []
        size = 0
        for batch in batches:
            for doc_id, text, at, is_edge in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "range", "edge"))):
                hashes, positions = winnow(text, gram, window)
                if held is not None and held[0] == at:
                    _, held_id, held_text, h, p = held
                    quarter = len(held_text) // 4
                    edited = held_text[:len(held_text) - quarter] + text[:quarter]
                    eh, ep = winnow(edited, gram, window)
                    out.append((held_id, len(held_text), hashlib.sha256(edited.encode()).hexdigest(), h, p, eh, ep,
                                likeness(h, eh), likeness(h, hashes)))
                    size += len(h) + len(eh)
                held = None if is_edge else (at, doc_id, text, hashes, positions)
                if size >= 500_000:
                    yield _batch(out, target)
                    out, size = [], 0
        if out:
            yield _batch(out, target)

    return every.mapInArrow(run, NEXT_SCHEMA)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
