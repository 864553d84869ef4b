"""Periodic runs of words by recursive frequency splitting.

A run is a stretch of consecutive words whose smallest period is q, of length ``max(LEAST, 3 * q)``
or more, that no neighbouring word extends keeping period q. Each of its words occurs at least three
times in it. So words that occur fewer than three times in a segment cut it, pieces shorter than
``LEAST`` go, and the rest is counted and cut again until nothing changes (``survivors``). No run is
cut: all its words keep three occurrences in whatever segment holds it.

The surviving segments are scanned by lag (``runs_of``), small lags first. Lags under ``GRAM`` compare
the segment with itself, word by word. Longer lags are taken in octaves [P, 2P): a run of such a
period holds a checkpoint (every P-th word) in its first period, and the ``GRAM`` words there recur one
period later, so at each checkpoint only the lags at which its gram recurs are tried. What lies inside
a run of a smaller period has that period and is left out.

All work of a document is near-linear in its words; documents are independent, so there is no shuffle.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trolley.llm.common import map_batches, words_of

LEAST = 24      # words of a run
TIMES = 3       # periods of a run
GRAM = 8        # LEAST // TIMES: a run of this period or longer is as long as its periods ask
SEPARATORS = r"[\x20\x09-\x0D]+"
RUN = "array<struct<start:long,length:long,period:long>>"
SCHEMA = f"doc_id long, n_words long, runs {RUN}, collapsed string"


def survivors(ids: Sequence[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """Segments ``[lo, hi)`` of ``least`` or more numbers in which each number occurs ``times`` or more.

    A segment's counts pass to its longest piece, less what is cut off, and only the words whose count
    fell are looked at again; shorter pieces are counted anew. So a word is counted log(n) times at most.
    """
    n = len(ids)
    if n < least:
        return []
    count = Counter(ids)
    if max(count.values()) < times:
        return []
    where: dict[int, list[int]] = {}
    for i, w in enumerate(ids):
        where.setdefault(w, []).append(i)
    out: list[tuple[int, int]] = []
    todo = [(0, n, count, list(count))]
    while todo:
        lo, hi, count, suspects = todo.pop()
        cuts = []
        for w in suspects:
            if 0 < count[w] < times:
                at = where[w]
                first = bisect_left(at, lo)
                cuts += at[first:first + count[w]]
        if not cuts:
            out.append((lo, hi))
            continue
        cuts.sort()
        edges = [lo - 1, *cuts, hi]
        pieces = [(a + 1, b) for a, b in zip(edges, edges[1:])]
        big = max(pieces, key=lambda p: p[1] - p[0])
        if big[1] - big[0] < least:
            continue
        lost = Counter(ids[lo:big[0]])
        lost.update(ids[big[1]:hi])
        for w, c in lost.items():
            count[w] -= c
        todo.append((*big, count, list(lost)))
        for a, b in pieces:
            if (a, b) != big and b - a >= least:
                part = Counter(ids[a:b])
                todo.append((a, b, part, list(part)))
    return sorted(out)


def _reach(s: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The stretch ``[start, end)`` with period ``lag`` around ``at`` (where s[at] == s[at + lag])."""
    n, step, right = len(s) - lag, 64, at
    while right < n:
        other = np.flatnonzero(s[right:right + step][:n - right] != s[right + lag:right + lag + step])
        if len(other):
            right += int(other[0])
            break
        right = min(n, right + step)
        step *= 2
    left, step = at, 64
    while left > 0:
        low = max(0, left - step)
        other = np.flatnonzero(s[low:left] != s[low + lag:left + lag])
        if len(other):
            left = low + int(other[-1]) + 1
            break
        left, step = low, 2 * step
    return left, right + lag


def _numbers(s: np.ndarray, gram: int) -> np.ndarray:
    """A number for each ``gram`` consecutive words, equal for equal words; exact, by doubling."""
    out, span = np.unique(s, return_inverse=True)[1].reshape(-1).astype(np.int64), 1
    while span < gram:
        step = min(span, gram - span)
        out = np.unique(out[:-step] * np.int64(len(s) + 1) + out[step:], return_inverse=True)[1].reshape(-1).astype(np.int64)
        span += step
    return out


def runs_of(s: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs ``(start, length, period)`` of one segment, by lag scan."""
    n = len(s)
    found: list[tuple[int, int, int]] = []
    covered = np.zeros(n, np.int64)     # farthest end of a found run that holds the place
    settled = np.zeros(n, np.int64)     # farthest end less period: up to there a longer lag is no smallest period

    def take(start: int, end: int, lag: int) -> None:
        if end - start >= max(LEAST, TIMES * lag) and covered[start] < end:
            found.append((start, end - start, lag))
            np.maximum(covered[start:end], end, out=covered[start:end])
            np.maximum(settled[start:end], end - lag, out=settled[start:end])

    for lag in range(1, min(GRAM, n // TIMES + 1)):
        same = np.concatenate([[False], s[lag:] == s[:-lag], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        for start, end in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if end - start >= LEAST - lag:
                take(start, end + lag, lag)
    if n < TIMES * GRAM:
        return sorted(found)
    number = _numbers(s, GRAM)
    m = len(number)
    keyed = np.sort(number * np.int64(n + 1) + np.arange(m))     # (gram, place)
    octave = GRAM
    while octave <= n // TIMES:
        checks = np.arange(0, m, octave)
        base = number[checks] * np.int64(n + 1)
        lo = np.searchsorted(keyed, base + checks + octave)
        hi = np.searchsorted(keyed, base + np.minimum(checks + 2 * octave, n))
        many = np.maximum(hi - lo, 0)
        at = np.repeat(checks, many)
        lag = keyed[np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(many.cumsum() - many, many)] % (n + 1) - at
        open_ = at + lag > settled[at]
        at, lag = at[open_], lag[open_]
        seen: dict[int, int] = {}                                # lag: end of the last stretch tried
        for c, q in sorted(zip(at.tolist(), lag.tolist())):
            if TIMES * q <= n and c + q >= seen.get(q, 0):
                start, end = _reach(s, c, q)
                seen[q] = end
                take(start, end, q)
        octave *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def find_runs(words: Sequence) -> list[tuple[int, int, int]]:
    """All runs ``(start, length, period)`` of a text's words, by start, then period."""
    number: dict = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    if len(ids) < LEAST or len(number) > len(ids) - LEAST + LEAST // TIMES:
        return []       # LEAST words of a run are at most LEAST // TIMES different ones
    array = np.array(ids, np.int64)
    return sorted(((lo + a, n, q) for lo, hi in survivors(ids) for a, n, q in runs_of(array[lo:hi])),
                  key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: Sequence[tuple[int, int, int]]) -> list[bytes]:
    """The words less those that a run holds after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [w for w, inside in zip(words, edge[:-1].cumsum().tolist()) if not inside]


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)`` per input row.

    ``runs`` holds every run by start, then period (word numbers from 0), and ``collapsed`` the text with
    one period of each run, its words joined by one space. A null or empty text has no words, no runs
    and the empty collapsed text. Null ids stay null, repeated rows repeat their result, other columns
    are not read, and texts of any length are scanned whole.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        counts, found, texts = [], [], []
        for text in pdf["text"].array:
            words = text.encode().split() if isinstance(text, str) else []
            runs = find_runs(words)
            counts.append(len(words))
            found.append([{"start": a, "length": n, "period": q} for a, n, q in runs])
            texts.append(b" ".join(collapse(words, runs)).decode())
        return pd.DataFrame({"doc_id": pdf["doc_id"], "n_words": counts, "runs": found, "collapsed": texts})

    rows = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")
    return map_batches(rows, run, SCHEMA)


def plant(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)``: every tenth document, by a checksum of its id, gets a repeating tail.

    With h = crc32 of the decimal id, g = h div 10, n words, h divisible by 10 and n > 0, each word i from
    a = g mod n on becomes word a + (i - a) mod p, where p = 1 + (n - a) div (3 + g mod 8). Other texts
    and rows with a null id stay as they are.
    """
    h = F.crc32(F.col(id_col).cast("string"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), h.alias("h"))
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, words_of(F.col("text"), SEPARATORS)))
    rows = rows.withColumn("g", F.expr("h div 10")).withColumn("n", F.size("words"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    tail = F.transform(F.col("words"), lambda w, i: F.when(i >= F.col("a"), F.get(
        F.col("words"), (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))).otherwise(w))
    chosen = F.coalesce((F.col("h") % 10 == 0) & (F.col("n") > 0), F.lit(False))
    return rows.select("doc_id", F.when(chosen, F.array_join(tail, " ")).otherwise(F.col("text")).alias("text"))


def best_run(runs: Sequence[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run of the greatest exact length / period; ties go to the smallest start, then period."""
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))


def report(detected: DataFrame) -> DataFrame:
    """Digest columns of ``detect``'s rows: counts, the run of the highest exponent, and checksums.

    Exponents are compared by cross-multiplication, so they are exact. Without a run its four columns
    are null and ``runs_sha256`` is that of the empty text.
    """
    better = (lambda x, y: x["length"] * y["period"] > y["length"] * x["period"])   # runs come by start, then period
    best = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.get("runs", F.lit(0)),
                       lambda acc, x: F.when(better(x, acc), x).otherwise(acc))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return (detected.withColumn("best", best)
            .select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
                    F.col("best.length").alias("length"), F.col("best.period").alias("period"),
                    F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
                    F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
                    F.sha2("collapsed", 256).alias("collapsed_sha256")))
