"""Quality rules: plain text counts, then compression bands.

A zstandard ratio far below that of prose means repetition, one far above it means noise. The ratio
of the whole document and of every fixed-size chunk must lie in the band of its length: short texts
compress worse because the frame header and the unseen vocabulary weigh more.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from trolley.llm.common import keep_rows, map_batches

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
CHUNK_BYTES = 4096
LEAST_BYTES = 256     # of a last chunk: the frame header alone takes shorter ones out of any band
LEVEL = 3
# (bytes up to, lowest ratio, highest ratio): the band of texts of at most that many bytes.
BANDS = ((256, 0.30, 1.15), (1024, 0.16, 0.90), (4096, 0.12, 0.72), (16384, 0.08, 0.68), (1 << 62, 0.05, 0.66))

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SCHEMA = (f"doc_id long, {COUNTS}, base_failed boolean, ratio double, chunk_low double, chunk_high double, "
          "method_failed boolean, kept boolean")


def repeat_words(words: Sequence[bytes], window: int = WINDOW) -> int:
    """Words inside a ``window``-word run that the text holds at least twice (first one included).

    Exact: runs get numbers by doubling (pairs, fours, eights) from numbered words, no hashing.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    span = 1
    while span < window:
        step = min(span, window - span)
        pair = ids[:-step] * np.int64(len(words) + 1) + ids[step:]
        ids = np.unique(pair, return_inverse=True)[1].reshape(-1)
        span += step
    twice = np.bincount(ids)[ids] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((edge[:-1].cumsum() > 0).sum())


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line of the text."""
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    return len(lines) - len(set(lines))


def band_of(n_bytes: int, bands=BANDS) -> tuple[float, float]:
    return next((low, high) for most, low, high in bands if n_bytes <= most)


def ratios(raw: bytes, compressor, chunk: int = CHUNK_BYTES) -> tuple[float, list[tuple[int, float]]]:
    """Whole-document ratio, and (bytes, ratio) of each chunk; a last one under ``LEAST_BYTES`` takes bytes before it."""
    if not raw:
        return 0.0, []
    whole = len(compressor.compress(raw)) / len(raw)
    if len(raw) <= chunk:
        return whole, []
    parts = [raw[i:i + chunk] for i in range(0, len(raw), chunk)]
    if len(parts[-1]) < LEAST_BYTES:
        parts[-1] = raw[-min(LEAST_BYTES, chunk):]
    return whole, [(len(p), len(compressor.compress(p)) / len(p)) for p in parts]


def _measure(pdf: pd.DataFrame, bands, chunk: int, level: int) -> pd.DataFrame:
    import zstandard

    compressor = zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False)
    rows = []
    for doc_id, text in zip(pdf["doc_id"].array, pdf["text"].array):
        text = text if isinstance(text, str) else ""
        raw = text.encode()
        words = raw.split()
        n = len(words)
        repeated = repeat_words(words)
        base_failed = n < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * n
        whole, parts = ratios(raw, compressor, chunk)
        low, high = band_of(len(raw), bands)
        bad = not low <= whole <= high
        chunk_low = min((r for _, r in parts), default=whole)
        chunk_high = max((r for _, r in parts), default=whole)
        for size, r in parts:
            low, high = band_of(size, bands)
            bad = bad or not low <= r <= high
        rows.append((doc_id, n, len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)),
                     dup_lines(text), repeated, base_failed, whole, chunk_low, chunk_high, bad,
                     not base_failed and not bad))
    out = pd.DataFrame(rows, columns=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                      "base_failed", "ratio", "chunk_low", "chunk_high", "method_failed", "kept"])
    out["doc_id"] = out["doc_id"].astype("Int64")
    return out


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands=BANDS, chunk: int = CHUNK_BYTES,
            level: int = LEVEL) -> DataFrame:
    """Counts, ratios and the verdict of each document; one output row per input row.

    A null or empty text has no words, ratio 0 and fails the base rules. Null ids stay null; repeated
    rows give repeated results; other columns are not read. Texts of any length are measured whole.
    """
    rows = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")
    return map_batches(rows, lambda pdf: _measure(pdf, bands, chunk, level), SCHEMA)


def keep_good(docs: DataFrame, text_col: str = "text", bands=BANDS, chunk: int = CHUNK_BYTES,
              level: int = LEVEL) -> DataFrame:
    """Rows of ``docs`` whose text passes the base rules and the bands, columns unchanged."""

    def mask(texts: list) -> np.ndarray:
        pdf = pd.DataFrame({"doc_id": pd.Series(range(len(texts)), dtype="Int64"), "text": pd.Series(texts, dtype=object)})
        return _measure(pdf, bands, chunk, level)["kept"].to_numpy(bool)

    return keep_rows(docs, mask, text_col=text_col)
