"""Language ID by language-bitmask n-gram filters.

All languages share one bit-sliced Bloom filter: slot j holds a 64-bit mask with one bit for each
language, and the AND of an n-gram's slots names every language that contains it. A document's
votes are the popcounts per language over its n-grams, less the share that the language's fill
lets through by chance; most corrected votes win.

The model is fitted on a bounded sample: about ``DOCS_PER_LANGUAGE`` labelled documents of each
language, chosen by a hash of the id, and at most ``GRAMS_PER_LANGUAGE`` n-grams of each.
Its size is therefore fixed (at most 16 MB); counting is a Spark aggregate.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trolley.llm.common import map_batches

SIZES = (3, 4)
PROBES = 3
DOCS_PER_LANGUAGE = 4000
GRAMS_PER_LANGUAGE = 20_000
MIN_COUNT = 3
RIVAL_SHARE = 0.34       # a language contains an n-gram if its rate is at least this part of the highest rate
MAX_LANGUAGES = 64
MAX_SLOTS_LOG2 = 21      # three 21-bit probes out of one 64-bit hash
FOLDS = 5
UNDETERMINED = "und"
PIECE = 1 << 20
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each n-gram, number of its text, whether each text has a letter).

    Letters are lower-cased, anything else is a word edge; an n-gram may begin or end with an edge.
    """
    lowered = [t.lower() + "\n" for t in texts]
    codes = np.frombuffer(("\n" + "".join(lowered)).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    doc = np.concatenate([[0], doc])
    letter = _letters()[codes]
    codes = np.where(letter, codes, 32).astype(np.uint64)
    hashes, owner = [], []
    for n in SIZES:
        count = len(codes) - n + 1
        if count < 1:
            continue
        inner = letter[1:count + 1].copy()
        for j in range(2, n - 1):
            inner &= letter[j:count + j]
        h = np.full(count, n, np.uint64)
        for j in range(n):
            h = (h ^ codes[j:count + j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        hashes.append(h[inner])
        owner.append(doc[1:count + 1][inner])   # the second character is a letter of its own text
    has_letter = np.bincount(doc[letter], minlength=len(texts))[:len(texts)] > 0
    return np.concatenate(hashes or [np.empty(0, np.uint64)]), np.concatenate(owner or [np.empty(0, np.int64)]), has_letter


def _pieces(text: str) -> list[str]:
    """A very long text in pieces that overlap by the longest n-gram less one."""
    step = PIECE - max(SIZES) + 1
    return [text] if len(text) <= PIECE else [text[i:i + PIECE] for i in range(0, len(text), step)]


@dataclass
class Model:
    languages: list[str]
    slots: np.ndarray        # uint64 masks
    chance: np.ndarray       # per language: share of unknown n-grams that its filter lets through

    def masks(self, h: np.ndarray) -> np.ndarray:
        low, out = np.uint64(len(self.slots) - 1), None
        for p in range(PROBES):
            m = self.slots[(h >> np.uint64(21 * p)) & low]
            out = m if out is None else out & m
        return out

    def votes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Corrected votes (texts x languages) and whether each text has a letter."""
        parts = [(i, p) for i, t in enumerate(texts) for p in _pieces(t)]
        hits = np.zeros((len(texts), len(self.languages)))
        total, has = np.zeros(len(texts)), np.zeros(len(texts), bool)
        start = 0
        while start < len(parts):
            end, size = start, 0
            while end < len(parts) and (end == start or size + len(parts[end][1]) <= PIECE):
                size += len(parts[end][1])
                end += 1
            index = np.array([i for i, _ in parts[start:end]])
            h, owner, letter = grams([p for _, p in parts[start:end]])
            has[index[letter]] = True
            if len(h):
                owner = index[owner]
                masks = self.masks(h)
                total += np.bincount(owner, minlength=len(texts))
                for k in range(len(self.languages)):
                    hits[:, k] += np.bincount(owner, (masks >> np.uint64(k)) & np.uint64(1), minlength=len(texts))
            start = end
        return np.maximum(0, (hits - total[:, None] * self.chance) / (1 - self.chance)), has

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and its share of all votes. No vote at all: the first language, score 0."""
        if not self.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        votes, has = self.votes(texts)
        best, total = votes.argmax(axis=1), votes.sum(axis=1)
        top = votes[np.arange(len(texts)), best]
        share = np.divide(top, total, out=np.zeros(len(texts)), where=total > 0)
        return ([self.languages[b] if ok else UNDETERMINED for b, ok in zip(best, has)],
                [float(s) if ok else 0.0 for s, ok in zip(share, has)])


def build(languages: list[str], gram: np.ndarray, mask: np.ndarray) -> Model:
    """The bit-sliced filter of n-gram hashes and their language masks: 8 slots an n-gram or more."""
    log2 = min(MAX_SLOTS_LOG2, max(10, int(np.ceil(np.log2(max(1, 8 * len(gram)))))))
    slots = np.zeros(1 << log2, np.uint64)
    low = np.uint64(len(slots) - 1)
    for p in range(PROBES):
        np.bitwise_or.at(slots, (gram >> np.uint64(21 * p)) & low, mask)
    fill = np.array([((slots >> np.uint64(k)) & np.uint64(1)).mean() for k in range(len(languages))])
    return Model(languages, slots, np.minimum(0.99, fill ** PROBES))


def fit(labelled: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE,
        grams_per_language: int = GRAMS_PER_LANGUAGE) -> Model:
    """Model of ``labelled(doc_id, text, lang)``; rows with a null column are left out.

    No rows give a model without languages, which answers ``und``.
    """
    rows = labelled.where("doc_id is not null and text is not null and lang is not null")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        return build([], np.empty(0, np.uint64), np.empty(0, np.uint64))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    chosen = F.lit(False)
    for r in sizes:
        chosen = chosen | ((F.col("lang") == r["lang"]) & (draw < min(1.0, docs_per_language / r["n"])))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        frames = []
        for lang, part in pdf.groupby("lang"):
            h, _, _ = grams([p for t in part["text"] for p in _pieces(t)])
            g, c = np.unique(h, return_counts=True)
            frames.append(pd.DataFrame({"lang": lang, "gram": g.view(np.int64), "c": c}))
        return pd.concat(frames)

    counted = (map_batches(rows.where(chosen).select("text", "lang"), count, "lang string, gram long, c long",
                           max_chars=PIECE).groupBy("lang", "gram").agg(F.sum("c").alias("c")))
    rate = F.col("c") / F.sum("c").over(Window.partitionBy("lang"))
    rated = counted.withColumn("rate", rate).withColumn("high", F.max("rate").over(Window.partitionBy("gram")))
    order = Window.partitionBy("lang").orderBy(F.col("c").desc(), "gram")
    most = min(grams_per_language, (1 << MAX_SLOTS_LOG2) // (8 * len(languages)))
    kept = (rated.where((F.col("c") >= MIN_COUNT) & (F.col("rate") >= RIVAL_SHARE * F.col("high")))
            .withColumn("place", F.row_number().over(order)).where(F.col("place") <= most))
    found = kept.select("lang", "gram").toPandas()   # at most grams_per_language rows a language
    bit = found["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(np.uint64)
    gram = found["gram"].to_numpy(np.int64).view(np.uint64)
    return build(languages, gram, np.left_shift(np.uint64(1), bit))


def held_out(id_col: str = "doc_id"):
    """Whether the id's fold is 0; a null id is not held out (and never learned from)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(False))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` per input row, from the whole text alone.

    Null texts and texts without a letter are ``und`` with score 0. Repeated rows repeat.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)   # at most 16 MB, see MAX_SLOTS_LOG2

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lang, score = shared.value.predict([t if isinstance(t, str) else "" for t in pdf["text"].array])
        return pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "held_out": pdf["held_out"],
                             "lang_pred": lang, "score": score})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       held_out(id_col).alias("held_out"))
    return map_batches(rows, run, SCHEMA, max_chars=4 * PIECE)


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the rows outside fold 0 with a language, then predict every row of ``documents``."""
    model = fit(docs.select("doc_id", "text", "lang").where(~held_out()))
    return predict(docs, model)
