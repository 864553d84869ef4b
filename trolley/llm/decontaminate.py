"""Benchmark decontamination by winnowing.

A shared span of ``WINDOW`` words must be found. Every run of ``WINDOW - GRAM + 1`` consecutive k-grams
(``GRAM`` words each) keeps its smallest hash, leftmost on ties; a shared span holds one such run, so
both sides keep the same k-gram of it. Documents and items are joined on kept hashes only, and each
hit is extended: the item windows around it are compared word for word. Items shorter than the
window keep one gram of their whole length, and documents all grams of such lengths.

Benchmark fingerprints and windows are broadcast while their counted rows are few; then documents
cross the network only as hits. Beyond that bound the fingerprints are joined by shuffling, and
only documents with a hit are read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trolley.llm.common import ascii_lower, bitmap, digest128, materialize, split_by_bitmap

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
GRAM = 7
MAX_BROADCAST = 200_000
KEPT = "array<struct<f:long,at:int>>"


def words(text: Column) -> Column:
    """The lower-cased words; null has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def kept_grams(lengths: list[int], window: int = WINDOW, gram: int = GRAM) -> Column:
    """Winnowed fingerprints ``(f, at)`` of the array column ``words``; ``at`` counts from 1.

    A hash's upper 34 bits and its place (30 bits) share one long, so the smallest long is the leftmost
    smallest hash. ``lengths``: lengths of short items, whose grams are all kept.
    """
    run = window - gram + 1
    packed = (f"transform(sequence(1, size(words) - {gram - 1}), "
              f"i -> shiftleft(shiftright(xxhash64(slice(words, i, {gram})), 30), 30) + i)")
    least = (f"transform(array({packed}), g -> array_distinct(transform(sequence(1, size(g) - {run - 1}), "
             f"i -> array_min(slice(g, i, {run})))))[0]")
    long = (f"transform({least}, x -> named_struct('f', shiftright(x, 30), 'at', cast(x & {(1 << 30) - 1}L as int)))")
    parts = [f"if(size(words) >= {window}, {long}, cast(array() as {KEPT}))"]
    for n in lengths:   # at most window - 1 of them; the length is part of the hash
        parts.append(f"if(size(words) >= {n}, transform(sequence(1, size(words) - {n - 1}), i -> named_struct("
                     f"'f', shiftright(xxhash64({n}, slice(words, i, {n})), 30), 'at', i)), cast(array() as {KEPT}))")
    return F.expr(f"concat({', '.join(parts)})")


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(run array<string>, window_key, item_id)`` of every item window; equal windows share a key."""
    size = F.least(F.size("words"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("words") - size + 1)
    return (items.where("size(words) > 0")
            .select("item_id", F.explode(F.array_distinct(F.transform(starts, lambda i: F.slice("words", i, size)))).alias("run"))
            .withColumn("window_key", digest128(F.col("run"))))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM,
         max_broadcast: int = MAX_BROADCAST) -> tuple[DataFrame, DataFrame]:
    """``(text_key, start, end, window_key)`` of every occurrence of an item window in ``docs(text_key, text)``,
    and ``(window_key, item_id)`` of the items that have each window.

    ``start`` counts words from 1, ``end`` is exclusive. Equal texts share a key and give their hits once.
    A broadcast window has no item ids, so its row does not grow with the benchmark.
    """
    items = materialize(benchmark.select("item_id", words(F.col("text")).alias("words")), "items")
    lengths = sorted(r["n"] for r in items.select(F.size("words").alias("n")).where(
        f"n between 1 and {window - 1}").distinct().collect())   # fewer than window numbers
    of_items = materialize(item_windows(items, window), "item-windows")
    windows = materialize(of_items.select("run", "window_key").distinct(), "distinct-windows")
    # an item only needs the fingerprints of its own form: the short form if it is short
    short = items.where(f"size(words) between 1 and {window - 1}").select(F.expr(
        "shiftright(xxhash64(size(words), words), 30)").alias("f"))
    full = (items.where(f"size(words) >= {window}").select(F.explode(kept_grams([], window, gram)).alias("k"))
            .select("k.f"))
    fingerprints = materialize(short.unionByName(full).distinct(), "item-fingerprints")
    small = fingerprints.count() <= max_broadcast and windows.count() <= max_broadcast
    texts = docs.select("text_key", words(F.col("text")).alias("words"))
    kept = texts.select("text_key", "words", F.explode(kept_grams(lengths, window, gram)).alias("k"))
    if small:
        found = kept.select("text_key", "words", F.col("k.f").alias("f"), F.col("k.at").alias("at")).join(
            F.broadcast(fingerprints), "f", "left_semi")
        found = found.select("text_key", "words", "at")
        windows = F.broadcast(windows)
    else:
        at = materialize(kept.select("text_key", "k.f", "k.at").join(fingerprints, "f", "left_semi")
                         .select("text_key", "at").distinct(), "hit-places")
        some = texts.join(at.select("text_key").distinct(), "text_key", "left_semi")
        found = some.join(at, "text_key")
    # the item windows that can hold the gram at ``at``: full ones that cover it, short ones that start there
    around = F.sequence(F.greatest(F.lit(1), F.col("at") - (window - gram)),
                        F.greatest(F.lit(1), F.least(F.col("at"), F.size("words") - window + 1)))
    full_tries = F.when(F.size("words") >= window, F.transform(around, lambda i: F.struct(
        i.alias("start"), F.lit(window).alias("n")))).otherwise(F.array().cast("array<struct<start:int,n:int>>"))
    short_tries = F.transform(F.array(*map(F.lit, lengths)).cast("array<int>"),
                              lambda n: F.struct(F.col("at").alias("start"), n.alias("n")))
    tries = F.filter(F.concat(full_tries, short_tries), lambda t: t["start"] + t["n"] - 1 <= F.size("words"))
    spans = (found.select("text_key", F.explode(F.transform(tries, lambda t: F.struct(
        t["start"].alias("start"), (t["start"] + t["n"]).alias("end"), F.slice("words", t["start"], t["n"]).alias("run"))))
        .alias("t")).select("text_key", "t.*"))
    found = spans.join(windows, "run").select("text_key", "start", "end", "window_key")
    return found, of_items.select("window_key", "item_id")


def _hit_texts(keyed: DataFrame, benchmark: DataFrame, window: int, gram: int, max_broadcast: int) -> DataFrame:
    """``(text_key, spans, n_hit, item_ids)`` of the texts with a hit."""
    found, of_items = hits(keyed.select("text_key", "text"), benchmark.select("item_id", "text"), window, gram, max_broadcast)
    found = materialize(found.distinct(), "hits")
    ids = (found.select("text_key", "window_key").distinct().join(of_items, "window_key")
           .groupBy("text_key").agg(F.collect_set("item_id").alias("ids")))
    per_text = (found.groupBy("text_key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
                .join(ids, "text_key"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["reach"]))).alias("n"),
            F.greatest(acc["reach"], s["end"]).alias("reach")), lambda acc: acc["n"])
    return per_text.select("text_key", "spans", covered.cast("long").alias("n_hit"),
                           F.array_sort(F.transform("ids", lambda i: i.cast("string"))).alias("item_ids"))


def _is_contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM,
                  max_broadcast: int = MAX_BROADCAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_hit, item_ids, spans, contaminated)`` per input row.

    ``spans`` are the ``(start, end)`` word places of the hits, ``item_ids`` the items as sorted strings. Null
    and empty texts have no words and are clean; empty items match nothing; items without an id hit
    words but are not listed; repeated rows repeat. An empty benchmark leaves all clean.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("text_key", digest128(F.col("text")))
    counted = _hit_texts(rows, benchmark, window, gram, max_broadcast)
    sized = rows.select("doc_id", "text_key", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = sized.join(counted, "text_key", "left").withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long")))
    return out.select("doc_id", "n_words", "n_hit", F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
                      F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
                      _is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def report(found: DataFrame) -> DataFrame:
    """Counts and the digest of the items of each document."""
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM,
                      max_broadcast: int = MAX_BROADCAST, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, columns unchanged, whose text is not contaminated.

    Decided by text, not by id. A fixed-size bitmap of the contaminated texts' hashes lets the other
    rows pass where they are; only rows that it cannot clear are joined.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(text.alias("text")).withColumn("text_key", digest128(F.col("text")))
    counted = _hit_texts(keyed, benchmark, window, gram, max_broadcast)
    sized = keyed.select("text_key", F.size(words(F.col("text"))).alias("n_words"))
    bad = materialize(sized.join(counted.select("text_key", "n_hit"), "text_key")
                      .where(_is_contaminated(F.col("n_hit"), F.col("n_words"))).select("text_key").distinct(), "bad-texts")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), digest128(text).alias("text_key"))
    rows = rows.withColumn("short", F.col("text_key.a"))
    marked = split_by_bitmap(rows, "short", bitmap(bad.select(F.col("text_key.a").alias("short")), "short"))
    cleared = marked.where(~F.col("maybe"))
    checked = marked.where("maybe").join(bad, "text_key", "left_anti")
    return cleared.select("row.*").unionByName(checked.select("row.*"))
