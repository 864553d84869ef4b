"""URL filters by a Bloom filter cascade.

A cascade tells exactly which keys of a known universe are listed. Level 0 is a Bloom filter of the
listed keys; the unlisted keys of the universe that pass it are encoded in level 1, the listed keys
that pass level 1 in level 2, and so on until nothing passes wrongly. The universe here is every key
of the corpus, so a lookup in the (small) filters replaces a join.

Keys are host suffixes at label boundaries, with the path cut to the lengths that rules have.
Each list (allowing rules, blocking rules, listed hosts) has its own cascade.

Level 0 lets about a sixteenth as many unlisted keys pass as there are listed ones, whatever the
universe; later levels let one key in 32 pass. So n listed of m other keys need about
1.44 n (4 + log2(m / n)) bits: the filters follow the list, and the corpus only by its logarithm.
The bits are set in tasks, a segment of words each; the driver receives the finished segments. A list
that needs more than ``max_bytes`` is cut into shards of its keys by hash, a cascade each, and the
shards are looked up one after the other, so no broadcast outgrows the bound.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trolley.llm.common import ASCII_UPPER, map_batches, materialize

RATE = 1 / 32                  # of wrong keys that a level after the first lets pass
FIRST_SHARE = 1 / 16           # wrong keys that level 0 lets pass, as a share of the listed ones
MAX_FILTER_BYTES = 64 << 20    # of level 0; a list that needs more is cut into shards
SEGMENT_WORDS = 1 << 17        # of a filter, made in one task
MAX_LEVELS = 60
# fixed values: words that mark an unwanted host when they are a label or a hyphened part of one
UNWANTED = ("adult", "bets", "casino", "gambling", "pills", "porn", "spam", "xxx")
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
         ("allow", "org", "/fr/"))


def with_host_path(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` plus ``host`` and ``path``; both empty for a null url or one without ``://``."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    part = lambda i: F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i)
    return pages.withColumn("host", F.translate(part(1), ASCII_UPPER, ASCII_UPPER.lower())).withColumn("path", part(2))


def suffixes(host: str) -> list[str]:
    """The host and its parent domains, longest first; nothing for an empty host."""
    labels = host.split(".")
    return [".".join(labels[i:]) for i in range(len(labels))] if host else []


def keys_of(host: str, path: str, lengths: tuple[int, ...]) -> list[str]:
    """Suffix plus path start, for every length that the path has."""
    starts = [path[:n] for n in lengths if len(path) >= n]
    return [s + p for s in suffixes(host) for p in starts]


@dataclass
class Level:
    words: np.ndarray   # uint64
    salt: int
    probes: int

    def positions(self, h: np.ndarray) -> list[np.ndarray]:
        """h: the two hashes of each key (n x 2)."""
        bits = np.uint64(len(self.words) * 64)
        step = h[:, 1] | np.uint64(1)
        start = h[:, 0] ^ np.uint64((self.salt + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        start ^= start >> np.uint64(29)
        start *= np.uint64(0xBF58476D1CE4E5B9)
        start ^= start >> np.uint64(32)
        return [(start + np.uint64(j) * step) % bits for j in range(self.probes)]

    def passes(self, h: np.ndarray) -> np.ndarray:
        ok = np.ones(len(h), bool)
        for p in self.positions(h):
            ok &= (self.words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return ok


@dataclass
class Cascade:
    levels: list[Level]

    def contains(self, h: np.ndarray) -> np.ndarray:
        """Exact for keys of the universe: the number of levels passed in a row is odd."""
        depth, going = np.zeros(len(h), int), np.ones(len(h), bool)
        for level in self.levels:
            going &= level.passes(h)
            depth += going
        return depth % 2 == 1


def hashes(keys: list[str]) -> np.ndarray:
    import xxhash

    raw = [k.encode() for k in keys]
    return np.array([(xxhash.xxh64_intdigest(k, 1), xxhash.xxh64_intdigest(k, 2)) for k in raw],
                    np.uint64).reshape(-1, 2)


def first_rate(listed: int, others: int) -> float:
    """The rate of other keys that level 0 may let pass."""
    return min(RATE, FIRST_SHARE * listed / others) if listed and others else RATE


def filter_words(keys: int, rate: float) -> int:
    """64-bit words of a filter of so many keys."""
    return max(1, math.ceil(keys * math.log2(1 / rate) / math.log(2) / 64))


def _level(include: DataFrame, keys: int, rate: float, salt: int) -> Level:
    """The filter of ``keys`` keys: bits are gathered per word, words per segment, in tasks; segments come to the driver."""
    level = Level(np.zeros(filter_words(keys, rate), np.uint64), salt, max(1, round(math.log2(1 / rate))))
    shape = Level(np.broadcast_to(np.uint64(0), level.words.shape), salt, level.probes)   # its size, for the tasks

    def bits(batches):
        for pdf in batches:
            p = np.concatenate([np.empty(0, np.uint64), *shape.positions(hashes(list(pdf["key"])))])
            yield pd.DataFrame({"word": (p >> np.uint64(6)).astype(np.int64),
                                "bits": np.left_shift(np.uint64(1), p & np.uint64(63)).view(np.int64)})

    def segment(key, pdf):
        words = np.zeros(SEGMENT_WORDS, np.int64)
        words[pdf["word"].to_numpy() % SEGMENT_WORDS] = pdf["bits"].to_numpy(np.int64)
        return pd.DataFrame({"segment": [key[0]], "words": [words.tobytes()]})

    set_words = (include.select("key").mapInPandas(bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
                 .withColumn("segment", (F.col("word") / SEGMENT_WORDS).cast("long")))
    for r in set_words.groupBy("segment").applyInPandas(segment, "segment long, words binary").collect():
        at = r["segment"] * SEGMENT_WORDS
        words = np.frombuffer(r["words"], np.uint64)
        level.words[at:at + SEGMENT_WORDS] = words[:len(level.words) - at]
    return level


def _kept(keys: DataFrame, test, name: str) -> DataFrame:
    """The keys whose hashes pass ``test`` of a filter or cascade, written; it is broadcast for this alone."""
    shared = keys.sparkSession.sparkContext.broadcast(test)

    def keep(batches):
        for pdf in batches:
            yield pdf[shared.value(hashes(list(pdf["key"])))] if len(pdf) else pdf

    out = materialize(keys.mapInPandas(keep, keys.schema), name)
    shared.destroy()
    return out


def _split(listed: DataFrame, universe: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """The listed and the other keys of the universe, and their numbers. Nulls go, repeated keys count once."""
    every = universe.where("key is not null").distinct()
    include = materialize(every.join(listed.where("key is not null").distinct(), "key", "left_semi"), "listed")
    n = include.count()
    return include, every.join(include, "key", "left_anti"), n, every.count() - n


def _cascade(include: DataFrame, exclude: DataFrame, n: int, others: int) -> Cascade:
    levels: list[Level] = []
    while n:
        if len(levels) == MAX_LEVELS:
            raise RuntimeError("the cascade does not end")
        level = _level(include, n, RATE if levels else first_rate(n, others), len(levels))
        levels.append(level)
        include, exclude = _kept(exclude, level.passes, "passing"), include
        n = include.count()
    return Cascade(levels)


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """Cascade of the ``listed`` keys that ``universe`` has; both are tables of one column ``key``.

    Nulls are left out and repeated keys count once. Without listed keys nothing is contained.
    """
    return _cascade(*_split(listed, universe))


def cascade_or_keys(listed: DataFrame, universe: DataFrame, max_bytes: int = MAX_FILTER_BYTES) -> Cascade | DataFrame:
    """The cascade of a list; of one whose level 0 would pass ``max_bytes``, the universe's listed keys as a
    table, told by a cascade for each shard of the keys in turn."""
    include, exclude, n, others = _split(listed, universe)
    shards = math.ceil(filter_words(n, first_rate(n, others)) * 8 / max_bytes) if n else 1
    if shards == 1:
        return _cascade(include, exclude, n, others)
    found = []
    for s in range(shards):
        of = lambda df: df.where(F.pmod(F.xxhash64("key"), F.lit(shards)) == s)  # noqa: E731, B023
        keys = of(universe.where("key is not null").distinct())
        found.append(_kept(keys, build_cascade(of(include), keys).contains, "contained"))
    return reduce(DataFrame.unionByName, found)


def _rule_table(spark, rules) -> DataFrame:
    """``(action, host, path)`` of rules given as a table or as tuples; a rule with a null has no effect."""
    cols = ["action", "host", "path"]
    df = rules if isinstance(rules, DataFrame) else spark.createDataFrame(list(rules), "action string, host string, path string")
    return df.select(*cols).dropna()


def judge(pages: DataFrame, rules=RULES, unwanted: tuple[str, ...] = UNWANTED, id_col: str = "page_id",
          url_col: str = "url", max_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` per input row.

    ``rules`` are tuples or a table ``(action, host, path)`` of any size; ``action`` is allow or block. The
    longest fitting rule decides (``rule`` names it); block wins where both actions have that rule. Else the
    method's own list does: hosts with an unwanted word are blocked, and so is every subdomain; all others
    are allowed. Urls that are null or have no ``://`` have no keys and are allowed. Repeated rows repeat.
    """
    spark = pages.sparkSession
    rows = with_host_path(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url")))
    rows = rows.select("page_id", "host", "path")
    table = _rule_table(spark, rules)
    lengths = tuple(sorted(r[0] for r in table.select(F.length("path")).distinct().collect()))   # no more than the longest path
    longest = max(lengths, default=0)
    start = F.substring("path", 1, longest)

    def expand(batches):
        for pdf in batches:
            made = [(h, p, k) for h, p in zip(pdf["host"], pdf["start"]) for k in sorted({*keys_of(h, p, lengths), *suffixes(h)})]
            yield pd.DataFrame(made, columns=["host", "start", "key"], dtype=object)

    pairs = rows.select("host", start.alias("start")).distinct()
    keyed = pairs.mapInPandas(expand, "host string, start string, key string")
    universe = materialize(keyed.select("key").distinct(), "keys")
    word = "|".join(unwanted)
    lists = {a: table.where(F.col("action") == a).select(F.concat("host", "path").alias("key")) for a in ("allow", "block")}
    lists["hosts"] = universe.where(~F.contains("key", F.lit("/")) & F.col("key").rlike(f"^(?:[^.]*-)?(?:{word})(?:-[^.]*)?[.]"))
    cascades = {}
    for name, listed in lists.items():
        found = cascade_or_keys(listed, universe, max_bytes)
        if isinstance(found, Cascade):
            cascades[name] = found
            rows = rows.withColumn(f"{name}_key", F.lit(None).cast("string"))
        else:     # the longest listed key of each host and path start
            best = (keyed.join(found, "key").groupBy("host", "start")
                    .agg(F.max_by("key", F.length("key")).alias(f"{name}_key")))
            rows = (rows.withColumn("start", start).join(best, ["host", "start"], "left").drop("start"))
    shared = spark.sparkContext.broadcast(cascades)   # three, of about max_bytes at most each

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lists = shared.value
        rule, verdict = [], []
        memo: dict[tuple[str, str], tuple[str | None, str]] = {}
        for host, path, *known in zip(pdf["host"], pdf["path"], pdf["allow_key"], pdf["block_key"], pdf["hosts_key"]):
            begin = path[:longest]
            if (host, begin) not in memo:
                known = {a: k for a, k in zip(("allow", "block", "hosts"), known) if isinstance(k, str)}
                keys, parents = keys_of(host, begin, lengths), suffixes(host)
                h = hashes(keys)
                fits = [(len(known[a]), a, known[a]) for a in ("allow", "block") if a in known]
                fits += [(len(k), a, k) for a in ("allow", "block") if a in lists for k, x in zip(keys, lists[a].contains(h)) if x]
                if fits:
                    _, action, key = max(fits)
                    memo[host, begin] = key, action
                else:
                    bad = "hosts" in known or ("hosts" in lists and lists["hosts"].contains(hashes(parents)).any())
                    memo[host, begin] = None, "block" if bad else "allow"
            k, v = memo[host, begin]
            rule.append(k)
            verdict.append(v)
        return pd.DataFrame({"page_id": pdf["page_id"], "host": pdf["host"], "path": pdf["path"],
                             "rule": pd.Series(rule, dtype=object), "verdict": verdict})

    return map_batches(rows, run, "page_id long, host string, path string, rule string, verdict string", text_col="path")
