"""Secret scans: patterns for known shapes, and character Markov models for the rest.

Two first-order models of characters, one of random strings and one of ordinary identifiers, give
the log-likelihood ratio of a candidate token. They are trained here from labelled samples of the
corpus: the values that the patterns find are random strings, other words are identifiers; half of
the random model's mass is uniform, since no sample shows every alphabet. Training reads about
``SAMPLE_DOCS`` documents for secrets, and about ``ORDINARY_DOCS`` of these for identifiers, chosen by a
hash of the text. Everything is built-in expressions.

Places come from splitting: a pattern's matches and the pieces between them add up to the text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the base patterns, the group whose length counts, and its least length
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"          # a run of 16 or more is a maximal run of [0-9a-f]+ that is long enough
MIN_CANDIDATE = 16
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{MIN_CANDIDATE},}}"
WORD = r"[A-Za-z0-9+/_=-]{5,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
SAMPLE_DOCS = 20_000
ORDINARY_DOCS = 2_000
MIN_RATIO = 12.0                # nats in all
MIN_RATIO_PER_STEP = 0.6        # and for each transition
SPAN = "array<struct<start:int,kind:int,end:int>>"


def _spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """``(start, kind, end)`` of the matches whose ``group`` has ``least`` characters; code points."""
    pieces = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    steps = F.zip_with(F.slice(pieces, F.lit(1), F.size(whole)), F.arrays_zip(whole.alias("whole"), measured.alias("part")),
                       lambda p, m: F.struct(F.length(p).alias("skip"), F.length(m["whole"]).alias("len"),
                                             F.length(m["part"]).alias("part")))
    none = F.array().cast(SPAN)
    found = F.aggregate(
        steps, F.struct(F.lit(0).alias("at"), none.alias("spans")),
        lambda acc, s: F.struct(
            (acc["at"] + s["skip"] + s["len"]).alias("at"),
            F.when(s["part"] >= least, F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + s["skip"]).alias("start"), F.lit(kind).alias("kind"),
                (acc["at"] + s["skip"] + s["len"]).alias("end"))))).otherwise(acc["spans"]).alias("spans")),
        lambda acc: acc["spans"])
    return F.when(text.rlike(pattern), found).otherwise(none)


def _states(token: Column) -> Column:
    """Alphabet places (from 1) of a token's characters."""
    return F.transform(F.slice(F.split(token, ""), F.lit(1), F.length(token)), lambda c: F.instr(F.lit(ALPHABET), c))


def _transitions(token: Column) -> Column:
    """Number of each transition: from 1 to the square of the alphabet."""
    at = _states(token)
    return F.zip_with(F.slice(at, F.lit(1), F.size(at) - 1), F.slice(at, F.lit(2), F.size(at) - 1),
                      lambda a, b: (a - 1) * len(ALPHABET) + b)


def ratios_of(counts: list[tuple[str, int, int]], smooth: float = 0.5) -> list[float]:
    """Log-likelihood ratio of every transition from ``(label, transition, count)`` rows."""
    n = len(ALPHABET)
    seen = {label: [smooth] * (n * n) for label in ("random", "ordinary")}
    for label, transition, count in counts:
        seen[label][transition - 1] += count
    out = []
    for a in range(n):
        rows = {label: v[a * n:(a + 1) * n] for label, v in seen.items()}
        total = {label: sum(r) for label, r in rows.items()}
        for b in range(n):
            random = 0.5 / n + 0.5 * rows["random"][b] / total["random"]
            out.append(math.log(random / (rows["ordinary"][b] / total["ordinary"])))
    return out


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, ordinary_docs: int = ORDINARY_DOCS,
          text_col: str = "text") -> list[float]:
    """Transition ratios from about ``sample_docs`` texts; the table's size is fixed by the alphabet."""
    rows = docs.select(F.col(text_col).alias("text")).where("text is not null and text <> ''")
    total = rows.count()
    text = F.col("text")
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) * max(1, total) / (1 << 30)   # uniform in 0 .. total
    sample = rows.where(draw < sample_docs)
    values = F.concat(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0)),
                      F.regexp_extract_all(text, F.lit(HEX), F.lit(0)))
    secret = F.filter(values, lambda v: F.length(v) >= 12)
    rest = text
    for pattern in (ASSIGN, ACCESS, HEX):
        rest = F.regexp_replace(rest, pattern, " ")
    ordinary = F.when(draw < ordinary_docs, F.regexp_extract_all(rest, F.lit(WORD), F.lit(0))).otherwise(
        F.array().cast("array<string>"))
    tokens = sample.select(F.explode(F.concat(
        F.transform(secret, lambda v: F.struct(F.lit("random").alias("label"), v.alias("token"))),
        F.transform(ordinary, lambda v: F.struct(F.lit("ordinary").alias("label"), v.alias("token"))))).alias("t"))
    counted = (tokens.select("t.label", F.explode(_transitions(F.col("t.token"))).alias("step"))
               .groupBy("label", "step").agg(F.count(F.lit(1)).alias("n")).collect())   # at most 2 x 68 x 68 rows
    return ratios_of([(r["label"], r["step"], r["n"]) for r in counted])


def scan(docs: DataFrame, ratios: list[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, base, spans)`` per input row: arrays of ``(start, kind, end)`` sorted by start, then kind.

    ``kind`` counts in ``KINDS``; ``base`` has the patterns' spans, ``spans`` also those that the
    models add in what the base spans leave of each token. Null texts count as empty and have no spans; whole texts are
    scanned; repeated rows repeat. Reads no other column.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    base = F.concat(_spans(text, ASSIGN, 0, group=2, least=12), _spans(text, ACCESS, 1, least=18), _spans(text, HEX, 2))
    tokens = _spans(text, CANDIDATE, 3)
    with_base = rows.select("doc_id", "text", F.array_sort(base).alias("base"), tokens.alias("tokens"))
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")

    def likely(span: Column) -> Column:
        token = F.substring(text, span["start"] + 1, span["end"] - span["start"])
        score = F.aggregate(_transitions(token), F.lit(0.0), lambda acc, t: acc + F.element_at(table, t))
        return (score >= MIN_RATIO) & (score >= MIN_RATIO_PER_STEP * (span["end"] - span["start"] - 1))

    def parts(t: Column) -> Column:
        """What the base spans leave of a token: the pieces before, between and after them."""
        inside = F.filter("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
        part = lambda start, end: F.array(F.struct(start.alias("start"), t["kind"].alias("kind"), end.alias("end")))
        return F.aggregate(
            inside, F.struct(t["start"].alias("at"), F.array().cast(SPAN).alias("cut")),
            lambda acc, b: F.struct(F.greatest(acc["at"], b["end"]).alias("at"),
                                    F.concat(acc["cut"], part(acc["at"], b["start"])).alias("cut")),
            lambda acc: F.concat(acc["cut"], part(acc["at"], t["end"])))

    free = F.filter(F.flatten(F.transform("tokens", parts)), lambda t: t["end"] - t["start"] >= MIN_CANDIDATE)
    return (with_base.withColumn("free", free)
            .select("doc_id", "base", F.array_sort(F.concat("base", F.filter("free", likely))).alias("spans")))


def render(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    """Counts per base kind, the digest of the base spans and all spans as text."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(render(F.col("base")), 256).alias("base_sha256"), render(F.col("spans")).alias("spans"))
