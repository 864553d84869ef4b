"""Tables under small changes: buckets of a key with base, delta and tombstone files, merged on read.

A commit writes two small sets of Parquet files: ``rows`` that appear and ``gone``, the keys whose older
rows disappear. A reader takes a row file plainly unless a later ``gone`` file lies in the same bucket;
only then are its rows matched with those tombstones. So a commit writes bytes in proportion to the change.

    <root>/data/<seq>-<id>-<kind>/bucket=<depth>-<bits>/*.parquet
    <root>/manifest/<version>.json     the buckets and the files that make up a version

Buckets hold the keys whose hash ends in some bits, and their number follows the data (extendible
hashing): one that outgrows ``bucket_bytes`` is split on its next bit. Where a second hash column is
named, a bucket of a single key goes on with the bits of that column's hash, so a key that holds a
third of all rows is spread too. A bucket whose deltas outweigh a share of its base, or are many, is
compacted, alone. Renaming the manifest into place commits a version; a replay writes new files and
replaces it. Files that no kept manifest names are deleted by ``drop_before``.

A table may name a column that ``sums`` up: its rows of one key add up, and a sum of 0 is no row. A commit then
writes signed amounts without reading the table, and nothing is ever ``gone``. Of a bucket, only the newest files
that outweigh a share of the one before them are merged, so sizes fall geometrically: a row is rewritten as
often as the logarithm of the commits, not once a commit.

A table may also lie over a ``source`` that it does not own: then its base is that DataFrame, never rewritten.
"""

from __future__ import annotations

import json
import math
import uuid
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trolley.sources.store import filesystem

BUCKET_BYTES = 64 << 20
ROWS_PER_BUCKET = 500_000     # of a new table, before any size is known
COMPACT_SHARE = 0.5           # deltas over this share of the base are merged into it
MAX_DELTAS = 8
FIRST_BITS = 32               # hash bits of the first column; those of the second follow
_SEQ = r"/data/(\d+)-"


@dataclass(frozen=True)
class Part:
    """The files of one commit in one bucket."""
    bucket: str
    seq: int
    kind: str      # rows or gone
    path: str
    size: int


@dataclass
class Manifest:
    seq: int = 0
    directory: list[tuple[int, int]] = field(default_factory=lambda: [(0, 0)])   # (depth, bits) of each bucket
    parts: list[Part] = field(default_factory=list)
    written: int = 0          # bytes that this version wrote, compaction included

    def dump(self) -> str:
        return json.dumps({"seq": self.seq, "directory": self.directory, "written": self.written,
                           "parts": [[p.bucket, p.seq, p.kind, p.path, p.size] for p in self.parts]})

    @staticmethod
    def load(text: str) -> "Manifest":
        d = json.loads(text)
        return Manifest(d["seq"], [tuple(x) for x in d["directory"]], [Part(*p) for p in d["parts"]], d["written"])


class DeltaTable:
    """``keys``: what a tombstone names; ``hashed``: the first and, if rows of one key are many, a second hash column."""

    def __init__(self, spark: SparkSession, root: str, keys: tuple[str, ...], hashed: tuple[str, ...], schema,
                 source: DataFrame | None = None, bucket_bytes: int = BUCKET_BYTES, share: float = COMPACT_SHARE,
                 max_deltas: int = MAX_DELTAS, sums: str | None = None):
        if sums is not None and source is not None:
            raise ValueError("a table that sums up owns its rows")
        if not set(hashed) <= set(keys) or not 1 <= len(hashed) <= 2:
            raise ValueError("the one or two hashed columns are keys")
        self.spark, self.root, self.keys, self.hashed = spark, root.rstrip("/"), keys, hashed
        self.schema, self.source, self.sums = schema, source, sums
        self.bucket_bytes, self.share, self.max_deltas = bucket_bytes, share, max_deltas

    # ------------------------------------------------------------------ manifests

    def _manifest_path(self, version: int) -> str:
        return f"{self.root}/manifest/{int(version)}.json"

    def manifest(self, version: int) -> Manifest:
        if version == 0 and self.source is not None:
            return Manifest()
        fs, path = filesystem(self.spark, self._manifest_path(version))
        stream = fs.open(path)
        try:
            return Manifest.load(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, version: int, m: Manifest) -> None:
        fs, path = filesystem(self.spark, self._manifest_path(version))
        _, draft = filesystem(self.spark, f"{self.root}/manifest/_{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray(m.dump().encode()))
        out.close()
        fs.delete(path, False)      # of a replayed version
        if not fs.rename(draft, path):
            raise OSError(f"could not commit {path}")

    def versions(self) -> list[int]:
        fs, path = filesystem(self.spark, f"{self.root}/manifest")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("_"))

    # ------------------------------------------------------------------ buckets

    def bucket(self, directory: list[tuple[int, int]]) -> Column:
        """The name of the bucket of a row's key."""
        h = F.xxhash64(self.hashed[0]).bitwiseAND(F.lit((1 << FIRST_BITS) - 1))
        if len(self.hashed) == 2:
            h = h + F.shiftleft(F.xxhash64(self.hashed[1]).bitwiseAND(F.lit((1 << 30) - 1)), FIRST_BITS)
        found = []
        for depth in sorted({d for d, _ in directory}):
            low = h.bitwiseAND(F.lit((1 << depth) - 1))
            found.append(F.when(low.isin([b for d, b in directory if d == depth]), F.concat(F.lit(f"{depth}-"), low.cast("string"))))
        return F.coalesce(*found)

    def _children(self, depth: int, bits: int, single: int | None) -> list[tuple[int, int]]:
        """The buckets that replace one: two of the next bit, or, for a single key with this hash of its first
        column, the empty ones beside its way down and two of the second column's first bit."""
        if single is None:
            return [(depth + 1, bits), (depth + 1, bits | 1 << depth)]
        beside = [(d + 1, (single & ((1 << (d + 1)) - 1)) ^ (1 << d)) for d in range(depth, FIRST_BITS)]
        return [*beside, (FIRST_BITS + 1, single), (FIRST_BITS + 1, single | 1 << FIRST_BITS)]

    # ------------------------------------------------------------------ writing

    def _write(self, df: DataFrame, kind: str, m: Manifest) -> list[Part]:
        path = f"{self.root}/data/{m.seq:08d}-{uuid.uuid4().hex[:8]}-{kind}"
        df.withColumn("bucket", self.bucket(m.directory)).repartition("bucket").write.partitionBy("bucket").parquet(path)
        fs, where = filesystem(self.spark, path)
        files, sizes = fs.listFiles(where, True), {}
        while files.hasNext():      # the files of this commit
            s = files.next()
            folder = s.getPath().getParent()
            if folder.getName().startswith("bucket=") and s.getPath().getName().endswith(".parquet"):
                sizes[folder.getName()[7:]] = sizes.get(folder.getName()[7:], 0) + s.getLen()
        m.written += sum(sizes.values())
        return [Part(b, m.seq, kind, f"{path}/bucket={b}", n) for b, n in sorted(sizes.items())]

    def create(self, df: DataFrame, version: int = 0) -> None:
        """The table's first version. The number of buckets follows the row count, then the sizes written."""
        depth = max(0, math.ceil(math.log2(max(1, df.count() / ROWS_PER_BUCKET))))
        m = Manifest(0, [(depth, b) for b in range(1 << depth)])
        m.parts = self._write(df, "rows", m)
        self._commit(version, self._compacted(m))

    def commit(self, version: int, gone: DataFrame | None = None, rows: DataFrame | None = None) -> int:
        """Version ``version`` from the one before: older rows of the ``gone`` keys go, ``rows`` come (one a key). Returns its bytes."""
        if gone is not None and self.sums is not None:
            raise ValueError("rows that add up are not replaced")
        m = self.manifest(version - 1)
        m.seq, m.written = m.seq + 1, 0
        parts = list(m.parts)
        if gone is not None:
            parts += self._write(gone.select(*self.keys).distinct(), "gone", m)
        if rows is not None:
            parts += self._write(rows, "rows", m)
        m.parts = parts
        m = self._compacted(m)
        self._commit(version, m)
        return m.written

    def _compacted(self, m: Manifest) -> Manifest:
        """Buckets with heavy or many deltas rewritten, and buckets over ``bucket_bytes`` split, until none is left."""
        settled: set[str] = set()       # buckets of a single key that cannot be split
        while True:
            by: dict[str, list[Part]] = {}
            for p in m.parts:
                by.setdefault(p.bucket, []).append(p)
            rewrite, large = {}, []
            for b, parts in by.items():
                rows = sorted((p for p in parts if p.kind == "rows"), key=lambda p: p.seq)
                merged = self._heavy(parts, rows)
                if merged:
                    rewrite[b] = merged
                elif sum(p.size for p in rows) > self.bucket_bytes and b not in settled and self.source is None:
                    large.append(b)
            if not rewrite and not large:
                return m
            chosen = set(rewrite) | set(large)
            taken = lambda: [p for b in chosen for p in rewrite.get(b, by[b])]
            df = self._merged(taken())
            if large:
                first = F.xxhash64(self.hashed[0]).bitwiseAND(F.lit((1 << FIRST_BITS) - 1))
                spans = {r["b"]: (r["lo"], r["hi"]) for r in
                         df.withColumn("h", first).groupBy(self.bucket(m.directory).alias("b"))
                         .agg(F.min("h").alias("lo"), F.max("h").alias("hi")).collect()}     # a row a bucket
                for b in large:
                    depth, bits = map(int, b.split("-"))
                    lo, hi = spans.get(b, (None, None))
                    single = lo if lo is not None and lo == hi and depth <= FIRST_BITS else None
                    deepest = FIRST_BITS + 30 if len(self.hashed) == 2 else FIRST_BITS
                    if depth >= deepest or (single is not None and len(self.hashed) == 1):
                        settled.add(b)
                        chosen.discard(b)
                        continue
                    m.directory = [x for x in m.directory if x != (depth, bits)] + self._children(depth, bits, single)
                if not chosen:
                    continue
                df = self._merged(taken())
            m.seq += 1
            old = {p.path for p in taken()}
            m.parts = [p for p in m.parts if p.path not in old] + self._write(df, "rows", m)

    def _heavy(self, parts: list[Part], rows: list[Part]) -> list[Part]:
        """The files of a bucket to merge into one, if any; ``rows`` are those with rows, oldest first."""
        if self.source is not None:     # the first rows file is a delta too, and tombstones of the source must stay
            return []
        if self.sums is not None:
            for i, p in enumerate(rows):
                if sum(x.size for x in rows[i + 1:]) > self.share * p.size:
                    return rows[i:]
            return []
        base = rows[0].size if rows else 0
        deltas = [p for p in parts if not rows or p is not rows[0]]
        heavy = deltas and (sum(p.size for p in deltas) > self.share * base or len(deltas) > self.max_deltas)
        return parts if heavy else []

    # ------------------------------------------------------------------ reading

    def _gone(self, parts: list[Part]) -> DataFrame:
        named = self.spark.read.schema(self._key_schema()).parquet(*[p.path for p in parts])
        seq = F.regexp_extract(F.col("_metadata.file_path"), _SEQ, 1).cast("long").alias("_gone_seq")
        return named.select(*[F.col(k).alias(f"_gone_{k}") for k in self.keys], seq)

    def _key_schema(self):
        from pyspark.sql.types import StructType
        return StructType([f for f in self.schema.fields if f.name in self.keys])

    def _without(self, rows: DataFrame, gone: DataFrame, seq: Column) -> DataFrame:
        match = seq < F.col("_gone_seq")
        for k in self.keys:
            match = match & F.col(k).eqNullSafe(F.col(f"_gone_{k}"))
        return rows.join(gone, match, "left_anti")

    def _merged(self, parts: list[Part]) -> DataFrame:
        """The rows of some buckets: files under later tombstones are matched with them, others are read plainly."""
        last_gone: dict[str, int] = {}
        for p in parts:
            if p.kind == "gone":
                last_gone[p.bucket] = max(p.seq, last_gone.get(p.bucket, -1))
        rows = [p for p in parts if p.kind == "rows"]
        if self.sums is not None:
            return self._added_up(rows)
        under = [p for p in rows if last_gone.get(p.bucket, -1) > p.seq]
        plain = [p.path for p in rows if last_gone.get(p.bucket, -1) <= p.seq]
        load = lambda paths: self.spark.read.schema(self.schema).parquet(*paths)
        out = load(plain) if plain else self.spark.createDataFrame([], self.schema)
        if under:
            touched = {p.bucket for p in under}
            gone = self._gone([p for p in parts if p.kind == "gone" and p.bucket in touched])
            old = load([p.path for p in under]).withColumn(
                "_seq", F.regexp_extract(F.col("_metadata.file_path"), _SEQ, 1).cast("long"))
            out = out.unionByName(self._without(old, gone, F.col("_seq")).drop("_seq"))
        return out

    def _added_up(self, rows: list[Part]) -> DataFrame:
        """The sums of the rows; a bucket's only file has one row a key."""
        files = Counter(p.bucket for p in rows)
        single, several = ([p.path for p in rows if (files[p.bucket] == 1) == one] for one in (True, False))
        load = lambda paths: (self.spark.read.schema(self.schema).parquet(*paths) if paths
                              else self.spark.createDataFrame([], self.schema))
        if not several:
            return load(single)
        total = F.sum(self.sums).cast(self.schema[self.sums].dataType).alias(self.sums)
        out = load(several).groupBy(*self.keys).agg(total).where(F.col(self.sums) != 0).select(*self.schema.names)
        return load(single).unionByName(out) if single else out

    def _buckets_of(self, directory: list[tuple[int, int]], asked: DataFrame) -> set[str]:
        """The names of the buckets that can hold the asked keys: at most one a bucket. With the first hashed
        column alone, a bucket split on the second one's bits is known by its first ``FIRST_BITS``."""
        if len(directory) == 1:
            return {f"{d}-{b}" for d, b in directory}
        if set(self.hashed) <= set(asked.columns):
            return {r["b"] for r in asked.select(self.bucket(directory).alias("b")).distinct().collect()}
        mask = (1 << FIRST_BITS) - 1
        cut = sorted({(min(d, FIRST_BITS), b & mask) for d, b in directory})
        first = DeltaTable(self.spark, self.root, self.keys, self.hashed[:1], self.schema).bucket(cut)
        found = {r["b"] for r in asked.select(first.alias("b")).distinct().collect()}
        return {f"{d}-{b}" for d, b in directory if f"{min(d, FIRST_BITS)}-{b & mask}" in found}

    def read(self, version: int, only: DataFrame | None = None) -> DataFrame:
        """The rows of a version; with ``only``, a table of values of keys (the first hashed one among them), the
        rows that have them, from their buckets alone. Null equals null."""
        m = self.manifest(version)
        parts = m.parts
        if only is not None:
            on = [k for k in self.keys if k in only.columns]
            asked = only.select(*on).distinct()
            found = self._buckets_of(m.directory, asked)
            parts = [p for p in parts if p.bucket in found]
        out = self._merged(parts)
        if self.source is not None:
            gone = [p for p in m.parts if p.kind == "gone"]
            base = self.source.select(*[f.name for f in self.schema.fields])
            base = self._without(base, self._gone(gone), F.lit(0)) if gone else base
            out = base.unionByName(out) if m.parts else base
        if only is None:
            return out
        asked = asked.select(*[F.col(k).alias(f"_asked_{k}") for k in on])
        match = F.lit(True)
        for k in on:
            match = match & F.col(k).eqNullSafe(F.col(f"_asked_{k}"))
        return out.join(asked, match, "left_semi")

    def drop_before(self, version: int) -> None:
        """Forget versions lower than ``version`` and delete the files that no other manifest names."""
        keep = [v for v in self.versions() if v >= version]
        needed = {p.path for v in keep for p in self.manifest(v).parts}
        for v in self.versions():
            if v < version:
                fs, path = filesystem(self.spark, self._manifest_path(v))
                fs.delete(path, False)
        fs, data = filesystem(self.spark, f"{self.root}/data")
        for commit in fs.listStatus(data) if fs.exists(data) else []:
            inside = [s.getPath() for s in fs.listStatus(commit.getPath()) if s.getPath().getName().startswith("bucket=")]
            named = {p.split("/data/")[1] for p in needed}
            free = [p for p in inside if f"{commit.getPath().getName()}/{p.getName()}" not in named]
            if len(free) == len(inside):
                fs.delete(commit.getPath(), True)
            else:
                for p in free:
                    fs.delete(p, True)
