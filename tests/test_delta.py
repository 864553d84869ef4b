"""Delta tables against a plain model: rows in memory, changed by the same commits."""

import os
import random

import pytest

from trolley.sources.delta import FIRST_BITS, DeltaTable
from trolley.streaming.changes import run_folder

SCHEMA = "user_id long, item_id long, x long"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(sorted(rows), schema)


def table(spark, source=None, **settings):
    schema = frame(spark, []).schema
    return DeltaTable(spark, run_folder(spark, "test-delta"), ("user_id", "item_id"), ("user_id", "item_id"), schema,
                      source=source, **settings)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("over_source", [False, True])
def test_commits_equal_a_plain_table(spark, over_source):
    rng = random.Random(3)
    want = {(u, i): (u, i, 0) for u in range(30) for i in range(8)}
    base = frame(spark, want.values())
    t = table(spark, base if over_source else None, bucket_bytes=1500, max_deltas=3)
    if not over_source:
        t.create(base)
    kept = {0: sorted(want.values())}
    for v in range(1, 6):
        gone = rng.sample(sorted(want), 6)
        new = [(u, i, v) for u, i in rng.sample(gone, 3)] + [(100 + v, v, v)]
        for k in gone:
            del want[k]
        want |= {r[:2]: r for r in new}
        t.commit(v, gone=frame(spark, gone, "user_id long, item_id long"), rows=frame(spark, new))
        kept[v] = sorted(want.values())
    for v, rows in kept.items():        # older versions stay readable
        assert rows_of(t.read(v)) == rows
    only = spark.createDataFrame([(3,), (105,), (999,)], "user_id long")
    assert rows_of(t.read(5, only=only)) == [r for r in kept[5] if r[0] in (3, 105)]
    if over_source:
        return
    m = t.manifest(5)
    assert len(m.directory) > 1 and sum(2.0 ** -d for d, _ in m.directory) == 1     # split, and the buckets cover all hashes
    t.drop_before(5)
    assert t.versions() == [5] and rows_of(t.read(5)) == kept[5]
    held = {os.path.join(a, d).split("/data/")[1] for a, ds, _ in os.walk(t.root.removeprefix("file:") + "/data") for d in ds if d.startswith("bucket=")}
    assert held == {p.path.split("/data/")[1] for p in t.manifest(5).parts}


def test_a_replayed_version_replaces_itself(spark):
    t = table(spark)
    t.create(frame(spark, [(1, 1, 0), (2, 2, 0)]))
    gone = frame(spark, [(1, 1)], "user_id long, item_id long")
    for _ in range(2):
        t.commit(1, gone=gone, rows=frame(spark, [(3, 3, 1)]))
    assert rows_of(t.read(1)) == [(2, 2, 0), (3, 3, 1)]
    t.commit(2, rows=frame(spark, [(1, 1, 2)]))         # a key may come back
    assert rows_of(t.read(2)) == [(1, 1, 2), (2, 2, 0), (3, 3, 1)]
    t.commit(3, gone=frame(spark, [], "user_id long, item_id long"))
    assert rows_of(t.read(3)) == rows_of(t.read(2))


def test_a_key_with_a_third_of_all_rows_is_spread(spark):
    rows = [(7, i, i) for i in range(4000)] + [(u, u, u) for u in range(100, 8100)]
    t = table(spark, bucket_bytes=12_000)
    t.create(frame(spark, rows))
    m = t.manifest(0)
    assert rows_of(t.read(0)) == sorted(rows)
    assert sum(2.0 ** -d for d, _ in m.directory) == 1 and max(d for d, _ in m.directory) > FIRST_BITS
    assert max(p.size for p in m.parts) <= 12_000
    t.commit(1, gone=frame(spark, [(7, 5), (100, 100)], "user_id long, item_id long"), rows=frame(spark, [(7, 9000, 1)]))
    assert rows_of(t.read(1)) == sorted({*rows, (7, 9000, 1)} - {(7, 5, 5), (100, 100, 100)})
    assert t.manifest(1).written < 40_000      # the touched buckets only, at most


def test_a_null_key_and_no_rows(spark):
    t = table(spark)
    t.create(frame(spark, []))
    assert rows_of(t.read(0)) == []
    t.commit(1, rows=spark.createDataFrame([(None, 1, 1), (2, None, 2)], SCHEMA))
    assert t.read(1).count() == 2


def test_amounts_add_up_without_reading_the_table(spark, monkeypatch):
    """A commit of signed amounts reads no row of the table, and a row is rewritten a few times, not once a commit."""
    from collections import Counter

    from pyspark.sql import types as T

    from trolley.sources.delta import DeltaTable
    from trolley.streaming.changes import run_folder
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("n", T.LongType())])
    t = DeltaTable(spark, run_folder(spark, "test-sums"), ("k",), ("k",), schema, sums="n")
    rows = lambda found: spark.createDataFrame(found, schema).coalesce(1)
    t.create(rows([]))
    monkeypatch.setattr(t, "read", lambda *a, **k: 1 / 0)
    want, written = Counter(), 0
    for v in range(1, 13):
        some = [(v * 1000 + i, 1) for i in range(1000)] + [(None, v), ((v - 1) * 1000, -1)]
        written += t.commit(v, rows=rows(some))
        for k, n in some:
            want[k] += n
    monkeypatch.undo()
    got = {r["k"]: r["n"] for r in t.read(12).collect()}
    assert got == {k: n for k, n in want.items() if n} and 1000 not in got and got[None] == 78
    sizes = [p.size for p in t.manifest(12).parts]
    assert len(sizes) <= 4 and written < 7 * sum(sizes)
    assert sorted(tuple(r) for r in t.read(12, only=rows([(3001, 0)]).select("k")).collect()) == [(3001, 1)]
    import pytest
    with pytest.raises(ValueError):
        t.commit(13, gone=rows([(1, 1)]))
