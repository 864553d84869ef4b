"""Request parsing (malformed rows kept aside) and the change log (batch order does not matter)."""

from pyspark.sql import functions as F

from trolley.streaming import changes as CH
from trolley.streaming import requests as RQ

LINES = [
    '{"PurchaseDeletion": {"user_id": 7, "item_id": 12}}',
    '{"Recommendations": {"user_id": 7}}',
    '{"ModelState": {"user_id": 3, "scenario": "Alcohol"}}',
    '{"ModelState": {"user_id": 3, "scenario": "Sugar"}}',
    '{"PurchaseDeletion": {"user_id": 7}}',
    '{"Purchases": {"user_id": 1}, "Recommendations": {"user_id": 1}}',
    'not json at all',
    '{}',
]


def test_parse_requests(spark):
    df = spark.createDataFrame([(x,) for x in LINES], "value string")
    rows = {r["raw"]: r for r in RQ.parse_requests(df).collect()}
    assert rows[LINES[0]]["kind"] == "PurchaseDeletion" and rows[LINES[0]]["item_id"] == 12
    assert rows[LINES[1]]["kind"] == "Recommendations"
    assert rows[LINES[2]]["kind"] == "ModelState" and rows[LINES[2]]["scenario"] == "Alcohol"
    assert rows[LINES[3]]["error"] == "unknown scenario"
    assert rows[LINES[4]]["error"] == "missing item_id"
    assert rows[LINES[5]]["error"] == "several request tags"
    assert rows[LINES[6]]["error"] == "not a request"
    assert rows[LINES[7]]["error"] == "not a request"
    dels = [tuple(r) for r in RQ.deletion_requests(RQ.parse_requests(df)).collect()]
    assert dels == [(7, 12)]


def test_request_json_roundtrip(spark):
    d = spark.createDataFrame([(1, 2), (3, 4)], "user_id long, item_id long")
    back = RQ.deletion_requests(RQ.parse_requests(RQ.to_request_json(d)))
    assert sorted(tuple(r) for r in back.collect()) == [(1, 2), (3, 4)]


def changes(spark, rows):
    return spark.createDataFrame(rows, "op int, basket_id long, user_id long, item_id long")


def test_change_log_order_insensitive(spark):
    ins = changes(spark, [(1, 10, 1, 5), (1, 10, 1, 5), (1, 11, 1, 6), (1, 12, 2, 5)])
    rem = changes(spark, [(-1, 10, 1, 5), (-1, 10, 1, 5), (-1, 12, 2, 5)])
    results = []
    for order in ([ins, rem], [rem, ins]):
        root = CH.run_folder(spark, "test-changes")
        glob = CH.write_change_files([c.coalesce(1) for c in order], f"{root}/in")
        v = CH.run_change_log(spark, glob, root, max_files=1)
        assert v == 2
        table = CH.lines_at(spark, root, v)
        results.append(sorted(tuple(r) for r in CH.live_interactions(table).collect()))
    assert results[0] == results[1] == [(1, 6)]


def test_apply_changes_keeps_negative_counts(spark):
    first = CH.apply_changes(None, changes(spark, [(-1, 1, 1, 1)]))
    assert [r["mult"] for r in first.collect()] == [-1]
    second = CH.apply_changes(first, changes(spark, [(1, 1, 1, 1)]))
    assert second.count() == 0


def test_restart_finds_its_version_and_old_ones_go(spark):
    root = CH.run_folder(spark, "test-restart")
    for i in range(3):
        changes(spark, [(1, 10 + i, 1, 5 + i)]).coalesce(1).write.json(f"{root}/in/part={i:05d}")
        v = CH.run_change_log(spark, f"{root}/in/part=*/*.json", root, max_files=1)
        assert v == i + 1
    assert CH.run_change_log(spark, f"{root}/in/part=*/*.json", root, max_files=1) == 3   # no new file
    assert CH.lines_at(spark, root, 3).count() == 3
    assert CH.line_table(spark, root).versions() == [2, 3]


def test_a_batch_writes_in_proportion_to_its_lines(spark):
    from collections import Counter
    root = CH.run_folder(spark, "test-proportion")
    table = CH.start(CH.line_table(spark, root, bucket_bytes=40_000))
    # a third of the log is one user's; its buckets go on by basket
    big = [(1, u, u % 5000 if u % 3 else 7, u % 11) for u in range(30_000)]
    want = Counter()
    written = []
    for i, rows in enumerate([big, [(1, 100, 7, 6)], [(-1, 6, 7, 6), (-1, 100, 7, 6), (1, 1, 1, 1)], [(-1, 3, 9, 9)]]):
        written.append(CH.step_lines(table, changes(spark, rows), i))
        for op, *key in rows:
            want[tuple(key)] += op
        if i:
            m = table.manifest(i + 1)
            assert len(m.directory) > 8 and max(d for d, _ in m.directory) > 32
            assert max(p.size for p in m.parts) < 100_000
    got = {(r["basket_id"], r["user_id"], r["item_id"]): r["mult"] for r in table.read(4).collect()}
    assert got == {k: n for k, n in want.items() if n} and got[(3, 9, 9)] == -1
    assert max(written[1:]) * 10 < written[0]


def test_null_ids_are_keys_like_others(spark):
    root = CH.run_folder(spark, "test-null-lines")
    table = CH.start(CH.line_table(spark, root))
    for i in range(2):
        CH.step_lines(table, changes(spark, [(1, None, 1, 5), (1, 2, None, None)]), i)
    assert sorted(map(tuple, table.read(2).collect()), key=str) == [(2, None, None, 2), (None, 1, 5, 2)]


def test_a_failing_read_is_not_an_absent_version(spark):
    import pytest

    from trolley.sources.store import version_exists
    root = CH.run_folder(spark, "test-missing")
    assert CH.start(CH.line_table(spark, root)).read(0).count() == 0
    with pytest.raises(Exception):
        CH.lines_at(spark, root, 3)      # a later batch never starts from nothing
    with pytest.raises(Exception):
        version_exists(spark, "nosuchstore://x", "lines", 0)


def test_keyed_stream_emits_the_change_alone(spark):
    from trolley.streaming.keyed import count_table, factor_table, keyed_embedding_stream, vectors_at
    root = CH.run_folder(spark, "test-lazy")
    long_vector = [(1, 1, 1, i) for i in range(3000)]
    glob = CH.write_change_files([c.coalesce(1) for c in (
        changes(spark, long_vector + [(1, 5, 2, 5)]),
        changes(spark, [(1, 2, 1, 0), (1, 2, 1, 1)]),           # a second basket: every weight of user 1 moves
        changes(spark, [(-1, 5, 2, 5), (1, None, 2, 1)]))], f"{root}/in")
    assert keyed_embedding_stream(spark, glob, root, max_files=1, share=10.0) == 3
    m = count_table(spark, root).manifest(3)
    new = [p.path for p in m.parts if p.kind == "rows" and p.seq > m.parts[0].seq]
    assert spark.read.parquet(*new).count() == 2                # of 3000
    got = {(r["user_id"], r["item_id"]): r["weight"] for r in vectors_at(spark, root, 3).collect()}
    f = factor_table(spark, root).read(3).collect()
    assert [r["user_id"] for r in f] == [1] and set(got) == {(1, i) for i in range(3000)}
    assert got[(1, 0)] == 2 * f[0]["factor"] and got[(1, 2999)] == f[0]["factor"]


def test_keyed_state_embeddings_match_batch(spark):
    from tests.conftest import SF_SMALL
    from trolley.operators import embeddings as EM
    from trolley.operators import unlearn as U
    from trolley.sources.purchases import lines, load_purchases
    from trolley.streaming import maintain as MT
    from trolley.streaming.keyed import keyed_embedding_stream, vectors_at
    p = load_purchases(spark, SF_SMALL)
    dels = U.most_bought_item_deletions(p).withColumnRenamed("item_id", "product_id")
    removed = lines(p).join(dels, ["user_id", "product_id"], "left_semi")
    root = CH.run_folder(spark, "test-keyed")
    glob = CH.write_change_files([MT.line_changes(lines(p), 1).repartition(2),
                                  MT.line_changes(removed, -1).coalesce(1)], f"{root}/in")
    v = keyed_embedding_stream(spark, glob, root, max_files=1)
    got = vectors_at(spark, root, v)
    p_new = U.apply_deletions(p, U.most_bought_item_deletions(p))
    want = EM.embeddings(p_new)
    cols = ["user_id", "item_id", F.round("weight", 9).alias("w")]
    assert got.select(*cols).exceptAll(want.select(*cols)).count() == 0
    assert want.select(*cols).exceptAll(got.select(*cols)).count() == 0


def test_maintain_stream_writes_impact(spark):
    from tests.conftest import SF_SMALL
    from trolley.operators import unlearn as U
    from trolley.plans.state import build_state
    from trolley.sources.purchases import load_purchases
    from trolley.sources.store import read_version
    from trolley.streaming import maintain as MT
    p = load_purchases(spark, SF_SMALL)
    root = CH.run_folder(spark, "test-maintain")
    RQ.to_request_json(U.latest_line(p)).coalesce(1).write.text(f"{root}/in")
    v = MT.maintain_stream(spark, build_state(p, k=10), f"{root}/in/*.txt", root)
    assert v == 1
    impact = read_version(spark, root, "impact", v).collect()
    assert len(impact) == 1 and len(impact[0]["basket_ids"]) >= 1
    assert impact[0]["num_recommendation_changes"] > 0 and impact[0]["topk_index_update_ms"] > 0
    metrics = read_version(spark, root, "metrics", v).first()
    assert metrics["num_accepted"] == 1 and metrics["num_malformed"] == 0


def test_answer_requests(spark):
    from tests.conftest import SF_SMALL
    from trolley.plans.state import build_state
    from trolley.sources.purchases import load_purchases
    p = load_purchases(spark, SF_SMALL)
    st = build_state(p, k=5)
    lines = ['{"Purchases": {"user_id": 1}}', '{"Recommendations": {"user_id": 1}}',
             '{"ModelState": {"user_id": 1, "scenario": "Alcohol"}}', 'oops']
    parsed = RQ.parse_requests(spark.createDataFrame([(x,) for x in lines], "value string"))
    out = RQ.answer_requests(st, parsed)
    assert out["purchases"].where("user_id = 1").count() == out["purchases"].count() > 0
    assert 0 < out["recommendations"].count() <= 20
    assert out["embeddings"].count() > 0 and out["rejected"].count() == 1
    assert out["ego_vertices"].where("ego_id = 1 AND user_id = 1").count() == 1
    assert set(r["scenario"] for r in out["ego_sensitive"].collect()) == {"alcohol"}
