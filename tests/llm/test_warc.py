import hashlib

import pytest

from trolley.llm import warc as W

LONG = "<p>" + "x" * 120 + "é</p>"
ROWS = [(5, "http://a.example/1", LONG), (3, "http://a.example/2", LONG), (9, None, LONG), (None, "http://n.example", LONG),
        (7, "http://s.example\r\nX-Evil: 1", "short"), (8, "u", "short"), (1, "u", None), (2, "u", ""), (3, "http://a.example/2", LONG),
        (11, "u", "y" * 100), (12, "u", "y" * 100), (13, "u", "z" * 99), (14, "u", "z" * 99)]


def archive(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as payload", "1 as short", "2 as header")
    root = W.new_archive(spark)
    W.write_archive(pages, root)
    return root


def test_round_trip(spark):
    root = archive(spark, ROWS)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload))
                  for r in W.read_archive(spark, root).collect()), key=repr)
    want = []
    for page, _, html in ROWS:
        raw = (html or "").encode()
        ids = [p for p, _, h in ROWS if (h or "").encode() == raw and p is not None]
        revisit = len(raw) >= 100 and page != min(ids)
        want.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response",
                     min(ids) if revisit else None, raw))
    assert got == sorted(want, key=repr)
    assert spark.read.parquet(f"{root}/payloads").count() == len({(h or "") for _, _, h in ROWS})


def test_records_are_warc(spark):
    for r in W.record_bytes(W.read_archive(spark, archive(spark, ROWS))).collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and b"X-Evil" not in fields and rest.endswith(b"\r\n\r\n")
        assert int(fields[b"Content-Length"]) == len(rest) - 4
        assert fields[b"WARC-Payload-Digest"] == b"sha256:" + r.payload_digest.encode()


def test_changed_payload_is_an_error(spark):
    root = archive(spark, ROWS[:2])
    spark.read.parquet(f"{root}/payloads").selectExpr("payload_digest", "cast('other' as binary) as payload").write.parquet(f"{root}/x/payloads")
    spark.read.parquet(f"{root}/headers").write.parquet(f"{root}/x/headers")
    with pytest.raises(Exception, match="payload missing or changed"):
        W.read_archive(spark, f"{root}/x").collect()


def test_empty(spark):
    assert W.read_archive(spark, archive(spark, [])).count() == 0
