import base64
import glob
import hashlib
import zlib

from oracle import same

from lumenframe.llm import warc
from lumenframe.llm.common import fresh_path
from lumenframe.llm.registry import ORACLE_SQL, QUERIES


def test_matches_sql(spark):
    assert same(spark, QUERIES["op7_warc"], ORACLE_SQL["op7_warc"], "/root/testdata/sf0.01") > 0


def there_and_back(spark, rows, **more):
    path = fresh_path(spark, "warc-test")
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string")
    warc.write(df, path, **more)
    return warc.assemble(warc.read_records(spark, path)).collect()


def test_round_trip_and_edges(spark):
    tricky = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nb\r\n\r\n\n"
    rows = [(1, "http://a/é", tricky), (2, None, None), (0, "http://b\r\nX: y", ""), (3, "u", tricky), (3, "u", tricky), (None, "n", "only"), (None, "n", tricky), (9, "big", "ü" * 3_000_000)]
    found = there_and_back(spark, rows)
    assert len(found) == len(rows)
    assert sorted(((r.metadata.page_id, bytes(r.response.payload).decode()) for r in found), key=str) == sorted(((p, h or "") for p, _, h in rows), key=str)
    for r in found:
        body = bytes(r.response.payload)
        assert r.response.payload_bytes == len(body) and r.response.intact
        assert r.response.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert r.request is not None
    kinds = sorted(((r.metadata.page_id, r.type, r.refers_to) for r in found), key=str)
    assert kinds == sorted([(1, "response", None), (2, "revisit", 0), (0, "response", None), (3, "revisit", 1), (3, "revisit", 1), (None, "response", None), (None, "revisit", 1), (9, "response", None)], key=str)
    assert {r.metadata.page_id: r.target_uri for r in found if r.metadata.page_id in (0, 1, 2)} == {0: "http://b%0D%0AX: y", 1: "http://a/é", 2: None}


def test_small_payloads_stay_responses_and_ties(spark):
    found = there_and_back(spark, [(1, "u", "abc"), (2, "u", "abc"), (3, "u", "longer"), (4, "u", "longer"), (3, "u", "longer")], min_bytes=4)
    assert sorted((r.metadata.page_id, r.type) for r in found) == [(1, "response"), (2, "response"), (3, "response"), (3, "revisit"), (4, "revisit")]
    assert there_and_back(spark, []) == []


def test_many_repeated_payloads_take_the_other_way(spark, monkeypatch):
    rows = [(i, "u", "payload %d" % (i % 7)) for i in range(60)] + [(None, None, "payload 3")]
    one = sorted(map(str, there_and_back(spark, rows)))
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    assert sorted(map(str, there_and_back(spark, rows))) == one


def test_archives_are_bounded_and_records_can_be_read_by_offset(spark):
    path = fresh_path(spark, "warc-test")
    df = spark.createDataFrame([(i, "http://a/%d" % i, hashlib.sha256(b"%d" % i).hexdigest() * 9) for i in range(80)], "page_id long, url string, html string")
    warc.write(df.coalesce(2), path, archive_bytes=2000)
    files = glob.glob(path.removeprefix("file://") + "/part-*")
    assert len(files) > 10
    members = 0
    for f in files:
        data = open(f, "rb").read()
        assert len(data) < 2000 + 1500
        while data.strip(b"\0"):
            one = zlib.decompressobj(31)
            record = one.decompress(data) + one.flush()
            assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
            data, members = one.unused_data, members + 1
    assert members == 240
    assert warc.read_records(spark, path).count() == 240
