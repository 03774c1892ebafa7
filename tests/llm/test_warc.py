import base64
import hashlib
import io

import zstandard
from pyspark.sql import functions as F

from tracewright.llm import common, warc

ROWS = [(3, "http://a/x y\n", "<p>one</p>"), (1, "http://b", "<p>one</p>"), (2, None, "<p>two</p>"), (5, "u", None), (4, "u", ""), (7, "é", "é\r\n\r\nWARC/1.1"), (None, "n", "<p>two</p>"), (9, "l", "x" * 900_000), (2, None, "<p>two</p>"), (10, "l", "x" * 900_000)]


def frame(spark, rows):
    return spark.createDataFrame([(a, b, c, "x") for a, b, c in rows], "page_id long, url string, html string, refers_to string")


def brute(rows):
    data = [(i, (h or "").encode()) for i, _, h in rows]
    least = {}
    for i, h in data:
        if i is not None:
            least[h] = min(least.get(h, i), i)
    out = []
    for i, h in data:
        revisit = sum(x == h for _, x in data) > 1 and h in least and i != least[h]
        out.append((i, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "revisit" if revisit else "response", least[h] if revisit else None))
    return sorted(out, key=str)


def test_digests_match_brute_force(spark):
    assert sorted(map(tuple, warc.digests(spark, frame(spark, ROWS)).collect()), key=str) == brute(ROWS)
    assert warc.digests(spark, frame(spark, [])).collect() == []


def test_many_repeated_payloads_are_joined_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", 0)
    monkeypatch.setattr(common, "HOT_SHARE", 0.3)
    monkeypatch.setattr(common, "SMALL", 0)
    rows = ROWS + [(100 + i, "h", "<p>hot</p>") for i in range(30)]
    assert sorted(map(tuple, warc.digests(spark, frame(spark, rows)).collect()), key=str) == brute(rows)


def test_reading_spreads_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(warc, "TASK_BYTES", 500)
    manifest = warc.write_bundles(frame(spark, [(i, "u", f"<p>{i * 7919}</p>" * 20) for i in range(200)]).repartition(1), frame_bytes=1000)
    read = warc.read_bundles(manifest, payloads=False)
    assert read.count() == 200 and read.groupBy(F.spark_partition_id()).count().count() >= 4


def test_round_trip_and_random_access(spark):
    manifest = warc.write_bundles(frame(spark, ROWS), frame_bytes=50).collect()
    assert len(manifest) == len(ROWS)
    for m in manifest:
        r = warc.read_record(m["file"], m["frame"], m["offset"], m["length"])
        assert r["record_id"] == m["record_id"]
        want = [(u, h or "") for i, u, h in ROWS if (None if i is None else str(i)) == m["record_id"]]
        assert (r["url"], r["payload"].decode() if r["payload"] is not None else want[0][1]) == want[0]


def test_small_payloads_are_not_revisits(spark):
    got = warc.read_bundles(warc.write_bundles(frame(spark, ROWS), least_bytes=100)).collect()
    assert {r["record_id"] for r in got if r["record_type"] == "revisit"} == {"10"}


def test_a_bundle_is_plain_zstandard_with_a_seek_table(tmp_path):
    w = warc.BundleWriter(f"file://{tmp_path}/b.warc.zst", 64)
    records = [warc.format_record(str(i), "u", b"p" * i, warc.digest(b"p" * i), None) for i in range(20)]
    for r in records:
        w.add(r)
    w.close()
    data = (tmp_path / "b.warc.zst").read_bytes()
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read() == b"".join(records)
    table = warc.read_seek_table(io.BytesIO(data), len(data))
    assert len(table) == 20 and sum(t[2] for t in table) == sum(map(len, records))
