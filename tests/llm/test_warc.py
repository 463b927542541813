import gzip
import hashlib
import os

import pytest

from filmcrate.llm import common, warc

SHAPE = "page_id long, url string, html string, digest int, origin string"


def rows():
    big = "é\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n\n" * 50
    yield from [(1, "http://a", "x" * 99), (2, "http://b", "x" * 99), (3, None, None), (4, "u\r\nv", ""), (5, "", "y" * 100), (6, "", "y" * 100)]
    yield from [(7, "", big), (9, "", big), (8, "", big), (10, "", "\r\n"), (11, "", "z" * 4097), (None, "", "q" * 300), (12, "", "q" * 300), (5, "", "y" * 100)]


@pytest.mark.parametrize("chunk", [7, 1000, 1 << 20])
def test_round_trip(spark, chunk):
    data = list(rows())
    df = spark.createDataFrame([(*r, 1, "") for r in data], SHAPE).repartition(3)
    path = common.scratch(spark, "warc")
    warc.write_archives(df, path, chunk)
    chunks = warc.read_archives(spark, path).collect()
    assert all(len(c["chunk"]) <= chunk for c in chunks)
    payload, html = {}, {}
    for c in sorted(chunks, key=lambda c: (c["page_id"] or 0, c["chunk_no"])):
        if c["record_type"] == "response" and c["page_id"] != 5:
            payload[c["page_id"]] = payload.get(c["page_id"], b"") + c["chunk"]
            assert c["payload_digest"] == hashlib.sha256(payload[c["page_id"]]).hexdigest()
    got = sorted((c["page_id"] or 0, c["payload_bytes"], c["payload_digest"], c["record_type"], c["refers_to"]) for c in chunks if c["last"])
    want = []
    for page, _, h in data:
        raw = (h or "").encode()
        same = [p for p, _, x in data if (x or "").encode() == raw and p is not None]
        first = min(same) if len(raw) >= 100 and same else page
        again = page is not None and page != first
        html[page] = raw
        want.append((page or 0, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want)
    assert all(v == html[k] for k, v in payload.items())


def test_archive_is_well_formed(spark):
    path = common.scratch(spark, "warc")
    warc.write_archives(spark.createDataFrame([(1, "http://a/", "hello", 1, "")], SHAPE).coalesce(1), path)
    (name,) = [f for f in os.listdir(path) if f.endswith(".gz")]
    raw = gzip.open(f"{path}/{name}").read()
    head, _, body = raw.partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and b"\r\nContent-Length: 5" in head
    assert body == b"hello\r\n\r\n"


def test_damage_is_seen_and_empty_table(spark):
    path = common.scratch(spark, "warc")
    warc.write_archives(spark.createDataFrame([], SHAPE), path)
    assert warc.read_archives(spark, path).count() == 0
    reader = warc.Reader()
    for line in b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:1>\r\nWARC-Payload-Digest: sha256:00\r\nX-Payload-Length: 1\r\nContent-Length: 1\r\n\r".split(b"\n"):
        assert reader.take(line) is None
    with pytest.raises(ValueError):
        reader.take(b"x\r")
