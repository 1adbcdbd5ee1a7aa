import gzip
import hashlib
import io
from base64 import b32encode
from collections import Counter, defaultdict

import pytest

from revlens.llm import warc

PAGES = [
    (1, "http://a/ b\n", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://c", None), (4, "http://d", ""), (5, "u", "ü" * 100_000),
    (7, "u", "same"), (7, "v", "same"), (6, "w", "same"), (None, "x", "same"), (None, "y", "lone"), (8, "http://é", "a\r\n\r\nb"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, sha string, n int")


def brute(rows):
    groups = defaultdict(list)
    for page_id, _, html in rows:
        groups[(html or "").encode()].append(page_id)
    out = Counter()
    for data, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        digest = b32encode(hashlib.sha1(data).digest()).decode()
        for k, i in enumerate(sorted(ids, key=lambda i: i != best)):
            out[i, len(data), digest, "response" if k == 0 else "revisit", None if k == 0 else best] += 1
    return out


def test_round_trip(spark, tmp_path):
    folder = str(tmp_path / "archives")
    read = warc.round_trip(spark, frame(spark, PAGES).repartition(3), folder).collect()
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in read)
    assert got == brute(PAGES)
    payloads = {bytes(r["payload"]).decode() for r in read if r["record_type"] == "response"}
    assert payloads == {h or "" for _, _, h in PAGES}
    files = list((tmp_path / "archives").glob("*.warc.gz"))
    assert files
    for f in files:  # any gzip reader sees all records
        assert gzip.decompress(f.read_bytes()).count(b"WARC/1.1\r\n") > 0


def test_small_archives_and_hot_payload(spark, tmp_path):
    rows = [(k, f"u{k}", "hot" if k % 3 else f"page {k}" * 50) for k in range(300)]
    folder = str(tmp_path)
    manifest = warc.write_archives(warc.classified(frame(spark, rows)), folder, archive_bytes=5000)
    manifest.write.parquet(str(tmp_path / "manifest"))
    manifest = spark.read.parquet(str(tmp_path / "manifest"))
    assert manifest.count() > 5
    read = warc.read_archives(spark, manifest, folder, keep_payload=False).collect()
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in read)
    assert got == brute(rows)


def test_empty(spark, tmp_path):
    assert warc.round_trip(spark, frame(spark, []), str(tmp_path)).collect() == []


def test_reader_across_blocks_and_damage(monkeypatch):
    members = [warc.record(k, "u", bytes([65 + k]) * (50 + k), None, True) for k in range(20)]
    for block in (1, 7, 100_000):
        monkeypatch.setattr(warc, "BLOCK", block)
        rows = [warc.parse(m) for m in warc.read_members(io.BytesIO(b"".join(members)))]
        assert [r["payload_bytes"] for r in rows] == [50 + k for k in range(20)]
    with pytest.raises(warc.WarcError):
        list(warc.read_members(io.BytesIO(members[0][:-5])))
    with pytest.raises(warc.WarcError):
        list(warc.read_members(io.BytesIO(b"not gzip at all")))
    whole = next(warc.read_members(io.BytesIO(members[0])))
    for damaged in (whole.replace(b"AAAA", b"AAAB", 1), whole[:-1], whole + b"x", b"HTTP" + whole):
        with pytest.raises(warc.WarcError):
            warc.parse(damaged)


def test_revisits_refer_to_records_of_the_archives(spark, tmp_path):
    read = warc.round_trip(spark, frame(spark, PAGES).repartition(3), str(tmp_path)).collect()
    ids = [r["record_id"] for r in read]
    assert len(ids) == len(set(ids)) == len(PAGES)
    responses = {r["record_id"]: r["payload_digest"] for r in read if r["record_type"] == "response"}
    revisits = [r for r in read if r["record_type"] == "revisit"]
    assert revisits and all(responses[r["refers_to_record"]] == r["payload_digest"] for r in revisits)


def member(fields, block):
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n")


def test_foreign_records(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nServer: x\xff\r\n\r\nbody"
    sha1 = b32encode(hashlib.sha1(b"body").digest()).decode()
    records = [
        member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:uuid:1>")], b"software: x\r\n"),
        member([("WARC-Type", "request")], b"GET / HTTP/1.1\r\n\r\n"),
        member([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:2>"), ("WARC-Target-URI", "http://x")], http),
        member([("warc-type", "response"), ("WARC-Payload-Digest", f"SHA1:{sha1.lower()}"), ("WARC-Block-Digest", "md5:abc")], http),
        member([("WARC-Type", "revisit"), ("WARC-Refers-To", "<urn:uuid:2>")], b""),
    ]
    (tmp_path / "foreign.warc.gz").write_bytes(b"".join(records))
    manifest = spark.createDataFrame([("foreign.warc.gz", None, None)], "file string, records long, bytes long")
    rows = warc.read_archives(spark, manifest, str(tmp_path)).collect()
    assert [(r["record_type"], r["payload_bytes"], r["page_id"], r["refers_to_record"]) for r in rows] == [
        ("response", 4, None, None), ("response", 4, None, None), ("revisit", None, None, "<urn:uuid:2>"),
    ]
    assert rows[0]["payload_digest"] == sha1 and bytes(rows[1]["payload"]) == b"body"
    damaged = gzip.decompress(records[3]).replace(b"body", b"bodx")
    for bad in (damaged, gzip.decompress(records[2]).replace(b"Content-Length", b"Content-Size")):
        with pytest.raises(warc.WarcError):
            warc.parse(bad)
