import hashlib
import gzip
import io
import os

import pyarrow.parquet as pq
from pyspark.sql import types as T

from smeltery.llm import warc
from smeltery.llm.folders import scratch

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("record", T.StringType())])
ROWS = [
    (5, "http://a/", "same", "x"),
    (2, "http://b/\r\nInjected: 1", "same", None),
    (9, None, "", "y"),
    (7, "http://c/", None, "z"),
    (8, "http://d/", "Ünï \r\n\r\n WARC/1.1 \x00" + "long " * 200_000, ""),
    (11, "http://e/", "same", ""),
    (11, "http://e/", "same", ""),
    (12, "http://f/", "only", ""),
    (None, "http://g/", "without id", ""),
]


def want(rows):
    import base64

    out, first = [], {}
    bodies = [(i, (h or "").encode()) for i, _, h, _ in rows]
    for i, b in sorted((x for x in bodies if x[0] is not None)):
        first.setdefault(b, i)
    used = set()
    for i, b in bodies:
        head = first.get(b) == i and b not in used or b not in first
        if head:
            used.add(b)
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if head else "revisit", None if head else first[b]))
    return sorted(out, key=str)


def test_pages_come_back(spark):
    folder = scratch(spark, "warc-test")
    archives = warc.archive_pages(spark.createDataFrame(ROWS, PAGES).repartition(2), folder)
    got = warc.page_records(archives, f"{folder}/archives/warc").collect()
    assert sorted(((r.record_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == want(ROWS)
    # every member opens alone and the whole file reads in order as well
    root = f"{folder}/archives/warc".removeprefix("file:")
    for row in archives.collect():
        with open(os.path.join(root, row.archive), "rb") as f:
            raw = f.read()
        index = pq.read_table(os.path.join(root, row.sidecar)).to_pylist()
        assert sum(r["length"] for r in index) == len(raw)
        assert [r.id for r in warc.stream_records(io.BytesIO(raw))] == [r["record_id"] for r in index]
        for r in index:
            assert gzip.decompress(raw[r["offset"] : r["offset"] + r["length"]]).startswith(b"WARC/1.1\r\n")
            assert b"\r\nInjected" not in gzip.decompress(raw[r["offset"] : r["offset"] + r["length"]])
    assert not os.path.exists(f"{folder}/whole".removeprefix("file:"))


def test_small_payloads_stay_responses(spark):
    folder = scratch(spark, "warc-test")
    archives = warc.archive_pages(spark.createDataFrame(ROWS, PAGES), folder, least_bytes=5)
    got = warc.page_records(archives, f"{folder}/archives/warc").collect()
    assert {r.record_type for r in got} == {"response"}


def test_no_pages(spark):
    folder = scratch(spark, "warc-test")
    archives = warc.archive_pages(spark.createDataFrame([], PAGES), folder)
    assert warc.page_records(archives, f"{folder}/archives/warc").collect() == []


def test_files_roll_over(spark):
    folder = scratch(spark, "warc-test")
    rows = warc.write_archives(spark.createDataFrame(ROWS, PAGES).coalesce(1), folder, file_records=2).collect()
    assert len({r.file for r in rows}) == 5
    assert sum(len(r.records) for r in rows) == len(ROWS)


def foreign(*records, end=b"\r\n\r\n"):
    return b"".join(b"WARC/1.0\r\n" + b"\r\n".join(lines) + b"\r\nContent-Length: %d\r\n\r\n" % len(block) + block + end for lines, block in records)


HTTP = b"HTTP/1.1 200 OK\r\nX: 1\r\n\r\n"
RECORDS = [
    ([b"WARC-Type: warcinfo", b"WARC-Record-ID: <urn:uuid:0>", b"WARC-Date: 2011-02-03T04:05:06Z", b"Content-Type: application/warc-fields"], b"software: x\r\n\r\n"),
    ([b"WARC-Type: request", b"WARC-Record-ID: <urn:uuid:1>", b"Content-Type: application/http; msgtype=request"], b"GET / HTTP/1.1\r\n\r\n"),
    ([b"warc-type: response", b"X-Odd:  kept \xff ", b"WARC-Record-ID: <urn:uuid:2>", b"Content-Type: application/http; msgtype=response"], HTTP + b"payload"),
    ([b"WARC-Type: response", b"WARC-Record-ID: <urn:uuid:3>", b"WARC-Payload-Digest: sha1:" + hashlib.sha1(b"payload").hexdigest().encode(), b"WARC-Block-Digest: sha1:X", b"Content-Type: application/http"], HTTP + b"payload"),
    ([b"WARC-Type: revisit", b"WARC-Record-ID: <urn:uuid:4>", b"WARC-Refers-To: <urn:uuid:2>", b"WARC-Payload-Digest: sha1:" + b"A" * 32], b""),
    ([b"WARC-Type: resource", b"WARC-Record-ID: <urn:uuid:5>", b"WARC-Payload-Digest: sha1:" + b"B" * 32], b"\r\n\r\nstarts with lines"),
    ([b"WARC-Type: response", b"WARC-Record-ID: <urn:uuid:6>", b"WARC-Payload-Digest: md5:00"], b"payload"),
]


def test_foreign_archives_keep_their_records(spark, tmp_path):
    source, target = tmp_path / "in", scratch(spark, "warc-test")
    source.mkdir()
    plain = foreign(*RECORDS)
    (source / "a.warc.gz").write_bytes(gzip.compress(plain))
    (source / "b.warc.gz").write_bytes(gzip.compress(foreign(*RECORDS[5:6], end=b"\r\n\r\n\r\n\r\n")) + gzip.compress(foreign(RECORDS[0])))
    (source / "broken.warc.gz").write_bytes(gzip.compress(plain)[:-30])
    (source / "odd.warc.gz").write_bytes(b"no gzip at all")
    done = warc.normalise_folder(spark, str(source), target, find_repeats=False)
    rows = {r.archive.split("-")[0]: r for r in done.collect()}
    root = f"{target}/warc".removeprefix("file:")

    def raw(name):
        with open(os.path.join(root, rows[name].archive), "rb") as f:
            return f.read()

    assert gzip.decompress(raw("a")) == plain and rows["a"].error is None
    assert gzip.decompress(raw("b")) == foreign(RECORDS[5], RECORDS[0])
    assert rows["broken"].error and plain.startswith(gzip.decompress(raw("broken"))) and rows["odd"].error and rows["odd"].records == 0
    index = pq.read_table(os.path.join(root, rows["a"].sidecar)).to_pylist()
    assert [r["type"] for r in index] == ["warcinfo", "request", "response", "response", "revisit", "resource", "response"]
    sha1 = warc.sha1_base32(b"payload")
    assert [r["payload_sha1"] for r in index] == [None, None, sha1, sha1, None, warc.sha1_base32(RECORDS[5][1]), sha1]
    got = {r.record_id: r for r in warc.read_records(done.where("archive LIKE 'a-%'"), f"{target}/warc").collect()}
    assert [got[f"urn:uuid:{i}"].intact for i in range(7)] == [None, None, None, True, None, False, None]
    assert [got[f"urn:uuid:{i}"].payload_bytes for i in range(7)] == [None, None, 7, 7, None, len(RECORDS[5][1]), 7]
    assert (got["urn:uuid:4"].refers_to, got["urn:uuid:4"].payload_digest) == ("urn:uuid:2", "A" * 32)


def test_repeats_over_foreign_archives(spark, tmp_path):
    source, target = tmp_path / "in", scratch(spark, "warc-test")
    source.mkdir()
    (source / "a.warc.gz").write_bytes(gzip.compress(foreign(*RECORDS[3:])))
    (source / "b.warc.gz").write_bytes(gzip.compress(foreign(*RECORDS[:3])))
    done = warc.normalise_folder(spark, str(source), target)
    got = {r.record_id: r for r in warc.read_records(done, f"{target}/warc").collect()}
    assert [got[f"urn:uuid:{i}"].record_type for i in range(7)] == ["warcinfo", "request", "response", "revisit", "revisit", "resource", "revisit"]
    assert all(got[f"urn:uuid:{i}"].refers_to == "urn:uuid:2" and got[f"urn:uuid:{i}"].payload_bytes == 7 for i in (3, 6))
    assert got["urn:uuid:3"].payload_digest == warc.sha1_base32(b"payload")
    turned = warc.Record.of(b"WARC/1.0\r\n" + b"\r\n".join(RECORDS[3][0]) + b"\r\nContent-Length: 37", RECORDS[3][1]).revisit("urn:uuid:2")
    assert turned.block == HTTP and b"\r\nContent-Length: %d\r\n" % len(HTTP) in turned.head and b"WARC-Block-Digest: sha1:" + warc.sha1_base32(HTTP).encode() in turned.head


def test_archives_are_dealt_to_tasks(spark):
    folder = scratch(spark, "warc-test")
    pages = spark.range(40).selectExpr("id page_id", "'u' url", "concat('page ', id) html").repartition(4)
    warc.write_archives(pages, f"{folder}/whole", file_records=3).write.parquet(f"{folder}/manifest")
    files = spark.read.parquet(f"{folder}/manifest").select("file").distinct()
    n = files.count()
    assert n >= 12 and warc.dealt(files, "file").rdd.getNumPartitions() == n
    assert warc.dealt(files, "file").rdd.glom().map(len).max() <= 2
