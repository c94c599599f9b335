"""WARC archives: whole-file gzip in, one gzip member a record and an offset index out.

``write_archives`` streams records to one gzip stream per file, as many crawlers do. Such a file can
only be read from its start. ``normalise_archives`` inflates each once, rewrites every record as a
member of its own, turns repeated payloads into revisit records, and writes an offset index beside it;
``read_records`` then opens any record from its offset alone. It takes archives of any origin: heads are
copied byte for byte, and only a record that becomes a revisit has lines of its head changed.

Folders are URLs that every executor reaches; files are opened through Arrow's file systems as streams.
A task names its files by task and attempt and only the names in the returned rows count, so files left
by lost tasks are never read. Memory is one record and the record list of one file (``FILE_RECORDS``).
Archives are dealt to as many tasks as there are archives, up to ``MOST_TASKS``.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

FILE_BYTES = 64 << 20
FILE_RECORDS = 20_000
MOST_TASKS = 20_000
BLOCK = 1 << 18
LEVEL = 6
DATE = "2024-01-01T00:00:00Z"
OWN_ID = "urn:record:"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_folder(url: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder; a path without a scheme is taken for this machine's disk."""
    if re.match("file:/(?!/)", url):
        url = "file://" + url.removeprefix("file:")
    return pafs.FileSystem.from_uri(url) if "://" in url else (pafs.LocalFileSystem(), url)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def record_bytes(name: str, url: str | None, payload: bytes, digest: str) -> bytes:
    """One WARC/1.1 response record."""
    head = [
        "WARC/1.1",
        "WARC-Type: response",
        f"WARC-Record-ID: <{OWN_ID}{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: text/html",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + payload + b"\r\n\r\n"


@dataclass
class Record:
    """One record: the bytes of its head without the empty line, its fields by lower-case name, and its block."""

    head: bytes
    fields: dict[str, str]
    block: bytes

    @classmethod
    def of(cls, head: bytes, block: bytes = b"") -> Record:
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        parted = (line.partition(":") for line in lines[1:])
        return cls(head, {name.strip().lower(): value.strip() for name, colon, value in parted if colon}, block)

    @property
    def kind(self) -> str:
        return self.fields.get("warc-type", "").lower()

    @property
    def id(self) -> str:
        return bare(self.fields.get("warc-record-id", ""))

    @property
    def payload_at(self) -> int:
        """Where the payload starts in the block: behind the head of an HTTP message, else at once."""
        if not self.fields.get("content-type", "").lower().startswith("application/http"):
            return 0
        end = self.block.find(b"\r\n\r\n")
        return len(self.block) if end < 0 else end + 4

    def bytes(self) -> bytes:
        return self.head + b"\r\n\r\n" + self.block + b"\r\n\r\n"

    def revisit(self, refers_to: str) -> Record:
        """The record without its payload: type, lengths and block digest changed, all other lines as they were."""
        at = self.payload_at
        block, digest = self.block[:at], sha1_base32(self.block[at:])
        changed = {b"warc-type": b"revisit", b"content-length": b"%d" % len(block), b"warc-block-digest": b"sha1:" + sha1_base32(block).encode()}
        lines = []
        for line in self.head.split(b"\r\n"):
            name, colon, _ = line.partition(b":")
            value = changed.get(name.strip().lower()) if colon else None
            lines.append(line if value is None else name + b": " + value)
        lines.append(f"WARC-Profile: {_REVISIT}\r\nWARC-Refers-To: <{refers_to}>\r\nPayload-Length: {len(self.block) - at}".encode())
        if "warc-payload-digest" not in self.fields:
            lines.append(b"WARC-Payload-Digest: sha1:" + digest.encode())
        return Record.of(b"\r\n".join(lines), block)


def bare(value: str) -> str:
    return value.removeprefix("<").removesuffix(">")


def stated_sha1(fields: dict[str, str]) -> str | None:
    """The payload's SHA-1 in upper-case base32 where the head states one."""
    kind, _, value = fields.get("warc-payload-digest", "").partition(":")
    if kind.lower() != "sha1":
        return None
    if re.fullmatch("[0-9A-Fa-f]{40}", value):
        return base64.b32encode(bytes.fromhex(value)).decode("ascii")
    return value.upper() if re.fullmatch("[A-Za-z2-7]{32}", value) else None


def stream_records(source) -> Iterator[Record]:
    """Records of a gzip file, whether it is one member or many, inflated once in bounded blocks."""
    inflate, held, tail = zlib.decompressobj(31), bytearray(), b""

    def more() -> bool:
        nonlocal inflate, tail
        while True:
            if not tail:
                tail = source.read(BLOCK)
                if not tail:
                    return False
            if inflate.eof:
                inflate = zlib.decompressobj(31)
            out = inflate.decompress(tail, BLOCK)
            tail = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
            if out:
                held.extend(out)
                return True

    while True:
        while True:
            if held[:1] in (b"\r", b"\n"):  # the empty lines behind a block, however many
                del held[: len(held) - len(held.lstrip(b"\r\n"))]
            if held and (at := held.find(b"\r\n\r\n")) >= 0:
                break
            if not more():
                if held:
                    raise ValueError("archive ends inside a record head")
                return
        record = Record.of(bytes(held[:at]))
        end = at + 4 + int(record.fields["content-length"])
        while len(held) < end:
            if not more():
                raise ValueError("archive ends inside a record")
        record.block = bytes(held[at + 4 : end])
        yield record
        del held[:end]


class _Roll:
    """Opens the next archive of a task when the last is full."""

    def __init__(self, folder: str, stem: str):
        self.fs, self.root = open_folder(folder)
        self.fs.create_dir(self.root, recursive=True)
        context = TaskContext.get()
        self.stem = f"{stem}-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        self.files = 0

    def open(self):
        name = f"{self.stem}-{self.files:04d}.warc.gz"
        self.files += 1
        return name, self.fs.open_output_stream(posixpath.join(self.root, name), compression=None)


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", file_bytes: int = FILE_BYTES, file_records: int = FILE_RECORDS) -> DataFrame:
    """Write every row as a response record into whole-file gzip archives below ``folder``.

    Returns per file and distinct payload: file, digest, first_key, first_record and the numbers of all
    its records in the file. The rows are the only list of valid files, so store them before use.
    Null payloads are empty; records are written in the order of the input and repeated rows each get one.
    """
    kind = dict(pages.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = _Roll(folder, "crawl")
        out = squeeze = None
        name, size, number = "", 0, 0
        seen: dict[str, list] = {}

        def close() -> pa.RecordBatch:
            out.write(squeeze.flush())
            out.close()
            digests = list(seen)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * len(digests), pa.string()),
                    pa.array(digests, pa.string()),
                    pa.array([seen[d][0] for d in digests], key_type),
                    pa.array([seen[d][1] for d in digests], pa.int32()),
                    pa.array([seen[d][2] for d in digests], pa.list_(pa.int32())),
                ],
                names=["file", "digest", "first_key", "first_record", "records"],
            )

        key_type = None
        for batch in batches:
            key_type = batch.schema.field(key).type
            for k, u, p in zip(batch.column(key), batch.column(url), batch.column(payload)):
                k, u, body = k.as_py(), u.as_py(), (p.as_py() or "").encode("utf-8")
                if out is None:
                    name, out = roll.open()
                    squeeze, size, number, seen = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0, 0, {}
                digest = sha1_base32(body)
                raw = record_bytes("" if k is None else str(k), u, body, digest)
                out.write(squeeze.compress(raw))
                size += len(raw)
                entry = seen.setdefault(digest, [k, number, []])
                if k is not None and (entry[0] is None or k < entry[0]):
                    entry[0], entry[1] = k, number
                entry[2].append(number)
                number += 1
                if size >= file_bytes or number >= file_records:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return pages.select(key, url, payload).mapInArrow(run, f"file string, digest string, first_key {kind}, first_record int, records array<int>")


def archives_in(spark: SparkSession, folder: str, pattern: str = "*.gz") -> DataFrame:
    """file: the names of the archives in a folder, by Spark's listing; no content is read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return found.select(F.regexp_extract("path", "[^/]*$", 0).alias("file"))


def dealt(rows: DataFrame, name: str) -> DataFrame:
    """The rows, one archive each, over as many tasks as there are rows."""
    return rows.repartitionByRange(max(1, min(rows.count(), MOST_TASKS)), name)


def payload_manifest(files: DataFrame, folder: str) -> DataFrame:
    """What ``write_archives`` returns, for archives of any origin: each file is inflated once to list its payloads.

    Only response and resource records have payloads; ``first_key`` is the record id. A file that breaks off
    is listed up to there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                seen: dict[str, list] = {}
                with fs.open_input_stream(posixpath.join(root, name), compression=None) as stream, suppress(ValueError, KeyError, zlib.error):
                    for number, record in enumerate(stream_records(stream)):
                        if record.kind in ("response", "resource"):
                            entry = seen.setdefault(sha1_base32(record.block[record.payload_at :]), [record.id, number, []])
                            if record.id < entry[0]:
                                entry[:2] = record.id, number
                            entry[2].append(number)
                rows = [{"file": name, "digest": d, "first_key": e[0], "first_record": e[1], "records": e[2]} for d, e in seen.items()]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("file", pa.string()), ("digest", pa.string()), ("first_key", pa.string()), ("first_record", pa.int32()), ("records", pa.list_(pa.int32()))]))

    return dealt(files.select("file"), "file").mapInArrow(run, "file string, digest string, first_key string, first_record int, records array<int>")


def revisits(manifest: DataFrame, prefix: str = "") -> DataFrame:
    """Per file, the records that repeat the payload of another: file, list of (record, refers_to).

    The record with the smallest key, then file and number, is the one kept; null keys come last. Payloads
    are counted per file first, so one that a third of all pages share is one row a file. ``refers_to`` is
    the key behind ``prefix``.
    """
    first = manifest.groupBy("digest").agg(
        F.min(F.struct(F.col("first_key").isNull().alias("no_key"), "first_key", "file", "first_record")).alias("first")
    )
    to = F.concat(F.lit(prefix), F.coalesce(F.col("first.first_key").cast("string"), F.lit("")))
    repeated = (
        manifest.join(first, "digest")
        .select("file", F.explode("records").alias("record"), to.alias("refers_to"), ((F.col("file") == F.col("first.file"))).alias("same"), F.col("first.first_record").alias("at"))
        .where(~(F.col("same") & (F.col("record") == F.col("at"))))
    )
    return repeated.groupBy("file").agg(F.collect_list(F.struct("record", "refers_to")).alias("repeats"))


def normalise_archives(files: DataFrame, source: str, target: str, least_bytes: int = 0) -> DataFrame:
    """Rewrite archives record by record; ``files`` has file and repeats (null: none), one row a file.

    Every record becomes a gzip member of its own below ``target``, its head as it was. Response and resource
    records in ``repeats`` whose payload has at least ``least_bytes`` bytes become revisits. A sidecar
    ``<archive>.idx.parquet`` lists record_id, type, offset, length and the payload's SHA-1 (counted, also where
    the head states none; null for records without a payload) of every member. Returns archive, sidecar,
    records and error: where a file breaks off, the records before that are kept and error says why.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(source)
        for batch in batches:
            for name, repeats in zip(batch.column("file").to_pylist(), batch.column("repeats").to_pylist()):
                to = {r["record"]: r["refers_to"] for r in repeats or []}
                roll = _Roll(target, name.removesuffix(".gz").removesuffix(".warc"))
                archive, out = roll.open()
                index: dict[str, list] = {"record_id": [], "type": [], "offset": [], "length": [], "payload_sha1": []}
                at, error = 0, None
                with fs.open_input_stream(posixpath.join(root, name), compression=None) as stream:
                    try:
                        for number, record in enumerate(stream_records(stream)):
                            payload = record.block[record.payload_at :] if record.kind in ("response", "resource") else None
                            digest = None if payload is None else sha1_base32(payload)
                            if number in to and payload is not None and len(payload) >= least_bytes:
                                record = record.revisit(to[number])
                            squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                            member = squeeze.compress(record.bytes()) + squeeze.flush()
                            out.write(member)
                            for column, value in zip(index.values(), (record.id, record.kind, at, len(member), digest)):
                                column.append(value)
                            at += len(member)
                    except (ValueError, KeyError, zlib.error) as broken:
                        error = f"{type(broken).__name__}: {broken}"
                out.close()
                sidecar = archive + ".idx.parquet"
                kinds = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("payload_sha1", pa.string())])
                pq.write_table(pa.table(index, kinds), posixpath.join(roll.root, sidecar), filesystem=roll.fs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([archive]), pa.array([sidecar]), pa.array([len(index["offset"])], pa.int64()), pa.array([error], pa.string())],
                    names=["archive", "sidecar", "records", "error"],
                )

    return files.select("file", "repeats").mapInArrow(run, "archive string, sidecar string, records bigint, error string")


def read_records(archives: DataFrame, folder: str) -> DataFrame:
    """Every record of ``archives`` (archive, sidecar), opened by its offset in the sidecar index.

    Returns record_id, record_type, target_uri, payload_bytes and payload_digest (bare upper-case base32 SHA-1)
    of the full payload, refers_to and intact. The digest of a response or resource is counted from its bytes;
    ``intact`` says whether it is the one in its head, null where the head states none. A revisit has what its
    head states; records of other types have no payload.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_())
        for batch in batches:
            for archive, sidecar in zip(batch.column("archive").to_pylist(), batch.column("sidecar").to_pylist()):
                index = pq.read_table(posixpath.join(root, sidecar), filesystem=fs, columns=["offset", "length"])
                rows = []
                with fs.open_input_file(posixpath.join(root, archive)) as file:
                    for offset, length in zip(index.column("offset").to_pylist(), index.column("length").to_pylist()):
                        raw = zlib.decompress(file.read_at(length, offset), 31)
                        at = raw.index(b"\r\n\r\n")
                        record = Record.of(raw[:at])
                        record.block = raw[at + 4 : at + 4 + int(record.fields["content-length"])]
                        size = digest = intact = None
                        stated = stated_sha1(record.fields)
                        if record.kind in ("response", "resource"):
                            payload = record.block[record.payload_at :]
                            size, digest = len(payload), sha1_base32(payload)
                            intact = None if stated is None else digest == stated
                        elif record.kind == "revisit":
                            size, digest = record.fields.get("payload-length"), stated
                            size = int(size) if size and size.isdigit() else None
                        refers = record.fields.get("warc-refers-to")
                        rows.append((record.id, record.kind, record.fields.get("warc-target-uri"), size, digest, bare(refers) if refers else None, intact))
                for first in range(0, len(rows), 10_000):
                    columns = list(zip(*rows[first : first + 10_000]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["record_id", "record_type", "target_uri", "payload_bytes", "payload_digest", "refers_to", "intact"])

    schema = "record_id string, record_type string, target_uri string, payload_bytes bigint, payload_digest string, refers_to string, intact boolean"
    return dealt(archives.select("archive", "sidecar"), "archive").mapInArrow(run, schema)


def drop_folder(url: str) -> None:
    fs, root = open_folder(url)
    with suppress(FileNotFoundError):
        fs.delete_dir(root)


def archive_pages(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """Pages to whole-file archives to normalised archives below ``folder``; returns archive, sidecar, records, error.

    Whole-file archives are removed once they are rewritten. An empty table gives no archive.
    """
    spark = pages.sparkSession
    plain, listed, done = f"{folder}/whole", f"{folder}/manifest", f"{folder}/archives"
    write_archives(pages, plain, key, url, payload).write.parquet(listed)
    manifest = spark.read.parquet(listed)
    manifest.select("file").distinct().join(revisits(manifest, OWN_ID), "file", "left").write.parquet(f"{folder}/work")
    normalise_archives(dealt(spark.read.parquet(f"{folder}/work"), "file"), plain, f"{done}/warc", least_bytes).write.parquet(f"{done}/list")
    drop_folder(plain)
    return spark.read.parquet(f"{done}/list")


def normalise_folder(spark: SparkSession, source: str, target: str, least_bytes: int = 0, find_repeats: bool = True) -> DataFrame:
    """All archives of a folder, whoever wrote them, to normalised ones below ``target``; returns archive, sidecar, records, error.

    With ``find_repeats`` the payloads are listed first, and repeated ones over all files become revisits.
    The source stays as it is; a folder without archives gives no rows.
    """
    files = archives_in(spark, source)
    if find_repeats:
        payload_manifest(files, source).write.parquet(f"{target}/manifest")
        repeats = revisits(spark.read.parquet(f"{target}/manifest"))
        files.join(repeats, "file", "left").write.parquet(f"{target}/work")
    else:
        files.withColumn("repeats", F.lit(None).cast("array<struct<record:int,refers_to:string>>")).write.parquet(f"{target}/work")
    normalise_archives(dealt(spark.read.parquet(f"{target}/work"), "file"), source, f"{target}/warc", least_bytes).write.parquet(f"{target}/list")
    return spark.read.parquet(f"{target}/list")


def page_records(archives: DataFrame, folder: str, key_type: str = "bigint") -> DataFrame:
    """Records of ``archive_pages`` by the keys of their pages: record_id and refers_to as ``key_type``, null for an empty key."""
    own = {c: F.nullif(F.regexp_replace(c, f"^{OWN_ID}", ""), F.lit("")).cast(key_type) for c in ("record_id", "refers_to")}
    return read_records(archives, folder).withColumns(own)
