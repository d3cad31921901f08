"""WARC records in ZIP packages, read by range without extraction.

A package holds stored members: `archive/data.warc.gz` (each record a gzip member of its own) and
`indexes/index.jsonl` (a line per record with its offset and length in the archive). The reader parses the
end record, the ZIP64 records and the central directory with ranged reads, finds where the stored members
lie, reads the index and then only the bytes of the records.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inciflow.llm.common import HEAVY_SHARE, attach, work_path

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
#: Payload bytes after which a task closes a package and starts the next.
PACKAGE_BYTES = 64 << 20
#: Records whose bytes are read with one ranged read.
READ_BYTES = 4 << 20
#: Signatures of the ZIP format: end record, ZIP64 locator, ZIP64 end record, central entry, local header.
END, LOCATOR64, END64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06", b"PK\x01\x02", b"PK\x03\x04"
ALL_ONES_16, ALL_ONES_32 = 0xFFFF, 0xFFFFFFFF
#: Fixed values of WARC 1.1: the profile of a revisit with an equal payload, the content type of a response.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_RESPONSE = "application/http; msgtype=response"
#: Date of records whose table has none: fixed, so that reruns write equal records.
DATE = "2000-01-01T00:00:00Z"
#: URI of a page without one; a record needs a URI.
NO_URL = "urn:no-url:"


class BadPackage(ValueError):
    """The file isn't a readable package of stored members."""


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header: int


def end_of_directory(read_at, size: int) -> tuple[int, int, int]:
    """(number of entries, bytes, offset) of the central directory."""
    tail_at = max(0, size - 22 - ALL_ONES_16)
    tail = read_at(tail_at, size - tail_at)
    at = tail.rfind(END, 0, max(0, len(tail) - 18))
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(END, 0, at)  # the mark can stand in a comment
    if at < 0:
        raise BadPackage("no end record")
    entries, length, offset = struct.unpack_from("<HII", tail, at + 10)
    if ALL_ONES_16 in (entries,) or ALL_ONES_32 in (length, offset):
        locator_at = tail_at + at - 20
        locator = read_at(locator_at, 20) if locator_at >= 0 else b""
        if locator[:4] != LOCATOR64:
            raise BadPackage("no ZIP64 locator")
        record = read_at(struct.unpack_from("<Q", locator, 8)[0], 56)
        if record[:4] != END64:
            raise BadPackage("no ZIP64 end record")
        entries, length, offset = struct.unpack_from("<QQQ", record, 32)
    return entries, length, offset


def directory(read_at, size: int) -> dict[str, Member]:
    """Members by name, from the central directory and its ZIP64 fields."""
    entries, length, offset = end_of_directory(read_at, size)
    raw, at, found = read_at(offset, length), 0, {}
    for _ in range(entries):
        if raw[at : at + 4] != CENTRAL:
            raise BadPackage("broken central directory")
        method = struct.unpack_from("<H", raw, at + 10)[0]
        packed, plain, name_len, extra_len, comment_len = struct.unpack_from("<IIHHH", raw, at + 20)
        header = struct.unpack_from("<I", raw, at + 42)[0]
        name = raw[at + 46 : at + 46 + name_len].decode()
        extra, end = at + 46 + name_len, at + 46 + name_len + extra_len
        while extra + 4 <= end:
            tag, n = struct.unpack_from("<HH", raw, extra)
            if tag == 1:  # ZIP64: the values that the entry couldn't hold, in this order
                values = iter(struct.unpack_from(f"<{n // 8}Q", raw, extra + 4))
                plain = next(values) if plain == ALL_ONES_32 else plain
                packed = next(values) if packed == ALL_ONES_32 else packed
                header = next(values) if header == ALL_ONES_32 else header
            extra += 4 + n
        found[name] = Member(name, method, packed, header)
        at = end + comment_len
    return found


def data_offset(read_at, member: Member) -> int:
    """Where the bytes of a stored member begin."""
    if member.method != 0:
        raise BadPackage(f"{member.name} is compressed")
    header = read_at(member.header, 30)
    if header[:4] != LOCAL:
        raise BadPackage("no local header")
    return member.header + 30 + sum(struct.unpack_from("<HH", header, 26))


def record_bytes(fields: dict[str, str], payload: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    raw = f"WARC/1.1\r\n{head}Content-Length: {len(payload)}\r\n\r\n".encode() + payload + b"\r\n\r\n"
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    plain = zlib.decompress(raw, 31)
    head, _, rest = plain.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise BadPackage("not a WARC record")
    fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
    return fields, rest[: int(fields["content-length"])]


def http_response(payload: bytes) -> bytes:
    """The payload under the header of an HTTP response."""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload


def http_payload(block: bytes) -> bytes:
    head, mark, payload = block.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"HTTP/"):
        raise BadPackage("a response without an HTTP header")
    return payload


def package(records: list[tuple[dict[str, str], bytes]]) -> bytes:
    """A package of (fields, payload) records."""
    archive, index = io.BytesIO(), []
    for fields, payload in records:
        raw = record_bytes(fields, payload)
        index.append(json.dumps({"id": fields["WARC-Record-ID"], "offset": archive.tell(), "length": len(raw)}))
        archive.write(raw)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in ((ARCHIVE, archive.getbuffer()), (INDEX, "".join(f"{x}\n" for x in index).encode())):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=True) as member:
                member.write(data)
    return out.getvalue()


def read_package(read_at, size: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a package, in the order of its index."""
    members = directory(read_at, size)
    index, archive = members[INDEX], members[ARCHIVE]
    lines = read_at(data_offset(read_at, index), index.size).splitlines()
    base, spans = data_offset(read_at, archive), [json.loads(x) for x in lines]
    at = 0
    while at < len(spans):
        end, first = at + 1, spans[at]["offset"]
        while end < len(spans) and spans[end]["offset"] + spans[end]["length"] - first <= READ_BYTES:
            end += 1
        block = read_at(base + first, spans[end - 1]["offset"] + spans[end - 1]["length"] - first)
        for s in spans[at:end]:
            yield parse_record(block[s["offset"] - first : s["offset"] - first + s["length"]])
        at = end


def revisits(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """page_id, url, payload, digest, refers_to: null for responses, else the smallest page_id with the payload.

    A null html is an empty payload. Of rows that repeat page_id and payload, all are responses if theirs is the
    smallest id.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.cast("binary").alias("payload"), F.sha2(payload, 256).alias("digest"))
    long = F.length("payload") >= least_bytes
    ids = rows.filter(long).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    limit = HEAVY_SHARE * max(1, pages.count())
    found = attach(rows, ids, ["digest"], "n", limit, ["page_id"])
    refers = F.when(F.col("first_id").isNotNull() & (F.col("page_id") != F.col("first_id")), F.col("first_id"))
    return found.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_packages(pages: DataFrame, folder: str, least_bytes: int = 100, date: str = DATE) -> DataFrame:
    """Write `pages` into packages below `folder`; (path, records) of the packages written.

    A response holds the payload under an HTTP header; a revisit names its profile and the record it refers to and
    holds nothing. All records carry `date`.

    A package gets its name from the attempt that writes it and counts only if the list returned names it, so
    a repeated task leaves no record twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        records, held, paths, counts = [], 0, [], []

        def close():
            nonlocal records, held
            name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.wacz"
            with fs.open_output_stream(f"{root}/{name}") as out:
                out.write(package(records))
            paths.append(name)
            counts.append(len(records))
            records, held = [], 0

        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                uri = f"{NO_URL}{'' if page_id is None else page_id}" if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
                fields = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>"}
                fields |= {"WARC-Date": date, "WARC-Target-URI": uri, "WARC-Payload-Digest": f"sha256:{digest}", "X-Payload-Length": str(len(payload))}
                if refers_to is None:
                    fields["Content-Type"] = HTTP_RESPONSE
                else:
                    fields |= {"WARC-Profile": SAME_PAYLOAD, "WARC-Refers-To": f"<urn:page:{refers_to}>"}
                records.append((fields, http_response(payload) if refers_to is None else b""))
                held += len(payload) if refers_to is None else 0
                if held >= PACKAGE_BYTES:
                    close()
        if records:
            close()
        yield pa.RecordBatch.from_pydict({"path": paths, "records": counts}, schema=pa.schema([("path", pa.string()), ("records", pa.int64())]))

    return revisits(pages, least_bytes).mapInArrow(run, "path string, records long")


def read_packages(packages: DataFrame, folder: str) -> DataFrame:
    """One row per record of the listed packages: page_id, url, record_type, refers_to, payload, payload_bytes, payload_digest.

    `payload` is null for revisits; size and digest are those of the full payload. The digest of a response is
    computed from the bytes read and must be the one that the record names.
    """
    number = lambda x: int(x[len("<urn:page:") : -1]) if x and x != "<urn:page:>" else None
    names = ["page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for name in (x for b in batches for x in b.column("path").to_pylist()):
            with fs.open_input_file(f"{root}/{name}") as file:
                rows, held = [], 0
                for fields, block in read_package(lambda at, n: file.read_at(n, at), file.size()):
                    digest, kind = fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"]
                    payload = http_payload(block) if kind == "response" else block
                    uri = fields["warc-target-uri"]
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise BadPackage(f"{name}: a payload was changed")
                    n = len(payload) if kind == "response" else int(fields["x-payload-length"])
                    rows.append((number(fields["warc-record-id"]), None if uri.startswith(NO_URL) else uri, kind, number(fields.get("warc-refers-to")), payload if kind == "response" else None, n, digest))
                    held += len(payload)
                    if held > READ_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return packages.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string")


def round_trip(spark: SparkSession, pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Write `pages` to packages in the shared folder and read them back. An empty table gives no rows."""
    folder = work_path(spark, "warc")
    listing = f"{folder}-list"
    write_packages(pages, folder, least_bytes).write.parquet(listing)
    packages = spark.read.schema("path string, records long").parquet(listing).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return read_packages(packages, folder)


PAGES_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM f
"""
