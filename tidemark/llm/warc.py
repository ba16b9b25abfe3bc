"""WARC records in ZIP-packaged archives, read by range without extraction.

``write_archives`` packs records into archives of at most about ``ARCHIVE_BYTES``: ZIP files with stored members
``archive/data.warc.gz`` (one gzip member a record), ``indexes/index.cdxj`` (a line a record, with offset and length inside the
data member) and ``datapackage.json``. Each task writes under new names in the shared folder and returns what it wrote; a
retried task writes again under other names, and only returned names are read.

``read_archives`` parses the end-of-central-directory record (ZIP64 too), the central directory and local headers with a few
range reads, then reads the index members (all of ``indexes/``, plain or gzip) and each record's bytes by range from the member of
``archive/`` that its index line names; archives are never extracted or read whole.

Archives are opened by pyarrow, on local and mounted folders, HDFS, S3 (``s3a`` and ``s3n`` too) and GCS; other schemes are refused
with a message before anything is written.

Payloads of at least ``LEAST`` bytes that are equal (by SHA-1) share one response record, at the smallest page_id; the others
are revisit records that refer to it and keep the response's HTTP head, so their size and digest are read back too.

Defined results: a null html is an empty payload; a null url is written as ``urn:page:ID``; rows with a null page_id are
always responses; rows with equal page_id and payload are all responses or all revisits; an empty table gives no archives
and no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import scratch, stored

LEAST = 0
ARCHIVE_BYTES = 16 << 20
DATE = "2025-01-01T00:00:00Z"
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:page").int >> 64 << 64


def record_id(page_id: int) -> str:
    """A URN whose low half is the page's id."""
    return f"<urn:uuid:{uuid.UUID(int=_SPACE | page_id & (1 << 64) - 1)}>"


def page_of(urn: str) -> int | None:
    low = int(urn.strip("<>").rpartition(":")[2].replace("-", ""), 16) & (1 << 64) - 1
    return low - (1 << 64) if low >> 63 else low


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def quoted(url: str) -> str:
    """The URL without white space and control characters, which would end its line."""
    return re.sub(r"[\x00-\x20\x7f-\xa0\u2028\u2029]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def write_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One WARC/1.1 record: a response, or a revisit if it refers to another page."""
    uri = quoted(url) if url else f"urn:page:{page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Target-URI": uri,
        "WARC-Date": DATE,
        "WARC-Record-ID": record_id(page_id) if page_id is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, sha1_base32(payload))}>",
        "WARC-Payload-Digest": "sha1:" + sha1_base32(payload),
        "WARC-Block-Digest": "sha1:" + sha1_base32(block),
        "Content-Type": "application/http; msgtype=response",
    }
    if page_id is None:
        head["X-Page"] = "none"
    if refers_to is not None:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in (head | {"Content-Length": len(block)}).items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def read_record(data: bytes) -> dict:
    """RECORDS of one record's bytes; a response's digest and length are those of the payload that was read."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in head.decode().split("\r\n")[1:])}
    if not head.startswith(b"WARC/1.") or len(rest) < int(fields["content-length"]):
        raise ValueError("not a whole WARC record")
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x[15:]) for x in http.decode().split("\r\n") if x.lower().startswith("content-length:"))
    kind = fields["warc-type"]
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (sha1_base32(payload) != digest or len(payload) != length):
        raise ValueError(f"{fields['warc-record-id']}: the payload differs from its digest")
    return {"page_id": None if "x-page" in fields else page_of(fields["warc-record-id"]), "url": fields["warc-target-uri"], "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": page_of(fields["warc-refers-to"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None}


def zip_members(read, size: int) -> dict[str, tuple[int, int, int]]:
    """name -> (place of the local header, stored size, method) from the central directory. ``read(start, length)`` reads a range."""
    tail_at = max(0, size - 65_557)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of central directory")
    _, _, _, total, length, start, _ = struct.unpack_from("<HHHHIIH", tail, at + 4)
    locator = at - 20
    if locator >= 0 and tail[locator : locator + 4] == b"PK\x06\x07":
        record = read(struct.unpack_from("<Q", tail, locator + 8)[0], 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        total, length, start = struct.unpack_from("<QQQ", record, 32)
    directory, out, i = read(start, length), {}, 0
    for _ in range(total):
        if directory[i : i + 4] != b"PK\x01\x02":
            raise ValueError("the central directory is damaged")
        flags, method = struct.unpack_from("<HH", directory, i + 8)
        packed, whole, n, extra, note = struct.unpack_from("<IIHHH", directory, i + 20)
        place = struct.unpack_from("<I", directory, i + 42)[0]
        name = directory[i + 46 : i + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        more, j = directory[i + 46 + n : i + 46 + n + extra], 0
        while j + 4 <= len(more):
            tag, span = struct.unpack_from("<HH", more, j)
            if tag == 1:  # ZIP64: only the fields that are full in the entry, in this order
                wide = iter(struct.unpack_from(f"<{span // 8}Q", more, j + 4))
                whole = next(wide) if whole == 0xFFFFFFFF else whole
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                place = next(wide) if place == 0xFFFFFFFF else place
            j += 4 + span
        out[name] = (place, packed, method)
        i += 46 + n + extra + note
    return out


def member_range(read, member: tuple[int, int, int]) -> tuple[int, int]:
    """Start and length of a stored member's bytes."""
    place, size, method = member
    if method:
        raise ValueError("only stored members can be read by range")
    head = read(place, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no local header")
    name, extra = struct.unpack_from("<HH", head, 26)
    return place + 30 + name + extra, size


class Archive:
    """Records of one archive, by range reads."""

    def __init__(self, read, size: int):
        self.read = read
        members = zip_members(read, size)
        self.data = {name.rpartition("/")[2]: member for name, member in members.items() if name.startswith("archive/") and not name.endswith("/")}
        self.places: dict[str, tuple[int, int]] = {}
        self.index = []
        for name in sorted(x for x in members if x.startswith("indexes/") and re.search(r"\.cdxj?(\.gz)?$", x)):
            text = read(*member_range(read, members[name]))
            text = gzip.decompress(text) if name.endswith(".gz") else text
            self.index += [json.loads(line.split(" ", 2)[2]) for line in text.decode().split("\n") if line and not line.startswith("!")]

    def record(self, entry: dict) -> dict:
        name = entry["filename"].rpartition("/")[2]
        if name not in self.places:
            if name not in self.data:
                raise ValueError(f"the index names {name}, which the archive does not hold")
            self.places[name] = member_range(self.read, self.data[name])
        start, whole = self.places[name]
        offset, length = int(entry["offset"]), int(entry["length"])
        if offset + length > whole:
            raise ValueError("the index points outside the data member")
        return read_record(zlib.decompress(self.read(start + offset, length), 31))


def build_archive(records: list[tuple[str, bytes]]) -> bytes:
    """An archive of (url, record)."""
    data, lines, at = [], [], 0
    for url, record in records:
        packed = gzip.compress(record, 6, mtime=0)
        lines.append(f"{quoted(url) or '-'} {re.sub('[^0-9]', '', DATE)} " + json.dumps({"offset": at, "length": len(packed), "filename": DATA.rpartition("/")[2]}))
        data.append(packed)
        at += len(packed)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, content in ((DATA, b"".join(data)), (INDEX, "\n".join(lines).encode()), ("datapackage.json", json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"path": DATA}, {"path": INDEX}]}).encode())):
            z.writestr(zipfile.ZipInfo(name), content)
    return out.getvalue()


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark writes it."""
    if not re.match(r"[a-z0-9]+:", path):
        return fs.LocalFileSystem(), path
    known = re.sub(r"^s3[an]:", "s3:", path)
    if not re.match(r"(file|hdfs|viewfs|s3|gs|gcs):", known):
        raise ValueError(f"archives cannot be opened at {path}: set spark.checkpoint.dir to a folder, HDFS, S3 or GCS")
    return fs.FileSystem.from_uri(known)


def tagged(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload and first, the page that a revisit refers to. Digests are aggregated before they are shuffled; which
    pages are revisits is found from ids and digests alone, and only then met by page, so that equal payloads do not meet in one task
    however many there are."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")).withColumn("sha1", F.sha1("payload"))
    known = rows.where(F.length("payload") >= least).select("page_id", "sha1")
    firsts = known.groupBy("sha1").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select(F.col("sha1").alias("s"), "first")
    again = known.join(firsts, F.col("sha1") == F.col("s")).where("first < page_id").select(F.col("page_id").alias("again"), "s", "first").distinct()
    met = rows.join(again, (F.col("page_id") == F.col("again")) & (F.col("sha1") == F.col("s")), "left")
    return met.select("page_id", "url", "payload", "first")


def write_archives(records: DataFrame, root: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes (page_id, url, payload, first) under ``root``; returns the catalog (path, size, n_records), a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, folder = _filesystem(root)
        filesystem.create_dir(folder, recursive=True)
        held: list[tuple[str, bytes]] = []
        size = 0

        def put() -> pa.RecordBatch:
            name, content = f"{uuid.uuid4().hex}.wacz", build_archive(held)
            with filesystem.open_output_stream(f"{folder}/{name}") as f:
                f.write(content)
            return pa.RecordBatch.from_pydict({"path": [f"{root}/{name}"], "size": [len(content)], "n_records": [len(held)]})

        for batch in batches:
            for row in batch.to_pylist():
                held.append((row["url"] or "", write_record(row["page_id"], row["url"], row["payload"], row["first"])))
                size += len(held[-1][1])
                if size >= archive_bytes:
                    yield put()
                    held, size = [], 0
        if held:
            yield put()

    return stored(records.select("page_id", "url", "payload", "first").mapInArrow(run, "path string, size bigint, n_records bigint"), "archives")


def read_archives(catalog: DataFrame) -> DataFrame:
    """RECORDS of all archives of a catalog."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for row in batch.to_pylist():
                filesystem, path = _filesystem(row["path"])
                with filesystem.open_input_file(path) as f:
                    archive = Archive(lambda start, length, f=f: f.read_at(length, start), row["size"])
                    for at in range(0, len(archive.index), 256):
                        yield pa.RecordBatch.from_pylist([archive.record(x) for x in archive.index[at : at + 256]], schema=schema)

    parts = int(catalog.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return catalog.select("path", "size").repartition(parts).mapInArrow(run, RECORDS)


def archive_pages(pages: DataFrame, least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) to archives in the shared folder and reads them back."""
    root = scratch(pages.sparkSession, "warc")
    _filesystem(root)
    return read_archives(write_archives(tagged(pages, least), root, archive_bytes))
