"""Web archives: pages to ARC files, ARC files to WARC files, and WARC files back to rows.

Archives are files in a shared folder, written and read by the tasks through
Arrow's file systems, one archive of bounded size after the other.  A step's
manifest, a table of the archives that its finished tasks wrote, says which ones
count: what a lost or repeated attempt leaves behind is in no manifest.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import cut_lineage, run_folder

#: Bytes, before compression, after which a task goes on with a new archive.
ARCHIVE_BYTES = 32 << 20
#: Payloads shorter than this are never revisits.
REVISIT_BYTES = 1000
#: What a record of a page without a URL is filed under.
NO_URL = "urn:page:none"
_LEVEL = 1
_MANIFEST = "path string, records long"

#: Names of the fields of an ARC header line, by version; the URL may hold spaces.
ARC_FIELDS = {
    1: ("url", "ip", "date", "mime", "length"),
    2: ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length"),
}
_ARC_NAMES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}


class _Archive:
    """A compressed archive in writing: one member a record."""

    def __init__(self, folder: str, suffix: str):
        self.name = f"{uuid.uuid4().hex}.{suffix}.gz"
        self.path = f"{folder}/{self.name}"
        system, path = fs.FileSystem.from_uri(self.path)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self._out = system.open_output_stream(path, compression=None)
        self.size = self.records = 0

    def add(self, *parts: bytes) -> None:
        member = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
        for part in parts:
            self._out.write(member.compress(part))
            self.size += len(part)
        self._out.write(member.flush())
        self.records += 1

    def close(self) -> tuple[str, int]:
        self._out.close()
        return self.path, self.records


def _opened(path: str) -> BinaryIO:
    system, inner = fs.FileSystem.from_uri(path)
    return gzip.GzipFile(fileobj=system.open_input_file(inner))


def _manifest(written: list[tuple[str, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([p for p, _ in written], pa.string()), pa.array([n for _, n in written], pa.int64())],
        names=["path", "records"],
    )


def _spread(manifest: DataFrame) -> DataFrame:
    """Archives over tasks."""
    return manifest.select("path").repartition(max(1, min(manifest.count(), 100_000)), "path")


def write_arc(
    pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "20200101000000"
) -> DataFrame:
    """Write an ARC record per page and return the manifest; archives alternate between versions 1 and 2.

    A record's content is an HTTP response whose header names the page.  The
    payload is the html in UTF-8, empty for null.  A null URL becomes NO_URL;
    white space and control characters in a URL are percent-encoded.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("p"), F.col(url).cast("string").alias("u"), F.col(html).alias("h"))

    def start(version: int) -> _Archive:
        archive = _Archive(folder, "arc")
        body = f"{version} 0 fleetlens\n{_ARC_NAMES[version]}\n\n".encode()
        name = f"filedesc://{archive.name}"
        archive.add((_arc_line(version, name, "text/plain", date, len(body), archive) + "\n").encode(), body, b"\n")
        return archive

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, written = None, []
        for batch in batches:
            for p, u, h in zip(*(c.to_pylist() for c in (batch.column(0), batch.column(1), batch.column(2).cast(pa.binary()))), strict=True):
                if archive is None or archive.size > ARCHIVE_BYTES:
                    if archive is not None:
                        written.append(archive.close())
                    archive = start(1 + len(written) % 2)
                    version = 1 + len(written) % 2
                payload = h or b""
                head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                head += ("" if p is None else f"X-Page-Id: {p}\r\n") + f"Content-Length: {len(payload)}\r\n\r\n"
                name = NO_URL if u is None else quote(u, safe="".join(map(chr, range(33, 127))))
                block = head.encode()
                line = _arc_line(version, name, "text/html", date, len(block) + len(payload), archive)
                archive.add(f"{line}\n".encode(), block, payload, b"\n")
        if archive is not None:
            written.append(archive.close())
        yield _manifest(written)

    return cut_lineage(rows.mapInArrow(run, _MANIFEST))


def _arc_line(version: int, url: str, mime: str, date: str, length: int, archive: _Archive) -> str:
    given = {"url": url, "ip": "0.0.0.0", "date": date, "mime": mime, "status": "200", "checksum": "-",
             "location": "-", "offset": str(archive.size), "filename": archive.name, "length": str(length)}
    return " ".join(given[f] for f in ARC_FIELDS[version])


def read_arc(stream: BinaryIO) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header, content) of each record after the file's own, which states the version.

    Header lines are split from the right, by the version's fields, as a URL may
    hold spaces; the content is as long as declared.
    """
    at, version = 0, 0
    while line := stream.readline():
        start, at = at, at + len(line)
        if not line.strip():
            continue
        names = ARC_FIELDS[version or (1 if len(line.split()) == len(ARC_FIELDS[1]) else 2)]
        values = line.decode("utf-8", "replace").rstrip("\r\n").rsplit(" ", len(names) - 1)
        if len(values) != len(names) or not values[-1].isdigit():
            raise ValueError(f"no ARC header line at {start}: {line[:200]!r}")
        header = dict(zip(names, values, strict=True))
        content = stream.read(int(header["length"]))
        if len(content) != int(header["length"]):
            raise ValueError(f"the record at {start} is cut short")
        at += len(content)
        if not version:
            version = int(content.split(b" ", 1)[0])
            continue
        yield start, header, content


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """Header block and payload of an HTTP response; all is payload where it is none."""
    if not content.startswith(b"HTTP/"):
        return b"", content
    end = content.find(b"\r\n\r\n")
    return (content, b"") if end < 0 else (content[: end + 4], content[end + 4 :])


def _field(block: bytes, name: bytes) -> str | None:
    for line in block.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        if key.lower() == name:
            return value.strip().decode("utf-8", "replace")
    return None


def record_id(path: str, offset: int) -> str:
    """Of the record that an ARC record becomes, the same in every attempt."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{path.rpartition("/")[2]}#{offset}')}>"


def warc_date(date: str) -> str:
    """Of an ARC date of 14 digits, or 12 without seconds."""
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


_INDEX = "path string, offset long, url string, date string, bytes long, digest string, page_id long"


def index_arc(manifest: DataFrame) -> DataFrame:
    """(path, offset, url, date, bytes, digest, page_id) of every record; length and digest are the payload's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with _opened(path) as stream:
                    for offset, header, content in read_arc(stream):
                        block, payload = split_http(content)
                        page = _field(block, b"x-page-id")
                        rows.append((path, offset, header["url"], header["date"], len(payload), _sha1(payload), int(page) if page else None))
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(("path", "offset", "url", "date", "bytes", "digest", "page_id"), r, strict=True)) for r in rows],
                    schema=pa.schema([("path", pa.string()), ("offset", pa.int64()), ("url", pa.string()), ("date", pa.string()),
                                      ("bytes", pa.int64()), ("digest", pa.string()), ("page_id", pa.int64())]),
                )

    return cut_lineage(_spread(manifest).mapInArrow(run, _INDEX))


def plan_revisits(index: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """`index` with the (first_path, first_offset, first_url, first_date) that a record revisits, null for responses.

    Of records with equal payloads of `least` bytes or more, the one with the
    largest page_id is the response; of equal ids, that with the largest path and
    offset; a null id comes last.  Digests are counted before the shuffle.
    """
    order = F.struct(F.col("page_id").isNotNull().alias("has"), F.coalesce("page_id", F.lit(0)).alias("id"), "path", "offset", "url", "date")
    groups = index.filter(F.col("bytes") >= least).groupBy("digest").agg(F.max(order).alias("first"), F.count("*").alias("n"))
    groups = groups.filter("n > 1").select("digest", *[F.col(f"first.{c}").alias(f"first_{c}") for c in ("path", "offset", "url", "date")])
    found = index.join(groups, "digest", "left")
    own = (F.col("first_path") == F.col("path")) & (F.col("first_offset") == F.col("offset"))
    names = ("first_path", "first_offset", "first_url", "first_date")
    return found.select(*index.columns, *[F.when(~own, F.col(c)).alias(c) for c in names])


def convert_arc(plan: DataFrame, folder: str) -> DataFrame:
    """Write the WARC records of the ARC records that `plan` lists and return the manifest.

    A task takes whole archives, each read once from start to end beside its rows.
    """
    columns = ("path", "offset", "digest", "first_path", "first_offset", "first_url", "first_date")
    parts = max(1, min(plan.select("path").distinct().count(), 100_000))
    rows = plan.select(*columns).repartition(parts, "path").sortWithinPartitions("path", "offset")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, written, stream, source, at = None, [], None, None, None
        for path, offset, digest, f_path, f_offset, f_url, f_date in records(batches):
            if path != at:
                if stream is not None:
                    stream.close()
                stream, at = _opened(path), path
                source = read_arc(stream)
            here, header, content = next(source)
            while here != offset:
                here, header, content = next(source)
            if archive is None or archive.size > ARCHIVE_BYTES:
                if archive is not None:
                    written.append(archive.close())
                archive = _Archive(folder, "warc")
                info = b"software: fleetlens\r\nformat: WARC File Format 1.1\r\n"
                archive.add(*_warc_record("warcinfo", record_id(archive.name, 0), warc_date(header["date"]),
                                          [("WARC-Filename", archive.name), ("Content-Type", "application/warc-fields")], info))
            block, payload = split_http(content)
            kind = "response" if block else "resource"
            more = [("WARC-Target-URI", header["url"]), ("WARC-IP-Address", header["ip"])]
            more.append(("Content-Type", "application/http; msgtype=response" if block else header["mime"]))
            more.append(("WARC-Payload-Digest", digest))
            if f_path is not None:
                kind, content = "revisit", block
                more += [
                    ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                    ("WARC-Refers-To", record_id(f_path, f_offset)),
                    ("WARC-Refers-To-Target-URI", f_url),
                    ("WARC-Refers-To-Date", warc_date(f_date)),
                ]
            more.append(("WARC-Block-Digest", _sha1(content)))
            archive.add(*_warc_record(kind, record_id(path, offset), warc_date(header["date"]), more, content))
        if stream is not None:
            stream.close()
        if archive is not None:
            written.append(archive.close())
        yield _manifest(written)

    return cut_lineage(rows.mapInArrow(run, _MANIFEST))


def _warc_record(kind: str, identifier: str, date: str, more: list[tuple[str, str]], block: bytes) -> tuple[bytes, bytes, bytes]:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {identifier}", f"WARC-Date: {date}"]
    lines += [f"{k}: {v}" for k, v in more] + [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode(), block, b"\r\n\r\n"


def read_warc(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, names in lower case; block) of each record."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:200]!r}")
        header: dict[str, str] = {}
        while (line := stream.readline()).strip():
            key, _, value = line.partition(b":")
            header[key.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
        block = stream.read(int(header["content-length"]))
        if len(block) != int(header["content-length"]):
            raise ValueError(f"record {header.get('warc-record-id')} is cut short")
        yield header, block


_READ = "record_id string, type string, url string, date string, bytes long, digest string, page_id long, refers_to_id string"


def read_archives(manifest: DataFrame) -> DataFrame:
    """(record_id, type, url, date, bytes, digest, page_id, refers_to_id) of all records but warcinfo.

    `digest` is bare lower-case hex.  A response's is taken of its payload and
    must equal the one declared; a revisit's length and digest are those its
    headers declare.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("record_id", "type", "url", "date", "bytes", "digest", "page_id", "refers_to_id")
        types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())
        for batch in batches:
            for path in batch.column(0).to_pylist():
                out = []
                with _opened(path) as stream:
                    for h, block in read_warc(stream):
                        kind = h["warc-type"]
                        if kind == "warcinfo":
                            continue
                        http, payload = split_http(block)
                        declared = h["warc-payload-digest"]
                        size = len(payload)
                        if kind == "revisit":
                            size = int(_field(http, b"content-length") or 0)
                        elif _sha1(payload) != declared:
                            raise ValueError(f"{path}: payload of {h['warc-record-id']} differs from its digest")
                        page = _field(http, b"x-page-id")
                        out.append((h["warc-record-id"], kind, h.get("warc-target-uri"), h["warc-date"], size,
                                    base64.b32decode(declared.partition(":")[2]).hex(), int(page) if page else None,
                                    h.get("warc-refers-to")))
                columns = list(zip(*out, strict=True)) if out else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=list(names))

    return _spread(manifest).mapInArrow(run, _READ)


def archived_pages(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of pages after the round trip.

    Pages become ARC files, those WARC files, and these rows again.  Rows of
    equal page_id are records of their own; a null page_id stays null; extra
    columns are not read.  Files go to `folder`, by default in the session's
    own folder in the shared one, which is removed at the end.
    """
    folder = folder or f"{run_folder(pages.sparkSession)}/{uuid.uuid4().hex}"
    plan = plan_revisits(index_arc(write_arc(pages, f"{folder}/arc", page_id, url, html)))
    found = cut_lineage(read_archives(convert_arc(cut_lineage(plan), f"{folder}/warc")))
    first = found.filter("type != 'revisit'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    again = found.filter("refers_to_id is not null").join(first, "refers_to_id", "left")
    both = found.filter("refers_to_id is null").withColumn("refers_to", F.lit(None).cast("long")).unionByName(again)
    return both.select(
        "page_id", "url", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), "refers_to",
    )
