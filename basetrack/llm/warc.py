"""WARC archives: one gzip member per record, written by tasks to the shared folder and read back in sequence.

* write: records go to archives that are rotated by size.  An attempt writes under names of its own, and the manifest
  (a written table) lists only the archives of attempts that succeeded, so a lost executor leaves no half archive in the result.
* read: a task streams its archives; a member is inflated piece by piece, its header ends at the first empty line, its
  block is framed by Content-Length, and block and payload digests are checked as the bytes go by.
* revisits: of records with equal payloads the one with the largest page_id is the response and the others
  revisit it: their records hold the HTTP header and no payload.  Copies are counted on the map side first.

Edge cases: a null html is an empty payload; a null page_id is less than any other; rows that share page_id and
payload are all responses if theirs is the largest; an empty table gives an empty result; other columns are passed over.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basetrack.llm.common import materialise, shared_dir, ship

ARCHIVE_BYTES = 64 << 20
PIECE = 64 << 10
#: More archives than this are dealt round-robin, several to a task.
MOST_READERS = 20_000
#: HTTP headers are small; a WARC header holds the url and may have any length.
HEADER_BYTES = 64 << 10
#: Rows read back are given on at so many characters of urls at least, or at 4,096 rows.
URL_CHARS = 16 << 20
MANIFEST = "path string, records long, bytes long"
RECORDS = "page_id long, record_type string, refers_to long, target_uri string, payload_bytes long, payload_digest string, stored_bytes long"


def base32_sha1(h) -> str:
    return base64.b32encode(h.digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, revisits: int | None, is_revisit: bool) -> bytes:
    """One WARC record as a gzip member."""
    digest = base32_sha1(hashlib.sha1(payload))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{revisits}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(hashlib.sha1(block))}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


class Members:
    """The inflated bytes of one gzip member after another, in pieces."""

    def __init__(self, stream: BinaryIO) -> None:
        self.stream, self.left = stream, b""

    def next(self) -> Iterator[bytes] | None:
        if not self.left:
            self.left = self.stream.read(PIECE)
        return self._inflate() if self.left else None

    def _inflate(self) -> Iterator[bytes]:
        z = zlib.decompressobj(31)
        while not z.eof:
            data = z.unconsumed_tail or self.left or self.stream.read(PIECE)
            if not data:
                raise ValueError("the archive ends within a member")
            if not z.unconsumed_tail:
                self.left = b""
            if piece := z.decompress(data, PIECE):
                yield piece
        self.left = z.unused_data + self.left


def _take_header(pieces: Iterator[bytes]) -> tuple[bytes, bytes]:
    """The WARC header, of any length, and the bytes after it; each byte is searched about once."""
    buffer, seen = bytearray(), 0
    while (at := buffer.find(b"\r\n\r\n", seen)) < 0:
        seen = max(len(buffer) - 3, 0)
        piece = next(pieces, None)
        if piece is None:
            raise ValueError("no end of the WARC header")
        buffer += piece
        if not buffer.startswith(b"WARC/"[: len(buffer)]):
            raise ValueError(f"not a WARC record: {bytes(buffer[:40])!r}")
    return bytes(buffer[:at]), bytes(buffer[at + 4 :])


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = head.decode().split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _page(urn: str) -> int | None:
    digits = urn.removeprefix("<urn:x-page:").removesuffix(">")
    return int(digits) if digits else None


def read_archive(stream: BinaryIO) -> Iterator[tuple]:
    """The records of an archive, in order, each verified; one piece of a record is in memory at a time."""
    members = Members(stream)
    while (pieces := members.next()) is not None:
        head, rest = _take_header(pieces)
        version, h = _fields(head)
        if version not in ("WARC/1.0", "WARC/1.1"):
            raise ValueError(f"not a WARC record: {version[:40]}")
        length, block, got, http, payload, stored = int(h["content-length"]), hashlib.sha1(), 0, b"", hashlib.sha1(), 0
        fields: dict[str, str] | None = None
        tail = b""
        for piece in _with(rest, pieces):
            part, over = piece[: length - got], piece[length - got :]
            got += len(part)
            tail += over
            block.update(part)
            if fields is None:
                http += part
                if b"\r\n\r\n" in http:
                    top, _, part = http.partition(b"\r\n\r\n")
                    fields, http = _fields(top)[1], b""
                elif len(http) > HEADER_BYTES:
                    raise ValueError("no end of the HTTP header")
                else:
                    continue
            payload.update(part)
            stored += len(part)
        if got != length or tail != b"\r\n\r\n" or fields is None:
            raise ValueError(f"record {h.get('warc-record-id')}: framed {length} bytes, read {got}")
        if h["warc-block-digest"] != "sha1:" + base32_sha1(block):
            raise ValueError(f"record {h['warc-record-id']}: block digest differs")
        kind, said = h["warc-type"], h["warc-payload-digest"].removeprefix("sha1:")
        if kind == "response" and (said != base32_sha1(payload) or int(fields["content-length"]) != stored):
            raise ValueError(f"record {h['warc-record-id']}: payload digest differs")
        url = h.get("warc-target-uri")
        yield _page(h["warc-record-id"]), kind, _page(h["warc-refers-to"]) if kind == "revisit" else None, None if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"), int(fields["content-length"]), said, stored


def _with(first: bytes, pieces: Iterator[bytes]) -> Iterator[bytes]:
    if first:
        yield first
    yield from pieces


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def mark_revisits(pages: DataFrame, least_bytes: int = 0, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, url, payload, refers_to (the response that a revisit refers to), is_revisit."""
    rows = pages.select(pages[id_column].cast("long").alias("page_id"), pages[url_column].alias("url"), F.coalesce(pages[html_column], F.lit("")).alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload")})
    groups = rows.where(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("digest", "size", "response")
    again = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    return rows.join(groups, ["digest", "size"], "left").select("page_id", "url", "payload", F.when(again, F.col("response")).alias("refers_to"), again.alias("is_revisit"))


def write_archives(marked: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives to ``folder``/warc; returns the manifest, a written table."""
    ship(marked.sparkSession)
    place = f"{folder}/warc"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(place)
        system.create_dir(root, recursive=True)
        out = name = None
        n = size = 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [name], "records": pa.array([n], pa.int64()), "bytes": pa.array([size], pa.int64())})

        for batch in batches:
            for page_id, url, payload, refers_to, again in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to", "is_revisit")), strict=True):
                if out is None:
                    name, n, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(name, compression=None)
                data = record(page_id, url, payload.encode(), refers_to, again)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return materialise(marked.mapInArrow(run, MANIFEST), folder, "manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """The records of the archives that the manifest lists."""
    ship(manifest.sparkSession)
    place = f"{folder}/warc"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _open(place)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = [x.split()[0] for x in RECORDS.split(", ")]

        def give(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for path, records in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist(), strict=True):
                rows, n, chars = [], 0, 0
                with system.open_input_stream(path, compression=None) as stream:
                    for row in read_archive(stream):
                        rows.append(row)
                        n += 1
                        chars += len(row[3] or "")
                        if len(rows) >= 4096 or chars >= URL_CHARS:
                            yield give(rows)
                            rows, chars = [], 0
                if n != records:
                    raise ValueError(f"{path}: {n} records, the manifest has {records}")
                if rows:
                    yield give(rows)

    # a stated number of partitions, which adaptive execution leaves alone: an archive a task, as far as tasks are cheap
    return manifest.select("path", "records").repartition(min(max(manifest.count(), 1), MOST_READERS)).mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame, least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Writes a record per page and reads the archives back."""
    folder = folder or shared_dir(pages.sparkSession)
    return read_archives(write_archives(mark_revisits(pages, least_bytes), folder), folder)
