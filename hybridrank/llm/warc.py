"""WARC archives whose records are compressed one by one with a shared dictionary.

An archive (.warc.zst) begins with a skippable frame that holds a zstandard dictionary built from the
archive's own first records; each record follows as a frame of its own, so a reader can start at any
record. Pages whose payloads are equal are stored once: one response record, and revisit records that
refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_folder, text_or_empty, written
from .files import MANIFEST, Manifest, create, dealt, opened, slices

# Fixed values of the formats.
SKIPPABLE_DICTIONARY = 0x184D2A5D
DICTIONARY_MAGIC = b"\x37\xa4\x30\xec"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Bytes of a dictionary; bytes and number of the records it is built from; compressed bytes after
#: which a new archive begins.
DICTIONARY_BYTES, SAMPLE_BYTES, SAMPLE_RECORDS, ARCHIVE_BYTES = 32 << 10, 4 << 20, 1024, 256 << 20


def record(page_id, url, payload: bytes, sha1_hex: str, refers_to, revisit: bool, date: str) -> bytes:
    """A response record, or a revisit record with the response's HTTP header and no payload."""
    name = lambda i: f"<urn:x-page:{'none' if i is None else i}>"
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else name(page_id)[1:-1]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1_hex)).decode()}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class ArchiveWriter:
    """One archive. Records wait until there are enough to build the dictionary from."""

    def __init__(self, folder: str, level: int) -> None:
        self.uri, self.out = create(folder, ".warc.zst")
        self.level, self.waiting, self.held, self.size, self.records, self.frame = level, [], 0, 0, 0, None

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def _begin(self) -> None:
        import zstandard

        try:
            words = zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, self.held // 8)), self.waiting)
            raw = words.as_bytes()
            self._write(struct.pack("<II", SKIPPABLE_DICTIONARY, len(raw)) + raw)
            self.frame = zstandard.ZstdCompressor(level=self.level, dict_data=words, write_checksum=True).compress
        except zstandard.ZstdError:  # too few records to learn from: an archive without dictionary
            self.frame = zstandard.ZstdCompressor(level=self.level, write_checksum=True).compress
        for r in self.waiting:
            self._write(self.frame(r))
        self.waiting = []

    def add(self, data: bytes) -> None:
        self.records += 1
        if self.frame:
            self._write(self.frame(data))
            return
        self.waiting.append(data)
        self.held += len(data)
        if self.held >= SAMPLE_BYTES or len(self.waiting) >= SAMPLE_RECORDS:
            self._begin()

    def close(self) -> int:
        if self.waiting:
            self._begin()
        self.out.close()
        return self.size


def records(uri: str):
    """Each record of an archive: its header fields and its block."""
    import zstandard

    with opened(uri) as file:
        magic, size = struct.unpack("<II", file.read(8))
        words = zstandard.ZstdCompressionDict(file.read(size)) if magic == SKIPPABLE_DICTIONARY else None
        file.seek(0)
        stream = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=words).stream_reader(file, read_across_frames=True), 1 << 20)
        while line := stream.readline():
            if line.strip() != VERSION:
                raise ValueError(f"{uri}: not a record: {line[:40]!r}")
            fields = {}
            while line := stream.readline().strip():
                key, _, value = line.decode("utf-8").partition(":")
                fields[key.strip().lower()] = value.strip()
            block = stream.read(int(fields["content-length"]))
            if stream.read(4) != b"\r\n\r\n":
                raise ValueError(f"{uri}: a record is cut short")
            yield fields, block


def write_archives(pages: DataFrame, folder: str, min_payload: int = 0, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html", level: int = 3) -> DataFrame:
    """Write a record per row of ``pages``; the archives' manifest.

    Payload: the page in UTF-8 (null: empty). Of equal payloads of at least ``min_payload`` bytes the
    row with the largest id becomes the response (all of them, if several rows repeat that id), the
    others refer to it; rows without id are smaller than any other. A missing address is replaced by the
    record's name. An empty table gives no archives. Other columns are not read.

    Payloads meet by digest and length; the largest id of each is found from ids alone, and the join
    that brings it to the pages can split a payload that a third of them share.
    """
    spark = pages.sparkSession

    def write(batches):
        manifest, out = Manifest(), None
        for batch in slices(batches):
            c = batch.to_pydict()
            for page, url, html, sha, keep, revisit in zip(*(c[k] for k in ("page_id", "url", "html", "sha", "keep", "revisit")), strict=True):
                out = out or ArchiveWriter(folder, level)
                out.add(record(page, url, html, sha, keep, revisit, date))
                if out.size >= ARCHIVE_BYTES:
                    manifest.add(out.uri, out.records, out.records, out.close())
                    out = None
        if out:
            manifest.add(out.uri, out.records, out.records, out.close())
        yield manifest.batch()

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_or_empty(html_col).cast("binary").alias("html"))
    rows = rows.withColumns({"sha": F.sha1("html"), "n": F.octet_length("html")})
    # written, so that both sides of the join come from exchanges that can be split where a payload is frequent
    keepers = written(rows.groupBy("sha", "n").agg(F.max("page_id").alias("keep")), "warc-keepers")
    joined = rows.join(keepers, ["sha", "n"])
    revisit = (F.col("n") >= min_payload) & ~F.col("page_id").eqNullSafe(F.col("keep"))
    return written(joined.select("page_id", "url", "html", "sha", "keep", revisit.alias("revisit")).mapInArrow(write, MANIFEST), "warc-manifest")


ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(manifest: DataFrame) -> DataFrame:
    """A row per record: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    A response's payload is measured and its digest computed anew and held against its header; a
    revisit has both from its headers.
    """

    def read(batches):
        number = lambda s: None if s is None or s == "<urn:x-page:none>" else int(s.strip("<>").rsplit(":", 1)[1])
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                for fields, block in records(path):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                    size = int(re.search(rb"(?mi)^Content-Length: (\d+)", head)[1])
                    if kind == "response":
                        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if (found, len(payload)) != (digest, size):
                            raise ValueError(f"{path}: {fields['warc-record-id']} doesn't match its digest")
                    rows.append((number(fields["warc-record-id"]), size, digest, kind, number(fields.get("warc-refers-to"))))
                    if len(rows) == 4096:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)

    return dealt(manifest).mapInArrow(read, ROWS)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in ROWS.split(", ")])


def archives(pages: DataFrame, min_payload: int = 0, **columns: str) -> DataFrame:
    """:func:`write_archives` to a new folder of the shared one, then :func:`read_archives`."""
    return read_archives(write_archives(pages, shared_folder(pages.sparkSession, "warc"), min_payload, **columns))
