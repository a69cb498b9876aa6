"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames of about FRAME raw bytes, each compressed on its own, so a reader
needs one frame to get a record. A bundle ends in a seek table: a skippable frame with the sizes
of all frames and a fixed footer, as in the Zstandard seekable format. An index maps each record's
identifier to bundle, frame and offset within the frame.

Tasks write bundles under names of their own into the shared folder; the index that Spark commits
names those of successful attempts, and only these are read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import fits_broadcast
from plumbline.session import Workspace

#: Raw bytes of records in a frame, and of a bundle.
FRAME, BUNDLE = 1 << 20, 64 << 20
LEVEL = 3
#: The most tasks that read bundles back.
READERS = 10_000
#: Numbers of the seekable format (fixed values): skippable frame, footer.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
_INDEX = "page_id long, record_id string, bundle string, frame int, offset long, size long"
_PAGE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _filesystem(where: str):
    """File system and path of a folder or file; without a scheme it is a local one (``_qualified`` adds the scheme)."""
    from pyarrow import fs

    if where.startswith("file:"):
        return fs.LocalFileSystem(), "/" + where.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(where) if "://" in where else (fs.LocalFileSystem(), where)


def _qualified(pages: DataFrame, where: str) -> str:
    """The path with the scheme of Spark's default file system where it has none, so that tasks write where Spark reads."""
    jvm = pages.sparkSession._jvm  # noqa: SLF001
    path = jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(pages.sparkSession._jsc.hadoopConfiguration()).makeQualified(path).toString()  # noqa: SLF001


def record_name(page_id: int | None) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"


def format_record(name: str, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response record, or a revisit of another page's equal payload. Header values lose line breaks."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", name), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    head.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if refers_to is not None:
        head.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        head.append(("WARC-Refers-To", record_name(refers_to)))
    body = http + (payload if refers_to is None else b"")
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers (names lower-cased) and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = lambda lines: {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    warc = fields(head.decode("utf-8", "replace").split("\r\n")[1:])
    body = rest[: int(warc["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    return warc, fields(http.decode("utf-8", "replace").split("\r\n")[1:]), payload


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


class BundleWriter:
    """Frames and seek table of one bundle file."""

    def __init__(self, folder: str):
        import zstandard

        self.fs, base = _filesystem(folder)
        self.name = f"bundle-{uuid.uuid4().hex}.warc.zst"
        self.fs.create_dir(base, recursive=True)
        self.file = self.fs.open_output_stream(f"{base}/{self.name}", compression=None)
        self.coder = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, write_checksum=True)
        self.frames: list[tuple[int, int]] = []
        self.held: list[bytes] = []
        self.size = self.total = 0

    def add(self, record: bytes) -> tuple[int, int]:
        """Frame and offset in it at which the record begins."""
        if self.size and self.size + len(record) > FRAME:
            self.flush()
        at = len(self.frames), self.size
        self.held.append(record)
        self.size += len(record)
        self.total += len(record)
        return at

    def flush(self) -> None:
        if self.held:
            data = self.coder.compress(b"".join(self.held))
            self.file.write(data)
            self.frames.append((len(data), self.size))
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.file.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.file.close()


class BundleReader:
    """Random access to the frames of a bundle through its seek table."""

    def __init__(self, where: str):
        import zstandard

        fs, path = _filesystem(where)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{where} has no seek table")
        step = 12 if flags & 0x80 else 8
        table = self.file.read_at(n * step, size - 9 - n * step)
        self.sizes = [struct.unpack_from("<II", table, i * step) for i in range(n)]
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)
        self.coder = zstandard.ZstdDecompressor()

    def frame(self, i: int) -> bytes:
        return self.coder.decompressobj().decompress(self.file.read_at(self.sizes[i][0], self.starts[i]))

    def close(self) -> None:
        self.file.close()


def _write(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer: BundleWriter | None = None
        for batch in batches:
            out: list[tuple] = []
            for page, url, html, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                payload = html.encode() if html is not None else b""
                if writer is None or writer.total >= BUNDLE:
                    if writer is not None:
                        writer.close()
                    writer = BundleWriter(folder)
                name = record_name(page)
                record = format_record(name, url, payload, base32_sha1(payload), refers, date)
                out.append((page, name, f"{folder}/{writer.name}", *writer.add(record), len(record)))
            if out:
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["page_id", "record_id", "bundle", "frame", "offset", "size"])
        if writer is not None:
            writer.close()

    return run


def write_warc(pages: DataFrame, ws: Workspace, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row and return the index (page_id, record_id, bundle, frame, offset, size).

    Of rows with equal payloads (by SHA-1) of ``min_revisit_bytes`` or more, the smallest page_id's
    are responses, the others revisits of it; smaller payloads are all responses. Null html is an
    empty payload, a null url leaves the header out, a null page_id gets a record name of its own
    and is a response where no row with a page_id has its payload. Repeated rows are repeated
    records. Other columns are ignored; an empty table writes no bundle.
    """
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    pages = pages.withColumn("sha", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    sized = ws.save(pages.select("page_id", "sha", F.octet_length(F.coalesce("html", F.lit(""))).alias("bytes")), "digests")
    same = sized.filter(F.col("bytes") >= min_revisit_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    same = ws.save(same.filter("n > 1 and first is not null").select("sha", F.col("first").alias("refers_to")), "same")
    small = F.broadcast(same) if fits_broadcast(same, same.count()) else same
    rows = pages.join(small, "sha", "left")
    rows = rows.withColumn("refers_to", F.when(F.coalesce(F.col("page_id") != F.col("refers_to"), F.lit(True)), F.col("refers_to")))
    folder = _qualified(pages, ws.path("bundles"))
    return ws.save(rows.select("page_id", "url", "html", "refers_to").mapInArrow(_write(folder, date), _INDEX), "index")


def _page_row(raw: bytes) -> tuple:
    warc, http, payload = parse_record(raw)
    kind = warc["warc-type"]
    digest = warc["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and base32_sha1(payload) != digest:
        raise ValueError(f"payload of {warc['warc-record-id']} does not match its digest")
    number = lambda x: int(x[len("<urn:page:") : -1]) if x and x.startswith("<urn:page:") else None
    return number(warc["warc-record-id"]), int(http["content-length"]), digest, kind, number(warc.get("warc-refers-to"))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches of an index in the order of bundle and frame, each with its rows' raw records; a frame is read once."""
    reader, now, held = None, None, (-1, b"")
    for batch in batches:
        out = []
        for where, frame, offset, size in zip(*(batch.column(c).to_pylist() for c in ("bundle", "frame", "offset", "size")), strict=True):
            if where != now:
                if reader is not None:
                    reader.close()
                reader, now, held = BundleReader(where), where, (-1, b"")
            if held[0] != frame:
                held = frame, reader.frame(frame)
            out.append(held[1][offset : offset + size])
        yield batch, out
    if reader is not None:
        reader.close()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    for batch, records in _records(batches):
        rows = []
        for name, record in zip(batch.column("record_id").to_pylist(), records, strict=True):
            if parse_record(record)[0]["warc-record-id"] != name:
                raise ValueError(f"the index places {name} wrongly")
            rows.append(_page_row(record))
        columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in _PAGE.split(", ")])


def _in_place(index: DataFrame) -> DataFrame:
    """The index with a bundle's rows in one task and in the order of their places."""
    tasks = max(1, min(READERS, index.select("bundle").distinct().count()))
    return index.repartition(tasks, "bundle").sortWithinPartitions("bundle", "frame", "offset")


def read_warc(index: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record of the index, a row per index row.

    Each record is taken from its frame and offset; its identifier and its payload's digest are
    checked. Repeated index rows give repeated rows; other columns are ignored; an empty index gives none.
    """
    return _in_place(index.select("record_id", "bundle", "frame", "offset", "size")).mapInArrow(_read, _PAGE)


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, records in _records(batches):
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(records, pa.binary())], ["page_id", "record"])


def fetch_records(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(page_id, record): raw records of the wanted page_ids, each read from its frame alone.

    Null and unknown ids give no row, repeated ones are one; pages with repeated records give each. Other
    columns are ignored; empty tables give no rows.
    """
    some = index.join(wanted.select("page_id").distinct(), "page_id")
    return _in_place(some.select("page_id", "bundle", "frame", "offset", "size")).mapInArrow(_fetch, "page_id long, record binary")


def archive_pages(pages: DataFrame, **columns) -> DataFrame:
    """Write the pages to bundles and read all of them back, a row per page."""
    ws = Workspace(pages.sparkSession, "warc")
    return read_warc(write_warc(pages, ws, **columns))
