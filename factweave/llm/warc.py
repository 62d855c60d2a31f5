"""WARC archives: writing, and normalising monolithic gzip files into one member per record.

``write_archives`` writes each partition of a page table as one archive whose whole
content is a single gzip stream, as careless crawlers do. ``normalise`` inflates such a
stream once, from start to end in small chunks, rewrites every record as a gzip member
of its own and writes a sidecar index of offsets. ``read_archives`` then opens single
members at their offsets.

Defined cases: a null html is an empty payload; among equal payloads of at least
``min_bytes`` the smallest page_id is the response and larger ones are revisits of it (rows
that repeat the smallest page_id are responses too; a null page_id counts as the largest,
and is a response if no other page has the payload); an empty table gives no row.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ARROW_BYTES, in_arrow, join_unique, scratch, stash

CHUNK = 1 << 18
#: Payloads read back go on together up to so many bytes or rows.
READ_BYTES = ARROW_BYTES
READ_ROWS = 10_000


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


#: Pages name no time of their capture, so all records carry this one.
DATE = "2020-01-01T00:00:00Z"


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC/1.1 record: an HTTP response, or a revisit that has its headers alone."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {' '.join(url.split())}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(raw: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in raw.decode("utf-8").split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def inflate(source: BinaryIO) -> Iterator[bytes]:
    """The content of a gzip file, of one member or several, in chunks."""
    d = zlib.decompressobj(31)
    while raw := source.read(CHUNK):
        while raw:
            yield d.decompress(raw, CHUNK)
            raw = d.unconsumed_tail
            if d.eof:
                raw, d = d.unused_data, zlib.decompressobj(31)
    if rest := d.flush():
        yield rest


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and raw bytes of each record of an inflated archive, holding one record at a time."""
    buffer, ended = bytearray(), False

    def more() -> bool:
        nonlocal ended
        part = next(chunks, None)
        ended = part is None
        if not ended:
            buffer.extend(part)
        return not ended

    while True:
        while (head := buffer.find(b"\r\n\r\n")) < 0 and more():
            pass
        if head < 0:
            if buffer.strip():
                raise ValueError("the archive ends inside a record's headers")
            return
        fields = _headers(bytes(buffer[:head]))
        size = head + 4 + int(fields["content-length"]) + 4
        while len(buffer) < size and more():
            pass
        if len(buffer) < size:
            raise ValueError("the archive ends inside a record")
        yield fields, bytes(buffer[:size])
        del buffer[:size]


class Store:
    """Files of a shared folder by URI (file, hdfs, s3, ...); a finished file appears at once, by renaming."""

    def __init__(self, root: str):
        self.fs, self.root = pa.fs.FileSystem.from_uri(root)
        self.fs.create_dir(self.root, recursive=True)

    def write(self, name: str, parts: Iterator[bytes]) -> int:
        held, n = f"{self.root}/.{name}.{uuid.uuid4().hex}", 0
        with self.fs.open_output_stream(held, compression=None) as f:
            for part in parts:
                f.write(part)
                n += len(part)
        self.fs.move(held, f"{self.root}/{name}")
        return n

    def open(self, name: str) -> BinaryIO:
        return self.fs.open_input_file(f"{self.root}/{name}")


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to); only digests and ids meet, and html moves once, by page.

    A payload that a large share of pages has, such as the empty one, is no key of a shuffle: ``join_unique`` broadcasts it.
    """
    html = F.coalesce("html", F.lit(""))
    seen = pages.select("page_id", F.sha1(html.cast("binary")).alias("_sha"), F.octet_length(html).alias("_size"))
    firsts = seen.where(F.col("_size") >= min_bytes).groupBy("_sha", "_size").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("_n")).where("_n > 1")
    firsts = stash(firsts, "warc-firsts")
    keys = ["_sha", "_size"]
    late = join_unique(seen, firsts.drop("_n"), keys, firsts.select(*keys, F.col("_n").alias("n")))
    late = late.where("page_id > refers_to or (page_id is null and refers_to is not null)")
    late = late.select(F.col("page_id").alias("_page"), "_sha", "refers_to").distinct()
    rows = pages.select("page_id", "url", html.alias("html"))
    same = F.col("page_id").eqNullSafe(F.col("_page")) & (F.sha1(F.col("html").cast("binary")) == F.col("_sha"))
    return rows.join(late, same, "left").select("page_id", "url", "html", "refers_to")


def write_archives(marked: DataFrame, root: str) -> DataFrame:
    """One monolithic gzip archive per partition; returns (archive, records) as stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0

        def parts() -> Iterator[bytes]:
            nonlocal n
            z = zlib.compressobj(6, zlib.DEFLATED, 31)
            for batch in batches:
                for page_id, url, html, refers_to in zip(*(batch.column(i) for i in range(4)), strict=True):
                    n += 1
                    yield z.compress(record(page_id.as_py(), url.as_py() or "", html.as_py().encode(), refers_to.as_py()))
            yield z.flush()

        name = f"part-{_task():06d}.warc.gz"
        Store(root).write(name, parts())
        yield pa.RecordBatch.from_pydict({"archive": [name], "records": pa.array([n], pa.int64())})

    return stash(in_arrow(marked, run, "archive string, records bigint"), "archives")


def normalise(archives: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrite archives record by record; returns the index (archive, offset, length, record_id) as stored.

    Beside every archive lies its index as text, ``<archive>.idx``: offset, length, record id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old, new = Store(source), Store(target)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                index: list[tuple[int, int, str]] = []

                def members(name: str = name, index: list = index) -> Iterator[bytes]:
                    at = 0
                    with old.open(name) as f:
                        for fields, raw in records(inflate(f)):
                            z = zlib.compressobj(6, zlib.DEFLATED, 31)
                            member = z.compress(raw) + z.flush()
                            index.append((at, len(member), fields["warc-record-id"]))
                            at += len(member)
                            yield member

                new.write(name, members())
                new.write(f"{name}.idx", (f"{o} {n} {i}\n".encode() for o, n, i in index))
                if index:
                    o, n, i = zip(*index, strict=True)
                    yield pa.RecordBatch.from_pydict({"archive": [name] * len(index), "offset": pa.array(o, pa.int64()), "length": pa.array(n, pa.int64()), "record_id": list(i)})

    # An archive is a task: the list is short, the work behind each entry is long.
    dealt = archives.repartitionByRange(max(1, archives.count()), "archive")
    return stash(dealt.mapInArrow(run, "archive string, offset bigint, length bigint, record_id string"), "warc-index")


def read_sidecars(archives: DataFrame, root: str) -> DataFrame:
    """The index again, from the text files beside the archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(root)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open(f"{name}.idx") as f:
                    rows = [line.split(" ", 2) for line in f.read().decode().splitlines()]
                if rows:
                    o, n, i = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_pydict({"archive": [name] * len(rows), "offset": pa.array(map(int, o), pa.int64()), "length": pa.array(map(int, n), pa.int64()), "record_id": list(i)})

    return archives.select("archive").mapInArrow(run, "archive string, offset bigint, length bigint, record_id string")


def read_archives(index: DataFrame, root: str) -> DataFrame:
    """Open each member at its offset: page_id, payload_bytes, payload_digest, record_type, refers_to, payload."""

    def number(uri: str | None) -> int | None:
        return int(uri[10:-1]) if uri and uri != "<urn:page:>" else None

    def table(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A batch of the index is a few bytes a row and says nothing of its payloads: these are counted and handed on by their bytes.
        store, source, name = Store(root), None, None
        out: list[tuple] = []
        held = 0
        for batch in batches:
            for archive, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if archive != name:
                    if source is not None:
                        source.close()
                    source, name = store.open(archive), archive
                source.seek(offset)
                ((fields, raw),) = records(iter([zlib.decompress(source.read(length), 31)]))
                block = raw[raw.index(b"\r\n\r\n") + 4 : -4]
                head, _, payload = block.partition(b"\r\n\r\n")
                said = fields["warc-payload-digest"].removeprefix("sha1:")
                size = int(_headers(head)["content-length"])
                if fields["warc-type"] == "response" and (len(payload), digest(payload)) != (size, said):
                    raise ValueError(f"record {fields['warc-record-id']} of {archive} doesn't match its digest")
                out.append((number(fields["warc-record-id"]), size, said, fields["warc-type"], number(fields.get("warc-refers-to")), payload))
                held += len(payload)
                if held >= READ_BYTES or len(out) >= READ_ROWS:
                    yield table(out)
                    out, held = [], 0
        if out:
            yield table(out)
        if source is not None:
            source.close()

    ddl = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"
    return in_arrow(index.select("archive", "offset", "length"), run, ddl)


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write, normalise and read back a page table."""
    root = f"{scratch(pages.sparkSession)}/factweave/warc-{uuid.uuid4().hex}"
    raw, clean = os.path.join(root, "raw"), os.path.join(root, "clean")
    index = normalise(write_archives(mark_revisits(pages, min_bytes), raw), raw, clean)
    return read_archives(index, clean)
