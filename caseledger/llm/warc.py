"""WARC archives with a two-level capture index.

Each task writes archives of gzip members, one per record, and tells where each record
is. The captures are sorted by reversed-host URL key and page; each range of them is
written as compressed blocks of lines (first level), beside a sparse directory with the
first key and the place of every block (second level). A lookup finds the range among
their first keys, binary-searches that range's directory file by range reads, reads one
block, searches it, and range-reads the record. Nothing is loaded whole.

Files are written through Arrow's file systems into a folder all executors share, first
under a name of their own and then moved, so a task that runs twice leaves the same file.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import re
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseledger.operators.skew import join_back
from caseledger.storage import new_folder, stored

LEAST_REVISIT = 100  # bytes from which an equal payload is not stored again
LINES = 1_000  # captures in a block
IN_RANGE = 50_000  # captures in a range of the index, about
IN_TASK = 10_000  # captures that a task looks up, about
FILE_BYTES = 1 << 30  # an archive is closed beyond this
DATE = "1970-01-01T00:00:00Z"  # the tables carry no capture time
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def url_key(url: str | None) -> str:
    """``com,example,sub)/path?query``: host reversed, lower case, without ``www`` and port.

    Null and empty URLs have the empty key.
    """
    if not url:
        return ""
    rest = url.partition("#")[0].strip()
    scheme, sep, after = rest.partition("://")
    rest = after if sep else rest
    cut = min((i for i in (rest.find(c) for c in "/?") if i >= 0), default=len(rest))
    host, path = rest[:cut].rpartition("@")[2].lower(), rest[cut:]
    host, _, port = host.partition(":")
    if port and port != {"http": "80", "https": "443"}.get(scheme.lower(), "80"):
        port = f":{port}"
    else:
        port = ""
    host = re.sub(r"^www\d*\.", "", host)
    path = path if path.startswith("/") else "/" + path
    return _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", ",".join(reversed(host.split("."))) + port + ")" + path)


def capture_key(url: str | None, page: int | None) -> str:
    """Key of a capture: the URL's, then the page as a number of fixed width (null: none)."""
    return url_key(url) + " " + ("" if page is None else f"{page + (1 << 63):020d}")


def opened(folder: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", folder))


def record(page: int | None, url: str | None, payload: bytes, digest: str, first: int | None, size: int) -> bytes:
    """One record; ``first`` is the page whose payload a revisit repeats."""
    http = _HTTP % size
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: <urn:x-page:{'' if page is None else page}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url:
        head.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if first is not None:
        head += [f"WARC-Refers-To: <urn:x-page:{first}>", f"WARC-Profile: {_PROFILE}"]
        payload = b""
    head.append(f"Content-Length: {len(http) + len(payload)}")
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def parse(raw: bytes) -> dict[str, object]:
    """Page, type, payload size and digest and reference of a record, checked against its digest."""
    head, _, body = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    body = body[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    page = fields["WARC-Record-ID"][len("<urn:x-page:") : -1]
    kind, first = fields["WARC-Type"], None
    if kind == "revisit":
        first = int(fields["WARC-Refers-To"][len("<urn:x-page:") : -1])
    elif len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"the payload of page {page} differs from its digest")
    return {
        "page_id": int(page) if page else None,
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": first,
    }


class SharedFile:
    """One file, visible under its name when it is complete."""

    def __init__(self, folder: str, name: str) -> None:
        self.fs, self.folder = opened(folder)
        self.name, self.place = name, 0
        self.own = f"{self.folder}/.{name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.own)

    def put(self, data: bytes) -> tuple[int, int]:
        at, self.place = self.place, self.place + len(data)
        self.out.write(data)
        return at, len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.own, f"{self.folder}/{self.name}")


_CAPTURE = "key string, page_id bigint, file string, at bigint, size bigint, kind string, digest string"


def _archive(folder: str):
    names = [c.split()[0] for c in _CAPTURE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, out = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                told = []
                for page, url, html, digest, first in zip(
                    *(c.to_pylist() for c in batch.slice(k, 200).columns), strict=True
                ):
                    if out is None:
                        out = SharedFile(folder, f"part-{part:06d}-{count:04d}.warc.gz")
                        out.put(gzip.compress(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x-info:"
                                              + out.name.encode() + b">\r\nWARC-Date: " + DATE.encode()
                                              + b"\r\nContent-Length: 0\r\n\r\n\r\n\r\n", mtime=0))
                    payload = (html or "").encode("utf-8")
                    raw = record(page, url, payload, digest, first, len(payload))
                    at, size = out.put(gzip.compress(raw, 6, mtime=0))
                    kind = "response" if first is None else "revisit"
                    told.append((capture_key(url, page), page, out.name, at, size, kind, digest))
                    if out.place > FILE_BYTES:
                        out.close()
                        out, count = None, count + 1
                columns = list(zip(*told, strict=True)) or [[] for _ in names]
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names
                )
        if out is not None:
            out.close()

    return run


def _blocks(folder: str):
    """Sorted captures to blocks and their directory; tells the range's first key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        block, entries, index = [], None, None
        first = None

        def flush() -> None:
            at, size = index.put(gzip.compress("".join(line for _, line in block).encode("utf-8"), 6, mtime=0))
            entries.put(f"{block[0][0]}\t{at}\t{size}\n".encode())
            block.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if index is None:
                    first = row[0]
                    index = SharedFile(folder, f"cdx-{part:06d}.gz")
                    entries = SharedFile(folder, f"cdx-{part:06d}.idx")
                block.append((row[0], "\t".join("" if x is None else str(x) for x in row) + "\n"))
                if len(block) == LINES:
                    flush()
        if index is not None:
            if block:
                flush()
            index.close()
            entries.close()
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([f"cdx-{part:06d}"])], names=["key", "name"])

    return run


@dataclass(frozen=True)
class Archive:
    """Where the archives and their index are; one (first key, name) for each range."""

    folder: str
    ranges: tuple[tuple[str, str], ...]
    captures: int


class Reader:
    """Lookups by capture key; keeps some open files and the last block."""

    def __init__(self, archive: Archive) -> None:
        self.fs, self.folder = opened(archive.folder)
        self.firsts = [k.encode() for k, _ in archive.ranges]
        self.names = [n for _, n in archive.ranges]
        self.files: OrderedDict[str, tuple[pa.NativeFile, int]] = OrderedDict()
        self.block: tuple[object, list[list[bytes]]] = (None, [])

    def _file(self, name: str) -> tuple[pa.NativeFile, int]:
        if name not in self.files:
            if len(self.files) >= 32:
                self.files.popitem(last=False)[1][0].close()
            file = self.fs.open_input_file(f"{self.folder}/{name}")
            self.files[name] = (file, file.size())
        self.files.move_to_end(name)
        return self.files[name]

    def _line(self, name: str, at: int) -> tuple[int, bytes]:
        """The directory line that begins at or after a byte, and where it begins."""
        file, size = self._file(name)
        begin = max(0, at - 1)
        data = b""
        while True:
            data += file.read_at(min(512, size - begin - len(data)), begin + len(data))
            start = 0 if at == 0 else data.find(b"\n") + 1
            end = data.find(b"\n", start) if at == 0 or start else -1
            if end >= 0:
                return begin + start, data[start:end]
            if begin + len(data) >= size:
                return size, b""

    def _entry(self, name: str, key: bytes) -> tuple[int, bytes]:
        """The last directory line whose key is not above ``key`` (or the first line)."""
        low, high = 0, self._file(name)[1]
        best = self._line(name, 0)
        while low < high:
            middle = (low + high) // 2
            at, line = self._line(name, middle)
            if line and line.split(b"\t", 1)[0] <= key:
                best, low = (at, line), at + len(line) + 1
            else:
                high = middle
        return best

    def _rows(self, name: str, line: bytes) -> list[list[bytes]]:
        if self.block[0] != (name, line):
            _, at, size = line.split(b"\t")
            data = self._file(f"{name}.gz")[0].read_at(int(size), int(at))
            self.block = ((name, line), [r.split(b"\t") for r in gzip.decompress(data).splitlines()])
        return self.block[1]

    def captures(self, key: str) -> Iterator[list[bytes]]:
        """Index lines of a key, also where they go on in the next block or range."""
        want = key.encode("utf-8")
        part = max(0, bisect.bisect_left(self.firsts, want) - 1)
        while part < len(self.names) and (part == 0 or self.firsts[part] <= want):
            name = self.names[part]
            at, line = self._entry(f"{name}.idx", want)
            at, line = self._back(f"{name}.idx", at, line, want)
            while line:
                rows = self._rows(name, line)
                lo = bisect.bisect_left(rows, want, key=lambda r: r[0])
                for row in rows[lo:]:
                    if row[0] != want:
                        break
                    yield row
                if rows[-1][0] > want:
                    return
                at, line = self._line(f"{name}.idx", at + len(line) + 1)
                if line and line.split(b"\t", 1)[0] > want:
                    return
            part += 1

    def _back(self, name: str, at: int, line: bytes, want: bytes) -> tuple[int, bytes]:
        """Steps back while a block begins with the very key, as the key may begin before."""
        while at > 0 and line.split(b"\t", 1)[0] == want:
            before = max(0, at - 2)
            while before > 0 and self._file(name)[0].read_at(1, before - 1) != b"\n":
                before -= 1
            at, line = self._line(name, before)
        return at, line

    def read(self, row: list[bytes]) -> bytes:
        data = self._file(row[2].decode())[0].read_at(int(row[4]), int(row[3]))
        return zlib.decompress(data, 31)


def write(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_REVISIT) -> Archive:
    """Write one record per row into a new shared folder, with its capture index.

    Of rows with equal payloads (the text in UTF-8, null as empty) of ``least`` bytes or
    more, that of the smallest id is a response and the others are revisits of it. A row
    without an id is a response. Rows that repeat an id and payload are all what the
    first of them is. Control characters in URLs are percent-encoded.
    """
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    system, path = opened(folder)
    system.create_dir(path, recursive=True)
    rows = pages.select(
        F.col(id).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.coalesce(html, F.lit("")).alias("html")
    )
    large = F.octet_length("html") >= least
    rows = rows.withColumn("digest", F.sha2("html", 256))
    alone = F.concat_ws("-", F.lit("page"), "page_id", F.xxhash64("url"))  # small payloads meet nobody
    rows = rows.withColumn("same", F.when(large & F.col("page_id").isNotNull(), F.col("digest")).otherwise(alone))
    firsts = rows.filter(large & F.col("page_id").isNotNull()).groupBy("same").agg(F.min("page_id").alias("first"))
    dealt = join_back(rows, firsts, "same", "left").select(
        "page_id", "url", "html", "digest", F.when(F.col("first") < F.col("page_id"), F.col("first")).alias("first")
    )
    dealt = dealt.sortWithinPartitions("page_id", "url", "digest")
    captures = stored(dealt.mapInArrow(_archive(folder), _CAPTURE), "captures")
    held = captures.count()
    # so many ranges that keys of any length make several; a given number is not merged again
    ordered = captures.repartitionByRange(-(-held // IN_RANGE) or 1, "key", "file", "at").sortWithinPartitions("key", "file", "at")
    ranges = ordered.mapInArrow(_blocks(folder), "key string, name string").collect()
    return Archive(folder, tuple(sorted((r.key, r.name) for r in ranges)), held)


_FOUND = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url_key string"


def lookup(keys: DataFrame, archive: Archive, key: str = "key") -> DataFrame:
    """What the records of each capture key hold; a key without captures gives no row.

    Keys are looked up in their order, so neighbours find their block already read.
    """
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    names = [c.split()[0] for c in _FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(archive)
        for batch in batches:
            found = []
            for k in batch.column(0).to_pylist():
                for row in reader.captures(k):
                    found.append(parse(reader.read(row)) | {"url_key": k.rpartition(" ")[0]})
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[n] for f in found], t) for n, t in zip(names, kinds, strict=True)], names=names
            )

    asked = keys.select(F.col(key).alias("key")).filter("key is not null").distinct()
    tasks = -(-archive.captures // IN_TASK) or 1
    return asked.repartitionByRange(tasks, "key").sortWithinPartitions("key").mapInArrow(run, _FOUND)


def keyed(pages: DataFrame, id: str = "page_id", url: str = "url") -> DataFrame:
    """Capture keys of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([capture_key(u, p) for u, p in pairs], pa.string())], names=["key"])

    return pages.select(F.col(id).cast("bigint").alias("p"), F.col(url).alias("u")).mapInArrow(run, "key string")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, then read every record back through the index."""
    archive = write(pages)
    return lookup(keyed(pages), archive)
