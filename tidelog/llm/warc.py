"""WARC archives of pages with revisit records, and a reader that salvages damaged ones."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.files import new_file, open_fs
from tidelog.stage import Stage

MANIFEST = "path string, records long, bytes long"
RECORDS = "path string, start long, stop long, kind string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, note string"
_READ, _ROLL, _LEVEL, _HEAD, _LOOK = 1 << 20, 256 << 20, 3, 1 << 16, 1 << 16
_ID = "urn:tidelog:page:"
_GZIP, _VERSION, _LINE = b"\x1f\x8b\x08", b"WARC/1.", re.compile(rb"WARC/1\.\d{1,3}\r\n")


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _clean(value: str) -> str:
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record; a revisit keeps the HTTP header, with the payload's length, but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = lambda i: f"<{_ID}{'' if i is None else i}>"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name(page_id)}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {_clean(url)}"] if url is not None else []),
        *([f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{sha1}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, stage: Stage, min_revisit_bytes: int = 0, compress: bool = True) -> DataFrame:
    """Write a record for each page (page_id, url, html) and return the manifest, written as a table.

    Of pages with equal payloads of at least ``min_revisit_bytes`` bytes that with the largest
    page_id is a response record and the others revisit it. Rows repeated with that same page_id
    are responses too. A null html is an empty payload; a null page_id sorts below all others; a
    null url is left out. Payloads are compared by their SHA-1; the largest page_id of each is
    found before the shuffle of the pages, so a payload that many pages share is one small row.
    """
    folder = stage.path("archive")
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload")).withColumn("sha1", F.sha1("payload"))
    first = pages.select("page_id", F.sha1(F.encode(F.coalesce("html", F.lit("")), "utf-8")).alias("sha1")).groupBy("sha1").agg(F.max("page_id").alias("response_id"))
    revisit = ~F.col("page_id").eqNullSafe(F.col("response_id")) & (F.length("payload") >= min_revisit_bytes)
    rows = rows.join(first, "sha1").select("page_id", "url", "payload", "response_id", revisit.alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        row, part = next(rows, None), 0
        while row is not None:
            with new_file(folder, f"pages-{part}") as (stream, path):
                n = size = 0
                while row is not None and size < _ROLL:
                    page_id, url, payload, response, revisit = row
                    data = record_bytes(page_id, url, payload, digest(payload), response, revisit)
                    if compress:
                        data = gzip.compress(data, _LEVEL, mtime=0)
                    stream.write(data)
                    n, size, row = n + 1, size + len(data), next(rows, None)
            part += 1
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [n], "bytes": [size]})

    return stage.save(rows.mapInArrow(run, MANIFEST), "archives")


class _Bytes:
    """A file read forward in blocks; holds what lies between ``at`` and what was last asked for.

    ``size`` is the file's length if it is known.
    """

    def __init__(self, file, size: int | None = None):
        self.file, self.size, self.at, self.data, self.ended = file, size, 0, bytearray(), False

    def more(self) -> bool:
        block = b"" if self.ended else self.file.read(_READ)
        self.ended = not block
        self.data += block
        return bool(block)

    def need(self, n: int) -> bool:
        """Whether the file has n more bytes; if it has, they are held."""
        if self.size is not None and n > self.size - self.at:
            return False
        while len(self.data) < n and self.more():
            pass
        return len(self.data) >= n

    def find(self, start: int, most: int, *marks: bytes) -> int:
        """Where the first of the marks begins from ``start`` on and within about ``most`` bytes, or -1.

        They are looked for together in one short window that slides over what is held, so one
        that never occurs isn't looked for to the end.
        """
        longest, look = max(map(len, marks)), 1 << 9
        while start <= most:
            if len(self.data) < start + longest and not self.more() and len(self.data) <= start:
                return -1
            to = min(len(self.data), start + look + longest - 1)
            found = [i for m in marks if (i := self.data.find(m, start, to)) >= 0]
            if found:
                return min(found)
            if to == len(self.data) and not self.more():
                return -1
            start, look = max(start, to - longest + 1), min(2 * look, _LOOK)
        return -1

    def skip(self, n: int) -> None:
        del self.data[:n]
        self.at += n

    def skip_to(self, *marks: bytes) -> None:
        """Go on to the first of the marks behind this place, or to the end.

        What was passed isn't held.
        """
        self.skip(1)
        while self.data or self.more():
            if (i := self.find(0, _LOOK, *marks)) >= 0:
                return self.skip(i)
            if self.ended:
                return self.skip(len(self.data))
            self.skip(max(1, min(_LOOK, len(self.data) - max(map(len, marks)) + 1)))


def _headers(text: bytes) -> dict[str, str]:
    out = {}
    for line in text.decode("utf-8", "replace").split("\r\n")[1:]:
        key, sep, value = line.partition(":")
        if sep:
            out[key.strip().lower()] = value.strip()
    return out


def _parse(data: bytes) -> tuple[dict, int]:
    """The record at the start of data, checked, and its length. ValueError says what is wrong with it."""
    if not data.startswith(_VERSION):
        raise ValueError("no version line")
    if (end := data.find(b"\r\n\r\n")) < 0:
        raise ValueError("header without end")
    head = _headers(data[:end])
    if not (length := head.get("content-length", "")).isdigit():
        raise ValueError("no content length")
    stop = end + 4 + int(length)
    block = data[end + 4 : stop]
    if len(block) < int(length) or data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("record is cut short")
    want = head.get("warc-block-digest", "")
    if want.startswith("sha1:") and digest(block) != want[5:]:
        raise ValueError("block digest differs")
    http, sep, payload = block.partition(b"\r\n\r\n")
    kind, said = head.get("warc-type", ""), head.get("warc-payload-digest", "").removeprefix("sha1:")
    row = {"url": head.get("warc-target-uri"), "record_type": kind, "page_id": _number(head.get("warc-record-id")), "refers_to": _number(head.get("warc-refers-to"))}
    if kind == "revisit":
        size = _headers(http).get("content-length", "")
        row |= {"payload_bytes": int(size) if size.isdigit() else None, "payload_digest": said or None}
    else:
        row |= {"payload_bytes": len(payload if sep else block), "payload_digest": digest(payload if sep else block)}
        if said and said != row["payload_digest"]:
            raise ValueError("payload digest differs")
    return row, stop + 4


def _number(name: str | None) -> int | None:
    value = (name or "").strip("<>").removeprefix(_ID)
    return int(value) if value.lstrip("-").isdigit() else None


def _member(source: _Bytes) -> tuple[bytes, int]:
    """The gzip member at the start: its content and its compressed length."""
    inflate, out, fed, step = zlib.decompressobj(31), [], 0, 1 << 14
    while not inflate.eof:
        if fed >= len(source.data) and not source.more():
            raise ValueError("member is cut short")
        part = bytes(source.data[fed : fed + step])
        try:
            out.append(inflate.decompress(part))
        except zlib.error as e:
            raise ValueError(f"member is damaged: {e}") from None
        fed, step = fed + len(part), min(2 * step, _READ)
    return b"".join(out), fed - len(inflate.unused_data)


def _plain(source: _Bytes) -> tuple[dict, int]:
    """The uncompressed record at the start, reading on until it is whole; its header has at most some 64 KB."""
    if not source.need(12) or not _LINE.match(source.data):
        raise ValueError("no version line")
    end = source.find(0, _HEAD, b"\r\n\r\n", b"\r\n" + _VERSION)  # a record that begins within the header ends it
    if end >= 0 and source.data.startswith(b"\r\n\r\n", end):
        length = _headers(bytes(source.data[:end])).get("content-length", "")
        if length.isdigit():
            if not source.need(end + 8 + int(length)):
                raise ValueError("record is cut short")
            return _parse(bytes(source.data[: end + 8 + int(length)]))
    raise ValueError("no readable header")


def salvage(file, size: int | None = None) -> Iterator[dict]:
    """Records of an archive, compressed by record or not, and the gaps that could not be read.

    A record that fails a check (gzip, version line, length, block or payload digest) is
    quarantined from its start to the next place where a record passes all checks; each gap is
    given as a row with the reason. Memory is that of the largest record: between records the file
    passes through a window, and with the file's ``size`` a damaged length that leads beyond the
    end isn't followed.
    """
    source, bad, why = _Bytes(file, size), None, ""
    while source.need(1):
        try:
            if source.need(3) and source.data.startswith(_GZIP):
                data, size = _member(source)
                row, used = _parse(data)
                if used != len(data):
                    raise ValueError("member holds more than a record")
            else:
                row, size = _plain(source)
        except ValueError as e:
            if bad is None:
                bad, why = source.at, str(e)
            source.skip_to(_GZIP, _VERSION)
            continue
        if bad is not None:
            yield {"start": bad, "stop": source.at, "kind": "gap", "note": why}
            bad = None
        yield row | {"start": source.at, "stop": source.at + size, "kind": "record"}
        source.skip(size)
    if bad is not None:
        yield {"start": bad, "stop": source.at, "kind": "gap", "note": why}


def read_archives(manifest: DataFrame) -> DataFrame:
    """Rows of all archives of the manifest: records (kind ``record``) and quarantined gaps (kind ``gap``)."""
    schema = pa.schema([(x.split()[0], pa.int64() if x.endswith("long") else pa.string()) for x in RECORDS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, local = open_fs(path)
                with store.open_input_file(local) as file:
                    rows = []
                    for row in salvage(file, file.size()):
                        rows.append({name: row.get(name) for name in schema.names} | {"path": path})
                        if len(rows) == 2000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    return manifest.select("path").repartition(max(1, manifest.count()), "path").mapInArrow(run, RECORDS)
