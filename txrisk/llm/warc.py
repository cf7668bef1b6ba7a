"""WARC archives: a writer that stores equal payloads once, and a splittable reader.

Writing. Every page is one record in a gzip member of its own. Of records with equal payloads of at least
``min_bytes`` bytes, that with the largest page id is a response and the others are revisits that refer to it. Tasks
write files with names of their own and list them in a manifest; only files listed there are ever read, so a
task that is run twice leaves a stray file and no wrong record.

Reading. A file is cut into byte ranges. A task scans its range for the gzip magic, tries each candidate by decoding
the first bytes of the member, which have to be a WARC version line, and owns the records that start inside its range,
to their ends beyond it. Payload digests are recomputed and have to agree with the headers.

The folder is named by a URI, and files are opened through Arrow's file systems, which know local and
shared folders and the common object stores.

Defined cases: null html is an empty payload; a null page id is written without one and never the one referred to, unless
all ids of its group are null, and then all of them are responses; rows that repeat the largest page id are all
responses; a null url is left out; an empty table writes nothing and reads as no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.llm.common import materialise, salt_of, with_group_facts
from txrisk.session import new_path

MIN_BYTES = 0
ARCHIVE_BYTES = 1 << 30
SPLIT_BYTES = 8 << 20
BLOCK = 1 << 18
MAGIC = b"\x1f\x8b\x08"
_ID = "urn:x-page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "path string, bytes bigint, records bigint"
_RECORD = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()),
])
_RECORD_SQL = (
    "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary"
)


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP head, with the length of the payload, and not the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_ID}{page_id}>" if page_id is not None else f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=_URL_SAFE)}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_URL_SAFE = "".join(chr(c) for c in range(0x21, 0x7F) if chr(c) != "%")


def planned(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, url, payload, refers_to): which records are revisits.

    Groups of equal payloads are summed up per cell first, so a payload that a third of all pages share meets no
    single task.
    """
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("same", F.when(F.octet_length("payload") >= min_bytes, F.sha1("payload")))
    grouped = with_group_facts(
        rows, ["same"], salt_of(F.col("page_id"), F.col("url")),
        {"n": F.count(F.lit(1)), "top": F.max("page_id")}, {"n": F.sum("n"), "top": F.max("top")}, keep=F.col("n") > 1,
    )
    revisit = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    return grouped.select("page_id", "url", "payload", F.when(revisit, F.col("top")).alias("refers_to"))


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    min_bytes: int = MIN_BYTES, archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write all pages to ``folder``; the manifest (path, bytes, records) of the files written."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = open_folder(folder)
        system.create_dir(place, recursive=True)
        out, name, size, count = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "bytes": [size], "records": [count]})

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(k) for k in range(4))):
                if out is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{place}/{name}", compression=None)
                member = gzip.compress(record(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py()), 6, mtime=0)
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= archive_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return materialise(planned(pages, id_col, url_col, html_col, min_bytes).mapInArrow(write, _MANIFEST), "manifest")


class Window:
    """A file seen through a buffer that moves forward."""

    def __init__(self, file, at: int):
        self.file, self.at, self.buffer, self.ended = file, at, b"", False
        file.seek(at)

    def more(self) -> bool:
        got = b"" if self.ended else self.file.read(BLOCK)
        self.ended = not got
        self.buffer += got
        return bool(got)

    def skip(self, count: int) -> None:
        self.buffer = self.buffer[count:]
        self.at += count


def starts_record(data: bytes) -> bool:
    """Whether a gzip member that holds a WARC record starts here."""
    try:
        return zlib.decompressobj(31).decompress(data, 16).startswith(b"WARC/1.")
    except zlib.error:
        return False


def members(file, start: int, stop: int) -> Iterator[bytes]:
    """The contents of all members that start in [start, stop)."""
    window = Window(file, start)
    while True:
        found = window.buffer.find(MAGIC)
        if found < 0:
            window.skip(max(0, len(window.buffer) - len(MAGIC) + 1))
            if window.at >= stop or not window.more():
                return
            continue
        window.skip(found)
        if window.at >= stop:
            return
        while len(window.buffer) < 4096 and window.more():
            pass
        if not starts_record(window.buffer[:4096]):
            window.skip(1)
            continue
        decoder, parts = zlib.decompressobj(31), []
        while True:
            taken = len(window.buffer)
            parts.append(decoder.decompress(window.buffer))
            window.skip(taken - len(decoder.unused_data))
            if decoder.eof:
                break
            if not window.more():
                raise ValueError(f"the member before byte {window.at} is cut off")
        yield b"".join(parts)


def parsed(data: bytes) -> dict:
    """The fields of a record; raises if the payload does not have the digest it should."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = block[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    kind = fields["WARC-Type"]
    number = lambda value: int(value[len(_ID) + 1 : -1]) if value and value.startswith(f"<{_ID}") else None
    length = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    known = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != length or digest(payload) != known):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    url = fields.get("WARC-Target-URI")
    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": None if url is None else unquote(url), "record_type": kind,
        "refers_to": number(fields.get("WARC-Refers-To")), "payload_digest": known, "payload_bytes": length,
        "payload": payload if kind == "response" else None,
    }


def read_archives(spark: SparkSession, manifest: DataFrame, split_bytes: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """All records of the files in ``manifest`` (path, bytes): page_id, url, record_type, refers_to, digest, size, payload."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, stop in zip(*(batch.column(k).to_pylist() for k in range(3))):
                system, place = open_folder(path)
                rows, held = [], 0
                with system.open_input_file(place) as file:
                    for data in members(file, start, stop):
                        row = parsed(data)
                        if not with_payload:
                            row["payload"] = None
                        rows.append(row)
                        held += len(data) if with_payload else 500
                        if held > BLOCK * 16:
                            yield pa.RecordBatch.from_pylist(rows, _RECORD)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, _RECORD)

    size = F.lit(split_bytes).cast("long")
    ranges = manifest.filter("bytes > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, size)).alias("start"))
    ranges = ranges.select("path", "start", (F.col("start") + size).alias("stop"))
    # As many tasks as ranges, by number: the rows of ranges are short, and adaptive planning would put them together.
    tasks = manifest.agg(F.sum(F.ceil(F.col("bytes") / size))).first()[0] or 1
    return ranges.repartition(int(tasks)).mapInArrow(read, _RECORD_SQL)


def round_trip(pages: DataFrame, with_payload: bool = False, **columns: str) -> DataFrame:
    """Write ``pages`` to a new folder of the shared work folder and read the archives back."""
    folder = new_path(pages.sparkSession, "warc")
    return read_archives(pages.sparkSession, write_archives(pages, folder, **columns), with_payload=with_payload)
