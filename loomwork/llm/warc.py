"""WARC archives with a two-level capture index.

Pages become WARC/1.1 records, one gzip member each, in files of bounded size. The index has a line for each capture,
sorted by (reversed-host URL key, page_id), in zlib-compressed blocks; each index file ends with a sparse directory of
its blocks' first keys. A lookup bisects the first keys of the files, then the directory of one file, then the lines of
one block, and reads the record's byte range from the archive.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import TEXT_ROWS, new_folder, stage
from loomwork.llm.files import Output, reader

#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 100
#: An archive is closed at so many bytes; index blocks have so many lines; a hot payload is dealt to so many tasks.
ARCHIVE_BYTES, BLOCK_LINES, SALT = 1 << 27, 3000, 16
#: Records next to each other in an archive are read together up to so many bytes.
READ_BYTES = 1 << 22
#: Records are dealt to reading tasks in stretches of so many bytes of an archive, a task for each as far as there are
#: MOST_TASKS; the numbers are fixed before, since locators are too small to tell their work.
STRETCH, MOST_TASKS = 1 << 21, 20_000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL name space of RFC 4122
_URL = re.compile(r"^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#]*@)?([^/?#:]*)(:\d+)?([^#]*)", re.I | re.S)
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
#: Stands for a null page_id in keys: before all others.
NO_PAGE = -(1 << 63)


def url_key(url: str | None) -> str:
    """The host reversed by commas, then ``)`` and path and query: captures of a host and its subdomains sort together."""
    if url is None:
        return "-"
    m = _URL.match(url)
    if not m:
        return _CONTROL.sub("%20", url)
    host = ",".join(reversed(m[1].lower().rstrip(".").split(".")))
    return _CONTROL.sub("%20", host + (m[2] or "") + ")" + (m[3] or "/"))


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}')}>"


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record, gzipped by itself. A revisit keeps the headers and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_CONTROL.sub(lambda m: f'%{ord(m[0]):02X}', url or '')}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + gz.flush()


def parse(data: bytes) -> dict:
    """The fields of a gzipped record; the payload's digest is computed anew and must be the one in the header."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    field = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(field["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = field["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = field["WARC-Type"]
    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError("a payload doesn't have its digest")
    number = lambda k: int(field[k]) if k in field else None
    return {
        "page_id": number("X-Page-Id"),
        "payload_bytes": int(re.search(rb"Content-Length: (\d+)", http)[1]),
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": number("X-Refers-To-Page-Id"),
        "url": field["WARC-Target-URI"],
        "payload": payload,
    }


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record for every row; returns the captures: key, page, name, offset, length.

    Of equal payloads of at least LEAST_BYTES the smallest page_id is the response and the others revisit it; rows that
    repeat that page_id are responses too. Payload digests meet in map-side minima; only digests that occur more than
    once are joined back, dealt by a salt, so a payload that a third of all pages share is no task of its own.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    own = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload")).withColumns(
        {"digest": F.sha2("payload", 256), "salt": F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT))}
    )
    big = own.where(F.octet_length("payload") >= LEAST_BYTES)
    firsts = big.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    dealt = firsts.select("digest", "first", F.explode(F.expr(f"sequence(0L, {SALT - 1}L)")).alias("salt"))
    joined = own.join(dealt.hint("shuffle_hash"), ["digest", "salt"], "left")
    rows = joined.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for b in batches:
            found = []
            for page_id, url, data, digest, refers_to in zip(*(b.column(k).to_pylist() for k in range(5))):
                if out is None or out.size >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    out = Output(folder, "archive", ".warc.gz")
                packed = record(page_id, url, data, digest, refers_to)
                found.append((url_key(url), NO_PAGE if page_id is None else page_id, out.name, out.write(packed), len(packed)))
            yield pa.RecordBatch.from_pylist([dict(zip(_CAPTURE.names, x)) for x in found], schema=_CAPTURE)
        if out is not None:
            out.close()

    return stage(rows.mapInArrow(run, "key string, page long, name string, offset long, length long"), "captures", TEXT_ROWS)


_CAPTURE = pa.schema([("key", pa.string()), ("page", pa.int64()), ("name", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Writes the index files; returns one row a file: name, first_key, first_page, blocks, at (of its directory)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, directory, lines = None, [], []

        def flush() -> None:
            nonlocal lines
            block = zlib.compress("\n".join(json.dumps(x, ensure_ascii=False) for x in lines).encode())
            directory.append([lines[0][0], lines[0][1], out.write(block), len(block)])
            lines = []

        for b in batches:
            for line in zip(*(b.column(k).to_pylist() for k in range(5))):
                out = out or Output(folder, "index", ".cdx")
                lines.append(line)
                if len(lines) == block_lines:
                    flush()
        if lines:
            flush()
        if out:
            at = out.write(zlib.compress(json.dumps(directory, ensure_ascii=False).encode()))
            out.close()
            yield pa.RecordBatch.from_pylist(
                [{"name": out.name, "first_key": directory[0][0], "first_page": directory[0][1], "blocks": len(directory), "at": at}], schema=_FILE
            )

    ordered = captures.repartitionByRange("key", "page").sortWithinPartitions("key", "page", "name", "offset")
    return stage(ordered.mapInArrow(run, "name string, first_key string, first_page long, blocks long, at long"), "index")


_FILE = pa.schema([("name", pa.string()), ("first_key", pa.string()), ("first_page", pa.int64()), ("blocks", pa.int64()), ("at", pa.int64())])


class IndexFile:
    """One index file: its sparse directory in memory, one block at a time."""

    def __init__(self, folder: str, name: str, at: int):
        self.file = reader(folder, name)
        self.directory = json.loads(zlib.decompress(self.file.read_at(self.file.size() - at, at)))
        self.firsts = [(k, p) for k, p, *_ in self.directory]
        self.held: tuple[int, list] = (-1, [])

    def block(self, k: int) -> list:
        if self.held[0] != k:
            _, _, at, length = self.directory[k]
            self.held = (k, [json.loads(x) for x in zlib.decompress(self.file.read_at(length, at)).decode().split("\n")])
        return self.held[1]

    def find(self, key: str, page: int | None = None) -> Iterator[list]:
        """The captures of a key, or of a key and page: a bisection of the directory, then of a block."""
        want = (key, NO_PAGE if page is None else page)
        beyond = (lambda x: x[0] > key) if page is None else (lambda x: (x[0], x[1]) > want)
        k = max(0, bisect.bisect_left(self.firsts, want) - 1)
        while k < len(self.firsts) and not beyond(self.firsts[k]):
            lines = self.block(k)
            for i in range(bisect.bisect_left(lines, want, key=lambda x: (x[0], x[1])), len(lines)):
                if beyond(lines[i]):
                    return
                yield lines[i]
            k += 1


def locate(requests: DataFrame, index: DataFrame, folder: str) -> DataFrame:
    """name, offset, length of the captures of each request (key, page), by the two levels of the index.

    The first keys of the index files (one a write task) go to every task; directories and blocks are read by range.
    """
    files = sorted((r["first_key"], r["first_page"], r["name"], r["at"]) for r in index.collect())
    firsts = [(k, p) for k, p, *_ in files]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = zip(b.column(0).to_pylist(), b.column(1).to_pylist())
            part = [max(0, bisect.bisect_right(firsts, x) - 1) for x in keys]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part, pa.int32())], ["key", "page", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[int, IndexFile | None] = (-1, None)
        for b in batches:
            found = []
            for key, page, part in zip(*(b.column(k).to_pylist() for k in range(3))):
                if opened[0] != part:
                    opened = (part, IndexFile(folder, *files[part][2:]))
                found += opened[1].find(key, page)
            yield pa.RecordBatch.from_pylist([dict(zip(_CAPTURE.names, x)) for x in found], schema=_CAPTURE)

    if not files:
        return requests.sparkSession.createDataFrame([], "key string, page long, name string, offset long, length long")
    dealt = requests.select("key", "page").mapInArrow(choose, "key string, page long, part int").repartition(min(MOST_TASKS, len(files)), "part")
    return dealt.sortWithinPartitions("part", "key", "page").mapInArrow(run, "key string, page long, name string, offset long, length long")


def ranges(rows: Iterable[tuple[str, int, int]]) -> Iterator[tuple[str, int, list[int]]]:
    """(name, offset, lengths): runs of records that lie next to each other, up to READ_BYTES."""
    name, at, lengths = None, 0, []
    for n, offset, length in rows:
        if lengths and (n != name or offset != at + sum(lengths) or sum(lengths) + length > READ_BYTES):
            yield name, at, lengths
            lengths = []
        if not lengths:
            name, at = n, offset
        lengths.append(length)
    if lengths:
        yield name, at, lengths


def read_records(located: DataFrame, folder: str, total: int | None = None) -> DataFrame:
    """The fields of the located records, read from the archives by byte ranges. total: the bytes of all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = (None, None)
        for b in batches:
            out = []
            for name, at, lengths in ranges(zip(*(b.column(k).to_pylist() for k in range(3)))):
                if opened[0] != name:
                    opened = (name, reader(folder, name))
                data = opened[1].read_at(sum(lengths), at)
                start = 0
                for n in lengths:
                    out.append(parse(data[start : start + n]))
                    start += n
            yield pa.RecordBatch.from_pylist([{k: x[k] for k in _RECORD.names} for x in out], schema=_RECORD)

    stretch = F.floor(F.col("offset") / STRETCH).alias("stretch")
    tasks = () if total is None else (max(1, min(MOST_TASKS, total // STRETCH + 1)),)
    rows = located.select("name", "offset", "length", stretch).repartition(*tasks, "name", "stretch").sortWithinPartitions("name", "offset")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    return stage(rows.mapInArrow(run, schema), "records", 512)


_RECORD = pa.schema(
    [
        ("page_id", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("url", pa.string()),
    ]
)


def archived(pages: DataFrame) -> DataFrame:
    """Write the archives and their index, look every page up in the index and read its record back.

    One row per row of pages: page_id, payload_bytes, payload_digest, record_type, refers_to, url. A null html is an
    empty payload, a null url an empty one; a null page_id never is a response to others unless all copies lack one.
    An empty table gives an empty result. Rows that repeat key and page_id are all found.
    """
    folder = new_folder(pages.sparkSession, "warc")
    captures = write_archives(pages, folder)
    index = write_index(captures, folder)
    total = captures.agg(F.sum("length")).first()[0]
    return read_records(locate(captures.select("key", "page").distinct(), index, folder), folder, total)
