"""WARC archives: writing one gzip member per record, and a sequential reader.

Files are written by Spark's text writer through its commit protocol. It ends each row with a given line end; a gzip
member ends in the high byte of its length, 0 for members under 16 MiB, and that byte is the line end. Rows are runs of
members of up to CHUNK_BYTES; where a run's last member is larger, a small metadata record closes the run, so that the
file stays a plain run of gzip members. The reader decompresses incrementally and frames by content length.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equireach.llm.common import Scratch, join_counted, maybe_among

CHUNK_BYTES = 4_000_000
#: Rows of a file: its size stays under this many runs.
RUNS_PER_FILE = 24
READ_BYTES = 1 << 16
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
#: Fixed values of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(value: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{value}')}>"


def record(kind: str, headers: dict[str, object], block: bytes) -> bytes:
    """One record as one gzip member."""
    lines = [f"WARC-Type: {kind}", *(f"{k}: {_line(v)}" for k, v in headers.items() if v is not None), f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("WARC/1.1\r\n".encode() + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def _line(value: object) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in str(value))


def page_record(page_id: int | None, url: str | None, payload: bytes, of: int | None) -> bytes:
    key = "null" if page_id is None else page_id
    sha1 = digest(payload)
    head = {"WARC-Record-ID": _name(key), "WARC-Date": DATE, "WARC-Target-URI": url, "X-Page-ID": key, "WARC-Payload-Digest": f"sha1:{sha1}", "X-Payload-Length": len(payload)}
    if of is None:
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        return record("response", head | {"Content-Type": "application/http; msgtype=response"}, http + payload)
    http = b"HTTP/1.1 200 OK\r\n\r\n"
    return record("revisit", head | {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": _name(of), "X-Refers-To-Page": of, "Content-Type": "application/http; msgtype=response"}, http)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[bytes] = []
    size = 0

    def run() -> pa.RecordBatch:
        if held[-1][-1]:
            held.append(record("metadata", {"WARC-Record-ID": _name("end"), "WARC-Date": DATE}, b""))
        return pa.RecordBatch.from_pydict({"value": pa.array([b"".join(held)[:-1]], pa.binary())})

    for batch in batches:
        for page_id, url, html, of in zip(*(batch.column(i) for i in range(4)), strict=True):
            held.append(page_record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), of.as_py()))
            size += len(held[-1])
            if size >= CHUNK_BYTES:
                yield run()
                held.clear()
                size = 0
    if held:
        yield run()


def revisits(rows: DataFrame, least: int, scratch: Scratch) -> DataFrame:
    """(page_id, sha1, size, of) of the rows (page_id, sha1, size) whose payload, of `least` bytes or more, a smaller id has.

    No payload is read. Groups are counted on the map side, and the rows of a payload that very many pages have stay
    where they are.
    """
    keys = scratch.table(rows.where(F.col("size") >= least).select("page_id", "sha1", "size"), "keys")
    on = ["sha1", "size"]
    first = keys.groupBy(*on).agg(F.min("page_id").alias("of"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = join_counted(keys, scratch.table(first, "first"), on, "n", keys.count())
    return scratch.table(met.where("of < page_id").select("page_id", *on, "of").distinct(), "revisits")


def write(pages: DataFrame, path: str, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes a record for every row: a response, or a revisit of the smallest id with the same payload of `least` bytes or more.

    A null payload is empty, a null url leaves the header out; a row with a null id is a response. Rows that repeat an id
    are written each, decided by their own payloads; several rows of a payload's smallest id are all responses. Payloads
    are equal when length and SHA-1 are. Only rows that may be revisits are shuffled.
    """
    scratch = Scratch(pages.sparkSession, "warc-write")
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"), F.octet_length(html).alias("size"))
    again = revisits(rows, least, scratch)
    told = maybe_among(rows, "page_id", again, "page_id", "maybe")
    new = told.where("NOT maybe").select("page_id", "url", "html", F.lit(None).cast("long").alias("of"))
    old = told.where("maybe").join(again, ["page_id", "sha1", "size"], "left").select("page_id", "url", "html", "of")
    members = new.unionByName(old).mapInArrow(_members, "value binary")
    members.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", RUNS_PER_FILE).text(path)
    scratch.close()


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive, in order; ValueError where framing or compression is broken."""
    view, at = memoryview(content), 0
    while at < len(view):
        inflate, data = zlib.decompressobj(31), bytearray()
        while not inflate.eof:
            piece = view[at : at + READ_BYTES]
            if not piece:
                raise ValueError("the archive ends inside a record")
            data += inflate.decompress(piece)
            at += len(piece) - len(inflate.unused_data)
        end = data.find(b"\r\n\r\n")
        lines = data[:end].decode().split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/1."):
            raise ValueError("no record where one should begin")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        size = int(headers["Content-Length"])
        if len(data) != end + 4 + size + 4 or data[-4:] != b"\r\n\r\n":
            raise ValueError(f"{headers.get('WARC-Record-ID')}: the content length is wrong")
        yield headers, bytes(data[end + 4 : end + 4 + size])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split(" ")[0] for f in READ.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for batch in batches:
        for content in batch.column(0):
            out: list[list] = [[] for _ in names]
            for headers, block in records(content.as_py()):
                kind = headers["WARC-Type"]
                if kind not in ("response", "revisit"):
                    continue
                said, size = headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["X-Payload-Length"])
                if kind == "response":
                    payload = block.partition(b"\r\n\r\n")[2]
                    if digest(payload) != said or len(payload) != size:
                        raise ValueError(f"{headers['WARC-Record-ID']}: the payload's digest is wrong")
                page = headers["X-Page-ID"]
                of = headers.get("X-Refers-To-Page")
                for column, x in zip(out, (None if page == "null" else int(page), size, said, kind, of and int(of)), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record; fails where a digest does."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return files.select("content").mapInArrow(_read, READ)


def round_trip(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the archives to the shared folder and returns what they hold. An empty table gives an empty result."""
    scratch = Scratch(pages.sparkSession, "warc")
    write(pages, scratch.path("archives"), least, id_col, url_col, html_col)
    return read(pages.sparkSession, scratch.path("archives"))
