"""WARC archives: writing, and reading as a chunked record table.

Reading streams each archive: a payload becomes rows of at most CHUNK bytes, numbered within its
record, and each row carries the digest and length of the payload up to its end; nothing holds
a whole record. Writing puts one gzip member a record into files of the shared folder through
its own file system; a task that is run again writes files of another name, and only those that
a finished task names are read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, new_path, table, written

CHUNK, ROLL = 1 << 20, 64 << 20
CHUNK_SCHEMA = "archive string, record_no long, record_id string, record_type string, uri string, page_id long, refers_to long, declared_digest string, declared_bytes long, chunk_no int, data binary, bytes_so_far long, digest_so_far string, last boolean, error string"
_NAMES = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _line(x: str) -> str:
    """A header value on one line."""
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode()) for c in x)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, n_bytes: int, first: int | None, date: str) -> Iterator[bytes]:
    """A record's bytes, before compression: a revisit if ``first`` is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n_bytes
    kind = "response" if first is None else "revisit"
    body = payload if first is None else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id} {digest} {url}')}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {n_bytes}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if first is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {first}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(body)}", "", ""]
    yield "\r\n".join(head).encode() + http
    for i in range(0, len(body), CHUNK):
        yield body[i : i + CHUNK]
    yield b"\r\n\r\n"


def mark_revisits(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """(page_id, url, html, ...) -> page_id, url, html, n_bytes, digest, first (the response's page_id for revisits).

    Equal payloads are found by SHA-256 on narrow rows, of which a partial minimum leaves one a
    digest and task. Rows that share the smallest page_id are all responses; a null page_id is
    never the one referred to. Rows of a payload that very many share meet its first one in several
    tasks. Null html: an empty payload. Extra columns are ignored; an empty
    table gives an empty result.
    """
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("digest"))
    firsts = written(p.where(f"n_bytes >= {least_bytes} and page_id is not null").groupBy("digest").agg(F.min("page_id").alias("low"), F.count("*").alias("m")).where("m > 1"), "warc-firsts")
    return join_hot(p, firsts, "digest", "m", "page_id", "left").select("page_id", "url", "html", "n_bytes", "digest", F.when(F.coalesce(F.col("page_id") != F.col("low"), F.col("low").isNotNull()), F.col("low")).alias("first"))


def write_warc(marked: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write archives under ``path``; a row (archive, records) for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _file_system(path)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        out, n, done, names = None, 0, 0, []

        def close() -> None:
            nonlocal out, n
            if out is not None:
                out.close()
                names[-1][1] = n
            out, n = None, 0

        for b in batches:
            cols = [b.column(c) for c in ("page_id", "url", "html", "n_bytes", "digest", "first")]
            for i in range(b.num_rows):
                page_id, url, html, n_bytes, digest, first = (c[i].as_py() for c in cols)
                if out is None:
                    name = f"part-{task.partitionId() if task else 0:05d}-{uuid.uuid4().hex}.warc.gz"
                    out, done = store.open_output_stream(f"{root}/{name}", compression=None), 0
                    names.append([f"{path}/{name}", 0])
                z = zlib.compressobj(1, zlib.DEFLATED, 31)
                for piece in record(page_id, url, html.encode(), digest, n_bytes, first, date):
                    done += out.write(z.compress(piece)) or 0
                tail = z.flush()
                out.write(tail)
                done = out.tell()
                n += 1
                if done >= ROLL:
                    close()
        close()
        if names:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in names]), pa.array([k for _, k in names], pa.int64())], ["archive", "records"])

    return written(marked.mapInArrow(run, "archive string, records long"), "warc-names")


class _Stream:
    """Decompressed bytes of concatenated gzip members (or of a plain file), a bounded piece at a time."""

    def __init__(self, raw, zipped: bool):
        self.raw, self.z, self.buffer, self.rest = raw, zlib.decompressobj(31) if zipped else None, b"", b""

    def more(self) -> bool:
        while True:
            if not self.rest:
                self.rest = self.raw.read(CHUNK)
                if not self.rest:
                    return False
            if self.z is None:
                self.buffer, self.rest = self.buffer + self.rest, b""
                return True
            got = self.z.decompress(self.rest, CHUNK)
            self.rest = self.z.unconsumed_tail
            if self.z.eof:
                self.rest = self.z.unused_data
                self.z = zlib.decompressobj(31)
            if got:
                self.buffer += got
                return True

    def until(self, mark: bytes, most: int = 1 << 20) -> bytes | None:
        while (i := self.buffer.find(mark)) < 0:
            if len(self.buffer) > most:
                raise ValueError("a header has no end")
            if not self.more():
                return None
        out, self.buffer = self.buffer[: i + len(mark)], self.buffer[i + len(mark) :]
        return out

    def take(self, most: int) -> bytes:
        if not self.buffer and not self.more():
            raise ValueError("the archive ends within a record")
        out, self.buffer = self.buffer[:most], self.buffer[most:]
        return out


def chunks(archive: str) -> Iterator[tuple]:
    """Rows of CHUNK_SCHEMA of one archive. One that is cut off or broken ends with a row that has ``error``, without data."""
    store, path = _file_system(archive)
    at: list = [archive, 0, *[None] * 7]
    with store.open_input_stream(path, compression=None) as raw:
        try:
            yield from _chunks(_Stream(raw, archive.endswith(".gz")), archive, at)
        except (ValueError, KeyError, zlib.error, EOFError) as e:
            yield (*at, None, None, None, None, True, f"{type(e).__name__}: {e}")


def _chunks(s: _Stream, archive: str, at: list) -> Iterator[tuple]:
    """``at`` has the archive, number and headers of the record being read."""
    no = 0
    while (head := s.until(b"\r\n\r\n")) is not None:
        h = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:]) if k}
        left = int(h["content-length"])
        if "application/http" in h.get("content-type", ""):
            left -= len(s.until(b"\r\n\r\n") or b"")
        if left < 0:
            raise ValueError("a record is shorter than its own headers")
        number = lambda k: int(h[k]) if k in h else None
        own = (archive, no, h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), number("x-page-id"), number("x-refers-to-page"), h.get("warc-payload-digest"), number("x-payload-length"))
        at[:] = own
        sha, total, k = hashlib.sha256(), 0, 0
        while left or not k:
            piece = b""
            while left and len(piece) < CHUNK:
                got = s.take(min(left, CHUNK - len(piece)))
                piece += got
                left -= len(got)
            sha.update(piece)
            total += len(piece)
            yield (*own, k, piece, total, sha.copy().hexdigest(), not left, None)
            k += 1
        s.until(b"\r\n\r\n")
        no += 1
        at[1:] = [no, *[None] * 7]


def read_warc(archives: DataFrame) -> DataFrame:
    """A frame with a column ``archive`` of paths (.warc or .warc.gz) -> the chunked record table. Other columns are ignored."""
    fields = [(f.name, f.dataType.simpleString()) for f in archives.sparkSession.createDataFrame([], CHUNK_SCHEMA).schema]
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], _NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive in b.column("archive"):
                rows, size = [], 0
                for row in chunks(archive.as_py()):
                    rows.append(row)
                    size += len(row[10] or b"")
                    if size >= 4 * CHUNK or len(rows) >= 2000:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    names = archives.select("archive").where("archive is not null")
    return names.repartition(max(1, min(10_000, names.count()))).mapInArrow(run, CHUNK_SCHEMA)


def records(chunked: DataFrame) -> DataFrame:
    """The chunked table -> a row a record: payload_bytes and payload_digest of the full payload (as declared for revisits).

    digest_ok: the payload read has the digest that its record declares (null for revisits and where none is declared).
    A record that its archive breaks off in has ``error`` and neither length nor digest.
    """
    r = chunked.where("last")
    revisit = F.col("record_type") == "revisit"
    declared = F.regexp_replace(F.lower("declared_digest"), "^sha256:", "")
    return r.select("page_id", F.when(revisit, F.col("declared_bytes")).otherwise(F.col("bytes_so_far")).alias("payload_bytes"), F.when(revisit, declared).otherwise(F.col("digest_so_far")).alias("payload_digest"), "record_type", F.col("refers_to"), "uri", "record_id", F.when(~revisit, declared == F.col("digest_so_far")).alias("digest_ok"), "error")


def op10_warc(spark, sf_dir: str) -> DataFrame:
    archives = write_warc(mark_revisits(table(spark, sf_dir, "pages")), new_path(spark, "warc"))
    return records(read_warc(archives)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS low FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> low THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> low THEN low END AS refers_to
FROM f
"""
