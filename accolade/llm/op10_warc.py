"""WARC archives and the monolithic gzip normaliser.

Pages are written as whole-file gzip streams, the form that cannot be read from the middle.
The normaliser inflates such a stream once from front to back, cuts it into records as they
come, writes each record as a gzip member of its own and lists the members' offsets in a
sidecar. Reading then goes by offset. All files go to the folder that the cluster shares; each
attempt of a task writes under a name of its own, and only names that a finished task has
returned are read, so lost executors and repeated tasks leave nothing wrong behind.

Equal payloads of at least `least` bytes: the row with the smallest page_id is the response (of rows that share it that with the least url,
of equal rows any one), the others are revisits that hold its id and digest but no payload. Payloads are compared by their SHA-256.

Defined cases: a null html is the empty payload; a null url has no target header; a null page_id comes
after all others, so it is a response only where no row with its payload has an id, and is referred to as null then; an
empty table writes no archive and gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from accolade.llm._shared import scratch, small, stored, table

#: Payload bytes that one archive takes before the next begins.
ARCHIVE_BYTES = 64 << 20
_GZIP = 31
_END = b"\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, revisit: bool, refers_to: int | None) -> bytes:
    """One WARC record; a revisit holds the response's head only."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _END + block + _END


def headers(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])


class Inflater:
    """Reads a gzip stream, of one member or more, from front to back; holds little more than one record."""

    def __init__(self, source, chunk: int = 1 << 20):
        self.source, self.chunk, self.left, self.buffer, self.z = source, chunk, b"", bytearray(), zlib.decompressobj(_GZIP)

    def more(self) -> bool:
        data = self.left or self.source.read(self.chunk)
        if not data:
            return False
        self.buffer += self.z.decompress(data, 4 << 20)
        self.left = self.z.unconsumed_tail
        if self.z.eof:
            self.left = self.z.unused_data
            self.z = zlib.decompressobj(_GZIP)
        return True

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        """Headers and all bytes of each record."""
        while True:
            at = 0
            while (end := self.buffer.find(_END, at)) < 0:
                at = max(0, len(self.buffer) - 3)
                if not self.more():
                    if self.buffer.strip():
                        raise ValueError("the archive ends within a record")
                    return
            found = headers(bytes(self.buffer[:end]))
            whole = end + len(_END) + int(found["Content-Length"]) + len(_END)
            while len(self.buffer) < whole:
                if not self.more():
                    raise ValueError("the archive ends within a record")
            yield found, bytes(self.buffer[:whole])
            del self.buffer[:whole]


def _gzip(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, _GZIP)
    return z.compress(data) + z.flush()


def _number(urn: str) -> int | None:
    value = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value else None


def _opened(folder: str):
    files, path = pafs.FileSystem.from_uri(folder)
    files.create_dir(path, recursive=True)
    return files, path


def _write_archives(folder: str):
    """Whole-file gzip archives of the pages of a task; gives their names."""

    def run(batches):
        files, base = _opened(folder)
        out, z, held, names = None, None, 0, []
        for batch in batches:
            for page_id, url, html, digest, revisit, refers_to in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "revisit", "refers_to")], strict=True):
                if out is None:
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, z, held = files.open_output_stream(f"{base}/{names[-1]}", compression=None), zlib.compressobj(1, zlib.DEFLATED, _GZIP), 0
                payload = (html or "").encode()
                out.write(z.compress(record(page_id, url, payload, digest, revisit, refers_to)))
                held += len(payload)
                if held >= ARCHIVE_BYTES:
                    out.write(z.flush())
                    out.close()
                    out = None
        if out is not None:
            out.write(z.flush())
            out.close()
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["archive"])

    return run


def _normalise(folder: str, level: int):
    """Rewrites archives with a member for each record and a sidecar of offsets; the whole-file archive goes when its successor is complete."""

    def run(batches):
        files, base = _opened(folder)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                target = f"{name.removesuffix('.warc.gz')}-{uuid.uuid4().hex[:8]}.members.warc.gz"
                offsets, lengths, at = [], [], 0
                with files.open_input_stream(f"{base}/{name}", compression=None) as source, files.open_output_stream(f"{base}/{target}", compression=None) as out, files.open_output_stream(f"{base}/{target}.idx", compression=None) as index:
                    for found, data in Inflater(source).records():
                        member = _gzip(data, level)
                        out.write(member)
                        index.write(f"{found['WARC-Record-ID']} {found['WARC-Type']} {at} {len(member)}\n".encode())
                        offsets.append(at)
                        lengths.append(len(member))
                        at += len(member)
                yield pa.RecordBatch.from_arrays([pa.array([target] * len(offsets), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], ["archive", "offset", "length"])

    return run


def _read(folder: str):
    """Records by archive, offset and length, as the query's rows."""

    def run(batches):
        files, base = _opened(folder)
        name, source = None, None
        for batch in batches:
            rows = []
            for archive, offset, length in zip(*[batch.column(c).to_pylist() for c in ("archive", "offset", "length")], strict=True):
                if archive != name:
                    if source is not None:
                        source.close()
                    name, source = archive, files.open_input_file(f"{base}/{archive}")
                source.seek(offset)
                data = zlib.decompress(source.read(length), _GZIP)
                head, _, block = data[: -len(_END)].partition(_END)
                found = headers(head)
                http, _, payload = block.partition(_END)
                is_response = found["WARC-Type"] == "response"
                size = len(payload) if is_response else int(headers(http)["Content-Length"])
                digest = hashlib.sha256(payload).hexdigest() if is_response else found["WARC-Payload-Digest"].removeprefix("sha256:")
                rows.append((_number(found["WARC-Record-ID"]), size, digest, found["WARC-Type"], None if is_response else _number(found["WARC-Refers-To"])))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if source is not None:
            source.close()

    return run


def write_archives(pages: DataFrame, folder: str, least: int = 100) -> DataFrame:
    """Names of the whole-file archives written for every row of (page_id, url, html)."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"))
    size = F.octet_length(F.coalesce("html", F.lit("")))
    place = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", F.col("url").isNull().alias("no_url"), "url")
    firsts = pages.where(size >= least).groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    firsts = stored(firsts, "warc-firsts")
    is_first = F.col("page_id").eqNullSafe(F.col("first.page_id")) & F.col("url").eqNullSafe(F.col("first.url"))
    marked = pages.join(small(firsts, firsts.count(), 512), "digest", "left").withColumn("leads", is_first & F.col("first").isNotNull())
    # Where rows are alike in id and url as well, one of them stays the response.
    alike = stored(marked.where("leads").groupBy("digest").count().where("count > 1").select("digest"), "warc-alike")
    several = alike.count()
    if several:
        nth = F.row_number().over(Window.partitionBy("digest").orderBy("page_id"))
        twins = marked.where("leads").join(small(alike, several, 96), "digest", "left_semi").withColumn("leads", nth == 1)
        others = marked.where("not leads").unionByName(marked.where("leads").join(small(alike, several, 96), "digest", "left_anti"))
        marked = others.unionByName(twins)
    revisit = F.col("first").isNotNull() & ~F.col("leads")
    marked = marked.select("page_id", "url", "html", "digest", revisit.alias("revisit"), F.when(revisit, F.col("first.page_id")).alias("refers_to"))
    return stored(marked.mapInArrow(_write_archives(folder), "archive string"), "warc-archives")


def normalise_archives(archives: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """(archive, offset, length) of every record's member in the archives rewritten from whole-file ones, in the files' order."""
    return stored(archives.repartitionByRange(max(1, archives.count()), "archive").mapInArrow(_normalise(folder, level), "archive string, offset long, length long"), "warc-index")


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    return index.mapInArrow(_read(folder), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    archives = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(normalise_archives(archives, folder), folder)


SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY page_id NULLS LAST, url NULLS LAST) AS nth, first_value(page_id) OVER (PARTITION BY d ORDER BY page_id NULLS LAST, url NULLS LAST) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n < 100 OR nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN n >= 100 AND nth > 1 THEN first END AS refers_to
FROM f
"""
