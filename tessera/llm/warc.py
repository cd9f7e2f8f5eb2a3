"""WARC archives: a writer with revisit records and a splittable reader.

Archives are files of gzip members, one record each. Writer tasks stream their rows into one file of a name of their
own and report it; only reported files belong to the archive, so a task that runs twice leaves an orphan and no
duplicate. The reader cuts every file into byte ranges: a task looks for gzip magic from its range's start, takes a
place for a member only if it inflates to a WARC header, reads on from member to member, and owns the records that
start inside its range.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, scratch_path, table, written

SPLIT_BYTES = 8 << 20
CHUNK = 1 << 20
MAGIC = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, bytes long, records long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, path string, offset long"


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _line(name: str, value: str) -> bytes:
    """A header line; white space and control characters of the value become percent codes."""
    clean = "".join(c if c > " " and c != "\x7f" else "".join(f"%{x:02X}" for x in c.encode()) for c in value) if name != "Content-Type" else value
    return f"{name}: {clean}\r\n".encode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member. A revisit has the digest and length of the payload, but not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if revisit else http + payload
    lines = [b"WARC/1.1\r\n", _line("WARC-Type", "revisit" if revisit else "response"), _line("WARC-Record-ID", record_id(page_id)), _line("WARC-Date", DATE)]
    if url is not None:
        lines.append(_line("WARC-Target-URI", url))
    if page_id is not None:
        lines.append(_line("Page-Id", str(page_id)))
    if revisit:
        lines.append(_line("WARC-Profile", PROFILE))
        if refers_to is not None:
            lines += [_line("WARC-Refers-To", record_id(refers_to)), _line("Refers-To-Page-Id", str(refers_to))]
    lines += [_line("WARC-Payload-Digest", f"sha1:{digest}"), _line("Payload-Length", str(len(payload))), _line("Content-Type", "application/http;msgtype=response"), _line("Content-Length", str(len(block)))]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"".join([*lines, b"\r\n", block, b"\r\n\r\n"])) + packer.flush()


def _writer(where: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(where)
        files.create_dir(root, recursive=True)
        path, size, n = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
        with files.open_output_stream(path, compression=None) as out:
            for batch in batches:
                for page_id, url, html, first, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    payload = html or b""
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    made = record(page_id, url, payload, digest, first if revisit else None, revisit)
                    out.write(made)
                    size += len(made)
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], names=["path", "bytes", "records"])

    return run


def write_archive(pages: DataFrame, where: str, least_bytes: int = 0) -> DataFrame:
    """Writes pages (page_id, url, html) as WARC files under `where`; (path, bytes, records) of each file.

    The payload is the html in UTF-8, empty for null. Among records with equal payloads of at least least_bytes bytes
    those with the smallest page_id are responses and the others revisit it; smaller payloads are all responses. A null
    page_id counts as the largest. Rows that repeat a page_id with one payload are alike: all responses or all
    revisits. Other columns are ignored. Payloads are told apart by their SHA-1, as the format does. A group of equal
    payloads is reduced to its smallest page_id before the shuffle and joined as one row, so it may be of any size.
    """
    prepare(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"))
    rows = rows.withColumn("sha", F.sha1("html"))
    first: Column = F.min("page_id").alias("first")
    firsts = rows.select("sha", "page_id").groupBy("sha").agg(first)
    rows = rows.join(firsts.hint("shuffle_merge"), "sha")
    revisit = (F.length("html") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first"))
    made = rows.select("page_id", "url", "html", "first", revisit.alias("revisit")).mapInArrow(_writer(where), MANIFEST)
    return written(made, "warc-manifest")


class _Source:
    """Reads a file forwards from any place, in chunks."""

    def __init__(self, file, at: int):
        self.file, self.at, self.held = file, at, b""
        file.seek(at)

    def more(self) -> bool:
        chunk = self.file.read(CHUNK)
        self.held += chunk
        return bool(chunk)

    def skip(self, n: int) -> None:
        self.held = self.held[n:]
        self.at += n


def _member(source: _Source) -> tuple[bytes, int] | None:
    """The inflated member that begins at the source's place and its length; None if there is none with a WARC header.

    The checksum and length at the member's end are verified by zlib.
    """
    unpack, out, used, seen = zlib.decompressobj(31), [], 0, b""
    while not unpack.eof:
        if used == len(source.held) and not source.more():
            return None
        part = source.held[used : used + CHUNK]
        try:
            got = unpack.decompress(part)
        except zlib.error:
            return None
        used += len(part) - len(unpack.unused_data)
        seen = seen if len(seen) >= 5 else seen + got[:5]
        out.append(got)
        if len(seen) >= 5 and seen[:5] != b"WARC/":
            return None
    whole = b"".join(out)
    return (whole, used) if whole.startswith(b"WARC/") and b"\r\n\r\n" in whole else None


def members(file, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, inflated record) of the records that start in [start, end) of a file of gzip members."""
    source = _Source(file, start)
    while source.at < end:
        place = source.held.find(MAGIC)
        if place < 0:
            if len(source.held) > 2:
                source.skip(len(source.held) - 2)
            if not source.more():
                return
            continue
        source.skip(place)
        if source.at >= end:
            return
        found = _member(source)
        if found is None:
            source.skip(1)
        else:
            yield source.at, found[0]
            source.skip(found[1])


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """The headers of a record, by lower-case name, and its block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return headers, rest[: int(headers.get("content-length", len(rest)))]


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RECORDS.split(", ")]
    whole = lambda x: int(x) if x is not None else None
    for batch in batches:
        for path, scheme, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "scheme", "start", "end")), strict=True):
            files, _ = _filesystem(scheme)
            rows: list[tuple] = []
            with files.open_input_file(path) as file:
                for offset, raw in members(file, start, end):
                    headers, block = parsed(raw)
                    kind = headers.get("warc-type", "")
                    length, digest = whole(headers.get("payload-length")), headers.get("warc-payload-digest", "").removeprefix("sha1:")
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        length, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    rows.append((whole(headers.get("page-id")), headers.get("warc-target-uri"), kind, whole(headers.get("refers-to-page-id")), length, digest, path, offset))
            schema = pa.schema([(x.split()[0], {"long": pa.int64(), "string": pa.string()}[x.split()[1]]) for x in RECORDS.split(", ")])
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], t.type) for t in schema], names=names)


def read_archive(manifest: DataFrame, where: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """RECORDS of the files of a manifest (path, bytes) in the store of the URI `where`, read in ranges of split_bytes.

    A response's length and digest are taken from its payload; a revisit's are those that it states. A file without
    records, or bytes that belong to none, give no rows.
    """
    ranges = manifest.select("path", F.lit(where).alias("scheme"), F.explode(F.expr(f"sequence(0, greatest(bytes - 1, 0), {split_bytes})")).alias("start"), "bytes")
    ranges = ranges.select("path", "scheme", F.col("start").cast("long").alias("start"), F.least(F.col("start") + split_bytes, F.col("bytes")).cast("long").alias("end"))
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(tasks, "path", "start").mapInArrow(_reader, RECORDS)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = scratch_path(spark, "warc")
    where = where if "://" in where else f"file://{where}"
    manifest = write_archive(table(spark, sf_dir, "pages"), where)
    found = written(read_archive(manifest, where), "warc-records")
    held, read = manifest.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("n")).first()["n"], found.count()
    if held != read:
        raise ValueError(f"the archive holds {held} records, and {read} were read")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
bits AS (SELECT page_id, p.h, strlen(html) AS n, first, array_to_string(list_transform(string_split(p.h, ''), lambda c: CASE c
  WHEN '0' THEN '0000' WHEN '1' THEN '0001' WHEN '2' THEN '0010' WHEN '3' THEN '0011' WHEN '4' THEN '0100' WHEN '5' THEN '0101' WHEN '6' THEN '0110' WHEN '7' THEN '0111'
  WHEN '8' THEN '1000' WHEN '9' THEN '1001' WHEN 'a' THEN '1010' WHEN 'b' THEN '1011' WHEN 'c' THEN '1100' WHEN 'd' THEN '1101' WHEN 'e' THEN '1110' ELSE '1111' END), '') AS b
  FROM p JOIN f USING (h))
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(16 * CAST(substr(b, i * 5 + 1, 1) AS INT) + 8 * CAST(substr(b, i * 5 + 2, 1) AS INT) + 4 * CAST(substr(b, i * 5 + 3, 1) AS INT) + 2 * CAST(substr(b, i * 5 + 4, 1) AS INT) + CAST(substr(b, i * 5 + 5, 1) AS INT) + 1 AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM bits
"""
