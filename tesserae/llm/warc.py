"""WARC records in ZIP packages, and a reader that works on byte ranges.

A package is a ZIP file with stored (never compressed) members: archive/data.warc.gz, whose records are one gzip member
each, indexes/index.cdxj, one line a record with its offset and length in that member, and datapackage.json. The
reader parses the end of central directory (ZIP64 too), the central directory and local headers, range-reads the
index member, and range-reads records in blocks; nothing is extracted. Members without an index are read in order.

Records of equal payloads (of at least min_bytes bytes): the one with the largest page_id is a response, others are
revisits that name it.

Plan: one aggregation finds digests that occur more than once (digest and id only are shuffled), one join, which
adaptive execution splits if one payload is frequent, brings them to the pages; each task streams its pages into one package.
Reading: one row a package, then one row a block of records.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_written, shared_dir, small_batches, table, tidy, written
from .files import Output, open_input

DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MEMBER, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Compressed bytes of records that are read together.
BLOCK = 2_000_000
_EOCD, _LOCATOR, _EOCD64, _CENTRAL, _LOCAL = b"PK\5\6", b"PK\6\7", b"PK\6\6", b"PK\1\2", b"PK\3\4"


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record(rid: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC record, a response or (if it refers to another) a revisit with the HTTP header only."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{rid}>", f"WARC-Date: {DATE}"]
    if url:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    else:
        block += payload
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    if len(rest) < n:
        raise ValueError("a WARC record is cut short")
    return fields, rest[:n]


def payload_of(block: bytes) -> tuple[dict[str, str], bytes]:
    """HTTP header fields and body of a block."""
    head, _, body = block.partition(b"\r\n\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}, body


class _Stream:
    """What zipfile needs of an output that can't seek."""

    def __init__(self, out: Output):
        self.write, self.flush, self.tell = out.write, out.flush, out.tell

    def seekable(self) -> bool:
        return False


def members(f) -> dict[str, tuple[int, int, int]]:
    """name: (method, offset of the data, stored size) of every member, from the central directory."""
    size = f.size()
    n = min(size, 65_557)
    tail = f.read_at(n, size - n)
    at = tail.rfind(_EOCD)
    if at < 0:
        raise ValueError("not a ZIP file")
    count, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
    if 0xFFFFFFFF in (length, start) or count == 0xFFFF or tail[max(0, at - 20) : at][:4] == _LOCATOR:
        locator = tail[at - 20 : at]
        if locator[:4] != _LOCATOR:
            raise ValueError("no ZIP64 locator")
        end = f.read_at(56, struct.unpack("<Q", locator[8:16])[0])
        if end[:4] != _EOCD64:
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack("<QQQ", end[32:56])
    raw, p, out = f.read_at(length, start), 0, {}
    for _ in range(count):
        if raw[p : p + 4] != _CENTRAL:
            raise ValueError("broken central directory")
        method, stored, plain, n_name, n_extra, n_note, header = struct.unpack("<10xH8xIIHHH8xI", raw[p : p + 46])
        name = raw[p + 46 : p + 46 + n_name].decode("utf-8")
        extra, q = raw[p + 46 + n_name : p + 46 + n_name + n_extra], 0
        while q + 4 <= len(extra):
            kind, n = struct.unpack("<HH", extra[q : q + 4])
            if kind == 1:  # ZIP64: only the fields that did not fit, in this order
                wide = iter(struct.unpack(f"<{n // 8}Q", extra[q + 4 : q + 4 + n // 8 * 8]))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                stored = next(wide) if stored == 0xFFFFFFFF else stored
                header = next(wide) if header == 0xFFFFFFFF else header
            q += 4 + n
        local = f.read_at(30, header)
        if local[:4] != _LOCAL:
            raise ValueError("broken local header")
        out[name] = (method, header + 30 + sum(struct.unpack("<HH", local[26:30])), stored)
        p += 46 + n_name + n_extra + n_note
    return out


def _need_stored(found: dict, name: str) -> tuple[int, int]:
    method, at, size = found[name]
    if method:
        raise ValueError(f"{name} is compressed; only stored members can be read by range")
    return at, size


def numbered(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with a row number and sha1, as a written table: whatever is computed again later reads the same numbers."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    df = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html")).withColumn("row", F.monotonically_increasing_id())
    return written(df.withColumn("sha1", F.sha1("html")), "warc-rows", "gzip")


def with_records(df: DataFrame, min_bytes: int = 0) -> DataFrame:
    """numbered() pages with the page_id and row of the response that each equals, null if it is alone."""
    several = (
        df.where(F.octet_length("html") >= min_bytes)
        .groupBy("sha1")
        .agg(F.max(F.struct("page_id", "row")).alias("refers"), F.count("*").alias("n"))
        .where("n > 1")
        .select(F.col("sha1").alias("same"), "refers")
    )
    return df.join(several, F.col("sha1") == F.col("same"), "left").select("page_id", "row", "url", "html", F.col("refers.page_id").alias("to_page"), F.col("refers.row").alias("to_row"))


def write(pages: DataFrame, uri: str, min_bytes: int = 0) -> DataFrame:
    """Writes a record for every row of pages into packages below uri; returns the small table (file, n_records) of them.

    Null html is an empty payload; null URLs have no target URI. Of repeated rows of one page_id and payload one is the
    response. Null page_ids count as smallest. Other columns are not read. An empty table makes no package.
    """

    def rid(page: int | None, row: int) -> str:
        return f"urn:x-page:{'' if page is None else page}:{row}"

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: list[Output] = []
        try:
            yield from package(batches, opened)
        except BaseException:
            for out in opened:
                out.abandon()
            raise

    def package(batches: Iterator[pa.RecordBatch], opened: list[Output]) -> Iterator[pa.RecordBatch]:
        out, index, zf, member = None, [], None, None
        at = 0
        for b in batches:
            for page, row, url, html, to_page, to_row in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if out is None:
                    name = f"part-{TaskContext.get().partitionId():06d}.wacz"
                    out = Output(f"{uri}/{name}")
                    opened.append(out)
                    zf = zipfile.ZipFile(_Stream(out), "w", zipfile.ZIP_STORED, allowZip64=True)
                    member = zf.open(zipfile.ZipInfo(MEMBER), "w", force_zip64=True)
                payload = html.encode("utf-8")
                digest = base32(hashlib.sha1(payload).digest())
                refers = rid(to_page, to_row) if to_row is not None and to_row != row else None
                z = zlib.compressobj(5, zlib.DEFLATED, 31)
                data = z.compress(record(rid(page, row), url, payload, digest, refers)) + z.flush()
                member.write(data)
                index.append((at, len(data), digest, url))
                at += len(data)
        if out is None:
            return
        member.close()
        with zf.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as f:
            for o, n, digest, url in index:
                f.write(f"{json.dumps({'offset': o, 'length': n, 'digest': digest, 'filename': 'data.warc.gz', 'url': url})}\n".encode())
        zf.writestr(zipfile.ZipInfo("datapackage.json"), json.dumps({"profile": "data-package", "resources": [{"path": MEMBER, "bytes": at}, {"path": INDEX}]}))
        zf.close()
        out.close()
        yield pa.RecordBatch.from_pydict({"file": [name], "n_records": [len(index)]})

    small_batches(pages.sparkSession)
    rows = numbered(pages)
    files = written(with_records(rows, min_bytes).mapInArrow(tidy(save), "file string, n_records long"), "packages")
    drop_written(rows)
    return files


def blocks(files: DataFrame, uri: str) -> DataFrame:
    """(file, at, size, lengths): ranges of whole records of every package, from its directories and index member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file in b.column(0).to_pylist():
                with open_input(f"{uri}/{file}") as f:
                    found = members(f)
                    rows: list[tuple[int, int, list[int]]] = []
                    for name in (x for x in found if x.startswith("archive/")):
                        at, size = _need_stored(found, name)
                        if INDEX in found:
                            i_at, i_size = _need_stored(found, INDEX)
                            lines = [json.loads(x) for x in f.read_at(i_size, i_at).splitlines()]
                            parts = sorted((x["offset"], x["length"]) for x in lines if x["filename"] == name.rpartition("/")[2])
                        else:
                            parts = list(_scan(f, at, size))
                        for o, n in parts:
                            if not rows or rows[-1][0] + rows[-1][1] != at + o or rows[-1][1] + n > BLOCK:
                                rows.append((at + o, 0, []))
                            first, total, lengths = rows.pop()
                            rows.append((first, total + n, lengths + [n]))
                    if rows:
                        a, s, n = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([file] * len(rows)), pa.array(a, pa.int64()), pa.array(s, pa.int64()), pa.array(n, pa.list_(pa.int64()))], names=["file", "at", "size", "lengths"]
                        )

    return files.select("file").mapInArrow(tidy(run), "file string, at long, size long, lengths array<long>")


def _scan(f, at: int, size: int) -> Iterator[tuple[int, int]]:
    """Offset and length of each gzip member of a stored member that has no index."""
    start = p = 0
    buffer, z = b"", zlib.decompressobj(31)
    while p < size or buffer:
        if not buffer:
            buffer = f.read_at(min(1 << 20, size - p), at + p)
            p += len(buffer)
        while buffer and not z.eof:
            z.decompress(buffer)
            buffer = z.unused_data if z.eof else b""
        if z.eof:
            end = p - len(buffer)
            yield start, end - start
            start, z = end, zlib.decompressobj(31)
    if start != size:
        raise ValueError("the last record is cut short")


def read(files: DataFrame, uri: str, payloads: bool = True) -> DataFrame:
    """Rows of every record of the packages: page_id, payload_bytes, payload_digest, record_type, refers_to, url[, payload].

    A revisit's payload is null; its size and digest are those its headers give. A response whose payload has not its
    digest, or a broken package, is an error.
    """
    spark = files.sparkSession
    todo = blocks(files.repartition(max(1, min(files.count(), 4096))), uri)
    kinds = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * payloads

    def page(rid: str | None) -> int | None:
        got = re.fullmatch(r"<urn:x-page:(-?\d*):\d+>", rid or "")
        return int(got[1]) if got and got[1] else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, at, size, lengths in zip(*(x.to_pylist() for x in b.columns), strict=True):
                with open_input(f"{uri}/{file}") as f:
                    raw, p, rows = f.read_at(size, at), 0, []
                for n in lengths:
                    fields, block = parse_record(zlib.decompress(raw[p : p + n], 31))
                    p += n
                    http, body = payload_of(block)
                    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and base32(hashlib.sha1(body).digest()) != digest:
                        raise ValueError(f"{file}: the payload of {fields['warc-record-id']} has another digest")
                    row = [page(fields["warc-record-id"]), len(body) if kind == "response" else int(http["content-length"]), digest, kind, page(fields.get("warc-refers-to")), fields.get("warc-target-uri")]
                    rows.append(row + [body if kind == "response" else None] * payloads)
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()] + [pa.binary()] * payloads
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in kinds.split(", ")])

    n = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4096))
    return todo.repartition(n).mapInArrow(tidy(run), kinds)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = shared_dir(spark, "wacz")
    files = write(table(spark, sf_dir, "pages", "page_id", "url", "html"), uri)
    return read(files, uri, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_CHARS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, {5 * g + 1}, 5) AS BIGINT) >> {15 - 5 * i}) & 31 AS INT) + 1, 1)" for g in range(8) for i in range(4)
)
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, strlen(html) AS payload_bytes, {_CHARS} AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM g
"""
