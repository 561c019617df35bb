"""WARC archives: writing pages, and normalising archives that are one gzip stream.

Pages are written as one whole-file gzip stream for each task's rows, as some crawlers leave them. The normaliser
inflates such a stream once, rewrites every record as a gzip member of its own and writes a sidecar index with a line
for each record (offset, length, type, id), so that a record can be read by itself. Records of equal payloads (SHA-1) are
written once as a response, by the smallest page_id, and as revisits that refer to it.

Files go through pyarrow's file systems, so a folder may be on any store that they reach. A task names its files by its
attempt; only names that Spark has committed are read further on, so lost executors and repeated tasks do no harm.
Streams are read and written in pieces: memory is bounded by a single record.

Archives of others are normalised too: header lines may lack the blank after the colon, have names in any case or be
continued, and a member may hold several records or one. What is cut off or damaged is refused, never taken as whole.

Defined cases: null html is an empty payload; a null url leaves the record without a target; a null page_id is never
referred to unless all records of a payload have none (then all are responses); repeated rows of the smallest page_id are
responses, each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, python_batches, written

#: Payload bytes after which a task begins another archive.
ARCHIVE_BYTES = 256 * 2**20
PIECE = 2**20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    store, path = fs.FileSystem.from_uri(folder.replace("s3a://", "s3://"))
    store.create_dir(path, recursive=True)
    return store, path


def _headers(first: str, fields: list[tuple[str, object]]) -> bytes:
    return "".join([f"{first}\r\n", *[f"{k}: {v}\r\n" for k, v in fields if v is not None], "\r\n"]).encode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit of the record of page refers_to."""
    http = _headers("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))])
    block = http + (payload if refers_to is None else b"")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", None if url is None else quote(url, safe=":/?#[]@!$&'()*+,;=%~")),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
        ("WARC-Refers-To", None if refers_to is None else f"<urn:page:{refers_to}>"),
        ("WARC-Profile", None if refers_to is None else _PROFILE),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", len(block)),
    ]
    return _headers("WARC/1.1", fields) + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    """Of a header: names in lower case, values without outer blanks; a line that begins with a blank continues the one before."""
    out, last = {}, None
    for line in head.decode(errors="replace").split("\r\n")[1:]:
        if line[:1] in " \t" and last:
            out[last] += " " + line.strip()
        elif line:
            name, colon, value = line.partition(":")
            if not colon:
                raise ValueError(f"not a header line: {line[:80]!r}")
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, by lower-case name, and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    return fields, rest[: int(fields["content-length"])]


def records(stream: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated stream that comes in pieces."""
    held = bytearray()

    def more() -> bool:
        piece = next(stream, None)
        if piece is not None:
            held.extend(piece)
        return piece is not None

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held:
                    raise ValueError("the archive ends within a record's header")
                return
        if not held.startswith(b"WARC/"):
            raise ValueError(f"not a record: {bytes(held[:20])!r}")
        size = _fields(bytes(held[:end])).get("content-length", "")
        if not size.isdigit():
            raise ValueError("a record without its length")
        total = end + 4 + int(size) + 4
        while len(held) < total:
            if not more():
                raise ValueError("the archive ends within a record")
        yield bytes(held[:total])
        del held[:total]


def inflated(file) -> Iterator[bytes]:
    """Pieces of a gzip file's content, be it one member or many; a file that ends within a member is refused, as is anything else behind a member."""
    inflate = None
    while piece := file.read(PIECE):
        while piece or (inflate and inflate.unconsumed_tail):
            inflate = inflate or zlib.decompressobj(31)
            try:
                out = inflate.decompress(piece, PIECE)
            except zlib.error as e:
                raise ValueError(f"not a whole gzip stream: {e}") from e
            if out:
                yield out
            piece = inflate.unconsumed_tail
            if inflate.eof:
                piece, inflate = inflate.unused_data.lstrip(b"\0"), None  # some writers fill up with zeros
    if inflate:
        raise ValueError("the archive ends within a gzip member")


def _member(data: bytes) -> bytes:
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


def normalise(source, archive, index) -> int:
    """Rewrites the archive in source, a file, as one member for each record, with an index; gives the number of records."""
    offset = n = 0
    for data in records(inflated(source)):
        member, fields = _member(data), parse(data)[0]
        archive.write(member)
        entry = {"offset": offset, "length": len(member), "type": fields.get("warc-type"), "id": fields.get("warc-record-id")}
        index.write(json.dumps(entry).encode() + b"\n")
        offset, n = offset + len(member), n + 1
    return n


def _write(folder: str):
    """Archives of the pages of a partition, each a single gzip stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, path = _store(folder)
        file, size, names = None, 0, []
        for batch in batches:
            for page_id, url, html, refers_to in zip(*[batch[c].to_pylist() for c in ("page_id", "url", "html", "refers_to")], strict=True):
                if file is None:
                    names.append(f"{context.partitionId():06d}-{context.taskAttemptId()}-{len(names)}")
                    file, deflate, size = store.open_output_stream(f"{path}/{names[-1]}.warc.gz", compression=None), zlib.compressobj(1, zlib.DEFLATED, 31), 0
                payload = (html or "").encode()
                file.write(deflate.compress(record(page_id, url, payload, refers_to)))
                size += len(payload)
                if size >= ARCHIVE_BYTES:
                    file.write(deflate.flush())
                    file.close()
                    file = None
        if file is not None:
            file.write(deflate.flush())
            file.close()
        yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string())})

    return run


def _normalise(raw: str, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        (source, from_path), (store, path) = _store(raw), _store(folder)
        for batch in batches:
            names, counts = [], []
            for name in batch["name"].to_pylist():
                names.append(f"{name}-{attempt}")
                with source.open_input_stream(f"{from_path}/{name}.warc.gz", compression=None) as f, store.open_output_stream(f"{path}/{names[-1]}.warc.gz", compression=None) as archive, store.open_output_stream(f"{path}/{names[-1]}.index.jsonl", compression=None) as index:
                    counts.append(normalise(f, archive, index))
            yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string()), "records": pa.array(counts, pa.int64())})

    return run


def read_record(file, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record of a normalised archive, read by itself."""
    file.seek(offset)
    return parse(zlib.decompress(file.read(length), 31))


def _page(urn: str | None) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">") if urn else ""
    return int(number) if number else None


_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _read(folder: str, lot: int = 1024):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        for batch in batches:
            for name in batch["name"].to_pylist():
                with store.open_input_file(f"{path}/{name}.warc.gz") as file, store.open_input_stream(f"{path}/{name}.index.jsonl", compression=None) as index:
                    rows, rest = [], b""
                    while piece := index.read(PIECE):
                        *lines, rest = (rest + piece).split(b"\n")
                        for entry in map(json.loads, lines):
                            fields, block = read_record(file, entry["offset"], entry["length"])
                            http, _, payload = block.partition(b"\r\n\r\n")
                            digest = fields["warc-payload-digest"].removeprefix("sha1:")
                            if fields["warc-type"] == "response":
                                size = len(payload)
                                if base32_sha1(payload) != digest:
                                    raise ValueError(f"{name}: the payload of {entry['id']} does not match its digest")
                            else:
                                size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                            rows.append((_page(entry["id"]), size, digest, fields["warc-type"], _page(fields.get("warc-refers-to"))))
                            if len(rows) >= lot:
                                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _READ, strict=True)], schema=_READ)
                                rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _READ, strict=True)], schema=_READ)

    return run


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, sha1, refers_to of the rows that repeat a payload of at least least_bytes."""
    rows = pages.select("page_id", F.sha1(F.coalesce("html", F.lit(""))).alias("sha1"), F.octet_length(F.coalesce("html", F.lit(""))).alias("bytes")).filter(F.col("bytes") >= least_bytes)
    firsts = written(rows.groupBy("sha1").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1 AND refers_to IS NOT NULL").select("sha1", "refers_to"), "warc-firsts")
    return written(rows.select("page_id", "sha1").join(firsts, "sha1").filter("NOT page_id <=> refers_to").distinct(), "warc-revisits")


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes pages (page_id, url, html) below folder, each task's rows as one gzip stream; the archives' names."""
    python_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", "html").withColumn("sha1", F.sha1(F.coalesce("html", F.lit(""))))
    again = revisits(pages, least_bytes).select(F.col("page_id").alias("again_id"), F.col("sha1").alias("again_sha1"), "refers_to")
    joined = rows.join(again, F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("sha1") == F.col("again_sha1")), "left")
    return written(joined.select("page_id", "url", "html", "refers_to").mapInArrow(_write(folder), "name string"), "warc-written")


def normalise_archives(names: DataFrame, raw: str, folder: str) -> DataFrame:
    """Normalises the named archives of folder raw into folder; the names and numbers of records of the new ones."""
    return written(names.repartition(max(1, names.count())).mapInArrow(_normalise(raw, folder), "name string, records long"), "warc-normalised")


def read_archives(names: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, each read at its indexed place."""
    ddl = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return names.repartition(max(1, names.count())).select("name").mapInArrow(_read(folder), ddl)


def op8_warc(spark, sf_dir: str) -> DataFrame:
    root = fresh_path(spark, "warc")
    names = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), f"{root}/raw")
    return read_archives(normalise_archives(names, f"{root}/raw", f"{root}/members"), f"{root}/members")


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, ((i // 4) * 5 + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN f USING (h)
"""
