"""WARC archives of web pages and the resolution of their revisits.

1. ``write_archives`` writes every page as a response record; each record is a gzip member of its own, an archive is
   closed at ``ARCHIVE_BYTES``.  The tasks return one header row per record: archive, offset, length, page, digest.
2. ``resolve_revisits`` shuffles the header rows, never the payloads, by payload digest: of equal payloads the record
   with the largest page id is the original; the other records join it.
3. ``deduplicate_archives`` reads each archive by its header rows and writes it anew with fresh headers: originals
   with their payload, revisits with the HTTP header alone and a reference to the original.
4. ``read_archives`` parses the written archives record by record.

Defined cases: a null html is the empty payload, a null url the empty one; control characters in a url are
percent-encoded in the header; a null page id is smaller than all others; of rows that repeat a page id and its
payload one is the original (the last by archive and offset); an empty table gives no archive and no row; other
columns of the table are not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import ship_package
from .common import open_fs, put_file, shared_path, utf8, written

ARCHIVE_BYTES = 32 << 20  # compressed size at which an archive is closed; a task holds one archive
HOT_SHARE = 1000  # a digest with at least 1/1000 of the records is hot: at most 1000 digests are, so they fit a broadcast
CHUNK = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = "archive long, offset long, length long, page_id long, url string, digest string, payload_bytes long"
RESOLVED = f"{HEADERS}, refers_archive long, refers_offset long, refers_to long, refers_url string, is_revisit boolean"


def payload_digest(payload: bytes) -> str:
    """Bare base32 SHA-1, upper case."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, archive: int, offset: int) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{archive}-{offset}>"


def page_of(identifier: str):
    """The page id that a record id carries."""
    page = identifier.split(":")[2]
    return int(page) if page else None


def safe_uri(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url)


def record(kind: str, identifier: str, url: str, date: str, digest: str, size: int, payload: bytes, refers: dict) -> bytes:
    """One record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload
    fields = {"WARC-Type": kind, "WARC-Record-ID": identifier, "WARC-Target-URI": safe_uri(url), "WARC-Date": date,
              "WARC-Payload-Digest": f"sha1:{digest}", "WARC-Block-Digest": f"sha1:{payload_digest(block)}", **refers,
              "Content-Type": "application/http;msgtype=response", "Content-Length": str(len(block))}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return b"".join((packer.compress(head.encode()), packer.compress(block), packer.compress(b"\r\n\r\n"), packer.flush()))


def parse_head(raw: bytes, start: int = 0) -> tuple[dict[str, str], int]:
    """Header fields (names in lower case) after the first line, and the place where they end."""
    end = raw.index(b"\r\n\r\n", start)
    lines = raw[start:end].decode().split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, end + 4


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of one record."""
    fields, at = parse_head(raw)
    end = at + int(fields["content-length"])
    if raw[end:] != b"\r\n\r\n":
        raise ValueError(f"record {fields.get('warc-record-id')} does not end where its length says")
    http, body = parse_head(raw[:end], at)
    return fields, http, raw[body:end]


def members(source) -> Iterator[bytes]:
    """The gzip members of a stream; holds one of them."""
    raw, parts, unpack = b"", [], None
    while True:
        raw = raw or source.read(CHUNK)
        if not raw:
            if unpack is not None:
                raise ValueError("the archive ends inside a record")
            return
        unpack = unpack or zlib.decompressobj(31)
        parts.append(unpack.decompress(raw))
        raw = b""
        if unpack.eof:
            yield b"".join(parts)
            raw, parts, unpack = unpack.unused_data, [], None


def arrow_rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def write_archives(pages: DataFrame, folder: str, date: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``page_id``, ``url`` and ``html`` of every page as a response record under ``folder``; header rows."""
    ship_package(pages.sparkSession)
    schema = StructType.fromDDL(HEADERS)
    arrow = to_arrow_schema(schema)

    def run(batches):
        from pyspark import TaskContext
        archive = TaskContext.get().partitionId() << 32
        sink, rows = io.BytesIO(), []
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for page_id, url, payload in zip(ids, utf8(batch.column(1)), utf8(batch.column(2))):
                url, digest, offset = url.decode(errors="replace"), payload_digest(payload), sink.tell()
                sink.write(record("response", record_id(page_id, archive, offset), url, date, digest, len(payload), payload, {}))
                rows.append((archive, offset, sink.tell() - offset, page_id, url, digest, len(payload)))
                if sink.tell() >= archive_bytes:
                    put_file(f"{folder}/{archive}.warc.gz", lambda out, sink=sink: out.write(sink.getbuffer()))
                    yield arrow_rows(arrow, rows)
                    archive, sink, rows = archive + 1, io.BytesIO(), []
        if rows:
            put_file(f"{folder}/{archive}.warc.gz", lambda out: out.write(sink.getbuffer()))
            yield arrow_rows(arrow, rows)

    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return written(plain.mapInArrow(run, schema), "headers")


def resolve_revisits(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Header rows with the original of each revisit.

    Counts and originals per digest are summed before the shuffle.  Hot digests, at most ``HOT_SHARE``, are joined
    by broadcast, so the rows of the shuffle join hold no digest with more than 1/``HOT_SHARE`` of all rows.
    """
    key = ["digest", "payload_bytes"]
    total = headers.count()
    originals = (headers.filter(F.col("payload_bytes") >= min_bytes).groupBy(*key)
                 .agg(F.count("*").alias("copies"), F.max(F.struct("page_id", "archive", "offset", "url")).alias("original"))
                 .filter("copies > 1"))
    originals = written(originals, "originals")
    is_hot = F.col("copies") * HOT_SHARE >= total
    marked = headers.join(F.broadcast(originals.filter(is_hot).drop("copies")), key, "left")
    cold = (marked.filter("original IS NULL").drop("original")
            .join(originals.filter(~is_hot).drop("copies"), key, "left"))
    both = marked.filter("original IS NOT NULL").unionByName(cold)
    revisit = F.col("original").isNotNull() & ~((F.col("original.archive") == F.col("archive"))
                                                 & (F.col("original.offset") == F.col("offset")))
    named = {"refers_archive": "archive", "refers_offset": "offset", "refers_to": "page_id", "refers_url": "url"}
    schema = StructType.fromDDL(RESOLVED)
    return (both.withColumn("is_revisit", F.coalesce(revisit, F.lit(False)))
            .select(*headers.columns, *[F.when(F.col("is_revisit"), F.col(f"original.{c}")).alias(n) for n, c in named.items()],
                    "is_revisit").select(*schema.names))


def deduplicate_archives(resolved: DataFrame, source: str, folder: str, date: str) -> DataFrame:
    """Write each archive of ``source`` anew under ``folder``, by its resolved header rows; one row (path) per archive.

    Only header rows are shuffled, to their archive (at most ``ARCHIVE_BYTES`` of records).  Payloads of revisits
    are not even read."""
    schema = StructType.fromDDL("path string")
    arrow = to_arrow_schema(schema)

    def rewrite(archive: int, rows: list[dict]) -> str:
        path = f"{folder}/{archive}.warc.gz"
        store, at = open_fs(f"{source}/{archive}.warc.gz")

        def write(sink) -> None:
            with store.open_input_file(at) as old:
                for r in rows:
                    identifier, payload, refers = record_id(r["page_id"], archive, r["offset"]), b"", {}
                    if r["is_revisit"]:
                        refers = {"WARC-Profile": PROFILE, "WARC-Refers-To-Target-URI": safe_uri(r["refers_url"]), "WARC-Refers-To-Date": date,
                                  "WARC-Refers-To": record_id(r["refers_to"], r["refers_archive"], r["refers_offset"])}
                    else:
                        old.seek(r["offset"])
                        payload = parse_record(zlib.decompress(old.read(r["length"]), 31))[2]
                    sink.write(record("revisit" if r["is_revisit"] else "response", identifier, r["url"], date, r["digest"],
                                      r["payload_bytes"], payload, refers))

        put_file(path, write)
        return path

    def run(batches):
        archive, rows = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["archive"] != archive and rows:
                    yield arrow_rows(arrow, [(rewrite(archive, rows),)])
                    rows = []
                archive = r["archive"]
                rows.append(r)
        if rows:
            yield arrow_rows(arrow, [(rewrite(archive, rows),)])

    dealt = resolved.repartition("archive").sortWithinPartitions("archive", "offset")
    return written(dealt.mapInArrow(run, schema), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """Records of the archives (``path``): page_id, payload_bytes, payload_digest, record_type and refers_to.  The
    digest of a stored payload is computed anew and must agree with its header."""
    ship_package(archives.sparkSession)
    schema = StructType.fromDDL("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = open_fs(path)
                rows = []
                with store.open_input_stream(at, compression=None) as source:
                    for raw in members(source):
                        fields, http, payload = parse_record(raw)
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        kind, size = fields["warc-type"], int(http["content-length"])
                        if kind == "response" and (len(payload), payload_digest(payload)) != (size, digest):
                            raise ValueError(f"payload of {fields['warc-record-id']} differs from its digest")
                        refers = page_of(fields["warc-refers-to"]) if kind == "revisit" else None
                        rows.append((page_of(fields["warc-record-id"]), size, digest, kind, refers))
                yield arrow_rows(arrow, rows)

    # one row per archive: dealt by place, so that archives spread evenly
    n = max(1, archives.count())
    return archives.repartition(n, "path").select("path").mapInArrow(run, schema)


def deduplicated_pages(spark: SparkSession, pages: DataFrame, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Archive ``pages``, resolve their revisits, write the deduplicated archives and read them back."""
    first, second = shared_path(spark, "crawl"), shared_path(spark, "deduplicated")
    resolved = resolve_revisits(write_archives(pages, first, date), min_bytes)
    return read_archives(deduplicate_archives(resolved, first, second, date))
