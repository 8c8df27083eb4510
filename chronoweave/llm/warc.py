"""WARC archives: one gzip member per record, written and read sequentially by Spark tasks.

Writing: each task writes the records of its partition to an archive in the shared folder under a name of its own
attempt and renames it when complete, so a task that is run again leaves one whole archive. A record whose payload (of at
least ``least`` bytes) also belongs to a page with a smaller id becomes a revisit record with the HTTP head only.

Reading: each task inflates its archive in small chunks, one gzip member at a time, cuts the record by Content-Length and
checks block and payload digests. A damaged record is an error that names the archive.

Defined results: null html is an empty payload; a null url leaves out the target; a page with a null id is never referred
to while the group has another id, and with null ids only, all are responses; rows that repeat the smallest id are all
responses; an empty table gives no archive and an empty result; other columns are left alone.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm.text import open_folder, table
from chronoweave.session import cut_lineage

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_BYTES = 64 << 20
CHUNK = 64 << 10


def mark_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 100) -> DataFrame:
    """Page id, url, ``_payload``, ``_digest`` and ``_first``: the smallest id with the same payload, for pages that revisit it.

    Only digests that occur twice or more are joined back; a digest of a third of all pages is pre-aggregated on the one
    side and its join partition is split by adaptive execution on the other.
    """
    payload = F.coalesce(F.encode(html, "UTF-8"), F.lit(b""))
    marked = pages.select(page_id, url, payload.alias("_payload")).withColumn("_digest", F.sha2("_payload", 256))
    firsts = (
        marked.filter(F.octet_length("_payload") >= least).groupBy("_digest").agg(F.min(page_id).alias("_first"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1").drop("_n")
    )
    joined = marked.join(firsts, "_digest", "left")
    return joined.withColumn("_first", F.when(F.col("_first").eqNullSafe(F.col(page_id)), None).otherwise(F.col("_first")))


def record(page: str, url: str | None, payload: bytes, digest: str, first: str | None, date: str) -> bytes:
    """One record; a revisit has the HTTP head, whose Content-Length is that of the full payload, and no payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block += payload if first is None else b""
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Date: {date}",
        *([] if url is None else [f"WARC-Target-URI: {quote(url, safe='%/:=&?~#+!$,;@()*[]')}"]),
        *([] if first is None else [f"WARC-Refers-To: <urn:page:{first}>", f"WARC-Profile: {PROFILE}"]),
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(marked: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes what ``mark_revisits`` returns; gives (archive, n_records, n_bytes), one row per archive, written once."""

    def write(batches):
        where, path = fs.FileSystem.from_uri(folder)
        where.create_dir(path, recursive=True)
        task, out, done = TaskContext.get(), None, []

        def close():
            out.close()
            where.move(f"{path}/{done[-1][0]}.{task.taskAttemptId()}", f"{path}/{done[-1][0]}")

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for page, target, payload, digest, first in zip(*columns):
                if out is None or done[-1][2] >= ARCHIVE_BYTES:
                    if out is not None:
                        close()
                    done.append([f"part-{task.partitionId():06d}-{len(done):04d}.warc.gz", 0, 0])
                    out = where.open_output_stream(f"{path}/{done[-1][0]}.{task.taskAttemptId()}", compression=None)
                member = _member(record(str(page), target, payload, digest, first, date))
                out.write(member)
                done[-1][1] += 1
                done[-1][2] += len(member)
        if out is not None:
            close()
        names, counts, sizes = zip(*done) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{n}" for n in names], pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())],
                                         ["archive", "n_records", "n_bytes"])

    rows = marked.select(F.col(page_id).cast("string"), url, "_payload", "_digest", F.col("_first").cast("string"))
    return cut_lineage(rows.mapInArrow(write, "archive string, n_records bigint, n_bytes bigint"))


def inflate(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one after another, read and inflated in chunks."""
    packed = stream.read(CHUNK)
    while packed:
        inflater, parts = zlib.decompressobj(31), []
        while not inflater.eof:
            if not packed:
                raise ValueError("the archive ends within a record")
            parts.append(inflater.decompress(packed))
            packed = inflater.unused_data if inflater.eof else stream.read(CHUNK)
        yield b"".join(parts)
        packed = packed or stream.read(CHUNK)


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Record head, HTTP head and payload of one record, framed by Content-Length, with digests checked."""
    def heads(block: bytes) -> tuple[dict[str, str], bytes]:
        head, mark, rest = block.partition(b"\r\n\r\n")
        if not mark:
            raise ValueError("a head without an end")
        lines = head.decode().split("\r\n")
        return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])} | {"": lines[0]}, rest

    head, rest = heads(data)
    length = int(head["content-length"])
    block, end = rest[:length], rest[length:]
    if not head[""].startswith("WARC/") or len(block) != length or end != b"\r\n\r\n":
        raise ValueError("a record does not fit its Content-Length")
    if head["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError("a block differs from its digest")
    http, payload = heads(block)
    if head["warc-type"] == "response" and (
        len(payload) != int(http["content-length"]) or head["warc-payload-digest"] != f"sha256:{hashlib.sha256(payload).hexdigest()}"
    ):
        raise ValueError("a payload differs from its length or digest")
    return head, http, payload


def read_archives(archives: DataFrame, page_id_type: str = "bigint", payload: bool = True) -> DataFrame:
    """One row per record of the listed archives, each archive read by one task; ``payload`` is null for revisits."""

    def page(name: str | None) -> str | None:
        found = None if name is None else name.removeprefix("<urn:page:").removesuffix(">")
        return None if found == "None" else found

    def read(batches):
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                where, path = fs.FileSystem.from_uri(archive)
                rows, size = [], 0
                with where.open_input_stream(path, compression=None) as stream:
                    try:
                        for data in inflate(stream):
                            head, http, body = parse(data)
                            rows.append((page(head["warc-record-id"]), head.get("warc-target-uri"), int(http["content-length"]),
                                         head["warc-payload-digest"].removeprefix("sha256:"), head["warc-type"], page(head.get("warc-refers-to")),
                                         body if payload and head["warc-type"] == "response" else None))
                            size += len(body)
                            if size > (4 << 20) or len(rows) >= 10_000:
                                yield _rows(rows)
                                rows, size = [], 0
                    except (ValueError, KeyError, zlib.error) as error:
                        raise ValueError(f"{archive}: {error}") from error
                yield _rows(rows)

    def _rows(rows):
        columns = list(zip(*rows)) or [()] * 7
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    spread = archives.select("archive").repartition(max(1, archives.count()), "archive")  # a stated number is not made smaller by adaptive execution
    rows = spread.mapInArrow(read, "page_id string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, payload binary")
    return rows.withColumns({name: F.col(name).cast(page_id_type) for name in ("page_id", "refers_to")})


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages to archives and returns what reading the archives gives."""
    pages = table(spark, sf_dir, "pages")
    archives = write_archives(mark_revisits(pages), open_folder(spark, f"warc-{uuid.uuid4().hex}"))
    return read_archives(archives, pages.schema["page_id"].dataType.simpleString(), payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM f
"""
