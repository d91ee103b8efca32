"""WARC archives: written one gzip member a record, read back in sequence.

Writing. Each page is one record with the page's bytes behind an HTTP header. Of records whose payloads are equal
and have at least ``MIN_REVISIT`` bytes, that of the smallest page_id is a ``response``; the others are
``revisit`` records that name it and carry no payload. Each task writes one archive, under a name of its own that
is renamed at the end, so a task that runs again leaves the same file.

Reading. ``records`` takes the bytes of an archive in blocks, inflates one gzip member after the other, finds the
ends of header and block by content-length, and verifies the block and payload digests. It holds one record.

A null html counts as empty; a null page_id is kept and is never named by a revisit. Rows that
repeat the smallest page_id of a payload are all responses. Long pages are handled whole, one at a time.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_fields, file_system, mapped, move, new_path, only, written

MIN_REVISIT = 100
#: Compression level of records: pages are repetitive, higher levels cost several times the CPU.
LEVEL = 1
_BLOCK = 1 << 16
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2000-01-01T00:00:00Z"
_RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _digest(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member. ``refers_to``: the page that a revisit names."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    name = "null" if page_id is None else page_id
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {_DATE}",
        *([] if url is None else [f"WARC-Target-URI: {_escaped(url)}"]),
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"] if revisit else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: {_digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def _escaped(url: str) -> str:
    """A header value is one line: percent signs, control characters and spaces are percent-encoded."""
    return re.sub("[%\0- \x7f\x85]", lambda m: f"%{ord(m[0]):02X}", url)


def _unescaped(url: str) -> str:
    return re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), url)


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes


def members(blocks: Iterable[bytes]) -> Iterator[bytes]:
    """The content of each gzip member, inflated as its bytes come."""
    inflate, parts, rest, more = None, [], b"", iter(blocks)
    while True:
        if not rest:
            rest = next(more, b"")
            if not rest:
                break
        if inflate is None:
            inflate, parts = zlib.decompressobj(31), []
        parts.append(inflate.decompress(rest))
        rest = inflate.unused_data
        if inflate.eof:
            inflate = None
            yield b"".join(parts)
    if inflate is not None:
        raise ValueError("an archive ends inside a record")


def records(blocks: Iterable[bytes], verify: bool = True) -> Iterator[Record]:
    """The records of an archive. Raises ValueError where a length or a digest doesn't hold."""
    for data in members(blocks):
        end = data.find(b"\r\n\r\n")
        lines = data[:end].decode().split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/1."):
            raise ValueError("not a WARC record")
        headers = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
        size = int(headers["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size or data[end + 4 + size :] != b"\r\n\r\n":
            raise ValueError("content-length and record differ")
        if verify and headers.get("warc-block-digest") not in (None, _digest(block)):
            raise ValueError("block digest and block differ")
        yield Record(headers, block)


def _page(text: str) -> int | None:
    name = text.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "null" else int(name)


def row_of(r: Record) -> tuple:
    """A record as a row of ``_RECORDS``; a response's payload must have the digest that its header names."""
    h = r.headers
    end = r.block.index(b"\r\n\r\n") + 4
    size = next(int(x.split(b":")[1]) for x in r.block[:end].split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = h["warc-payload-digest"]
    if h["warc-type"] == "response" and (len(r.block) - end != size or _digest(r.block[end:]) != digest):
        raise ValueError("payload digest and payload differ")
    url = h.get("warc-target-uri")
    refers = h.get("warc-refers-to")
    return _page(h["warc-record-id"]), None if url is None else _unescaped(url), size, digest.removeprefix("sha256:"), h["warc-type"], None if refers is None else _page(refers)


def with_types(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, refers_to. Only digests and ids are grouped; a payload that a third of all pages
    share is one group of partial minima, and its pages are joined back by Spark's skew join."""
    html = F.coalesce("html", F.lit(""))
    digested = only(pages, "page_id", "url", "html").withColumn("html", html).withColumn("digest", F.sha2(F.encode(html, "UTF-8"), 256))
    least = digested.where(F.octet_length("html") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").drop("n")
    least = written(least, "payloads")  # a table of its own: Spark can then split the partition of a common payload
    refers_to = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return digested.join(least, "digest", "left").select("page_id", "url", "html", "digest", refers_to.alias("refers_to"))


def write(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the archives below ``path`` (a folder that all see) and returns their names."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = file_system(path)
        task = TaskContext.get()
        own, name, out = f"{at}/.{task.partitionId():06d}-{task.taskAttemptId()}", f"{task.partitionId():06d}.warc.gz", None
        for batch in batches:
            for page, url, html, digest, first in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    fs.create_dir(at)
                    out = fs.open_output_stream(own, compression=None)
                payload = html.encode()
                out.write(record(page, url, payload, digest, first))
        if out is not None:
            out.close()
            move(fs, own, f"{at}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{name}"])], ["archive"])

    names = f"{path}/names"
    mapped(with_types(pages), archive, "archive string").write.parquet(names)
    return spark.read.schema("archive string").parquet(names)


def read(archives: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of each record of the archives."""
    names, types = arrow_fields(archives.sparkSession, _RECORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = file_system(path)
                with fs.open_input_stream(at, compression=None) as f:
                    rows = []
                    for r in records(iter(lambda: f.read(_BLOCK), b"")):
                        rows.append(row_of(r))
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return mapped(archives.select("archive").repartition(max(1, archives.sparkSession.sparkContext.defaultParallelism * 4)), run, _RECORDS)
