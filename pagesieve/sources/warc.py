"""WARC archives: sequential scans, and point lookups through an index of fixed-width offsets."""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one record of an offset index: ten digits and a line feed.
OFFSET_BYTES = 11
_header = re.compile(rb"^([A-Za-z0-9-]+):[ \t]*(.*?)\r?$", re.M)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, body) of each record of an uncompressed archive."""
    at = 0
    while True:
        at = data.find(b"WARC/", at)
        if at < 0:
            return
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        headers = {k.decode().lower(): v.decode("utf-8", "replace") for k, v in _header.findall(data[at:end])}
        size = int(headers.get("content-length", "0") or 0)
        body = data[end + 4 : end + 4 + size]
        yield headers, body
        at = end + 4 + size


def http_body(record: bytes) -> bytes:
    """The body of an HTTP response, with gzip and chunks undone."""
    head, _, body = record.partition(b"\r\n\r\n")
    low = head.lower()
    if b"transfer-encoding: chunked" in low:
        out, at = [], 0
        while True:
            line = body.find(b"\r\n", at)
            try:
                size = int(body[at:line].split(b";")[0], 16)
            except ValueError:
                break
            if line < 0 or size == 0:
                break
            out.append(body[line + 2 : line + 2 + size])
            at = line + 4 + size
        body = b"".join(out)
    if b"content-encoding: gzip" in low:
        try:
            body = gzip.decompress(body)
        except (OSError, EOFError):
            pass
    return body


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """(url, content) of the response records of the archives below path. An archive is the unit of work."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.where(F.col("path").rlike("\\.warc(\\.gz)?$")).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_py()
                if name.endswith(".gz"):
                    data = gzip.GzipFile(fileobj=io.BytesIO(data)).read()
                urls, bodies = [], []
                for headers, record in parse_records(data):
                    if headers.get("warc-type") == "response":
                        urls.append(headers.get("warc-target-uri"))
                        bodies.append(http_body(record))
                yield pa.record_batch([pa.array(urls, pa.string()), pa.array(bodies, pa.binary())], ["url", "content"])

    return files.mapInArrow(run, "url STRING, content BINARY")


def base_path(cw22id: Column, root: str, kind: str = "html") -> Column:
    """Path of the files that hold a document, from an id of the form clueweb22-<dir>-<file>-<doc>."""
    parts = F.split(cw22id, "-")
    d = parts[1]
    return F.concat_ws("/", F.lit(f"{root}/{kind}"), F.substring(d, 1, 2), F.substring(d, 1, 4), d, F.concat(d, F.lit("-"), parts[2]))


def document_number(cw22id: Column) -> Column:
    return F.try_element_at(F.split(cw22id, "-"), F.lit(-1)).cast("int")


def offset_at(index: Column, doc: Column) -> Column:
    """The byte offset of a document in an offset index held as a string."""
    return F.substring(index, (doc * OFFSET_BYTES + 1).cast("int"), F.lit(OFFSET_BYTES - 1)).cast("long")


def html_of(record: str) -> str:
    """A record's page: what follows the header up to its first blank line."""
    lines = record.splitlines(keepends=True)
    for i, line in enumerate(lines):
        if not line.strip():
            return "".join(lines[i + 1 :])
    return ""


def lookup(ids: DataFrame, root: str) -> DataFrame:
    """(cw22id, html) of documents by id: archive paths and places are columns, and each task opens its archives, seeks and
    inflates one record. Ids whose record can't be read are left out."""
    placed = ids.select("cw22id", base_path(F.col("cw22id"), root).alias("base"), document_number(F.col("cw22id")).alias("doc"))
    placed = placed.where("doc IS NOT NULL").repartition("base").sortWithinPartitions("base", "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, str]] = []
            for cw, base, doc in zip(*(batch.column(c).to_pylist() for c in ("cw22id", "base", "doc")), strict=True):
                try:
                    with open(f"{base}.warc.offset", "rb") as f:
                        f.seek(doc * OFFSET_BYTES)
                        start, end = int(f.read(OFFSET_BYTES)), int(f.read(OFFSET_BYTES))
                    with open(f"{base}.warc.gz", "rb") as f:
                        f.seek(start)
                        out.append((cw, html_of(gzip.decompress(f.read(end - start)).decode())))
                except (OSError, ValueError, EOFError, UnicodeDecodeError):
                    continue
            yield pa.record_batch([pa.array([a for a, _ in out], pa.string()), pa.array([b for _, b in out], pa.string())], ["cw22id", "html"])

    return placed.mapInArrow(run, "cw22id STRING, html STRING")


def fetched(urls: DataFrame, timeout: float = 20.0) -> DataFrame:
    """(url, status, content) of each url by HTTP GET; the status is null where there was no answer, content only for 200."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from urllib.error import HTTPError, URLError
        from urllib.request import Request, urlopen

        for batch in batches:
            rows = []
            for url in batch.column(0).to_pylist():
                status, body = None, None
                try:
                    with urlopen(Request(url, headers={"User-Agent": "pagesieve"}), timeout=timeout) as r:
                        status, body = r.status, r.read()
                except HTTPError as e:
                    status = e.code
                except (URLError, OSError, ValueError):
                    pass
                rows.append((url, status, body if status == 200 else None))
            u, s, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.record_batch([pa.array(u, pa.string()), pa.array(s, pa.int32()), pa.array(b, pa.binary())], ["url", "status", "content"])

    return urls.select("url").mapInArrow(run, "url STRING, status INT, content BINARY")
