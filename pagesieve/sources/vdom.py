"""Annotated pages: zip archives of protobuf messages, decoded by field number."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Field numbers of the message.
URL, URLHASH, LANGUAGE, TOPIC, HTML, ANNOTATION, RAW_FEATURE, CW22ID = range(1, 9)
NODE_ID, TYPE = 1, 2

MESSAGE = (
    "doc_id STRING, url STRING, urlhash STRING, language STRING, cw22id STRING, topic ARRAY<STRING>, content BINARY, "
    "annotations ARRAY<STRUCT<nodeId: INT, type: INT>>, nodeRawFeature ARRAY<STRING>"
)
_SCHEMA = pa.schema(
    [
        ("doc_id", pa.string()), ("url", pa.string()), ("urlhash", pa.string()), ("language", pa.string()), ("cw22id", pa.string()), ("topic", pa.list_(pa.string())),
        ("content", pa.binary()), ("annotations", pa.list_(pa.struct([("nodeId", pa.int32()), ("type", pa.int32())]))), ("nodeRawFeature", pa.list_(pa.string())),
    ]
)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 0x7F) << shift
        at += 1
        if b < 0x80:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a message in wire format."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            if at + size > len(data):
                raise ValueError("the message ends inside a field")
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, value


def decode(data: bytes) -> dict:
    """One message; missing fields have protobuf's defaults."""
    out = {"url": "", "urlhash": "", "language": "", "cw22id": "", "topic": [], "content": b"", "annotations": [], "nodeRawFeature": []}
    names = {URL: "url", URLHASH: "urlhash", LANGUAGE: "language", CW22ID: "cw22id"}
    for number, value in fields(data):
        if number in names:
            out[names[number]] = value.decode()
        elif number == HTML:
            out["content"] = value
        elif number == TOPIC:
            out["topic"].append(value.decode())
        elif number == RAW_FEATURE:
            out["nodeRawFeature"].append(value.decode())
        elif number == ANNOTATION:
            inner = dict(fields(value))
            signed = lambda n: n - (1 << 64) if n >= 1 << 63 else n
            out["annotations"].append({"nodeId": signed(inner.get(NODE_ID, 0)), "type": inner.get(TYPE, 0)})
    return out


def _put(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def encode(page: dict) -> bytes:
    """A message in wire format, for tests and for writing archives."""

    def field(number: int, value: bytes) -> bytes:
        return _put(number << 3 | 2) + _put(len(value)) + value

    out = b"".join(field(n, page[k].encode()) for n, k in ((URL, "url"), (URLHASH, "urlhash"), (LANGUAGE, "language"), (CW22ID, "cw22id")) if page.get(k))
    out += b"".join(field(TOPIC, t.encode()) for t in page.get("topic", ()))
    out += field(HTML, page.get("content", b""))
    for a in page.get("annotations", ()):
        out += field(ANNOTATION, _put(NODE_ID << 3) + _put(a["nodeId"]) + _put(TYPE << 3) + _put(a["type"]))
    return out + b"".join(field(RAW_FEATURE, r.encode()) for r in page.get("nodeRawFeature", ()))


def read_archives(spark: SparkSession, path: str, doc_ids: list[str] | None = None) -> DataFrame:
    """One row for each member of the zip archives below path; the doc id is the member's name without its extension.

    Archives are the unit of work; a member that is no message is left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(path).select("content")
    wanted = frozenset(doc_ids) if doc_ids is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for name in z.namelist():
                        doc = name[:-4]
                        if wanted is not None and doc not in wanted:
                            continue
                        try:
                            yield pa.RecordBatch.from_pylist([{"doc_id": doc} | decode(z.read(name))], schema=_SCHEMA)
                        except (ValueError, IndexError, UnicodeDecodeError):
                            continue

    return files.mapInArrow(run, MESSAGE)


def annotations(pages: DataFrame) -> DataFrame:
    """(url, node_id, type) from decoded messages."""
    return pages.select("url", F.explode("annotations").alias("a")).select("url", F.col("a.nodeId").alias("node_id"), "a.type")
