"""Bytes to text, and the language of a text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A few frequent words of each language, enough to tell them apart.
PROFILES = {
    "en": "the of and to in is that for on with as was it by this at from are",
    "de": "der die das und in zu den von mit ist auf nicht ein eine im des für",
    "fr": "le la les des et à de un une du en dans que pour sur est au avec",
    "es": "el la los las de que y en un una por con del se para su al lo",
    "pt": "o a os as de que e em um uma do da para com não por no na",
    "it": "il la di che e un una per in del con non sono della nel le gli",
    "nl": "de het een van en in is dat op te voor met zijn niet aan er",
}


def decode_bytes(raw: bytes) -> str | None:
    """UTF-8 where it is valid, else the western charset, else None: a byte that charset leaves undefined."""
    for codec in ("utf-8", "cp1252"):
        try:
            return raw.decode(codec)
        except UnicodeDecodeError:
            continue
    return None


def decoded(pages: DataFrame, content: str = "content") -> DataFrame:
    """pages with html in place of the bytes; pages that can't be decoded are left out."""
    names = [c for c in pages.columns if c != content]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = pa.array([None if b is None else decode_bytes(b) for b in batch.column(content).to_pylist()], pa.string())
            out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), html], [*names, "html"])
            yield out.filter(html.is_valid())

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name != content) + ", html STRING"
    return pages.mapInArrow(run, ddl)


def without_controls(text: Column) -> Column:
    """The text without control, format and unassigned characters."""
    return F.regexp_replace(text, "\\p{C}", "")


def language(text: Column) -> Column:
    """The language whose frequent words occur most, null without any; ties go to the earlier name of the list."""
    words = F.split(F.lower(text), "[^\\p{L}]+")
    counts = [F.size(F.filter(words, _among(p.split()))).alias(k) for k, p in PROFILES.items()]
    best = F.greatest(*counts)
    out = F.lit(None).cast("string")
    for k, c in reversed(list(zip(PROFILES, counts, strict=True))):
        out = F.when(c == best, k).otherwise(out)
    return F.when(best > 0, out)


def _among(words: list[str]):
    return lambda w: w.isin(*words)
