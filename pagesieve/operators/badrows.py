"""Rows that fail to parse: sound records come out typed, faulty ones apart with one reason each.

Blocks of records are parsed at once by the columnar CSV reader. A block passes only as a whole, when every
record gives one row of the right width, quoting is strict and every value is valid; a failing block is
halved again and again until its bad records stand alone, and those are diagnosed one by one by a strict
reader. The work is local to a partition: no shuffle, and no state beyond one Arrow batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pcsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Records parsed at once before any halving.
BLOCK = 256

# The record layouts and the tasks of the prediction files.
LAYOUTS = {
    "inference_test.tsv": ("\t", ("url", "node_id", "task")),
    "textnodes.csv": (",", ("url", "node_id", "text")),
    "goldlabels.csv": (",", ("url", "node_id", "text", "judgment")),
}
TASKS = ("Primary", "Heading", "Title", "Paragraph", "Table", "List")
INT_MAX = 2147483647

#: Unicode whitespace as the inside of a character class, the same in every regex engine.
SPACE = "\\t\\n\\x0b\\f\\r\\x1c-\\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
URL = (
    rf"^[hH][tT][tT][pP][sS]?://(?:[^{SPACE}/?#]*@)?(?:[^{SPACE}/?#:@\[\]]+|\[[^{SPACE}/?#@\]]+\])"
    rf"(?::[^{SPACE}/?#@]*)?(?:[/?#][^{SPACE}]*)?$"
)
FIELD = r'(?:[^",]*|"(?:[^"]|"")*")'
STRICT_CSV = rf"^{FIELD}(?:,{FIELD})*$"
#: What the columnar reader may see: a line break outside quotes would make two rows of a record, or be lost with an empty one.
FAST_FIELD = r'(?:[^",\n\r]*|"(?:[^"]|"")*")'
FAST_CSV, FAST_TSV = rf"^{FAST_FIELD}(?:,{FAST_FIELD})*$", r"^[^\n\r]*$"
BOOL = r"^(?:[tT][rR][uU][eE]|[fF][aA][lL][sS][eE])$"

_url = re.compile(URL[:-1] + r"\Z")
_digits = re.compile(r"[0-9]+\Z")
_bool = re.compile(BOOL[:-1] + r"\Z")
_field = re.compile(r'"((?:[^"]|"")*)"|([^",]*)')

OUT = pa.schema(
    [
        ("row_id", pa.int64()),
        ("file_name", pa.string()),
        ("reason", pa.string()),
        ("url", pa.string()),
        ("node_id", pa.int32()),
        ("task", pa.string()),
        ("text", pa.string()),
        ("judgment", pa.bool_()),
    ]
)
DDL = "row_id BIGINT, file_name STRING, reason STRING, url STRING, node_id INT, task STRING, text STRING, judgment BOOLEAN"


def split_strict(record: str, delimiter: str) -> list[str] | None:
    """The fields of one record, or None where the quoting is broken. Tab-separated records know no quotes."""
    if delimiter == "\t":
        return record.split("\t")
    fields, at = [], 0
    while True:
        m = _field.match(record, at)
        quoted, plain = m.group(1), m.group(2)
        fields.append(quoted.replace('""', '"') if quoted is not None else plain)
        at = m.end()
        if at == len(record):
            return fields
        if record[at] != ",":
            return None
        at += 1


def diagnose(record: str | None, file_name: str | None) -> tuple[str | None, dict]:
    """(reason, typed fields) of one record; the reason is None when the record is sound.

    A null record has no fields and a file of unknown name has no layout: both are `columns`.
    """
    layout = LAYOUTS.get((file_name or "").lower())
    if record is None or layout is None:
        return "columns", {}
    delimiter, names = layout
    fields = split_strict(record[:-1] if record.endswith("\r") else record, delimiter)
    if fields is None:
        return "quoting", {}
    if len(fields) != len(names):
        return "columns", {}
    row = dict(zip(names, fields, strict=True))
    if not (_url.match(row["url"]) and _digits.match(row["node_id"]) and int(row["node_id"].lstrip("0")[:11] or 0) <= INT_MAX):
        return "value", {}
    if "task" in row and row["task"] not in TASKS or "judgment" in row and not _bool.match(row["judgment"]):
        return "value", {}
    row["node_id"] = int(row["node_id"])
    if "judgment" in row:
        row["judgment"] = row["judgment"].lower() == "true"
    return None, row


def _parse_block(raw: pa.StringArray, delimiter: str, names: tuple[str, ...]) -> dict[str, pa.Array] | None:
    """The block's typed columns, or None if any of its records may be faulty."""
    tsv = delimiter == "\t"
    if not pc.all(pc.match_substring_regex(raw, FAST_TSV if tsv else FAST_CSV)).as_py():
        return None
    buf = pa.py_buffer("\n".join(raw.to_pylist()).encode())
    try:
        got = pcsv.read_csv(
            pa.BufferReader(buf),
            read_options=pcsv.ReadOptions(column_names=list(names), use_threads=False, block_size=buf.size + 1),
            parse_options=pcsv.ParseOptions(delimiter=delimiter, quote_char=False if tsv else '"', double_quote=True, newlines_in_values=not tsv),
            convert_options=pcsv.ConvertOptions(column_types=dict.fromkeys(names, pa.string()), strings_can_be_null=False, null_values=[]),
        )
        if got.num_rows != len(raw):
            return None
        cols = {n: got[n].combine_chunks() for n in names}
        ok = [pc.match_substring_regex(cols["url"], URL), pc.match_substring_regex(cols["node_id"], "^[0-9]+$")]
        if "task" in cols:
            ok.append(pc.is_in(cols["task"], pa.array(TASKS)))
        if "judgment" in cols:
            ok.append(pc.match_substring_regex(cols["judgment"], BOOL))
            cols["judgment"] = pc.equal(pc.utf8_lower(cols["judgment"]), "true")
        if not all(pc.all(x).as_py() for x in ok):
            return None
        cols["node_id"] = pc.cast(cols["node_id"], pa.int32())
        return cols
    except pa.ArrowInvalid:
        return None


def _emit(ids: pa.Array, file_name: str, cols: dict[str, pa.Array]) -> pa.RecordBatch:
    n = len(ids)
    at = {"row_id": ids, "file_name": pa.array([file_name] * n, pa.string())} | cols
    return pa.record_batch([at[f.name] if f.name in at else pa.nulls(n, f.type) for f in OUT], schema=OUT)


def _bisect(ids: pa.Array, raw: pa.Array, file_name: str, out: list[pa.RecordBatch], singles: list[tuple]) -> None:
    delimiter, names = LAYOUTS[file_name.lower()]
    cols = _parse_block(raw, delimiter, names)
    if cols is not None:
        out.append(_emit(ids, file_name, cols))
    elif len(ids) == 1:
        # diagnose() takes a final carriage return off; the record has lost its own
        singles.append((ids[0].as_py(), file_name, raw[0].as_py() + "\r"))
    else:
        half = len(ids) // 2
        _bisect(ids[:half], raw[:half], file_name, out, singles)
        _bisect(ids[half:], raw[half:], file_name, out, singles)


def parse_batch(batch: pa.RecordBatch, block: int = BLOCK) -> list[pa.RecordBatch]:
    """Typed and diagnosed rows of one batch of (row_id, file_name, raw)."""
    out: list[pa.RecordBatch] = []
    singles: list[tuple] = []
    names = batch.column("file_name")
    for name in pc.unique(names).to_pylist():
        part = batch.filter(pc.is_null(names) if name is None else pc.equal(names, name))
        if name is None or name.lower() not in LAYOUTS:
            singles += [(i, name, r) for i, r in zip(part["row_id"].to_pylist(), part["raw"].to_pylist(), strict=True)]
            continue
        gone = pc.is_null(part["raw"])
        singles += [(i, name, None) for i in part.filter(gone)["row_id"].to_pylist()]
        part = part.filter(pc.invert(gone))
        raw = pc.replace_substring_regex(part["raw"], pattern=r"\r\z", replacement="")
        for at in range(0, len(raw), block):
            _bisect(part["row_id"][at : at + block], raw[at : at + block], name, out, singles)
    if singles:
        rows = []
        for row_id, name, record in singles:
            reason, typed = diagnose(record, name)
            rows.append({"row_id": row_id, "file_name": name, "reason": reason} | typed)
        out.append(pa.RecordBatch.from_pylist(rows, schema=OUT))
    return out


def parsed_rows(raw_rows: DataFrame, row_id: str = "row_id", file_name: str = "file_name", raw: str = "raw", block: int = BLOCK) -> DataFrame:
    """One row for each input row: typed fields where it is sound, else a reason (quoting, columns, value).

    Null or unknown file names and null records are `columns`; an empty record is one empty field, so
    `columns` too; repeated rows are kept; other columns of the input are ignored; no rows in, no rows out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from parse_batch(batch, block)

    picked = raw_rows.select(
        F.col(row_id).cast("long").alias("row_id"), F.col(file_name).cast("string").alias("file_name"), F.col(raw).cast("string").alias("raw")
    )
    return picked.mapInArrow(run, DDL)


def separate(raw_rows: DataFrame, **columns: str) -> tuple[DataFrame, DataFrame]:
    """(sound typed rows, faulty rows with their reason)."""
    both = parsed_rows(raw_rows, **columns)
    return both.where("reason IS NULL").drop("reason"), both.where("reason IS NOT NULL").select("row_id", "file_name", "reason")
