"""Feature rows: strip, tokens, chunks, and the fixed-size arrays a scorer reads."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagesieve.functions.text import stripped

MAX_NODES, MAX_TOKENS, ROW_TOKENS = 384, 5, 50
# Ids of the start, padding and end token.
START, PAD, END = 0, 1, 2


def strip_filter(nodes: DataFrame, text: str = "Text") -> DataFrame:
    """nodes whose text is not empty once stripped, with the stripped text."""
    return nodes.withColumn(text, stripped(F.col(text))).where(F.length(text) > 0)


def chunk_number(page: list[str], order: list[Column], size: int = MAX_NODES) -> Column:
    """Number of the consecutive slice of a page's nodes that a node falls in."""
    return F.floor((F.row_number().over(Window.partitionBy(*page).orderBy(*order)) - 1) / size).cast("int")


def chunk_rows(nodes: DataFrame, page: str, node: str, tokens: str | None = None, labels: str | None = None, size: int = MAX_NODES) -> DataFrame:
    """(chunk, NodeIds, Url, TokenId?, Labels?): parallel arrays of each slice of a page in document order."""
    fields = [c for c in (node, tokens, labels) if c]
    numbered = nodes.withColumn("chunk", chunk_number([page], [F.desc(node)], size))
    rows = numbered.groupBy(page, "chunk").agg(F.sort_array(F.collect_list(F.struct(*fields)), asc=False).alias("rows"))
    out = ["chunk", F.transform("rows", lambda x: x[node]).alias("NodeIds"), F.array_repeat(page, F.size("rows")).alias("Url")]
    if tokens:
        out.append(F.transform("rows", lambda x: x[tokens]).alias("TokenId"))
    if labels:
        out.append(F.transform("rows", lambda x: x[labels]).alias("Labels"))
    return rows.select(*out)


def feature_json(chunks: DataFrame) -> DataFrame:
    """(json): each chunk as one compact JSON line."""
    keep = [c for c in ("Labels", "TokenId", "NodeIds", "Url") if c in chunks.columns]
    return chunks.select(F.to_json(F.struct(*keep)).alias("json"))


Tokenizer = Callable[[list[str]], list[list[int]]]


def codepoint_tokenizer(texts: list[str]) -> list[list[int]]:
    """A stand-in for a vocabulary that is not at hand: one id a word, by hash, above the special ids."""
    import xxhash

    return [[3 + xxhash.xxh32_intdigest(w) % 250_000 for w in t.split()] for t in texts]


def sentencepiece_tokenizer(model: str) -> Tokenizer:
    """Token ids of a sentencepiece model file, read once in each worker."""
    held: list = []

    def run(texts: list[str]) -> list[list[int]]:
        if not held:
            import sentencepiece

            held.append(sentencepiece.SentencePieceProcessor(model_file=model))
        return held[0].encode(texts, num_threads=1)

    return run


def tokenized(nodes: DataFrame, tokenizer: Tokenizer = codepoint_tokenizer, text: str = "text", width: int = ROW_TOKENS) -> DataFrame:
    """nodes with TokenId: start and end token around the text's tokens, cut and padded to the width. Null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            ids = tokenizer([t or "" for t in batch.column(at).to_pylist()])
            rows = [[START, *i[: width - 2], END] for i in ids]
            rows = [r + [PAD] * (width - len(r)) for r in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.int32()))], [*batch.schema.names, "TokenId"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields) + ", TokenId ARRAY<INT>"
    return nodes.mapInArrow(run, ddl)


def cut_tokens(tokens: Column, width: int = MAX_TOKENS) -> Column:
    """The first width - 1 ids and the end token."""
    return F.concat(F.slice(tokens, 1, width - 1), F.array(F.lit(END)))


def mask(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: (t != PAD).cast("int"))


def padded(flat: Column, length: int) -> Column:
    """A flat array padded with 0 on the right."""
    return F.concat(flat, F.array_repeat(F.lit(0), F.greatest(F.lit(length) - F.size(flat), F.lit(0))))


def tensors(rows: DataFrame, nodes: int = MAX_NODES, width: int = MAX_TOKENS) -> DataFrame:
    """rows with token_ids, token_mask, node_ids (and labels, where the rows have Labels) of fixed length."""
    cut = F.transform(F.slice("TokenId", 1, nodes), lambda t: cut_tokens(t, width))
    out = rows.withColumn("_cut", cut)
    out = out.withColumn("token_ids", padded(F.flatten("_cut"), nodes * width))
    out = out.withColumn("token_mask", padded(F.flatten(F.transform("_cut", mask)), nodes * width))
    out = out.withColumn("node_ids", padded(F.slice("NodeIds", 1, nodes), nodes))
    if "Labels" in rows.columns:
        out = out.withColumn("labels", padded(F.flatten(F.slice("Labels", 1, nodes)), nodes * 6))
    return out.drop("_cut")


def position(p: Column, i: Column, d: int) -> Column:
    """Positional encoding: pairs of neighbouring positions share an angle; even places are sines, odd ones cosines."""
    angle = F.floor(p / 2) * F.exp(-(F.lit(2.0) * F.floor(i / 2) / d) * F.ln(F.lit(10000.0)))
    return F.when(i % 2 == 0, F.sin(angle)).otherwise(F.cos(angle))
