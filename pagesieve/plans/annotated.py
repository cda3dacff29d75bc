"""Annotated pages: primary content with offsets of their annotations, and labelled feature rows for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.functions.dom import parse_pages
from pagesieve.operators.features import Tokenizer, chunk_rows, codepoint_tokenizer, tokenized
from pagesieve.operators.labels import TYPES, gold_flag, multi_hot, propagated, table_annotations, with_fallback
from pagesieve.operators.nodes import br_before, candidates, is_inline, text_ends
from pagesieve.operators.render import invisible_runs, node_offsets, page_text, part_offsets, rendered, title_offsets
from pagesieve.operators.visual import parsed, visible, with_defaults


def annotated_nodes(pages: DataFrame) -> DataFrame:
    """Nodes with their features of pages (url, html, nodeRawFeature); a node without a raw string has zeros."""
    nodes = br_before(parse_pages(pages, ids="read"))
    raws = parsed(pages.select("url", F.explode("nodeRawFeature").alias("raw"))).where("node_id IS NOT NULL").dropDuplicates(["url", "node_id"])
    return with_defaults(nodes, raws)


def _fields(prefix: str = "") -> list[Column]:
    c = lambda n: F.col(prefix + n)
    return [
        visible(c("position_w"), c("position_h"), c("opacity")).alias("visible"), c("brs").alias("brs"), c("block_id").alias("block_id"),
        is_inline(c("parent_tag"), c("parent_style")).alias("inline"), c("position_x").alias("x"), c("position_w").alias("w"),
        c("offset_left").alias("offset_left"), c("client_left").alias("client_left"),
    ]


def primary_pieces(nodes: DataFrame, annotations: DataFrame, binary: bool = False, add_title: bool = True) -> DataFrame:
    """Rendered pieces of the Primary nodes in document order, the page's title before them. Pages without Primary take
    every text node. An element's separator follows its first text node."""
    listed = with_fallback(annotations, nodes).where("type = 1").select("url", "node_id").distinct()
    wanted = nodes.join(listed, ["url", "node_id"], "left_semi").where(F.length(F.btrim("own_text", F.lit("\r\n\t\xa0 "))) > 0)
    ends = text_ends(nodes, wanted.select("url", "node_id", "last_desc_id")).select("url", "node_id", "first_text_id")
    firsts = nodes.select("url", F.col("node_id").alias("first_text_id"), F.col("own_text").alias("first_text"), *_fields())
    pieces = wanted.select("url", "node_id", F.col("own_text").alias("text")).join(ends, ["url", "node_id"]).join(firsts, ["url", "first_text_id"], "left")
    pieces = pieces.withColumn("seq", -F.col("node_id")).withColumn("title", F.lit(False)).drop("first_text_id", "first_text")
    if add_title:
        first = nodes.where("tag = 'title'").groupBy("url").agg(F.min_by("node_id", "doc_order").alias("node_id"))
        titles = nodes.join(first, ["url", "node_id"]).where(F.length(F.btrim("own_text", F.lit("\r\n\t\xa0 "))) > 0)
        rows = titles.select("url", "node_id", F.col("own_text").alias("text"), *_fields(), F.lit(-(2**31)).alias("seq"), F.lit(True).alias("title"))
        pieces = pieces.unionByName(rows)
    return rendered(pieces, binary=binary)


def primary_content(pages: DataFrame, annotations: DataFrame, binary: bool = False, add_title: bool = True) -> tuple[DataFrame, DataFrame]:
    """((url, text), (url, name, node_id, start, end)): the primary text of each page and the offsets of its annotations."""
    nodes = annotated_nodes(pages)
    known = annotations.join(nodes.select("url", "node_id").distinct(), ["url", "node_id"], "left_semi")
    pieces = primary_pieces(nodes, known, binary, add_title)
    offsets = pieces.select("url", "node_id", "start", "end")
    body = pieces.where("NOT title").select("url", "node_id", "start", "end")
    of = lambda t: known.where(F.col("type") == t).select("url", "node_id").distinct().join(nodes.select("url", "node_id", "parent_id", "last_desc_id"), ["url", "node_id"])
    named = [pieces.where("title").select("url", F.lit("HtmlTitle").alias("name"), "node_id", "start", "end")]
    named.append(title_offsets(offsets, of(3)).select("url", F.lit("Title").alias("name"), "node_id", "start", "end"))
    for t in (2, 4, 5, 6):
        named.append(node_offsets(body, of(t)).select("url", F.lit(TYPES[t]).alias("name"), "node_id", "start", "end"))
    named.append(part_offsets(nodes, body, table_annotations(known)))
    named.append(invisible_runs(pieces).select("url", F.lit("InvisibleText").alias("name"), "node_id", "start", "end"))
    out = named[0]
    for n in named[1:]:
        out = out.unionByName(n)
    return page_text(pieces), out


def training_rows(pages: DataFrame, annotations: DataFrame, tokenizer: Tokenizer = codepoint_tokenizer) -> DataFrame:
    """(NodeIds, Url, TokenId, Labels): feature rows with six labels a node."""
    nodes = annotated_nodes(pages)
    known = annotations.join(nodes.select("url", "node_id").distinct(), ["url", "node_id"], "left_semi")
    types = propagated(with_fallback(known, nodes), nodes)
    found = multi_hot(candidates(nodes).select("url", "node_id", "text"), types)
    return chunk_rows(tokenized(found, tokenizer), "url", "node_id", "TokenId", "labels").drop("chunk")


def test_rows(pages: DataFrame, annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gold rows, text nodes) of annotated pages: gold flags are the nodes listed as Primary themselves."""
    nodes = annotated_nodes(pages)
    found = candidates(nodes).where(F.length("text") > 0).select("url", "node_id", "text")
    rows = gold_flag(found, with_fallback(annotations, nodes)).select(
        F.col("url").alias("Url"), F.col("node_id").alias("TextNodeId"), F.col("text").alias("Text"), F.col("is_primary").alias("JudgmentIsPrimary")
    )
    return rows, rows.drop("JudgmentIsPrimary")


test_rows.__test__ = False  # no test, for collectors that go by names
