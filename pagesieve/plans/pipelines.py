"""End-to-end plans: pages to feature rows, pages to text, predictions to an evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesieve.functions.decode import decoded, language, without_controls
from pagesieve.functions.dom import parse_pages
from pagesieve.operators.evaluate import metrics, page_confusion
from pagesieve.operators.extract import page_texts, predicted_text
from pagesieve.operators.features import Tokenizer, chunk_rows, codepoint_tokenizer, tokenized
from pagesieve.operators.nodes import candidates


def html_pages(pages: DataFrame, wanted_language: str | None = "en") -> DataFrame:
    """(url, html) of raw pages (url, content) that decode and are in the wanted language. The filter stands before the
    parse, as nothing is pushed through it."""
    html = decoded(pages.select("url", "content"))
    if wanted_language is None:
        return html
    return html.where(language(without_controls(F.regexp_replace("html", "<[^>]*>", " "))) == wanted_language)


def build(html: DataFrame, tokenizer: Tokenizer = codepoint_tokenizer) -> tuple[DataFrame, DataFrame]:
    """(feature chunks, text nodes) of (url, html)."""
    found = candidates(parse_pages(html)).select("url", "node_id", "text")
    chunks = chunk_rows(tokenized(found, tokenizer), "url", "node_id", "TokenId").drop("chunk")
    texts = found.where(F.length("text") > 0).select(F.col("url").alias("Url"), F.col("node_id").alias("TextNodeId"), F.col("text").alias("Text"))
    return chunks, texts


def all_text(html: DataFrame) -> DataFrame:
    """(url, text) with every text node taken for Primary, as on pages without annotations. The fallback makes all text
    nodes the predictions, so no join is left: one parse, then one ordered aggregate."""
    found = candidates(parse_pages(html)).where("is_text")
    texts = found.select(F.col("url").alias("Url"), F.col("node_id").alias("TextNodeId"), F.lit("Primary").alias("Task"), F.col("text").alias("Text"))
    return page_texts(texts).select(F.col("Url").alias("url"), F.col("Text").alias("text"))


def evaluation(predictions: DataFrame, textnodes: DataFrame, gold: DataFrame) -> DataFrame:
    """One row of metrics of the Primary predictions against gold judgments."""
    texts = page_texts(predicted_text(predictions, textnodes, "Primary"))
    return metrics(page_confusion(texts, gold))
