"""Page text from predicted nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesieve.session import without_nulls


def predicted_text(predictions: DataFrame, textnodes: DataFrame, task: str | None = None) -> DataFrame:
    """(Url, TextNodeId, Task, Text): predictions with the text of their nodes. Rows with any null are dropped, which makes
    the left join an inner one; repeated rows multiply."""
    p = predictions.select("Url", "TextNodeId", "Task")
    if task is not None:
        p = p.where(F.col("Task") == task)
    return p.join(textnodes.select("Url", "TextNodeId", "Text"), ["Url", "TextNodeId"], "left").transform(without_nulls)


def page_texts(joined: DataFrame) -> DataFrame:
    """(Url, Task, Text): texts of a page joined without separator in document order, which is descending ids.

    The order lives inside the aggregate, so nothing is sorted over the whole table.
    """
    return joined.groupBy("Url", "Task").agg(F.expr("listagg(Text, '') WITHIN GROUP (ORDER BY TextNodeId DESC, Text)").alias("Text"))


def lower_case(texts: DataFrame) -> DataFrame:
    """(url, text) as written to text files."""
    return texts.select(F.col("Url").alias("url"), F.col("Text").alias("text"))


def with_missing(texts: DataFrame, textnodes: DataFrame) -> DataFrame:
    """texts (Url, Text) and a null text for each page of textnodes without one."""
    pages = textnodes.where("Url IS NOT NULL").select("Url").distinct()
    return pages.join(texts.select("Url", "Text"), "Url", "left")


def first_seen(texts: DataFrame, textnodes: DataFrame, place: str) -> DataFrame:
    """texts with first_seen, the least place of each page among textnodes, to order a report by; rows of a frame have no
    order of their own, so the place is a column."""
    seen = textnodes.where("Url IS NOT NULL").groupBy("Url").agg(F.min(place).alias("first_seen"))
    return texts.join(seen, "Url", "left")
