"""Node tables: neighbours, parents, subtrees and blocks, as windows and joins on id intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagesieve.functions.dom import BLOCK, INLINE, WITH_TEXT
from pagesieve.functions.text import stripped


def linked(nodes: DataFrame, page: str = "url", node: str = "node_id") -> DataFrame:
    """nodes with prev_id and next_id in document order, which is descending ids; null at a page's ends."""
    order = Window.partitionBy(page).orderBy(F.desc(node))
    return nodes.withColumn("prev_id", F.lag(node).over(order)).withColumn("next_id", F.lead(node).over(order))


def text_linked(nodes: DataFrame) -> DataFrame:
    """Text nodes of a page with prev_text_id and next_text_id."""
    texts = linked(nodes.where("is_text"))
    return texts.withColumnRenamed("prev_id", "prev_text_id").withColumnRenamed("next_id", "next_text_id")


def candidates(nodes: DataFrame) -> DataFrame:
    """Text nodes with a text, and the elements whose whole text counts, with the stripped text."""
    kept = nodes.withColumn("text", stripped(F.coalesce("own_text", F.lit(""))))
    return kept.where((F.col("is_text") & (F.length("text") > 0)) | F.col("tag").isin(*sorted(WITH_TEXT)))


def titles(nodes: DataFrame) -> DataFrame:
    """(url, title): the text of the first title of each page."""
    first = nodes.where("tag = 'title'").groupBy("url").agg(F.min_by("node_id", "doc_order").alias("title_id"))
    inside = nodes.where("is_text").select("url", "parent_id", "own_text")
    return first.join(inside, (first["url"] == inside["url"]) & (first["title_id"] == inside["parent_id"]), "left").select(
        first["url"], stripped(F.coalesce("own_text", F.lit(""))).alias("title")
    )


def children(nodes: DataFrame) -> DataFrame:
    """(url, node_id, child_ids) in document order, for nodes that have children."""
    kids = F.sort_array(F.collect_list(F.struct("doc_order", "node_id")))
    grouped = nodes.where("parent_id IS NOT NULL").groupBy("url", F.col("parent_id").alias("parent")).agg(kids.alias("kids"))
    return grouped.select("url", F.col("parent").alias("node_id"), F.transform("kids", lambda x: x["node_id"]).alias("child_ids"))


def inside(outer: DataFrame, inner: DataFrame, page: str = "url") -> DataFrame:
    """Pairs (outer, inner) of one page where the inner id lies in the outer subtree: page is the equi key, the
    interval a residual test, so a page's nodes meet in one task and pages are spread."""
    o, i = outer.alias("o"), inner.alias("i")
    return o.join(i, (F.col(f"o.{page}") == F.col(f"i.{page}")) & F.col("i.node_id").between(F.col("o.node_id"), F.col("o.last_desc_id")))


def text_ends(nodes: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(url, node_id, first_text_id, last_text_id) of the wanted nodes' subtrees, null without a text node."""
    wanted = nodes if wanted is None else wanted
    found = inside(wanted.select("url", "node_id", "last_desc_id"), nodes.where("is_text").select("url", "node_id"))
    ends = found.groupBy("o.url", "o.node_id").agg(F.max("i.node_id").alias("first_text_id"), F.min("i.node_id").alias("last_text_id"))
    return wanted.select("url", "node_id").join(ends, ["url", "node_id"], "left")


def texts_under(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(url, node_id, text_id) of the text nodes under each wanted (url, node_id); unknown ids have none."""
    known = nodes.select("url", "node_id", "last_desc_id").join(wanted.select("url", "node_id"), ["url", "node_id"], "left_semi")
    found = inside(known, nodes.where("is_text").select("url", "node_id"))
    return found.select(F.col("o.url").alias("url"), F.col("o.node_id").alias("node_id"), F.col("i.node_id").alias("text_id"))


def descendants_by_tag(nodes: DataFrame, wanted: DataFrame, tags: list[str]) -> DataFrame:
    """(url, node_id, tag, ids): descendants-or-self with one of the tags, breadth first."""
    known = wanted.select("url", "node_id").distinct().join(nodes.select("url", "node_id", "last_desc_id"), ["url", "node_id"])
    found = inside(known, nodes.where(F.col("tag").isin(*tags)).select("url", "node_id", "tag", "depth", "doc_order"))
    ids = F.sort_array(F.collect_list(F.struct("i.depth", "i.doc_order", "i.node_id")))
    grouped = found.groupBy(F.col("o.url").alias("url"), F.col("o.node_id").alias("node_id"), F.col("i.tag").alias("tag")).agg(ids.alias("ids"))
    return grouped.withColumn("ids", F.transform("ids", lambda x: x["node_id"]))


def nested(listed: DataFrame, keys: list[str]) -> DataFrame:
    """listed (keys, node_id, last_desc_id) with is_nested: whether the id lies in [a, last_desc(a)) of a smaller listed
    id. The upper bound is exclusive, so the last descendant itself is kept."""
    order = Window.partitionBy(*keys).orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    return listed.withColumn("is_nested", F.coalesce(F.col("node_id") < F.max("last_desc_id").over(order), F.lit(False)))


def is_block(tag: Column) -> Column:
    return tag.isin(*sorted(BLOCK))


def is_inline(parent_tag: Column, parent_style: Column) -> Column:
    """Whether a text node's parent is inline by style or tag."""
    return F.coalesce(parent_style.contains("display:inline"), F.lit(False)) | F.coalesce(parent_tag.isin(*sorted(INLINE)), F.lit(False))


def br_before(nodes: DataFrame) -> DataFrame:
    """nodes with brs: the number of br tags up to each node in document order; two nodes have a br between them when
    their numbers differ."""
    order = Window.partitionBy("url").orderBy("doc_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return nodes.withColumn("brs", F.sum(F.when(F.col("tag") == "br", 1).otherwise(0)).over(order))
