"""Text of chosen nodes with separators and offsets, and offsets of annotations.

All of it is windows over the kept nodes of a page in the order in which they are listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagesieve.operators.nodes import inside, nested

# Fixed value: ASCII punctuation as the inside of a character class.
PUNCT = "!-/:-@\\[-`{-~"


def space_between(prev_text: Column, text: Column) -> Column:
    return prev_text.rlike("[ \\t]\\z") | text.rlike("^[ \\t]")


def margin_between(prev_x: Column, prev_w: Column, x: Column, offset_left: Column, client_left: Column) -> Column:
    return (prev_x + prev_w + 5 <= x) | (offset_left >= 5) | (client_left >= 5)


def starts_with_mark(text: Column) -> Column:
    """A punctuation mark alone, or followed by a blank."""
    return text.rlike(f"^[{PUNCT}](?: |\\z)")


def ends_with_mark(text: Column) -> Column:
    """A punctuation mark alone, or after a blank."""
    return text.rlike(f"(?:^| )[{PUNCT}]\\z")


def separator(prev: dict[str, Column], curr: dict[str, Column], default: str = "\n") -> Column:
    """The separator before a node. prev and curr have text, visible, brs, block_id, inline, x, w, offset_left, client_left;
    a null prev text means there is no node before."""
    same_block = F.coalesce(prev["block_id"] == curr["block_id"], F.lit(False))
    tight = prev["inline"] & curr["inline"] & ~margin_between(prev["x"], prev["w"], curr["x"], curr["offset_left"], curr["client_left"])
    return (
        F.when(prev["text"].isNull(), default)
        .when(prev["visible"] != curr["visible"], "\n")
        .when(prev["brs"] != curr["brs"], "\n")
        .when(~same_block, "\n")
        .when(space_between(prev["text"], curr["text"]), " ")
        .when(tight, "")
        .when(starts_with_mark(curr["text"]) | ends_with_mark(prev["text"]), "")
        .otherwise(" ")
    )


FIELDS = ("text", "visible", "brs", "block_id", "inline", "x", "w", "offset_left", "client_left")


def rendered(kept: DataFrame, page: str = "url", order: str = "seq", binary: bool = False) -> DataFrame:
    """kept with sep, piece, start and end, from rows of nodes in listed order with the fields of separator().

    Empty pieces must be filtered before; the first piece of a page has no separator; offsets count characters, or
    bytes of UTF-8 with binary. A row with title=true is the page's title and stands first.
    """
    w = Window.partitionBy(page).orderBy(order)
    prev = {f: F.lag(f).over(w) for f in FIELDS}
    # the title is output but no text node, so nothing comes before the node after it
    lagged_title = F.coalesce(F.lag("title").over(w), F.lit(False))
    sep = separator({**prev, "text": F.when(lagged_title, None).otherwise(prev["text"])}, {f: F.col(f) for f in FIELDS})
    size = F.octet_length if binary else F.length
    out = kept.withColumn("piece", F.btrim("text", F.lit("\r\n\t\xa0 ")))
    out = out.withColumn("sep", F.when(F.row_number().over(w) == 1, "").otherwise(sep))
    total = F.sum(size("sep") + size("piece")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return out.withColumn("end", total.cast("int")).withColumn("start", (F.col("end") - size("piece")).cast("int"))


def page_text(pieces: DataFrame, page: str = "url", order: str = "seq") -> DataFrame:
    """(page, text): pieces of rendered() joined in order."""
    ordered = F.sort_array(F.collect_list(F.struct(order, "sep", "piece")))
    return pieces.groupBy(page).agg(F.array_join(F.transform(ordered, lambda x: F.concat(x["sep"], x["piece"])), "").alias("text"))


def node_offsets(offsets: DataFrame, wanted: DataFrame) -> DataFrame:
    """(url, node_id, start, end): from the first to the last rendered text node in each wanted node's subtree.

    offsets has url, node_id, start, end of text nodes; wanted url, node_id, last_desc_id. Document order is descending id.
    """
    found = inside(wanted.select("url", "node_id", "last_desc_id").distinct(), offsets)
    return found.groupBy(F.col("o.url").alias("url"), F.col("o.node_id").alias("node_id")).agg(
        F.max_by("i.start", "i.node_id").alias("start"), F.min_by("i.end", "i.node_id").alias("end")
    )


def title_offsets(offsets: DataFrame, titles: DataFrame) -> DataFrame:
    """(url, node_id, start, end) keyed by the parent of the title's text nodes, first start to last end."""
    joined = titles.select("url", "node_id", "parent_id").join(offsets, ["url", "node_id"])
    return joined.groupBy("url", F.col("parent_id").alias("node_id")).agg(
        F.max_by("start", joined["node_id"]).alias("start"), F.min_by("end", joined["node_id"]).alias("end")
    )


# Annotation names of the parts of tables and lists.
PARTS = {"caption": "TableCaption", "th": "TableHeader", "tr": "TableRow", "td": "TableCell", "li": "ListItem"}
UNNESTED = ("tr", "td", "li")


def part_offsets(nodes: DataFrame, offsets: DataFrame, annotated: DataFrame) -> DataFrame:
    """(url, name, node_id, start, end) of the parts of annotated tables and lists (url, node_id, kind); nested rows, cells
    and items are left out."""
    known = annotated.join(nodes.select("url", "node_id", "last_desc_id"), ["url", "node_id"])
    parts = nodes.where(F.col("tag").isin(*PARTS)).select("url", "node_id", "tag", "last_desc_id")
    pairs = inside(known, parts).where(F.when(F.col("o.kind") == "List", F.col("i.tag") == "li").otherwise(F.col("i.tag") != "li"))
    pairs = pairs.select("o.url", F.col("o.node_id").alias("root"), F.col("i.node_id").alias("node_id"), "i.tag", "i.last_desc_id")
    found = pairs.join(node_offsets(offsets, pairs), ["url", "node_id"])
    marked = nested(found, ["url", "root", "tag"]).where(~(F.col("tag").isin(*UNNESTED) & F.col("is_nested")))
    names = F.create_map(*(F.lit(x) for kv in PARTS.items() for x in kv))
    return marked.select("url", names[F.col("tag")].alias("name"), "node_id", "start", "end").distinct()


def invisible_runs(pieces: DataFrame, page: str = "url", order: str = "seq") -> DataFrame:
    """(page, node_id, start, end) of each maximal run of invisible pieces, keyed by its first node; the end is the
    start of the run's last piece, and a title row is skipped."""
    kept = pieces.where(~F.coalesce("title", F.lit(False)))
    w = Window.partitionBy(page).orderBy(order)
    run = F.sum(F.col("visible").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    runs = kept.withColumn("run", run).where(~F.col("visible"))
    return runs.groupBy(page, "run").agg(F.min_by("node_id", order).alias("node_id"), F.min("start").alias("start"), F.max("start").alias("end")).drop("run")
