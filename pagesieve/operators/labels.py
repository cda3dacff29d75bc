"""Annotation labels: maps, fallback, propagation to text nodes, multi-hot rows, gold flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesieve.operators.nodes import inside

# The annotation types by number.
TYPES = {1: "Primary", 2: "Heading", 3: "Title", 4: "Paragraph", 5: "Table", 6: "List"}


def annotation_map(annotations: DataFrame, nodes: DataFrame) -> DataFrame:
    """(url, type, node_ids): ids of each type on each page that exist there, descending, repeats kept; type 0 is dropped."""
    known = annotations.where("type <> 0").join(nodes.select("url", "node_id").distinct(), ["url", "node_id"])
    return known.groupBy("url", "type").agg(F.sort_array(F.collect_list("node_id"), asc=False).alias("node_ids"))


def with_fallback(annotations: DataFrame, nodes: DataFrame) -> DataFrame:
    """annotations (url, node_id, type); on pages without any Primary every text node is Primary."""
    has = annotations.where("type = 1").join(nodes.select("url", "node_id"), ["url", "node_id"], "left_semi").select("url").distinct()
    lacking = nodes.where("is_text").join(has, "url", "left_anti").select("url", "node_id", F.lit(1).alias("type"))
    return annotations.select("url", "node_id", "type").unionByName(lacking)


def propagated(annotations: DataFrame, nodes: DataFrame) -> DataFrame:
    """(url, node_id, types): each text node with the distinct types of its annotated ancestors-or-self."""
    known = annotations.where("type <> 0").join(nodes.select("url", "node_id", "last_desc_id"), ["url", "node_id"])
    found = inside(known, nodes.where("is_text").select("url", "node_id"))
    return found.groupBy(F.col("i.url").alias("url"), F.col("i.node_id").alias("node_id")).agg(F.sort_array(F.collect_set("o.type")).alias("types"))


def multi_hot(nodes: DataFrame, types: DataFrame) -> DataFrame:
    """nodes with labels, six 0/1 places; nodes without a type, elements among them, have zeros."""
    joined = nodes.join(types, ["url", "node_id"], "left")
    spots = F.array(*(F.coalesce(F.array_contains("types", k), F.lit(False)).cast("int") for k in TYPES))
    return joined.withColumn("labels", spots).drop("types")


def gold_flag(nodes: DataFrame, annotations: DataFrame) -> DataFrame:
    """nodes with is_primary: whether the node itself is listed as Primary."""
    listed = annotations.where("type = 1").select("url", "node_id").distinct().withColumn("_p", F.lit(True))
    return nodes.join(listed, ["url", "node_id"], "left").withColumn("is_primary", F.coalesce("_p", F.lit(False))).drop("_p")


def table_annotations(annotations: DataFrame) -> DataFrame:
    """(url, node_id, kind) of the annotated tables and lists."""
    kind = F.when(F.col("type") == 5, "Table").when(F.col("type") == 6, "List")
    return annotations.select("url", "node_id", kind.alias("kind")).where("kind IS NOT NULL").distinct()
