"""Visual features of nodes, from attribute strings such as id12px10pw200."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The two-letter keys of the raw attribute string with the names of the 30 features, in serialized order.
KEYS = {
    "px": "position_x", "py": "position_y", "pw": "position_w", "ph": "position_h", "ol": "offset_left", "ot": "offset_top", "ow": "offset_w", "oh": "offset_h",
    "cl": "client_left", "ct": "client_top", "cw": "client_w", "ch": "client_h", "ca": "font_color_a", "cr": "font_color_r", "cb": "font_color_b", "cg": "font_color_g",
    "fw": "font_weight", "fs": "font_size", "fi": "font_italic", "fd": "font_decoration", "lt": "list_style", "di": "display_style", "cu": "cursor_style",
    "lh": "line_height", "tt": "text_transform", "op": "opacity", "bl": "border_style_left", "bt": "border_style_top", "br": "border_style_right", "bb": "border_style_bottom",
}
FEATURES = tuple(KEYS.values())


def raw_value(raw: Column, key: str) -> Column:
    """The last value of a key in the raw string, null without one. Negative numbers do not match."""
    pairs = F.regexp_extract_all(raw, F.lit("([a-z][a-z])([0-9]+)"), F.lit(0))
    mine = F.filter(pairs, lambda p: p.startswith(key))
    return F.substring(F.try_element_at(mine, F.lit(-1)), 3, 20).cast("int")


def parsed(raws: DataFrame, raw: str = "raw") -> DataFrame:
    """raws with node_id and the 30 features; a key that is missing is 0, the id null."""
    col = F.col(raw)
    return raws.select("*", raw_value(col, "id").alias("node_id"), *(F.coalesce(raw_value(col, k), F.lit(0)).alias(n) for k, n in KEYS.items()))


def with_defaults(nodes: DataFrame, features: DataFrame) -> DataFrame:
    """nodes with the features of their id on their page, zeros where there are none."""
    joined = nodes.join(features.select("url", "node_id", *FEATURES), ["url", "node_id"], "left")
    return joined.na.fill(0, list(FEATURES))


def as_array() -> Column:
    """The 30 features in their fixed order."""
    return F.array(*FEATURES)


def visible(w: Column, h: Column, opacity: Column) -> Column:
    return (w > 2) & (h > 2) & (opacity != 0)
