"""Lines repeated across the pages of one site.

The lines of a site are the nodes of a graph, weighted by the urls that carry them; two lines that follow one
another are joined by an edge, weighted alike. Nodes and edges of high support stay; the connected components
are the site's boilerplate blocks, a line without edges a block of one, and every occurrence of their lines is deleted.
Found lines, cleaned texts and what other operators take for a page's own text all come from the occurrences of blocks.

Texts are folded once, into one 64-bit key a line, and staged; counts, occurrences and edges are made of these keys.
Counts are combined before every shuffle, so a site or a line with a third of all rows costs no more than any
other. High-support lines of a site are at most 1 / min_share times its mean lines a page, which bounds the per-site
graph.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.functions.text import folded_lines, site_of
from pagesieve.session import keyed_join, stage


@dataclass(frozen=True)
class Rule:
    min_letters: int = 12
    min_urls: int = 3
    min_share: float = 0.1

    def kept(self, urls: Column, site_urls: Column) -> Column:
        """Whether the support is high; a share that is met exactly counts, whatever its float product."""
        return (urls >= self.min_urls) & (urls >= F.lit(self.min_share) * site_urls - 1e-6)


def _long_enough(line: Column, rule: Rule) -> Column:
    return line.rlike(f"(?:\\p{{L}}\\P{{L}}*){{{rule.min_letters}}}")


def keyed_lines(pages: DataFrame, rule: Rule = Rule(), keep_text: bool = False) -> DataFrame:
    """(url, site, s, u, keys) of each row with a url and a text, staged, with its text where that is wanted: hashes of site and
    url, and for each line the hash of its folded form, null for lines that never count."""
    key = lambda x: F.when((F.length(x) >= rule.min_letters) & _long_enough(x, rule), F.xxhash64(x))
    rows = pages.select("url", site_of(F.col("url")).alias("site"), "text").where("url IS NOT NULL AND text IS NOT NULL")
    rows = rows.select("url", "site", F.xxhash64("site").alias("s"), F.xxhash64("url").alias("u"), F.transform(folded_lines(F.col("text")), key).alias("keys"), *(["text"] if keep_text else []))
    return stage(rows, "keyed")


def frequent_lines(keyed: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(site, s, k, urls, site_urls): the high-support nodes, staged."""
    lines = keyed.select("s", "u", F.explode(F.array_distinct("keys")).alias("k")).where("k IS NOT NULL")
    nodes = lines.groupBy("s", "k").agg(F.countDistinct("u").alias("urls")).where(F.col("urls") >= rule.min_urls)
    sites = keyed.groupBy("site", "s").agg(F.countDistinct("u").alias("site_urls"))
    kept = nodes.join(sites, "s").where(rule.kept(F.col("urls"), F.col("site_urls"))).select("site", "s", "k", "urls", "site_urls")
    return stage(kept, "lines")


def _with_lines(keyed: DataFrame, lines: DataFrame) -> DataFrame:
    """keyed with mine, those of the site's lines (s, k) that stand on the page; pages of sites without any are left out unless
    they carry a text."""
    n = lines.count()
    sites = lines.groupBy("s").agg(F.collect_list("k").alias("ks"))
    joined = keyed_join(keyed, sites, ["s"], 24 * n, F.col("u"), "left" if "text" in keyed.columns else "inner")
    return joined.withColumn("mine", F.array_intersect("keys", F.coalesce("ks", F.array().cast("array<bigint>")))).drop("ks")


def occurrences(keyed: DataFrame, lines: DataFrame) -> DataFrame:
    """(url, site, s, u, hits): the places and keys of the site's lines on each page that has any, staged."""
    placed = F.transform("keys", lambda k, i: F.struct((i + 1).alias("n"), k.alias("k")))
    rows = _with_lines(keyed.select("url", "site", "s", "u", "keys"), lines).where(F.size("mine") > 0)
    return stage(rows.select("url", "site", "s", "u", F.filter(placed, lambda x: F.array_contains("mine", x["k"])).alias("hits")), "hits")


def _components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        s, k, block = [], [], []
        for row in batch.to_pylist():
            parent = {n: n for n in row["nodes"]}

            def root(x: int, parent: dict = parent) -> int:
                while parent[x] != x:
                    parent[x] = x = parent[parent[x]]
                return x

            for e in row["edges"] or ():
                a, b = root(e["a"]), root(e["b"])
                parent[max(a, b)] = min(a, b)
            for x in parent:
                s.append(row["s"])
                k.append(x)
                block.append(root(x))
        yield pa.record_batch([pa.array(s, pa.int64()), pa.array(k, pa.int64()), pa.array(block, pa.int64())], ["s", "k", "block"])


def blocks(keyed: DataFrame, rule: Rule = Rule()) -> tuple[DataFrame, DataFrame]:
    """((s, k, block, urls, site_urls), occurrences): the lines of each site's blocks, staged, and where they stand."""
    frequent = frequent_lines(keyed, rule)
    hits = occurrences(keyed, frequent)
    follow = F.zip_with(F.slice("hits", 1, F.greatest(F.size("hits") - 1, F.lit(0))), F.slice("hits", 2, F.size("hits")), lambda x, y: F.struct(x["n"].alias("n"), x["k"].alias("a"), y["n"].alias("m"), y["k"].alias("b")))
    pairs = F.transform(F.filter(follow, lambda x: (x["m"] == x["n"] + 1) & (x["a"] != x["b"])), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b")))
    edges = hits.select("s", "u", F.explode(F.array_distinct(pairs)).alias("e")).groupBy("s", "e.a", "e.b").agg(F.countDistinct("u").alias("w"))
    sites = frequent.select("s", "site_urls").distinct()
    edges = edges.join(sites, "s").where(rule.kept(F.col("w"), F.col("site_urls")))
    graph = frequent.groupBy("s").agg(F.collect_list("k").alias("nodes")).join(edges.groupBy("s").agg(F.collect_list(F.struct("a", "b")).alias("edges")), "s", "left")
    found = graph.mapInArrow(_components, "s BIGINT, k BIGINT, block BIGINT").join(frequent.select("s", "k", "urls", "site_urls"), ["s", "k"])
    return stage(found, "blocks"), hits


def repeated_lines(pages: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(url, line_no, site, block, urls, site_urls) of each line that recurs too often on its site.

    pages has url and text; other columns are ignored. Null urls and texts have no lines; repeated rows count
    once; empty lines and lines of few letters never count; ties have no meaning, as support decides alone.
    """
    found, hits = blocks(keyed_lines(pages, rule), rule)
    each = hits.select("url", "site", "s", "u", F.explode("hits").alias("x")).select("url", "site", "s", "u", F.col("x.n").alias("line_no"), F.col("x.k").alias("k"))
    placed = keyed_join(each, found, ["s", "k"], 40 * found.count(), F.col("u"))
    return placed.select("url", "line_no", "site", "block", "urls", "site_urls").dropDuplicates(["url", "line_no", "block"])


def own_text(pages: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(url, text, own): each page and its text without the lines of its site's blocks. Null urls and texts have no row, and no
    text is shuffled unless the blocks are too many to send along."""
    keyed = keyed_lines(pages, rule, keep_text=True)
    found, _ = blocks(keyed.drop("text"), rule)
    zipped = F.arrays_zip(F.split("text", "\n", -1).alias("line"), F.col("keys").alias("k"))
    kept = F.filter(zipped, lambda x: x["k"].isNull() | ~F.array_contains("mine", x["k"]))
    own = F.when(F.size("mine") == 0, F.col("text")).otherwise(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"))
    return _with_lines(keyed, found).select("url", "text", own.alias("own"))
