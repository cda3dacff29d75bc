"""Queries of the training-data problems, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagesieve.functions.text import BLANKS, HOST
from pagesieve.llm.body import page_bodies, scored_nodes
from pagesieve.llm.charset import garbled
from pagesieve.llm.leaks import leaked
from pagesieve.llm.lines import blocks, keyed_lines, own_text, repeated_lines
from pagesieve.llm.mixing import mix, source_key, token_counts
from pagesieve.llm.quality import not_prose, page_profiles, quality, spam_pages
from pagesieve.llm.residue import residue_documents, without_residue
from pagesieve.llm.splitting import oversized, pieces
from pagesieve.plans.registry import Registry
from pagesieve.session import keyed_join, table

registry = Registry()

LINES_SQL = f"""
WITH pages AS (
  SELECT url, text, regexp_replace(lower(regexp_extract(url, '{HOST}', 1)), '^www\\.', '') AS site FROM cc_text WHERE url IS NOT NULL AND text IS NOT NULL
), cut AS (SELECT DISTINCT url, site, text, str_split(text, chr(10)) AS parts FROM pages
), raw AS (SELECT url, site, unnest(parts) AS line, generate_subscripts(parts, 1) AS line_no FROM cut
), folded AS (SELECT url, site, line, CAST(line_no AS INT) AS line_no, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[{BLANKS}]+', ' ', 'g'), ' ') AS k FROM raw
), long AS (SELECT * FROM folded WHERE length(regexp_replace(k, '[^\\p{{L}}]+', '', 'g')) >= 12
), sites AS (SELECT site, count(DISTINCT url) AS n FROM pages GROUP BY site
), often AS (SELECT long.site, k FROM long JOIN sites USING (site) GROUP BY long.site, k, n HAVING count(DISTINCT url) >= 3 AND count(DISTINCT url) * 10 >= n
), hits AS (SELECT DISTINCT url, line_no FROM long JOIN often USING (site, k))"""


@registry.add(LINES_SQL + " SELECT url, line_no FROM hits")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of cc_text that recur too often on their site."""
    return repeated_lines(table(spark, sf_dir, "cc_text")).select("url", "line_no").distinct()


@registry.add(
    LINES_SQL
    + """ SELECT url, CASE WHEN bool_or(h.line_no IS NULL) THEN string_agg(CASE WHEN h.line_no IS NULL THEN line END, chr(10) ORDER BY f.line_no) ELSE '' END AS own
    FROM folded f LEFT JOIN hits h USING (url, line_no) GROUP BY url"""
)
def p5_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's text without the repeated lines."""
    return own_text(table(spark, sf_dir, "cc_text")).select("url", "own").distinct()


@registry.add(
    LINES_SQL
    + """, hit AS (SELECT DISTINCT url, site, line_no, k FROM long JOIN often USING (site, k)
), pairs AS (SELECT a.site, a.k AS a, b.k AS b, count(DISTINCT a.url) AS w FROM hit a JOIN hit b ON a.url = b.url AND b.line_no = a.line_no + 1 AND a.k <> b.k GROUP BY a.site, a.k, b.k
), edges AS (SELECT site, a, b FROM pairs JOIN sites USING (site) WHERE w >= 3 AND w * 10 >= n), two_way AS (SELECT site, a, b FROM edges UNION SELECT site, b, a FROM edges
), reach AS (WITH RECURSIVE r AS (SELECT site, k AS a, k AS b FROM (SELECT DISTINCT site, k FROM hit) UNION SELECT r.site, r.a, e.b FROM r JOIN two_way e ON r.site = e.site AND r.b = e.a) SELECT site, a AS k, min(b) AS block FROM r GROUP BY site, a)
SELECT site, count(DISTINCT hit.k) AS lines, count(*) AS occurrences, count(DISTINCT url) AS urls FROM hit JOIN reach USING (site, k) GROUP BY site, block"""
)
def p5_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boilerplate blocks of each site: connected components of its frequent lines, with their lines and occurrences."""
    keyed = keyed_lines(table(spark, sf_dir, "cc_text"))
    found, hits = blocks(keyed)
    each = hits.select("url", "site", "s", F.explode("hits").alias("x")).select("url", "site", "s", F.col("x.n").alias("line_no"), F.col("x.k").alias("k")).distinct()
    placed = keyed_join(each, found, ["s", "k"], 40 * found.count(), F.col("url"))
    return placed.groupBy("site", "s", "block").agg(F.countDistinct("k").alias("lines"), F.count(F.lit(1)).alias("occurrences"), F.countDistinct("url").alias("urls")).drop("s", "block")


@registry.add()
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of cc_text that are no natural prose."""
    return not_prose(table(spark, sf_dir, "cc_text"))


@registry.add()
def p3_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality figures of each page with their percentiles and robust z-scores."""
    return quality(page_profiles(table(spark, sf_dir, "cc_text"))).drop("text_id").distinct()


@registry.add()
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of cc_text that are keyword-stuffed, link lists or product tags."""
    return spam_pages(table(spark, sf_dir, "cc_text"))


def _page_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(table(spark, sf_dir, t) for t in ("textnodes", "inference_test", "goldlabels"))


@registry.add()
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of textnodes that do not belong to their page's body."""
    return scored_nodes(*_page_tables(spark, sf_dir)).where("NOT is_body").select("url", "node_id")


@registry.add()
def p4_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's body."""
    return page_bodies(*_page_tables(spark, sf_dir))


def _text_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "textnodes").select(
        F.lit("textnodes").alias("field"), F.col("Url").alias("url"), F.col("TextNodeId").alias("node_id"), F.col("Text").alias("text")
    )
    pages = table(spark, sf_dir, "cc_text").select(F.lit("cc_text").alias("field"), "url", F.lit(-1).alias("node_id"), "text")
    return nodes.unionByName(pages)


@registry.add()
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of textnodes and cc_text with text decoded with a wrong charset."""
    return garbled(_text_records(spark, sf_dir)).select("table_name", "url", "node_id").distinct()


@registry.add()
def p2_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The restored text of each of these records."""
    return garbled(_text_records(spark, sf_dir)).distinct()


@registry.add()
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are template residue, filler, error pages or script notices."""
    return residue_documents(table(spark, sf_dir, "documents")).select("doc_id").distinct()


@registry.add()
def p10_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residue documents with what shows it: signs, passages or links."""
    return residue_documents(table(spark, sf_dir, "documents")).groupBy("how").agg(F.countDistinct("doc_id").alias("documents"))


@registry.add()
def p10_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without the residue ones."""
    return without_residue(table(spark, sf_dir, "documents"))


@registry.add()
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold passages of test items, with the items."""
    return leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).distinct()


@registry.add(
    """SELECT DISTINCT feature_id FROM (
      SELECT feature_id, len([x for x in NodeIds if x <> 0]) AS n,
        list_sum([CASE WHEN NodeIds[i] <> 0 THEN len([y for y in TokenId[i] if y <> 1]) ELSE 0 END for i in range(1, len(NodeIds) + 1)]) AS t
      FROM page_features) WHERE n > 384 OR t > 4096"""
)
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of page_features that are cut into several pieces, as they have over 384 nodes or 4,096 tokens."""
    return oversized(table(spark, sf_dir, "page_features"))


@registry.add()
def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of page_features in pieces within both limits."""
    return pieces(table(spark, sf_dir, "page_features"))


@registry.add(
    """WITH x AS (SELECT feature_id, unnest(NodeIds) AS n, unnest(TokenId) AS t FROM page_features)
    SELECT feature_id, count(*) AS nodes, CAST(sum(len([y for y in t if y <> 1])) AS BIGINT) AS tokens, 0 AS over, 0 AS gaps FROM x WHERE n <> 0 GROUP BY feature_id"""
)
def p7_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces without what they repeat, put together again: nodes and tokens of each row, its pieces over a limit, and those
    that repeat nothing though the page goes on."""
    p = pieces(table(spark, sf_dir, "page_features"))
    sizes = F.transform("TokenId", F.size)
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x)
    own = F.slice(sizes, F.col("repeated") + 1, F.size("TokenId"))
    # a node that is cut stands there once a fragment, and counts where it begins
    pairs = F.arrays_zip(F.col("NodeIds").alias("n"), F.col("Url").alias("u"))
    own_pairs = F.slice(pairs, F.greatest(F.col("repeated"), F.lit(1)), F.size(pairs))
    cut = F.aggregate(F.zip_with(F.slice(own_pairs, 2, F.size(pairs)), own_pairs, lambda x, y: x.isNotNull() & x.eqNullSafe(y)), F.lit(0), lambda a, x: a + x.cast("int"))
    goes_on = (F.col("repeated") == 0) & (F.element_at("Url", 1) == F.lag(F.element_at("Url", -1)).over(Window.partitionBy("feature_id").orderBy("piece")))
    each = p.select("feature_id", (F.size("NodeIds") - F.col("repeated") - cut).alias("nodes"), total(own).alias("tokens"),
                    ((F.size(F.array_distinct("NodeIds")) > 384) | (total(sizes) > 4096)).cast("int").alias("over"), F.coalesce(goes_on, F.lit(False)).cast("int").alias("gaps"))
    return each.groupBy("feature_id").agg(F.sum("nodes").alias("nodes"), F.sum("tokens").alias("tokens"), F.max("over").alias("over"), F.max("gaps").alias("gaps"))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mix(token_counts(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets"))


@registry.add()
def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed records: each document with the times it stands in the mix."""
    return _mixed(spark, sf_dir)[0]


@registry.add()
def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share that each source reaches."""
    return _mixed(spark, sf_dir)[1]


MIX_SQL = """WITH t AS (SELECT regexp_replace(lower(trim(source)), '[_\\s]+', '-', 'g') AS source, sum(greatest(coalesce(target_share, 0), 0)) AS target_share, max(greatest(coalesce(max_repeats, 0), 0)) AS max_repeats
  FROM mix_targets WHERE source IS NOT NULL GROUP BY 1
), d AS (SELECT doc_id, source, length(text) AS n, md5(CAST(doc_id AS VARCHAR)) AS key FROM (SELECT doc_id, regexp_replace(lower(trim(source)), '[_\\s]+', '-', 'g') AS source, text FROM documents WHERE text IS NOT NULL) JOIN t USING (source)
), sizes AS (SELECT source, sum(n) AS size FROM d GROUP BY source), whole AS (SELECT sum(size) * 0.5 AS total FROM sizes
), plan AS (SELECT source, target_share, max_repeats, coalesce(size, 0) AS size, target_share * total AS budget, CASE WHEN size > 0 THEN least(floor(target_share * total / size), max_repeats) ELSE 0 END AS epochs FROM t LEFT JOIN sizes USING (source), whole
), run AS (SELECT doc_id, source, n, sum(n) OVER (PARTITION BY source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM d
), records AS (SELECT doc_id, source, CAST(n AS BIGINT) AS tokens, CAST(epochs + CASE WHEN epochs < max_repeats AND upto - n / 2 <= budget - epochs * size THEN 1 ELSE 0 END AS BIGINT) AS repeats FROM run JOIN plan USING (source))"""


def _mixed_chars(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", source_key(F.col("source")).alias("source"), F.length("text").cast("long").alias("tokens"))
    return mix(docs, table(spark, sf_dir, "mix_targets"), key=F.md5(F.col("doc_id").cast("string")))


@registry.add(MIX_SQL + " SELECT doc_id, source, tokens, repeats FROM records WHERE repeats > 0")
def p9_mix_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix with sizes in characters and keys by a digest that SQL has too."""
    return _mixed_chars(spark, sf_dir)[0]


@registry.add(
    MIX_SQL
    + """ SELECT source, CAST(coalesce(m.tokens, 0) AS BIGINT) AS tokens, coalesce(m.documents, 0) AS documents, round(coalesce(m.tokens, 0) / total, 9) AS share_of_total, size * max_repeats < budget AS short
    FROM plan LEFT JOIN (SELECT source, sum(tokens * repeats) AS tokens, count(*) AS documents FROM records WHERE repeats > 0 GROUP BY source) m USING (source), whole"""
)
def p9_shares_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that this mix reaches."""
    return _mixed_chars(spark, sf_dir)[1].select("source", "tokens", "documents", F.round("share_of_total", 9).alias("share_of_total"), "short")
