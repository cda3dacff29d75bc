"""Queries of the extraction engine over whole tables, with the SQL that confirms them.

Where a table lacks a column that an operator needs (tree intervals, visual features, scores), both sides derive it
from ids by the same integer rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesieve.functions.decode import PROFILES, language, without_controls
from pagesieve.functions.dom import original, parse_pages
from pagesieve.functions.text import stripped
from pagesieve.operators import evaluate, extract, features, labels, nodes, predict, render, training, visual
from pagesieve.plans.pipelines import all_text
from pagesieve.plans.registry import Registry
from pagesieve.session import table, without_nulls
from pagesieve.sources.files import before_dot, entry_of, response, tsv_name, without_extension
from pagesieve.sources.warc import base_path, document_number, offset_at

registry = Registry()
STRIP_SQL = "chr(13) || chr(10) || chr(9) || chr(160) || ' '"


def _escaped(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def html_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, html): each document as a page, its first line the title and every line a paragraph."""
    lines = F.split("text", "\n", -1)
    body = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("<p>"), _escaped(x), F.lit("</p>"))), "")
    html = F.concat(F.lit("<html><head><title>"), _escaped(lines[0]), F.lit("</title></head><body>"), body, F.lit("</body></html>"))
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("url"), html.alias("html"))


LINES_SQL = f"""
WITH parts AS (SELECT doc_id, str_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL
), all_lines AS (SELECT doc_id, unnest(list_prepend(p[1], p)) AS x, generate_subscripts(list_prepend(p[1], p), 1) AS n FROM parts
), lines AS (SELECT doc_id, n, trim(x, {STRIP_SQL}) AS x FROM all_lines)"""


@registry.add(LINES_SQL + " SELECT CAST(doc_id AS VARCHAR) AS url, string_agg(x, '' ORDER BY n) AS text FROM lines WHERE x <> '' GROUP BY doc_id")
def page_text_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parse, number, strip and join the text nodes of each page, every one taken for Primary."""
    return all_text(html_documents(spark, sf_dir))


@registry.add(LINES_SQL + " SELECT CAST(doc_id AS VARCHAR) AS url, x AS title FROM lines WHERE n = 1")
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.titles(parse_pages(html_documents(spark, sf_dir)))


@registry.add()
def node_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All numbered nodes of all pages."""
    return parse_pages(html_documents(spark, sf_dir)).drop("attrs")


@registry.add(LINES_SQL + " SELECT CAST(doc_id AS VARCHAR) AS url, count(*) AS n FROM lines WHERE x <> '' GROUP BY doc_id")
def text_node_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.candidates(parse_pages(html_documents(spark, sf_dir))).groupBy("url").agg(F.count(F.lit(1)).alias("n"))


@registry.add()
def tree_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children, text ends and neighbours of every node."""
    n = parse_pages(html_documents(spark, sf_dir))
    linked = nodes.linked(n).select("url", "node_id", "prev_id", "next_id")
    return linked.join(nodes.children(n), ["url", "node_id"], "left").join(nodes.text_ends(n), ["url", "node_id"], "left")


@registry.add()
def paragraphs_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs and titles below each page's root, breadth first."""
    n = parse_pages(html_documents(spark, sf_dir))
    return nodes.descendants_by_tag(n, n.where("node_id = 0"), ["p", "title"])


_SHOWN = "CASE WHEN regexp_full_match(x, '[ \\t\\n\\r\\f\\v]+') THEN ' ' ELSE replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') END"


@registry.add(
    f"""WITH parts AS (SELECT CAST(doc_id AS VARCHAR) AS url, str_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL
    ), shown AS (SELECT url, [{_SHOWN} for x in p] AS p FROM parts)
    SELECT url, '<html><head><title>' || p[1] || '</title></head><body>' || array_to_string(['<p>' || x || '</p>' for x in p], '') || '</body></html>' AS html FROM shown"""
)
def original_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without the markers of an annotated copy."""

    @F.pandas_udf("string")
    def run(html):  # noqa: ANN001, ANN202
        return html.map(original)

    return html_documents(spark, sf_dir).select("url", run("html").alias("html"))


def _nodes(spark: SparkSession, sf_dir: str, text: bool = True) -> DataFrame:
    """(url, node_id, text): text nodes once, without nulls. Repeated rows never differ in text, so the text is shuffled only
    where it is used; rows are placed by page first, and what follows by page needs no other shuffle."""
    t = without_nulls(table(spark, sf_dir, "textnodes"), "Url", "TextNodeId", "Text")
    kept = t.select(F.col("Url").alias("url"), F.col("TextNodeId").alias("node_id"), *([F.col("Text").alias("text")] if text else []))
    return kept.repartition("url").dropDuplicates()


NODES_SQL = "WITH nodes AS (SELECT DISTINCT Url AS url, TextNodeId AS node_id, Text AS text FROM textnodes WHERE Url IS NOT NULL AND TextNodeId IS NOT NULL AND Text IS NOT NULL)"


@registry.add(
    NODES_SQL
    + " SELECT url, node_id, lag(node_id) OVER w AS prev_id, lead(node_id) OVER w AS next_id FROM nodes WINDOW w AS (PARTITION BY url ORDER BY node_id DESC)"
)
def node_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.linked(_nodes(spark, sf_dir, False)).select("url", "node_id", "prev_id", "next_id")


@registry.add(f"SELECT Url AS url, TextNodeId AS node_id, trim(Text, {STRIP_SQL}) AS text FROM textnodes WHERE length(trim(Text, {STRIP_SQL})) > 0")
def strip_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = features.strip_filter(table(spark, sf_dir, "textnodes"))
    return kept.select(F.col("Url").alias("url"), F.col("TextNodeId").alias("node_id"), F.col("Text").alias("text"))


def _chunk_sql(size: int) -> str:
    return NODES_SQL + f" SELECT url, node_id, CAST(floor((row_number() OVER (PARTITION BY url ORDER BY node_id DESC) - 1) / {size}) AS INT) AS chunk FROM nodes"


@registry.add(_chunk_sql(384))
def chunk_384(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir, False).select("url", "node_id", features.chunk_number(["url"], [F.desc("node_id")]).alias("chunk"))


@registry.add(_chunk_sql(16))
def chunk_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir, False).select("url", "node_id", features.chunk_number(["url"], [F.desc("node_id")], 16).alias("chunk"))


@registry.add(
    NODES_SQL
    + """, c AS (SELECT url, node_id, CAST(floor((row_number() OVER (PARTITION BY url ORDER BY node_id DESC) - 1) / 384) AS INT) AS chunk FROM nodes)
    SELECT '{"NodeIds":[' || string_agg(CAST(node_id AS VARCHAR), ',' ORDER BY node_id DESC) || '],"Url":[' || string_agg('"' || url || '"', ',') || ']}' AS json FROM c GROUP BY url, chunk"""
)
def feature_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows as compact JSON lines."""
    return features.feature_json(features.chunk_rows(_nodes(spark, sf_dir, False), "url", "node_id").select("NodeIds", "Url"))


@registry.add(
    """WITH x AS (SELECT feature_id, unnest(TokenId) AS t, generate_subscripts(TokenId, 1) AS n FROM page_features)
    SELECT feature_id, CAST(n AS INT) AS n, array_to_string(list_append(t[1:4], 2), ',') AS tokens, array_to_string([CASE WHEN y <> 1 THEN 1 ELSE 0 END for y in list_append(t[1:4], 2)], ',') AS mask FROM x"""
)
def tokens_truncate_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "page_features").select("feature_id", F.posexplode("TokenId").alias("n", "t")).withColumn("t", features.cut_tokens(F.col("t")))
    joined = lambda c: F.array_join(F.transform(c, lambda y: y.cast("string")), ",")
    return x.select("feature_id", (F.col("n") + 1).alias("n"), joined(F.col("t")).alias("tokens"), joined(features.mask(F.col("t"))).alias("mask"))


@registry.add(
    """WITH c AS (SELECT feature_id, NodeIds[1:384] AS ids, [list_append(t[1:4], 2) for t in TokenId[1:384]] AS ts FROM page_features)
    SELECT feature_id, CAST(1920 AS INT) AS token_places, CAST(384 AS INT) AS node_places, CAST(coalesce(list_sum(flatten(ts)), 0) AS BIGINT) AS token_sum,
      CAST(len([y for y in flatten(ts) if y <> 1]) AS BIGINT) AS mask_sum, CAST(coalesce(list_sum(ids), 0) AS BIGINT) AS node_sum FROM c"""
)
def tensor_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flattened and padded arrays of each feature row: their lengths and sums."""
    t = features.tensors(table(spark, sf_dir, "page_features").select("feature_id", "TokenId", "NodeIds"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return t.select(
        "feature_id", F.size("token_ids").alias("token_places"), F.size("node_ids").alias("node_places"),
        total("token_ids").alias("token_sum"), total("token_mask").alias("mask_sum"), total("node_ids").alias("node_sum"),
    )


@registry.add(
    """SELECT CAST(p AS INT) AS p, CAST(i AS INT) AS i, round(CASE WHEN i % 2 = 0 THEN sin(a) ELSE cos(a) END, 6) AS v FROM (
      SELECT p, i, floor(p / 2) * exp(-(2.0 * floor(i / 2) / 64) * ln(10000.0)) AS a FROM range(384) t(p), range(64) u(i))"""
)
def position_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spark.range(384 * 64).select(F.floor(F.col("id") / 64).cast("int").alias("p"), (F.col("id") % 64).cast("int").alias("i"))
    return grid.select("p", "i", F.round(features.position(F.col("p"), F.col("i"), 64), 6).alias("v"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _nodes(spark, sf_dir, False)
    six = F.array(*(predict.hashed_score(F.col("node_id"), k) for k in range(6)))
    return predict.exploded(n.withColumn("scores", six))


SCORES_SQL = (
    NODES_SQL
    + """, tasks AS (SELECT unnest(['Primary','Heading','Title','Paragraph','Table','List']) AS task, unnest(range(6)) AS k
    ), scores AS (SELECT url, node_id, task, CAST(((node_id * (k + 7) + k * 13) % 100) / 100.0 AS FLOAT) AS score FROM nodes, tasks WHERE node_id <> 0
    ), thresholds AS (SELECT unnest([0.1,0.25,0.4,0.5,0.6,0.7,0.8,0.9]) AS threshold
    ), passing AS (SELECT url, node_id, task, CAST(threshold AS DOUBLE) AS threshold FROM scores, thresholds WHERE score > CAST(threshold AS FLOAT))"""
)


@registry.add(SCORES_SQL + " SELECT task, threshold, url, count(DISTINCT node_id) AS n FROM passing GROUP BY ALL")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    swept = predict.sweep(_scores(spark, sf_dir))
    return swept.select("task", "threshold", "url", F.size("node_ids").cast("long").alias("n"))


@registry.add(SCORES_SQL + " SELECT DISTINCT url AS \"Url\", node_id AS \"TextNodeId\", task AS \"Task\" FROM passing WHERE task = 'Primary' AND threshold = 0.9")
def predictions_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict.saved(_scores(spark, sf_dir))


@registry.add(SCORES_SQL + " SELECT url, string_agg(CAST(node_id AS VARCHAR), ',' ORDER BY node_id) AS ids FROM (SELECT DISTINCT url, node_id FROM passing WHERE task = 'List' AND threshold = 0.5) GROUP BY url")
def chunk_merge_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node sets of a page merged over its chunks."""
    swept = predict.sweep(_scores(spark, sf_dir)).where("task = 'List' AND threshold = 0.5")
    return swept.select("url", F.array_join(F.transform("node_ids", lambda x: x.cast("string")), ",").alias("ids"))


def _joined(spark: SparkSession, sf_dir: str, task: str | None = None) -> DataFrame:
    return extract.predicted_text(table(spark, sf_dir, "inference_test"), table(spark, sf_dir, "textnodes"), task)


JOINED_SQL = """WITH joined AS (SELECT p.Url, p.TextNodeId, p.Task, t.Text FROM inference_test p JOIN textnodes t ON p.Url = t.Url AND p.TextNodeId = t.TextNodeId
  WHERE p.Task IS NOT NULL AND t.Text IS NOT NULL), texts AS (SELECT Url, Task, string_agg(Text, '' ORDER BY TextNodeId DESC, Text) AS Text FROM joined GROUP BY Url, Task)"""


@registry.add(JOINED_SQL + ' SELECT Url AS "Url", Task AS "Task", Text AS "Text" FROM texts')
def extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of each page and task from its predicted nodes."""
    return extract.page_texts(_joined(spark, sf_dir))


PRIMARY_SQL = JOINED_SQL + ", primary_texts AS (SELECT Url, Text FROM texts WHERE Task = 'Primary')"


@registry.add(PRIMARY_SQL + ' SELECT p.Url AS "Url", t.Text AS "Text" FROM (SELECT DISTINCT Url FROM textnodes WHERE Url IS NOT NULL) p LEFT JOIN primary_texts t USING (Url)')
def missing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted text with a null row for pages without any."""
    return extract.with_missing(extract.page_texts(_joined(spark, sf_dir, "Primary")), table(spark, sf_dir, "textnodes")).select("Url", "Text")


@registry.add(PRIMARY_SQL + ' SELECT t.Url AS "Url", t.Text AS "Text", epoch_us(s.first_seen) AS first_seen FROM primary_texts t LEFT JOIN (SELECT Url, min(loaded_at) AS first_seen FROM textnodes WHERE Url IS NOT NULL GROUP BY Url) s USING (Url)')
def report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted text with the time at which a page was first seen, the order of a report."""
    return extract.first_seen(extract.page_texts(_joined(spark, sf_dir, "Primary")).select("Url", "Text"), table(spark, sf_dir, "textnodes"), "loaded_at").withColumn("first_seen", F.unix_micros("first_seen"))


CONFUSION_SQL = PRIMARY_SQL + """, gold AS (SELECT Url, replace(replace(replace(Text, '#N#', chr(10)), '#TAB#', chr(9)), '#R#', chr(13)) AS g, JudgmentIsPrimary AS yes
  FROM goldlabels WHERE Url IS NOT NULL AND TextNodeId IS NOT NULL AND Text IS NOT NULL AND JudgmentIsPrimary IS NOT NULL
), hit AS (SELECT gold.Url, yes, coalesce(contains(t.Text, g), false) AS found FROM gold LEFT JOIN primary_texts t USING (Url)
), pages AS (SELECT Url, count(*) FILTER (yes AND found) AS tp, count(*) FILTER (NOT yes AND NOT found) AS tn, count(*) FILTER (NOT yes AND found) AS fp, count(*) FILTER (yes AND NOT found) AS fn FROM hit GROUP BY Url)"""


@registry.add(CONFUSION_SQL + ' SELECT Url AS "Url", tp, tn, fp, fn FROM pages')
def eval_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.page_confusion(extract.page_texts(_joined(spark, sf_dir, "Primary")), table(spark, sf_dir, "goldlabels"))


@registry.add(
    CONFUSION_SQL
    + """, s AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(tn) AS BIGINT) AS tn, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM pages)
    SELECT tp, tn, fp, fn, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round((tp + tn) / (tp + tn + fp + fn), 9) AS accuracy, round(2 * tp / (2 * tp + fp + fn), 9) AS fscore FROM s"""
)
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evaluate.metrics(eval_confusion(spark, sf_dir))
    return m.select("tp", "tn", "fp", "fn", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "accuracy", "fscore")))


@registry.add(
    """WITH g AS (SELECT Url, replace(replace(replace(Text, '#N#', chr(10)), '#TAB#', chr(9)), '#R#', chr(13)) AS t, JudgmentIsPrimary AS yes FROM goldlabels
      WHERE Url IS NOT NULL AND TextNodeId IS NOT NULL AND Text IS NOT NULL AND JudgmentIsPrimary IS NOT NULL)
    SELECT Url AS url, count(*) FILTER (yes) AS positives, count(*) FILTER (NOT yes) AS negatives, CAST(sum(length(t)) AS BIGINT) AS chars FROM g GROUP BY Url"""
)
def gold_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = evaluate.gold_lists(table(spark, sf_dir, "goldlabels"))
    chars = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    return g.select(F.col("Url").alias("url"), F.size("positives").cast("long").alias("positives"), F.size("negatives").cast("long").alias("negatives"), (chars("positives") + chars("negatives")).alias("chars"))


def _annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, node_id, type) from the predicted tasks."""
    t = without_nulls(table(spark, sf_dir, "inference_test"))
    number = F.create_map(*(F.lit(x) for k, v in labels.TYPES.items() for x in (v, k)))
    return t.select(F.col("Url").alias("url"), F.col("TextNodeId").alias("node_id"), number[F.col("Task")].alias("type")).where("type IS NOT NULL")


ANNOTATIONS_SQL = NODES_SQL + """, ann AS (SELECT Url AS url, TextNodeId AS node_id, list_position(['Primary','Heading','Title','Paragraph','Table','List'], Task) AS type
  FROM inference_test WHERE Url IS NOT NULL AND TextNodeId IS NOT NULL AND Task IN ('Primary','Heading','Title','Paragraph','Table','List'))"""


@registry.add(ANNOTATIONS_SQL + " SELECT url, CAST(type AS INT) AS type, string_agg(CAST(node_id AS VARCHAR), ',' ORDER BY node_id DESC) AS ids FROM ann JOIN (SELECT DISTINCT url, node_id FROM nodes) USING (url, node_id) GROUP BY url, type")
def annotation_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = labels.annotation_map(_annotations(spark, sf_dir), _nodes(spark, sf_dir, False))
    return m.select("url", "type", F.array_join(F.transform("node_ids", lambda x: x.cast("string")), ",").alias("ids"))


@registry.add(
    ANNOTATIONS_SQL
    + """, has AS (SELECT DISTINCT url FROM ann JOIN (SELECT DISTINCT url, node_id FROM nodes) USING (url, node_id) WHERE type = 1)
    SELECT url, node_id, CAST(type AS INT) AS type FROM ann UNION ALL SELECT url, node_id, 1 FROM nodes WHERE url NOT IN (SELECT url FROM has)"""
)
def label_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.with_fallback(_annotations(spark, sf_dir), _nodes(spark, sf_dir, False).withColumn("is_text", F.lit(True)))


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text nodes with pseudo intervals: a node spans as many ids as its id leaves over seven."""
    n = _nodes(spark, sf_dir, False)
    return n.withColumn("is_text", F.lit(True)).withColumn("last_desc_id", (F.col("node_id") + F.col("node_id") % 7).cast("int"))


PROPAGATED_SQL = ANNOTATIONS_SQL + """, tree AS (SELECT DISTINCT url, node_id, node_id + node_id % 7 AS last_id FROM nodes
), types AS (SELECT t.url, t.node_id, list_sort(list_distinct(list(a.type))) AS types FROM ann a JOIN tree r ON a.url = r.url AND a.node_id = r.node_id
  JOIN tree t ON t.url = r.url AND t.node_id BETWEEN r.node_id AND r.last_id GROUP BY t.url, t.node_id)"""


@registry.add(PROPAGATED_SQL + " SELECT url, node_id, array_to_string(types, ',') AS types FROM types")
def label_propagate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = labels.propagated(_annotations(spark, sf_dir), _tree(spark, sf_dir))
    return p.select("url", "node_id", F.array_join(F.transform("types", lambda x: x.cast("string")), ",").alias("types"))


@registry.add(
    PROPAGATED_SQL
    + """ SELECT url, node_id, array_to_string([CASE WHEN list_contains(coalesce(types, []), k) THEN 1 ELSE 0 END for k in range(1, 7)], ',') AS labels FROM nodes LEFT JOIN types USING (url, node_id)"""
)
def label_multihot(spark: SparkSession, sf_dir: str) -> DataFrame:
    hot = labels.multi_hot(_nodes(spark, sf_dir, False), labels.propagated(_annotations(spark, sf_dir), _tree(spark, sf_dir)))
    return hot.select("url", "node_id", F.array_join(F.transform("labels", lambda x: x.cast("string")), ",").alias("labels"))


@registry.add(ANNOTATIONS_SQL + " SELECT url, node_id, (url, node_id) IN (SELECT (url, node_id) FROM ann WHERE type = 1) AS is_primary FROM nodes")
def gold_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.gold_flag(_nodes(spark, sf_dir, False), _annotations(spark, sf_dir)).select("url", "node_id", "is_primary")


TREE_SQL = NODES_SQL + ", tree AS (SELECT DISTINCT url, node_id, node_id + node_id % 7 AS last_id FROM nodes)"


@registry.add(TREE_SQL + " SELECT o.url, o.node_id, max(i.node_id) AS first_text_id, min(i.node_id) AS last_text_id FROM tree o JOIN tree i ON o.url = i.url AND i.node_id BETWEEN o.node_id AND o.last_id GROUP BY o.url, o.node_id")
def subtree_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last text node of each subtree."""
    return nodes.text_ends(_tree(spark, sf_dir))


@registry.add(TREE_SQL + " SELECT o.url, o.node_id, i.node_id AS text_id FROM tree o JOIN tree i ON o.url = i.url AND i.node_id BETWEEN o.node_id AND o.last_id")
def texts_under(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tree(spark, sf_dir)
    return nodes.texts_under(t, t)


@registry.add(TREE_SQL + " SELECT o.url, o.node_id, EXISTS (SELECT 1 FROM tree a WHERE a.url = o.url AND a.node_id < o.node_id AND o.node_id < a.last_id) AS is_nested FROM tree o")
def remove_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tree(spark, sf_dir).select("url", "node_id", "last_desc_id")
    return nodes.nested(t, ["url"]).select("url", "node_id", "is_nested")


def _raws(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    raw = F.concat(
        F.lit("id"), li.l_orderkey, F.lit("px"), li.l_partkey % 100, F.lit("py-3"), F.lit("px"), li.l_suppkey % 50, F.lit("pw"), li.l_linenumber, F.lit("ph"), li.l_orderkey % 6, F.lit("op"), li.l_linenumber % 2, F.lit("zz9")
    )
    return li.select("l_orderkey", "l_linenumber", raw.alias("raw"))


RAWS_SQL = """WITH raws AS (SELECT l_orderkey, l_linenumber, 'id' || l_orderkey || 'px' || (l_partkey % 100) || 'py-3' || 'px' || (l_suppkey % 50) || 'pw' || l_linenumber || 'ph' || (l_orderkey % 6) || 'op' || (l_linenumber % 2) || 'zz9' AS raw FROM lineitem
), pairs AS (SELECT l_orderkey, l_linenumber, regexp_extract_all(raw, '([a-z][a-z])([0-9]+)') AS ps FROM raws
), v AS (SELECT l_orderkey, l_linenumber, CAST(([p for p in ps if starts_with(p, 'id')])[-1][3:] AS INT) AS node_id, CAST(([p for p in ps if starts_with(p, 'px')])[-1][3:] AS INT) AS x,
  CAST(coalesce(([p for p in ps if starts_with(p, 'py')])[-1][3:], '0') AS INT) AS y, CAST(([p for p in ps if starts_with(p, 'pw')])[-1][3:] AS INT) AS w,
  CAST(([p for p in ps if starts_with(p, 'ph')])[-1][3:] AS INT) AS h, CAST(([p for p in ps if starts_with(p, 'op')])[-1][3:] AS INT) AS opacity FROM pairs)"""


@registry.add(RAWS_SQL + " SELECT l_orderkey, l_linenumber, node_id, x, y, w, h, opacity FROM v")
def visual_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visual features from raw attribute strings."""
    p = visual.parsed(_raws(spark, sf_dir))
    return p.select("l_orderkey", "l_linenumber", "node_id", F.col("position_x").alias("x"), F.col("position_y").alias("y"), F.col("position_w").alias("w"), F.col("position_h").alias("h"), "opacity")


@registry.add(RAWS_SQL + " SELECT w > 2 AND h > 2 AND opacity <> 0 AS visible, count(*) AS n FROM v GROUP BY 1")
def visible_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = visual.parsed(_raws(spark, sf_dir)).select(visual.visible(F.col("position_w"), F.col("position_h"), F.col("opacity")).alias("visible"))
    return p.groupBy("visible").agg(F.count(F.lit(1)).alias("n"))


def _pieces(spark: SparkSession, sf_dir: str, binary: bool = False) -> DataFrame:
    n, i = _nodes(spark, sf_dir), F.col("node_id")
    n = n.where(F.length(stripped(F.col("text"))) > 0).select(
        "url", "node_id", "text", (-i).alias("seq"), F.lit(False).alias("title"), (i % 5 != 0).alias("visible"), F.floor(i / 13).alias("brs"), F.floor(i / 4).alias("block_id"),
        (i % 3 == 0).alias("inline"), (i * 7 % 50).alias("x"), (i % 9).alias("w"), (i % 6).alias("offset_left"), F.lit(0).alias("client_left"),
    )
    return render.rendered(n, binary=binary)


PIECES_SQL = NODES_SQL + f""", kept AS (SELECT url, node_id, text, trim(text, {STRIP_SQL}) AS piece, node_id % 5 <> 0 AS visible, node_id // 13 AS brs, node_id // 4 AS block_id,
    node_id % 3 = 0 AS inl, node_id * 7 % 50 AS x, node_id % 9 AS w, node_id % 6 AS ol FROM nodes WHERE length(trim(text, {STRIP_SQL})) > 0
), prev AS (SELECT *, lag(text) OVER o AS ptext, lag(visible) OVER o AS pvis, lag(brs) OVER o AS pbrs, lag(block_id) OVER o AS pblock, lag(inl) OVER o AS pinl, lag(x) OVER o AS px, lag(w) OVER o AS pw,
    row_number() OVER o AS rn FROM kept WINDOW o AS (PARTITION BY url ORDER BY node_id DESC)
), seps AS (SELECT url, node_id, piece, visible, CASE WHEN rn = 1 THEN '' WHEN pvis <> visible OR pbrs <> brs OR pblock <> block_id THEN chr(10)
    WHEN regexp_matches(ptext, '[ \\t]\\z') OR regexp_matches(text, '^[ \\t]') THEN ' '
    WHEN pinl AND inl AND NOT (px + pw + 5 <= x OR ol >= 5) THEN ''
    WHEN regexp_matches(text, '^[{render.PUNCT}](?: |\\z)') OR regexp_matches(ptext, '(?:^| )[{render.PUNCT}]\\z') THEN '' ELSE ' ' END AS sep FROM prev
), pieces AS (SELECT url, node_id, piece, sep, visible, CAST(sum(length(sep) + length(piece)) OVER o AS INT) AS end_at, CAST(sum(strlen(sep) + strlen(piece)) OVER o AS INT) AS end_byte,
    CAST(length(piece) AS INT) AS n FROM seps WINDOW o AS (PARTITION BY url ORDER BY node_id DESC ROWS UNBOUNDED PRECEDING))"""


@registry.add(PIECES_SQL + " SELECT url, node_id, sep FROM pieces")
def separator_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).select("url", "node_id", "sep")


@registry.add(PIECES_SQL + " SELECT url, node_id, end_at - n AS start_at, end_at, end_byte FROM pieces")
def running_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets of each rendered node in characters, and its end in bytes."""
    chars = _pieces(spark, sf_dir).select("url", "node_id", F.col("start").alias("start_at"), F.col("end").alias("end_at"))
    return chars.join(_pieces(spark, sf_dir, True).select("url", "node_id", F.col("end").alias("end_byte")), ["url", "node_id"])


@registry.add(PIECES_SQL + " SELECT url, string_agg(sep || piece, '' ORDER BY node_id DESC) AS text FROM pieces GROUP BY url")
def rendered_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.page_text(_pieces(spark, sf_dir))


@registry.add(
    PIECES_SQL
    + """, runs AS (SELECT *, sum(CAST(visible AS INT)) OVER (PARTITION BY url ORDER BY node_id DESC ROWS UNBOUNDED PRECEDING) AS run FROM pieces)
    SELECT url, max(node_id) AS node_id, min(end_at - n) AS start_at, max(end_at - n) AS end_at FROM runs WHERE NOT visible GROUP BY url, run"""
)
def invisible_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = render.invisible_runs(_pieces(spark, sf_dir))
    return r.select("url", "node_id", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


@registry.add(
    PIECES_SQL
    + """ SELECT o.url, o.node_id, arg_max(i.end_at - i.n, i.node_id) AS start_at, arg_min(i.end_at, i.node_id) AS end_at FROM (SELECT DISTINCT url, node_id, node_id + node_id % 7 AS last_id FROM nodes) o
    JOIN pieces i ON o.url = i.url AND i.node_id BETWEEN o.node_id AND o.last_id GROUP BY o.url, o.node_id"""
)
def node_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first to the last rendered text node of each subtree."""
    r = render.node_offsets(_pieces(spark, sf_dir).select("url", "node_id", "start", "end"), _tree(spark, sf_dir))
    return r.select("url", "node_id", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


@registry.add(
    PIECES_SQL
    + " SELECT url, node_id // 10 AS parent_id, arg_max(end_at - n, node_id) AS start_at, arg_min(end_at, node_id) AS end_at FROM pieces GROUP BY url, node_id // 10"
)
def title_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pieces(spark, sf_dir).select("url", "node_id", "start", "end")
    parents = p.select("url", "node_id", F.floor(F.col("node_id") / 10).cast("int").alias("parent_id"))
    r = render.title_offsets(p.select("url", "node_id", "start", "end"), parents)
    return r.select("url", F.col("node_id").alias("parent_id"), F.col("start").alias("start_at"), F.col("end").alias("end_at"))


@registry.add("SELECT event_id, CAST(ntile(64) OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS INT) AS worker FROM events")
def shard_ntile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.sharded(table(spark, sf_dir, "events").select("event_id", "event_type"), [F.col("event_id")], 64, ["event_type"]).select("event_id", "worker")


@registry.add("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE r <= n - n % 128")
def truncate_multiple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.truncated(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", "event_id", 128).select("event_id")


@registry.add(
    """WITH e AS (SELECT event_id AS step, value AS loss FROM events ORDER BY event_id LIMIT 1000)
    SELECT step, loss, round(avg(loss) OVER (ORDER BY step ROWS UNBOUNDED PRECEDING) + 1e-9, 6) AS mean, round(loss - lag(loss) OVER (ORDER BY step), 6) AS gap FROM e"""
)
def loss_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running mean and gap of the losses up to a step limit."""
    got = training.running_mean(table(spark, sf_dir, "events"), "event_id", "value", 1000)
    return got.select("step", "loss", F.round(F.col("mean") + 1e-9, 6).alias("mean"), F.round("gap", 6).alias("gap"))


@registry.add(
    """WITH x AS (SELECT unnest(NodeIds) AS n, unnest(Url) AS url FROM page_features) SELECT url AS "Url", count(DISTINCT n) AS nodes FROM x WHERE url IS NOT NULL GROUP BY url"""
)
def scored_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of each page that the node scorer gives scores to, over a small fixed weight set: every node of every chunk."""
    rows = table(spark, sf_dir, "page_features").select("Url", "NodeIds", F.transform("TokenId", lambda t: F.transform(t, lambda x: F.when(x <= 2, x).otherwise(3 + x % 997))).alias("TokenId"))
    got = predict.scored(rows, predict.numpy_scorer(predict.small_weights())).where("Url IS NOT NULL AND size(scores) = 6 AND scores[0] BETWEEN 0 AND 1")
    return got.groupBy("Url").agg(F.countDistinct("NodeId").alias("nodes"))

@registry.add("SELECT event_type, CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS INT) AS place, CAST(1 AS BIGINT) AS rows FROM events")
def line_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of a seeded order of the rows of each group: each place once."""
    got = training.shuffled(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", "event_id", 42)
    return got.groupBy("event_type", "place").agg(F.countDistinct("event_id").alias("rows"))


@registry.add(
    """WITH x AS (SELECT vec_id % 10 AS sample, vec_id % 6 AS class_id, greatest(least(CAST(label % 2 AS DOUBLE), 1 - 1e-7), 1e-7) AS y, greatest(least((vec_id % 97) / 97.0, 1 - 1e-7), 1e-7) AS p FROM embeddings
    ), e AS (SELECT sample, class_id, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS l FROM x GROUP BY ALL), s AS (SELECT sample, sum(l) AS l FROM e GROUP BY sample) SELECT round(avg(l), 6) AS loss FROM s"""
)
def weighted_bce(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    x = e.select((e.vec_id % 10).alias("sample"), e.vec_id.alias("node"), (e.vec_id % 6).cast("int").alias("class_id"), (e.label % 2).cast("double").alias("y"), (e.vec_id % 97 / 97.0).alias("p"))
    return training.weighted_loss(x, training.class_weights(spark)).select(F.round("loss", 6).alias("loss"))


@registry.add("SELECT count(*) AS n, CAST(0 AS BIGINT) AS infinite, round(avg(value), 6) AS mean FROM events")
def finite_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = training.finite_losses(table(spark, sf_dir, "events"), "value")
    return f.select("n", "infinite", F.round("mean", 6).alias("mean"))


_LR, _WARM, _TOTAL, _EPOCH = 6e-4, 50, 1000, 100
SCHEDULE_SQL = f"""WITH s AS (SELECT CAST(range AS INT) AS step, CAST(range AS DOUBLE) AS s, floor(1 + range / 100.0) AS cycle FROM range({_TOTAL})
), t AS (SELECT *, greatest(0, 1 - abs(s / 50 - 2 * cycle + 1)) AS tri FROM s)
SELECT step,
  round({_LR} * CASE WHEN step < 50 THEN s / 50 ELSE greatest(0, (1000 - s) / 950) END, 10) AS linear_with_warmup,
  round({_LR} * CASE WHEN step < 50 THEN s / 50 ELSE 1 END, 10) AS constant_with_warmup,
  round({_LR} * CASE WHEN step < 50 THEN s / 50 ELSE greatest(0, 0.5 * (1 + cos(pi() * (s - 50) / 950))) END, 10) AS cosine_with_warmup,
  round(1e-8 + ({_LR} - 1e-8) * tri / pow(2, cycle - 1), 10) AS cyclic_triangular2,
  round(1e-8 + ({_LR} - 1e-8) * tri * pow(0.85, s), 10) AS cyclic_exp,
  round({_LR} * pow(0.1, floor(s / 100)) * least(1, (s + 1) / 50), 10) AS step_with_warmup,
  round({_LR} * CASE WHEN step < 50 THEN s / 50 ELSE pow(exp((ln(1e-8) - ln({_LR})) / 100), s) END, 10) AS exponential_with_warmup FROM t"""


@registry.add(SCHEDULE_SQL)
def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = spark.range(_TOTAL).select(F.col("id").cast("int").alias("step"))
    return steps.select("step", *(F.round(training.learning_rate(F.col("step"), k, _LR, _WARM, _TOTAL, _EPOCH), 10).alias(k) for k in training.SCHEDULES))


@registry.add(
    """WITH b AS (SELECT o_custkey, count(*) * 100 AS n FROM orders GROUP BY o_custkey), p AS (SELECT o_custkey, n, n // 8 AS per, least(30, n // 8) AS every FROM b)
    SELECT o_custkey, n * 30 // 2 AS total_steps, CASE WHEN every > 0 THEN per // every * every ELSE 0 END AS steps_per_epoch, CASE WHEN every > 0 THEN per // every * every ELSE 0 END * 30 AS steps_per_process FROM p"""
)
def step_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.count(F.lit(1)) * 100).alias("n"))
    c = training.step_counts(F.col("n"), 30, 2, 4, 30)
    return b.select("o_custkey", *(v.cast("long").alias(k) for k, v in c.items()))


@registry.add("SELECT * FROM (VALUES (0, 'Primary'), (1, 'Heading'), (2, 'Title'), (3, 'Paragraph'), (4, 'Table'), (5, 'List')) v(class_id, name), (SELECT 1.0::DOUBLE AS pos_weight, 1.0::DOUBLE AS neg_weight, 1.0::DOUBLE AS class_weight)")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.class_weights(spark)


@registry.add("SELECT doc_id, lower(lang) AS lang FROM documents WHERE lower(lang) = 'en'")
def language_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.lower("lang").alias("lang")).where("lang = 'en'")


_COUNTS = ", ".join(f"len([x for x in ws if x IN ({', '.join(repr(w) for w in p.split())})]) AS {k}" for k, p in PROFILES.items())
_BEST = f"greatest({', '.join(PROFILES)})"


@registry.add(
    f"""WITH w AS (SELECT doc_id, lang, regexp_split_to_array(lower(regexp_replace(text, '\\p{{C}}', '', 'g')), '[^\\p{{L}}]+') AS ws FROM documents WHERE text IS NOT NULL
    ), c AS (SELECT doc_id, lang, {_COUNTS} FROM w)
    SELECT doc_id, lang, CASE WHEN {_BEST} = 0 THEN NULL {" ".join(f"WHEN {k} = {_BEST} THEN '{k}'" for k in PROFILES)} END AS detected FROM c"""
)
def language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document by its frequent words."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", "lang", language(without_controls(F.col("text"))).alias("detected"))


@registry.add(
    """SELECT cw22id, '/data/html/' || substr(d, 1, 2) || '/' || substr(d, 1, 4) || '/' || d || '/' || d || '-' || split_part(cw22id, '-', 3) AS base, CAST(split_part(cw22id, '-', -1) AS INT) AS doc
    FROM (SELECT DISTINCT cw22id, split_part(cw22id, '-', 2) AS d FROM webpages WHERE cw22id IS NOT NULL)"""
)
def clueweb_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "webpages").select("cw22id").where("cw22id IS NOT NULL").distinct()
    return ids.select("cw22id", base_path(F.col("cw22id"), "/data").alias("base"), document_number(F.col("cw22id")).alias("doc"))


@registry.add(
    """WITH i AS (SELECT string_agg(lpad(CAST(n_nationkey * 977 AS VARCHAR), 10, '0') || chr(10), '' ORDER BY n_nationkey) AS x FROM nation)
    SELECT n_nationkey, CAST(substr(x, n_nationkey * 11 + 1, 10) AS BIGINT) AS start_byte FROM nation, i"""
)
def offset_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte offsets read from a fixed-width index by place."""
    n = table(spark, sf_dir, "nation")
    line = F.concat(F.lpad((n.n_nationkey * 977).cast("string"), 10, "0"), F.lit("\n"))
    index = n.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", line.alias("l")))), lambda x: x["l"]), "").alias("x"))
    return n.select("n_nationkey", offset_at(F.lit(index.first()[0]), F.col("n_nationkey")).alias("start_byte"))


@registry.add("SELECT warc_file, split_part(warc_file, '-', 1) AS entry, regexp_replace(warc_file, '\\.[^.]*$', '') AS bare, split_part(warc_file, '.', 1) AS stem, warc_file AS tsv FROM (SELECT DISTINCT warc_file FROM cc_text)")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of file names: entry, name without extension, stem, and the name before .tsv."""
    w = table(spark, sf_dir, "cc_text").select("warc_file").distinct()
    c = F.col("warc_file")
    return w.select("warc_file", entry_of(c).alias("entry"), without_extension(c).alias("bare"), before_dot(c).alias("stem"), tsv_name(F.concat(F.lit("/out/"), c, F.lit(".tsv"))).alias("tsv"))


@registry.add(PRIMARY_SQL + " SELECT '{\"Text\":' || to_json(t.Text) || '}' AS json FROM primary_texts t")
def response_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.page_texts(_joined(spark, sf_dir, "Primary")).select(response(F.col("Text")).alias("json"))
