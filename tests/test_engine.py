import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pagesieve.operators import evaluate, extract, features, labels, predict, render, training, visual
from pagesieve.plans.badrow_queries import registry as badrow_registry
from pagesieve.plans.queries import registry
from verify import plain

SF = "/root/testdata/sf0.001"
QUERIES = {**registry.queries, **badrow_registry.queries}
SQL = {**registry.sql, **badrow_registry.sql}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings webpages textnodes goldlabels inference_test cc_text page_features eval_items mix_targets raw_rows".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name in SQL:
        cur = con.execute(SQL[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == cols
        assert got == sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    else:
        assert got


def test_entry(spark):
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert entry.entry(spark).columns == ["url", "text"]


def test_tokens(spark):
    df = spark.createDataFrame([([0, 10, 11, 12, 13, 2, 1],), ([0, 10, 2, 1, 1],), ([],)], "t ARRAY<INT>")
    got = [(r.c, r.m) for r in df.select(features.cut_tokens(df.t).alias("c"), features.mask(features.cut_tokens(df.t)).alias("m")).collect()]
    assert got == [([0, 10, 11, 12, 2], [1] * 5), ([0, 10, 2, 1, 2], [1, 1, 1, 0, 1]), ([2], [1])]


def test_chunks(spark):
    n = spark.range(800).selectExpr("'u' AS url", "CAST(id AS INT) AS node_id")
    assert sorted(len(r.NodeIds) for r in features.chunk_rows(n, "url", "node_id").collect()) == [32, 384, 384]
    texts = spark.createDataFrame([("u", "a b"), ("v", None), ("w", " ".join("x" * 99))], "url STRING, text STRING")
    rows = {r.url: r.TokenId for r in features.tokenized(texts).collect()}
    assert all(len(t) == 50 for t in rows.values()) and rows["v"][:3] == [0, 2, 1] and rows["w"][-1] == 2


def test_confusion(spark):
    texts = spark.createDataFrame([("u1", "alpha beta"), ("u9", "x")], "Url STRING, Text STRING")
    gold = spark.createDataFrame(
        [("u1", 1, "alpha", True), ("u1", 2, "gamma", True), ("u1", 3, "beta", False), ("u1", 4, "zeta", False), ("u2", 1, "a", True), ("u2", 2, "b", False), ("u2", 3, "c", False), ("u2", 4, None, True)],
        "Url STRING, TextNodeId INT, Text STRING, JudgmentIsPrimary BOOLEAN",
    )
    m = evaluate.metrics(evaluate.page_confusion(texts, gold)).first()
    assert (m.tp, m.fp, m.fn, m.tn) == (1, 1, 2, 3)
    assert m.precision == 0.5 and abs(m.recall - 1 / 3) < 1e-12 and abs(m.accuracy - 4 / 7) < 1e-12 and abs(m.fscore - 0.4) < 1e-12
    assert evaluate.metrics(evaluate.page_confusion(texts, gold.limit(0))).first().precision is None


def test_threshold_is_strict_in_32_bits(spark):
    s = spark.createDataFrame([("u", 1, "Primary", 0.9), ("u", 2, "Primary", 0.9001), ("u", 0, "Primary", 1.0), ("u", 3, "Primary", None)], "url STRING, node_id INT, task STRING, score FLOAT")
    assert [r.TextNodeId for r in predict.saved(s).collect()] == [2]
    assert {r.node_id for r in predict.passing(s).where("threshold = 0.9").collect()} == {2}


def test_visual(spark):
    df = spark.createDataFrame([("id12px10px11py-3pw200",), ("",), (None,)], "raw STRING")
    rows = visual.parsed(df).collect()
    assert (rows[0].node_id, rows[0].position_x, rows[0].position_y, rows[0].position_w) == (12, 11, 0, 200)
    assert rows[1].node_id is None and rows[1].opacity == 0 and rows[2].position_x == 0


def test_fallback_and_flags(spark):
    nodes = spark.createDataFrame([("a", 1, 3, False), ("a", 2, 2, True), ("a", 3, 3, True), ("b", 5, 5, True)], "url STRING, node_id INT, last_desc_id INT, is_text BOOLEAN")
    ann = spark.createDataFrame([("a", 1, 1), ("a", 2, 6), ("a", 99, 2), ("b", 5, 0)], "url STRING, node_id INT, type INT")
    assert {(r.url, r.node_id) for r in labels.with_fallback(ann, nodes).where("url = 'b' AND type = 1").collect()} == {("b", 5)}
    hot = {(r.url, r.node_id): r.labels for r in labels.multi_hot(nodes, labels.propagated(ann, nodes)).collect()}
    assert hot["a", 2] == [1, 0, 0, 0, 0, 1] and hot["a", 3] == [1, 0, 0, 0, 0, 0] and hot["b", 5] == [0] * 6 and hot["a", 1] == [0] * 6
    assert {(r.type, tuple(r.node_ids)) for r in labels.annotation_map(ann, nodes).collect()} == {(1, (1,)), (6, (2,))}


def test_shards(spark, monkeypatch):
    monkeypatch.setattr(training, "PART_ROWS", 7)
    df = spark.range(50).select("id", F.when(F.col("id") < 40, "big").when(F.col("id") < 47, "small").alias("g"))
    got = [r["count"] for r in training.sharded(df.where("id < 10"), [F.col("id")], 4).groupBy("worker").count().orderBy("worker").collect()]
    assert got == [3, 3, 2, 2]
    places = {(r.g, r.place) for r in training.shuffled(df, "g", "id", 3).collect()}
    assert places == {("big", i) for i in range(40)} | {("small", i) for i in range(7)} | {(None, i) for i in range(3)}
    assert {r.id for r in training.truncated(df, "g", "id", 6).collect()} == {*range(36), *range(40, 46)}
    assert training.sharded(df.limit(0), [F.col("id")], 4).count() == 0
    with pytest.raises(ValueError):
        training.learning_rate(df.id, "none", 1, 1, 1, 1)


def test_scores_do_not_depend_on_batches(spark):
    rng = __import__("random").Random(1)
    rows = [([f"u{i}"] * n, list(range(n, 0, -1)), [[0, *(rng.randrange(3, 999) for _ in range(rng.randint(0, 6))), 2] for _ in range(n)]) for i, n in enumerate((1, 5, 300, 420, 0, 40))]
    df = spark.createDataFrame([*rows, (None, None, None)], "Url ARRAY<STRING>, NodeIds ARRAY<INT>, TokenId ARRAY<ARRAY<INT>>")
    scorer = predict.numpy_scorer(predict.small_weights())
    alone = {}
    for urls, ids, tokens in rows:
        for at in range(0, len(ids), 384):
            alone |= dict(zip([(urls[0], i) for i in ids[at : at + 384]], [tuple(round(float(x), 5) for x in r) for r in scorer(tokens[at : at + 384])], strict=True))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in ("1", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = {(r.Url, r.NodeId): tuple(round(x, 5) for x in r.scores) for r in predict.scored(df.coalesce(1), scorer).collect()}
        assert got.keys() == alone.keys() and all(got[k] == pytest.approx(alone[k], abs=2e-5) for k in got)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {k for k, v in alone.items() if v[0] > 0.9}
    assert {(r.Url, r.TextNodeId) for r in predict.infer(df, scorer).collect()} == want


def test_extract_drops_nulls(spark):
    p = spark.createDataFrame([("u", 1, "Primary"), ("u", 2, "Primary"), ("u", None, "Primary"), ("v", 1, "List")], "Url STRING, TextNodeId INT, Task STRING")
    t = spark.createDataFrame([("u", 1, "b"), ("u", 2, "a"), ("u", 2, "a"), ("v", 1, None)], "Url STRING, TextNodeId INT, Text STRING")
    assert [(r.Url, r.Text) for r in extract.page_texts(extract.predicted_text(p, t)).collect()] == [("u", "aab")]


def test_title_row_comes_first(spark):
    row = dict(url="u", visible=True, brs=0, block_id=1, inline=False, x=0, w=9, offset_left=0, client_left=0)
    rows = [dict(row, node_id=9, seq=0, text="T", title=True), dict(row, node_id=5, seq=1, text="a", title=False), dict(row, node_id=4, seq=2, text=". b", title=False)]
    df = spark.createDataFrame(rows)
    got = {r.node_id: (r.sep, r.start, r.end) for r in render.rendered(df).collect()}
    assert got == {9: ("", 0, 1), 5: ("\n", 2, 3), 4: ("", 3, 6)}
    assert render.page_text(render.rendered(df)).first().text == "T\na. b"
