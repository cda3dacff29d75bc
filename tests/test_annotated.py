from pagesieve.plans.annotated import primary_content, test_rows, training_rows

HTML = (
    '<html data-dcnode-id="0" semanticlayout="x"><head data-dcnode-id="14"><title data-dcnode-id="15"><span data-dcnode-id="16" instrument_node="">T</span></title></head>'
    '<body data-dcnode-id="1"><p data-dcnode-id="10"><span data-dcnode-id="13" instrument_node="">Hi</span><b data-dcnode-id="11"><span data-dcnode-id="12" instrument_node=""> bold</span></b></p>'
    '<table data-dcnode-id="4"><tr data-dcnode-id="5"><td data-dcnode-id="8"><span data-dcnode-id="9" instrument_node="">c1</span></td><td data-dcnode-id="6"><span data-dcnode-id="7" instrument_node="">c2</span></td></tr></table>'
    '<noscript data-dcnode-id="2"><span data-dcnode-id="3" instrument_node="">no</span></noscript></body></html>'
)
SEEN = [f"id{i}pw50ph20op1" for i in (13, 12, 9)]


def _input(spark, annotations):
    pages = spark.createDataFrame([("u", HTML, SEEN)], "url STRING, html STRING, nodeRawFeature ARRAY<STRING>")
    return pages, spark.createDataFrame(annotations, "url STRING, node_id INT, type INT")


def test_content_and_offsets(spark):
    pages, ann = _input(spark, [("u", i, 1) for i in (13, 12, 9, 7)] + [("u", 10, 4), ("u", 4, 5), ("u", 13, 3), ("u", 999, 2)])
    text, offsets = primary_content(pages, ann)
    assert text.first().text == "T\nHi bold\nc1\nc2"
    got = {(r.name, r.node_id): (r.start, r.end) for r in offsets.collect()}
    assert got == {
        ("HtmlTitle", 15): (0, 1), ("Title", 10): (2, 4), ("Paragraph", 10): (2, 9), ("Table", 4): (10, 15), ("TableRow", 5): (10, 15),
        ("TableCell", 8): (10, 12), ("TableCell", 6): (13, 15), ("InvisibleText", 7): (13, 13),
    }
    bare, _ = primary_content(pages, ann, add_title=False)
    assert bare.first().text == "Hi bold\nc1\nc2"


def test_training_rows(spark):
    pages, ann = _input(spark, [("u", 10, 1), ("u", 4, 5)])
    row = training_rows(pages, ann).first()
    assert row.NodeIds == [16, 13, 12, 9, 7, 4]
    assert row.Labels == [[0] * 6] + [[1, 0, 0, 0, 0, 0]] * 2 + [[0, 0, 0, 0, 1, 0]] * 2 + [[0] * 6]
    gold, texts = test_rows(pages, ann)
    assert {r.TextNodeId for r in gold.where("JudgmentIsPrimary").collect()} == set() and texts.count() == 6
    pages, ann = _input(spark, [("u", 4, 5)])
    assert {r.TextNodeId for r in test_rows(pages, ann)[0].where("JudgmentIsPrimary").collect()} == {16, 13, 12, 9, 7}
