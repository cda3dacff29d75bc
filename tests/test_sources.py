import gzip
import zipfile

from pagesieve.cli import parser
from pagesieve.functions.decode import decode_bytes, language
from pagesieve.plans.pipelines import all_text, build, html_pages
from pagesieve.sources import files, vdom, warc
from pagesieve.streaming.micro import page_text_stream


def _record(url, body, kind="response"):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nContent-Length: {len(http)}\r\n\r\n".encode()
    return head + http + b"\r\n\r\n"


def test_warc_scan_and_build(spark, tmp_path):
    data = _record("http://a", b"<p>the cat and the dog of the house</p>") + _record("http://b", b"x", "request") + _record("http://c", "<p>der Hund und die Katze sind in dem Haus</p>".encode())
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(data))
    pages = warc.read_responses(spark, str(tmp_path))
    assert {r.url for r in pages.collect()} == {"http://a", "http://c"}
    html = html_pages(pages)
    assert [r.url for r in html.collect()] == ["http://a"]
    chunks, texts = build(html)
    assert [r.Text for r in texts.collect()] == ["the cat and the dog of the house"]
    assert chunks.first().NodeIds == [1]
    files.write_features(chunks, str(tmp_path / "encoded"))
    good, bad = files.read_features(spark, str(tmp_path / "encoded"))
    assert good.first().Url == ["http://a"] and bad.count() == 0


def test_point_lookup(spark, tmp_path):
    base = tmp_path / "html" / "en" / "en00" / "en0000"
    base.mkdir(parents=True)
    blobs = [gzip.compress(f"WARC/1.0\r\nA: {i}\r\n\r\n<p>{i}</p>".encode()) for i in range(3)]
    offsets = [sum(map(len, blobs[:i])) for i in range(4)]
    (base / "en0000-00.warc.gz").write_bytes(b"".join(blobs))
    (base / "en0000-00.warc.offset").write_text("".join(f"{o:010d}\n" for o in offsets))
    ids = spark.createDataFrame([("clueweb22-en0000-00-00001",), ("clueweb22-en0000-00-00009",), ("clueweb22-en0001-00-00000",)], "cw22id STRING")
    assert [(r.cw22id[-1], r.html) for r in warc.lookup(ids, str(tmp_path)).collect()] == [("1", "<p>1</p>")]


def test_vdom(spark, tmp_path):
    page = {"url": "u", "urlhash": "h", "language": "en", "cw22id": "c", "topic": ["a"], "content": b"<p>x", "annotations": [{"nodeId": 300, "type": 1}], "nodeRawFeature": ["id1px2"]}
    with zipfile.ZipFile(tmp_path / "en0001-01.zip", "w") as z:
        z.writestr("doc1.bin", vdom.encode(page))
        z.writestr("doc2.bin", b"\xff\xff\xff")
    rows = vdom.read_archives(spark, str(tmp_path)).collect()
    assert [r.doc_id for r in rows] == ["doc1"] and rows[0].annotations[0].nodeId == 300 and bytes(rows[0].content) == b"<p>x"


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("u", 1, 'a "b", c\nd'), ("v", 2, None)], files.TEXTNODES)
    files.write_csv(df, str(tmp_path / "t"))
    assert sorted(files.read_textnodes(spark, str(tmp_path / "t")).collect()) == sorted(df.collect())
    p = spark.createDataFrame([("u", 1, "Primary")], files.PREDICTIONS)
    files.write_tsv(p, str(tmp_path / "p"))
    assert files.read_predictions(spark, str(tmp_path / "p")).collect() == p.collect()
    (tmp_path / "m.json").write_text('["en0000-01.zip", "en0001-02.zip"]')
    assert [r.entry for r in files.read_manifest(spark, str(tmp_path / "m.json")).collect()] == ["en0000", "en0001"]
    (tmp_path / "l.txt").write_text("a\nb\n")
    assert [(r.line_no, r.value) for r in files.indexed_lines(spark, str(tmp_path / "l.txt")).collect()] == [(0, "a"), (1, "b")]
    (tmp_path / "a.tsv.offset").write_text("")
    assert {r.path.rsplit("/", 1)[1] for r in files.list_data_files(spark, str(tmp_path)).collect()} >= {"m.json"}


def test_stream(spark, tmp_path):
    spark.createDataFrame([("u", "<p>a</p><p>b</p>"), ("v", "<div>c</div>")], "url STRING, html STRING").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("url STRING, html STRING").parquet(str(tmp_path / "in"))
    page_text_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {(r.url, r.text) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("u", "a"), ("v", "c")}


def test_small_parts(spark):
    assert decode_bytes(b"\xe9") == "é" and decode_bytes(b"\xff\x81") is None and decode_bytes("é".encode()) == "é"
    df = spark.createDataFrame([("the house of the cat",), ("",), (None,)], "t STRING")
    assert [r[0] for r in df.select(language(df.t)).collect()] == ["en", None, None]
    assert parser().parse_args(["build", "--path", "a", "--out", "b"]).language == "en"
    assert all_text(spark.createDataFrame([], "url STRING, html STRING")).count() == 0
    assert warc.fetched(spark.createDataFrame([("http://127.0.0.1:9/",)], "url STRING"), 1).first().status is None
