import duckdb
import pytest

from pagesieve import session
from pagesieve.llm.lines import blocks, keyed_lines, own_text, repeated_lines
from pagesieve.llm.pagestats import PROFILE, Line, figures, prose_flags
from pagesieve.llm.quality import flagged, not_prose, page_profiles, quality, spam_pages
from pagesieve.llm.queries import registry
from pagesieve.llm.robust import robust_z, statistics

SF = "/root/testdata/sf0.001"
PAGES = "url STRING, text STRING, site STRING, own STRING, k LONG, block LONG"
LEGAL = "All rights reserved by the owners 2020"


def pages(spark, rows):
    return spark.createDataFrame([(u, t, "clash", "clash", 1, 2) for u, t in rows], PAGES)


@pytest.mark.parametrize("name", ["p5_found", "p5_clean", "p5_blocks"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW cc_text AS SELECT * FROM '{SF}/cc_text.parquet'")
    cur = con.execute(registry.sql[name])
    names = [d[0] for d in cur.description]
    df = registry.queries[name](spark, SF)
    assert sorted(tuple(map(str, r)) for r in df.select(*names).collect()) == sorted(tuple(map(str, r)) for r in cur.fetchall())


def test_repeated_lines(spark):
    rows = [(f"http://WWW.a.example/{i}", f"Own line number {'x' * i} of page\n{LEGAL.upper() if i % 2 else LEGAL.replace('2020', '77')}\n  Imprint  and contact page \nshort") for i in range(5)]
    rows += [rows[0], ("http://a.example/9", None), (None, LEGAL), ("http://b.example/1", LEGAL), ("http://b.example/2", ""), ("nohost", LEGAL)]
    got = repeated_lines(pages(spark, rows))
    found = {(r.url, r.line_no) for r in got.collect()}
    assert found == {(f"http://WWW.a.example/{i}", n) for i in range(5) for n in (2, 3)}
    assert got.select("block").distinct().count() == 1  # the two lines follow one another on every page
    own = {r.url: r.own for r in own_text(pages(spark, rows)).collect() if r.url}
    assert own["http://WWW.a.example/3"] == "Own line number xxx of page\nshort" and own["http://b.example/1"] == LEGAL and "http://a.example/9" not in own
    assert repeated_lines(pages(spark, [])).count() == 0 and own_text(pages(spark, [])).count() == 0


def test_exact_share_counts(spark):
    rows = [(f"http://c.example/{i}", LEGAL if i < 7 else f"Some own line of the page {'y' * i}") for i in range(70)]
    rows += [(f"http://d.example/{i}", LEGAL if i < 7 else f"Some own line of the page {'y' * i}") for i in range(71)]
    assert {r.url for r in repeated_lines(pages(spark, rows)).collect()} == {f"http://c.example/{i}" for i in range(7)}


def test_shuffled_joins_are_whole(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/cc_text.parquet")
    want = {tuple(r) for r in repeated_lines(df).select("url", "line_no").collect()}, {tuple(r) for r in own_text(df).select("url", "own").collect()}
    monkeypatch.setattr(session, "BROADCAST_LIMIT", 0)
    assert ({tuple(r) for r in repeated_lines(df).select("url", "line_no").collect()}, {tuple(r) for r in own_text(df).select("url", "own").collect()}) == want


def test_single_lines_are_blocks(spark):
    rows = [(f"http://e.example/{i}", f"First common line here\nOwn line {'z' * (i + 9)} of it\nSecond common line here") for i in range(5)]
    found, hits = blocks(keyed_lines(pages(spark, rows)))
    assert found.select("block").distinct().count() == 2 and found.count() == 2 and hits.count() == 5


PROSE = "The old house stood near the river. It was a cold day, and the people of the town were at home."
WRAPPED = "It was a cold day. The old house\nstood near the river and the\npeople of the town were at home\nbecause it was winter then. The\nmill stood still."
ITEMS = "\n".join(f"{mark} The {x} of the house" for mark in ("-", "3)", "7.", "•") for x in ("door", "roof", "garden"))
TABLE = "\n".join(f"Oven {i} | n/a | {i}.5% | 2020-01-{i:02d}" for i in range(1, 20))
STUFFED = " ".join(["cheap kettle online", "best kettle", "kettle shop", "Kettle"] * 30)
LINKS = "\n".join(f"A title of some page {i} http://a.example/some/long/path/{i}" for i in range(20))
TAGS = " ".join(f"#kettle{x}" for x in ("", "shop", "sale", "best") * 20)


def test_prose_flags():
    assert all(prose_flags([Line(x) for x in PROSE.split("\n")])) and all(prose_flags([Line(x) for x in WRAPPED.split("\n")]))
    assert not any(prose_flags([Line(x) for x in TABLE.split("\n")]))
    assert not any(prose_flags([Line(x) for x in ITEMS.split("\n")]))
    assert prose_flags([Line(PROSE.upper())]) == [True]
    assert prose_flags([Line("Старая река осталась пустой после дождя и люди ушли.")]) == [True]
    assert prose_flags([Line(PROSE.replace("a", "Ã©"))]) == [True]


def test_figures():
    f = figures(PROSE)
    assert f["language"] == "en" and f["n_words"] == 21 and f["not_prose"] == 0 and f["punct_lines"] == 1
    assert figures("")["n_words"] == 0 and figures("")["not_prose"] == 0
    assert figures(TABLE)["not_prose"] > 0.9
    assert figures(ITEMS)["not_prose"] == 1 and figures(ITEMS)["spam"] == 0
    anchors = "\n".join(f"<a href=//a.example>The title of a page {i}</a>" for i in range(9))
    captions = "\n".join(f"The title of some page {i} – b.example" for i in range(9))
    russian = "Старая река осталась пустой после дождя. Новая дорога привела людей к дому. " * 5
    assert figures(russian.encode().decode("latin-1"))["not_prose"] == 0
    for text in (STUFFED, LINKS, TAGS, anchors, captions):
        assert figures(text)["spam"] > 0.5, text
    assert figures(PROSE * 50)["spam"] == 0 and figures(TABLE)["spam"] < 0.5
    assert figures("x" * 2_000_000)["n_words"] == 1


def test_operators(spark):
    rows = [(f"http://s{i}.example/p", f"The person {i} saw the house of the town. " + PROSE + f" It was year {i}.") for i in range(80)]
    bad = {"http://t.example/1": TABLE, "http://t.example/2": STUFFED, "http://t.example/3": LINKS, "http://t.example/4": TAGS}
    df = pages(spark, rows + list(bad.items()) + [("http://t.example/5", None), ("http://t.example/6", ""), ("http://t.example/1", TABLE)])
    assert {r.url for r in not_prose(df).collect()} == set(bad)
    assert {r.url for r in spam_pages(df).collect()} == set(list(bad)[1:])
    profiles = page_profiles(df)
    got = quality(profiles)
    assert got.count() == profiles.count() == 86 and {f"rank_{c}" for c in ("n_words", "closed")} < set(got.columns)
    flags = {r.url: (r.in_tail, r.outlier) for r in got.collect()}
    assert not any(any(flags[u]) for u, _ in rows) and flags["http://t.example/1"][0] and all(flags[u][1] for u in list(bad)[1:])
    assert not_prose(pages(spark, [])).count() == 0 and spam_pages(pages(spark, [])).count() == 0


def test_junk_at_any_share_is_found(spark):
    prose = [(f"http://s{i}.example/p", f"The person {i} saw the house of the town. " + PROSE) for i in range(60)]
    # every language figure sees the junk: English function words beside it
    junk = "the of and\n" + TABLE
    rows = prose + [("http://t.example/copied", junk)] * 40 + [("http://t.example/other", junk.replace("Oven", "Stove"))]
    rows += [(f"http://t.example/{i}", junk.replace("Oven", f"Oven {'x' * i}")) for i in range(40)]
    for part in (rows, rows[60:], prose[:1] + rows[60:]):
        assert {r.url for r in not_prose(pages(spark, part)).collect()} == {u for u, _ in rows[60:]}
    # copies of one text move no statistic
    figs = page_profiles(pages(spark, rows))
    once = {r.url: r.z_closed for r in quality(figs.dropDuplicates(["url"])).collect()}
    assert {r.url: r.z_closed for r in quality(figs).collect()} == once


def test_spam_stays_spam_at_any_share(spark):
    prose = [(f"http://s{i}.example/p", f"The person {i} saw the house of the town. " + PROSE) for i in range(60)]
    stuffed = "It is the best of the kettle. " + STUFFED
    spam = [("http://t.example/copied", stuffed)] * 50 + [(f"http://t.example/{i}", stuffed.replace("shop", f"shop{'x' * i}")) for i in range(40)]
    for rows in (prose + spam, spam, prose[:1] + spam):
        assert {r.url for r in spam_pages(pages(spark, rows)).collect()} == {u for u, _ in spam}
    far = {r.url: r.outlier for r in flagged(page_profiles(pages(spark, prose + spam)), quality=False).collect()}
    assert {u for u, o in far.items() if o} == {u for u, _ in spam}


def test_selection_keeps_what_the_shares_find(spark):
    """Over a whole table, hardly a page that its shares would call a case is missed by tails and outliers, which spare most pages."""
    rows = [(r.own, r.in_tail, r.outlier) for r in flagged(page_profiles(spark.read.parquet("/root/testdata/sf0.01/cc_text.parquet"))).select("own", "in_tail", "outlier").collect()]
    exact = [(t or o, o, f["not_prose"] > 0.5 or f["spam"] > 0.5, f["spam"] > 0.5) for (own, t, o), f in ((r, figures(r[0])) for r in rows)]
    assert sum(f and c for f, _, c, _ in exact) >= 0.98 * sum(c for _, _, c, _ in exact) > 0
    assert sum(o and s for _, o, _, s in exact) >= 0.98 * sum(s for *_, s in exact) > 0
    assert sum(f for f, *_ in exact) < 0.5 * len(exact)


def test_small_languages_lean_on_all(spark):
    rows = [(i, "en", float(i % 9)) for i in range(900)] + [(1000 + i, "de", 50.0) for i in range(2)]
    df = spark.createDataFrame(rows, "text_id LONG, language STRING, x DOUBLE")
    stats = {r.language: r.m_x for r in statistics(df, ("x",), {"x": 0.5}).collect()}
    assert abs(stats["en"] - 4) <= 1 and stats["en"] < stats["de"] < 10 and stats["fr"] == pytest.approx(4, abs=1)
    z = {r.text_id: r.z_x for r in robust_z(df, statistics(df, ("x",), {"x": 0.5}), ("x",)).collect()}
    assert z[1000] > 5 and len(z) == 902
    assert statistics(df.limit(0), ("x",), {"x": 0.5}).count() == 9


def test_code_is_no_spam():
    code = "\n".join(f"var kol{i}=tov[{i}]||function(to){{return tov.tor({i})}};" for i in range(40))
    assert figures(code)["spam"] < 0.5 < figures(code)["not_prose"] and set(PROFILE) < set(figures(code))


def test_all_key_words_count():
    six = "\n".join(f"{a} {b} {c}" for b in ("kettle", "lamp", "sofa", "tent", "boot", "mug") for a in ("best", "cheap", "new") for c in ("online", "shop") * 2)
    phrases = "\n".join(f"{x} offers {i % 5}" for i in range(5) for x in ("tall lamp", "red sofa", "wide tent", "dry boot", "blue mug", "old door", "big oven", "soft rug", "thin pan", "hot iron", "long rope", "flat desk"))
    short = "\n".join(["tv kaufen tv neu tv", "pc kaufen pc alt pc", "tv laden tv", "pc laden pc"] * 12)
    foreign = "The price of it is low. " + "\n".join(["war game war shop war", "die cast die set die", "war film war", "die box die"] * 12)
    for text in (six, phrases, short, foreign):
        assert figures(text)["spam"] > 0.5, text
    amounts = "\n".join(f"{i * 7} {m} {a} {b}" for i, (m, a, b) in enumerate((m, a, b) for a in ("large", "small", "grey", "old", "warm", "thin", "wide", "odd", "raw", "dry") for b, m in zip(("oven", "lamp", "sofa", "tent", "boot", "mug", "desk", "rug", "pan", "rope"), ("kg", "g", "ml", "tsp", "x") * 2)))
    assert figures(amounts)["spam"] <= 0.5 and figures(TABLE)["spam"] < 0.5 and figures(PROSE * 50)["spam"] == 0


def test_thin_key_words_beside_links():
    thin = "\n".join(f"{a}kettle {b}kettle and then {a} or {b} at one of our many other old town shops" for a, b in (("tea", "egg"), ("cat", "dog"), ("sun", "sea"), ("ice", "oak"), ("ash", "elm")))
    plain = "The kettle is here now. A kettle came by. Our kettle fell. One kettle left again. " * 2 + " ".join(f"It was w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}n at it." for i in range(33))
    links = "\n".join(f"//a.de/{i} a b c d e f http://b.de" for i in range(34))
    text = "\n".join((links, thin, plain))
    assert figures(text)["links"] < 0.5 < figures(text)["spam"]
