import random
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from pagesieve import session
from pagesieve.llm.neardup import prefix, reached, shingles, simhash
from pagesieve.llm.residue import _loose, is_residue, look, residue_documents, without_residue

PROSE = (
    "The old house stood near the river and nobody lived there. It was a cold day, and the people of the town stayed at home with their dogs. "
    "In the evening a letter came for the owner of the mill, who read it twice and then put it into the fire. Nobody in the town ever heard what it said."
)


@pytest.mark.parametrize(
    "text",
    ["Welcome to {{name}}, the shop in {{city}}.", "Buy %title% for only %price%", "Thanks, [[street]]", "Dear *|name|*,", "About <%= x %>", "Hello ${user.email}", "About @@title@@", "Thanks, __city__",
     "404 – Page not found", "502 Bad Gateway", "Erreur 404", "Seite nicht gefunden", "[object Object]", "null null", "Please enable JavaScript to view this page.", "Checking your browser before you enter X.",
     "Service temporarily unavailable", "Session expired", "Fatal error", "Untitled document", "Database connection failed", "The story you asked for has been removed or is no longer available.", "Error interno del servidor", "Text text text.", "This is a dummy paragraph.", "Your text goes here. Replace this text."],
)
def test_signs(text):
    assert is_residue(text)


@pytest.mark.parametrize("text", ["The page was long.", "Room 404 was empty.", "She undid the knot here and there.", "The server wrote “404 Not Found” in red.", "It cost 50% of 20% in all", "a [sic] b [1]", ""])
def test_no_signs(text):
    assert not is_residue(text)


def parts(text):
    """(words of signed passages, words of other prose)"""
    ps = look(text).passages
    return sum(n for _, n, mark, _ in ps if mark), sum(n for _, n, mark, prose in ps if prose and not mark)


def test_look():
    assert parts(PROSE)[0] == 0 and parts(PROSE)[1] >= 60
    assert parts(PROSE + "\nIn the template, write {{date}} here.")[1] >= 60 and look("Please enable JavaScript.\n" + PROSE).leads
    assert parts("404 – Page not found\nThe address /x/1 does not exist on this server. Check the spelling.")[0] > 0
    assert parts("Lorem ipsum dolor sit amet, consectetur adipiscing elit.\n" * 30)[0] > 200
    assert parts("Some words of the house. " * 40)[0] > 100  # one sentence over and over is filler, however long
    assert parts("at a.b (c.php:12)\n#1 d.e (f.js:3)\nFile x (y.py:7)")[0] > 0
    assert look("").words == [] and look("Home | News\nLoading").passages == [] and parts("A short sentence of its own.")[0] == 0
    masked = [p for p, *_ in look("You need {{x}} to open /a/b of Red Lamp on day 7.").passages]
    assert masked == ["you need {} to open 0 of N on day 0"]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id LONG, text STRING, class_id LONG, marked STRING")


def test_operator(spark):
    gone = "The thing you asked this machine for is no longer kept in this place since the big move of the year {}, so kindly look for it in some other place"
    rows = [(1, "Please enable JavaScript to view this page."), (2, PROSE), (3, None), (4, ""), (5, "502 Bad Gateway\n" + gone.format(7)), (6, gone.format(8) + " today"), (7, "502 Bad Gateway\n" + gone.format(9)), (8, "A short text of its own."), (9, "  \n ")]
    got = {r.doc_id: r for r in residue_documents(docs(spark, rows)).collect()}
    assert set(got) == {1, 5, 6, 7}
    assert got[6].how == "links" and got[6].component == got[5].class_id and got[5].class_id == got[7].class_id and got[5].how == "signs"
    assert {r.doc_id for r in without_residue(docs(spark, rows)).collect()} == {2, 3, 4, 8, 9}
    assert residue_documents(docs(spark, [])).count() == 0
    assert residue_documents(docs(spark, [(1, "word " * 300_000 + "{{x}}")])).count() in (0, 1)


def test_long_error_pages_are_reached(spark):
    """A long page without a sign is residue where its wording is: by passages of other residue, and by near-duplicates."""
    regret = "We are so sorry that the thing you came for is not here. Our people know about it and work on it at this hour. You can go back to where you were. Or come again when the sun is up."
    rows = [(i, f"502 Bad Gateway\nBig thing {'x' * i} error 500\n{regret}") for i in range(30)]
    rows += [(100, regret), (101, regret.replace("sun", "moon") + "\n" + regret), (102, PROSE), (103, PROSE + "\n" + regret)]
    got = {r.doc_id: r.how for r in residue_documents(docs(spark, rows)).collect()}
    assert set(got) == {*range(30), 100, 101} and set(got.values()) == {"passages"}


def _partition(n, links):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        parent[root(a)] = root(b)
    return {frozenset(j for j in range(n) if root(j) == root(i)) for i in range(n)}


@pytest.mark.parametrize("limit", [session.BROADCAST_LIMIT, 0])
def test_reached_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(session, "BROADCAST_LIMIT", limit)
    rng = random.Random(7)
    bases = [[rng.getrandbits(62) for _ in range(rng.randint(1, 40))] for _ in range(12)]
    sets = []
    for _ in range(120):
        s = list(rng.choice(bases))
        for _ in range(rng.randint(0, 6)):
            s[rng.randrange(len(s))] = rng.getrandbits(62)
        sets.append(np.array(sorted(set(s)), np.int64))
    nodes = spark.createDataFrame([(i, simhash(s), len(s), prefix(s), s.tolist()) for i, s in enumerate(sets)], "id LONG, sim LONG, n INT, keys ARRAY<LONG>, shingles ARRAY<LONG>")
    seeds = spark.createDataFrame([(i,) for i in range(0, 120, 17)], "id LONG")
    got = {r.id: r.root for r in reached(nodes.drop("shingles"), seeds, lambda ids, size: nodes.join(ids, "id").select("id", "shingles")).collect()}
    as_sets = [set(s.tolist()) for s in sets]
    similar = [(i, j) for i in range(len(sets)) for j in range(i) if len(as_sets[i] & as_sets[j]) >= 0.8 * len(as_sets[i] | as_sets[j])]
    parts = _partition(len(sets), similar)
    want = set().union(*(p for p in parts if any(i % 17 == 0 for i in p)))
    assert set(got) == want and len(want) > 20
    assert all(any(i in p and got[i] in p for p in parts) and got[i] % 17 == 0 for i in got)


def test_shingles():
    words = "a b c d e f g a b c d e".split()
    assert len(shingles(words)) == 7 and len(shingles(words[:3])) == 1 and len(shingles([])) == 0
    assert set(shingles(words[:6]).tolist()) < set(shingles(words).tolist())
    assert len(prefix(shingles(words))) == 2 and len(prefix(np.arange(10))) == 3


def test_words_come_in_few_pieces():
    """Words in small letters are taken in runs, and the words are those of a look at each word by itself."""
    plain = re.compile(r"(?<!\S)\S*[\d/\\@]\S*|\w+|[{}]+|\n")
    assert len(_loose.findall("the old house stood near the river, and nobody lived there.")) == 2
    rng = random.Random(3)
    parts = ["the", "old ", " ", "  ", "\n", "\xa0", "é", "ß", "ж", "A", "Ünter ", "4", "/", "@", "\\", ".", ", ", "!” ", "don't", "a-b", "_", "{", "}}", "ª", "é", "漢"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=12))
        assert [w for x in _loose.findall(text) for w in (x.split(" ") if " " in x else [x])] == plain.findall(text), text


def test_prose_is_looked_for_where_it_matters(spark):
    """Without a sign a text's prose is left for later, and found once its passages turn out to be residue, whatever its id."""
    assert any(x for *_, x in look(PROSE).passages) and not any(x for *_, x in look(PROSE, False).passages)
    assert look(PROSE + "\n404 – Page not found", False) == look(PROSE + "\n404 – Page not found")
    regret = "We are so sorry that the thing you came for is not here. Our people know about it and work on it at this hour. You can go back to where you were. Or come again when the sun is up."
    rows = [(i, f"502 Bad Gateway\nBig thing {'x' * i} error 500\n{regret}") for i in range(30)]
    rows += [(None, regret), (None, PROSE), (0, regret + "\n" + PROSE)]
    got = residue_documents(docs(spark, rows)).select("doc_id").collect()
    assert sorted(str(r.doc_id) for r in got) == sorted([*map(str, range(30)), "None"])
