import pytest

from pagesieve.llm.charset import CHAINS, SOUND, STATES, cells, garbled, restore, undo, undo_cell

CLEAN = [
    "La fête célèbre a mesuré l’été près de la forêt étrange.", "Die schöne Straße führt über die große Brücke.", "A canção do avô começou na manhã de verão.",
    "“The river’s edge was cold,” said André — and nobody answered.", "© 2020 Märkte & Co. Alle Rechte vorbehalten.", "Старая река осталась пустой после дождя.",
]


def _codec(text, written, read):
    table = {}
    for b in range(256):
        try:
            table[b] = bytes([b]).decode(read)
        except UnicodeDecodeError:
            table[b] = chr(b)
    return "".join(table[b] for b in text.encode(written))


@pytest.mark.parametrize("chain", [c for c in CHAINS if c[1] == "utf-8"])
def test_round_trip(chain):
    read, written, times = chain
    for text in CLEAN[:5]:
        bad = text
        for _ in range(times):
            bad = _codec(bad, written, read)
        out, at = [], 0
        for cell, a, b in cells(bad):
            got = undo_cell(cell, chain)
            out += [bad[at:a], got[0] if got else cell[1:-1]]
            at = b
        assert "".join(out) + bad[at:] == text, (chain, bad)


def test_no_chain_for_sound_text():
    assert undo("é", ("cp1252", "utf-8", 1)) is None and undo("лампа", ("cp1252", "utf-8", 1)) is None
    assert cells("") == [] and cells("plain") == [] and cells("é") == [("sés", 0, 1)]


def records(spark, rows):
    return spark.createDataFrame([("textnodes", u, i, t, "clash", 1) for u, i, t in rows], "field STRING, url STRING, node_id INT, text STRING, site STRING, share INT")


def test_operator(spark):
    rows, bad = [], {}
    for i in range(400):
        rows.append((f"http://s{i % 4}.example/{i}", i, CLEAN[i % 6]))
    for k, (read, written) in enumerate([("cp1252", "utf-8"), ("latin-1", "utf-8"), ("mac_roman", "utf-8"), ("cp437", "utf-8"), ("cp437", "cp1252")]):
        text = CLEAN[k]
        bad[1000 + k] = text
        rows.append((f"http://s{k % 4}.example/bad{k}", 1000 + k, _codec(text, written, read)))
    half = CLEAN[0] + "\n" + _codec(CLEAN[2], "utf-8", "cp1252")
    rows += [("http://s1.example/half", 2000, half), ("http://s1.example/lost", 2001, "La f�te"), ("http://s1.example/n", 2002, None), ("http://s1.example/e", 2003, ""), (None, 2004, "Ã©"), ("http://s1.example/half", 2000, half)]
    got = {r.node_id: r for r in garbled(records(spark, rows)).collect()}
    assert set(got) == set(bad) | {2000, 2001}
    assert all(got[i].restored == t for i, t in bad.items())
    assert got[2000].restored == CLEAN[0] + "\n" + CLEAN[2]
    assert not got[2001].restorable and got[2000].restorable
    assert garbled(records(spark, [])).count() == 0
    assert garbled(records(spark, [("http://a/", 1, "plain")])).count() == 0
    long = "\n".join(CLEAN * 3000)
    assert garbled(records(spark, [("http://a/", 1, long)])).count() == 0


def test_shares_of_the_site_decide_without_a_gain():
    text = _codec("é", "utf-8", "cp1252")
    state = next(i for i, c in enumerate(CHAINS, 1) if c == ("cp1252", "utf-8", 1))
    share = [1e-4] * STATES
    share[state], share[SOUND] = 0.9, 0.05
    # the cell is as likely sound, or a little likelier
    for loss in (0.0, 0.5):
        by = {SOUND: -3.0, state: -3.0 - loss}
        got = restore(text, lambda: share, lambda c, by=by: (by, []))
        assert got is not None and got[0] == state and got[2] == "é"
    even = [0.9, *[0.1 / (STATES - 1)] * (STATES - 1)]
    assert restore(text, lambda: even, lambda c: ({SOUND: -3.0, state: -3.5}, []), False) is None
    assert restore(text, lambda: even, lambda c: ({SOUND: -3.0, state: -3.5}, [])) is None
