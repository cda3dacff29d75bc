import pytest
from hypothesis import Phase, given, settings
from hypothesis import strategies as st

from pagesieve.llm.mixing import mix, source_key, token_counts
from pagesieve.llm.splitting import Limits, oversized, pieces, split_row

SMALL = Limits(nodes=12, tokens=60, overlap_nodes=3, overlap_tokens=5)


def check(nodes, tokens, urls, limits):
    got = split_row(nodes, tokens, urls, limits)
    real = [(n, [t for t in ts if t != 1]) for n, ts in zip(nodes, tokens, strict=True) if n]
    own: list = []
    for k, p in enumerate(got):
        assert len(p["node_ids"]) <= limits.nodes and sum(map(len, p["token_ids"])) <= limits.tokens
        r = p["repeated"]
        assert r < len(p["node_ids"])
        if k and r:
            before = got[k - 1]
            if p["node_ids"][r - 1] == p["node_ids"][r] and before["node_ids"][-1] == p["node_ids"][r]:
                assert r == 1 and before["token_ids"][-1][-len(p["token_ids"][0]) :] == p["token_ids"][0] and len(p["token_ids"][0]) <= limits.overlap_tokens
            else:
                assert r <= limits.overlap_nodes and before["node_ids"][-r:] == p["node_ids"][:r] and before["token_ids"][-r:] == p["token_ids"][:r]
        own += list(zip(p["node_ids"], p["token_ids"], strict=True))[r:]
    merged: list = []
    for n, t in own:
        if merged and merged[-1][0] == n and len(merged[-1][1]) < len(real[len(merged) - 1][1]):
            merged[-1] = (n, merged[-1][1] + t)
        else:
            merged.append((n, t))
    assert merged == real
    return got


@settings(max_examples=200, deadline=None, phases=[Phase.explicit, Phase.generate])
@given(st.lists(st.tuples(st.integers(0, 30), st.sampled_from(["a", "b", None])), max_size=60), st.randoms(use_true_random=False))
def test_any_row(entries, rng):
    nodes = [0 if rng.random() < 0.05 else 1000 - 3 * i - rng.randint(0, 2) for i in range(len(entries))]
    tokens = [[0, *(rng.randint(3, 9) for _ in range(n if rng.random() > 0.05 else n * 10)), 2, 1, 1] for n, _ in entries]
    check(nodes, tokens, [u for _, u in entries], SMALL)


def test_natural_boundaries():
    # two pages of eight nodes: the cut falls between them and nothing is repeated
    nodes = list(range(40, 24, -1))
    got = check(nodes, [[0, 5, 2]] * 16, ["a"] * 8 + ["b"] * 8, Limits(12, 1000, 3, 5))
    assert [len(p["node_ids"]) for p in got] == [8, 8] and [p["repeated"] for p in got] == [0, 0]
    # one page in two parts: the wide gap of ids is cut
    got = check([60, 59, 58, 57, 56, 55, 40, 39, 38, 37, 36], [[0, 5, 2]] * 11, ["a"] * 11, Limits(10, 1000, 3, 5))
    assert [p["node_ids"] for p in got] == [[60, 59, 58, 57, 56, 55], [57, 56, 55, 40, 39, 38, 37, 36]]
    # a node that is too long alone is cut at the sentence mark, and its last tokens are repeated
    got = check([9], [[0] + [7] * 50 + [4] + [7] * 48 + [4, 2]], ["a"], SMALL)
    assert got[0]["token_ids"][0][-1] == 4 and got[1]["token_ids"][0] == got[0]["token_ids"][0][-5:]


def test_pieces_table(spark):
    rows = [(1, [[0, 5, 2]] * 500, list(range(600, 100, -1)), ["u"] * 500, 1), (2, None, None, None, 1), (3, [], [], [], 1), (4, [[0, 2, 1], [1]], [5, 0], [None, "u"], 1), (5, [[0, 5, 2]] * 500, list(range(600, 100, -1)), ["u"] * 500, 1)]
    df = spark.createDataFrame(rows, "feature_id LONG, TokenId ARRAY<ARRAY<INT>>, NodeIds ARRAY<INT>, Url ARRAY<STRING>, piece INT")
    got = pieces(df)
    assert {r.feature_id for r in oversized(df).collect()} == {1, 5} and oversized(df.limit(0)).count() == 0
    assert {r.feature_id: r["count"] for r in got.groupBy("feature_id").count().collect()} == {1: 2, 4: 1, 5: 2}
    assert got.where("feature_id = 4").first().TokenId == [[0, 2]] and pieces(df.limit(0)).count() == 0


def brute_mix(counted, targets):
    import xxhash  # noqa: F401  # the hash itself is Spark's; only sums are compared

    total = sum(t for _, s, t in counted if s in targets) / 2
    return {s: share * total for s, (share, _) in targets.items()}


def test_mix(spark):
    counted = [(i, f"s{i % 3}", 50 + i % 7) for i in range(3000)] + [(5000 + i, "tiny", 40) for i in range(10)] + [(6000, None, 9), (6001, "other", 9)]
    targets = {"s0": (0.5, 1), "s1": (0.2, 1), "s2": (0.1, 3), "tiny": (0.15, 4), "none": (0.05, 2)}
    c = spark.createDataFrame(counted, "doc_id LONG, source STRING, tokens LONG")
    t = spark.createDataFrame([(k, a, b) for k, (a, b) in targets.items()] + [("nulls", None, None)], "source STRING, target_share DOUBLE, max_repeats INT")
    records, shares = mix(c, t)
    budgets = brute_mix(counted, targets)
    got = {r.source: r for r in shares.collect()}
    for s in ("s0", "s1", "s2"):
        assert abs(got[s].tokens - budgets[s]) <= 57 and not got[s].short
    assert got["tiny"].short and got["tiny"].tokens == 1600 and got["none"].tokens == 0 and got["none"].short
    rows = records.collect()
    assert len({r.doc_id for r in rows}) == len(rows) and all(r.repeats <= targets[r.source][1] for r in rows)
    assert {r.source for r in rows} == {"s0", "s1", "s2", "tiny"}
    again, _ = mix(c, t)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in rows}
    other, _ = mix(c, t, seed=1)
    assert {tuple(r) for r in other.collect()} != {tuple(r) for r in rows}
    none, empty = mix(c.limit(0), t)
    assert none.count() == 0 and {r.tokens for r in empty.collect()} == {0}


def test_epochs(spark):
    c = spark.createDataFrame([(i, "a", 10) for i in range(10)] + [(100 + i, "b", 10) for i in range(90)], "doc_id LONG, source STRING, tokens LONG")
    t = spark.createDataFrame([("a", 0.5, 4), ("b", 0.5, 1)], "source STRING, target_share DOUBLE, max_repeats INT")
    repeats = sorted(r.repeats for r in mix(c, t)[0].where("source = 'a'").collect())
    assert repeats == [2] * 5 + [3] * 5  # 250 tokens of 100: two whole epochs and half of a third


def test_tokens(spark):
    df = spark.createDataFrame([(1, " CC_News ", "the cat sat"), (2, "cc-news", None), (3, None, ""), (4, "x", "word " * 100_000)], "doc_id LONG, source STRING, text STRING")
    got = {r.doc_id: (r.source, r.tokens) for r in token_counts(df).collect()}
    assert got[1] == ("cc-news", 3) and got[3] == (None, 0) and 2 not in got and got[4][1] >= 100_000
    assert [r[0] for r in df.select(source_key(df.source)).collect()][:2] == ["cc-news", "cc-news"]


def test_operator_cuts_like_the_row(spark):
    import random

    rng = random.Random(3)
    rows = []
    for i in range(40):
        n = rng.randint(0, 60)
        tokens = [[0, *(rng.randint(3, 9) for _ in range(rng.choice((2, 5, 9, 80)))), 2, 1] for _ in range(n)]
        rows.append((i, tokens, [rng.choice((0, 1000 - 3 * k)) if rng.random() < 0.2 else 1000 - 3 * k for k in range(n)], [rng.choice(("a", "a", "a", "b", None)) for _ in range(n)]))
    df = spark.createDataFrame(rows, "feature_id LONG, TokenId ARRAY<ARRAY<INT>>, NodeIds ARRAY<INT>, Url ARRAY<STRING>")
    got = {(r.feature_id, r.piece): (r.NodeIds, r.TokenId, r.Url, r.repeated) for r in pieces(df, SMALL).collect()}
    want = {(i, k): (p["node_ids"], p["token_ids"], p["urls"], p["repeated"]) for i, t, n, u in rows for k, p in enumerate(split_row(n, t, u, SMALL))}
    assert got == want and {r.feature_id for r in oversized(df, SMALL).collect()} == {i for i, k in want if k == 1}


@pytest.mark.parametrize("name", ["p7_found", "p7_checked", "p9_mix_chars", "p9_shares_chars"])
def test_against_sql(spark, name):
    import duckdb

    from pagesieve.llm.queries import registry

    con = duckdb.connect()
    for t in ("page_features", "documents", "mix_targets"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    cur = con.execute(registry.sql[name])
    names = [d[0] for d in cur.description]
    df = registry.queries[name](spark, "/root/testdata/sf0.01")
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(map(str, r)) for r in df.select(*names).collect()) == sorted(tuple(map(str, r)) for r in cur.fetchall())
