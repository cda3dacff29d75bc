"""Page boilerplate apart from the main content.

Text nodes are numbered in pre-order with siblings from right to left, so the gap between the ids of two
neighbouring text nodes is the number of tags that close between them. A node's path is its site with the gaps
before and after it, which stands in for the root-to-leaf tag path where the table has no tags. Text length and
punctuation are summed per path, their ratios fused and smoothed along the page; the fused ratio, with how often
a text stands on other pages, the frequent texts around it, the model's picks and the node's shape, goes to a
linear model fitted on every judged node, and its threshold selects the content nodes.

Only numbers are shuffled: a node's text is reduced to hashes, lengths and flags where it is read. Long pages are
cut into blocks of BLOCK ids, so no page, however long, makes one large group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagesieve.functions.text import RAGGED, site_of
from pagesieve.session import keyed_join, stage

#: Ids of one page that are looked at together, and how far a node sees.
BLOCK, NEAR = 8192, 1024
#: Pages with judgments are dealt out to groups of about so many nodes, each of which fits a model for the mean of all groups.
GROUP = 65_536
#: Share of judgments beyond a bound that may say the contrary; about one in a hundred judgments is wrong.
CONTRARY = 0.011
#: Hashed features of the linear model, parts of one that weights are rounded to, and steps of the ratio that bounds are told by.
WIDTH, UNIT, STEPS = 1 << 19, 1 << 24, 1024
#: A text is frequent if it stands on this share of its site's pages, or of all pages, and on two pages at least.
ON_SITE, ANYWHERE = 0.03, 0.004

# One bit a task of the prediction table.
TASK_BITS = {"Primary": 1, "Heading": 2, "Title": 4, "Paragraph": 8, "Table": 16, "List": 32}

#: Runs of blanks and line feeds other than a single space.
RAGGED_LINES = RAGGED.replace("\\t", "\\t\\n")
#: A blank other than a space: the second branch of these without the run behind it.
RARE_BLANK = RAGGED_LINES[RAGGED_LINES.index("|") + 1 : RAGGED_LINES.index(")")]

NUMBERS = ("k", "length", "words", "ending", "first", "digits", "shape", "start", "titled", "punct", "letters")


def _class(c: Column) -> Column:
    """Class of a single character: sentence end or closing quote, pointer, letter, digit, other."""
    letter = F.lower(c) != F.upper(c)
    return F.when(c.isin(*".!?…”\"’"), 1).when(c.isin(":", "»", ">"), 2).when(letter, 3).when(c.between("0", "9"), 4).otherwise(0)


def _nodes(textnodes: DataFrame) -> DataFrame:
    text = F.btrim(F.coalesce(F.col("Text"), F.lit("")), F.lit("\r\n\t\xa0 "))
    low = F.lower(text)
    # most texts have no digits, and no blanks but single spaces
    undigited = F.when(low.rlike("[0-9]"), F.regexp_replace(low, "[0-9]+", "0")).otherwise(low)
    folded = F.when(F.contains(low, F.lit("  ")) | low.rlike(RARE_BLANK), F.regexp_replace(undigited, RAGGED_LINES, " ")).otherwise(undigited)
    shape = F.regexp_replace(F.regexp_replace(F.substring(text, 1, 40), "\\p{Lu}\\p{L}*", "A"), "\\p{Ll}+", "a")
    tail = F.lower(F.substring_index(F.col("Url"), "/", -2))
    path = F.regexp_replace(tail, "[^a-z0-9]+", "-")
    slug = F.substring(F.btrim(F.regexp_replace(F.substring(low, 1, 60), "[^a-z0-9]+", "-"), F.lit("-")), 1, 16)
    # a slug in the path starts there as the text does, or the text starts with other than letters a to z and digits
    start = F.substring(low, 1, 3)
    may = F.contains(tail, start) | start.rlike("[^a-z0-9]")
    titled = F.when((F.length(text) >= 8) & may, F.when(F.length(slug) >= 8, (F.instr(path, slug) > 0).cast("int")).otherwise(0)).otherwise(0)
    # numerals and signs with cases count as letters, but few texts have no other
    letters = F.when(text.rlike("\\p{L}"), 1).otherwise((low != F.upper(text)).cast("int"))
    return textnodes.where("Url IS NOT NULL AND TextNodeId IS NOT NULL").select(
        F.col("Url").alias("url"),
        F.col("TextNodeId").alias("id"),
        F.xxhash64(site_of(F.col("Url"))).alias("s"),
        F.col("Text").isNotNull().cast("int").alias("node"),
        F.xxhash64(folded).alias("k"),
        F.length(text).alias("length"),
        (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).alias("words"),
        _class(F.right(text, F.lit(1))).alias("ending"),
        F.xxhash64(F.substring(text, 1, 1)).alias("first"),
        (undigited != low).cast("int").alias("digits"),
        F.xxhash64(F.substring(shape, 1, 24)).alias("shape"),
        F.xxhash64(F.substring(shape, 1, 8)).alias("start"),
        titled.alias("titled"),
        F.regexp_count(text, F.lit("[.,;:!?…]")).alias("punct"),
        letters.alias("letters"),
        F.lit(0).alias("task"),
        F.lit(None).cast("int").alias("gold"),
    )


def _marks(df: DataFrame, task: Column, gold: Column) -> DataFrame:
    return df.where("Url IS NOT NULL AND TextNodeId IS NOT NULL").select(
        F.col("Url").alias("url"), F.col("TextNodeId").alias("id"), task.alias("task"), gold.alias("gold")
    )


def prepared(textnodes: DataFrame, predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """One row of numbers for each node of a page with its gaps, the model's tasks and the judgment, staged. A node stands in
    its own block, with core set, and in those that it is near to; judged tells the blocks that have judgments of their own.

    Repeated rows fall together; ids without a text node are dropped; a judgment and its contrary leave none.
    """
    bit = sum((F.when(F.col("Task") == t, b).otherwise(0) for t, b in TASK_BITS.items()), F.lit(0))
    marks = _marks(predictions, bit, F.lit(None).cast("int")).unionByName(_marks(gold, F.lit(0), F.col("JudgmentIsPrimary").cast("int")))
    rows = _nodes(textnodes).unionByName(marks, allowMissingColumns=True)
    at = lambda by: F.floor((F.col("id") + by) / BLOCK).cast("int")
    rows = rows.withColumn("block", F.explode(F.sequence(F.greatest(at(-NEAR), F.least(at(0), F.lit(0))), at(NEAR))))
    merged = rows.repartition("url", "block").groupBy("url", "block", "id").agg(
        *(F.max(c).alias(c) for c in ("s", "node", *NUMBERS)),
        F.bit_or("task").alias("task"),
        F.when(F.min("gold") == F.max("gold"), F.max("gold")).alias("gold"),
    )
    order = Window.partitionBy("url", "block").orderBy("id")
    gap = lambda x: F.when(x <= NEAR, F.least(x, F.lit(8))).otherwise(0)
    merged = merged.withColumn("core", (F.floor(F.col("id") / BLOCK) == F.col("block")).cast("int"))
    own = F.when((F.col("node") == 1) & (F.col("core") == 1), F.col("gold"))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = merged.where("node IS NOT NULL").select("*", F.lead("id").over(order).alias("next"), F.lag("id").over(order).alias("last"), F.max(own).over(whole).alias("told"))
    gaps = {"gap_before": gap(F.col("next") - F.col("id")), "gap_after": gap(F.col("id") - F.col("last")), "judged": F.col("told").isNotNull()}
    return stage(seen.withColumns(gaps).drop("next", "last", "told"), "nodes")


def with_counts(nodes: DataFrame) -> DataFrame:
    """nodes with the shares of pages that hold the text on its site and anywhere, whether it is frequent, the path's ratios, and
    for pages of several blocks their headline."""
    core, page = nodes.where("core = 1"), F.xxhash64("url")
    counted = stage(core.where("letters = 1").groupBy("k", "s").agg(F.countDistinct(page).alias("on_site")), "counted")
    sites = stage(core.groupBy("s").agg(F.countDistinct(page).alias("site_pages")), "sites")
    total = sites.agg(F.coalesce(F.sum("site_pages"), F.lit(0))).first()[0]
    # a page lies on one site, so the pages of a text on all sites are the sum over its sites
    anywhere = stage(counted.groupBy("k").agg(F.sum("on_site").alias("anywhere")).where("anywhere >= 2"), "anywhere")
    pages = counted.where("on_site >= 2")
    spread = F.xxhash64("url", "id")
    out = keyed_join(nodes, pages, ["k", "s"], pages.count() * 32, spread, "left")
    out = keyed_join(out, anywhere, ["k"], anywhere.count() * 24, spread, "left")
    out = keyed_join(out, sites, ["s"], sites.count() * 24, spread, "left")
    out = out.na.fill(1, ["on_site", "anywhere", "site_pages"])
    out = out.withColumn("site_share", F.col("on_site") / F.col("site_pages")).withColumn("any_share", F.col("anywhere") / F.lit(float(max(total, 1))))
    wide = ((F.col("on_site") >= 2) & (F.col("site_share") >= ON_SITE)) | ((F.col("anywhere") >= 2) & (F.col("any_share") >= ANYWHERE))
    out = out.withColumn("often", ((F.col("letters") == 1) & (F.col("length") > 1) & wide).cast("int"))
    # ratios of a path: text and punctuation a node, of texts that are not frequent
    own = lambda c: F.log1p(F.avg(F.when(F.col("often") == 0, F.col(c)).otherwise(0)))
    path = stage(out.where("core = 1").groupBy("s", "gap_before", "gap_after").agg(own("length").alias("text_ratio"), own("punct").alias("punct_ratio")), "paths")
    out = keyed_join(out, path, ["s", "gap_before", "gap_after"], path.count() * 48, spread, "left").na.fill(0.0, ["text_ratio", "punct_ratio"])
    long = stage(core.where("block > 0").select("url").distinct(), "long")
    n = long.count()
    if not n:
        return out.withColumn("head", F.lit(None).cast("int")).withColumn("head_score", F.lit(None).cast("double"))
    score = F.when(F.col("titled") == 1, 2.0 * (F.col("gap_before") + 3 * (1 - F.col("often")))).otherwise(0.0) + F.when((F.col("gap_before") >= 7) & (F.col("often") == 0), 0.5).otherwise(0.0)
    best = keyed_join(out.where("core = 1"), long, ["url"], n * 100, spread).groupBy("url").agg(F.max(F.struct(score.alias("v"), F.col("id"))).alias("best"))
    heads = stage(best.select("url", F.col("best.id").alias("head"), F.col("best.v").alias("head_score")), "heads")
    return keyed_join(out, heads, ["url"], n * 120, spread, "left")


_U = np.uint64
_P1, _P2, _P3, _P4 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0x27D4EB2F165667C5)


def _mix(n: int, *parts: np.ndarray) -> np.ndarray:
    h = np.full(len(parts[0]), n + 1, _U) * _P1
    for p in parts:
        h = (h ^ (p.astype(np.int64).view(_U) * _P2)) * _P3
        h ^= h >> _U(29)
    h = (h * _P4) >> _U(20)
    return (h & _U(WIDTH - 1)).astype(np.int32)


def _log(x: np.ndarray) -> np.ndarray:
    return np.log2(x + 1.0).astype(np.int64)


def _rarity(share: np.ndarray) -> np.ndarray:
    """How many times a share must be doubled to be the whole."""
    return np.floor(-np.log2(np.clip(share, 1e-12, 1.0)) + 1e-9).astype(np.int64)


class View:
    """What each node of some pages sees: the first and last node within NEAR ids of it on its page."""

    def __init__(self, ids: np.ndarray, page: np.ndarray) -> None:
        self.at = np.arange(len(ids))
        self.key = page * (1 << 33) - ids
        self.first = np.searchsorted(self.key, self.key - NEAR, "left")
        self.last = np.searchsorted(self.key, self.key + NEAR, "right") - 1

    def shift(self, x: np.ndarray, by: int, fill: float = -1) -> np.ndarray:
        """x of the node `by` places earlier (by > 0) or later, fill where none is near."""
        there = self.at - by
        ok = (there >= self.first) & (there <= self.last)
        return np.where(ok, x[np.where(ok, there, 0)], np.array(fill, x.dtype)) if len(x) else x

    def before(self, mark: np.ndarray) -> np.ndarray:
        """Index of the last marked node before each, -1 where none is near."""
        if not len(mark):
            return self.at
        run = np.concatenate([[-1], np.maximum.accumulate(np.where(mark, self.at, -1))[:-1]])
        return np.where(run >= self.first, run, -1)

    def after(self, mark: np.ndarray) -> np.ndarray:
        if not len(mark):
            return self.at
        n = len(mark)
        run = (n - 1 - np.maximum.accumulate(np.where(mark[::-1], self.at, -1)))[::-1]
        run = np.concatenate([run[1:], [n]])
        return np.where(run <= self.last, run, -1)


def _heads(t: dict[str, np.ndarray], page: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id of each node's headline, whether its page has none): a text that stands in the url, after the widest gap; else the
    first rare text after a wide gap. Pages of several blocks bring theirs along."""
    score = np.where(t["titled"] == 1, t["gap_before"] + 3 * (1 - t["often"]), 0) * 2.0 + np.where((t["gap_before"] >= 7) & (t["often"] == 0), 0.5, 0.0)
    best = np.full(int(page[-1]) + 1, -1, np.int64)
    order = np.lexsort((-at, score, page))
    best[page[order]] = order  # the last of a page has its highest score, the earliest of equals
    head = best[page]
    known = ~np.isnan(t["head"])
    ids = np.where(known, np.nan_to_num(t["head"]), t["id"][head]).astype(np.int64)
    return ids, np.where(known, np.nan_to_num(t["head_score"]), score[head]) <= 0


def features(t: dict[str, np.ndarray], page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashed features, smoothed path ratio) of the nodes of whole pages, or blocks of pages, in document order."""
    n = len(page)
    if not n:
        return np.empty((0, 0), np.int32), np.empty(0)
    see = View(t["id"], page)
    at = see.at
    length, words, ending = _log(t["length"]), np.minimum(t["words"], 12), t["ending"]
    before, after, k, task, often = t["gap_before"], t["gap_after"], t["k"], t["task"], t["often"]
    site_log, any_log = _rarity(t["site_share"]), _rarity(t["any_share"])
    share = (10 * t["site_share"]).astype(np.int64)
    # a frequent text is none of the page's own
    fused = np.where(often == 1, 0.0, t["text_ratio"] * t["punct_ratio"] + 0.5 * np.log1p(t["length"]))
    smooth = (see.shift(fused, 1, 0.0) + 2 * fused + see.shift(fused, -1, 0.0)) / 4

    head, headless = _heads(t, page, at)
    place = np.where(headless, 3, np.sign(head - t["id"]) + 1)
    head_at = np.clip(np.searchsorted(see.key, page * (1 << 33) - head), 0, n - 1)
    close = (np.abs(head - t["id"]) <= NEAR) & (t["id"][head_at] == head) & (page[head_at] == page)
    from_head = np.where(headless, 9, np.clip(np.where(close, at - head_at, 9 * np.sign(head - t["id"])), -3, 6))

    prev, nxt, prev_open = see.before(often == 1), see.after(often == 1), np.where(before >= 4, at, see.before(before >= 4))
    prev_k, prev_far = np.where(prev >= 0, k[prev], 0), np.where(prev >= 0, np.minimum(at - prev, 4), 9)
    next_k, next_far = np.where(nxt >= 0, k[nxt], 0), np.where(nxt >= 0, np.minimum(nxt - at, 4), 9)
    open_k = np.where(prev_open >= 0, k[prev_open], 0)
    primary = task & 1
    near = sum((see.shift(primary, d, 0) for d in (-3, -2, -1, 1, 2, 3)), np.zeros(n, np.int64))
    own_k = np.where(often == 1, k, 0)
    to_end = np.minimum(see.last - at, 5)
    even = (2 * smooth).astype(np.int64)

    sets = [
        (length, ending), (place,), (place, before), (before, after), (often,), (site_log,), (any_log,), (site_log, length), (share,),
        (primary,), (task,), (near,), (primary, near), (place, primary, near // 2), (prev_k,), (prev_k, prev_far), (prev_k, before, often),
        (next_k,), (next_k, next_far), (even,), (place, even // 2), (t["shape"],), (place, t["start"]), (open_k,), (open_k, place, often),
        (before, length, ending), (to_end,), (t["digits"], length), (place, often, length), (from_head,), (words,), (t["first"],),
        (open_k, prev_k, often), (own_k,), (own_k, place),
        (see.shift(length, 1), see.shift(often, 1), place), (see.shift(length, -1), see.shift(often, -1), place),
    ]
    return np.stack([_mix(i, *s) for i, s in enumerate(sets)], 1), smooth


_COLUMNS = (
    "id", "node", "gold", "length", "words", "ending", "first", "digits", "shape", "start", "titled", "letters", "k", "task",
    "gap_before", "gap_after", "site_share", "any_share", "often", "text_ratio", "punct_ratio", "core", "head", "head_score",
)
_FLOATS = ("site_share", "any_share", "text_ratio", "punct_ratio", "head", "head_score")


def _numbered(t: pa.Table) -> np.ndarray:
    """The number of the page (or page block) of each row of a sorted table."""
    url, block = t["url"].combine_chunks().dictionary_encode(), t["block"].to_numpy()
    key = url.indices.to_numpy() * (int(block.max()) + 1 if len(block) else 1) + block
    return np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]) if len(key) else key


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole pages (or page blocks) of a sorted partition, some thousand nodes at a time, with their page numbers."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        t = pa.Table.from_batches(held)
        page = _numbered(t)
        cut = int(np.searchsorted(page, page[-1], "left"))
        if cut:
            yield t.slice(0, cut), page[:cut]
            held = t.slice(cut).combine_chunks().to_batches()
    if held:
        t = pa.Table.from_batches(held)
        yield t, _numbered(t)


def _arrays(t: pa.Table) -> dict[str, np.ndarray]:
    return {c: (t[c].fill_null(-1) if c == "gold" else t[c]).to_numpy().astype(np.float64 if c in _FLOATS else np.int64) for c in _COLUMNS}


def _sorted(nodes: DataFrame) -> DataFrame:
    return nodes.select("url", "block", *_COLUMNS).repartition("url", "block").sortWithinPartitions("url", "block", F.desc("id"))


def _train(x: np.ndarray, y: np.ndarray, rounds: int = 4, step: float = 0.1, decay: float = 1e-5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, weight, rows that have it) of a logistic model by adaptive gradient steps over a fixed order of the rows."""
    used, at, n = np.unique(x.ravel(), return_inverse=True, return_counts=True)
    at, rng = at.reshape(x.shape), np.random.default_rng(0)
    w, g2 = np.zeros(len(used)), np.full(len(used), 1e-6)
    size = min(max(len(x) // 128, 16), 512)
    for _ in range(rounds):
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // size)):
            f = at[rows]
            g = 1 / (1 + np.exp(-w[f].sum(1))) - y[rows]
            s = np.bincount(f.ravel(), np.repeat(g, x.shape[1]), len(used)) + decay * len(rows) * w
            g2 += s * s
            w -= step * s / np.sqrt(g2)
    return used, w, n


@dataclass
class Fitted:
    """Bounds on the fused ratio, and the weights of the model between them (none without judgments)."""

    low: float
    high: float
    weights: np.ndarray | None = None


def _steps(ratio: np.ndarray) -> np.ndarray:
    return np.rint(ratio * STEPS).astype(np.int64)


def _bounds(ratio: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> tuple[float, float]:
    """The widest bounds beyond which hardly a judgment says the contrary; of n judgments of each ratio, y name a body.
    Judgments of one ratio count together, as a bound can't part them."""
    n = np.ones(len(ratio), np.int64) if n is None else n
    order = np.argsort(ratio, kind="stable")
    r, body, n = ratio[order], y[order], n[order]

    def widest(r: np.ndarray, contrary: np.ndarray, n: np.ndarray, none: float) -> float:
        seen = np.cumsum(n)
        ok = np.flatnonzero((np.cumsum(contrary) <= CONTRARY * seen) & (seen > 100) & np.append(r[1:] != r[:-1], True)) if len(r) else r
        return float(r[ok[-1]]) if len(ok) else none

    low, high = widest(r, body, n, -np.inf), widest(r[::-1], (n - body)[::-1], n[::-1], np.inf)
    return min(low, high), high


_COUNTED = "feature BOOLEAN, at INT, v BIGINT, n BIGINT"


def _fit_group(t: pa.Table) -> pa.Table:
    """The weights of one group's model, each times the nodes that have its feature, and the group's judgments by ratio."""
    t = t.sort_by([("url", "ascending"), ("block", "ascending"), ("id", "descending")])
    a = _arrays(t)
    x, smooth = features(a, _numbered(t))
    ok = np.flatnonzero((a["gold"] >= 0) & (a["node"] == 1) & (a["core"] == 1))
    # the same order however the pages are cut into blocks
    ok = ok[np.lexsort((a["id"][ok], t["url"].combine_chunks().dictionary_encode().indices.to_numpy()[ok]))]
    y = a["gold"][ok]
    used, w, n = _train(x[ok], y.astype(float))
    ratio, at, judged = np.unique(_steps(smooth[ok]), return_inverse=True, return_counts=True)
    body = np.bincount(at, y, len(ratio)).astype(np.int64)
    cols = [np.arange(len(used) + len(ratio)) < len(used), np.concatenate([used, ratio]).astype(np.int32), np.concatenate([np.rint(w * UNIT).astype(np.int64) * n, body]), np.concatenate([n, judged])]
    return pa.table([pa.array(c) for c in cols], [c.split()[0] for c in _COUNTED.split(", ")])


def fit(nodes: DataFrame, judged: int) -> Fitted:
    """Bounds and weights fitted on every judged node. The blocks of pages with judgments, which hold so many nodes, are dealt
    out by hashes to groups of bounded size; a weight is its mean over the nodes that have its feature, and a bound is told
    by the counts of all judgments. Sums are of whole numbers, so their order does not matter. Without judgments the mean
    ratio of all nodes is the one bound."""
    if not judged:
        fused = F.when(F.col("often") == 1, 0.0).otherwise(F.col("text_ratio") * F.col("punct_ratio") + 0.5 * F.log1p("length"))
        mean = nodes.where("core = 1").agg(F.coalesce(F.avg(fused), F.lit(0.0))).first()[0]
        return Fitted(mean, mean)
    rows = nodes.where("judged").select("url", "block", *_COLUMNS, F.pmod(F.xxhash64("url", "block"), F.lit(-(-judged // GROUP))).alias("part"))
    counted = rows.groupBy("part").applyInArrow(_fit_group, _COUNTED)
    # as many rows at most as there are features and steps of the ratio
    total = counted.groupBy("feature", "at").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).toArrow()
    feature, at, v, n = (total[c].to_numpy() for c in ("feature", "at", "v", "n"))
    weights = np.zeros(WIDTH, np.float32)
    weights[at[feature]] = v[feature] / n[feature] / UNIT
    return Fitted(*_bounds(at[~feature] / STEPS, v[~feature], n[~feature]), weights)


def scored_nodes(textnodes: DataFrame, predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """(url, node_id, ratio, by_ratio, score, is_body) of every text node with a text, each node once; by_ratio says whether the
    bounds on the ratio decided, else the score did.

    Null urls, ids and texts have no row; blank texts are nodes of length zero; without judgments the smoothed
    path ratio alone decides, against its mean over all nodes.
    """
    seen = prepared(textnodes, predictions, gold)
    nodes = with_counts(seen)
    fitted = nodes.sparkSession.sparkContext.broadcast(fit(nodes, seen.where("judged").count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = fitted.value
        for t, page in _pages(batches):
            a = _arrays(t)
            x, smooth = features(a, page)
            score = f.weights[x].sum(1).astype(np.float64) if f.weights is not None else smooth - f.high
            told = _steps(smooth) / STEPS if f.weights is not None else smooth
            decided = (told <= f.low) | (told >= f.high)
            body = np.where(decided, told >= f.high, score > 0)
            ok = (a["node"] == 1) & (a["core"] == 1)
            cols = (pa.array(a["id"][ok].astype(np.int32)), pa.array(smooth[ok]), pa.array(decided[ok]), pa.array(score[ok]), pa.array(body[ok]))
            yield pa.record_batch([t["url"].combine_chunks().filter(pa.array(ok)), *cols], ["url", "node_id", "ratio", "by_ratio", "score", "is_body"])

    return _sorted(nodes).mapInArrow(run, "url STRING, node_id INT, ratio DOUBLE, by_ratio BOOLEAN, score DOUBLE, is_body BOOLEAN")


def page_bodies(textnodes: DataFrame, predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """(url, text): each page's content nodes in document order, joined by line feeds."""
    body = scored_nodes(textnodes, predictions, gold).where("is_body").select("url", "node_id", F.lit(True).alias("is_body"))
    texts = textnodes.where("Url IS NOT NULL AND Text IS NOT NULL").select(F.col("Url").alias("url"), F.col("TextNodeId").alias("node_id"), F.col("Text").alias("text"))
    # texts and verdicts meet by page in one shuffle, which also serves the page's own aggregate
    both = texts.unionByName(body, allowMissingColumns=True).repartition("url")
    kept = both.groupBy("url", "node_id").agg(F.max("text").alias("text"), F.max("is_body").alias("is_body")).where("is_body AND text IS NOT NULL")
    ordered = F.sort_array(F.collect_list(F.struct("node_id", "text")), asc=False)
    return kept.groupBy("url").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))
