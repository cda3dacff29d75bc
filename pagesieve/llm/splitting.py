"""Splitting oversized feature rows at natural boundaries.

A row's nodes are the atoms; a node that alone exceeds the token limit is cut into even fragments, at the row's
sentence mark where one is near. Neighbouring segments are held in a heap by the strength of the boundary between
them, and the weakest boundaries are merged first while the merged segment and its overlap fit the limits: nodes of
one part of a page before parts, parts before pages. Rows are independent, so nothing is shuffled.

Python sees only ids, page hashes and token counts, with the tokens of those nodes alone that must be cut, and gives back
where each piece begins and ends; the pieces themselves are sliced out of the row where it is.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Padding and end tokens of the tokenizer.
PAD, END = 1, 2


@dataclass(frozen=True)
class Limits:
    nodes: int = 384
    tokens: int = 4096
    overlap_nodes: int = 16
    overlap_tokens: int = 64


@dataclass(slots=True)
class Atom:
    at: int  # place of the node in the row
    node: int
    page: int
    start: int  # tokens of the node from here
    size: int  # and so many
    part: int = 0  # number of the fragment in its node


def _pages(urls: list) -> list[int]:
    """Page number of each entry; an entry without a url belongs to the page before it, at the start to the one after."""
    known = [u for u in urls if u is not None]
    at, page, out = known[0] if known else None, 0, []
    for u in urls:
        if u is not None and u != at:
            at, page = u, page + 1
        out.append(page)
    return out


def _fragments(atom: Atom, tokens: list[int], mark: int | None, limits: Limits) -> list[Atom]:
    """Even fragments of a node that is too long alone, each with room for the repeated tokens of the one before."""
    room = limits.tokens - limits.overlap_tokens
    count = -(-len(tokens) // room)
    while True:
        size, cuts = -(-len(tokens) // count), [0]
        while len(tokens) - cuts[-1] > size:
            target = cuts[-1] + size
            slack = max(0, min(size // 8, room - size))
            near = [i + 1 for i in range(max(cuts[-1] + 1, target - size // 8), min(target + slack, len(tokens) - 1)) if tokens[i] == mark]
            cuts.append(min(near, key=lambda i: abs(i - target)) if near else target)
        cuts.append(len(tokens))
        if all(b - a <= room for a, b in zip(cuts, cuts[1:], strict=False)):
            return [Atom(atom.at, atom.node, atom.page, a, b - a, i) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        count += 1


def _overlap(atoms: list[Atom], start: int, limits: Limits) -> list[tuple[int, int, int]]:
    """What a piece that starts at an atom repeats, as (place, from, to): the last tokens of the fragment before when the
    cut is inside a node, else the last nodes of the page, as many as fit with the first atom of its own."""
    if start == 0 or atoms[start - 1].page != atoms[start].page:
        return []
    if atoms[start].part:
        a = atoms[start - 1]
        return [(a.at, a.start + max(0, a.size - limits.overlap_tokens), a.start + a.size)]
    out, left = [], limits.tokens - atoms[start].size
    for i in range(start - 1, max(-1, start - 1 - limits.overlap_nodes), -1):
        a = atoms[i]
        left -= a.size
        if a.page != atoms[start].page or left < 0 or len(out) + 1 >= limits.nodes:
            break
        out.append((a.at, a.start, a.start + a.size))
    return out[::-1]


def _strength(a: Atom, b: Atom) -> int:
    """Boundaries between pages are the strongest; then those with more tags closed between two nodes, by the gap of ids."""
    return 1 << 40 if a.page != b.page else 0 if b.part else abs(a.node - b.node)


def plan_row(ids: list[int], sizes: list[int], pages: list, ends: list[int | None], longs: list[list[int] | None], limits: Limits = Limits()) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Pieces of one row of real nodes, in order: (repeated entries at the start, entries (place, from, to)). pages has a hash of
    each node's url or null, ends the token before each node's end token, longs the tokens of nodes that are too long."""
    if len(ids) <= limits.nodes and sum(sizes) <= limits.tokens:
        return [(0, [(i, 0, n) for i, n in enumerate(sizes)])] if ids else []
    atoms = [Atom(i, node, page, 0, n) for i, (node, n, page) in enumerate(zip(ids, sizes, _pages(pages), strict=True))]
    known = Counter(e for e in ends if e is not None)
    mark = known.most_common(1)[0][0] if known else None
    atoms = [f for a in atoms for f in (_fragments(a, longs[a.at], mark, limits) if a.size > limits.tokens else [a])]
    repeated = [_overlap(atoms, i, limits) for i in range(len(atoms))]
    over = [(len({at for at, _, _ in r} - {atoms[i].at}), sum(b - a for _, a, b in r)) for i, r in enumerate(repeated)]
    # segment i starts at atom i and ends where ends_at says; the heap holds (strength, size, start of the left, its end, end of the right)
    ends_at = {i: i + 1 for i in range(len(atoms))}
    starts_at = {i + 1: i for i in range(len(atoms))}
    before = [0]
    for a in atoms:
        before.append(before[-1] + a.size)
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(start: int, middle: int, end: int) -> None:
        if end - start + over[start][0] <= limits.nodes and before[end] - before[start] + over[start][1] <= limits.tokens:
            heapq.heappush(heap, (_strength(atoms[middle - 1], atoms[middle]), before[end] - before[start], start, middle, end))

    for i in range(len(atoms) - 1):
        offer(i, i + 1, i + 2)
    while heap:
        _, _, start, middle, end = heapq.heappop(heap)
        if ends_at.get(start) != middle or ends_at.get(middle) != end:
            continue
        del ends_at[middle]
        ends_at[start], starts_at[end] = end, start
        del starts_at[middle]
        if start in starts_at:
            offer(starts_at[start], start, end)
        if end in ends_at:
            offer(start, end, ends_at[end])
    return [(len(repeated[i]), repeated[i] + [(a.at, a.start, a.start + a.size) for a in atoms[i : ends_at[i]]]) for i in sorted(ends_at)]


def split_row(node_ids: list[int | None], token_ids: list[list[int] | None], urls: list[str | None], limits: Limits = Limits()) -> list[dict]:
    """Pieces of one row, in order: node_ids, token_ids, urls and the number of repeated entries at their start."""
    real = [(n, [t for t in ts or () if t != PAD], u) for n, ts, u in zip(node_ids, token_ids, urls, strict=True) if n]
    ends = [t[-2] if len(t) > 2 and t[-1] == END else None for _, t, _ in real]
    plan = plan_row([n for n, *_ in real], [len(t) for _, t, _ in real], [u for *_, u in real], ends, [t for _, t, _ in real], limits)
    return [
        {"node_ids": [real[i][0] for i, _, _ in xs], "token_ids": [real[i][1][a:b] for i, a, b in xs], "urls": [real[i][2] for i, _, _ in xs], "repeated": r} for r, xs in plan
    ]


_ENTRY = pa.struct([("at", pa.int32()), ("start", pa.int32()), ("size", pa.int32())])
_PLAN = pa.list_(pa.struct([("repeated", pa.int32()), ("entries", pa.list_(_ENTRY))]))
_PLAN_DDL = "array<struct<repeated: int, entries: array<struct<at: int, start: int, size: int>>>>"


def planned(page_features: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(feature_id, ids, tokens, urls, plan): the real nodes of each row and its pieces. Null arrays are empty; a null id is padding."""

    @F.arrow_udf(_PLAN_DDL)
    def plan(ids: pa.Array, sizes: pa.Array, pages: pa.Array, ends: pa.Array, longs: pa.Array) -> pa.Array:
        rows = zip(*(x.to_pylist() for x in (ids, sizes, pages, ends, longs)), strict=True)
        return pa.array([[(r, [(i, a, b - a) for i, a, b in xs]) for r, xs in plan_row(*row, limits)] for row in rows], _PLAN)

    none = F.array().cast("array<int>")
    real = F.filter(F.arrays_zip("NodeIds", "TokenId", "Url"), lambda x: F.coalesce(x["NodeIds"], F.lit(0)) != 0)
    rows = page_features.select("feature_id", F.coalesce(real, F.array().cast("array<struct<NodeIds:int,TokenId:array<int>,Url:string>>")).alias("real"))
    rows = rows.select(
        "feature_id", F.transform("real", lambda x: x["NodeIds"]).alias("ids"), F.transform("real", lambda x: x["Url"]).alias("urls"),
        F.transform("real", lambda x: F.array_remove(F.coalesce(x["TokenId"], none), PAD)).alias("tokens"),
    )
    long = F.exists("tokens", lambda t: F.size(t) > limits.tokens)
    last = lambda t, i: F.try_element_at(t, F.lit(-i))
    end = lambda t: F.when((F.size(t) > 2) & (last(t, 1) == END), last(t, 2))
    made = plan(
        "ids", F.transform("tokens", F.size), F.transform("urls", lambda u: F.when(u.isNotNull(), F.xxhash64(u))),
        F.coalesce(F.when(long, F.transform("tokens", end)), none), F.transform("tokens", lambda t: F.when(F.size(t) > limits.tokens, t)),
    )
    return rows.withColumn("plan", made)


def pieces(page_features: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(feature_id, piece, TokenId, NodeIds, Url, repeated) of every row, without its padding.

    A row within the limits is one piece; rows that are empty or all padding have none; null Url entries stay null and
    belong to the page around them; null ids are padding; rows repeated under another id are split alike.
    """
    each = planned(page_features, limits).select("*", F.posexplode("plan").alias("piece", "p"))
    got = lambda f: F.transform("p.entries", f)
    pick = lambda c, x: F.get(F.col(c), x["at"])
    return each.select(
        "feature_id", "piece", got(lambda x: F.slice(pick("tokens", x), x["start"] + 1, x["size"])).alias("TokenId"), got(lambda x: pick("ids", x)).alias("NodeIds"),
        got(lambda x: pick("urls", x)).alias("Url"), F.col("p.repeated").alias("repeated"),
    )


def oversized(page_features: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(feature_id) of the rows that are cut: those of more than one piece. A row within the limits always ends as one, as its
    segments from the first node on can be merged in any order."""
    return planned(page_features, limits).where(F.size("plan") > 1).select("feature_id").distinct()
