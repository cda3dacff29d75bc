"""Near-duplicates of labelled texts, given as sets of hashed word shingles.

Candidates come from SimHash tables, one for each quarter of a 64-bit SimHash with a key that widens with the number
of texts, and, as near-duplicates of 0.8 may differ in more bits than tables can be keyed by, from an exact index of
prefixes: under one order of all shingles, two sets with a Jaccard similarity of at least t share one of the first
n - ceil(t n) + 1 of each. Only labelled texts look for partners, and only among texts without a label, round by round
until nothing is added, so that the labels fill their connected components without all pairs of any group.
Tables and prefixes carry ids and numbers; the sets themselves are joined once a candidate pair.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.session import keyed_join, stage

SHINGLE = 5
SIMILARITY = 0.8
#: Bits in which two SimHashes of a table may differ before their texts are compared; the prefixes find what lies beyond.
HAMMING = 20
#: A similarity that is met exactly counts, whatever its float product.
_SLACK = 1e-9
_M, _S = np.uint64(0x9E3779B97F4A7C15), np.uint64(31)
_known: dict[str, int] = {}


def shingles(words: list[str], size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of words; of all words where they are fewer."""
    if len(_known) > 200_000:
        _known.clear()
    for w in set(words).difference(_known):
        _known[w] = xxhash.xxh64_intdigest(w)
    size = min(size, len(words))
    if not size:
        return np.zeros(0, np.int64)
    word, h = np.fromiter(map(_known.__getitem__, words), np.uint64, len(words)), np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        h = (h ^ word[i : i + len(h)]) * _M
        h ^= h >> _S
    h = np.sort(h.view(np.int64))
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def simhash(sorted_hashes: np.ndarray) -> int:
    """64-bit SimHash of an array of 64-bit hashes."""
    if not len(sorted_hashes):
        return 0
    bits = np.unpackbits(sorted_hashes.astype(np.uint64).view(np.uint8).reshape(-1, 8), axis=1)
    return int(np.packbits(bits.sum(0) * 2 > len(sorted_hashes)).view(np.int64)[0])


def first(sorted_hashes: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The first hashes, one of which every set of that similarity holds among its own first."""
    n = len(sorted_hashes)
    return sorted_hashes[: n - math.ceil(similarity * n - _SLACK) + 1] if n else sorted_hashes


def prefix(sorted_hashes: np.ndarray, similarity: float = SIMILARITY) -> list[int]:
    """first as a list."""
    return first(sorted_hashes, similarity).tolist()


def _entries(nodes: DataFrame, bits: int) -> DataFrame:
    """(id, sim, n, rare, key): each text under its prefix and in the four tables."""
    turned = lambda t: F.shiftleft("sim", 64 - 16 * t).bitwiseOR(F.shiftrightunsigned("sim", 16 * t)) if t else F.col("sim")
    tables = [F.struct(F.lit(False).alias("rare"), F.xxhash64(F.lit(t), turned(t).bitwiseAND(F.lit((1 << bits) - 1))).alias("key")) for t in range(4)]
    rare = F.transform("keys", lambda k: F.struct(F.lit(True).alias("rare"), k.alias("key")))
    return nodes.where("n > 0").select("id", "sim", "n", F.explode(F.concat(rare, F.array(*tables))).alias("e")).select("id", "sim", "n", "e.rare", "e.key")


def similar(a: Column, b: Column, similarity: float = SIMILARITY) -> Column:
    common = F.size(F.array_intersect(a, b))
    return common >= F.lit(similarity) * (F.size(a) + F.size(b) - common) - _SLACK


def reached(nodes: DataFrame, labelled: DataFrame, sets: Callable[[DataFrame, int], DataFrame], similarity: float = SIMILARITY) -> DataFrame:
    """(id, root) of the labelled ids and all that links lead to from them; root is the least labelled id it was first
    reached from.

    nodes has id, sim, n and keys (the prefix), one row a distinct text; sets gives (id, shingles) for a frame of ids and
    its bytes.
    """
    total = nodes.count()
    bits = min(48, max(16, math.ceil(math.log2(max(total, 1)))))
    done = stage(labelled.select("id", F.col("id").alias("root")), "reached")
    front, n = done, done.count()
    while n:
        mine = keyed_join(nodes, front, ["id"], n * 24, F.col("id"))
        mine = _entries(mine, bits).join(front, "id").select(F.col("id").alias("a"), "root", F.col("sim").alias("sim_a"), F.col("n").alias("n_a"), "rare", "key")
        mine = stage(mine, "front")
        others = nodes.join(done.select("id"), "id", "left_anti")
        both = keyed_join(_entries(others, bits), mine, ["key", "rare"], mine.count() * 48, F.col("id"))
        near = F.col("rare") | (F.bit_count(F.col("sim").bitwiseXOR(F.col("sim_a"))) <= HAMMING)
        sized = F.least("n", "n_a") >= F.lit(similarity) * F.greatest("n", "n_a") - _SLACK
        pairs = stage(both.where(near & sized).select("a", "id", "root").distinct(), "pairs")
        m = pairs.count()
        if not m:
            break
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("id")).distinct()
        texts = stage(sets(stage(ids, "ids"), m * 32), "sets")
        left = pairs.join(texts.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(texts, "id")
        front = stage(left.where(similar(F.col("x"), F.col("shingles"), similarity)).groupBy("id").agg(F.min("root").alias("root")), "found")
        n = front.count()
        done = stage(done.unionByName(front), "reached")
    return done
