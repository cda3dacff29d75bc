"""Scores of nodes to sets of predicted nodes by task and threshold."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tasks in the order of the scores, the swept thresholds, and the one of each task that is saved.
TASKS = ("Primary", "Heading", "Title", "Paragraph", "Table", "List")
THRESHOLDS = (0.1, 0.25, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
SAVED = {"Primary": 0.9, "Heading": 0.25, "Title": 0.25, "Paragraph": 0.1, "Table": 0.1, "List": 0.1}

#: Token ids of a chunk's nodes to six scores a node. A chunk is scored by itself, whatever else is in its batch.
Scorer = Callable[[list[list[int]]], np.ndarray]
#: Nodes that a chunk may have.
CHUNK = 384


def hashed_score(seed: Column, task: int) -> Column:
    """A stand-in score that SQL can repeat: hundredths from an integer seed."""
    return (F.pmod(seed * (task + 7) + task * 13, F.lit(100)) / 100).cast("float")


def scored(rows: DataFrame, scorer: Scorer) -> DataFrame:
    """(Url, NodeId, scores) of rows with Url, NodeIds and TokenId: the scorer gets the nodes of one row, cut into chunks of CHUNK
    nodes where there are more, and gives six scores a node. Rows, and so pages and chunks, never see each other.

    The scorer is loaded once in each Python worker. Null rows have no nodes; missing tokens are padding.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat_url, flat_id, parts = [], [], []
            for urls, ids, tokens in zip(*(batch.column(c).to_pylist() for c in ("Url", "NodeIds", "TokenId")), strict=True):
                ids = ids or []
                tokens = [t or [] for t in (tokens or [])][: len(ids)]
                tokens += [[]] * (len(ids) - len(tokens))
                for at in range(0, len(ids), CHUNK):
                    parts.append(np.asarray(scorer(tokens[at : at + CHUNK]), np.float32))
                flat_id += ids
                flat_url += [(urls or [None])[min(i, len(urls or [None]) - 1)] for i in range(len(ids))]
            scores = [r for p in parts for r in p.tolist()]
            yield pa.record_batch([pa.array(flat_url, pa.string()), pa.array(flat_id, pa.int32()), pa.array(scores, pa.list_(pa.float32()))], ["Url", "NodeId", "scores"])

    return rows.select("Url", "NodeIds", "TokenId").mapInArrow(run, "Url STRING, NodeId INT, scores ARRAY<FLOAT>")


def infer(rows: DataFrame, scorer: Scorer, tasks: tuple[str, ...] = ("Primary",)) -> DataFrame:
    """(Url, TextNodeId, Task) of feature rows: scores, each task's own threshold, and every node of a page once over all of its
    chunks. Entries without a url are left out."""
    got = scored(rows, scorer).where("Url IS NOT NULL").select(F.col("Url").alias("url"), F.col("NodeId").alias("node_id"), "scores")
    return saved(exploded(got), tasks)


def exploded(scores: DataFrame) -> DataFrame:
    """(url, node_id, task, score) from (url, node_id, scores)."""
    named = F.arrays_zip(F.array(*map(F.lit, TASKS)).alias("task"), F.col("scores").alias("score"))
    return scores.select("url", "node_id", F.explode(named).alias("x")).select("url", "node_id", "x.task", "x.score")


def passing(scores: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """(url, node_id, task, threshold) of each score strictly over a threshold, compared as 32-bit floats; node 0, which is
    also the padding, never passes. The handful of thresholds is exploded in place, without a join."""
    kept = scores.where("node_id <> 0 AND score IS NOT NULL").withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    return kept.where(F.col("score").cast("float") > F.col("threshold").cast("float")).select("url", "node_id", "task", "threshold")


def sweep(scores: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """(task, threshold, url, node_ids): the set of nodes of a page, over all of its chunks, at each threshold.

    A page's scores are gathered once for each task and every threshold cuts the same array, so the shuffle carries one
    row a score and not one for each threshold it passes.
    """
    lowest = F.lit(min(thresholds)).cast("float")
    kept = scores.where("node_id <> 0 AND score IS NOT NULL").withColumn("score", F.col("score").cast("float")).where(F.col("score") > lowest)
    pages = kept.groupBy("task", "url").agg(F.collect_set(F.struct("node_id", "score")).alias("xs"))
    cut = pages.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    over = F.filter("xs", lambda x: x["score"] > F.col("threshold").cast("float"))
    ids = F.sort_array(F.array_distinct(F.transform(over, lambda x: x["node_id"])))
    return cut.select("task", "threshold", "url", ids.alias("node_ids")).where(F.size("node_ids") > 0)


def saved(scores: DataFrame, tasks: tuple[str, ...] = ("Primary",)) -> DataFrame:
    """(Url, TextNodeId, Task) of the predictions that are written: each task at its own threshold."""
    over = F.lit(False)
    for t in tasks:
        over |= (F.col("task") == t) & (F.col("score").cast("float") > F.lit(SAVED[t]).cast("float"))
    kept = scores.where("node_id <> 0").where(over)
    return kept.select(F.col("url").alias("Url"), F.col("node_id").alias("TextNodeId"), F.col("task").alias("Task")).distinct()


def numpy_scorer(weights: dict[str, np.ndarray], width: int = 5, heads: int = 8) -> Scorer:
    """The forward pass of the node scorer over given weights, for the nodes of one chunk: mean token embedding, linear,
    positions from the chunk's start, attention among the chunk's nodes alone, linear, sigmoid. weights has embed, in_w, in_b, pos, layers.<i>.(q|k|v|o)_(w|b), (norm1|norm2)_(w|b), ff1_(w|b), ff2_(w|b), out_w, out_b."""

    def norm(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + 1e-12) * w + b

    def run(tokens: list[list[int]]) -> np.ndarray:
        ids = np.array([([*t[: width - 1], 2] + [1] * width)[:width] for t in tokens])
        on = (ids != 1)[..., None]
        x = (weights["embed"][ids] * on).sum(1) / np.maximum(on.sum(1), 1)
        x = x @ weights["in_w"] + weights["in_b"]
        x = x + weights["pos"][: len(x)]
        i = 0
        while f"layers.{i}.q_w" in weights:
            g = lambda n, i=i: weights[f"layers.{i}.{n}"]
            q, k, v = (np.split(x @ g(f"{c}_w") + g(f"{c}_b"), heads, -1) for c in "qkv")
            att = []
            for a, b, c in zip(q, k, v, strict=True):
                s = a @ b.T / np.sqrt(a.shape[-1])
                s = np.exp(s - s.max(-1, keepdims=True))
                att.append(s / s.sum(-1, keepdims=True) @ c)
            x = norm(x + np.concatenate(att, -1) @ g("o_w") + g("o_b"), g("norm1_w"), g("norm1_b"))
            h = x @ g("ff1_w") + g("ff1_b")
            h = 0.5 * h * (1 + np.tanh(np.sqrt(2 / np.pi) * (h + 0.044715 * h**3)))
            x = norm(x + h @ g("ff2_w") + g("ff2_b"), g("norm2_w"), g("norm2_b"))
            i += 1
        return 1 / (1 + np.exp(-(x @ weights["out_w"] + weights["out_b"])))

    return run


def small_weights(vocabulary: int = 1000, size: int = 8, seed: int = 0) -> dict[str, np.ndarray]:
    """A small fixed weight set, in place of a trained one: embeddings, positions, one layer and the output."""
    rng = np.random.default_rng(seed)
    make = lambda *shape: rng.normal(0, 0.5, shape)
    w = {"embed": make(vocabulary, size), "in_w": make(size, size), "in_b": make(size), "pos": make(CHUNK, size), "out_w": make(size, 6), "out_b": make(6)}
    for n in ("q", "k", "v", "o"):
        w |= {f"layers.0.{n}_w": make(size, size), f"layers.0.{n}_b": make(size)}
    for n in ("norm1", "norm2"):
        w |= {f"layers.0.{n}_w": np.ones(size), f"layers.0.{n}_b": np.zeros(size)}
    return w | {"layers.0.ff1_w": make(size, 2 * size), "layers.0.ff1_b": make(2 * size), "layers.0.ff2_w": make(2 * size, size), "layers.0.ff2_b": make(size)}


def load_weights(path: str) -> dict[str, np.ndarray]:
    """Weights of an .npz file by the names of numpy_scorer."""
    with np.load(path) as f:
        return {k: f[k] for k in f.files}
