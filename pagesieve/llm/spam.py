"""Keyword-stuffed pages, link lists and product tags.

Each page is a point of density, entropy, repetition, function-word and link-mark figures. Per language a robust
centre and scale come from quantile sketches, and a covariance from the pages within three robust deviations on
every axis, all of one row for each distinct text of the reference population, pages that look like prose, so that no
share of spam moves them. Pages far off by Mahalanobis distance in a spam-directed way are flagged. What is flagged
is confirmed by its own text: it is made for the most part of stuffed units or link lines.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesieve.llm.pagestats import LANGUAGES
from pagesieve.llm.robust import BACKING

#: The figures and the direction of spam on each.
SPAM_COLUMNS = {"density": 1.0, "entropy": -1.0, "repetition": 1.0, "common_share": -1.0, "marks": 1.0}
# The least spread of each figure.
SPAM_FLOOR = {"density": 0.02, "entropy": 0.02, "repetition": 0.05, "common_share": 0.05, "marks": 0.1}
#: The 0.999 quantile of chi square with five degrees of freedom.
CUT = 20.5
#: Added to the diagonal of a correlation matrix before it is inverted.
RIDGE = 0.1
#: What confirms a flagged page.
IS_SPAM = "spam > 0.5"


def _inverses(z: DataFrame, columns: list[str]) -> dict[str, list[float]]:
    """Inverse covariance of the pages near the centre by language: a few sums a language come to the driver, and the sums
    over all languages stand behind each."""
    near = F.lit(True)
    for c in columns:
        near &= F.abs(f"z_{c}") <= 3
    sums = [F.sum(F.col(f"z_{a}") * F.col(f"z_{b}")).alias(f"{a}_{b}") for i, a in enumerate(columns) for b in columns[i:]]
    got = {}
    for r in z.where(near).groupBy("language").agg(F.count(F.lit(1)).alias("n"), *sums).collect():
        got[r["language"]] = r["n"], np.array([[r[f"{a}_{b}"] if f"{a}_{b}" in r else r[f"{b}_{a}"] for b in columns] for a in columns])
    total = sum(n for n, _ in got.values())
    every = sum(m for _, m in got.values()) / total if total else np.eye(len(columns))
    out = {}
    for name in (*LANGUAGES, "xx"):
        n, m = got.get(name, (0, 0.0))
        out[name] = np.linalg.inv((m + BACKING * every) / (n + BACKING) + RIDGE * np.eye(len(columns))).ravel().tolist()
    return out


def with_distance(z: DataFrame, reference: DataFrame, direction: dict[str, float] = SPAM_COLUMNS) -> DataFrame:
    """z with distance (squared Mahalanobis), spamward and outlier; reference has the z-scores of the reference population."""
    columns = list(direction)
    inverse = _inverses(reference, columns)
    matrix = F.create_map(*(F.lit(x) for k, m in inverse.items() for x in (k, F.array(*map(F.lit, m)))))
    m = matrix[F.col("language")]
    zs = [F.col(f"z_{c}") for c in columns]
    d2 = sum((m[i * len(columns) + j] * zs[i] * zs[j] for i in range(len(columns)) for j in range(len(columns))), F.lit(0.0))
    ward = sum((F.lit(s) * F.col(f"z_{c}") for c, s in direction.items()), F.lit(0.0))
    out = z.withColumn("distance", d2).withColumn("spamward", ward)
    return out.withColumn("outlier", (F.col("distance") >= CUT) & (F.col("spamward") > 0))

