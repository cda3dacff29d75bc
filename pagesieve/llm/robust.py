"""Robust location and scale per language from mergeable quantile sketches, with all languages behind each."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesieve.llm.pagestats import LANGUAGES

#: Size parameter of the sketches: rank error about 0.4 %, and a bound on their bytes.
SKETCH_K = 800
#: The figures over all languages count like so many pages of each language, so that a language of few pages leans on them
#: and one of many stands for itself, without a step between the two.
BACKING = 50
#: Percentiles are read in steps of 1 / STEPS.
STEPS = 50


def one_a_text(figures: DataFrame) -> DataFrame:
    """One row of figures for each text_id: a text counts once for its language however often its page was loaded."""
    return figures.dropDuplicates(["text_id"])


def statistics(figures: DataFrame, columns: tuple[str, ...], floor: dict[str, float]) -> DataFrame:
    """(language, and for each column its median m_, robust deviation d_ and quantiles s_) for every language of the fixed list
    and for texts without one. Sketches are merged per language and over all; a handful of numbers a language comes to
    the driver. Without any figures the median is 0 and the deviation the floor."""
    per = figures.groupBy("language").agg(F.count(F.lit(1)).alias("n"), *(F.kll_sketch_agg_double(c, SKETCH_K).alias(c) for c in columns))
    pooled = per.agg(F.sum("n").alias("n"), *(F.kll_merge_agg_double(c, SKETCH_K).alias(c) for c in columns)).where("n > 0")
    at = F.array(*(F.lit(p / (2 * STEPS)) for p in range(1, 2 * STEPS)))
    both = per.unionByName(pooled.select(F.lit("*").alias("language"), "n", *columns))
    got = {r["language"]: r for r in both.select("language", "n", *(F.kll_sketch_get_quantile_double(c, at).alias(c) for c in columns)).collect()}
    rows = []
    for name in (*LANGUAGES, "xx"):
        row: list = [name]
        for c in columns:
            if "*" not in got:
                row += [0.0, floor[c], []]
                continue
            every, own = np.array(got["*"][c]), got.get(name)
            n = own["n"] if own else 0
            q = (n * np.array(own[c]) + BACKING * every) / (n + BACKING) if own else every
            low, middle, high = q[STEPS // 2 - 1], q[STEPS - 1], q[STEPS + STEPS // 2 - 1]
            row += [float(middle), max(float(high - low) / 1.349, floor[c]), q[1::2].tolist()]
        rows.append(row)
    ddl = "language STRING, " + ", ".join(f"m_{c} DOUBLE, d_{c} DOUBLE, s_{c} ARRAY<DOUBLE>" for c in columns)
    return figures.sparkSession.createDataFrame(rows, ddl)


def _at_most(column: str):
    return lambda quantile: quantile <= F.col(column)


def robust_z(figures: DataFrame, stats: DataFrame, columns: tuple[str, ...], ranks: bool = False) -> DataFrame:
    """figures with z_<column>, the distance from the language's median in robust deviations, and where ranks are wanted
    rank_<column>, the share of the language's texts at or below the value. One row of stats a language of a fixed list is broadcast."""
    wanted = [f"{k}_{c}" for c in columns for k in ("mds" if ranks else "md")]
    joined = figures.join(F.broadcast(stats.select("language", *wanted)), "language", "left")
    z = [((F.col(c) - F.col(f"m_{c}")) / F.col(f"d_{c}")).alias(f"z_{c}") for c in columns]
    rank = [(F.size(F.filter(f"s_{c}", _at_most(c))) / STEPS).alias(f"rank_{c}") for c in columns] if ranks else []
    return joined.select(*figures.columns, *z, *rank)
