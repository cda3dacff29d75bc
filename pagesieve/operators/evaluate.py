"""Page-level evaluation: does the predicted text hold the gold strings?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.session import without_nulls


def unescaped(text: Column) -> Column:
    """Gold text with its line feeds, tabs and carriage returns restored."""
    return F.replace(F.replace(F.replace(text, F.lit("#N#"), F.lit("\n")), F.lit("#TAB#"), F.lit("\t")), F.lit("#R#"), F.lit("\r"))


def gold_lists(gold: DataFrame) -> DataFrame:
    """(Url, positives, negatives): unescaped gold strings of each page. Rows with any null are dropped."""
    g = without_nulls(gold.select("Url", "TextNodeId", "Text", "JudgmentIsPrimary")).withColumn("Text", unescaped(F.col("Text")))
    return g.groupBy("Url").agg(
        F.sort_array(F.collect_list(F.when(F.col("JudgmentIsPrimary"), F.col("Text")))).alias("positives"),
        F.sort_array(F.collect_list(F.when(~F.col("JudgmentIsPrimary"), F.col("Text")))).alias("negatives"),
    )


def page_confusion(texts: DataFrame, gold: DataFrame) -> DataFrame:
    """(Url, tp, tn, fp, fn): gold strings found or not in the page's predicted text (Url, Text). A page without a text finds
    nothing; pages without gold do not count."""
    g = without_nulls(gold.select("Url", "TextNodeId", "Text", "JudgmentIsPrimary"))
    joined = g.withColumn("Text", unescaped(F.col("Text"))).join(texts.select("Url", F.col("Text").alias("_text")), "Url", "left")
    found = F.coalesce(F.contains(F.col("_text"), F.col("Text")), F.lit(False))
    yes = F.col("JudgmentIsPrimary")
    count = lambda c: F.sum(c.cast("long"))
    return joined.groupBy("Url").agg(
        count(yes & found).alias("tp"), count(~yes & ~found).alias("tn"), count(~yes & found).alias("fp"), count(yes & ~found).alias("fn")
    )


def metrics(confusion: DataFrame) -> DataFrame:
    """One row of sums with precision, recall, accuracy and fscore; a zero denominator gives null."""
    s = confusion.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "tn", "fp", "fn")))
    return s.select(
        "tp", "tn", "fp", "fn",
        F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("accuracy"),
        F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("fscore"),
    )
