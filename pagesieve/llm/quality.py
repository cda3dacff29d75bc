"""Text quality statistics of each page, and the pages that are no natural prose.

The statistics of a page (word count, mean word length, symbol ratio, share of lines ending in punctuation,
share of common words, share of characters in lines that end a sentence) become percentiles and robust z-scores against
mergeable quantile sketches kept per language, of one row for each distinct text of the reference population: pages half
of whose characters stand in lines that end a sentence. Junk at any share of the corpus, or copied however often,
therefore moves no statistic. Pages in the tails of the distribution, and the spam-ward outliers of the spam operator,
are flagged; only what is flagged can be found, and it is confirmed by its own text: more than half of its characters
are list, table or junk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesieve.llm.lines import Rule, own_text
from pagesieve.llm.pagestats import PROFILE_DDL, SHARES_DDL, profile_batches, share_batches
from pagesieve.llm.robust import one_a_text, robust_z, statistics
from pagesieve.llm.spam import IS_SPAM, SPAM_COLUMNS, SPAM_FLOOR, with_distance
from pagesieve.session import stage

COLUMNS = ("n_words", "mean_word", "symbol_ratio", "punct_lines", "common_share", "closed")
# The least spread of each figure, so that languages of even pages don't turn noise into tails.
FLOOR = {"n_words": 20.0, "mean_word": 0.3, "symbol_ratio": 0.01, "punct_lines": 0.1, "common_share": 0.05, "closed": 0.05}
TAIL_Z = 3.5
#: The reference population.
REFERENCE = "closed >= 0.5"
#: What confirms a flagged page.
NOT_NATURAL = "not_prose > 0.5"
IN_TAIL = f"z_closed <= -{TAIL_Z} OR z_symbol_ratio >= {TAIL_Z} OR z_common_share <= -{TAIL_Z} OR abs(z_mean_word) >= {TAIL_Z}"


def page_profiles(pages: DataFrame, lines_rule: Rule = Rule()) -> DataFrame:
    """(url, text_id, own text, language and profile of the own text) for each row with a url and a text, staged."""
    own = own_text(pages.select("url", "text").where("url IS NOT NULL AND text IS NOT NULL"), lines_rule)
    return stage(own.select("url", F.xxhash64("own").alias("text_id"), "own").mapInArrow(profile_batches, PROFILE_DDL), "profiles")


def flagged(profiles: DataFrame, quality: bool = True, ranks: bool = False) -> DataFrame:
    """profiles with z-scores, in_tail (where quality is wanted), distance, spamward and outlier, every row kept."""
    columns = (*COLUMNS, *(c for c in SPAM_COLUMNS if c not in COLUMNS)) if quality else tuple(SPAM_COLUMNS)
    numbers = profiles.drop("own")
    reference = stage(one_a_text(numbers.where(REFERENCE)), "reference")
    stats = statistics(reference, columns, FLOOR | SPAM_FLOOR)
    scored = with_distance(robust_z(profiles, stats, columns, ranks), robust_z(reference, stats, columns))
    return scored.withColumn("in_tail", F.expr(IN_TAIL)) if quality else scored


def _confirmed(rows: DataFrame, test: str) -> DataFrame:
    """(url) of flagged rows of (url, own) whose own text meets the test; each url once."""
    return rows.select("url", "own").mapInArrow(share_batches, SHARES_DDL).where(test).select("url").distinct()


def quality(profiles: DataFrame) -> DataFrame:
    """Every row of profiles without its text, with z-scores, percentiles, in_tail and outlier.

    Null urls or texts have no profile; an empty text has zero words; repeated rows repeat.
    """
    return flagged(profiles, ranks=True).drop("own")


def not_prose(pages: DataFrame, lines_rule: Rule = Rule()) -> DataFrame:
    """(url) of the pages that are no natural prose, the spam pages among them; each url once. An empty text, having no
    characters, is no case."""
    rows = flagged(page_profiles(pages, lines_rule))
    return _confirmed(rows.where("in_tail OR outlier"), f"{NOT_NATURAL} OR {IS_SPAM}")


def spam_pages(pages: DataFrame, lines_rule: Rule = Rule()) -> DataFrame:
    """(url) of the keyword-stuffed pages, link lists and product tags; each url once. Empty texts are no spam."""
    rows = flagged(page_profiles(pages, lines_rule), quality=False)
    return _confirmed(rows.where("outlier"), IS_SPAM)
