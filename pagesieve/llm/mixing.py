"""Mixing sources to target weights.

Every document gets a key by a hash of its id and the seed. Documents are range-partitioned by source and key, the
token counts of each partition are summed, and the sums of the partitions before it give each document its place in
its source's running total: a distributed prefix sum, in which a source of any size is spread over as many tasks as
its rows need. A source is then cut at its exact budget, after as many whole epochs as the budget holds.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagesieve.session import broadcast_if_small, stage

#: The vocabulary file, which every node must have at this path.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Documents of a part, whose running total one task makes.
PART_ROWS = 100_000
# Fixed value: the public word pattern of byte-level BPE vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def source_key(source: Column) -> Column:
    """The spelling-free name of a source: lower case, trimmed, underscores and blanks as hyphens."""
    return F.regexp_replace(F.lower(F.trim(source)), "[_\\s]+", "-")


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens) of the documents with a text; source in its spelling-free form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), batch.column("source"), pa.array(n, pa.int64())], ["doc_id", "source", "tokens"])

    picked = documents.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), source_key(F.col("source")).alias("source"), "text")
    return picked.mapInArrow(run, "doc_id BIGINT, source STRING, tokens BIGINT")


def mix(counted: DataFrame, targets: DataFrame, total_share: float = 0.5, seed: int = 0, key: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, shares) of a mix from (doc_id, source, tokens) and (source, target_share, max_repeats).

    records has doc_id, source, tokens and repeats, how often the document stands in the mix; shares has for each
    target its budget, the tokens reached, the share of the total and of the mix, and whether its documents fell
    short. The total is total_share of the tokens of all documents whose source has a target. Documents without a
    source or a target are left out; the key is a hash of doc_id and seed unless one is given, and its ties go by doc_id; targets repeated after folding their names are
    summed; null or negative shares and repeats count as zero; sources without documents reach nothing.
    """
    goal = targets.groupBy(source_key(F.col("source")).alias("source")).agg(
        F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target_share"),
        F.max(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).alias("max_repeats"),
    )
    goal = stage(goal.where("source IS NOT NULL"), "goal")
    wanted = goal.count() * 64
    keyed = counted.join(broadcast_if_small(goal.select("source"), wanted), "source").withColumn("key", F.xxhash64("doc_id", F.lit(seed)) if key is None else key)
    # counted once and staged, as ranges take a sample of the rows before they are placed
    keyed = stage(keyed.select("doc_id", "source", "tokens", "key"), "keyed")
    spread = max(8, -(-keyed.count() // PART_ROWS))
    placed = stage(keyed.repartitionByRange(spread, "source", "key").withColumn("part", F.spark_partition_id()), "placed")
    # one row a source and partition: sources of the target table times partitions at most
    sums = placed.groupBy("source", "part").agg(F.sum("tokens").alias("sum"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("sum").over(earlier), F.lit(0)))
    sizes = sums.groupBy("source").agg(F.sum("sum").alias("size"))
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] * total_share
    plan = goal.join(sizes, "source", "left").na.fill(0, ["size"])
    plan = plan.withColumn("budget", F.col("target_share") * F.lit(float(total)))
    plan = plan.withColumn("epochs", F.when(F.col("size") > 0, F.least(F.floor(F.col("budget") / F.col("size")), F.col("max_repeats"))).otherwise(0).cast("long"))
    rest = F.when(F.col("epochs") < F.col("max_repeats"), F.col("budget") - F.col("epochs") * F.col("size")).otherwise(0.0)
    plan = stage(plan.withColumn("rest", rest), "plan")
    within = Window.partitionBy("source", "part").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = placed.withColumn("run", F.sum("tokens").over(within)).join(broadcast_if_small(offsets.select("source", "part", "offset"), wanted * spread), ["source", "part"])
    joined = running.join(broadcast_if_small(plan.select("source", "epochs", "rest"), wanted), "source")
    # the document on the cut goes to the side that brings the source nearer to its budget
    taken = (F.col("offset") + F.col("run") - F.col("tokens") / 2 <= F.col("rest")).cast("long")
    records = joined.withColumn("repeats", F.col("epochs") + taken).where("repeats > 0").select("doc_id", "source", "tokens", "repeats")
    records = stage(records, "mix")
    reached = records.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("documents"))
    shares = plan.join(reached, "source", "left").na.fill(0, ["tokens", "documents"])
    mixed = reached.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    shares = shares.select(
        "source", "target_share", "max_repeats", "documents", F.col("tokens"), F.col("budget"),
        F.try_divide(F.col("tokens"), F.lit(float(total))).alias("share_of_total"),
        F.try_divide(F.col("tokens"), F.lit(float(mixed))).alias("share_of_mix"),
        (F.col("size") * F.col("max_repeats") < F.col("budget")).alias("short"),
    )
    return records, shares

