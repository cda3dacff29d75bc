"""The data side of training: shuffles, shards, losses, schedules, step counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagesieve.session import broadcast_if_small, rows_and_bytes, stage

EPS = 1e-7
# Name, positive, negative and class weight of each class.
CLASS_WEIGHTS = {0: ("Primary", 1.0, 1.0, 1.0), 1: ("Heading", 1.0, 1.0, 1.0), 2: ("Title", 1.0, 1.0, 1.0), 3: ("Paragraph", 1.0, 1.0, 1.0), 4: ("Table", 1.0, 1.0, 1.0), 5: ("List", 1.0, 1.0, 1.0)}


#: Rows of a part whose ranks one task makes.
PART_ROWS = 200_000


def ranked(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """rows with _rank, the place from 0 in their group, and _all, the size of the group. Rows are placed by ranges of group and
    order and each range is counted, so that a group of any size is ranked by as many tasks as its rows need."""
    spread = max(1, -(-rows.count() // PART_ROWS))
    keys = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    names = [f"_o{i}" for i in range(len(order))]
    placed = stage(rows.select("*", *keys).repartitionByRange(spread, *(group or [F.lit(0)]), *names).withColumn("_part", F.spark_partition_id()), "placed")
    # one row a group and range: groups plus ranges at most
    sums = placed.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*group)
    offsets = sums.select(*group, "_part", F.coalesce(F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"), F.sum("_n").over(w).alias("_all"))
    offsets = offsets.select(*(F.col(c).alias(f"_of_{c}") for c in [*group, "_part"]), "_offset", "_all")
    n, size = rows_and_bytes(sums, *[f.name for f in sums.schema.fields if f.dataType.simpleString() == "string"])
    within = F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*names)) - 1
    on = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in [*group, "_part"]]
    joined = placed.withColumn("_place", within).join(broadcast_if_small(offsets, size + 16 * n), on)
    return joined.select(*rows.columns, (F.col("_offset") + F.col("_place")).alias("_rank"), "_all")


def shuffled(rows: DataFrame, file: str, line: str, seed: int) -> DataFrame:
    """rows with place, their rank in a seeded order of each file; a seed of -1 keeps the order of lines."""
    key = F.col(line) if seed == -1 else F.xxhash64(file, line, F.lit(seed))
    return ranked(rows, [file], [key, F.col(line)]).withColumn("place", F.col("_rank").cast("int")).drop("_rank", "_all")


def sharded(rows: DataFrame, order: list[Column], workers: int, group: list[str] | None = None) -> DataFrame:
    """rows with worker, the number of the contiguous slice they fall in; the first n mod workers slices have one row more."""
    small, more = F.floor(F.col("_all") / workers), F.col("_all") % workers
    front = more * (small + 1)
    worker = F.when(F.col("_rank") < front, F.floor(F.col("_rank") / (small + 1))).otherwise(more + F.floor((F.col("_rank") - front) / F.greatest(small, F.lit(1))))
    return ranked(rows, group or [], order).withColumn("worker", worker.cast("int")).drop("_rank", "_all")


def truncated(rows: DataFrame, file: str, line: str, multiple: int = 1) -> DataFrame:
    """rows of each file up to the largest multiple."""
    return ranked(rows, [file], [F.col(line)]).where(F.col("_rank") < F.col("_all") - F.col("_all") % multiple).drop("_rank", "_all")


def running_mean(losses: DataFrame, step: str, loss: str, limit: int | None = None) -> DataFrame:
    """(step, loss, mean, gap) of a run's finite losses in the order of steps, the first `limit` of them: the mean so far, and the
    gap of each loss to the one before. A run's steps are few and stand in one sequence."""
    ok = losses.where(~F.isnan(loss) & (F.abs(loss) != float("inf"))).select(F.col(step).alias("step"), F.col(loss).alias("loss"))
    if limit is not None:
        ok = ok.orderBy("step").limit(limit)
    w = Window.orderBy("step")
    so_far = F.avg("loss").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ok.select("step", "loss", so_far.alias("mean"), (F.col("loss") - F.lag("loss").over(w)).alias("gap"))


def class_weights(spark: SparkSession, overrides: dict[int, tuple] | None = None) -> DataFrame:
    """(class_id, name, pos_weight, neg_weight, class_weight), replaced as a whole where overrides are given."""
    rows = [(k, *((overrides or {}).get(k, v))) for k, v in CLASS_WEIGHTS.items()]
    return spark.createDataFrame(rows, "class_id INT, name STRING, pos_weight DOUBLE, neg_weight DOUBLE, class_weight DOUBLE")


def clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(EPS)), F.lit(1.0 - EPS))


def cross_entropy(y: Column, p: Column, pos: Column, neg: Column) -> Column:
    """Weighted binary cross-entropy of one node and class, both sides clamped away from 0 and 1."""
    y, p = clamp(y), clamp(p)
    return -(y * F.ln(p) * pos + (1 - y) * F.ln(1 - p) * neg)


def weighted_loss(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """(loss) from (sample, node, class_id, y, p): mean over a sample's nodes, weighted sum over classes, mean over samples."""
    joined = scores.join(F.broadcast(weights), "class_id")
    each = joined.groupBy("sample", "class_id").agg(F.avg(cross_entropy(F.col("y"), F.col("p"), F.col("pos_weight"), F.col("neg_weight"))).alias("l"), F.first("class_weight").alias("w"))
    return each.groupBy("sample").agg(F.sum(F.col("l") * F.col("w")).alias("l")).agg(F.avg("l").alias("loss"))


def finite_losses(losses: DataFrame, column: str = "loss") -> DataFrame:
    """(n, infinite, mean): how many losses there are, how many are not finite, and the mean of the finite ones."""
    ok = ~F.isnan(column) & (F.abs(column) != float("inf")) & F.col(column).isNotNull()
    return losses.agg(F.count(F.lit(1)).alias("n"), F.sum((~ok).cast("long")).alias("infinite"), F.avg(F.when(ok, F.col(column))).alias("mean"))


def learning_rate(step: Column, kind: str, lr: float, warmup: int, total: int, epoch_steps: int) -> Column:
    """Learning rate at a step."""
    s = step.cast("double")
    rise = s / max(1, warmup)
    cycle = F.floor(1 + s / (2 * (epoch_steps // 2)))
    tri = F.greatest(F.lit(0.0), 1 - F.abs(s / (epoch_steps // 2) - 2 * cycle + 1))
    low = 1e-8
    if kind == "linear_with_warmup":
        return lr * F.when(step < warmup, rise).otherwise(F.greatest(F.lit(0.0), (total - s) / max(1, total - warmup)))
    if kind == "constant_with_warmup":
        return lr * F.when(step < warmup, s / max(1.0, float(warmup))).otherwise(1.0)
    if kind == "cosine_with_warmup":
        done = (s - warmup) / max(1, total - warmup)
        return lr * F.when(step < warmup, rise).otherwise(F.greatest(F.lit(0.0), 0.5 * (1 + F.cos(F.lit(math.pi) * done))))
    if kind == "cyclic_triangular2":
        return low + (lr - low) * tri / F.pow(F.lit(2.0), cycle - 1)
    if kind == "cyclic_exp":
        return low + (lr - low) * tri * F.pow(F.lit(0.85), s)
    if kind == "step_with_warmup":
        return lr * F.pow(F.lit(0.1), F.floor(s / epoch_steps)) * F.least(F.lit(1.0), (s + 1) / max(1, warmup))
    if kind == "exponential_with_warmup":
        gamma = math.exp((math.log(low) - math.log(lr)) / epoch_steps)
        return lr * F.when(step < warmup, rise).otherwise(F.pow(F.lit(gamma), s))
    raise ValueError(f"no schedule of the name {kind}")


SCHEDULES = ("linear_with_warmup", "constant_with_warmup", "cosine_with_warmup", "cyclic_triangular2", "cyclic_exp", "step_with_warmup", "exponential_with_warmup")


def step_counts(batches: Column, epochs: int, accumulate: int, world: int, checkpoint: int) -> dict[str, Column]:
    """Steps over all, of a process in an epoch rounded down to whole checkpoints, and of a process."""
    per = F.floor(batches / (accumulate * world))
    every = F.least(F.lit(checkpoint), per)
    rounded = F.when(every > 0, F.floor(per / every) * every).otherwise(0)
    return {"total_steps": F.floor(batches * epochs / accumulate), "steps_per_epoch": rounded, "steps_per_process": rounded * epochs}
