"""Session defaults, the shared folder for cut lineage, and checked broadcasts."""

from __future__ import annotations

import uuid
from os import getpid
from pathlib import Path
from tempfile import gettempdir

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its measured size is at most this many bytes.
BROADCAST_LIMIT = 32 * 1024 * 1024
#: A join key is heavy when it holds more than this part of the rows, and is spread over so many places.
HEAVY, SALTS = 256, 32
_watched: set[str] = set()


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("pagesieve")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.checkpoint.dir", f"file://{Path(gettempdir()) / f'pagesieve-{getpid()}'}")
        .getOrCreate()
    )


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, whatever folder they start in. A cluster whose
    nodes have it installed, or get it as a file, is not affected."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(":")
    if root not in known:
        env["PYTHONPATH"] = ":".join([root, *filter(None, known)])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir. Where it is unset, a session on one machine stages in its temporary
    folder, as in tests; a cluster must name one, as nothing but a shared folder outlives an executor."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is unset: staged tables need a folder that all executors see")
        where = f"file://{Path(gettempdir()) / f'pagesieve-{getpid()}'}"
    return where.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: its lineage ends there, and a lost
    executor costs no more than rereading files. The table is deleted when the session ends, or by clear_staged."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/pagesieve-{spark.sparkContext.applicationId}"
    if spark.sparkContext.applicationId not in _watched:
        _watched.add(spark.sparkContext.applicationId)
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_staged(spark: SparkSession) -> bool:
    """Delete the tables that this application has staged; no frame that reads one may be used afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/pagesieve-{spark.sparkContext.applicationId}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def rows_and_bytes(df: DataFrame, *columns: str) -> tuple[int, int]:
    """Rows of df and the bytes of the named string or binary columns (16 bytes a row for the rest)."""
    total = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in columns), F.lit(0))
    n, b = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(total), F.lit(0))).first()
    return n, n * 16 + b


def broadcast_if_small(df: DataFrame, size: int, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """df with a broadcast hint when its measured size allows one, else df for a shuffled join."""
    return F.broadcast(df) if size <= limit else df.hint("merge")


def keyed_join(left: DataFrame, right: DataFrame, on: list[str], right_bytes: int, spread: Column, how: str = "inner", limit: int | None = None) -> DataFrame:
    """left joined with a right side whose rows of one key are few: sent along while its measured size allows it, else shuffled.

    A shuffled join would put all left rows of one key into one task, so the keys that hold more than a share of 1 / HEAVY of
    the left rows are counted first: at most HEAVY of them, by that share. Their left rows are spread over SALTS places by the
    expression spread, and only their right rows are copied to each place; all other rows are shuffled once.
    """
    if right_bytes <= (BROADCAST_LIMIT if limit is None else limit):
        return left.join(F.broadcast(right), on, how)
    counts = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    least = left.count() // HEAVY + 1
    heavy = F.broadcast(counts.where(F.col("_n") > least).select(*on, F.lit(SALTS).alias("_salts")))
    near = left.join(heavy, on, "left").withColumn("_salt", F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(0).cast("int"))
    far = right.join(heavy, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
    return near.drop("_salts").join(far.drop("_salts"), [*on, "_salt"], how).drop("_salt")


def without_nulls(df: DataFrame, *columns: str) -> DataFrame:
    """Rows without a null in the columns, all by default: as plain tests, which reach the scan and turn a left join into
    an inner one, unlike a count of nulls."""
    for c in columns or df.columns:
        df = df.where(F.col(c).isNotNull())
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
