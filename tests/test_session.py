import pytest
from pyspark.sql import functions as F

from pagesieve.session import broadcast_if_small, clear_staged, keyed_join, rows_and_bytes, shared_dir, stage


def test_staged_tables(spark):
    df = stage(spark.range(10).withColumn("t", F.lit("abc")), "x")
    assert df.count() == 10 and df.dtypes == [("id", "bigint"), ("t", "string")]
    assert rows_and_bytes(df, "t") == (10, 190) and rows_and_bytes(df.limit(0), "t") == (0, 0)
    assert shared_dir(spark) == shared_dir(spark)
    plan = broadcast_if_small(df, 1)._jdf.queryExecution().toString() + broadcast_if_small(df, 1 << 40)._jdf.queryExecution().toString()
    assert "broadcast" in plan and "merge" in plan
    assert clear_staged(spark) and not clear_staged(spark)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_heavy_keys_are_spread_and_whole(spark, how):
    left = spark.range(6000).select(F.col("id"), F.when(F.col("id") < 4000, F.lit(7)).when(F.col("id") % 9 == 0, None).otherwise(F.col("id") % 500).alias("k"))
    right = spark.range(400).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    want = sorted(map(tuple, left.join(right, ["k"], how).collect()), key=str)
    for size in (0, 1 << 40):
        assert sorted(map(tuple, keyed_join(left, right, ["k"], size, F.col("id"), how).collect()), key=str) == want
    assert keyed_join(left.limit(0), right, ["k"], 1 << 40, F.col("id"), how).count() == 0


def test_unset_folder(spark):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context
        conf = type("Conf", (), {"get": staticmethod(lambda name, default: default)})

    with pytest.raises(ValueError):
        shared_dir(Session)
    Context.master = "local[2]"
    assert shared_dir(Session).startswith("file://")
