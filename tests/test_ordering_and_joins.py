"""Size-checked broadcast and distributed row numbers on a hot group."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from crawlscope.operators import joins as J
from crawlscope.operators import ordering as OR


def test_broadcast_only_below_bound(spark):
    small = spark.range(10)
    big = spark.range(1000)
    assert J.has_at_most(small, 10) and not J.has_at_most(big, 999)
    plan_small = big.join(J.broadcast_if_small(small, 10), "id")._jdf.queryExecution().optimizedPlan().toString()
    plan_big = small.join(J.broadcast_if_small(big, 999), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan_small.lower()
    assert "broadcast" not in plan_big.lower()


def test_sequence_on_hot_group_matches_row_number(spark):
    # one group holds two thirds of the rows; numbering is spread over 12 range partitions
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "cold").otherwise("hot").alias("g"),
                                  ((F.col("id") * 7919) % 3001).alias("k"), "id")
    got = OR.sequence_within_groups(df, ["g"], ["k", "id"], out_col="seq", num_partitions=12)
    want = df.withColumn("seq", F.row_number().over(Window.partitionBy("g").orderBy("k", "id")).cast("bigint"))
    assert got.select("g", "id", "seq").exceptAll(want.select("g", "id", "seq")).count() == 0
    assert got.count() == 3000
