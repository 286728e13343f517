"""Numbers of rows in an order: over ranges, within keys, ties, empty tables."""

from collections import Counter

from pyspark.sql import functions as F

from loam.operators.ordinals import numbered, numbered_within


def test_numbered(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"), "id").repartition(5)
    found = numbered(rows, [F.desc("k")], "nth").collect()
    assert [r["nth"] for r in sorted(found, key=lambda r: -r["k"])] == list(range(5000))
    assert numbered(rows.where("false"), [F.desc("k")]).count() == 0


def test_numbers_of_ties_and_nulls(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (2, "c")], "k int, v string")
    found = numbered(rows, [F.asc_nulls_first("k")]).collect()
    assert sorted(r["nth"] for r in found) == [0, 1, 2, 3] and {r["v"]: r["nth"] for r in found}["b"] == 0
    assert {r["v"]: r["nth"] for r in found}["c"] == 3


def test_numbered_within_a_hot_key(spark):
    """Two thirds of all rows have one key, and no range has them all."""
    rows = spark.range(9000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 100).cast("string"))).alias("k"), "id").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = numbered_within(rows, ["k"], [F.col("id")]).collect()
        ranges = numbered(rows, [F.col("k"), F.col("id")]).where("k = 'hot'").groupBy(F.spark_partition_id()).count().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    expected, seen = {}, Counter()
    for r in sorted(found, key=lambda r: r["id"]):
        expected[r["id"]] = seen[r["k"]]
        seen[r["k"]] += 1
    assert {r["id"]: r["nth"] for r in found} == expected and ranges > 1
