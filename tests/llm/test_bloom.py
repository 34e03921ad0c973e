from pyspark.sql import functions as F

from relgraph.llm import bloom


def test_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(0, 40_000, 2).select((F.xxhash64("id")).alias("id"))
    may = bloom.maybe_in(keys)
    rows = spark.range(40_000).select("id", F.xxhash64("id").alias("h")).filter(may(F.col("h"))).select("id").collect()
    found = {r.id for r in rows}
    assert set(range(0, 40_000, 2)) <= found and len(found) < 20_000 * 1.02


def test_empty_and_null(spark):
    may = bloom.maybe_in(spark.createDataFrame([], "id long"))
    df = spark.createDataFrame([(1,), (None,)], "id long")
    assert df.filter(may(F.col("id"))).count() == 0
    assert df.filter(bloom.maybe_in(df)(F.col("id"))).count() == 1
