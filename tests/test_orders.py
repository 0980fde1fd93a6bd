"""Global orders with many buckets and ties, substring keys, label kinds."""

from pyspark.sql import functions as F

from colsense.operators import annotate, sample


def _check_index(df, order, key, **kw):
    got = [r["k"] for r in sample.dense_index(df, order, out="ix", **kw).orderBy("ix").select(F.col(key).alias("k"), "ix").collect()]
    want = [r["k"] for r in df.orderBy(*order).select(F.col(key).alias("k")).collect()]
    assert got == want


def test_dense_index_with_many_buckets(spark):
    df = spark.range(3000).withColumn("h", sample.hash_key("own-seed", "id"))
    _check_index(df, [F.col("h"), F.col("id")], "id", ranges=300)


def test_dense_index_with_equal_leading_keys(spark):
    df = spark.range(2000).withColumn("h", F.lit(7))
    _check_index(df, [F.col("h"), F.col("id")], "id", ranges=64)
    sizes = sample.ranged(df, [F.col("h"), F.col("id")], 64).groupBy("__p").count().collect()
    assert len(sizes) > 30 and max(r["count"] for r in sizes) < 200


def test_running_sum_with_heavy_and_null_keys(spark):
    df = spark.range(900).select("id", F.when(F.col("id") % 3 == 0, 5).when(F.col("id") % 50 == 1, None).otherwise(F.col("id")).alias("h"))
    order = [F.col("h"), F.col("id")]
    got = sample.running_sum(df, order, F.col("id"), "s", inclusive=True, ranges=32).orderBy("s", "id").collect()
    total, want = 0, {}
    for r in df.orderBy(*order).collect():
        total += r["id"]
        want[r["id"]] = total
    assert {r["id"]: r["s"] for r in got} == want


def test_substring_keys_may_repeat(spark):
    files = spark.createDataFrame([("a_goals_x",), ("plain",), ("",)], "file_name string")
    keys = spark.createDataFrame([("goals",), ("goals",), ("x",), ("",), (None,)], "file_key string")
    assert sorted(map(tuple, annotate.metadata_substring_match(files, keys).collect())) == [("a_goals_x", "goals"), ("a_goals_x", "x")]


def test_label_kinds_numerical_wins(spark):
    meta = spark.createDataFrame([("b", "numerical_cols", "h", "age"), ("z", "textual_cols", "h", "age"), ("b", "textual_cols", "g", "name"),
                                  ("c", "textual_cols", "n", None)], "file_key string, kind string, header string, column_type string")
    assert {r[0]: r[1] for r in annotate.type_to_datatype_lookup(meta).collect()} == {
        "age": "numerical", "name": "non-numerical", None: "numerical"}
