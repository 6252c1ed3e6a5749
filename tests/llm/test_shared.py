from pyspark.sql import functions as F

from lotlight.llm.shared import cut, shared_dir, small_join


def test_salted_and_broadcast_joins_agree(spark):
    big = spark.range(1000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("g"), "id")
    small = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3)], "g string, v int")
    for how in ("inner", "left"):
        a, b = (sorted(map(str, small_join(big, small, ["g"], 3, limit, how).select("g", "id", "v").collect())) for limit in (10, 0))
        assert a == b and len(a) > 600


def test_cut_keeps_rows_and_uses_the_set_folder(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    back = cut(df)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect())) and back.schema == df.schema
    assert cut(df.filter("false")).count() == 0
    assert "/lotlight-" in shared_dir(spark)
