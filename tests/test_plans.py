from pyspark.sql import functions as F

from querent.plans.skew import global_rank, join_on_hot_key
from querent.plans.staging import Stage, shared_dir


def test_global_rank_equals_a_window(spark):
    df = spark.createDataFrame([("a" if i % 3 else None, (i * 7) % 31, i) for i in range(200)], "g string, o int, i int")
    got = global_rank(Stage(spark, "t"), df, ["g"], ["o", "i"], partitions=7).collect()
    want = {}
    for r in sorted(got, key=lambda r: (r["g"] or "", r["o"], r["i"])):
        want[r["i"]] = sum(1 for x in got if x["g"] == r["g"] and (x["o"], x["i"]) < (r["o"], r["i"]))
    assert {r["i"]: r["rank"] for r in got} == want


def test_hot_keys_join_like_cold_ones(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(50)] + [("cold", 1), ("other", 2)], "k string, v int")
    stats = rows.groupBy("k").agg(F.count(F.lit(1)).alias("df"))
    got = join_on_hot_key(rows, stats, "k", 10, "df").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("df").alias("df")).collect()
    assert {r["k"]: (r["n"], r["df"]) for r in got} == {"hot": (50, 50), "cold": (1, 1), "other": (1, 1)}


def test_staged_tables_are_read_back_and_dropped(spark):
    stage = Stage(spark, "t")
    df = stage.write(spark.range(5), "x")
    assert df.count() == 5 and df._staged_path.startswith(shared_dir(spark))
    stage.drop(df)
    stage.drop(None)
