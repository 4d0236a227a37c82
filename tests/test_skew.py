import random
from collections import Counter

from cairnflow.operators import skew as K
from pyspark.sql import functions as F


def records(spark, n=4000):
    rnd = random.Random(2)
    return spark.createDataFrame([("hot" if rnd.random() < 0.5 else f"k{rnd.randrange(300)}", i, float(i % 7)) for i in range(n)] + [(None, -1, 0.0)], "k string, i int, x double")


def test_equals_a_plain_join_and_is_even(spark):
    df = records(spark)
    match = df.where("k is not null and k <> 'k5'").groupBy("k").agg(F.avg("x").alias("mean"), F.max("i").alias("i"))
    got = K.fragment_replicate(df, match, ["k"], tasks=8).collect()
    want = df.where("k is not null").join(match.select("k", "mean", F.col("i").alias("i_match")), "k", "left").collect()
    pick = lambda rows: sorted((r["k"], r["i"], r["x"], r["mean"] or -1, r["i_match"] or -1) for r in rows)
    assert pick(got) == pick(want)
    per = Counter(r["task"] for r in got)
    assert max(per.values()) < 1.5 * len(got) / 8  # half of the rows have one key
    assert len({r["task"] for r in got if r["k"] == "hot"}) > 1
    assert len({r["task"] for r in got if r["k"] == "k7"}) == 1


def test_plan_is_the_same_every_time(spark):
    loads = K.load_by_key(records(spark), ["k"])
    a, b = K.plan_tasks(loads, ["k"], 8), K.plan_tasks(loads, ["k"], 8)
    assert a.bucket_task == b.bucket_task and a.heavy == b.heavy


def test_ties_and_empty(spark):
    df = spark.createDataFrame([], "k string, i int")
    assert K.fragment_replicate(df, df.select("k", F.lit(1).alias("m")), ["k"]).count() == 0
    same = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 1)], "k string, task int")
    got = K.fragment_replicate(same, same.select("k").distinct().withColumn("m", F.lit(1)), ["k"], tasks=2)
    assert got.count() == 4 and got.where("m = 1").count() == 4
