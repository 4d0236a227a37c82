import pytest
from pyspark.sql import functions as F

from cairnflow.operators import drift as D
from cairnflow.operators import splits as S


def long(spark, xs):
    return spark.createDataFrame([("c", float(x)) for x in xs], "column string, value double")


def test_psi_of_constant_and_binary_references(spark):
    assert D.psi(long(spark, [0] * 50), long(spark, [1] * 50)).first()["psi"] > .2
    assert D.psi(long(spark, [0, 1] * 25), long(spark, [1] * 50)).first()["psi"] > .2
    assert abs(D.psi(long(spark, range(50)), long(spark, range(50))).first()["psi"]) < 1e-12


def test_ks(spark):
    r = D.ks(long(spark, [1, 2, 3]), long(spark, [4, 5, 6])).first()
    assert r["d"] == 1 and (r["n_ref"], r["n_cur"]) == (3, 3)


def test_scores_rise_with_the_shift(spark):
    base = spark.range(200).select(F.lit(1).alias("batch_id"), (F.col("id") / 200).alias("p"), (F.col("id") / 10).alias("x"))
    u = base
    for b, shift in ((2, 0.0), (3, 0.2), (4, 0.5)):
        u = u.unionByName(base.select(F.lit(b).alias("batch_id"), F.least(F.col("p") + shift, F.lit(1.0)).alias("p"), (F.col("x") + 20 * shift).alias("x")))
    got = {(r["detector"], r["batch_id"]): r["score"] for r in D.detector_scores(u, ["x"], [1], F.lit(.8)).collect()}
    for d in ("psi", "conf", "alert"):
        assert got[d, 2] < got[d, 3] < got[d, 4]
    assert got["ks", 2] == 0 and got["ks", 4] == 1


def test_lead_time(spark):
    curve = spark.createDataFrame([(9, .8), (10, .8), (11, .3), (12, .2)], "time int, f1 double")
    flags = spark.createDataFrame([("psi", b, b in (9, 10)) for b in range(9, 13)] + [("ks", b, False) for b in range(9, 13)], "detector string, batch_id int, flagged boolean")
    got = {r["detector"]: r for r in D.lead_time(curve, flags, .9).collect()}
    assert (got["psi"]["first_drop"], got["psi"]["first_flag"], got["psi"]["lead"]) == (11, 9, 2) and abs(got["psi"]["drop_level"] - .72) < 1e-12
    assert got["ks"]["first_flag"] is None and got["ks"]["lead"] is None


def test_dips_and_flicker_are_no_runs(spark):
    f = lambda xs, run: D.first_run(spark.createDataFrame([(0, 9 + i, x) for i, x in enumerate(xs)], "k int, t int, hit boolean"), ["k"], "t", "hit", run).first()["first"]
    assert f([False, True, False, True, True], 2) == 12 and f([False, True, False, True, True], 1) == 10 and f([False, True, False, True, False], 2) is None


def units(spark):
    return spark.range(1000).select(F.col("id").alias("unit"), (F.col("id") % 12).alias("batch_id"), F.when(F.col("id") % 10 == 0, 1).when(F.col("id") % 7 == 0, -1).otherwise(0).alias("y"))


def test_random_split_is_stratified_exact_and_the_same_every_time(spark):
    s = S.split_random(units(spark), ["unit"], 3)
    n = {(r["y"], r["part"]): r["count"] for r in s.groupBy("y", "part").count().collect()}
    for y in (0, 1):
        all_n = sum(v for k, v in n.items() if k[0] == y)
        assert n[y, "train"] == round(all_n * .7) and n[y, "val"] + n[y, "train"] == round(all_n * .85)
    again = S.split_random(units(spark).repartition(7), ["unit"], 3)
    assert S.split_hash(s, ["unit"], {}) == S.split_hash(again, ["unit"], {}) != S.split_hash(S.split_random(units(spark), ["unit"], 4), ["unit"], {})


def test_temporal_split_and_its_guard(spark):
    s = S.split_temporal(units(spark), 6, (7, 8), (9, 11))
    S.check_leakage(s, ["unit"], True)
    with pytest.raises(ValueError):
        S.check_leakage(s.unionByName(s.limit(1).withColumn("part", F.lit("test"))), ["unit"], True)
    with pytest.raises(ValueError):
        S.check_leakage(s.withColumn("part", F.when(F.col("part") == "val", "train").when(F.col("part") == "train", "val").otherwise("test")), ["unit"], True)


def test_rolling_steps():
    assert S.rolling_steps(34, 3, (38, 40)) == [(34, (35, 37), (38, 38)), (35, (36, 38), (39, 39)), (36, (37, 39), (40, 40))]
    with pytest.raises(ValueError):
        S.rolling_steps(34, 3, (38, 38))
