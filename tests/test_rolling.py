import datetime as dt
import random

import numpy as np

from cairnflow.operators import rolling as L
from pyspark.sql import functions as F

SCHEMA = "bank string, acct string, ts timestamp_ntz, x double, seen timestamp_ntz, day string"


def run(spark, rows, first, last, periods=(7, 30)):
    df = spark.createDataFrame(rows, SCHEMA)
    d = L.daily(df, {"bank": L.account("bank"), "account": L.account("acct")}, "ts", "x", "seen")
    return {(r["bank"], r["account"], r["day"]): r for r in L.rolling_totals(d, ["bank", "account"], first, last, periods).collect()}


def test_against_brute_force(spark):
    rnd = random.Random(1)
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for _ in range(400):
        d = rnd.randrange(150)
        t = t0 + dt.timedelta(days=d, minutes=rnd.randrange(1400))
        rows.append(("1", rnd.choice(["a", " A ", "b", "c"]), t, rnd.choice([None, round(rnd.random() * 100, 2)]), t + dt.timedelta(days=rnd.choice([0, 3])), "x"))
    rows += [("1", None, t0, 5.0, t0, "x"), ("1", "a", None, 5.0, t0, "x"), rows[0], rows[0]]
    first = int((np.datetime64("2024-01-01") - L.EPOCH).astype(int))
    got = run(spark, rows, first, first + 149)
    assert len(got) == 3 * 150
    for (_b, a, day), r in got.items():
        for p in (7, 30):
            lo = dt.datetime.combine(day, dt.time()) - dt.timedelta(days=p - 1)
            hi = dt.datetime.combine(day, dt.time()) + dt.timedelta(days=1)
            xs = [x[3] for x in rows if x[1] and x[1].strip().upper() == a and x[2] and lo <= x[2] < hi and x[3] is not None]
            assert r[f"n_{p}d"] == len(xs) and abs(r[f"total_{p}d"] - sum(xs)) < 1e-6
            assert r[f"avg_{p}d"] is None if not xs else abs(r[f"avg_{p}d"] - sum(xs) / len(xs)) < 1e-6


def test_corrections_touch_ancestors_only():
    leaves = np.zeros((64, 3, 5), dtype=np.int64)
    f = L.Forest(leaves)
    before = [n.copy() for n in f.nodes]
    touched = f.correct(np.array([2]), np.array([10]), np.array([[7], [0], [1]]))
    assert touched == 7  # a leaf and its six ancestors
    changed = [np.argwhere(n != b) for n, b in zip(f.nodes, before)]
    assert all(set(c[:, 2]) == {2} and set(c[:, 0]) == {10 >> k} for k, c in enumerate(changed))


def test_cover_is_exact():
    for lo in range(0, 64, 5):
        for hi in range(lo, 64, 3):
            days = [d for k, i in L.Forest.cover(lo, hi) for d in range(i << k, (i + 1) << k)]
            assert sorted(days) == list(range(lo, hi + 1))


def test_empty(spark):
    assert run(spark, [], 0, 3) == {}


def test_tree_table_answers_ranges_across_shards(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("1", "a", t0 + dt.timedelta(days=i), float(i), t0 + dt.timedelta(days=i + (i % 5 == 0)), "x") for i in range(0, 140, 2)]
    d = L.daily(spark.createDataFrame(rows, SCHEMA), {"k": L.account("acct")}, "ts", "x", "seen")
    nodes = L.correct_nodes(L.tree_nodes(d, ["k"]), ["k"], L.tree_nodes(d, ["k"], late=True))
    first = int((np.datetime64("2024-01-01") - L.EPOCH).astype(int))
    asks = spark.range(140).select(F.lit("A").alias("k"), (F.col("id") + first).alias("day"))
    for period in (1, 7, 30, 64):
        for r in L.range_totals(nodes, ["k"], asks, period).collect():
            i = r["day"] - first
            xs = [x for x in range(0, 140, 2) if i - period < x <= i]
            assert r["n"] == len(xs) and abs(r["total"] - sum(xs)) < 1e-9
    assert 0 < nodes.where("corrected").count() < nodes.count()


def test_large_and_infinite_amounts_count_whole(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("1", "a", t0, 3e16, t0, "x"), ("1", "a", t0 + dt.timedelta(days=1), 2.5, t0 + dt.timedelta(days=2), "x"), ("1", "b", t0 + dt.timedelta(days=1), float("inf"), t0 + dt.timedelta(days=4), "x"), ("1", "b", t0, float("nan"), t0, "x")]
    first = int((np.datetime64("2024-01-01") - L.EPOCH).astype(int))
    got = {(k[1], (k[2] - t0.date()).days): r for k, r in run(spark, rows, first, first + 9).items()}
    assert got["A", 0]["total_7d"] == 3e16 and got["A", 1]["total_7d"] == 3e16 + 2.5 and got["A", 1]["n_7d"] == 2
    assert got["A", 8]["total_7d"] == 0 and got["A", 7]["total_7d"] == 2.5 and got["A", 9]["total_30d"] == 3e16 + 2.5
    assert got["B", 0]["n_7d"] == 0 and got["B", 0]["total_7d"] == 0 and got["B", 2]["total_7d"] == float("inf") and got["B", 9]["total_7d"] == 0


def test_exact_sums_never_wrap(spark):
    import pytest

    rows = [("1", "a", dt.datetime(2024, 1, 1), 9.9e11, None, "x")] * 3
    d = L.daily(spark.createDataFrame(rows, SCHEMA), {"k": L.account("acct")}, "ts", "x").withColumn("w", F.lit(5 * 10**18)).withColumn("late_w", F.lit(0).cast("long"))
    first = int((np.datetime64("2024-01-01") - L.EPOCH).astype(int))
    with pytest.raises(Exception, match="exceeds 9e18"):
        L.rolling_totals(d.unionByName(d.withColumn("day", F.col("day") + 1)), ["k"], first, first + 3).collect()
