import math
import random

import numpy as np
from pyspark.sql import functions as F

from cairnflow.operators import running as R


def test_ranges_rise_with_their_values(spark):
    rnd = random.Random(1)
    vs = sorted({0.0, -0.0, 1e-300, -1e-300, 1e308, -1e308, 0.5, 1.0, *(rnd.uniform(-1, 1) * 10 ** rnd.randrange(-12, 12) for _ in range(500))})
    df = spark.createDataFrame([(v,) for v in vs] + [(None,), (float("nan"),), (math.inf,)], "v double")
    for f in (R.range_of_value, R.range_of_score):
        got = {r["v"]: r["c"] for r in df.where("v is not null and not isnan(v) and abs(v) < 1e290").select("v", f(F.col("v")).alias("c")).collect()}
        ordered = [got[v] for v in sorted(got)]
        assert ordered == sorted(ordered) and len(set(ordered)) > 20
    ends = {str(r["v"]): r["c"] for r in df.select("v", R.range_of_value(F.col("v")).alias("c")).collect()}
    assert ends["None"] == min(ends.values()) and ends["nan"] == max(ends.values()) and ends["inf"] < ends["nan"]


def test_running_sums_and_quantiles_against_numpy(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([0.0, 1.5, -2.0, rnd.gauss(0, 100), 1e6 + rnd.random()])) for _ in range(800)]
    df = spark.createDataFrame(rows + [("a", None)], "k string, v double")
    by = df.where("v is not null").groupBy("k", "v").agg(F.count("*").alias("n"))
    for falling in (False, True):
        for r in R.running_sums(by, ["k"], "v", ["n"], falling).collect():
            own = [v for k, v in rows if k == r["k"]]
            assert r["n_run"] == sum(v >= r["v"] if falling else v <= r["v"] for v in own) and r["n_all"] == len(own)
    for r in R.quantiles(df, ["k"], "v", [0, 0.1, 0.5, 0.77, 1]).collect():
        want = np.quantile([v for k, v in rows if k == r["k"]], [0, 0.1, 0.5, 0.77, 1])
        assert np.allclose(r["quantiles"], want, rtol=1e-12)
    assert R.quantiles(df.where("v > 1e9"), ["k"], "v", [0.5]).count() == 0
