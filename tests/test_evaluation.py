import pytest
from pyspark.sql import functions as F

from cairnflow.operators import evaluation as E


def pred(spark, y, p, time=None):
    return spark.createDataFrame([(a, float(b), t) for a, b, t in zip(y, p, time or [0] * len(y))], "y int, p double, time int")


def test_hand_computed(spark):
    d = pred(spark, [1, 0, 1, 1, 0, 0], [.9, .8, .7, .4, .3, .2])
    r = E.rank_metrics(d).first()
    assert abs(r["pr_auc"] - 29 / 36) < 1e-12 and abs(r["roc_auc"] - 7 / 9) < 1e-12
    assert abs(E.confusion(d, F.lit(.5)).first()["f1"] - 2 / 3) < 1e-12 and abs(E.confusion(d, F.lit(.35)).first()["f1"] - 6 / 7) < 1e-12
    at = {x["recall"]: x["precision"] for x in E.precision_at_recall(d, [.5, .8]).collect()}
    assert abs(at[.5] - 2 / 3) < 1e-12 and abs(at[.8] - 3 / 4) < 1e-12
    t = E.choose_threshold(d).first()
    assert t["threshold"] == .4 and abs(t["f1"] - 6 / 7) < 1e-12


def test_inverted_and_ties(spark):
    r = E.rank_metrics(pred(spark, [1, 1, 0, 0], [.1, .2, .8, .9])).first()
    assert abs(r["pr_auc"] - 5 / 12) < 1e-12 and r["roc_auc"] == 0
    t = E.choose_threshold(pred(spark, [1, 0, 0, 1], [.9, .8, .7, .6])).first()
    assert t["threshold"] == .9 and abs(t["f1"] - 2 / 3) < 1e-12
    assert E.rank_metrics(pred(spark, [1, 0], [.5, .5])).first()["roc_auc"] == .5


def test_undefined_metrics_are_null(spark):
    r = E.rank_metrics(pred(spark, [0, 0], [.1, .2])).first()
    assert r["pr_auc"] is None and r["roc_auc"] is None
    c = E.per_timestep(pred(spark, [1, 0, 0], [.9, .1, .2], [5, 5, 6]), F.lit(.5)).orderBy("time").collect()
    assert c[0]["f1"] == 1 and c[1]["f1"] == 0 and c[1]["pr_auc"] is None
    with pytest.raises(ValueError):
        E.check_labels(pred(spark, [0, -1], [.1, .2]))


def test_event_windows(spark):
    d = pred(spark, [1, 0, 1, 0, 1, 0, 1, 0], [.9, .2, .8, .1, .6, .7, .1, .3], [5, 5, 6, 6, 7, 7, 8, 8])
    w = {r["window"]: r for r in E.event_windows(d, 7, F.lit(.5)).collect()}
    assert (w["after"]["roc_auc"], w["after"]["recall"], w["after"]["pos_median"]) == (.25, .5, .35)
    assert w["before"]["roc_auc"] == 1 and w["before"]["recall"] == 1 and abs(w["before"]["pos_median"] - .85) < 1e-12


def test_seed_interval(spark):
    f = lambda xs: E.seed_interval(spark.createDataFrame([("m", float(x)) for x in xs], "k string, v double"), ["k"], "v").first()
    a, b, c, d = f([1, 2, 3, 4, 5]), f([.4, .5, .6]), f([.42]), f([.5, .5])
    assert abs(a["ci_high"] - a["seed_mean"] - 1.9632432) < 1e-6 and abs(b["ci_high"] - b["seed_mean"] - .2484130) < 1e-6
    assert c["ci_low"] is None and c["seed_mean"] == .42 and d["ci_low"] == d["ci_high"] == .5
