"""Metrics, curves and thresholds as DataFrames to DataFrames, over (keys, y, p).

Scores are first grouped by distinct value, then summed up in order, range by range.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import t_quantile
from .running import quantiles, range_of_score, running_sums

def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def score_steps(pred: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, p, pos, n, tp, m, all_pos, all_n): running positives and counts by falling score, and the totals."""
    keys = keys or []
    by = pred.groupBy(*keys, "p").agg(F.sum((F.col("y") == 1).cast("long")).alias("pos"), F.count("*").alias("n"))
    steps = running_sums(by, keys, "p", ["pos", "n"], falling=True, range_of=range_of_score)
    return steps.select(*keys, "p", "pos", "n", F.col("pos_run").alias("tp"), F.col("n_run").alias("m"), F.col("pos_all").alias("all_pos"), F.col("n_all").alias("all_n"))


def pr_curve(pred: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, p, precision, recall, f1) per distinct score; F1 = 2 TP / (M + P)."""
    s = score_steps(pred, keys)
    return s.select(*(keys or []), "p", (F.col("tp") / F.col("m")).alias("precision"), ratio(F.col("tp"), F.col("all_pos")).alias("recall"), (2 * F.col("tp") / (F.col("m") + F.col("all_pos"))).alias("f1"), "pos", "n", "all_pos", "all_n", "tp", "m")


def choose_threshold(val: DataFrame) -> DataFrame:
    """(threshold, f1) of the best F1 on validation predictions; ties go to the higher score. Labels must be 0 or 1."""
    return pr_curve(val).agg(F.max_by("p", F.struct("f1", "p")).alias("threshold"), F.max("f1").alias("f1"))


def precision_at_recall(pred: DataFrame, recalls: list[float], keys: list[str] | None = None) -> DataFrame:
    """(keys, recall, precision): precision at the highest score that reaches each recall."""
    c = pr_curve(pred, keys)
    cols = [F.max_by("precision", F.when(F.col("recall") >= r, F.col("p"))).alias(f"_r{i}") for i, r in enumerate(recalls)]
    wide = c.groupBy(*(keys or [])).agg(*cols) if keys else c.agg(*cols)
    return wide.select(*(keys or []), F.inline(F.array(*(F.struct(F.lit(float(r)).alias("recall"), F.col(f"_r{i}").alias("precision")) for i, r in enumerate(recalls)))))


def rank_metrics(pred: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, pr_auc, roc_auc, n, n_pos): average precision and area under the ROC curve with ties as half."""
    s = score_steps(pred, keys)
    neg = F.col("n") - F.col("pos")
    cum_neg, all_neg = F.col("m") - F.col("tp"), F.col("all_n") - F.col("all_pos")
    ap = F.sum(F.col("pos") * F.col("tp") / F.col("m"))
    area = F.sum(F.col("pos") * (all_neg - cum_neg) + 0.5 * F.col("pos") * neg)
    aggs = [ap.alias("_ap"), area.alias("_area"), F.max("all_n").alias("n"), F.max("all_pos").alias("n_pos")]
    g = s.groupBy(*keys).agg(*aggs) if keys else s.agg(*aggs)
    return g.select(*(keys or []), ratio(F.col("_ap"), F.col("n_pos")).alias("pr_auc"), ratio(F.col("_area"), F.col("n_pos") * (F.col("n") - F.col("n_pos"))).alias("roc_auc"), "n", "n_pos")


def confusion(pred: DataFrame, threshold: Column, keys: list[str] | None = None) -> DataFrame:
    """(keys, precision, recall, f1, n, n_pos) at p >= threshold, which may differ by row; empty denominators give 0."""
    hit, pos = F.col("p") >= threshold, F.col("y") == 1
    aggs = [F.count_if(hit & pos).alias("tp"), F.count_if(hit).alias("flagged"), F.count_if(pos).alias("n_pos"), F.count("*").alias("n")]
    g = pred.groupBy(*keys).agg(*aggs) if keys else pred.agg(*aggs)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return g.select(
        *(keys or []), zero(ratio(F.col("tp"), F.col("flagged"))).alias("precision"), zero(ratio(F.col("tp"), F.col("n_pos"))).alias("recall"),
        zero(ratio(2 * F.col("tp"), F.col("flagged") + F.col("n_pos"))).alias("f1"), "n", "n_pos")


def per_timestep(pred: DataFrame, threshold: Column) -> DataFrame:
    """(time, f1, pr_auc, n, n_pos) per batch; the average precision is null without positives."""
    return confusion(pred, threshold, ["time"]).select("time", "f1", "n", "n_pos").join(rank_metrics(pred, ["time"]).select("time", "pr_auc"), "time")


def event_windows(pred: DataFrame, event: int, threshold: Column) -> DataFrame:
    """(window, n, n_pos, roc_auc, recall, pos_median) before and from the event on."""
    p = pred.withColumn("window", F.when(F.col("time") < event, "before").otherwise("after"))
    base = p.groupBy("window").agg(F.count_if((F.col("y") == 1) & (F.col("p") >= threshold)).alias("_tp"))
    median = quantiles(p.where("y = 1"), ["window"], "p", [0.5]).select("window", F.col("quantiles")[0].alias("pos_median"))
    r = rank_metrics(p, ["window"])
    return base.join(r, "window").join(median, "window", "left").select("window", "n", "n_pos", "roc_auc", ratio(F.col("_tp"), F.col("n_pos")).alias("recall"), "pos_median")


def seed_interval(runs: DataFrame, keys: list[str], value: str, conf: float = 0.95) -> DataFrame:
    """(keys, seed_mean, ci_low, ci_high, n_seeds): Student-t interval over seeds; null bounds for a single seed."""
    if not 0 < conf < 1:
        raise ValueError("conf lies between 0 and 1")
    g = runs.groupBy(*keys).agg(F.avg(value).alias("seed_mean"), F.stddev_samp(value).alias("_s"), F.count(value).alias("n_seeds"))

    @F.pandas_udf("double")
    def t(n: pd.Series) -> pd.Series:  # a row a configuration and metric
        return pd.Series([t_quantile((1 + conf) / 2, float(k) - 1) if k >= 2 else None for k in n], dtype="float64")

    half = F.when(F.col("n_seeds") >= 2, t("n_seeds") * F.col("_s") / F.sqrt("n_seeds"))
    return g.select(*keys, "seed_mean", (F.col("seed_mean") - half).alias("ci_low"), (F.col("seed_mean") + half).alias("ci_high"), "n_seeds")


def check_labels(pred: DataFrame) -> None:
    """Raises on empty input, labels other than 0 and 1, no positives, or scores outside 0..1."""
    r = pred.agg(F.count("*").alias("n"), F.count_if(~F.col("y").isin(0, 1) | F.col("y").isNull()).alias("bad"), F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("p").isNull() | ~F.col("p").between(0, 1)).alias("out")).first()
    if r["n"] == 0 or r["bad"] or r["out"] or r["pos"] == 0:
        raise ValueError(f"{r['n']} rows, {r['bad']} unlabelled, {r['pos']} positive, {r['out']} scores outside 0..1")
