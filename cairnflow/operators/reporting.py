"""Results over tracked runs, and the ranked alert queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evaluation import seed_interval

FIRST_METRICS = ["f1", "pr_auc", "roc_auc", "precision_at_recall_0.5", "precision_at_recall_0.8"]
CONFIG = ["dataset", "regime", "model", "features"]


def provenance(col: str) -> Column:
    """Distinct values in order, joined; one value where runs agree."""
    return F.array_join(F.array_sort(F.collect_set(col)), "|")


def results_table(runs: DataFrame, keys: list[str] = CONFIG) -> DataFrame:
    """runs(keys, seed, metric, value, feature_version, split_hash, commit) to one row per configuration and metric."""
    ci = seed_interval(runs, [*keys, "metric"], "value")
    where = runs.groupBy(*keys, "metric").agg(*(provenance(c).alias(c) for c in ("feature_version", "split_hash", "commit")))
    return ci.join(where, [*keys, "metric"]).withColumn("ci_kind", F.lit("seed_t95"))


def results_wide(results: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """One row per configuration, one text column per metric: mean and half width."""
    half = F.col("ci_high") - F.col("seed_mean")
    cell = F.when(half.isNull(), F.format_string("%.4f", "seed_mean")).otherwise(F.format_string("%.4f ± %.4f", "seed_mean", half))
    return results.withColumn("_cell", cell).groupBy(*keys).pivot("metric", metrics).agg(F.first("_cell"))


def metric_order(metric: Column, first: list[str] | tuple[str, ...] = FIRST_METRICS) -> Column:
    """Orders metrics: the named ones as they are named, then the others by name."""
    at = F.array_position(F.array(*(F.lit(m) for m in first)), metric)
    return F.struct(F.when(at == 0, len(first) + 1).otherwise(at), metric)


def curve_bands(curves: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, time, f1_mean, low, high): the mean over seeds and its t-interval at every batch; no interval for one seed."""
    return seed_interval(curves, [*keys, "time"], "f1").select(*keys, "time", F.col("seed_mean").alias("f1_mean"), F.col("ci_low").alias("low"), F.col("ci_high").alias("high"))


def recovery(curves: DataFrame, regimes: list[str]) -> DataFrame:
    """(time, a column per regime): the mean F1 over seeds, beside each other."""
    return curves.groupBy("time").pivot("regime", regimes).agg(F.avg("f1"))


def lead_summary(leads: DataFrame) -> DataFrame:
    """(detector, first_flag, drop_level): over runs, the median first flag and the mean level of the drop. A row a run and detector."""
    return leads.groupBy("detector").agg(F.median("first_flag").alias("first_flag"), F.avg("drop_level").alias("drop_level"))


def alert_queue(scored: DataFrame, threshold: Column, key: list[str], top: int | None = None) -> DataFrame:
    """Units at or above the threshold, ranked by falling score, ties in key order. A queue for people: meant to be short."""
    q = scored.where(F.col("p") >= threshold)
    if top is not None:
        q = q.orderBy(F.desc("p"), *key).limit(top)
    return q.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("p"), *key)))


def top_features(contributions: dict[str, Column], k: int = 3) -> Column:
    """The k greatest signed contributions, as text."""
    arr = F.array(*(F.struct((-v).alias("neg"), F.lit(n).alias("name")) for n, v in contributions.items()))
    return F.array_join(F.transform(F.slice(F.array_sort(arr), 1, k), lambda s: F.format_string("%s %+.2f", s["name"], -s["neg"])), "; ")


def largest_component(edges: DataFrame, components: DataFrame, most: int) -> DataFrame:
    """(node, accounts, first_time) of the largest component of at most so many accounts; of equal ones that of the earliest
    edge, then the least name. edges(src, dst, edge_time), components(node, component)."""
    sized = components.groupBy("component").agg(F.count("*").alias("accounts")).where(F.col("accounts") <= most)
    first = edges.select(F.col("src").alias("node"), "edge_time").join(components, "node").groupBy("component").agg(F.min("edge_time").alias("first_time"))
    best = sized.join(first, "component").orderBy(F.desc("accounts"), "first_time", "component").limit(1)
    return components.join(F.broadcast(best), "component").select("node", "accounts", "first_time")  # one row


def alert_load(at_recall: DataFrame) -> DataFrame:
    """precision at recall with the alerts looked at per case caught."""
    return at_recall.withColumn("alerts_per_case", 1 / F.col("precision"))
