"""Drift of unlabelled batches against reference batches: stability index, KS, score shift and alert rate.

Columns are unpivoted once; no detector sees a label. Statistics are over distinct values with counts, so the merged
order of a column is its distinct values, not its rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import ks_pvalue
from .running import quantiles, running_sums

FLOOR = 1e-4
DETECTORS = ("psi", "ks", "conf", "alert")


def unpivot(df: DataFrame, keep: list[str], cols: list[str]) -> DataFrame:
    """(keep, column, value)"""
    return df.select(*keep, F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols))))


def psi(ref: DataFrame, cur: DataFrame, bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """(by, column, psi) of cur(by, column, value) against ref(column, value).

    Cuts are the distinct linear quantiles of the reference, without the greatest unless it is the only one; bins are
    (a, b]; shares are floored.
    """
    by = by or []
    cuts = quantiles(ref, ["column"], "value", [i / bins for i in range(bins + 1)]).select("column", F.array_distinct("quantiles").alias("_q"))
    cuts = cuts.select("column", F.when(F.size("_q") > 1, F.slice("_q", 1, F.size("_q") - 1)).otherwise(F.col("_q")).alias("_cuts"))
    b = F.size(F.filter("_cuts", lambda c: c < F.col("value")))
    count = lambda df, keys: df.join(F.broadcast(cuts), "column").groupBy(*keys, "column", b.alias("b")).agg(F.count("*").alias("n"))
    r, c = count(ref, []), count(cur, by)
    rs = r.select("column", "b", (F.col("n") / F.sum("n").over(Window.partitionBy("column"))).alias("r"))
    cs = c.select(*by, "column", "b", (F.col("n") / F.sum("n").over(Window.partitionBy(*by, "column"))).alias("c"))
    groups = cs.select(*by, "column").distinct()
    full = groups.join(rs, "column").join(cs, [*by, "column", "b"], "full_outer")
    share = lambda x: F.greatest(F.coalesce(F.col(x), F.lit(0.0)), F.lit(FLOOR))
    return full.groupBy(*by, "column").agg(F.sum((share("c") - share("r")) * F.log(share("c") / share("r"))).alias("psi"))


def ks(ref: DataFrame, cur: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, column, d, n_ref, n_cur): the greatest distance between the distribution functions."""
    by = by or []
    c = cur.groupBy(*by, "column", "value").agg(F.count("*").alias("c"))
    groups = c.select(*by, "column").distinct()
    r = ref.groupBy("column", "value").agg(F.count("*").alias("r"))
    both = groups.join(r, "column").join(c, [*by, "column", "value"], "full_outer").na.fill(0, ["r", "c"])
    f = running_sums(both, [*by, "column"], "value", ["r", "c"]).select(*by, "column", F.col("r_run").alias("_fr"), F.col("c_run").alias("_fc"), F.col("r_all").alias("n_ref"), F.col("c_all").alias("n_cur"))
    return f.groupBy(*by, "column").agg(F.max(F.abs(F.col("_fr") / F.col("n_ref") - F.col("_fc") / F.col("n_cur"))).alias("d"), F.first("n_ref").alias("n_ref"), F.first("n_cur").alias("n_cur"))


def ks_share(stats: DataFrame, by: list[str], alpha: float = 0.01) -> DataFrame:
    """(by, ks): the share of columns whose KS p-value is below alpha. Rows of stats are columns by batches, not units."""
    @F.pandas_udf("double")
    def p(d: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([ks_pvalue(float(x), int(m), int(n)) for x, m, n in zip(d, a, b)], dtype="float64")

    return stats.withColumn("_p", p("d", "n_ref", "n_cur")).groupBy(*by).agg(F.avg((F.col("_p") < alpha).cast("double")).alias("ks"))


def alert_rate(scores: DataFrame, threshold: Column, by: list[str]) -> DataFrame:
    return scores.groupBy(*by).agg((F.count_if(F.col("p") >= threshold) / F.count("*")).alias("rate"))


def alert_shift(cur_rate: Column, ref_rate: Column) -> Column:
    return F.abs(F.log(cur_rate + FLOOR) - F.log(ref_rate + FLOOR))


def first_run(flags: DataFrame, keys: list[str], time: str, hit: str, run: int) -> DataFrame:
    """(keys, first): the first time at which `run` consecutive rows are hits; null where none is."""
    w = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.currentRow, run - 1)
    s = flags.select(*keys, F.col(time).alias("_t"), (F.min(F.col(hit).cast("int")).over(w) == 1).alias("_all"), F.count("*").over(w).alias("_n"))
    return s.groupBy(*keys).agg(F.min(F.when(F.col("_all") & (F.col("_n") == run), F.col("_t"))).alias("first"))


def lead_time(curve: DataFrame, scores: DataFrame, ref_f1: float | Column, drop: float = 0.2, run: int = 2) -> DataFrame:
    """(detector, first_flag, first_drop, lead, drop_level, ref_f1); a positive lead warned in advance.

    curve(time, f1) and scores(detector, batch_id, flagged) have a row a batch.
    """
    ref = ref_f1 if isinstance(ref_f1, Column) else F.lit(float(ref_f1))
    level = (1 - drop) * ref
    drops = first_run(curve.withColumn("_k", F.lit(0)).withColumn("_hit", F.col("f1") < level), ["_k"], "time", "_hit", run).select(F.col("first").alias("first_drop"))
    flags = first_run(scores, ["detector"], "batch_id", "flagged", run).withColumnRenamed("first", "first_flag")
    return flags.crossJoin(F.broadcast(drops)).select(  # one row
        "detector", "first_flag", "first_drop", (F.col("first_drop") - F.col("first_flag")).alias("lead"), level.alias("drop_level"), ref.alias("ref_f1"))


def check_inputs(units: DataFrame, cols: list[str], ref: list[int]) -> None:
    """Raises where there is nothing to compare: no columns, columns that are missing or no numbers, no reference or no other batch."""
    kinds = dict(units.dtypes)
    wrong = [c for c in (*cols, "p") if kinds.get(c, "") not in ("double", "float", "int", "bigint", "smallint", "tinyint")]
    if not cols or wrong:
        raise ValueError(f"detectors take columns of numbers, not {wrong[:5] or 'none'}")
    r = units.agg(F.count_if(F.col("batch_id").isin(*ref)).alias("a"), F.count_if(~F.col("batch_id").isin(*ref)).alias("b")).first()
    if not r["a"] or not r["b"]:
        raise ValueError(f"{r['a']} units in the reference and {r['b']} beside it: detectors compare the one with the other")


def detector_scores(units: DataFrame, cols: list[str], ref: list[int], threshold: Column, bins: int = 10, alpha: float = 0.01, detectors: tuple[str, ...] = DETECTORS) -> DataFrame:
    """(detector, batch_id, score) of every batch not in the reference. units(batch_id, p, cols)."""
    is_ref = F.col("batch_id").isin(*ref)
    parts = []
    feats = unpivot(units, ["batch_id"], cols)
    scores = unpivot(units, ["batch_id"], ["p"])
    pick = lambda df: (df.where(is_ref).drop("batch_id"), df.where(~is_ref))
    if "psi" in detectors:
        parts.append(psi(*pick(feats), bins, ["batch_id"]).groupBy("batch_id").agg(F.max("psi").alias("score")).withColumn("detector", F.lit("psi")))
    if "ks" in detectors:
        parts.append(ks_share(ks(*pick(feats), ["batch_id"]), ["batch_id"], alpha).withColumnRenamed("ks", "score").withColumn("detector", F.lit("ks")))
    if "conf" in detectors:
        parts.append(ks(*pick(scores), ["batch_id"]).select("batch_id", F.col("d").alias("score"), F.lit("conf").alias("detector")))
    if "alert" in detectors:
        base = units.where(is_ref).agg((F.count_if(F.col("p") >= threshold) / F.count("*")).alias("_ref"))
        parts.append(alert_rate(units.where(~is_ref), threshold, ["batch_id"]).crossJoin(F.broadcast(base)).select("batch_id", alert_shift(F.col("rate"), F.col("_ref")).alias("score"), F.lit("alert").alias("detector")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("detector", "batch_id", "score")


def calibrate(units: DataFrame, cols: list[str], ref: list[int], threshold: Column, **kw) -> DataFrame:
    """(detector, level): the greatest score of a reference batch against the others; needs two populated batches.

    The loop is over the few reference batches of the configuration, not over data.
    """
    if len(ref) < 2:
        raise ValueError("calibration needs at least two reference batches")
    out = None
    inside = units.where(F.col("batch_id").isin(*ref))
    for b in ref:
        one = detector_scores(inside, cols, [r for r in ref if r != b], threshold, **kw)
        out = one if out is None else out.unionByName(one)
    return out.groupBy("detector").agg(F.max("score").alias("level"))
