"""Running sums and exact quantiles of long lists, without ordering a list in one task.

A list is cut into ranges of its values, which a value tells by itself, so no pass is needed to find them. Each range is
ordered by itself and goes on from the sums of the ranges before it. Values that all lie within a hundredth of each other
share a range, and are ordered in one task as they would be without it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAR = 1_000_000


def range_of_score(p: Column) -> Column:
    """The range of a score, rising with it; fine near 0 and 1, where probabilities crowd."""
    inside = F.floor(8 * F.log(p / (1 - p)))
    return F.when((p > 0) & (p < 1), inside).when(p <= 0, F.lit(-FAR) + F.floor(8 * p)).otherwise(F.lit(FAR) + F.floor(8 * p))


def range_of_value(v: Column) -> Column:
    """The range of any number, rising with it; null is before all others, not-a-number after."""
    size = F.floor(64 * F.log(F.least(F.abs(v), F.lit(1e300)))) + 50_000
    return F.when(v.isNull(), -FAR).when(F.isnan(v), FAR).when(v > 0, size).when(v < 0, -size).otherwise(0).cast("long")


def running_sums(df: DataFrame, keys: list[str], order: str, sums: list[str], falling: bool = False, range_of=range_of_value) -> DataFrame:
    """df with, for each of `sums`, its sum up to the row in the order of the key (_run) and over the whole key (_all).

    df has one row per key and value of the order.
    """
    turn = F.desc if falling else F.asc
    # the key as one value, in which nulls are alike; rows are placed by it and their range once, for the window and for the join
    cut = df.withColumn("_key", F.struct(*keys) if keys else F.lit(0)).withColumn("_c", range_of(F.col(order)))
    before = Window.partitionBy("_key").orderBy(turn("_c")).rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("_key")
    per = cut.groupBy("_key", "_c").agg(*(F.sum(s).alias(s) for s in sums))  # a row a range
    per = per.select("_key", "_c", *(F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_before_{s}") for s in sums), *(F.sum(s).over(own).alias(f"{s}_all") for s in sums))
    w = Window.partitionBy("_key", "_c").orderBy(turn(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = cut.select("*", *(F.sum(s).over(w).alias(f"_own_{s}") for s in sums))
    return rows.join(per, ["_key", "_c"]).select(*df.columns, *((F.col(f"_own_{s}") + F.col(f"_before_{s}")).alias(f"{s}_run") for s in sums), *(f"{s}_all" for s in sums))


def quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """(keys, quantiles): exact quantiles of each key, between two values by their distance; nulls are passed over."""
    by = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    run = running_sums(by, keys, value, ["_n"])
    at = lambda rank: F.min(F.when(F.col("_n_run") > rank, F.col(value)))
    wide = run.withColumns({f"_p{i}": F.lit(q) * (F.col("_n_all") - 1) for i, q in enumerate(shares)})
    cols = [c for i in range(len(shares)) for c in (at(F.floor(F.col(f"_p{i}"))).alias(f"_lo{i}"), at(F.ceil(F.col(f"_p{i}"))).alias(f"_hi{i}"), F.max(f"_p{i}").alias(f"_at{i}"))]
    got = wide.groupBy(*keys).agg(*cols)

    def between(i: int) -> Column:
        lo, hi, p = F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col(f"_at{i}")
        return F.when(lo == hi, lo).otherwise((F.ceil(p) - p) * lo + (p - F.floor(p)) * hi)

    return got.select(*keys, F.array(*(between(i) for i in range(len(shares)))).alias("quantiles"))
