"""Order and uniqueness of rows, said of whole tables without bringing them into one task.

Rows are cut into ranges of their order at sampled quantiles, which only decide where a row is looked at, never what is
found: every row is numbered or compared within its range, and ranges go on from one another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 64


def _ranged(df: DataFrame, first: str) -> DataFrame:
    """df with the range (_c) of its leading order column, a number without nulls."""
    cuts = sorted({float(q) for q in df.approxQuantile(first, [i / RANGES for i in range(1, RANGES)], 0.01)})
    return df.withColumn("_c", F.size(F.filter(F.array(*(F.lit(c) for c in cuts)).cast("array<double>"), lambda c: c < F.col(first))))  # at most RANGES literals


def positions(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """df with each row's place, from 0, in a stable order; the leading column is a number without nulls."""
    cut = _ranged(df, order[0])
    before = Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    start = cut.groupBy("_c").agg(F.count("*").alias("_n")).select("_c", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_c").orderBy(*order)) - 1
    return cut.withColumn("_i", place).join(F.broadcast(start), "_c").withColumn(name, F.col("_i") + F.col("_start")).drop("_c", "_i", "_start")  # at most RANGES + 1 rows


def repeated(df: DataFrame, key: list[str]) -> DataFrame:
    """(key, times) of keys that stand more than once; a null key is a key."""
    return df.groupBy(*key).agg(F.count("*").alias("times")).where("times > 1")


def order_breaks(df: DataFrame, order: str, value: Column) -> DataFrame:
    """One row: rows, and how many have a value below that of the row before them in the order, a number without nulls and repeats.

    Rows with a null value are passed over.
    """
    cut = _ranged(df, order).withColumn("_v", value).where("_v is not null")
    w = Window.partitionBy("_c").orderBy(order)
    inside = cut.select("_c", order, "_v", F.lag("_v").over(w).alias("_b"))
    per = inside.groupBy("_c").agg(F.count("*").alias("n"), F.count_if(F.col("_v") < F.col("_b")).alias("k"), F.min_by("_v", order).alias("_first"), F.max_by("_v", order).alias("_last"))
    joint = per.withColumn("_before", F.lag("_last").over(Window.orderBy("_c")))  # a row a range
    return joint.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("k") + F.coalesce((F.col("_first") < F.col("_before")).cast("int"), F.lit(0))), F.lit(0)).alias("breaks"))
