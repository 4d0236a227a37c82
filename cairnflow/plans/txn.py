"""The payment graph derived from the order tables: one edge per line item, with a label and a fixture score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shares, table, written

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
VAL, TEST, EVENT = (35, 37), (38, 48), 43


def batch_of(edge_time: Column) -> Column:
    return F.least(F.floor(edge_time / 51).cast("long"), F.lit(48).cast("long"))


def label() -> Column:
    return F.when((F.col("l_linestatus") == "O") & (F.col("l_partkey") % 2 == 0), -1).when((F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.08), 1).otherwise(0)


def _derived(lineitem: DataFrame) -> DataFrame:
    """lineitem with edge_time, batch_id and y."""
    t = F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01")).cast("long")
    return lineitem.select("*", t.alias("edge_time"), batch_of(t).alias("batch_id"), label().cast("int").alias("y"))


def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, src, dst, edge_time, batch_id, amount, payment_format, status, y, p); edge_time in days since 1995-01-01."""
    accounts = table(spark, sf_dir, "supplier", "s_suppkey").count()
    li = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    t = F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01")).cast("long")
    batch = batch_of(t)
    y = label()
    p = ((7 * F.col("l_partkey") + 13 * F.col("l_suppkey") + 17 * F.col("l_linenumber")) % 1000).cast("double") / 1e3 * 6e-1 + F.when((y == 1) & (batch < EVENT), 35e-2).otherwise(0e0)
    return li.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        *KEY, (F.col("o_custkey") % F.lit(accounts)).alias("src"), F.col("l_suppkey").alias("dst"), t.alias("edge_time"), batch.alias("batch_id"),
        F.col("l_extendedprice").alias("amount"), F.col("l_returnflag").alias("payment_format"), F.col("l_linestatus").alias("status"),
        F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), y.cast("int").alias("y"), p.alias("p"))


def model_edges(spark: SparkSession, sf_dir: str, keyed_from: int) -> DataFrame:
    """The edges of txn as models read them: (o, line, part, src, dst, edge_time, y, amount, quantity, discount, tax).

    What a model does not read of an edge is null before anything is shuffled: the key (o, line and part) before batch
    keyed_from, and all but ends and time without a label. dst and amount are the rest of the key. The table is written.
    """
    keyed, known = (F.col("y") >= 0) & (F.col("batch_id") >= keyed_from), F.col("y") >= 0
    li = _derived(table(spark, sf_dir, "lineitem"))
    accounts = table(spark, sf_dir, "supplier", "s_suppkey").count()
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    only = lambda when, c, name: F.when(when, F.col(c)).alias(name)
    li = li.select("l_orderkey", only(keyed, "l_linenumber", "line"), only(keyed, "l_partkey", "part"), F.col("l_suppkey").alias("dst"), "edge_time", keyed.alias("_keyed"), "y", only(known, "l_extendedprice", "amount"), *(only(known, f"l_{c}", c) for c in ("quantity", "discount", "tax")))
    parts = [a.join(b, F.col("l_orderkey") == F.col("o_orderkey")) for a, b in zip(shares(li, "l_orderkey"), shares(orders, "o_orderkey"))]
    return written(*(p.select(only(F.col("_keyed"), "l_orderkey", "o"), "line", "part", (F.col("o_custkey") % F.lit(accounts)).alias("src"), "dst", "edge_time", "y", "amount", "quantity", "discount", "tax") for p in parts))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled units of the validation and test batches: (time, y, p, part)."""
    t = txn(spark, sf_dir).where((F.col("y") >= 0) & F.col("batch_id").between(VAL[0], TEST[1]))
    return t.select(F.col("batch_id").alias("time"), "y", "p", F.when(F.col("batch_id") <= VAL[1], "val").otherwise("test").alias("part"))


#: The same in plain SQL, to begin other statements with.
TXN_SQL = """WITH RECURSIVE txn0 AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, o_custkey % (SELECT count(*) FROM supplier) AS src, l_suppkey AS dst,
    CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS edge_time, l_extendedprice AS amount, l_returnflag AS payment_format, l_linestatus AS status,
    l_quantity AS quantity, l_discount AS discount, l_tax AS tax,
    CASE WHEN l_linestatus = 'O' AND l_partkey % 2 = 0 THEN -1 WHEN l_returnflag = 'R' AND l_discount >= 0.08 THEN 1 ELSE 0 END AS y
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), txn1 AS (SELECT *, least(edge_time // 51, 48) AS batch_id FROM txn0),
txn AS (
  SELECT *, CAST((7 * l_partkey + 13 * l_suppkey + 17 * l_linenumber) % 1000 AS DOUBLE) / 1e3 * 6e-1 + CASE WHEN y = 1 AND batch_id < 43 THEN 35e-2 ELSE 0e0 END AS p FROM txn1
), scored AS (
  SELECT batch_id AS time, y, p, CASE WHEN batch_id <= 37 THEN 'val' ELSE 'test' END AS part FROM txn WHERE y >= 0 AND batch_id BETWEEN 35 AND 48
)"""
