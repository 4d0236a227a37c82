"""Readers that give a payment graph as nodes, edges and what is known about them."""

from __future__ import annotations

import hashlib
import json
import logging
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Dataset, Synthetic


@dataclass
class Meta:
    dataset: str
    version: str
    task: str  # "node" or "edge": what a unit is
    blocks: dict[str, list[str]] = field(default_factory=dict)
    dropped: list[str] = field(default_factory=list)
    cross_time_edges: bool = False
    source: str = ""  # a hash of what the graph is made from


@dataclass
class GraphTables:
    """nodes(node, node_time, y, features), edges(edge, src, dst, edge_time, ...); units are one or the other."""

    nodes: DataFrame
    edges: DataFrame
    meta: Meta

    @property
    def units(self) -> DataFrame:
        """(unit, unit_time, batch_id, y, features)"""
        if self.meta.task == "node":
            return self.nodes.select(F.col("node").alias("unit"), F.col("node_time").alias("unit_time"), F.coalesce("batch_id", "node_time").alias("batch_id"), "y", *self.feature_names)
        return self.edges.select(F.col("edge").alias("unit"), F.col("edge_time").alias("unit_time"), "batch_id", "y", *self.feature_names)

    @property
    def feature_names(self) -> list[str]:
        return [c for cs in self.meta.blocks.values() for c in cs]


def require(df: DataFrame, what: str, shown: int = 5) -> None:
    """Raises if df has rows, naming a few."""
    rows = df.limit(shown).collect()
    if rows:
        raise ValueError(f"{what}: {[tuple(r) for r in rows]}")


def read_elliptic(spark: SparkSession, d: Dataset) -> GraphTables:
    """Three CSV files: features (by header; 93 local and 72 aggregate columns are taken), classes, edges."""
    path = d.path
    raw = spark.read.option("header", True).csv(f"{path}/txs_features.csv")
    low = {c.lower().replace(" ", "_"): c for c in raw.columns}
    local = [f"local_feature_{i}" for i in range(1, 94)]
    agg = [f"aggregate_feature_{i}" for i in range(1, 73)]
    missing = [c for c in ("txid", "time_step", *local, *agg) if c not in low]
    if missing:
        raise ValueError(f"columns missing: {missing[:5]}")
    x = raw.select(
        F.col(f"`{low['txid']}`").cast("long").alias("node"), F.col(f"`{low['time_step']}`").cast("long").alias("node_time"), *(F.col(f"`{low[c]}`").cast("float").alias(c) for c in (*local, *agg)))
    require(x.groupBy("node").count().where("count > 1").select("node"), "transactions stand more than once")
    classes = spark.read.option("header", True).schema("txId long, class int").csv(f"{path}/txs_classes.csv").toDF("node", "class")
    require(classes.where("class not in (1, 2, 3)"), "classes other than 1, 2 and 3")
    y = F.when(F.col("class") == 1, 1).when(F.col("class") == 2, 0).otherwise(-1)
    nodes = x.join(classes, "node", "left").withColumn("y", y).withColumn("batch_id", F.col("node_time")).drop("class")
    # numbered as they stand in the file: unique for repeated edges too, and the order of edges of one time
    e = spark.read.option("header", True).schema("txId1 long, txId2 long").csv(f"{path}/txs_edgelist.csv").toDF("src", "dst").withColumn("edge", F.monotonically_increasing_id())
    for end in ("src", "dst"):
        require(e.select(F.col(end).alias("node")).join(nodes.select("node"), "node", "left_anti"), f"edges whose {end} is no transaction")
    t = nodes.select("node", "node_time")
    edges = e.join(t.toDF("src", "edge_time"), "src").join(t.toDF("dst", "_t"), "dst")
    require(edges.where("edge_time <> _t").select("src", "dst"), "edges across time steps")
    edges = edges.drop("_t")
    if d.version in PUBLISHED["elliptic"]:
        r = nodes.agg(F.count("*").alias("nodes"), F.count_distinct("node_time").alias("steps"), *(F.count_if(F.col("y") == k).alias(n) for k, n in ((1, "illicit"), (0, "licit"), (-1, "unknown")))).first().asDict()
        check_published("elliptic", d.version, r | {"edges": edges.count()})
    else:
        logging.getLogger(__name__).warning("no counts are published for elliptic %s, so none are checked", d.version)
    return GraphTables(nodes, edges, Meta("elliptic", d.version, "node", {"local": local, "agg1hop": agg}, [low[c] for c in low if c not in ("txid", "time_step", *local, *agg)]))


# Counts of the published releases.
PUBLISHED = {
    "elliptic": {"2023.1": {"nodes": 203_769, "edges": 234_355, "steps": 49, "illicit": 4_545, "licit": 42_019, "unknown": 157_205}},
    "amlworld": {"hi_small": {"edges": 5_078_345, "nodes": 515_088, "illicit": 5_177}},
}


def check_published(dataset: str, version: str, seen: dict[str, int]) -> None:
    """Raises where a release whose counts are known has others."""
    want = PUBLISHED[dataset].get(version, {})
    wrong = {k: (n, seen[k]) for k, n in want.items() if seen[k] != n}
    if wrong:
        raise ValueError(f"this is not {dataset} {version}: (published, seen) {wrong}")


AML_COLUMNS = ["timestamp", "from_bank", "from_account", "to_bank", "to_account", "amount_received", "currency_received", "amount_paid", "currency_paid", "payment_format", "is_laundering"]
AML_SCHEMA = T.StructType([T.StructField(c, T.TimestampNTZType() if c == "timestamp" else T.DoubleType() if c.startswith("amount") else T.IntegerType() if c == "is_laundering" else T.StringType()) for c in AML_COLUMNS])


def read_amlworld(spark: SparkSession, d: Dataset) -> GraphTables:
    """A CSV read by position, as two of its columns have one name; accounts are bank:account and keep leading zeros."""
    raw = spark.read.schema(AML_SCHEMA).option("header", True).option("enforceSchema", True).option("timestampNTZFormat", "yyyy/MM/dd HH:mm").csv(d.path)
    return amlworld_graph(raw, d)


def amlworld_graph(raw: DataFrame, d: Dataset) -> GraphTables:
    require(raw.where("is_laundering not in (0, 1)").select("is_laundering"), "labels other than 0 and 1")
    first = raw.agg(F.min("timestamp")).first()[0]
    if d.max_days and first is not None:
        import datetime as dt

        raw = raw.where(F.col("timestamp") < F.lit(first + dt.timedelta(days=d.max_days)).cast("timestamp_ntz"))  # a literal, so it reaches the scan
    hour = F.timestamp_diff("HOUR", F.lit(first).cast("timestamp_ntz"), F.col("timestamp"))
    key = lambda b, a: F.concat(F.col(b), F.lit(":"), F.col(a))
    e = raw.select(
        F.monotonically_increasing_id().alias("edge"), key("from_bank", "from_account").alias("src"), key("to_bank", "to_account").alias("dst"), hour.alias("edge_time"), F.floor(hour / 24).alias("batch_id"),
        F.col("is_laundering").alias("y"), F.col("amount_received").cast("float").alias("amount_received"), F.col("amount_paid").cast("float").alias("amount_paid"),
        "currency_received", "currency_paid", "payment_format", F.hour("timestamp").cast("float").alias("hour_of_day"))
    for c in ("currency_received", "currency_paid", "payment_format"):
        e = e.join(F.broadcast(codes(e, c)), c, "left").drop(c).withColumnRenamed(f"{c}_code", c)
    nodes = e.select("edge_time", F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.min("edge_time").alias("node_time")).withColumn("y", F.lit(-1)).withColumn("batch_id", F.lit(None).cast("long"))
    cols = ["amount_received", "amount_paid", "currency_received", "currency_paid", "payment_format", "hour_of_day"]
    if d.version in PUBLISHED["amlworld"] and not d.max_days:  # a prefix has fewer
        r = e.agg(F.count("*").alias("edges"), F.count_if(F.col("y") == 1).alias("illicit")).first().asDict()
        check_published("amlworld", d.version, r | {"nodes": nodes.count()})
    return GraphTables(nodes, e, Meta("amlworld", d.version + (f"-d{d.max_days}" if d.max_days else ""), "edge", {"local": cols}, cross_time_edges=True))


def codes(df: DataFrame, c: str, most: int = 10_000) -> DataFrame:
    """(c, c_code): sorted dense codes of a vocabulary, whose size is checked."""
    values = sorted(r[0] for r in df.select(c).where(f"{c} is not null").distinct().limit(most + 1).collect())
    if len(values) > most:
        raise ValueError(f"{c} has more than {most} values")
    return df.sparkSession.createDataFrame(list(zip(values, map(float, range(len(values))))) or [("", 0.0)], f"{c} string, {c}_code float")


def make_synthetic(spark: SparkSession, d: Dataset) -> GraphTables:
    """A seeded graph: labelled nodes over time, shifted features on illicit ones, edges within steps, and fan-in stars."""
    s: Synthetic = d.synthetic
    u = lambda *k: (F.xxhash64(F.lit(s.seed), *(F.lit(x) if isinstance(x, (str, int)) else x for x in k)).bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)
    gauss = lambda *k: F.sqrt(-2 * F.log(u("a", *k))) * F.cos(2 * 3.141592653589793 * u("b", *k))
    local, agg = [f"local_feature_{i}" for i in range(1, 94)], [f"aggregate_feature_{i}" for i in range(1, 73)]
    per = -(-s.n_nodes // s.n_timesteps)
    n = spark.range(s.n_nodes).select(F.col("id").alias("node"), (F.floor(F.col("id") / per) + 1).alias("node_time"))
    bad = u("y", F.col("node")) < s.illicit_rate
    n = n.withColumn("_bad", bad).withColumn("y", F.when(u("k", F.col("node")) < s.unknown_rate, -1).when(F.col("_bad"), 1).otherwise(0))
    x = [(gauss(c, F.col("node")) + F.when(F.col("_bad"), 1.2 if i < 10 else 0.0).otherwise(0.0)).cast("float").alias(c) for i, c in enumerate((*local, *agg))]
    nodes = n.select("node", "node_time", "y", F.col("node_time").alias("batch_id"), *x)
    base = n.select("node", "node_time", "_bad", F.explode(F.sequence(F.lit(1), F.when(F.col("_bad"), F.lit(4)).otherwise(F.lit(1)))).alias("_k"))
    start = (F.col("node_time") - 1) * per
    width = F.least(F.lit(per), F.lit(s.n_nodes) - start)
    other = start + F.floor(u("e", F.col("node"), F.col("_k")) * width)
    if s.cross_time_edges:
        other = F.when(u("x", F.col("node"), F.col("_k")) < 0.4, F.least(F.lit(s.n_nodes - 1), F.col("node") + 1 + F.floor(u("z", F.col("node"), F.col("_k")) * 3 * per))).otherwise(other)
    e = base.select(F.col("node").alias("dst"), other.cast("long").alias("src"), "_k").where("src <> dst")
    t = n.select("node", "node_time")
    e = e.join(t.toDF("src", "_a"), "src").join(t.toDF("dst", "_b"), "dst").select("src", "dst", F.greatest("_a", "_b").alias("edge_time"), F.xxhash64("src", "dst", "_k").alias("edge"))
    return GraphTables(nodes, e, Meta("synthetic", d.version, "node", {"local": local, "agg1hop": agg}, cross_time_edges=s.cross_time_edges))


LOADERS: dict[str, Callable[[SparkSession, Dataset], GraphTables]] = {"elliptic": read_elliptic, "amlworld": read_amlworld, "synthetic": make_synthetic}


def cache_key(d: Dataset, files: list | None = None) -> str:
    """A hash of everything the graph is made from: generator settings, or the files with their lengths and times."""
    return hashlib.sha256(json.dumps([d.model_dump(), files or []], sort_keys=True, default=str).encode()).hexdigest()[:16]


def source_files(spark: SparkSession, d: Dataset) -> list:
    """(path, length, time) of the files of a dataset, whose content is not read."""
    if not d.path:
        return []
    rows = spark.read.format("binaryFile").load(d.path).select("path", "length", "modificationTime").orderBy("path").limit(100_000).collect()  # a row a file
    return [list(r) for r in rows]


def check_edges(g: GraphTables) -> GraphTables:
    """The graph, if its edges have ids of their own; raises else."""
    require(g.edges.groupBy("edge").count().where("count > 1").select("edge"), "edge ids stand more than once")
    return g


def in_order(g: GraphTables) -> DataFrame:
    """The edges by time; edges of one time in the order of their ids, which is that of their file."""
    return g.edges.orderBy("edge_time", "edge")


def load_graph(spark: SparkSession, d: Dataset, cache: str | None = None) -> GraphTables:
    """The graph of a configuration, from the cache where it stands there, else built and kept."""
    if cache is None:
        return check_edges(LOADERS[d.name](spark, d))
    key = cache_key(d, source_files(spark, d))
    where = f"{cache.rstrip('/')}/{d.name}-{key}"
    try:
        meta = Meta(**json.loads(spark.read.text(f"{where}/meta").first()[0]))
    except Exception:  # no cache, or one that was not finished: the meta table is written last
        g = check_edges(LOADERS[d.name](spark, d))
        g.meta.source = key
        g.nodes.write.mode("overwrite").parquet(f"{where}/nodes")
        g.edges.write.mode("overwrite").parquet(f"{where}/edges")
        spark.createDataFrame([(json.dumps(asdict(g.meta)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{where}/meta")
        meta = g.meta
    return GraphTables(spark.read.parquet(f"{where}/nodes"), spark.read.parquet(f"{where}/edges"), meta)
