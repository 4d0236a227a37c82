"""The engine's own operators as named queries over the derived payment graph, and the same in plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import t_quantile
from ..operators import drift as D
from ..operators import evaluation as E
from ..operators import graph as G
from ..operators import reporting as R
from ..operators import splits as S
from ..session import table
from .txn import EVENT, KEY, TEST, TXN_SQL, VAL, batch_of, model_edges, scored, txn

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
W = 7
TRAIN_END = 34


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def rnd(df: DataFrame, **digits: int) -> DataFrame:
    """df with columns rounded, as sums of doubles depend on their order."""
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


# -- the graph, its codes and counts ------------------------------------------------------------------------------

KEYS_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"


@query("txn_edges", TXN_SQL + f" SELECT {KEYS_SQL}, src, dst, edge_time, batch_id, amount, payment_format, status, y, round(p, 6) AS p FROM txn")
def txn_edges(spark: SparkSession, d: str) -> DataFrame:
    return rnd(txn(spark, d).drop("quantity", "discount", "tax"), p=6)


@query("acct_first_seen", TXN_SQL + " SELECT account, min(edge_time) AS first_time FROM (SELECT src AS account, edge_time FROM txn UNION ALL SELECT dst, edge_time FROM txn) GROUP BY account")
def acct_first_seen(spark: SparkSession, d: str) -> DataFrame:
    ends = txn(spark, d).select("edge_time", F.explode(F.array("src", "dst")).alias("account"))
    return ends.groupBy("account").agg(F.min("edge_time").alias("first_time"))


@query("label_counts", TXN_SQL + " SELECT count(*) FILTER (y = 1) AS illicit, count(*) FILTER (y = 0) AS licit, count(*) FILTER (y = -1) AS unknown FROM txn")
def label_counts(spark: SparkSession, d: str) -> DataFrame:
    return txn(spark, d).agg(*(F.count_if(F.col("y") == v).alias(n) for v, n in ((1, "illicit"), (0, "licit"), (-1, "unknown"))))


@query("hour_day_fields", """
SELECT event_id, CAST(floor((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 3600000000.0) AS BIGINT) AS hour,
  CAST(floor((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 3600000000.0) AS BIGINT) // 24 AS batch_id, CAST(date_part('hour', ts) AS INTEGER) AS hour_of_day FROM events""")
def hour_day_fields(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "ts")
    first = F.lit(e.agg(F.min("ts")).first()[0]).cast("timestamp_ntz")  # one literal, so the scan is read once more, not joined
    hour = F.timestamp_diff("HOUR", first, F.col("ts"))
    return e.select("event_id", hour.alias("hour"), F.floor(hour / 24).alias("batch_id"), F.hour("ts").alias("hour_of_day"))


@query("max_days_prefix", """SELECT event_id FROM events WHERE ts < (SELECT min(ts) FROM events) + INTERVAL 240 HOUR""")
def max_days_prefix(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "ts")
    import datetime as dt

    end = e.agg(F.min("ts")).first()[0] + dt.timedelta(days=10)
    return e.where(F.col("ts") < F.lit(end).cast("timestamp_ntz")).select("event_id")  # a literal bound reaches the scan


@query("ordinal_codes", "SELECT event_type, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT event_type FROM events)")
def ordinal_codes(spark: SparkSession, d: str) -> DataFrame:
    kinds = table(spark, d, "events", "event_type").distinct()
    return kinds.select("event_type", (F.dense_rank().over(Window.orderBy("event_type")) - 1).alias("code"))  # over the vocabulary


@query("account_key", "SELECT DISTINCT trim(from_bank) || ':' || upper(trim(from_account)) AS account_key FROM hi_small_trans WHERE from_bank IS NOT NULL AND from_account IS NOT NULL")
def account_key(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "hi_small_trans", "from_bank", "from_account")
    return t.select(F.concat(F.trim("from_bank"), F.lit(":"), F.upper(F.trim("from_account"))).alias("account_key")).where("account_key is not null").distinct()


@query("resolve_ids_missing", "SELECT DISTINCT txid1 AS txid FROM txs_edgelist WHERE txid1 IS NOT NULL AND txid1 NOT IN (SELECT txid FROM txs_features WHERE txid IS NOT NULL)")
def resolve_ids_missing(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "txs_features", "txid")
    return table(spark, d, "txs_edgelist", F.col("txid1").alias("txid")).where("txid is not null").join(ids, "txid", "left_anti").distinct()


@query("class_labels", """SELECT f.txid, coalesce(CASE c.class WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN -1 END, -1) AS y
FROM (SELECT DISTINCT txid FROM txs_features WHERE txid IS NOT NULL) f LEFT JOIN (SELECT txid, min(class) AS class FROM txs_classes GROUP BY txid) c ON c.txid = f.txid""")
def class_labels(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "txs_classes").groupBy("txid").agg(F.min("class").alias("class"))
    y = F.when(F.col("class") == 1, 1).when(F.col("class") == 2, 0).otherwise(-1)
    return table(spark, d, "txs_features", "txid").where("txid is not null").distinct().join(c, "txid", "left").select("txid", y.alias("y"))


@query("elliptic_edges", """SELECT e.edge_id, e.txid1 AS src, e.txid2 AS dst, a.t AS edge_time, a.t <> b.t AS crosses FROM txs_edgelist e
JOIN (SELECT txid, min(time_step) AS t FROM txs_features GROUP BY txid) a ON a.txid = e.txid1 JOIN (SELECT txid, min(time_step) AS t FROM txs_features GROUP BY txid) b ON b.txid = e.txid2""")
def elliptic_edges(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "txs_features", "txid", "time_step").groupBy("txid").agg(F.min("time_step").alias("t"))
    e = table(spark, d, "txs_edgelist", "edge_id", F.col("txid1").alias("src"), F.col("txid2").alias("dst"))
    a, b = n.select(F.col("txid").alias("src"), F.col("t").alias("edge_time")), n.select(F.col("txid").alias("dst"), F.col("t").alias("_t"))
    return e.join(a, "src").join(b, "dst").select("edge_id", "src", "dst", "edge_time", (F.col("edge_time") != F.col("_t")).alias("crosses"))


# -- windowed and cumulative graph features -----------------------------------------------------------------------


def _bins_sql(size: str, value: str, prefix: str, bins=G.BINS) -> str:
    out, lo = [], 1
    for b in bins:
        cond = f"{size} > {lo} AND {size} <= {b}" if b != bins[-1] else f"{size} > {lo}"
        out.append(f"CAST(CASE WHEN {cond} THEN {value} ELSE 0 END AS BIGINT) AS {prefix}_bin{b}")
        lo = b
    return ", ".join(out)


def _counts_sql(v: str, o: str) -> str:
    return f"(SELECT a.{v} AS vertex, a.edge_time, count(DISTINCT b.{o}) AS fan, count(*) AS degree FROM (SELECT DISTINCT {v}, edge_time FROM txn) a JOIN txn b ON b.{v} = a.{v} AND b.edge_time > a.edge_time - {W} AND b.edge_time <= a.edge_time GROUP BY ALL)"


def _hist(kind: str, v: str, o: str, name: str):
    @query(name, TXN_SQL + f" SELECT vertex, edge_time, fan, degree, {_bins_sql(kind, 'degree', name.removesuffix('_hist'))} FROM {_counts_sql(v, o)}")
    def f(spark: SparkSession, d: str) -> DataFrame:
        c = G.windowed_counts(txn(spark, d), v, o, W)
        return c.select("vertex", "edge_time", "fan", "degree", *G.hist(F.col(kind), F.col("degree"), name.removesuffix("_hist")))


for _kind, _v, _o, _name in (("fan", "dst", "src", "fan_in_hist"), ("fan", "src", "dst", "fan_out_hist"), ("degree", "dst", "src", "degree_in_hist"), ("degree", "src", "dst", "degree_out_hist")):
    _hist(_kind, _v, _o, _name)


def _cumulative_sql(v: str, o: str) -> str:
    return f"""(SELECT vertex, edge_time, CAST(sum(new) OVER w AS BIGINT) AS fan, CAST(sum(n) OVER w AS BIGINT) AS degree FROM (
  SELECT {v} AS vertex, edge_time, count(*) AS n, count(DISTINCT CASE WHEN edge_time = first THEN {o} END) AS new
  FROM (SELECT *, min(edge_time) OVER (PARTITION BY {v}, {o}) AS first FROM txn) GROUP BY ALL) WINDOW w AS (PARTITION BY vertex ORDER BY edge_time ROWS UNBOUNDED PRECEDING))"""


@query("vertex_stats_cumulative", TXN_SQL + f" SELECT vertex, edge_time, 'in' AS way, fan, degree, fan / degree AS ratio FROM {_cumulative_sql('dst', 'src')} UNION ALL SELECT vertex, edge_time, 'out', fan, degree, fan / degree FROM {_cumulative_sql('src', 'dst')}")
def vertex_stats_cumulative(spark: SparkSession, d: str) -> DataFrame:
    t = txn(spark, d)
    return G.cumulative_counts(t, "dst", "src").withColumn("way", F.lit("in")).unionByName(G.cumulative_counts(t, "src", "dst").withColumn("way", F.lit("out")))


_STAT = ", ".join(f"coalesce({e}{w[0]}.{x}, 0) AS vs_{e}_{w}_{x}" for e in ("src", "dst") for w in ("out", "in") for x in ("fan", "degree"))
_ASOF = " ".join(
    f"ASOF LEFT JOIN {'co' if w == 'out' else 'ci'} {e}{w[0]} ON {e}{w[0]}.vertex = t.{e} AND {e}{w[0]}.edge_time <= t.edge_time" for e in ("src", "dst") for w in ("out", "in"))


@query("gfp_edge_features", TXN_SQL + f""", wi AS (SELECT * FROM {_counts_sql('dst', 'src')}), wo AS (SELECT * FROM {_counts_sql('src', 'dst')}),
co AS (SELECT * FROM {_cumulative_sql('src', 'dst')}), ci AS (SELECT * FROM {_cumulative_sql('dst', 'src')})
SELECT {', '.join('t.' + k for k in KEY)}, {_bins_sql('wi.fan', 'wi.degree', 'fan_in')}, {_bins_sql('wi.degree', 'wi.degree', 'degree_in')},
  {_bins_sql('wo.fan', 'wo.degree', 'fan_out')}, {_bins_sql('wo.degree', 'wo.degree', 'degree_out')}, {_STAT}
FROM txn t JOIN wi ON wi.vertex = t.dst AND wi.edge_time = t.edge_time JOIN wo ON wo.vertex = t.src AND wo.edge_time = t.edge_time {_ASOF}""")
def gfp_edge_features(spark: SparkSession, d: str) -> DataFrame:
    f = G.edge_features(txn(spark, d), W, KEY)
    return f.drop("src", "dst", "edge_time", *(c for c in f.columns if c.endswith("_ratio")))


_SG = """, e AS (SELECT DISTINCT src, dst, edge_time FROM txn WHERE src <> dst),
ps AS (SELECT DISTINCT a.src AS u, a.edge_time AS t, b.dst AS m, c.dst AS v FROM (SELECT DISTINCT src, edge_time FROM e) a JOIN e b ON b.src = a.src AND b.edge_time > a.edge_time - 7 AND b.edge_time <= a.edge_time
  JOIN e c ON c.src = b.dst AND c.edge_time > a.edge_time - 7 AND c.edge_time <= a.edge_time AND c.dst <> a.src),
pg AS (SELECT DISTINCT a.dst AS u, a.edge_time AS t, b.src AS m, c.src AS v FROM (SELECT DISTINCT dst, edge_time FROM e) a JOIN e b ON b.dst = a.dst AND b.edge_time > a.edge_time - 7 AND b.edge_time <= a.edge_time
  JOIN e c ON c.dst = b.src AND c.edge_time > a.edge_time - 7 AND c.edge_time <= a.edge_time AND c.src <> a.dst),
h AS (SELECT e.src, e.dst, e.edge_time, z.size FROM ps JOIN (SELECT u, t, v, count(*) AS size FROM ps GROUP BY ALL HAVING count(*) >= 2) z ON z.u = ps.u AND z.t = ps.t AND z.v = ps.v JOIN e ON e.src = ps.u AND e.dst = ps.m AND e.edge_time = ps.t
  UNION ALL SELECT e.src, e.dst, e.edge_time, z.size FROM pg JOIN (SELECT u, t, v, count(*) AS size FROM pg GROUP BY ALL HAVING count(*) >= 2) z ON z.u = pg.u AND z.t = pg.t AND z.v = pg.v JOIN e ON e.dst = pg.u AND e.src = pg.m AND e.edge_time = pg.t)
SELECT src, dst, edge_time, count(*) FILTER (size = 2) AS scatter_gather_bin2, count(*) FILTER (size BETWEEN 3 AND 4) AS scatter_gather_bin4, count(*) FILTER (size BETWEEN 5 AND 8) AS scatter_gather_bin8,
  count(*) FILTER (size BETWEEN 9 AND 16) AS scatter_gather_bin16, count(*) FILTER (size > 16) AS scatter_gather_bin32 FROM h GROUP BY ALL"""


@query("scatter_gather_w7", TXN_SQL + _SG)
def scatter_gather_w7(spark: SparkSession, d: str) -> DataFrame:
    return G.scatter_gather(txn(spark, d), W)


_HOP = "{x}.edge_time > a.edge_time - 7 AND {x}.edge_time <= a.edge_time"


@query("cycles_w7", TXN_SQL + f""", e AS (SELECT DISTINCT src, dst, edge_time FROM txn WHERE src <> dst),
c AS (SELECT DISTINCT a.src, a.dst, a.edge_time, 2 AS n FROM e a JOIN e b ON b.src = a.dst AND b.dst = a.src AND {_HOP.format(x='b')}
 UNION ALL SELECT src, dst, edge_time, 3 FROM (SELECT DISTINCT a.src, a.dst, a.edge_time FROM e a JOIN e b ON b.src = a.dst AND b.dst <> a.src AND {_HOP.format(x='b')} JOIN e c ON c.src = b.dst AND c.dst = a.src AND {_HOP.format(x='c')})
 UNION ALL SELECT src, dst, edge_time, 4 FROM (SELECT DISTINCT a.src, a.dst, a.edge_time FROM e a JOIN e b ON b.src = a.dst AND b.dst <> a.src AND {_HOP.format(x='b')}
   JOIN e c ON c.src = b.dst AND c.dst <> a.src AND c.dst <> a.dst AND {_HOP.format(x='c')} JOIN e f ON f.src = c.dst AND f.dst = a.src AND {_HOP.format(x='f')}))
SELECT src, dst, edge_time, count(*) FILTER (n = 2) AS closes_2, count(*) FILTER (n = 3) AS closes_3, count(*) FILTER (n = 4) AS closes_4 FROM c GROUP BY ALL""")
def cycles_w7(spark: SparkSession, d: str) -> DataFrame:
    """Whether each edge closes a cycle of 2, 3 or 4 accounts within the window."""
    return G.cycle_lengths(txn(spark, d), W)


@query("cycle_counts_w7", TXN_SQL + f""", e AS (SELECT DISTINCT src, dst, edge_time FROM txn WHERE src <> dst),
c AS (SELECT DISTINCT a.src, a.dst, a.edge_time, 2 AS n, 0 AS x, 0 AS z FROM e a JOIN e b ON b.src = a.dst AND b.dst = a.src AND {_HOP.format(x='b')}
 UNION ALL SELECT DISTINCT a.src, a.dst, a.edge_time, 3, b.dst, 0 FROM e a JOIN e b ON b.src = a.dst AND b.dst <> a.src AND {_HOP.format(x='b')} JOIN e c ON c.src = b.dst AND c.dst = a.src AND {_HOP.format(x='c')}
 UNION ALL SELECT DISTINCT a.src, a.dst, a.edge_time, 4, b.dst, c.dst FROM e a JOIN e b ON b.src = a.dst AND b.dst <> a.src AND {_HOP.format(x='b')}
   JOIN e c ON c.src = b.dst AND c.dst <> a.src AND c.dst <> a.dst AND {_HOP.format(x='c')} JOIN e f ON f.src = c.dst AND f.dst = a.src AND {_HOP.format(x='f')})
SELECT src, dst, edge_time, count(*) FILTER (n = 2) AS lc_cycle_bin2, count(*) FILTER (n > 2) AS lc_cycle_bin4 FROM c GROUP BY ALL""")
def cycle_counts_w7(spark: SparkSession, d: str) -> DataFrame:
    return G.cycles(txn(spark, d), W)


@query("cycles_w7_to10")
def cycles_w7_to10(spark: SparkSession, d: str) -> DataFrame:
    """Whether each edge closes a cycle of each length from 2 to 10 accounts within the window."""
    return G.cycle_lengths(txn(spark, d), W, 10)


@query("cycle_counts_w7_to10")
def cycle_counts_w7_to10(spark: SparkSession, d: str) -> DataFrame:
    return G.cycles(txn(spark, d), W, 10)


@query("node_fold_guarded", TXN_SQL + f""", nodes AS (SELECT src AS node, CAST(1200 AS BIGINT) AS node_time FROM txn GROUP BY src UNION SELECT dst, CAST(1200 AS BIGINT) FROM txn GROUP BY dst),
wi AS (SELECT * FROM {_counts_sql('dst', 'src')}), wo AS (SELECT * FROM {_counts_sql('src', 'dst')}),
x AS (SELECT t.src, t.dst, t.edge_time, wi.fan AS in_fan, wi.degree AS in_degree, wo.fan AS out_fan, wo.degree AS out_degree FROM txn t JOIN wi ON wi.vertex = t.dst AND wi.edge_time = t.edge_time JOIN wo ON wo.vertex = t.src AND wo.edge_time = t.edge_time),
b AS (SELECT src AS node, edge_time, 0 AS in_fan, 0 AS in_degree, out_fan, out_degree, 1 AS edges FROM x UNION ALL SELECT dst, edge_time, in_fan, in_degree, 0, 0, 1 FROM x)
SELECT n.node, n.node_time, coalesce(max(in_fan), 0) AS in_fan, coalesce(max(in_degree), 0) AS in_degree, coalesce(max(out_fan), 0) AS out_fan, coalesce(max(out_degree), 0) AS out_degree, CAST(coalesce(sum(edges), 0) AS BIGINT) AS edges
FROM nodes n LEFT JOIN b ON b.node = n.node AND n.node_time >= b.edge_time GROUP BY n.node, n.node_time""")
def node_fold_guarded(spark: SparkSession, d: str) -> DataFrame:
    t = txn(spark, d)
    nodes = t.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("node_time", F.lit(1200).cast("long"))
    ins, outs = G.windowed_counts(t, "dst", "src", W), G.windowed_counts(t, "src", "dst", W)
    x = t.select("src", "dst", "edge_time", F.lit(1).cast("long").alias("edges")).join(ins.select(F.col("vertex").alias("dst"), "edge_time", F.col("fan").alias("in_fan"), F.col("degree").alias("in_degree")), ["dst", "edge_time"])
    x = x.join(outs.select(F.col("vertex").alias("src"), "edge_time", F.col("fan").alias("out_fan"), F.col("degree").alias("out_degree")), ["src", "edge_time"])
    return G.node_fold(nodes, x, {"src": ["out_fan", "out_degree"], "dst": ["in_fan", "in_degree"]}, ["edges"])


@query("components_illicit", TXN_SQL + """, e AS (SELECT DISTINCT src AS a, dst AS b FROM txn WHERE y = 1 AND batch_id = 48 UNION SELECT dst, src FROM txn WHERE y = 1 AND batch_id = 48),
r(a, b) AS (SELECT a, a FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT a AS node, min(b) AS component FROM r GROUP BY a""")
def components_illicit(spark: SparkSession, d: str) -> DataFrame:
    return G.components(txn(spark, d).where("y = 1 and batch_id = 48").select(F.col("src").alias("u"), F.col("dst").alias("v")))


@query("components_illicit_all")
def components_illicit_all(spark: SparkSession, d: str) -> DataFrame:
    """Over all illicit edges; the recursive SQL above holds every pair of connected accounts, so it stays on one batch."""
    return G.components(txn(spark, d).where("y = 1").select(F.col("src").alias("u"), F.col("dst").alias("v")))


@query("induced_subgraph_pairs", TXN_SQL + """, a AS (SELECT DISTINCT src AS node FROM txn WHERE y = 1 AND batch_id >= 43)
SELECT src, dst, bool_or(y = 1) AS any_bad, bool_and(y = 1) AS all_bad FROM txn WHERE src <> dst AND src IN (SELECT node FROM a) AND dst IN (SELECT node FROM a) GROUP BY src, dst""")
def induced_subgraph_pairs(spark: SparkSession, d: str) -> DataFrame:
    t = txn(spark, d)
    a = t.where("y = 1 and batch_id >= 43").select(F.col("src").alias("node")).distinct()
    inside = t.where("src <> dst").join(a.withColumnRenamed("node", "src"), "src", "left_semi").join(a.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return inside.groupBy("src", "dst").agg(F.bool_or(F.col("y") == 1).alias("any_bad"), F.bool_and(F.col("y") == 1).alias("all_bad"))


@query("in_degree", TXN_SQL + " SELECT dst AS node, count(*) AS in_degree FROM txn GROUP BY dst")
def in_degree(spark: SparkSession, d: str) -> DataFrame:
    return txn(spark, d).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"))


@query("undirected_edges", TXN_SQL + " SELECT DISTINCT src, dst FROM (SELECT src, dst FROM txn UNION ALL SELECT dst, src FROM txn)")
def undirected_edges(spark: SparkSession, d: str) -> DataFrame:
    t = txn(spark, d).select("src", "dst").distinct()
    return t.unionByName(t.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


_ONE = ", v AS (SELECT src AS node, avg(amount) AS x FROM txn GROUP BY src), h1 AS (SELECT t.dst AS node, avg(v.x) AS x FROM txn t JOIN v ON v.node = t.src GROUP BY t.dst)"


def _hop0(t: DataFrame) -> DataFrame:
    return t.groupBy(F.col("src").alias("node")).agg(F.avg("amount").alias("x"))


@query("neighbour_mean_1hop", TXN_SQL + _ONE + " SELECT node, round(x, 4) AS x FROM h1")
def neighbour_mean_1hop(spark: SparkSession, d: str) -> DataFrame:
    t = txn(spark, d)
    return rnd(G.neighbour_mean(t, _hop0(t), ["x"]), x=4)


@query("neighbour_mean_2hop", TXN_SQL + _ONE + " SELECT t.dst AS node, round(avg(h1.x), 4) AS x FROM txn t JOIN h1 ON h1.node = t.src GROUP BY t.dst")
def neighbour_mean_2hop(spark: SparkSession, d: str) -> DataFrame:
    t = txn(spark, d)
    return rnd(G.neighbour_mean(t, G.neighbour_mean(t, _hop0(t), ["x"]), ["x"]), x=4)


@query("temporal_neighbours_topk", TXN_SQL + f""", few AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dst, edge_time ORDER BY {KEYS_SQL}) AS i FROM txn) WHERE i <= 5),
q AS (SELECT a.dst, a.edge_time, b.src AS neighbour, b.edge_time AS neighbour_time, row_number() OVER (PARTITION BY a.dst, a.edge_time ORDER BY b.edge_time DESC, b.i) AS k
  FROM (SELECT DISTINCT dst, edge_time FROM txn) a JOIN few b ON b.dst = a.dst AND b.edge_time <= a.edge_time)
SELECT dst, edge_time, CAST(k AS INTEGER) AS k, neighbour, neighbour_time FROM q WHERE k <= 5""")
def temporal_neighbours_topk(spark: SparkSession, d: str) -> DataFrame:
    return G.temporal_neighbours(txn(spark, d), 5, KEY)


# -- splits ---------------------------------------------------------------------------------------------------------

PART_SQL = "CASE WHEN batch_id <= 34 THEN 'train' WHEN batch_id BETWEEN 35 AND 37 THEN 'val' WHEN batch_id BETWEEN 38 AND 48 THEN 'test' END"


@query("split_temporal", TXN_SQL + f" SELECT {KEYS_SQL}, batch_id, y, {PART_SQL} AS part FROM txn WHERE y >= 0")
def split_temporal(spark: SparkSession, d: str) -> DataFrame:
    return S.split_temporal(txn(spark, d).select(*KEY, "batch_id", "y"), TRAIN_END, VAL, TEST)


@query("split_random_stratified", TXN_SQL + f""", r AS (SELECT {KEYS_SQL}, y, row_number() OVER (PARTITION BY y ORDER BY md5('7:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey), {KEYS_SQL}) AS r, count(*) OVER (PARTITION BY y) AS n FROM txn WHERE y >= 0)
SELECT {KEYS_SQL}, y, CASE WHEN r <= round(n * 0.7e0) THEN 'train' WHEN r <= round(n * 0.85e0) THEN 'val' ELSE 'test' END AS part FROM r""")
def split_random_stratified(spark: SparkSession, d: str) -> DataFrame:
    u = txn(spark, d).select(*KEY, "y")
    ids = KEY[:-1]
    h = S.split_random(u.withColumn("_price", F.col("l_extendedprice")), ids, 7)
    return h.select(*KEY, "y", "part")


@query("split_rolling_steps", TXN_SQL + f""", s AS (SELECT unnest(range(38, 49)) AS step)
SELECT CAST(step AS INTEGER) AS step, CASE WHEN batch_id <= step - 4 THEN 'train' WHEN batch_id < step THEN 'val' ELSE 'test' END AS part, count(*) AS n, count(*) FILTER (y = 1) AS n_pos FROM txn, s WHERE y >= 0 AND batch_id <= step GROUP BY ALL""")
def split_rolling_steps(spark: SparkSession, d: str) -> DataFrame:
    r = S.split_rolling(txn(spark, d).select("batch_id", "y"), S.rolling_steps(TRAIN_END, 3, TEST))
    return r.groupBy("step", "part").agg(F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("n_pos"))


@query("leakage_report", TXN_SQL + f""", s AS (SELECT {KEYS_SQL}, batch_id, y, {PART_SQL} AS part FROM txn WHERE y >= 0)
SELECT count(*) FILTER (part = 'train') AS n_train, count(*) FILTER (part = 'val') AS n_val, count(*) FILTER (part = 'test') AS n_test,
 count(*) FILTER (part = 'train' AND y = 1) AS pos_train, count(*) FILTER (part = 'val' AND y = 1) AS pos_val, count(*) FILTER (part = 'test' AND y = 1) AS pos_test, count(*) FILTER (y < 0) AS unlabelled,
 max(batch_id) FILTER (part = 'train') < min(batch_id) FILTER (part = 'val') AS train_before_val, max(batch_id) FILTER (part = 'val') < min(batch_id) FILTER (part = 'test') AS val_before_test,
 (SELECT count(*) FROM (SELECT 1 FROM s GROUP BY {KEYS_SQL} HAVING count(DISTINCT part) > 1)) AS overlapping FROM s""")
def leakage_report(spark: SparkSession, d: str) -> DataFrame:
    return S.leakage_report(split_temporal(spark, d), KEY)


@query("leakage_joining_edges", """WITH n AS (SELECT txid, min(time_step) AS t FROM txs_features WHERE txid IS NOT NULL GROUP BY txid),
s AS (SELECT txid, CASE WHEN t <= 29 THEN 'train' WHEN t <= 34 THEN 'val' ELSE 'test' END AS part FROM n)
SELECT a.part AS src_part, b.part AS dst_part, count(*) AS edges FROM txs_edgelist e JOIN s a ON a.txid = e.txid1 JOIN s b ON b.txid = e.txid2 GROUP BY ALL""")
def leakage_joining_edges(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "txs_features", "txid", "time_step").where("txid is not null").groupBy("txid").agg(F.min("time_step").alias("t"))
    s = n.select("txid", S.temporal_part(F.col("t"), 29, (30, 34), (35, 49)).alias("part"))
    e = table(spark, d, "txs_edgelist", "txid1", "txid2")
    a, b = s.select(F.col("txid").alias("txid1"), F.col("part").alias("src_part")), s.select(F.col("txid").alias("txid2"), F.col("part").alias("dst_part"))
    return e.join(a, "txid1").join(b, "txid2").groupBy("src_part", "dst_part").agg(F.count("*").alias("edges"))


@query("class_weight", TXN_SQL + " SELECT count(*) FILTER (y = 0) AS n_neg, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) / count(*) FILTER (y = 1) AS weight FROM txn WHERE y >= 0 AND batch_id <= 34")
def class_weight(spark: SparkSession, d: str) -> DataFrame:
    t = txn(spark, d).where(f"y >= 0 and batch_id <= {TRAIN_END}")
    return t.agg(F.count_if(F.col("y") == 0).alias("n_neg"), F.count_if(F.col("y") == 1).alias("n_pos")).withColumn("weight", F.col("n_neg") / F.col("n_pos"))


@query("zscore_train_only", TXN_SQL + f""", s AS (SELECT avg(amount) AS m, CASE WHEN stddev_pop(amount) = 0 THEN 1 ELSE stddev_pop(amount) END AS d FROM txn WHERE y >= 0 AND batch_id <= 34)
SELECT {KEYS_SQL}, round((amount - m) / d, 6) AS z FROM txn, s""")
def zscore_train_only(spark: SparkSession, d: str) -> DataFrame:
    t = txn(spark, d)
    s = t.where(f"y >= 0 and batch_id <= {TRAIN_END}").agg(F.avg("amount").alias("_m"), F.stddev_pop("amount").alias("_d"))
    z = (F.col("amount") - F.col("_m")) / F.when(F.col("_d") == 0, 1.0).otherwise(F.col("_d"))
    return t.crossJoin(F.broadcast(s)).select(*KEY, F.round(z, 6).alias("z"))  # one row


# -- evaluation -------------------------------------------------------------------------------------------------------

STEPS_SQL = """, v AS (SELECT * FROM scored WHERE part = 'val'), g AS (SELECT p, CAST(sum(y) AS BIGINT) AS pos, count(*) AS n FROM v GROUP BY p),
c AS (SELECT p, pos, n, CAST(sum(pos) OVER (ORDER BY p DESC) AS BIGINT) AS tp, CAST(sum(n) OVER (ORDER BY p DESC) AS BIGINT) AS m, CAST(sum(pos) OVER () AS BIGINT) AS ap, CAST(sum(n) OVER () AS BIGINT) AS an FROM g)"""
THR_SQL = STEPS_SQL + ", thr AS (SELECT arg_max(p, (2 * tp / (m + ap), p)) AS thr FROM c)"


@query("pr_curve", TXN_SQL + STEPS_SQL + " SELECT p, tp / m AS precision, tp / ap AS recall, 2 * tp / (m + ap) AS f1 FROM c")
def pr_curve(spark: SparkSession, d: str) -> DataFrame:
    return E.pr_curve(scored(spark, d).where("part = 'val'")).select("p", "precision", "recall", "f1")


@query("threshold_val", TXN_SQL + THR_SQL + " SELECT thr AS threshold, (SELECT max(2 * tp / (m + ap)) FROM c) AS f1 FROM thr")
def threshold_val(spark: SparkSession, d: str) -> DataFrame:
    return E.choose_threshold(scored(spark, d).where("part = 'val'"))


@query("average_precision", TXN_SQL + STEPS_SQL + " SELECT round(sum(pos * tp / m) / max(ap), 9) AS pr_auc FROM c")
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    return rnd(E.rank_metrics(scored(spark, d).where("part = 'val'")).select("pr_auc"), pr_auc=9)


@query("roc_auc", TXN_SQL + STEPS_SQL + " SELECT round(sum(pos * ((an - ap) - (m - tp)) + 0.5e0 * pos * (n - pos)) / (max(ap) * (max(an) - max(ap))), 9) AS roc_auc FROM c")
def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return rnd(E.rank_metrics(scored(spark, d).where("part = 'val'")).select("roc_auc"), roc_auc=9)


@query("precision_at_recall", TXN_SQL + STEPS_SQL + " SELECT r.recall, (SELECT arg_max(tp / m, p) FROM c WHERE tp / ap >= r.recall) AS precision FROM (SELECT unnest([5e-1, 8e-1]) AS recall) r")
def precision_at_recall(spark: SparkSession, d: str) -> DataFrame:
    return E.precision_at_recall(scored(spark, d).where("part = 'val'"), [0.5, 0.8])


def _threshold(spark: SparkSession, d: str) -> float:
    return E.choose_threshold(scored(spark, d).where("part = 'val'")).first()["threshold"]


CONF_SQL = "coalesce(count(*) FILTER (p >= thr AND y = 1) / nullif(count(*) FILTER (p >= thr), 0), 0) AS precision, coalesce(count(*) FILTER (p >= thr AND y = 1) / nullif(count(*) FILTER (y = 1), 0), 0) AS recall, coalesce(2 * count(*) FILTER (p >= thr AND y = 1) / nullif(count(*) FILTER (p >= thr) + count(*) FILTER (y = 1), 0), 0) AS f1, count(*) AS n, count(*) FILTER (y = 1) AS n_pos"


@query("confusion_metrics", TXN_SQL + THR_SQL + f" SELECT {CONF_SQL} FROM scored, thr WHERE part = 'test'")
def confusion_metrics(spark: SparkSession, d: str) -> DataFrame:
    return E.confusion(scored(spark, d).where("part = 'test'"), F.lit(_threshold(spark, d)))


AP_BY = """, gt AS (SELECT time, p, sum(y) AS pos, count(*) AS n FROM scored GROUP BY ALL), ct AS (SELECT time, p, pos, n, sum(pos) OVER w AS tp, sum(n) OVER w AS m, sum(pos) OVER (PARTITION BY time) AS ap, sum(n) OVER (PARTITION BY time) AS an FROM gt WINDOW w AS (PARTITION BY time ORDER BY p DESC)),
apt AS (SELECT time, round(CAST(sum(pos * tp / m) / nullif(max(ap), 0) AS DOUBLE), 9) AS pr_auc FROM ct GROUP BY time)"""
CURVE_SQL = THR_SQL + AP_BY + f", curve AS (SELECT s.*, apt.pr_auc FROM (SELECT time, {CONF_SQL} FROM scored, thr GROUP BY time) s JOIN apt USING (time))"


def curve(spark: SparkSession, d: str) -> DataFrame:
    return E.per_timestep(scored(spark, d), F.lit(_threshold(spark, d)))


@query("curve_per_batch", TXN_SQL + CURVE_SQL + " SELECT time, f1, pr_auc, n, n_pos FROM curve")
def curve_per_batch(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: threshold from validation, then metrics of every batch."""
    return rnd(curve(spark, d), pr_auc=9)


@query("event_windows", TXN_SQL + THR_SQL + f""", w AS (SELECT *, CASE WHEN time < {EVENT} THEN 'before' ELSE 'after' END AS win FROM scored WHERE part = 'test'),
gw AS (SELECT win, p, sum(y) AS pos, count(*) AS n FROM w GROUP BY ALL), cw AS (SELECT win, p, pos, n, sum(pos) OVER x AS tp, sum(n) OVER x AS m, sum(pos) OVER (PARTITION BY win) AS ap, sum(n) OVER (PARTITION BY win) AS an FROM gw WINDOW x AS (PARTITION BY win ORDER BY p DESC)),
rw AS (SELECT win, round(CAST(sum(pos * ((an - ap) - (m - tp)) + 0.5e0 * pos * (n - pos)) / (max(ap) * (max(an) - max(ap))) AS DOUBLE), 9) AS roc_auc FROM cw GROUP BY win)
SELECT w.win AS "window", count(*) AS n, count(*) FILTER (y = 1) AS n_pos, any_value(roc_auc) AS roc_auc, count(*) FILTER (y = 1 AND p >= thr) / count(*) FILTER (y = 1) AS recall, round(quantile_cont(p, 0.5) FILTER (y = 1), 9) AS pos_median FROM w JOIN rw ON rw.win = w.win, thr GROUP BY w.win""")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return rnd(E.event_windows(scored(spark, d).where("part = 'test'"), EVENT, F.lit(_threshold(spark, d))), roc_auc=9, pos_median=9)


@query("alert_load", TXN_SQL + STEPS_SQL + ", q AS (SELECT r.recall, (SELECT arg_max(tp / m, p) FROM c WHERE tp / ap >= r.recall) AS precision FROM (SELECT unnest([5e-1, 8e-1]) AS recall) r) SELECT recall, precision, 1 / precision AS alerts_per_case FROM q")
def alert_load(spark: SparkSession, d: str) -> DataFrame:
    return R.alert_load(E.precision_at_recall(scored(spark, d).where("part = 'val'"), [0.5, 0.8]))


# -- results over seeds ------------------------------------------------------------------------------------------------

RUNS = [("elliptic", "temporal", m, f, s, k, v + 0.01 * s, f"fv_{'new' if s else 'old'}", "h1", "c1") for m, f, v in (("gbt", "base", 0.5), ("sage", "base_gfp", 0.6)) for s in range(3) for k, v in (("f1", v), ("pr_auc", v + 0.1), ("roc_auc", v + 0.2))]
RUN_COLS = "dataset, regime, model, features, seed, metric, value, feature_version, split_hash, commit"
RUNS_SQL = f"WITH runs({RUN_COLS}) AS (VALUES " + ", ".join("(" + ", ".join(repr(x) if isinstance(x, (str, int)) else f"{x!r}e0" for x in r) + ")" for r in RUNS) + ")"


def runs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RUNS, "dataset string, regime string, model string, features string, seed int, metric string, value double, feature_version string, split_hash string, commit string")


T2 = repr(t_quantile(0.975, 2)) + "e0"
CI = f"round(avg(value), 9) AS seed_mean, round(avg(value) - {T2} * stddev_samp(value) / sqrt(count(*)), 9) AS ci_low, round(avg(value) + {T2} * stddev_samp(value) / sqrt(count(*)), 9) AS ci_high, count(*) AS n_seeds"


@query("seed_interval", RUNS_SQL + f" SELECT model, features, metric, {CI} FROM runs GROUP BY ALL")
def seed_interval(spark: SparkSession, d: str) -> DataFrame:
    return rnd(E.seed_interval(runs(spark), ["model", "features", "metric"], "value"), seed_mean=9, ci_low=9, ci_high=9)


@query("paired_gap", RUNS_SQL + f", g AS (SELECT a.metric, b.value - a.value AS value FROM runs a JOIN runs b ON a.seed = b.seed AND a.metric = b.metric WHERE a.model = 'gbt' AND b.model = 'sage') SELECT metric, {CI} FROM g GROUP BY metric")
def paired_gap(spark: SparkSession, d: str) -> DataFrame:
    r = runs(spark)
    a, b = r.where("model = 'gbt'").select("seed", "metric", F.col("value").alias("_a")), r.where("model = 'sage'").select("seed", "metric", F.col("value").alias("_b"))
    gap = a.join(b, ["seed", "metric"]).withColumn("value", F.col("_b") - F.col("_a"))
    return rnd(E.seed_interval(gap, ["metric"], "value"), seed_mean=9, ci_low=9, ci_high=9)


@query("results_table", RUNS_SQL + f" SELECT dataset, regime, model, features, metric, {CI}, 'seed_t95' AS ci_kind, string_agg(DISTINCT feature_version, '|' ORDER BY feature_version) AS feature_version, string_agg(DISTINCT split_hash, '|') AS split_hash, string_agg(DISTINCT commit, '|') AS commit FROM runs GROUP BY ALL")
def results_table(spark: SparkSession, d: str) -> DataFrame:
    return rnd(R.results_table(runs(spark)), seed_mean=9, ci_low=9, ci_high=9)


@query("results_wide", RUNS_SQL + f", r AS (SELECT model, features, metric, format('{{:.4f}} ± {{:.4f}}', avg(value), {T2} * stddev_samp(value) / sqrt(count(*))) AS cell FROM runs GROUP BY ALL) SELECT model, features, max(cell) FILTER (metric = 'f1') AS f1, max(cell) FILTER (metric = 'pr_auc') AS pr_auc FROM r GROUP BY ALL")
def results_wide(spark: SparkSession, d: str) -> DataFrame:
    return R.results_wide(R.results_table(runs(spark)), ["model", "features"], ["f1", "pr_auc"])


# -- drift ---------------------------------------------------------------------------------------------------------------

FEATURES = ["amount", "quantity", "discount", "tax"]
REF = list(range(VAL[0], VAL[1] + 1))


def drift_units(spark: SparkSession, d: str) -> DataFrame:
    return txn(spark, d).where(F.col("batch_id").between(VAL[0], TEST[1])).select("batch_id", "p", *FEATURES)


LONG_SQL = ", long AS (SELECT batch_id, unnest(['amount', 'quantity', 'discount', 'tax']) AS \"column\", unnest([amount, quantity, discount, tax]) AS value FROM txn WHERE batch_id BETWEEN 35 AND 48)"
PSI_SQL = LONG_SQL + """, q AS (SELECT "column", list_distinct(quantile_cont(value, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])) AS q FROM long WHERE batch_id <= 37 GROUP BY "column"),
cu AS (SELECT "column", CASE WHEN len(q) > 1 THEN list_sort(q)[1:len(q) - 1] ELSE q END AS cuts FROM q),
bn AS (SELECT l.batch_id, l."column", len(list_filter(cuts, lambda c: c < value)) AS b FROM long l JOIN cu ON cu."column" = l."column"),
rs AS (SELECT "column", b, count(*) / sum(count(*)) OVER (PARTITION BY "column") AS r FROM bn WHERE batch_id <= 37 GROUP BY "column", b),
cs AS (SELECT batch_id, "column", b, count(*) / sum(count(*)) OVER (PARTITION BY batch_id, "column") AS c FROM bn WHERE batch_id > 37 GROUP BY batch_id, "column", b),
gr AS (SELECT DISTINCT batch_id, "column" FROM cs), rg AS (SELECT batch_id, rs.* FROM gr JOIN rs ON rs."column" = gr."column"),
fu AS (SELECT coalesce(rg.batch_id, cs.batch_id) AS batch_id, coalesce(rg."column", cs."column") AS "column", greatest(coalesce(r, 0), 1e-4) AS r, greatest(coalesce(c, 0), 1e-4) AS c FROM rg FULL JOIN cs ON cs.batch_id = rg.batch_id AND cs."column" = rg."column" AND cs.b = rg.b),
psi AS (SELECT batch_id, "column", sum((c - r) * ln(c / r)) AS psi FROM fu GROUP BY ALL)"""


@query("psi_per_column", TXN_SQL + PSI_SQL + ' SELECT batch_id, "column", round(psi, 9) AS psi FROM psi')
def psi_per_column(spark: SparkSession, d: str) -> DataFrame:
    long = D.unpivot(drift_units(spark, d), ["batch_id"], FEATURES)
    return rnd(D.psi(long.where(f"batch_id <= {VAL[1]}").drop("batch_id"), long.where(f"batch_id > {VAL[1]}"), by=["batch_id"]), psi=9)


KS_SQL = """, vals AS (SELECT {keys}, value FROM {src}), ksg AS (SELECT DISTINCT batch_id, "column" FROM vals WHERE batch_id > 37),
kp AS (SELECT g.batch_id, g."column", v.value, 1 AS r, 0 AS c FROM ksg g JOIN vals v ON v."column" = g."column" AND v.batch_id <= 37 UNION ALL SELECT batch_id, "column", value, 0, 1 FROM vals WHERE batch_id > 37),
kd AS (SELECT batch_id, "column", value, sum(sum(r)) OVER w AS fr, sum(sum(c)) OVER w AS fc, sum(sum(r)) OVER (PARTITION BY batch_id, "column") AS nr, sum(sum(c)) OVER (PARTITION BY batch_id, "column") AS nc FROM kp GROUP BY batch_id, "column", value WINDOW w AS (PARTITION BY batch_id, "column" ORDER BY value)),
ks AS (SELECT batch_id, "column", max(abs(fr / nr - fc / nc)) AS d, CAST(any_value(nr) AS BIGINT) AS n_ref, CAST(any_value(nc) AS BIGINT) AS n_cur FROM kd GROUP BY ALL)"""


@query("ks_stat", TXN_SQL + LONG_SQL + KS_SQL.format(keys='batch_id, "column"', src="long") + ' SELECT batch_id, "column", round(d, 9) AS d, n_ref, n_cur FROM ks')
def ks_stat(spark: SparkSession, d: str) -> DataFrame:
    long = D.unpivot(drift_units(spark, d), ["batch_id"], FEATURES)
    return rnd(D.ks(long.where(f"batch_id <= {VAL[1]}").drop("batch_id"), long.where(f"batch_id > {VAL[1]}"), ["batch_id"]), d=9)


CONF_KS = ", sc AS (SELECT batch_id, 'p' AS \"column\", p AS value FROM txn WHERE batch_id BETWEEN 35 AND 48)" + KS_SQL.format(keys='batch_id, "column"', src="sc")


@query("conf_shift", TXN_SQL + CONF_KS + " SELECT batch_id, round(d, 9) AS score FROM ks")
def conf_shift(spark: SparkSession, d: str) -> DataFrame:
    return rnd(D.detector_scores(drift_units(spark, d), FEATURES, REF, F.lit(0.5), detectors=("conf",)).drop("detector"), score=9)


ALERT_SQL = ", al AS (SELECT b.batch_id, abs(ln(b.rate + 1e-4) - ln(r.rate + 1e-4)) AS score FROM (SELECT batch_id, count(*) FILTER (p >= thr) / count(*) AS rate FROM txn, thr WHERE batch_id BETWEEN 38 AND 48 GROUP BY batch_id) b, (SELECT count(*) FILTER (p >= thr) / count(*) AS rate FROM txn, thr WHERE batch_id BETWEEN 35 AND 37) r)"


@query("alert_shift", TXN_SQL + THR_SQL + ALERT_SQL + " SELECT batch_id, round(score, 9) AS score FROM al")
def alert_shift(spark: SparkSession, d: str) -> DataFrame:
    return rnd(D.detector_scores(drift_units(spark, d), FEATURES, REF, F.lit(_threshold(spark, d)), detectors=("alert",)).drop("detector"), score=9)


@query("ks_frac")
def ks_frac(spark: SparkSession, d: str) -> DataFrame:
    """Share of columns whose KS p-value is below 1 %; the p-value is numeric, so there is no SQL for it."""
    return D.detector_scores(drift_units(spark, d), FEATURES, REF, F.lit(0.5), detectors=("ks",))


FIXED = {"psi": 0.2, "ks": 0.2, "conf": 0.1, "alert": 0.5}


def flagged(scores: DataFrame) -> DataFrame:
    level = F.create_map(*[F.lit(x) for kv in FIXED.items() for x in kv])[F.col("detector")]
    return scores.withColumn("threshold", level).withColumn("flagged", F.col("score") > F.col("threshold"))


DET_SQL = THR_SQL + PSI_SQL + CONF_KS + ALERT_SQL + """, det AS (SELECT 'psi' AS detector, batch_id, max(psi) AS score, 2e-1 AS threshold FROM psi GROUP BY batch_id UNION ALL SELECT 'conf', batch_id, d, 1e-1 FROM ks UNION ALL SELECT 'alert', batch_id, score, 5e-1 FROM al)"""
THREE = ("psi", "conf", "alert")


@query("detector_scores", TXN_SQL + DET_SQL + " SELECT detector, batch_id, round(score, 9) AS score, score > threshold AS flagged, threshold FROM det")
def detector_scores(spark: SparkSession, d: str) -> DataFrame:
    return rnd(flagged(D.detector_scores(drift_units(spark, d), FEATURES, REF, F.lit(_threshold(spark, d)), detectors=THREE)), score=9)


@query("detector_calibrated")
def detector_calibrated(spark: SparkSession, d: str) -> DataFrame:
    """Detectors flagged against the greatest score of a reference batch left out."""
    u, thr = drift_units(spark, d), F.lit(_threshold(spark, d))
    level = D.calibrate(u, FEATURES, REF, thr)
    return D.detector_scores(u, FEATURES, REF, thr).join(F.broadcast(level), "detector").withColumn("flagged", F.col("score") > F.col("level"))  # a row a detector


RUN2 = "(SELECT min({t}) FROM (SELECT {t}, {hit} AND lead({hit}, 1, false) OVER (ORDER BY {t}) AS ok FROM {src}) WHERE ok)"


@query("lead_time", TXN_SQL + DET_SQL + AP_BY + f""", cv AS (SELECT time, coalesce(2 * count(*) FILTER (p >= thr AND y = 1) / nullif(count(*) FILTER (p >= thr) + count(*) FILTER (y = 1), 0), 0) AS f1 FROM scored, thr GROUP BY time),
ref AS (SELECT avg(f1) AS ref_f1 FROM cv WHERE time <= 37), dr AS (SELECT min(time) AS first_drop FROM (SELECT time, f1 < 0.8e0 * ref_f1 AND lead(f1 < 0.8e0 * ref_f1, 1, false) OVER (ORDER BY time) AS ok FROM cv, ref WHERE time >= 38) WHERE ok),
fl AS (SELECT detector, min(batch_id) FILTER (ok) AS first_flag FROM (SELECT detector, batch_id, score > threshold AND lead(score > threshold, 1, false) OVER (PARTITION BY detector ORDER BY batch_id) AS ok FROM det) GROUP BY detector)
SELECT detector, first_flag, first_drop, first_drop - first_flag AS lead, round(0.8e0 * ref_f1, 9) AS drop_level, round(ref_f1, 9) AS ref_f1 FROM fl, dr, ref""")
def lead_time(spark: SparkSession, d: str) -> DataFrame:
    c = curve(spark, d)
    ref = c.where(f"time <= {VAL[1]}").agg(F.avg("f1")).first()[0]
    s = flagged(D.detector_scores(drift_units(spark, d), FEATURES, REF, F.lit(_threshold(spark, d)), detectors=THREE))
    return rnd(D.lead_time(c.where(f"time >= {TEST[0]}"), s, ref), drop_level=9, ref_f1=9)


@query("first_run", TXN_SQL + CURVE_SQL + " SELECT min(time) AS first FROM (SELECT time, f1 < 0.5e0 AND lead(f1 < 0.5e0, 1, false) OVER (ORDER BY time) AS ok FROM curve) WHERE ok")
def first_run(spark: SparkSession, d: str) -> DataFrame:
    c = curve(spark, d).select("time", F.lit(0).alias("k"), (F.col("f1") < 0.5).alias("hit"))
    return D.first_run(c, ["k"], "time", "hit", 2).select("first")


# -- alerts ---------------------------------------------------------------------------------------------------------------


@query("alert_queue", TXN_SQL + THR_SQL + f" SELECT CAST(row_number() OVER (ORDER BY p DESC, {KEYS_SQL}) AS INTEGER) AS rank, {KEYS_SQL}, round(p, 6) AS p, src, dst FROM txn, thr WHERE batch_id = 38 AND p >= thr")
def alert_queue(spark: SparkSession, d: str) -> DataFrame:
    day = txn(spark, d).where("batch_id = 38").select(*KEY, "p", "src", "dst")
    return rnd(R.alert_queue(day, F.lit(_threshold(spark, d)), KEY), p=6)


@query("alert_top25", TXN_SQL + f" SELECT CAST(row_number() OVER (ORDER BY p DESC, {KEYS_SQL}) AS INTEGER) AS rank, {KEYS_SQL} FROM txn WHERE batch_id = 38 AND p >= 5e-1 ORDER BY p DESC, {KEYS_SQL} LIMIT 25")
def alert_top25(spark: SparkSession, d: str) -> DataFrame:
    return R.alert_queue(txn(spark, d).where("batch_id = 38").select(*KEY, "p"), F.lit(0.5), KEY, top=25).drop("p")


@query("alert_top_features", TXN_SQL + f""", c AS (SELECT {KEYS_SQL}, unnest(['amount', 'discount', 'quantity', 'tax']) AS name, unnest([amount / 1e5, discount * 10 - 5e-1, quantity / 5e1, 5e-1 - tax * 10]) AS v FROM txn WHERE batch_id = 38),
r AS (SELECT *, row_number() OVER (PARTITION BY {KEYS_SQL} ORDER BY v DESC, name) AS k FROM c)
SELECT {KEYS_SQL}, string_agg(printf('%s %+.2f', name, v), '; ' ORDER BY k) AS top_features FROM r WHERE k <= 3 GROUP BY ALL""")
def alert_top_features(spark: SparkSession, d: str) -> DataFrame:
    t = txn(spark, d).where("batch_id = 38")
    contrib = {"amount": F.col("amount") / 1e5, "discount": F.col("discount") * 10 - 0.5, "quantity": F.col("quantity") / 50, "tax": 0.5 - F.col("tax") * 10}
    return t.select(*KEY, R.top_features(contrib).alias("top_features"))


# -- models: no SQL says what they learn, so their rows only are checked, and their properties in the tests ---------------

MODEL_FEATURES = ["amount", "quantity", "discount", "tax", "dst_fan", "dst_degree", "src_fan", "src_degree"]


def model_columns(e: DataFrame, *more: str) -> DataFrame:
    """What models read of causal_edge_inputs, and more."""
    key = [F.col(c).alias(k) for c, k in zip(("o", "line", "part", "dst", "amount"), KEY)]
    return e.select(*key, batch_of(F.col("edge_time")).alias("batch_id"), "y", *MODEL_FEATURES, *more)


def model_rows(spark: SparkSession, d: str) -> DataFrame:
    """Labelled payments with what models read of them, written once; their key only from the test batches on."""
    from ..models import sage

    return model_columns(sage.causal_edge_inputs(model_edges(spark, d, TEST[0])))


@query("gbt_scores")
def gbt_scores(spark: SparkSession, d: str) -> DataFrame:
    """Test batches scored by boosted trees fitted on train, their number chosen on validation."""
    from ..models import trees

    rows = S.split_temporal(model_rows(spark, d), TRAIN_END, VAL, TEST).select(*KEY, "batch_id", "y", "part", *MODEL_FEATURES)
    m = trees.fit(rows.where("part = 'train'"), rows.where("part = 'val'"), MODEL_FEATURES, n_trees=20)
    return m.transform(rows.where("part = 'test'")).select(*KEY, "batch_id", "y", F.col("p").alias("proba"))


@query("tree_contributions")
def tree_contributions(spark: SparkSession, d: str) -> DataFrame:
    """What moved the scores of one batch, by exact path contributions."""
    from ..models import trees

    rows = S.split_temporal(model_rows(spark, d), TRAIN_END, VAL, TEST).select(*KEY, "batch_id", "y", "part", *MODEL_FEATURES)
    m = trees.fit(rows.where("part = 'train'"), rows.where("part = 'val'"), MODEL_FEATURES, n_trees=10)
    return m.explain(rows.where("batch_id = 38")).select(*KEY, "base", "logit", "contributions", "top_features")


@query("sage_lite_scores")
def sage_lite_scores(spark: SparkSession, d: str) -> DataFrame:
    """Test batches scored by message passing between accounts over all payments so far, fitted on train and stopped on validation."""
    from ..models import sage, sage_edge

    e = model_edges(spark, d, TEST[0])
    graph = sage_edge.neighbourhoods(e)  # of all payments, before those without a label are left out
    rows = S.split_temporal(model_columns(sage.causal_edge_inputs(e), "src", "dst", "edge_time"), TRAIN_END, VAL, TEST)
    m = sage_edge.fit(graph, rows, MODEL_FEATURES)
    return m.score(rows.where("part = 'test'")).select(*KEY, "batch_id", "y", F.col("p").alias("proba"))


@query("probe_auc")
def probe_auc(spark: SparkSession, d: str) -> DataFrame:
    """Cross-validated AUC inside each event window."""
    from ..models import trees

    t = txn(spark, d).where((F.col("y") >= 0) & F.col("batch_id").between(*TEST)).select(*KEY, "batch_id", "y", *FEATURES)
    out = [(w, trees.probe_auc(t.where(c), KEY, FEATURES, n_trees=3)) for w, c in (("before", f"batch_id < {EVENT}"), ("after", f"batch_id >= {EVENT}"))]
    return spark.createDataFrame(out, "window string, probe_roc_auc double")


@query("streaming_daily_scores", """SELECT CAST(date_trunc('day', ts) AS DATE) AS day, user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def streaming_daily_scores(spark: SparkSession, d: str) -> DataFrame:
    """Daily sums per user by the stream plan, run to the end of what there is."""
    from ..streaming.daily import daily_totals, run_available

    return rnd(run_available(daily_totals, spark, f"{d}/events.parquet", ["day", "user_id"]), total=4)


@query("streaming_causal_counts", """SELECT user_id, edge_time, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY edge_time) AS BIGINT) AS degree FROM
(SELECT user_id, date_diff('day', (SELECT CAST(min(ts) AS DATE) FROM events), CAST(ts AS DATE)) AS edge_time, count(*) AS n FROM events GROUP BY ALL)""")
def streaming_causal_counts(spark: SparkSession, d: str) -> DataFrame:
    """The forward-only driver: batches in order, each inserted and then scored against all so far."""
    from ..streaming.forward import replay_counts

    return replay_counts(spark, d)
