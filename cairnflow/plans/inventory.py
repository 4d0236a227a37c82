"""Further operators of the engine as named queries: order and uniqueness, codes, folds, figures' aggregates, chosen days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import t_quantile
from ..operators import checks as C
from ..operators import evaluation as E
from ..operators import graph as G
from ..operators import reporting as R
from ..operators import splits as S
from ..session import table
from .catalog import FEATURES, W, _bins_sql, _counts_sql, _cumulative_sql, rnd
from .txn import EVENT, KEY, TEST, TXN_SQL, VAL, scored, txn

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


# -- order and uniqueness ---------------------------------------------------------------------------------------------


@query("edges_stable_order", "SELECT edge_id, row_number() OVER (ORDER BY time_step, edge_id) - 1 AS position FROM txs_edgelist WHERE time_step IS NOT NULL")
def edges_stable_order(spark: SparkSession, d: str) -> DataFrame:
    """Edges by time; those of one time in the order they arrived in."""
    e = table(spark, d, "txs_edgelist", "edge_id", "time_step").where("time_step is not null")
    return C.positions(e, ["time_step", "edge_id"]).select("edge_id", "position")


@query("edges_lexical_order", """SELECT edge_id, row_number() OVER (ORDER BY time_step, txid1, txid2, edge_id) - 1 AS position FROM txs_edgelist
WHERE time_step IS NOT NULL AND txid1 IS NOT NULL AND txid2 IS NOT NULL""")
def edges_lexical_order(spark: SparkSession, d: str) -> DataFrame:
    """Edges by time, then by their ends."""
    e = table(spark, d, "txs_edgelist", "edge_id", "time_step", "txid1", "txid2").na.drop()
    return C.positions(e, ["time_step", "txid1", "txid2", "edge_id"]).select("edge_id", "position")


@query("repeated_ids", "SELECT txid, count(*) AS times FROM txs_features GROUP BY txid HAVING count(*) > 1")
def repeated_ids(spark: SparkSession, d: str) -> DataFrame:
    return C.repeated(table(spark, d, "txs_features", "txid"), ["txid"])


@query("repeated_edges", "SELECT txid1, txid2, count(*) AS times FROM txs_edgelist GROUP BY txid1, txid2 HAVING count(*) > 1")
def repeated_edges(spark: SparkSession, d: str) -> DataFrame:
    return C.repeated(table(spark, d, "txs_edgelist", "txid1", "txid2"), ["txid1", "txid2"])


@query("edge_order_check", """SELECT count(*) AS rows, count(*) FILTER (loaded_at < before) AS breaks FROM (
  SELECT loaded_at, lag(loaded_at) OVER (ORDER BY edge_id) AS before FROM txs_edgelist WHERE loaded_at IS NOT NULL AND edge_id IS NOT NULL)""")
def edge_order_check(spark: SparkSession, d: str) -> DataFrame:
    """How many edges were loaded before the one numbered before them."""
    return C.order_breaks(table(spark, d, "txs_edgelist", "edge_id", "loaded_at").where("edge_id is not null"), "edge_id", F.col("loaded_at"))


@query("release_counts", """SELECT (SELECT count(*) FROM (SELECT DISTINCT txid FROM txs_features WHERE txid IS NOT NULL)) AS nodes, (SELECT count(*) FROM txs_edgelist) AS edges,
  (SELECT count(DISTINCT time_step) FROM txs_features) AS steps, (SELECT count(*) FILTER (class = 1) FROM txs_classes) AS illicit, (SELECT count(*) FILTER (class = 2) FROM txs_classes) AS licit, (SELECT count(*) FILTER (class = 3) FROM txs_classes) AS unknown""")
def release_counts(spark: SparkSession, d: str) -> DataFrame:
    """The counts a published release is told by."""
    f = table(spark, d, "txs_features", "txid", "time_step").agg(F.count_distinct("txid").alias("nodes"), F.count_distinct("time_step").alias("steps"))
    e = table(spark, d, "txs_edgelist", "edge_id").agg(F.count("*").alias("edges"))
    c = table(spark, d, "txs_classes", "class").agg(*(F.count_if(F.col("class") == k).alias(n) for k, n in ((1, "illicit"), (2, "licit"), (3, "unknown"))))
    return f.crossJoin(F.broadcast(e)).crossJoin(F.broadcast(c)).select("nodes", "edges", "steps", "illicit", "licit", "unknown")  # one row each


# -- codes --------------------------------------------------------------------------------------------------------------

_KEY_SQL = "upper(trim({b})) || ':' || upper(trim({a}))"


@query("account_codes", f"""WITH k AS (
  SELECT {_KEY_SQL.format(b='from_bank', a='from_account')} AS account_key, 0 AS side, trans_id FROM hi_small_trans UNION ALL
  SELECT {_KEY_SQL.format(b='to_bank', a='to_account')}, 1, trans_id FROM hi_small_trans
), f AS (SELECT account_key, min(CAST(side AS BIGINT) * 4611686018427387904 + trans_id) AS first FROM k WHERE account_key IS NOT NULL AND trans_id IS NOT NULL GROUP BY account_key)
SELECT account_key, row_number() OVER (ORDER BY first) - 1 AS code FROM f""")
def account_codes(spark: SparkSession, d: str) -> DataFrame:
    """Every account, payer or payee, with a dense code in order of first appearance: payers first, then those who were only paid."""
    t = table(spark, d, "hi_small_trans", "trans_id", "from_bank", "from_account", "to_bank", "to_account").where("trans_id is not null")
    key = lambda b, a: F.concat(F.upper(F.trim(b)), F.lit(":"), F.upper(F.trim(a))).alias("account_key")
    ends = F.array(F.struct(key("from_bank", "from_account"), F.lit(0).cast("long").alias("side")), F.struct(key("to_bank", "to_account"), F.lit(1).cast("long").alias("side")))
    first = t.select("trans_id", F.inline(ends)).where("account_key is not null").groupBy("account_key").agg(F.min(F.struct("side", "trans_id")).alias("_f")).select("account_key", "_f.side", "_f.trans_id")
    order = (F.col("side") * F.lit(1 << 62) + F.col("trans_id")).alias("first")
    return C.positions(first.select("account_key", order), ["first"], "code").select("account_key", "code")


@query("payments_coded", f"""WITH k AS (
  SELECT {_KEY_SQL.format(b='from_bank', a='from_account')} AS s, {_KEY_SQL.format(b='to_bank', a='to_account')} AS t, trans_id FROM hi_small_trans WHERE trans_id IS NOT NULL
), f AS (SELECT x, row_number() OVER (ORDER BY min(o)) - 1 AS code FROM (SELECT s AS x, trans_id AS o FROM k UNION ALL SELECT t, trans_id + 4611686018427387904 FROM k) WHERE x IS NOT NULL GROUP BY x)
SELECT trans_id, a.code AS src, b.code AS dst FROM k JOIN f a ON a.x = k.s JOIN f b ON b.x = k.t""")
def payments_coded(spark: SparkSession, d: str) -> DataFrame:
    """Payments with the codes of both their accounts."""
    codes = account_codes(spark, d)
    t = table(spark, d, "hi_small_trans", "trans_id", "from_bank", "from_account", "to_bank", "to_account").where("trans_id is not null")
    key = lambda b, a: F.concat(F.upper(F.trim(b)), F.lit(":"), F.upper(F.trim(a)))
    t = t.select("trans_id", key("from_bank", "from_account").alias("_s"), key("to_bank", "to_account").alias("_t"))
    return t.join(codes.toDF("_s", "src"), "_s").join(codes.toDF("_t", "dst"), "_t").select("trans_id", "src", "dst")


@query("ids_missing_both_ends", """SELECT endpoint, txid, count(*) AS times FROM (SELECT 'txid1' AS endpoint, txid1 AS txid FROM txs_edgelist UNION ALL SELECT 'txid2', txid2 FROM txs_edgelist)
WHERE txid IS NOT NULL AND txid NOT IN (SELECT txid FROM txs_features WHERE txid IS NOT NULL) GROUP BY ALL""")
def ids_missing_both_ends(spark: SparkSession, d: str) -> DataFrame:
    """Ends of edges that no transaction resolves, and how often each stands there."""
    ends = F.array(*(F.struct(F.lit(c).alias("endpoint"), F.col(c).alias("txid")) for c in ("txid1", "txid2")))
    e = table(spark, d, "txs_edgelist", "txid1", "txid2").select(F.inline(ends)).where("txid is not null")
    ids = table(spark, d, "txs_features", "txid").distinct()
    return e.join(ids, "txid", "left_anti").groupBy("endpoint", "txid").agg(F.count("*").alias("times"))


# -- folds and components -------------------------------------------------------------------------------------------------

_OF_BOTH = ", ".join(f"coalesce(max({x}), 0) AS {x}" for x in ("v_out_fan", "v_out_degree", "v_in_fan", "v_in_degree"))


@query("node_fold_statistics", TXN_SQL + f""", nodes AS (SELECT node, min(t) + 400 AS node_time FROM (SELECT src AS node, edge_time AS t FROM txn UNION ALL SELECT dst, edge_time FROM txn) GROUP BY node),
wi AS (SELECT * FROM {_counts_sql('dst', 'src')}), wo AS (SELECT * FROM {_counts_sql('src', 'dst')}), co AS (SELECT * FROM {_cumulative_sql('src', 'dst')}), ci AS (SELECT * FROM {_cumulative_sql('dst', 'src')}),
b AS (
  SELECT DISTINCT t.src AS node, t.edge_time, {_bins_sql('wo.fan', 'wo.degree', 'fan_out')}, co.fan AS v_out_fan, co.degree AS v_out_degree, coalesce(ci.fan, 0) AS v_in_fan, coalesce(ci.degree, 0) AS v_in_degree
  FROM (SELECT DISTINCT src, edge_time FROM txn) t JOIN wo ON wo.vertex = t.src AND wo.edge_time = t.edge_time JOIN co ON co.vertex = t.src AND co.edge_time = t.edge_time ASOF LEFT JOIN ci ON ci.vertex = t.src AND ci.edge_time <= t.edge_time),
c AS (
  SELECT t.dst AS node, t.edge_time, coalesce(co.fan, 0) AS v_out_fan, coalesce(co.degree, 0) AS v_out_degree, ci.fan AS v_in_fan, ci.degree AS v_in_degree
  FROM (SELECT DISTINCT dst, edge_time FROM txn) t JOIN ci ON ci.vertex = t.dst AND ci.edge_time = t.edge_time ASOF LEFT JOIN co ON co.vertex = t.dst AND co.edge_time <= t.edge_time),
u AS (SELECT * FROM b UNION ALL SELECT node, edge_time, 0, 0, 0, 0, 0, v_out_fan, v_out_degree, v_in_fan, v_in_degree FROM c)
SELECT n.node, n.node_time, {', '.join(f'coalesce(max(fan_out_bin{k}), 0) AS fan_out_bin{k}' for k in G.BINS)}, {_OF_BOTH} FROM nodes n LEFT JOIN u ON u.node = n.node AND n.node_time >= u.edge_time GROUP BY n.node, n.node_time""")
def node_fold_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Pattern bins and cumulative statistics on accounts, as of 400 days after they were first seen; what an account has sent and
    received is one statistic each, whichever end it was at."""
    t = txn(spark, d).select("src", "dst", "edge_time")
    first = t.select("edge_time", F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg((F.min("edge_time") + 400).alias("node_time"))
    e = G.with_ends(t, G.vertex_statistics(t, W))
    stats = [(w, x) for w in G.WAYS for x in ("fan", "degree")]
    onto = {end: {f"v_{w}_{x}": f"vs_{end}_{w}_{x}" for w, x in stats} for end in ("src", "dst")}
    onto["src"] |= {f"fan_out_bin{k}": f"fan_out_bin{k}" for k in G.BINS}
    return G.node_fold(first, e, onto, [])


@query("component_largest_small")
def component_largest_small(spark: SparkSession, d: str) -> DataFrame:
    """The accounts of the largest component of illicit edges with at most 30 accounts; of equal ones that with the earliest edge.

    The components come from contraction over all illicit edges; SQL would hold every connected pair.
    """
    bad = txn(spark, d).where("y = 1").select("src", "dst", "edge_time")
    return R.largest_component(bad, G.components(bad.select(F.col("src").alias("u"), F.col("dst").alias("v"))), 30)


# -- chosen days and figures -------------------------------------------------------------------------------------------------

_DAYS = (TEST[0], TEST[0] + 1)
_DAYS_SQL = f""", v AS (SELECT * FROM scored WHERE part = 'test' AND time IN ({_DAYS[0]}, {_DAYS[1]})), g AS (SELECT p, CAST(sum(y) AS BIGINT) AS pos, count(*) AS n FROM v GROUP BY p),
c AS (SELECT p, CAST(sum(pos) OVER (ORDER BY p DESC) AS BIGINT) AS tp, CAST(sum(n) OVER (ORDER BY p DESC) AS BIGINT) AS m, CAST(sum(pos) OVER () AS BIGINT) AS ap FROM g),
q AS (SELECT r.recall, (SELECT arg_max(tp / m, p) FROM c WHERE tp / ap >= r.recall) AS precision FROM (SELECT unnest([5e-1, 8e-1]) AS recall) r)"""


@query("alert_load_days", TXN_SQL + _DAYS_SQL + " SELECT recall, precision, 1 / precision AS alerts_per_case, (SELECT count(*) FROM v) AS n, (SELECT count(*) FILTER (y = 1) FROM v) AS n_pos FROM q")
def alert_load_days(spark: SparkSession, d: str) -> DataFrame:
    """Alerts an analyst opens per case caught, on the chosen test days."""
    days = scored(spark, d).where((F.col("part") == "test") & F.col("time").isin(*_DAYS))
    n = days.agg(F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("n_pos"))
    return R.alert_load(E.precision_at_recall(days, [0.5, 0.8])).crossJoin(F.broadcast(n))  # one row


CURVES = [(r, m, "base_gfp", s, t, round(0.9 - 0.03 * (t - 38) * (2 if r == "temporal" else 1) + 0.01 * s, 4)) for r in ("temporal", "temporal_rolling") for m in ("gbt", "sage") for s in range(3) for t in range(38, 44)]
CURVES_SQL = "WITH curves(regime, model, features, seed, time, f1) AS (VALUES " + ", ".join(f"('{r}', '{m}', '{f}', {s}, CAST({t} AS BIGINT), {v!r}e0)" for r, m, f, s, t, v in CURVES) + ")"
_T2 = repr(t_quantile(0.975, 2)) + "e0"


def curves(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CURVES, "regime string, model string, features string, seed int, time long, f1 double")


@query("curve_bands", CURVES_SQL + f""" SELECT regime, model, features, time, round(avg(f1), 9) AS f1_mean, round(avg(f1) - {_T2} * stddev_samp(f1) / sqrt(count(*)), 9) AS low,
  round(avg(f1) + {_T2} * stddev_samp(f1) / sqrt(count(*)), 9) AS high FROM curves GROUP BY ALL""")
def curve_bands(spark: SparkSession, d: str) -> DataFrame:
    """Mean F1 over seeds at every batch, with its t-interval."""
    return rnd(R.curve_bands(curves(spark), ["regime", "model", "features"]), f1_mean=9, low=9, high=9)


@query("recovery_curve", CURVES_SQL + " SELECT time, round(avg(f1) FILTER (regime = 'temporal'), 9) AS temporal, round(avg(f1) FILTER (regime = 'temporal_rolling'), 9) AS temporal_rolling FROM curves WHERE model = 'gbt' GROUP BY time")
def recovery_curve(spark: SparkSession, d: str) -> DataFrame:
    """Trained once beside refitted each step."""
    return rnd(R.recovery(curves(spark).where("model = 'gbt'"), ["temporal", "temporal_rolling"]), temporal=9, temporal_rolling=9)


LEADS = [(det, s, None if det == "ks" and s else 40 + s + k, 0.7 + 0.01 * s) for k, det in enumerate(("psi", "ks", "conf")) for s in range(3)]


@query("lead_summary", "WITH leads(detector, seed, first_flag, drop_level) AS (VALUES " + ", ".join(f"('{a}', {b}, {'CAST(NULL AS BIGINT)' if c is None else f'CAST({c} AS BIGINT)'}, {v!r}e0)" for a, b, c, v in LEADS) + ") SELECT detector, median(first_flag) AS first_flag, round(avg(drop_level), 9) AS drop_level FROM leads GROUP BY detector")
def lead_summary(spark: SparkSession, d: str) -> DataFrame:
    """Over runs: the median first flag and the mean level of the drop."""
    return rnd(R.lead_summary(spark.createDataFrame(LEADS, "detector string, seed int, first_flag long, drop_level double")), drop_level=9)


STARTED = [("a", None, "elliptic", "parent", 10.0), ("b", "a", "elliptic", "child", 11.0), ("c", None, "elliptic", "parent", 20.0), ("d", "c", "elliptic", "child", 21.0), ("e", None, "other", "parent", 30.0)]


@query("latest_parent", "WITH runs(run_id, parent_run_id, experiment, kind, started) AS (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in r) + ")" for r in STARTED) + ") SELECT experiment, arg_max(run_id, started) AS run_id FROM runs WHERE kind = 'parent' GROUP BY experiment")
def latest_parent(spark: SparkSession, d: str) -> DataFrame:
    """Of every experiment the parent run that began last."""
    r = spark.createDataFrame(STARTED, "run_id string, parent_run_id string, experiment string, kind string, started double")
    return r.where("kind = 'parent'").groupBy("experiment").agg(F.max_by("run_id", "started").alias("run_id"))


@query("leakage_rolling", TXN_SQL + """, s AS (SELECT unnest(range(38, 49)) AS step), w AS (SELECT step, batch_id, y, CASE WHEN batch_id <= step - 4 THEN 'train' WHEN batch_id < step THEN 'val' ELSE 'test' END AS part FROM txn, s WHERE y >= 0 AND batch_id <= step)
SELECT CAST(step AS INTEGER) AS step, count(*) FILTER (part = 'train') AS n_train, count(*) FILTER (part = 'val') AS n_val, count(*) FILTER (part = 'test') AS n_test, count(*) FILTER (part = 'test' AND y = 1) AS pos_test,
  max(batch_id) FILTER (part = 'train') < min(batch_id) FILTER (part = 'val') AS train_before_val, max(batch_id) FILTER (part = 'val') < min(batch_id) FILTER (part = 'test') AS val_before_test, CAST(0 AS BIGINT) AS overlapping FROM w GROUP BY step""")
def leakage_rolling(spark: SparkSession, d: str) -> DataFrame:
    """The leak report of every step of a rolling split, in one pass."""
    s = S.split_rolling(txn(spark, d).select(*KEY, "batch_id", "y"), S.rolling_steps(VAL[0] - 1, 3, TEST))
    return S.leakage_report(s, KEY, by=["step"]).select("step", "n_train", "n_val", "n_test", "pos_test", "train_before_val", "val_before_test", "overlapping")


@query("event_probe")
def event_probe(spark: SparkSession, d: str) -> DataFrame:
    """Event windows with how well a model fitted inside each tells the classes there."""
    from ..models import trees

    p = scored(spark, d).where("part = 'test'")
    rows = E.event_windows(p, EVENT, F.lit(0.5))
    t = txn(spark, d).where((F.col("y") >= 0) & F.col("batch_id").between(*TEST)).select(*KEY, "batch_id", "y", *FEATURES)
    got = [(w, trees.probe_auc(t.where(c), KEY, FEATURES, n_trees=3)) for w, c in (("before", f"batch_id < {EVENT}"), ("after", f"batch_id >= {EVENT}"))]
    return rows.join(F.broadcast(spark.createDataFrame(got, "window string, probe_roc_auc double")), "window")  # two rows
