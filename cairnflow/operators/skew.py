"""Problem 3: a few keys holding most records.

Fragment-replicate by estimated load. The load of every key is counted with map-side combining. Keys above a share of
a task's load are heavy; there are at most tasks / share of them, so their list is small whatever the data. Light keys
are hashed into buckets whose loads are known too. Heavy keys are split into shards in proportion to their load, and
shards and buckets are bin-packed to tasks, largest first. Records go to the task of their bucket or, for a heavy key,
to one of its shards; the matching side of a heavy key is replicated to just the tasks that hold its shards. Within a
task, records meet their matching row by one sort, and per-key results come from merging the shards' partial results.

Defined cases. Null keys match nothing and form no key. Keys without a matching row keep nulls on that side. Several
matching rows for a key: the caller must reduce them to one. Null or not-a-number amounts count as payments, not in means. A column that stands on both sides keeps its name on the
record's side and gets the ending _match on the other. Repeated records each count. Ties in load are packed by
name, so plans are the same every time. Empty input: empty result.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut, parallelism, table
from .rolling import account, limbs

#: A key is heavy when its load exceeds this share of the average task's load.
HEAVY_SHARE = 0.25
#: Buckets of light keys for every task.
BUCKETS_PER_TASK = 8


class Plan:
    """Where each bucket of light keys and each shard of heavy keys is processed."""

    def __init__(self, tasks: int, buckets: int, bucket_task: list[int], heavy: dict[tuple, list[int]], loads: list[int]):
        self.tasks, self.buckets, self.bucket_task, self.heavy, self.loads = tasks, buckets, bucket_task, heavy, loads


def load_by_key(records: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, load): records of each key, combined before the shuffle."""
    return records.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).agg(F.count("*").alias("load"))


def plan_tasks(loads: DataFrame, keys: list[str], tasks: int) -> Plan:
    """Bin-packs light buckets and proportionate shards of heavy keys onto tasks, largest first."""
    buckets = tasks * BUCKETS_PER_TASK
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    by_bucket = loads.groupBy(bucket.alias("b")).agg(F.sum("load").alias("load"), F.max("load").alias("most")).collect()  # at most `buckets` rows
    total = sum(r["load"] for r in by_bucket)
    if total == 0:
        return Plan(tasks, buckets, [b % tasks for b in range(buckets)], {}, [0] * tasks)
    limit = max(1.0, HEAVY_SHARE * total / tasks)
    # fewer than tasks / HEAVY_SHARE keys can exceed the limit
    rows = loads.where(F.col("load") > limit).select(*keys, "load", bucket.alias("b")).collect() if any(r["most"] > limit for r in by_bucket) else []
    size = {r["b"]: r["load"] for r in by_bucket}
    pieces: list[tuple[float, str, tuple | int, int]] = []
    for r in rows:
        key, load = tuple(r[k] for k in keys), r["load"]
        size[r["b"]] -= load
        shards = max(1, min(tasks, -(-load // max(1, int(limit)))))
        pieces += [(load / shards, repr(key), key, s) for s in range(shards)]
    pieces += [(float(n), f"~{b:08d}", b, 0) for b, n in size.items()]
    heap = [(0.0, t) for t in range(tasks)]
    bucket_task, heavy, out = [b % tasks for b in range(buckets)], {}, [0.0] * tasks
    for load, _name, what, _s in sorted(pieces, key=lambda p: (-p[0], p[1], p[3])):
        have, t = heapq.heappop(heap)
        heapq.heappush(heap, (have + load, t))
        out[t] = have + load
        if isinstance(what, tuple):
            heavy.setdefault(what, []).append(t)
        else:
            bucket_task[what] = t
    return Plan(tasks, buckets, bucket_task, heavy, [int(x) for x in out])


def _placed(df: DataFrame, keys: list[str], plan: Plan, replicate: bool) -> DataFrame:
    """df with its task; rows of heavy keys spread over the shards, or replicated to each task that holds one."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(plan.buckets)).cast("int")
    light = F.element_at(F.array(*(F.lit(t) for t in plan.bucket_task)), bucket + 1) if plan.buckets <= 512 else None
    spark = df.sparkSession
    if light is None:
        at = spark.createDataFrame(list(enumerate(plan.bucket_task)), "_b int, _light int")
        df = df.withColumn("_b", bucket).join(F.broadcast(at), "_b", "left").drop("_b")  # one row per bucket
        light = F.col("_light")
    if plan.heavy:
        schema = ", ".join(f"{k} {dict(df.dtypes)[k]}" for k in keys) + ", _tasks array<int>"
        heavy = spark.createDataFrame([(*k, t) for k, t in plan.heavy.items()], schema)
        df = df.join(F.broadcast(heavy), keys, "left")  # fewer than tasks / HEAVY_SHARE rows
        tasks = F.col("_tasks")
        if replicate:
            df = df.withColumn("task", F.explode(F.coalesce(F.array_distinct(tasks), F.array(light))))
        else:
            # the row's other columns choose the shard, so a lost task is recomputed onto the same shards
            spread = F.pmod(F.xxhash64(*[c for c in df.columns if c not in ("_tasks", "_light")]), F.size(tasks)).cast("int")
            df = df.withColumn("task", F.when(tasks.isNull(), light).otherwise(F.get(tasks, spread)))
    else:
        df = df.withColumn("task", light)
    return df.drop("_tasks", "_light")


def fragment_replicate(records: DataFrame, match: DataFrame, keys: list[str], tasks: int | None = None, loads: DataFrame | None = None) -> DataFrame:
    """records with the columns of their matching row, and `task`; no task gets much more than its share of records.

    match has one row per key. A `task` column of the caller is overwritten.
    """
    records, match = records.drop("task"), match.drop("task")
    match = match.select(*keys, *(F.col(c).alias(f"{c}_match" if c in records.columns else c) for c in match.columns if c not in keys))
    tasks = tasks or max(2 * parallelism(records.sparkSession), int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    plan = plan_tasks(loads if loads is not None else load_by_key(records, keys), keys, tasks)
    mine, theirs = [c for c in records.columns if c not in keys], [c for c in match.columns if c not in keys]
    some = " and ".join(f"{k} is not null" for k in keys)
    left = _placed(records.where(some), keys, plan, False).withColumn("_side", F.lit(1))
    right = _placed(match.where(some), keys, plan, True).withColumn("_side", F.lit(0))
    both = left.select(*keys, "task", "_side", *mine, *(F.lit(None).cast(match.schema[c].dataType).alias(c) for c in theirs)).unionByName(
        right.select(*keys, "task", "_side", *(F.lit(None).cast(records.schema[c].dataType).alias(c) for c in mine), *theirs)
    )
    together = both.repartitionById(tasks, "task")
    # the matching row sorts before its records; one running frame hands it on, without holding a key's records
    w = Window.partitionBy("task", *keys).orderBy("_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = together.select(*keys, "task", "_side", *mine, *(F.first(c, ignorenulls=True).over(w).alias(c) for c in theirs))
    return got.where("_side = 1").drop("_side")


ROLES = (("from_account", "from_bank", "to_bank", "to_account"), ("to_account", "to_bank", "from_bank", "from_account"))


def _by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(role, bank, account, x, other): each payment once for its payer and once for its payee."""
    trans = table(spark, sf_dir, "hi_small_trans", "from_bank", "from_account", "to_bank", "to_account", "amount_paid", "amount_received", "timestamp", "trans_id")
    sides = F.array(*(
        F.struct(F.lit(acct).alias("role"), account(bank).alias("bank"), account(acct).alias("account"), F.col("amount_paid" if acct[0] == "f" else "amount_received").alias("x"),
                 F.xxhash64(account(ob), account(oa)).alias("other"))
        for acct, bank, ob, oa in ROLES
    ))
    return trans.select("trans_id", F.explode(sides).alias("s")).select("trans_id", "s.*").where("bank is not null and account is not null")


KEYS = ["role", "bank", "account"]


def account_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per account and role: payments, their mean, those more than twice the mean, and how many the matching side says there are.

    The load and mean of each account are the matching side, added up once and written; the payments meet it by
    fragment-replicate, and shards are merged.
    """
    records = _by_role(spark, sf_dir)
    parts = limbs(F.col("x"))
    sums = records.groupBy(*KEYS).agg(F.count("*").alias("load"), F.count_if(F.col("x").isNotNull() & ~F.isnan("x")).alias("_n"), *(F.sum(c).alias(f"_{k}") for k, c in parts.items()))
    mean = (F.col("_w") + F.col("_f") / 1e8 + F.col("_h")) / F.when(F.col("_n") > 0, F.col("_n"))
    match = cut(sums.select(*KEYS, "load", mean.alias("mean")))
    met = fragment_replicate(records.select(*KEYS, "trans_id", "x"), match, KEYS, loads=match.select(*KEYS, "load"))
    part = met.groupBy("task", *KEYS).agg(  # within the task: no shuffle
        F.count("*").alias("n"), F.max("load").alias("load"), F.max("mean").alias("mean"), F.sum(F.when(F.col("x") > 2 * F.col("mean"), 1).otherwise(0)).alias("above"), F.max("x").alias("largest"))
    return part.groupBy(*KEYS).agg(
        F.sum("n").alias("n"), F.max("load").alias("load"), F.max("mean").alias("mean"), F.sum("above").alias("above"), F.max("largest").alias("largest"), F.count("*").cast("int").alias("fragments"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts in at least 1 % of all rows, by role: payments that met their account's row, counted in all its shards."""
    rows = table(spark, sf_dir, "hi_small_trans", "trans_id").count()
    return account_results(spark, sf_dir).where((F.col("n") * 100 >= F.lit(rows)) & (F.col("n") == F.col("load"))).select(*KEYS)


def p3_account_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-account results over every payment, without one task holding a busy account."""
    return account_results(spark, sf_dir).select(*KEYS, "n", "largest", "mean", "above")


P3_SIDES = """
WITH s AS (
  SELECT 'from_account' AS role, upper(trim(from_bank)) AS bank, upper(trim(from_account)) AS account, amount_paid AS x FROM hi_small_trans
  UNION ALL SELECT 'to_account', upper(trim(to_bank)), upper(trim(to_account)), amount_received FROM hi_small_trans
), k AS (SELECT * FROM s WHERE bank <> '' AND account <> '')
"""
ORACLE = {
    "p3_found": P3_SIDES + "SELECT role, bank, account FROM k GROUP BY ALL HAVING count(*) * 100 >= (SELECT count(*) FROM hi_small_trans)",
    "p3_account_results": P3_SIDES + """, m AS (
  SELECT role, bank, account, count(*) AS n, max(x) AS largest,
    (coalesce(CAST(sum(CAST(floor(x) AS BIGINT)) AS DOUBLE), 0) + coalesce(CAST(sum(CAST(round((x - floor(x)) * 1e8) AS BIGINT)) AS DOUBLE), 0) / 1e8) / nullif(count(x), 0) AS mean FROM k GROUP BY ALL)
SELECT m.role, m.bank, m.account, m.n, m.largest, m.mean, count(*) FILTER (k.x > 2 * m.mean) AS above
FROM m JOIN k ON k.role = m.role AND k.bank = m.bank AND k.account = m.account GROUP BY ALL""",
}
QUERIES = {"p3_found": p3_found, "p3_account_results": p3_account_results}
