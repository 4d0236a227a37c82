"""Problem 2: rolling totals over trailing periods.

Events are added up per entity and day (combined before the shuffle, so a busy entity is at most one row a day), and
days are cut into time shards. For every (entity, shard) a segment tree holds sums and counts over the shard's days.
A block of entities is one dense numpy array per tree level, so building the trees, answering a trailing period for
every day and correcting trees are array operations over the whole block. A trailing period that begins in the shard
before reads that shard's tree too. A late record is a correction: it changes its leaf and the leaf's ancestors only.

Defined cases. Null entity or timestamp: the record belongs to no series and is left out. Null or not-a-number amount: no
payment to add; the day still belongs to the entity. Amounts below 1e12 are added exactly, as whole units and 1e-8 units;
larger and infinite ones as doubles beside them. Exact sums that reach 9e18 raise, they never wrap. Repeated rows count as often as they stand. Blanks and letter case around an
account do not count. Empty table: empty result. A period without payments has total 0, count 0 and a null average.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import parallelism, table

#: Days of a time shard; a power of two, and no shorter than the longest period.
SHARD_DAYS = 64
#: Entities handled as one block of arrays.
BLOCK = 512
PERIODS = (7, 30)
EPOCH = np.datetime64("1970-01-01", "D")


class Forest:
    """Segment trees over one shard for a block of entities.

    Level k has width / 2**k nodes; nodes[k][node] is, over the entities of the block, the sum of whole units, the sum of
    1e-8 units and the count, all integers, so sums are exact and do not depend on the order of addition. Blocks with amounts
    from EXACT on have a forest of doubles beside it, with that one sum.
    """

    def __init__(self, leaves: np.ndarray):
        self.nodes = [leaves]
        while self.nodes[-1].shape[0] > 1:
            self.nodes.append(self.nodes[-1][0::2] + self.nodes[-1][1::2])

    @property
    def width(self) -> int:
        return self.nodes[0].shape[0]

    def correct(self, rows: np.ndarray, days: np.ndarray, values: np.ndarray) -> int:
        """Adds late records, values being (parts, records); only leaves and their ancestors change. The nodes touched."""
        for k in range(len(self.nodes)):
            for part in range(len(values)):
                np.add.at(self.nodes[k][:, part], (days >> k, rows), values[part])
        return len(rows) * len(self.nodes)

    @staticmethod
    def cover(lo: int, hi: int) -> list[tuple[int, int]]:
        """The nodes (level, place) that make up days lo..hi, both included."""
        out, k = [], 0
        hi += 1
        while lo < hi:
            if lo & 1:
                out.append((k, lo))
                lo += 1
            if hi & 1:
                hi -= 1
                out.append((k, hi))
            lo, hi, k = lo >> 1, hi >> 1, k + 1
        return out

    def add_total(self, lo: int, hi: int, to: np.ndarray) -> None:
        lo, hi = max(lo, 0), min(hi, self.width - 1)
        for k, i in self.cover(lo, hi) if lo <= hi else []:
            to += self.nodes[k][i]


def _trailing(trees: list[Forest], day: int, period: int, to: np.ndarray) -> None:
    """Adds up the period that ends on a day; trees stand for consecutive shards, the day counts from the first."""
    w = trees[0].width
    lo = max(0, day - period + 1)
    for k in range(lo // w, day // w + 1):
        trees[k].add_total(lo - k * w, day - k * w, to)


#: Amounts from here on are added as doubles; below, as two integers.
EXACT = 1e12
LIMBS = ("w", "f", "h")
PARTS = ("w", "f", "n")


def limbs(x: Column) -> dict[str, Column]:
    """An amount as whole units (w), 1e-8 units (f) and, from EXACT on, as it is (h); all 0 where there is none."""
    there = x.isNotNull() & ~F.isnan(x)
    near = there & (F.abs(x) < EXACT)
    return {
        "w": F.when(near, F.floor(x).cast("long")).otherwise(F.lit(0).cast("long")),
        "f": F.when(near, F.round((x - F.floor(x)) * 1e8).cast("long")).otherwise(F.lit(0).cast("long")),
        "h": F.when(there & ~near, x).otherwise(0.0),
    }


def daily(events: DataFrame, keys: dict[str, Column], time: str, amount: str, ingested: str | None = None) -> DataFrame:
    """(keys, day, w, f, n, late_w, late_f, late_n): whole units, 1e-8 units and counts by entity and day.

    Records that arrived on a later day than their own stand apart. h and late_h are the sums of amounts from EXACT on.
    """
    day = F.datediff(F.to_date(time), F.lit("1970-01-01"))
    late = F.coalesce(F.to_date(ingested) > F.to_date(time), F.lit(False)) if ingested else F.lit(False)
    x = F.col(amount).cast("double")
    part = {**limbs(x), "n": F.when(x.isNotNull() & ~F.isnan(x), 1).otherwise(0)}
    df = events.select(
        *(c.alias(k) for k, c in keys.items()), day.alias("day"), late.alias("_late"),
        *(c.alias(f"_{p}") for p, c in part.items()),
    ).where(" and ".join(f"{k} is not null" for k in (*keys, "day")))
    return df.groupBy(*keys, "day").agg(
        *(F.sum(F.when(~F.col("_late"), F.col(f"_{p}")).otherwise(0)).alias(p) for p in part),
        *(F.sum(F.when(F.col("_late"), F.col(f"_{p}")).otherwise(0)).alias(f"late_{p}") for p in part),
    )


def _blocks(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 1) -> Iterator[pa.Table]:
    """Sorted batches, recut so that no entity is split; each block comes from at least so many rows, but the last."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if b.num_rows == 0:
            continue
        held.append(b)
        rows += b.num_rows
        if rows < least:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        starts = _starts(t, keys)
        if len(starts) > 1:
            yield t.slice(0, int(starts[-1]))
            held = t.slice(int(starts[-1])).combine_chunks().to_batches()
            rows = sum(x.num_rows for x in held)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Rows at which another entity begins."""
    new = np.zeros(t.num_rows, dtype=bool)
    new[:1] = True
    for k in keys:
        a = t.column(k).combine_chunks() if isinstance(t.column(k), pa.ChunkedArray) else t.column(k)
        new[1:] |= np.asarray(pc.not_equal(a.slice(1), a.slice(0, t.num_rows - 1)).to_numpy(zero_copy_only=False), dtype=bool)
    return np.flatnonzero(new)


def rolling_totals(per_day: DataFrame, keys: list[str], first: int, last: int, periods: tuple[int, ...] = PERIODS, partitions: int | None = None) -> DataFrame:
    """One row for every entity and every day first..last (days since 1970) with totals, counts and averages per period."""
    if max(periods) > SHARD_DAYS:
        raise ValueError(f"periods are at most {SHARD_DAYS} days, the length of a shard")
    days = last - first + 1
    shards = -(-days // SHARD_DAYS)
    spark = per_day.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * parallelism(spark))
    # an entity has at most one row a day, so no partition can be overfull because of one entity
    sorted_days = per_day.repartition(n, *keys).sortWithinPartitions(*keys)
    kinds = {k: dict(per_day.dtypes)[k] for k in keys}
    cols = ", ".join([f"{k} {t}" for k, t in kinds.items()] + ["day date"] + [f"total_{p}d double, n_{p}d int" for p in periods])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _blocks(batches, keys):
            starts = _starts(t, keys)
            entity = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, t.num_rows)))
            d = t.column("day").to_numpy() - first
            on_time, late = (np.stack([t.column(k + x).to_numpy() for x in PARTS]) for k in ("", "late_"))
            high, late_high = (t.column(k + "h").to_numpy()[None] for k in ("", "late_"))
            for at in range(0, len(starts), BLOCK):
                m = min(BLOCK, len(starts) - at)
                a, b = starts[at], (starts[at + m] if at + m < len(starts) else t.num_rows)
                rows, dd = entity[a:b] - at, d[a:b]
                if np.abs(on_time[0, a:b]).sum(dtype=np.float64) + np.abs(late[0, a:b]).sum(dtype=np.float64) >= 9e18 and max(
                    np.bincount(rows, weights=np.abs(v[0, a:b]), minlength=m).max() for v in (on_time, late)
                ) >= 4.5e18:
                    raise OverflowError("an entity's exact sum exceeds 9e18")
                tardy = late[2, a:b] > 0

                def forests(first_come: np.ndarray, later: np.ndarray) -> list[Forest]:
                    out = []
                    for k in range(shards):
                        here = np.flatnonzero((dd >= k * SHARD_DAYS) & (dd < (k + 1) * SHARD_DAYS))
                        leaves = np.zeros((SHARD_DAYS, len(first_come), m), dtype=first_come.dtype)
                        for part, values in enumerate(first_come):
                            leaves[dd[here] - k * SHARD_DAYS, part, rows[here]] = values[a:b][here]  # one row per entity and day
                        f = Forest(leaves)
                        here = here[tardy[here]]
                        f.correct(rows[here], dd[here] - k * SHARD_DAYS, later[:, a:b][:, here])
                        out.append(f)
                    return out

                def totals(trees: list[Forest], period: int) -> np.ndarray:
                    got = np.zeros((days, *trees[0].nodes[0].shape[1:]), dtype=trees[0].nodes[0].dtype)
                    for q in range(days):
                        _trailing(trees, q, period, got[q])
                    return got

                trees = forests(on_time, late)
                tall = forests(high, late_high) if high[0, a:b].any() or late_high[0, a:b].any() else None
                out = {}
                for p in periods:
                    got = totals(trees, p)
                    sums = got[:, 0] + got[:, 1] / 1e8
                    out[f"total_{p}d"] = pa.array((sums if tall is None else sums + totals(tall, p)[:, 0]).T.ravel())
                    out[f"n_{p}d"] = pa.array(got[:, 2].T.ravel().astype(np.int32))
                take = pa.array(np.repeat(starts[at : at + m], days))
                names = {k: t.column(k).combine_chunks().take(take) for k in keys}
                names = {k: v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v for k, v in names.items()}
                dates = pa.array(np.tile(np.arange(first, last + 1, dtype=np.int32), m)).cast(pa.date32())
                yield pa.RecordBatch.from_arrays([*names.values(), dates, *out.values()], names=[*names, "day", *out])

    got = sorted_days.mapInArrow(run, cols)
    return got.select(*keys, "day", *(c for p in periods for c in (
        F.col(f"total_{p}d"), F.col(f"n_{p}d"), (F.col(f"total_{p}d") / F.when(F.col(f"n_{p}d") > 0, F.col(f"n_{p}d"))).alias(f"avg_{p}d"))))


def account(name: str) -> Column:
    """A name as compared: in capitals, without blanks around it; null where nothing is left."""
    c = F.upper(F.trim(F.col(name)))
    return F.when(F.length(c) > 0, c)


def _trans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "hi_small_trans", "timestamp", "from_bank", "from_account", "amount_paid", "ingested_at")


def p2_rolling_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing 7 and 30 day totals and averages of every paying account on every day of the table."""
    trans = _trans(spark, sf_dir)
    span = trans.agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b")).first()
    per_day = daily(trans, {"bank": account("from_bank"), "account": account("from_account")}, "timestamp", "amount_paid", "ingested_at")
    if span["a"] is None:
        return rolling_totals(per_day, ["bank", "account"], 0, 0)
    first, last = (int((np.datetime64(span[k], "D") - EPOCH).astype(int)) for k in ("a", "b"))
    return rolling_totals(per_day, ["bank", "account"], first, last)


# -- trees kept as a table, so that late records can be taken in without reading the rest again -------------------------

LEVELS = SHARD_DAYS.bit_length()
NODE = (*PARTS, "h")


def tree_nodes(per_day: DataFrame, keys: list[str], late: bool = False) -> DataFrame:
    """(keys, shard, level, node, w, f, n, h): the nodes above every day an entity has, of its on-time or of its late records.

    Nodes without records are not kept. Days count from 1970, so shards are the same for every table.
    """
    p = "late_" if late else ""
    leaves = per_day.where(f"{p}n > 0").select(*keys, F.floor(F.col("day") / SHARD_DAYS).cast("int").alias("shard"), F.pmod("day", F.lit(SHARD_DAYS)).cast("int").alias("_d"), *(F.col(p + x).alias(x) for x in NODE))
    level = F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("level")
    up = leaves.select("*", level).withColumn("node", F.floor(F.col("_d") / F.pow(F.lit(2), F.col("level"))).cast("int"))
    return up.groupBy(*keys, "shard", "level", "node").agg(*(F.sum(x).alias(x) for x in NODE))


def correct_nodes(nodes: DataFrame, keys: list[str], corrections: DataFrame) -> DataFrame:
    """nodes with corrections (nodes of the same form) added: only leaves with late records and their ancestors change."""
    at = [*keys, "shard", "level", "node"]
    add = corrections.select(*at, *(F.col(x).alias(f"_{x}") for x in NODE))
    return nodes.join(add, at, "full_outer").select(*at, *((F.coalesce(x, F.lit(0)) + F.coalesce(f"_{x}", F.lit(0))).alias(x) for x in NODE), F.col("_n").isNotNull().alias("corrected"))


def range_totals(nodes: DataFrame, keys: list[str], asks: DataFrame, period: int) -> DataFrame:
    """asks(keys, day) with (total, n) over the period ending that day, each from the few nodes that cover it."""
    if period > SHARD_DAYS:
        raise ValueError(f"periods are at most {SHARD_DAYS} days, the length of a shard")
    cover = []
    for d in range(SHARD_DAYS):  # the nodes are the same for every shard, so they are a literal of SHARD_DAYS entries
        own = [(0, k, i) for k, i in Forest.cover(max(0, d - period + 1), d)]
        back = [(1, k, i) for k, i in Forest.cover(SHARD_DAYS + d - period + 1, SHARD_DAYS - 1)] if d - period + 1 < 0 else []
        cover.append(F.array(*(F.struct(F.lit(b).alias("back"), F.lit(k).alias("level"), F.lit(i).alias("node")) for b, k, i in own + back)))
    a = asks.select(*keys, "day", F.explode(F.get(F.array(*cover), F.pmod("day", F.lit(SHARD_DAYS)).cast("int"))).alias("_c"))
    a = a.select(*keys, "day", (F.floor(F.col("day") / SHARD_DAYS) - F.col("_c.back")).cast("int").alias("shard"), "_c.level", "_c.node")
    got = a.join(nodes, [*keys, "shard", "level", "node"], "left").groupBy(*keys, "day").agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in NODE))
    return got.select(*keys, "day", (F.col("w") + F.col("f") / 1e8 + F.col("h")).alias("total"), "n")


def p2_corrected_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trees of on-time payments with the late ones taken in; `corrected` marks the nodes that changed."""
    per_day = daily(_trans(spark, sf_dir), {"bank": account("from_bank"), "account": account("from_account")}, "timestamp", "amount_paid", "ingested_at")
    keys = ["bank", "account"]
    return correct_nodes(tree_nodes(per_day, keys), keys, tree_nodes(per_day, keys, late=True))


P2_TREES_SQL = """
WITH e AS (
  SELECT upper(trim(from_bank)) AS bank, upper(trim(from_account)) AS account, date_diff('day', DATE '1970-01-01', CAST("timestamp" AS DATE)) AS d, amount_paid AS x,
    coalesce(CAST(ingested_at AS DATE) > CAST("timestamp" AS DATE), false) AS late
  FROM hi_small_trans WHERE trim(from_bank) <> '' AND trim(from_account) <> '' AND "timestamp" IS NOT NULL AND amount_paid IS NOT NULL
)
SELECT bank, account, CAST(d // 64 AS INTEGER) AS shard, level, CAST((d % 64) // (1 << level) AS INTEGER) AS node,
  CAST(sum(CASE WHEN abs(x) < 1e12 THEN CAST(floor(x) AS BIGINT) ELSE 0 END) AS BIGINT) AS w, CAST(sum(CASE WHEN abs(x) < 1e12 THEN CAST(round((x - floor(x)) * 1e8) AS BIGINT) ELSE 0 END) AS BIGINT) AS f,
  count(*) AS n, sum(CASE WHEN abs(x) < 1e12 THEN 0e0 ELSE x END) AS h, bool_or(late) AS corrected
FROM e, (SELECT CAST(unnest(range(0, 7)) AS INTEGER) AS level) GROUP BY ALL
"""

P2_SQL = """
WITH e AS (
  SELECT upper(trim(from_bank)) AS bank, upper(trim(from_account)) AS account, CAST("timestamp" AS DATE) AS d, amount_paid AS x
  FROM hi_small_trans WHERE trim(from_bank) <> '' AND trim(from_account) <> '' AND "timestamp" IS NOT NULL
), p AS (
  SELECT bank, account, d, coalesce(sum(CAST(floor(x) AS BIGINT)), 0) AS w, coalesce(sum(CAST(round((x - floor(x)) * 1e8) AS BIGINT)), 0) AS f, count(x) AS n FROM e GROUP BY ALL
), days AS (
  SELECT CAST(unnest(generate_series(min(CAST("timestamp" AS DATE)), max(CAST("timestamp" AS DATE)), INTERVAL 1 DAY)) AS DATE) AS day FROM hi_small_trans
), g AS (
  SELECT a.bank, a.account, day, coalesce(p.w, 0) AS w, coalesce(p.f, 0) AS f, coalesce(p.n, 0) AS n
  FROM (SELECT DISTINCT bank, account FROM p) a CROSS JOIN days LEFT JOIN p ON p.bank = a.bank AND p.account = a.account AND p.d = day
), t AS (
  SELECT bank, account, day,
    CAST(sum(w) OVER w7 AS DOUBLE) + CAST(sum(f) OVER w7 AS DOUBLE) / 1e8 AS total_7d, CAST(sum(n) OVER w7 AS INTEGER) AS n_7d,
    CAST(sum(w) OVER w30 AS DOUBLE) + CAST(sum(f) OVER w30 AS DOUBLE) / 1e8 AS total_30d, CAST(sum(n) OVER w30 AS INTEGER) AS n_30d
  FROM g WINDOW w7 AS (PARTITION BY bank, account ORDER BY day ROWS 6 PRECEDING), w30 AS (PARTITION BY bank, account ORDER BY day ROWS 29 PRECEDING)
)
SELECT *, total_7d / nullif(n_7d, 0) AS avg_7d, total_30d / nullif(n_30d, 0) AS avg_30d FROM t
"""

ORACLE = {"p2_rolling_totals": P2_SQL, "p2_corrected_trees": P2_TREES_SQL}
QUERIES = {"p2_rolling_totals": p2_rolling_totals, "p2_corrected_trees": p2_corrected_trees}
