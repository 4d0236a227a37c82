"""Problem 4: references to records that do not exist.

Parents are reduced to one row per key: when it was first there for good. Their keys are range-partitioned at quantiles,
and each range is a slot with its sorted array of parents. References are sent to the slot of their range; a range that
draws more than its share of references is split, its parent array replicated to every split. In a slot the parents
arrive first and are held as sorted arrays, bounded by the range size; the references then stream through in batches
and are probed by binary search. Misses are counted per column and period.

Defined cases. Null references are no references. A parent with null deleted_at stands; with a null loaded_at it has
never arrived. A reference with a null load time is checked for existence only. Repeated parents: the earliest standing
row counts. Repeated references each count. Empty parents: every reference is an orphan. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, parallelism, table

#: Parents in a range, about; also what a task holds in memory.
RANGE_KEYS = 1_000_000
NEVER = np.int64(2**62)


def standing_parents(parents: DataFrame, key: str, loaded: str, deleted: str) -> DataFrame:
    """(key, since, ever): microseconds at which the key was first there in a row that still stands; ever: in any row."""
    at = F.unix_micros(F.col(loaded).cast("timestamp"))
    return (
        parents.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("key"))
        .agg(F.min(F.when(F.col(deleted).isNull(), at)).alias("since"))
        .withColumn("since", F.coalesce("since", F.lit(int(NEVER))))
    )


def probe(parents: DataFrame, refs: DataFrame, ranges: int | None = None) -> DataFrame:
    """refs(key, at, payload...) with `state`: 0 found, 1 no such key, 2 the key's rows are all deleted, 3 not yet there."""
    spark = refs.sparkSession
    parents = cut(parents)  # counted, cut into ranges and probed from one written copy
    n = parents.count()
    ranges = ranges or max(2 * parallelism(spark), -(-n // RANGE_KEYS))
    edges = np.array(sorted({int(q) for q in parents.approxQuantile("key", [i / ranges for i in range(1, ranges)], 0.25 / ranges)}) if n else [], dtype=np.int64)
    load = {r["range"]: r["n"] for r in _range_loads(refs.select("key"), edges).collect()}  # one row a range
    share = max(1, sum(load.values()) // max(1, ranges))
    splits = np.array([max(1, -(-load.get(r, 0) // share)) for r in range(len(edges) + 1)], dtype=np.int64)
    first = np.cumsum(splits) - splits
    payload = [c for c in refs.columns if c not in ("key", "at")]
    right = parents.select("key", F.col("since").alias("at"), F.lit(0).alias("_tag"), *(F.lit(None).cast(refs.schema[c].dataType).alias(c) for c in payload))
    left = refs.select("key", "at", F.lit(1).alias("_tag"), *payload)
    both = _placed(right, None, edges, first, splits).unionByName(_placed(left, F.xxhash64(*refs.columns), edges, first, splits))
    placed = both.repartitionById(int(splits.sum()), "_s").sortWithinPartitions("_tag", F.when(F.col("_tag") == 0, F.col("key")))
    kinds = dict(refs.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in ("key", "at", *payload)] + ["state int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        keys = since = None
        for b in batches:
            tag = b.column("_tag").to_numpy()
            cut = int(np.searchsorted(tag, 1))
            if cut:
                held.append((b.column("key").slice(0, cut).to_numpy(), b.column("at").slice(0, cut).to_numpy()))
            if cut == b.num_rows:
                continue
            if keys is None:
                keys, since = (np.concatenate([h[i] for h in held]) if held else np.zeros(0, dtype=np.int64) for i in (0, 1))
            part = b.slice(cut)
            k = part.column("key").to_numpy()
            t = part.column("at").fill_null(int(NEVER) - 1).to_numpy()
            i = np.searchsorted(keys, k)
            j = np.minimum(i, max(len(keys) - 1, 0))
            there = (i < len(keys)) & (keys[j] == k) if len(keys) else np.zeros(len(k), dtype=bool)
            s = since[j] if len(keys) else np.full(len(k), NEVER)
            state = np.where(~there, 1, np.where(s >= NEVER, 2, np.where(s > t, 3, 0))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("at"), *(part.column(c) for c in payload), pa.array(state)], names=["key", "at", *payload, "state"])

    return placed.mapInArrow(run, schema)


def _range_loads(refs: DataFrame, edges: np.ndarray) -> DataFrame:
    """(range, n): references of each range, added up per task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(edges) + 1, dtype=np.int64)
        for b in batches:
            total += np.bincount(np.searchsorted(edges, b.column(0).to_numpy()), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["range", "n"])

    return refs.mapInArrow(run, "range int, n long").groupBy("range").agg(F.sum("n").alias("n"))


def _placed(rows: DataFrame, spread: Column | None, edges: np.ndarray, first: np.ndarray, splits: np.ndarray) -> DataFrame:
    """rows with the slot (_s) of their key's range, by binary search; with no number to spread by, a copy for every split.

    The bounds of the ranges travel with the function: three numbers a range.
    """
    copies = spread is None
    rows = rows.withColumn("_h", F.lit(0).cast("long") if copies else spread)
    names = [c for c in rows.columns if c != "_h"]
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = np.searchsorted(edges, b.column("key").to_numpy())
            if copies:
                take = np.repeat(np.arange(len(r)), splits[r])
                again = np.arange(len(take)) - np.repeat(np.cumsum(splits[r]) - splits[r], splits[r])  # 0, 1, ... in each row's copies
                slot, b = first[r][take] + again, b.take(pa.array(take))
            else:
                slot = first[r] + b.column("_h").to_numpy() % splits[r]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(slot.astype(np.int32))], names=[*names, "_s"])

    return rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", _s int")


def orphan_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(edge_id, endpoint, time_step, key, at, state) of every non-null reference of txs_edgelist."""
    edges = table(spark, sf_dir, "txs_edgelist", "edge_id", "txid1", "txid2", "time_step", "loaded_at")
    parents = standing_parents(table(spark, sf_dir, "txs_features", "txid", "loaded_at", "deleted_at"), "txid", "loaded_at", "deleted_at")
    ends = F.array(*(F.struct(F.lit(c).alias("endpoint"), F.col(c).cast("long").alias("key")) for c in ("txid1", "txid2")))
    refs = (
        edges.select("edge_id", "time_step", F.unix_micros(F.col("loaded_at").cast("timestamp")).alias("at"), F.explode(ends).alias("e"))
        .select("e.key", "at", "edge_id", "e.endpoint", "time_step").where("key is not null")
    )
    return probe(parents, refs)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References with no standing parent at the time they were loaded."""
    return orphan_states(spark, sf_dir).where("state > 0").select("edge_id", "endpoint")


def p4_orphan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans per column and time step, by what became of the parent."""
    s = orphan_states(spark, sf_dir)
    return s.groupBy("endpoint", "time_step").agg(
        F.count("*").alias("refs"), *(F.count_if(F.col("state") == k).alias(n) for k, n in ((1, "missing"), (2, "deleted"), (3, "late"))), F.count_if(F.col("state") > 0).alias("orphans"))


P4_REFS = """
WITH r AS (
  SELECT edge_id, 'txid1' AS endpoint, txid1 AS k, time_step, loaded_at FROM txs_edgelist WHERE txid1 IS NOT NULL
  UNION ALL SELECT edge_id, 'txid2', txid2, time_step, loaded_at FROM txs_edgelist WHERE txid2 IS NOT NULL
), p AS (SELECT txid, min(CASE WHEN deleted_at IS NULL THEN loaded_at END) AS since FROM txs_features WHERE txid IS NOT NULL GROUP BY txid),
s AS (SELECT r.*, CASE WHEN p.txid IS NULL THEN 1 WHEN since IS NULL THEN 2 WHEN since > loaded_at THEN 3 ELSE 0 END AS state FROM r LEFT JOIN p ON p.txid = r.k)
"""
ORACLE = {
    "p4_found": """
SELECT edge_id, endpoint FROM (
  SELECT edge_id, 'txid1' AS endpoint, txid1 AS k, loaded_at FROM txs_edgelist UNION ALL SELECT edge_id, 'txid2', txid2, loaded_at FROM txs_edgelist) r
WHERE k IS NOT NULL AND NOT EXISTS (SELECT 1 FROM txs_features f WHERE f.txid = r.k AND f.deleted_at IS NULL AND f.loaded_at <= r.loaded_at)""",
    "p4_orphan_report": P4_REFS + """
SELECT endpoint, time_step, count(*) AS refs, count(*) FILTER (state = 1) AS missing, count(*) FILTER (state = 2) AS deleted,
  count(*) FILTER (state = 3) AS late, count(*) FILTER (state > 0) AS orphans FROM s GROUP BY ALL""",
}
QUERIES = {"p4_found": p4_found, "p4_orphan_report": p4_orphan_report}
