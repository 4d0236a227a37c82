"""Problem 5: a per-entity feature table from events.

Event types are evened out in spelling and numbered. Events are added up per (entity, role, type), combined before the
shuffle, so a busy entity brings at most one row per type. Entities are then hash-bucketed; in a bucket they are taken
in blocks, each (entity, type) is one index into a dense block, counts and sums are scattered by numpy bincount and the
latest times by maximum, and the block leaves over its own memory as Arrow feature columns: one row per entity, and for
each role three columns that hold a number per event type. Place i of such a column is the type numbered i in
`p5_feature_types`. `p5_feature_columns` lays the same table out with one column for each role, type and measure.

Why vectors: a row-wise file writer keeps a writer per column; with three columns per type (1,680 here) every cell goes to
another writer and misses the processor's cache, and the schema would change with the data.

Defined cases. Null entity: no row. Null type: counted in no column, but the entity still has its row. Null or not-a-number
amount: the event counts and is recent, and adds nothing. Null time: no recency. An entity without events of a type has
number 0, total 0 and a null recency. Amounts from 1e12 on are added as doubles, infinite ones too; smaller ones exactly.
Repeated rows count as often as they stand. Empty table: no rows. More than MAX_TYPES types raise in the dense forms, whose
rows would be too long; `feature_rows`, with a row for each entity, role and type that occurs, has no such bound.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import parallelism, table
from .rolling import LIMBS, _blocks, _starts, account, limbs

#: Cells of one dense block, about; entities in it: so many divided by the columns of an entity.
BLOCK_CELLS = 1 << 18
#: A dense row has a place for every type; more types than this are no vocabulary.
MAX_TYPES = 100_000
#: Spellings that are sent to every task; more are joined by a shuffle.
MAX_SPELLINGS = 1_000_000
NEVER = -(2**62)
MEASURES = (("n", "int"), ("recency", "int"), ("total", "double"))


def spelled_alike(name: str):
    """A type as compared: small letters; anything else between them but a slash is one blank, none around the slashes."""
    c = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.col(name)), r"[^\p{L}\p{N}/]+", " "), r" ?/ ?", "/"))
    return F.when(F.length(c) > 0, c)


def spellings(events: DataFrame, kind: str, time: str) -> DataFrame:
    """(type, _t, last): each spelling of an event type, evened out once and not once an event, and its latest time.

    A null type has its row too, so the latest time of all is among them.
    """
    return events.groupBy(F.col(kind).alias("type")).agg(F.max(time).alias("last")).select("type", spelled_alike("type").alias("_t"), "last")


def vocabulary(spelled: DataFrame) -> tuple[list[str], dict[str, int], object]:
    """The types in order, each spelling's place among them, and the latest time; their number is checked."""
    rows = spelled.limit(16 * MAX_TYPES + 1).collect()
    types = sorted({r["_t"] for r in rows if r["_t"] is not None})
    if len(types) > MAX_TYPES or len(rows) > 16 * MAX_TYPES:
        raise ValueError(f"more than {MAX_TYPES} event types, or 16 spellings of each: use feature_rows")
    place = {t: i for i, t in enumerate(types)}
    return types, {r["type"]: place[r["_t"]] for r in rows if r["_t"] is not None}, max((r["last"] for r in rows if r["last"] is not None), default=None)


def sums_by_type(events: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """events(keys, by, at, x) to (keys, by, n, w, f, h, last): numbers, exact sums and the latest time."""
    part = limbs(F.col("x"))
    return events.groupBy(*keys, *by).agg(F.count("*").cast("int").alias("n"), *(F.sum(part[k]).alias(k) for k in LIMBS), F.max("at").alias("last"))


def numbered(events: DataFrame, places: dict[str, int], count: int) -> DataFrame:
    """events(role, type, ...), role a number, with `slot`, which numbers role and type; -1 where there is no type."""
    numbers = events.sparkSession.createDataFrame(list(places.items()) or [("", 0)], "type string, _i int")  # at most 16 * MAX_TYPES rows
    return events.join(F.broadcast(numbers), "type", "left").withColumn("slot", F.coalesce(F.col("role") * count + F.col("_i"), F.lit(-1)))


def feature_vectors(sums: DataFrame, keys: list[str], roles: list[str], count: int, now: int, partitions: int | None = None) -> DataFrame:
    """One row per entity; for every role the numbers, minutes since the latest and totals of all types, as vectors.

    sums: (keys, slot, n, w, f, h, last), several rows for an entity and slot are added up.
    """
    spark = sums.sparkSession
    parts = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * parallelism(spark))
    kinds = dict(sums.dtypes)
    labels = [*keys, *(f"{r}_{m}" for r in roles for m, _ in MEASURES)]
    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + [f"{r}_{m} array<{t}>" for r in roles for m, t in MEASURES])
    block = max(1, BLOCK_CELLS // max(1, count * len(roles)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _blocks(batches, keys):
            starts = _starts(t, keys)
            entity = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, t.num_rows)))
            slot, n, w, f, h = (t.column(c).to_numpy() for c in ("slot", "n", *LIMBS))
            last = pc.fill_null(t.column("last"), NEVER).to_numpy()
            for at in range(0, len(starts), block):
                m = min(block, len(starts) - at)
                a, b = starts[at], (starts[at + m] if at + m < len(starts) else t.num_rows)
                ok = slot[a:b] >= 0
                role, kind = np.divmod(slot[a:b][ok], max(1, count))
                cells = m * count
                index = role * cells + (entity[a:b][ok] - at) * count + kind  # role by role, entity by entity

                def scattered(x: np.ndarray) -> np.ndarray:
                    return np.bincount(index, weights=x[a:b][ok], minlength=cells * len(roles))

                number = scattered(n).astype(np.int32)
                total = scattered(w) + scattered(f) / 1e8
                if h[a:b].any():
                    total += scattered(h)
                latest = np.full(cells * len(roles), NEVER, dtype=np.int64)
                np.maximum.at(latest, index, last[a:b][ok])
                none = latest == NEVER
                age = np.where(none, 0, now - latest).astype(np.int32)
                ends = pa.array(np.arange(m + 1, dtype=np.int32) * count)
                take = pa.array(starts[at : at + m])
                out = [c.combine_chunks() if isinstance(c := t.column(k).take(take), pa.ChunkedArray) else c for k in keys]
                for r in range(len(roles)):
                    own = slice(r * cells, (r + 1) * cells)
                    out += [pa.ListArray.from_arrays(ends, x) for x in (pa.array(number[own]), pa.array(age[own], mask=none[own]), pa.array(total[own]))]
                yield pa.RecordBatch.from_arrays(out, names=labels)

    return sums.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def column_names(roles: list[str], types: list[str]) -> list[str]:
    slug = [re.sub(r"[^0-9a-z]+", "_", t.lower()).strip("_") for t in types]
    slug = [s if s and slug.count(s) == 1 else f"{s}_{i}" for i, s in enumerate(slug)]
    return [f"{r}_{s}" for r in roles for s in slug]


def feature_columns(vectors: DataFrame, keys: list[str], roles: list[str], types: list[str]) -> DataFrame:
    """The vectors laid out: for every role and type its number (_n), minutes since the latest (_recency) and total (_total)."""
    out = []
    for j, name in enumerate(column_names(roles, types)):
        role, i = roles[j // len(types)], F.lit(j % len(types))
        got = {m: F.get(f"{role}_{m}", i) for m, _ in MEASURES}
        out += [(got[m] if m == "recency" else F.coalesce(got[m], F.lit(0).cast(t))).alias(f"{name}_{m}") for m, t in MEASURES]
    return vectors.select(*keys, *out)


def feature_rows(events: DataFrame, spelled: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, role, type, n, w, f, h, last) for each entity, role and type that occurs, for any number of types."""
    names = spelled.where("_t is not null").select("type", "_t")
    if len(names.limit(MAX_SPELLINGS + 1).select("type").toArrow()) <= MAX_SPELLINGS:
        names = F.broadcast(names)
    return sums_by_type(events.join(names, "type").drop("type").withColumnRenamed("_t", "type"), keys, ["role", "type"])


ROLES = ["sent", "got"]
KEYS = ["bank", "account"]


def _minutes(name: str):
    return F.floor(F.unix_seconds(F.col(name).cast("timestamp")) / 60)


def payment_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bank, account, role, type, at, x): each payment once for its payer and once for its payee; at in minutes."""
    trans = table(spark, sf_dir, "hi_small_trans", "timestamp", "from_bank", "from_account", "to_bank", "to_account", "amount_paid", "amount_received", "payment_format")
    sides = F.array(
        F.struct(F.lit(0).alias("role"), account("from_bank").alias("bank"), account("from_account").alias("account"), F.col("amount_paid").alias("x")),
        F.struct(F.lit(1).alias("role"), account("to_bank").alias("bank"), account("to_account").alias("account"), F.col("amount_received").alias("x")),
    )
    return trans.select(F.col("payment_format").alias("type"), _minutes("timestamp").alias("at"), F.explode(sides).alias("s")).select("s.*", "type", "at").where("bank is not null and account is not null")


def _spelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    trans = table(spark, sf_dir, "hi_small_trans", "timestamp", "payment_format")
    return spellings(trans, "payment_format", "timestamp").withColumn("last", _minutes("last"))


def _features(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    types, places, now = vocabulary(_spelled(spark, sf_dir))
    sums = sums_by_type(numbered(payment_events(spark, sf_dir), places, len(types)), KEYS, ["slot"])
    return feature_vectors(sums, KEYS, ROLES, len(types), int(now or 0)), types


def p5_feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per account: number, recency (minutes before the table's latest payment) and total for each payment format, as payer and as payee."""
    return _features(spark, sf_dir)[0]


def p5_feature_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table with a named column for each role, format and measure."""
    vectors, types = _features(spark, sf_dir)
    return feature_columns(vectors, KEYS, ROLES, types)


def p5_feature_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The format at each place of the vectors."""
    types = vocabulary(_spelled(spark, sf_dir))[0]
    return spark.createDataFrame(list(enumerate(types)), "place int, payment_format string")


def p5_feature_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of the table that hold events, a row each; the other cells have number 0, total 0 and no recency."""
    vectors, types = _features(spark, sf_dir)
    cells = vectors.select(*KEYS, F.explode(F.array(*(F.struct(F.lit(r).alias("role"), F.arrays_zip(*(F.col(f"{r}_{m}").alias(m) for m, _ in MEASURES)).alias("z")) for r in ROLES))).alias("s"))
    cells = cells.select(*KEYS, "s.role", F.posexplode("s.z").alias("place", "c")).where("c.n > 0 or c.total <> 0 or c.recency is not null")
    return cells.select(*KEYS, "role", F.get(F.array(*(F.lit(t) for t in types)), F.col("place")).alias("payment_format"), "c.n", "c.recency", "c.total")


def p5_feature_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same features as rows, without the dense blocks: one per account, role and format that occurs."""
    spelled = _spelled(spark, sf_dir)
    s = feature_rows(payment_events(spark, sf_dir), spelled, KEYS)
    now = spelled.agg(F.max("last").alias("now"))  # one row
    return s.crossJoin(F.broadcast(now)).select(
        *KEYS, F.get(F.array(*(F.lit(r) for r in ROLES)), F.col("role")).alias("role"), F.col("type").alias("payment_format"),
        "n", (F.col("now") - F.col("last")).cast("int").alias("recency"), (F.col("w") + F.col("f") / 1e8 + F.col("h")).alias("total"))


P5_SQL = r"""
WITH e AS (
  SELECT 'sent' AS role, upper(trim(from_bank)) AS bank, upper(trim(from_account)) AS account, amount_paid AS x, payment_format, "timestamp" AS ts FROM hi_small_trans
  UNION ALL SELECT 'got', upper(trim(to_bank)), upper(trim(to_account)), amount_received, payment_format, "timestamp" FROM hi_small_trans
), k AS (
  SELECT *, trim(regexp_replace(regexp_replace(lower(payment_format), '[^\p{L}\p{N}/]+', ' ', 'g'), ' ?/ ?', '/', 'g')) AS fmt, CAST(floor(epoch(ts) / 60) AS BIGINT) AS mins FROM e WHERE bank <> '' AND account <> ''
)
SELECT bank, account, role, fmt AS payment_format, CAST(count(*) AS INTEGER) AS n, CAST((SELECT max(mins) FROM k) - max(mins) AS INTEGER) AS recency,
  CAST(coalesce(sum(CAST(floor(x) AS BIGINT)), 0) AS DOUBLE) + CAST(coalesce(sum(CAST(round((x - floor(x)) * 1e8) AS BIGINT)), 0) AS DOUBLE) / 1e8 AS total
FROM k WHERE fmt <> '' GROUP BY bank, account, role, fmt
"""
P5_TYPES_SQL = r"""
SELECT CAST(row_number() OVER (ORDER BY payment_format) - 1 AS INTEGER) AS place, payment_format FROM (
  SELECT DISTINCT trim(regexp_replace(regexp_replace(lower(payment_format), '[^\p{L}\p{N}/]+', ' ', 'g'), ' ?/ ?', '/', 'g')) AS payment_format FROM hi_small_trans) WHERE payment_format <> ''
"""
ORACLE = {"p5_feature_cells": P5_SQL, "p5_feature_long": P5_SQL, "p5_feature_types": P5_TYPES_SQL}
QUERIES = {"p5_feature_table": p5_feature_table, "p5_feature_columns": p5_feature_columns, "p5_feature_types": p5_feature_types, "p5_feature_cells": p5_feature_cells, "p5_feature_long": p5_feature_long}
