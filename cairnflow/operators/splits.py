"""Leak-checked splits of units(unit, batch_id, y) into train, val and test."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import store

PARTS = ("train", "val", "test")


def temporal_part(batch: Column, train_end: int, val: tuple[int, int], test: tuple[int, int]) -> Column:
    """The part of a batch; null in gaps."""
    return F.when(batch <= train_end, "train").when(batch.between(*val), "val").when(batch.between(*test), "test")


def split_temporal(units: DataFrame, train_end: int, val: tuple[int, int], test: tuple[int, int]) -> DataFrame:
    return units.where("y >= 0").withColumn("part", temporal_part(F.col("batch_id"), train_end, val, test)).where("part is not null")


def split_random(units: DataFrame, key: list[str], seed: int, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """Stratified by label with exact shares: units are ranked within their label by a seeded hash of their key.

    The rank is counted within hash ranges and continued across them, so no label is sorted in one partition.
    """
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in key)))
    u = units.where("y >= 0").withColumn("_h", h).withColumn("_c", F.substring("_h", 1, 2))
    counts = u.groupBy("y", "_c").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("y").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)  # 256 rows a label
    offset = counts.select("y", "_c", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy("y")).alias("_all"))
    r = F.row_number().over(Window.partitionBy("y", "_c").orderBy("_h", *key)) + F.col("_before")
    u = u.join(F.broadcast(offset), ["y", "_c"]).withColumn("_r", r)
    a, b = F.round(F.col("_all") * train), F.round(F.col("_all") * (train + val))
    return u.withColumn("part", F.when(F.col("_r") <= a, "train").when(F.col("_r") <= b, "val").otherwise("test")).drop("_h", "_c", "_before", "_all", "_r")


def rolling_steps(train_end: int, val_width: int, test: tuple[int, int]) -> list[tuple[int, tuple[int, int], tuple[int, int]]]:
    """One (train end, val, test) per test batch: the windows before it slide along."""
    if test[1] <= test[0]:
        raise ValueError("rolling needs at least two test batches")
    gap = test[0] - 1 - val_width - train_end
    return [(t - 1 - val_width - gap, (t - val_width, t - 1), (t, t)) for t in range(test[0], test[1] + 1)]


def split_rolling(units: DataFrame, steps: list[tuple[int, tuple[int, int], tuple[int, int]]]) -> DataFrame:
    """units with (step, part) for every step; one pass, the steps are a literal array."""
    one = [F.struct(F.lit(s[2][0]).alias("step"), temporal_part(F.col("batch_id"), *s).alias("part")) for s in steps]
    return units.where("y >= 0").withColumn("_s", F.explode(F.array(*one))).select("*", "_s.step", "_s.part").drop("_s").where("part is not null")


def leakage_report(split: DataFrame, key: list[str], edges: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """One row for the split, or for each of `by`: units in two parts, parts that are empty or without positives, chronology,
    edges joining train and test.

    edges(src, dst) join units by key, which is then one column.
    """
    by = by or []
    grouped = lambda df: df.groupBy(*by) if by else df.groupBy()
    beside = lambda out, more: out.join(more, by, "left") if by else out.crossJoin(F.broadcast(more))  # noqa: E731  one row each, or one a step
    twice = grouped(split.groupBy(*by, *key).agg(F.count_distinct("part").alias("k"))).agg(F.count_if(F.col("k") > 1).alias("overlapping"))
    stats = grouped(split).agg(
        *(F.count_if(F.col("part") == p).alias(f"n_{p}") for p in PARTS), *(F.count_if((F.col("part") == p) & (F.col("y") == 1)).alias(f"pos_{p}") for p in PARTS),
        F.count_if(F.col("y") < 0).alias("unlabelled"),
        (F.max(F.when(F.col("part") == "train", F.col("batch_id"))) < F.min(F.when(F.col("part") == "val", F.col("batch_id")))).alias("train_before_val"),
        (F.max(F.when(F.col("part") == "val", F.col("batch_id"))) < F.min(F.when(F.col("part") == "test", F.col("batch_id")))).alias("val_before_test"),
    )
    out = beside(stats, twice)
    if edges is not None:
        a = split.select(*by, F.col(key[0]).alias("src"), F.col("part").alias("_a"))
        b = split.select(*by, F.col(key[0]).alias("dst"), F.col("part").alias("_b"))
        bad = grouped(edges.join(a, "src").join(b, ["dst", *by])).agg(F.count_if(F.concat_ws("-", "_a", "_b").isin("train-test", "test-train")).alias("joining_edges"))
        out = beside(out, bad)
    return out


def check_leakage(split: DataFrame, key: list[str], temporal: bool, edges: DataFrame | None = None, by: list[str] | None = None) -> None:
    """Raises where the report shows a leak in the split, or in any of those it holds (`by`); edges: none may join train and test."""
    wrong = []
    for r in leakage_report(split, key, edges, by).collect():  # one row a split
        r = r.asDict()
        bad = [k for k in ("overlapping", "unlabelled", "joining_edges") if r.get(k)] + [p for p in PARTS if not r[f"n_{p}"] or not r[f"pos_{p}"]]
        if temporal and not (r["train_before_val"] and r["val_before_test"]):
            bad.append("chronology")
        if bad:
            wrong.append(({k: r[k] for k in by or []}, bad))
    if wrong:
        raise ValueError(f"the split leaks or lacks: {wrong}")


def kept_split(split: DataFrame, params: dict, folder: str) -> dict:
    """Keeps split(step, unit, part) under its definition; where one is kept already, this one must be the same. Returns the note."""
    spark, path = split.sparkSession, f"{folder}/{definition_hash(params)}"
    hashed = split_hash(split, ["step", "unit"], params)
    note = store.get(spark, f"{path}/note")
    if note is None:
        split.write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows")
        sizes = {r["part"]: r["n"] for r in split.groupBy("part").agg(F.count("*").alias("n")).collect()}  # three rows
        store.put(spark, f"{path}/note", note := {"sizes": sizes, "split_hash": hashed, "definition_hash": definition_hash(params), "params": params})
    for what, h in (("made now", hashed), ("kept", split_hash(spark.read.parquet(f"{path}/rows"), ["step", "unit"], params))):
        if h != note["split_hash"]:
            raise store.StaleCache(f"the split {what} is not the one kept under its definition: {h}, not {note['split_hash']}")
    return note


def definition_hash(params: dict) -> str:
    return hashlib.sha256(json.dumps(params, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


def split_hash(split: DataFrame, key: list[str], params: dict) -> str:
    """A hash of what is in which part, whatever the order of rows: the sums of unit hashes per part, and the definition."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", *(F.col(k).cast("string") for k in key))), 1, 12), 16, 10).cast("decimal(38,0)")
    rows = split.groupBy("part").agg(F.sum(h).cast("string").alias("s"), F.count("*").alias("n")).orderBy("part").collect()  # three rows
    return definition_hash({"units": [[r["part"], r["s"], r["n"]] for r in rows], "params": params})
