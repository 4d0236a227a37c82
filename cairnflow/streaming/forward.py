"""Forward-only graph features over a stream: a batch is inserted and then scored, and late batches are an error.

A watermark would drop late rows without a word, which is not what causality asks for, so each micro-batch is checked
against the latest time seen. What is carried on are tables in the shared folder, written anew per batch: the pairs of
the last w times, from which windows are counted and from which older ones are evicted; every pair ever seen, which no
window evicts; and each vertex's degree so far. A note, written last, says which batch they stand after. So a driver or an
executor may be lost at any moment: a new driver goes on from the note, and a batch that is delivered again is not
counted again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import store
from ..operators import graph as G
from ..session import table
from .daily import shared_folder, stream_files

PAIR = ["vertex", "way", "other"]


class LateBatch(ValueError):
    """A batch holds times before one already scored."""


class ForwardFeatures:
    """The counts of `vertex_statistics` for one batch of edges (src, dst, edge_time) after another."""

    def __init__(self, spark: SparkSession, folder: str, w: int):
        self.spark, self.folder, self.w = spark, folder.rstrip("/"), w

    @property
    def note(self) -> dict | None:
        """The last batch that was scored: its number, its latest time, and every batch scored so far."""
        return store.get(self.spark, f"{self.folder}/note")

    def _state(self, number: int, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/state-{number}/{name}")

    def step(self, batch: DataFrame, number: int) -> None:
        """Inserts the batch's edges and scores them; what they get is read by `scored`."""
        note = self.note
        if note is not None and number <= note["number"]:
            return
        days = batch.select("edge_time", F.inline(F.array(
            F.struct(F.col("src").alias("vertex"), F.col("dst").alias("other"), F.lit(0).alias("way")), F.struct(F.col("dst").alias("vertex"), F.col("src").alias("other"), F.lit(1).alias("way")))))
        days = days.groupBy(*PAIR, "edge_time").agg(F.count("*").alias("n"))
        here = f"{self.folder}/state-{number}"
        days.write.mode("overwrite").parquet(f"{here}/new")
        new = self._state(number, "new")
        span = new.agg(F.min("edge_time").alias("a"), F.max("edge_time").alias("b")).first()
        if span["a"] is None:
            return
        if note is not None and span["a"] < note["last"]:
            raise LateBatch(f"time {span['a']} comes after {note['last']} was scored")
        if note is None:
            recent, pairs, degrees = new, new.select(*PAIR).distinct().limit(0), None
        else:
            recent = self._state(note["number"], "recent").where(F.col("edge_time") > span["a"] - self.w).unionByName(new)
            pairs, degrees = self._state(note["number"], "pairs"), self._state(note["number"], "degrees")
        # windows see the pairs that are kept; over all time, a pair is new where it was never seen
        windowed = G.pair_statistics(recent.groupBy(*PAIR, "edge_time").agg(F.sum("n").alias("n")), self.w)
        fresh = new.join(pairs, PAIR, "left_anti")
        first = fresh.groupBy(*PAIR).agg(F.min("edge_time").alias("edge_time")).withColumn("new", F.lit(1).cast("long"))
        adds = new.join(first, [*PAIR, "edge_time"], "left").groupBy("vertex", "edge_time").agg(*(
            F.sum(F.when(F.col("way") == i, x).otherwise(0)).alias(f"{way}_{k}") for i, way in enumerate(G.WAYS) for k, x in (("fan", F.coalesce("new", F.lit(0))), ("degree", F.col("n")))))
        from pyspark.sql import Window

        run = Window.partitionBy("vertex").orderBy("edge_time").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        totals = [f"{way}_{k}" for way in G.WAYS for k in ("fan", "degree")]
        so_far = adds.select("vertex", "edge_time", *(F.sum(c).over(run).alias(f"_{c}") for c in totals))
        if degrees is not None:
            so_far = so_far.join(degrees, "vertex", "left")
        before = lambda c: F.coalesce(F.col(c), F.lit(0)) if degrees is not None else F.lit(0)
        so_far = so_far.select("vertex", "edge_time", *((F.col(f"_{c}") + before(c)).alias(c.replace("_", "_all_")) for c in totals))
        out = windowed.select("vertex", "edge_time", *totals).join(so_far, ["vertex", "edge_time"])
        out = out.withColumns({f"{way}_all_ratio": F.when(F.col(f"{way}_all_degree") > 0, F.col(f"{way}_all_fan") / F.col(f"{way}_all_degree")).otherwise(0.0) for way in G.WAYS})
        out.write.mode("overwrite").parquet(f"{self.folder}/scored/batch={number}")
        # what the next batch needs: nothing older than the window can fall into one of its windows
        recent.where(F.col("edge_time") > span["b"] - self.w).write.mode("overwrite").parquet(f"{here}/recent")
        pairs.unionByName(fresh.select(*PAIR).distinct()).write.mode("overwrite").parquet(f"{here}/pairs")
        ends = adds.groupBy("vertex").agg(*(F.sum(c).alias(c) for c in totals))
        ends = ends if degrees is None else ends.unionByName(degrees).groupBy("vertex").agg(*(F.sum(c).alias(c) for c in totals))
        ends.write.mode("overwrite").parquet(f"{here}/degrees")
        store.put(self.spark, f"{self.folder}/note", {"number": number, "last": span["b"], "batches": [*(note["batches"] if note else []), number]})

    def scored(self) -> DataFrame:
        """(vertex, edge_time, counts) of every time at which a vertex acted: a time that came in several batches as it stood after the last."""
        note = self.note
        if note is None:
            raise LookupError("no batch has been scored")
        rows = self.spark.read.parquet(*(f"{self.folder}/scored/batch={b}" for b in note["batches"])).withColumn("batch", F.regexp_extract(F.col("_metadata.file_path"), r"batch=(\d+)", 1).cast("long"))
        cols = [c for c in rows.columns if c not in ("vertex", "edge_time", "batch")]
        return rows.groupBy("vertex", "edge_time").agg(F.max_by(F.struct(*cols), "batch").alias("s")).select("vertex", "edge_time", "s.*")


def replay(spark: SparkSession, edges: DataFrame, batches: list[int], w: int, folder: str | None = None) -> DataFrame:
    """Edges through the forward driver as a stream of batches that end at the given times, one file each, in order."""
    folder = folder or shared_folder(spark, "forward")
    driver = ForwardFeatures(spark, folder, w)
    begun, last = f"{folder}/source", None
    for i, end in enumerate(batches):
        part = edges.where((F.col("edge_time") <= end) & (F.lit(True) if last is None else F.col("edge_time") > last))
        part.select("src", "dst", "edge_time").coalesce(1).write.mode("overwrite").parquet(f"{begun}/part={i:06d}")
        last = end
    for i in range(len(batches)):  # files are handed over in the order of their names, whatever their times
        source = spark.readStream.schema("src long, dst long, edge_time long").parquet(f"{begun}/part={i:06d}")
        q = source.writeStream.option("checkpointLocation", f"{folder}/offsets-{i}").foreachBatch(lambda b, _n, i=i: driver.step(b, i)).trigger(availableNow=True).start()
        q.awaitTermination()
    return driver.scored()


def replay_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events(user_id, day) through the forward driver in one stream: every user's events up to each day."""
    path = f"{sf_dir}/events.parquet"
    first = table(spark, sf_dir, "events", "ts").agg(F.min("ts")).first()[0]
    driver = ForwardFeatures(spark, shared_folder(spark, "forward"), 1)
    days = stream_files(spark, path, 1).select(F.col("user_id").alias("src"), F.lit(-1).cast("long").alias("dst"), F.datediff(F.to_date("ts"), F.lit(first.date())).cast("long").alias("edge_time"))
    q = days.writeStream.option("checkpointLocation", shared_folder(spark, "forward-check")).foreachBatch(lambda b, i: driver.step(b, i)).trigger(availableNow=True).start()
    q.awaitTermination()
    if driver.note is None:
        return spark.createDataFrame([], "user_id long, edge_time long, degree long")
    return driver.scored().where("vertex >= 0").select(F.col("vertex").alias("user_id"), "edge_time", F.col("out_all_degree").alias("degree"))
