"""What runs keep between them, as small tables in any folder Spark can reach: notes, caches with a sidecar, tracked runs.

A cache is a parquet folder and a note beside it, written last: without the note there is no cache, so a job that was lost
half way leaves nothing that could be taken for one.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUNS = (
    "run_id string, parent_run_id string, experiment string, kind string, started double, seed int, tags map<string,string>, params map<string,string>, metrics map<string,double>")
HISTORY = "run_id string, metric string, step long, value double"
TAGS = ("dataset", "regime", "model", "features", "feature_version", "split_hash", "commit")


class StaleCache(ValueError):
    """A cache that does not hold what its note or its reader says."""


def put(spark: SparkSession, path: str, note: dict) -> None:
    spark.createDataFrame([(json.dumps(note, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def get(spark: SparkSession, path: str) -> dict | None:
    """The note at a path; None where there is none."""
    try:
        rows = spark.read.text(path).collect()  # one line
    except AnalysisException:
        return None
    return json.loads(rows[0]["value"]) if rows else None


def kept(spark: SparkSession, path: str, build: Callable[[], DataFrame], note: Callable[[], dict], check: Callable[[DataFrame, dict], None]) -> DataFrame:
    """The rows kept at a path after `check`; where none are kept, they are built and kept first."""
    said = get(spark, f"{path}/note")
    if said is None:
        build().write.mode("overwrite").parquet(f"{path}/rows")
        put(spark, f"{path}/note", said := note())
    rows = spark.read.parquet(f"{path}/rows")
    check(rows, said)
    return rows


def check_rows(rows: DataFrame, columns: list[str], want: DataFrame, key: list[str]) -> None:
    """Raises unless rows have these columns, in order, and the same keys as `want`, each as often."""
    if rows.columns != columns:
        raise StaleCache(f"the cache has other columns: {[c for c in rows.columns if c not in columns][:5]} for {[c for c in columns if c not in rows.columns][:5]}")
    sides = rows.select(*key, F.lit(1).alias("_n")).unionByName(want.select(*key, F.lit(-1).alias("_n")))
    wrong = sides.groupBy(*key).agg(F.sum("_n").alias("_n")).where("_n <> 0").limit(5).collect()
    if wrong:
        raise StaleCache(f"the cache has other rows: {[tuple(r)[:-1] for r in wrong]}")


# -- tracked runs ---------------------------------------------------------------------------------------------------


def log(spark: SparkSession, root: str, runs: list[dict], history: list[tuple]) -> None:
    """Appends runs, a parent and its children, and the metrics per step of the children."""
    names = [c.split()[0] for c in RUNS.split(", ")]
    spark.createDataFrame([tuple(r.get(c) for c in names) for r in runs], RUNS).coalesce(1).write.mode("append").parquet(f"{root}/runs")
    if history:
        spark.createDataFrame(history, HISTORY).coalesce(1).write.mode("append").parquet(f"{root}/metric_history")


def _runs(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(RUNS).parquet(f"{root}/runs")
    except AnalysisException:
        raise LookupError(f"no runs are kept in {root}") from None


def latest_parent(spark: SparkSession, root: str, experiment: str) -> str:
    """The parent run of an experiment that began last."""
    rows = _runs(spark, root).where((F.col("experiment") == experiment) & (F.col("kind") == "parent")).orderBy(F.desc("started"), "run_id").limit(1).collect()
    if not rows:
        raise LookupError(f"no experiment {experiment!r} in {root}")
    return rows[0]["run_id"]


def child_runs(spark: SparkSession, root: str, experiment: str, parent: str | None = None) -> DataFrame:
    """The child runs of an experiment, or of one parent; none is an error."""
    runs = _runs(spark, root).where((F.col("experiment") == experiment) & (F.col("kind") == "child"))
    runs = runs if parent is None else runs.where(F.col("parent_run_id") == parent)
    if runs.isEmpty():
        raise LookupError(f"no child runs of {experiment!r}" + (f" under {parent}" if parent else ""))
    return runs


def measured(children: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """A row per child and metric, with its tags as columns; a run without one of them is an error."""
    lacking = children.where(" or ".join(f"tags['{t}'] is null" for t in TAGS)).select("run_id").limit(5).collect()
    if lacking:
        raise ValueError(f"runs lack one of the tags {TAGS}: {[r[0] for r in lacking]}")
    out = children.select("run_id", "parent_run_id", "seed", *(F.col("tags")[t].alias(t) for t in TAGS), F.explode("metrics").alias("metric", "value"))
    return out if metrics is None else out.where(F.col("metric").isin(*metrics))


def predictions(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """(unit, time, y, p, part, threshold) of a child run."""
    try:
        return spark.read.parquet(f"{root}/predictions/{run_id}")
    except AnalysisException:
        raise LookupError(f"no predictions of run {run_id} in {root}") from None


def comparable(spark: SparkSession, root: str, experiment: str, parent: str) -> DataFrame:
    """(run, what, name, step, value as text) of a parent's children, without what differs from run to run: ids, times, the commit.

    Numbers count to nine digits, as sums of doubles depend on their order.
    """
    as_text = lambda v: F.coalesce(F.when(v.try_cast("double").isNotNull(), F.format_string("%.9g", v.try_cast("double"))), v.cast("string")).alias("value")
    children = child_runs(spark, root, experiment, parent).withColumn("run", F.concat_ws("/", *(F.col("tags")[t] for t in ("dataset", "regime", "model", "features")), F.col("seed").cast("string")))
    none = F.lit(None).cast("long").alias("step")

    def entries(what: str, leave: tuple[str, ...]) -> DataFrame:
        return children.select("run", F.lit(what).alias("what"), F.explode(what).alias("name", "value")).where(~F.col("name").isin(*leave)).select("run", "what", "name", none, as_text(F.col("value")))

    out = entries("tags", ("commit",)).unionByName(entries("params", ("fit_seconds",))).unionByName(entries("metrics", ("fit_seconds",)))
    try:
        steps = spark.read.schema(HISTORY).parquet(f"{root}/metric_history")
    except AnalysisException:
        return out
    return out.unionByName(children.select("run", "run_id").join(steps, "run_id").select("run", F.lit("history").alias("what"), F.col("metric").alias("name"), "step", as_text(F.col("value"))))


def differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of two comparable dumps that only one of them holds; `side` says which."""
    return before.exceptAll(after).withColumn("side", F.lit("before")).unionByName(after.exceptAll(before).withColumn("side", F.lit("after")))
