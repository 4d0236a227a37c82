"""Daily scoring as a stream: tumbling days, and batches handed to the same functions the batch plan uses."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_root


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the session's shared checkpoint folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def stream_files(spark: SparkSession, path: str, per_batch: int | None = None) -> DataFrame:
    """A stream over a folder of parquet files, or over the one file that has the name."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    files = spark.read.parquet(path).inputFiles()
    if len(files) == 1 and files[0].rstrip("/").endswith("/" + path.rstrip("/").rsplit("/", 1)[-1]):
        folder, name = path.rstrip("/").rsplit("/", 1)
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def daily_totals(events: DataFrame) -> DataFrame:
    """(day, user_id, n, total) over tumbling days; batch and stream alike."""
    return events.groupBy(F.to_date("ts").alias("day"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def run_available(plan: Callable[[DataFrame], DataFrame], spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The plan over a stream of parquet files, run to the end of what there is; one row per key, as it stood last.

    A batch writes only the keys it changed, to a folder of its own in the shared folder, so no batch writes again what
    others have written, and one that is run again after a loss replaces its own rows.
    """
    out, state = shared_folder(spark, "stream-out"), shared_folder(spark, "stream-state")
    stream = stream_files(spark, path)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    changed = plan(stream)
    q = changed.writeStream.outputMode("update").option("checkpointLocation", state).foreachBatch(keep).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.lastProgress is None:
        return plan(spark.read.schema(stream.schema).parquet(path)).limit(0)
    rows = spark.read.parquet(out)
    rest = [c for c in changed.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_s")).select(*keys, "_s.*")
