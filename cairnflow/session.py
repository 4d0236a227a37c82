"""Session helpers: table access, the shared checkpoint folder and default settings."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "6g", **conf: str) -> SparkSession:
    """A local session for tests, the bench and the command line."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("cairnflow")
    for k, v in {**DEFAULTS, "spark.driver.memory": memory, "spark.sql.shuffle.partitions": str(shuffle_partitions), **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A parquet table of the data folder, narrowed to the named columns."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share, which the session names in ``spark.checkpoint.dir``.

    Only on one machine, as in tests, may the setting be absent; then a temporary folder stands in for it.
    """
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "cairnflow-checkpoints")


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared checkpoint folder so that lost executors cost no lineage."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint(eager=True)


#: Into how many shares a table is cut that is made share by share.
ROUNDS = 4


def shares(df: DataFrame, *keys: str) -> list[DataFrame]:
    """df in ROUNDS parts, by what the keys hash to; nulls too. Not the hash that rows are shuffled by, so a part fills all tasks."""
    return [df.where(F.pmod(F.xxhash64(*keys), F.lit(ROUNDS)) == i) for i in range(ROUNDS)]


def written(*parts: DataFrame) -> DataFrame:
    """The rows of all parts as a table in the shared checkpoint folder, by columns and compressed, which is a fraction of what
    cut() takes. Parts are made one after the other, and what was shuffled for one is given back before the next. The table
    itself goes with forget() or with the session."""
    spark, schema = parts[0].sparkSession, parts[0].schema
    path = f"{shared_root(spark)}/written-{uuid.uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        for df in parts:
            df.write.mode("append").parquet(path)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(schema).parquet(path)


def forget(table: DataFrame) -> None:
    """Deletes what written() returned; nothing may read it any more."""
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        where = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def parallelism(spark: SparkSession) -> int:
    """Cores the session can use at once, as Spark reports them."""
    return max(1, spark.sparkContext.defaultParallelism)
