"""Message passing without a deep-learning library: k-hop neighbour means as features, then a weighted logistic model.

An approximation of a two-layer mean-aggregating network: the aggregations are the same, the transformations between
them are left out. Aggregation is joins and averages, so it scales with the edges; training is Spark ML.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import neighbour_mean, with_cumulative
from ..session import forget, shares, written


def hop_features(nodes: DataFrame, edges: DataFrame, cols: list[str], hops: int = 2) -> DataFrame:
    """nodes(node, cols) with h1_*, h2_*, ...: means over in-neighbours; 0 without any."""
    out, level = nodes, nodes.select("node", *cols)
    for h in range(1, hops + 1):
        level = neighbour_mean(edges, level, cols)
        out = out.join(level.select("node", *(F.col(c).alias(f"h{h}_{c}") for c in cols)), "node", "left")
    return out.na.fill(0, [f"h{h}_{c}" for h in range(1, hops + 1) for c in cols])


def causal_edge_inputs(edges: DataFrame) -> DataFrame:
    """Edge rows with both ends' cumulative counts: what an account without own features brings to a payment.

    edges come from written() and are forgotten. They are placed by each end in shares, so that no shuffle stands whole beside
    another; the table that is returned is read as often as a model needs it.
    """
    first = written(*(with_cumulative(e, "src", "dst", "src") for e in shares(edges, "src")))
    forget(edges)
    both = written(*(with_cumulative(e, "dst", "src", "dst").where("src is not null and dst is not null and edge_time is not null and y >= 0") for e in shares(first, "dst")))
    forget(first)
    return both


def fit(train: DataFrame, features: list[str], iterations: int = 30, penalty: float = 1e-3) -> PipelineModel:
    """z-scores from train rows only, then logistic regression with positives weighted by n_neg / n_pos."""
    c = train.agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")).first()
    if not c["pos"] or not c["neg"]:
        raise ValueError("training needs both labels")
    rows = train.select(F.col("y").cast("double").alias("y"), *(F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features)).withColumn("w", F.when(F.col("y") == 1, c["neg"] / c["pos"]).otherwise(1.0))
    stages = [
        VectorAssembler(inputCols=features, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True),
        LogisticRegression(featuresCol="_x", labelCol="y", weightCol="w", maxIter=iterations, regParam=penalty, standardization=False),
    ]
    return Pipeline(stages=stages).fit(rows)


def score(model: PipelineModel, df: DataFrame, features: list[str]) -> DataFrame:
    rows = df.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features})
    return model.transform(rows).withColumn("p", vector_to_array("probability")[1]).drop("_raw", "_x", "rawPrediction", "probability", "prediction")
