import datetime as dt
import json

import numpy as np
import pytest
from pydantic import ValidationError
from pyspark.sql import functions as F

from cairnflow import features as X
from cairnflow import pipeline, store
from cairnflow.config import Config, Dataset, Features, Model, Regime, Synthetic, load_config
from cairnflow.models import trees
from cairnflow.sources import graphs


def rows(spark, n=400):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] + .5 * x[:, 1] > .6).astype(int)
    return spark.createDataFrame([(int(a), *map(float, b), i) for i, (a, b) in enumerate(zip(y, x))], "y int, a double, b double, c double, unit long")


def test_trees_learn_explain_and_keep(spark):
    d = rows(spark)
    m = trees.fit(d.where("unit < 300"), d.where("unit >= 300"), ["a", "b", "c"], n_trees=6)
    got = m.explain(m.transform(d.where("unit >= 300"))).collect()
    for r in got:
        assert abs(r["base"] + sum(r["contributions"]) - r["logit"]) < 1e-8
        assert abs(1 / (1 + np.exp(-r["logit"])) - r["p"]) < 1e-9
    assert np.mean([(r["p"] >= .5) == r["y"] for r in got]) > .8
    assert sum(abs(r["contributions"][0]) for r in got) > sum(abs(r["contributions"][2]) for r in got)
    again = trees.BoostedTrees.from_json(m.to_json())
    x = np.array([[.1, .2, .3], [2, 2, 2]])
    assert (again.margins(x) == m.margins(x)).all()
    with pytest.raises(ValueError):
        trees.fit(d.withColumn("y", F.lit(-1)), d, ["a"])


def test_config_refuses_nonsense(tmp_path):
    base = {"dataset": {"name": "synthetic", "synthetic": {}}, "regimes": [{"regime": "temporal", "train_end": 6, "val": [7, 8], "test": [9, 12]}], "models": [{"name": "gbt"}]}
    Config.model_validate(base)
    for wrong in ({"typo": 1}, {"models": [{"name": "sage", "features": "raw"}]}, {"models": [{"name": "gbt"}, {"name": "gbt"}]}, {"seeds": [1, 1]}, {"features": {"bins": [4, 2]}}, {"features": {"families": ["fan", "fan"]}},
                  {"regimes": [{"regime": "temporal", "train_end": 8, "val": [7, 8], "test": [9, 12]}]}, {"regimes": [{"regime": "random", "fractions": [.5, .1, .1]}]}, {"drift": {"event": 9}}, {"score": {"batch": 3}},
                  {"regimes": [{"regime": "temporal_rolling", "train_end": 6, "val": [7, 8], "test": [9, 9]}]}):
        with pytest.raises(ValidationError):
            Config.model_validate(base | wrong)
    with pytest.raises(FileNotFoundError):
        load_config(tmp_path / "none.yaml")
    (tmp_path / "list.yaml").write_text("- 1")
    with pytest.raises(ValueError):
        load_config(tmp_path / "list.yaml")


def test_synthetic_graph_and_cache(spark, tmp_path):
    d = Dataset(name="synthetic", synthetic=Synthetic(n_nodes=300, n_timesteps=6))
    g = graphs.load_graph(spark, d, str(tmp_path))
    assert g.edges.where("src = dst").count() == 0 and g.edges.count() == g.edges.select("edge").distinct().count()
    t = g.nodes.select("node", "node_time")
    e = g.edges.join(t.toDF("src", "a"), "src").join(t.toDF("dst", "b"), "dst")
    assert e.where("edge_time <> greatest(a, b)").count() == 0 and e.where("a <> b").count() == 0
    again = graphs.load_graph(spark, d, str(tmp_path))
    assert again.nodes.count() == 300 and again.meta.blocks == g.meta.blocks
    assert graphs.cache_key(d) != graphs.cache_key(Dataset(name="synthetic", synthetic=Synthetic(n_nodes=300, n_timesteps=6, seed=1)))
    f = Features(families=("fan", "degree", "scatter_gather", "lc_cycle"))
    assert len(X.layout(f)) == 42 and len(X.layout(Features(vertex_stats=False))) == 20
    u = X.unit_features(g, f)
    assert u.count() == 300 and u.columns == ["unit", *X.layout(f, "node")] and len(X.layout(f, "node")) == 36


def test_bank_csv_is_read_by_position(spark, tmp_path):
    head = "Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering\n"
    (tmp_path / "t.csv").write_text(head + "2022/09/01 00:20,010,80001,0012,8F,10.5,US Dollar,10.5,US Dollar,ACH,0\n2022/09/02 01:00,0012,8F,010,80001,3,Euro,3,Euro,Wire,1\n")
    g = graphs.read_amlworld(spark, Dataset(name="amlworld", path=str(tmp_path / "t.csv")))
    e = g.edges.orderBy("edge_time").collect()
    assert [r["src"] for r in e] == ["010:80001", "0012:8F"] and [r["edge_time"] for r in e] == [0, 24] and [r["batch_id"] for r in e] == [0, 1]
    assert [r["payment_format"] for r in e] == [0.0, 1.0] and g.nodes.count() == 2
    one = graphs.read_amlworld(spark, Dataset(name="amlworld", path=str(tmp_path / "t.csv"), max_days=1))
    assert one.edges.count() == 1 and one.meta.version == "v1-d1"


def test_node_csvs(spark, tmp_path):
    cols = ["txId", "Time step", *(f"Local_feature_{i}" for i in range(1, 94)), *(f"Aggregate_feature_{i}" for i in range(1, 73)), "fees"]
    line = lambda i, t: ",".join([str(i), str(t), *["0.5"] * 165, "9"])
    (tmp_path / "txs_features.csv").write_text("\n".join([",".join(cols), line(1, 1), line(2, 1), line(3, 2)]))
    (tmp_path / "txs_classes.csv").write_text("txId,class\n1,1\n2,2\n")
    (tmp_path / "txs_edgelist.csv").write_text("txId1,txId2\n1,2\n")
    g = graphs.read_elliptic(spark, Dataset(name="elliptic", path=str(tmp_path)))
    assert {r["node"]: r["y"] for r in g.nodes.collect()} == {1: 1, 2: 0, 3: -1} and g.meta.dropped == ["fees"]
    for bad in ("1,9", "1,3"):  # no such transaction; across time steps
        (tmp_path / "txs_edgelist.csv").write_text(f"txId1,txId2\n{bad}\n")
        with pytest.raises(ValueError):
            graphs.read_elliptic(spark, Dataset(name="elliptic", path=str(tmp_path)))


def test_forward_driver_equals_the_batch_plan(spark, tmp_path):
    from cairnflow.operators import graph as G
    from cairnflow.streaming.forward import ForwardFeatures, LateBatch, replay

    rng = np.random.default_rng(5)
    edges = spark.createDataFrame([(int(a), int(b), int(t)) for a, b, t in zip(rng.integers(0, 12, 400), rng.integers(0, 12, 400), rng.integers(0, 20, 400))], "src long, dst long, edge_time long")
    want = G.vertex_statistics(edges, 3)
    got = replay(spark, edges, [3, 4, 11, 19], 3, str(tmp_path / "f"))
    assert got.select(want.columns).exceptAll(want).count() == 0 and want.count() == got.count()
    driver = ForwardFeatures(spark, str(tmp_path / "f"), 3)  # another driver goes on from what is kept
    assert driver.note["last"] == 19 and driver.note["batches"] == [0, 1, 2, 3]
    assert spark.read.parquet(str(tmp_path / "f/state-3/recent")).agg(F.min("edge_time")).first()[0] > 16  # older pairs are evicted
    driver.step(edges.where("edge_time = 19"), 3)  # delivered again: not counted again
    assert driver.scored().exceptAll(got).count() == 0
    with pytest.raises(LateBatch):
        driver.step(edges.where("edge_time = 18"), 4)
    same = edges.where("edge_time = 19")
    driver.step(same, 5)  # the latest time may go on
    twice = G.vertex_statistics(edges.unionByName(same), 3)
    assert driver.scored().select(twice.columns).exceptAll(twice).count() == 0


def test_smoke_end_to_end(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("CAIRNFLOW_DATA_DIR", str(tmp_path / "data"))
    cfg = Config(
        dataset=Dataset(name="synthetic", synthetic=Synthetic(n_nodes=500, n_timesteps=8, illicit_rate=.3, unknown_rate=.3)), regimes=(Regime(regime="temporal", train_end=4, val=(5, 6), test=(7, 8)),),
        models=(Model(name="gbt", features="base", params={"n_estimators": 3, "max_depth": 2}),), metrics=("f1", "pr_auc"), drift={"detectors": ("psi", "conf", "alert")}, score={"batch": 7})
    out = tmp_path / "out"
    files = pipeline.run_benchmark(spark, cfg, out)
    assert all(p.is_file() for p in files.values())
    parent = store.latest_parent(spark, str(out), "default")
    child = store.child_runs(spark, str(out), "default", parent).first()
    pred = store.predictions(spark, str(out), child["run_id"])
    from cairnflow.operators import evaluation as E

    assert {r["part"] for r in pred.select("part").distinct().collect()} == {"val", "test"}
    assert abs(E.confusion(pred.where("part = 'test'"), F.col("threshold")).first()["f1"] - child["metrics"]["f1"]) < 1e-12
    # the second run reads what the first kept, and its results are those of the first
    first = files["results"].read_text()
    pipeline.run_benchmark(spark, cfg, out)
    latest = store.latest_parent(spark, str(out), "default")
    assert latest != parent and len(files["results"].read_text().splitlines()) == len(first.splitlines())
    assert store.differences(store.comparable(spark, str(out), "default", parent), store.comparable(spark, str(out), "default", latest)).count() == 0
    assert store.child_runs(spark, str(out), "default").count() == 2
    for wrong in (lambda: store.latest_parent(spark, str(out), "other"), lambda: store.child_runs(spark, str(out), "default", "none"), lambda: store.predictions(spark, str(out), "none"), lambda: store.child_runs(spark, str(tmp_path / "no"), "default")):
        with pytest.raises(LookupError):
            wrong()
    files, flagged = pipeline.run_score(spark, cfg, out)
    health = json.loads(files["health"].read_text())
    assert health["flagged"] == flagged and health["note"] == pipeline.NOTE and "<script" not in files["page"].read_text()
    before = files["alerts"].read_text()
    files, _ = pipeline.run_score(spark, cfg, out)  # the deployed model is used again
    assert files["alerts"].read_text() == before
    drift = pipeline.run_drift(spark, cfg, out)
    assert all(p.is_file() for p in drift.values())


def test_features_are_kept_and_checked(spark, tmp_path):
    d = Dataset(name="synthetic", synthetic=Synthetic(n_nodes=200, n_timesteps=5))
    f = Features(families=("fan", "degree"))
    g = graphs.load_graph(spark, d, str(tmp_path / "graphs"))
    first = X.kept_features(g, f, str(tmp_path))
    path = f"{tmp_path}/features/{X.feature_version(g, f)}"
    note = store.get(spark, f"{path}/note")
    assert note["columns"] == X.layout(f, "node") and note["seconds"] >= 0
    assert X.kept_features(g, f, str(tmp_path)).exceptAll(first).count() == 0
    kept = spark.read.parquet(f"{path}/rows")
    kept.where("unit <> 7").write.parquet(f"{path}/less")
    (tmp_path / "x").mkdir()
    import shutil

    shutil.rmtree(f"{path}/rows")
    shutil.move(f"{path}/less", f"{path}/rows")
    with pytest.raises(store.StaleCache, match="other rows"):
        X.kept_features(g, f, str(tmp_path))
    store.put(spark, f"{path}/note", note | {"columns": note["columns"][::-1]})
    with pytest.raises(store.StaleCache, match="definition"):
        X.kept_features(g, f, str(tmp_path))


def test_every_split_is_checked_for_leaks_and_kept(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("CAIRNFLOW_DATA_DIR", str(tmp_path))
    rolling = Regime(regime="temporal_rolling", train_end=4, val=(5, 6), test=(7, 8))
    apart = graphs.load_graph(spark, Dataset(name="synthetic", synthetic=Synthetic(n_nodes=500, n_timesteps=8, illicit_rate=.3, unknown_rate=.3)))
    splits = pipeline.split_of(apart.units, rolling, apart)
    assert [s.agg(F.max("batch_id")).first()[0] for s in splits] == [7, 8]
    assert len(pipeline.split_of(apart.units, rolling, apart)) == 2  # the same again
    with pytest.raises(store.StaleCache):
        pipeline.split_of(apart.units.where("unit <> 3 or y < 0").withColumn("unit", F.col("unit") + 1), rolling, apart)
    late = apart.units.withColumn("y", F.when((F.col("batch_id") == 8) & (F.col("y") == 1), 0).otherwise(F.col("y")))
    with pytest.raises(ValueError, match="test"):  # the last of the steps has no positives
        pipeline.split_of(late, rolling, apart)
    across = graphs.load_graph(spark, Dataset(name="synthetic", synthetic=Synthetic(n_nodes=500, n_timesteps=8, illicit_rate=.3, unknown_rate=.3, cross_time_edges=True)))
    for r in (rolling, Regime(regime="temporal", train_end=4, val=(5, 6), test=(7, 8))):
        with pytest.raises(ValueError, match="joining_edges"):
            pipeline.split_of(across.units, r, across)
    assert len(pipeline.split_of(across.units, Regime(regime="random"), across)) == 1


def test_published_counts_and_edge_ids():
    good = dict(graphs.PUBLISHED["elliptic"]["2023.1"])
    graphs.check_published("elliptic", "2023.1", good)
    graphs.check_published("elliptic", "mine", {})
    with pytest.raises(ValueError, match="edges"):
        graphs.check_published("elliptic", "2023.1", good | {"edges": 1})


def test_runs_without_tags_are_an_error(spark, tmp_path):
    store.log(spark, str(tmp_path), [{"run_id": "a", "parent_run_id": "p", "experiment": "e", "kind": "child", "started": 1.0, "seed": 0, "tags": {"regime": "x"}, "params": {}, "metrics": {"f1": .5}}], [])
    with pytest.raises(ValueError, match="tags"):
        store.measured(store.child_runs(spark, str(tmp_path), "e"))


def test_growing_stops_by_itself(spark, monkeypatch):
    monkeypatch.setattr(trees, "FIRST", 3)
    d = rows(spark, 300)
    grown = []
    grow = trees._grow
    monkeypatch.setattr(trees, "_grow", lambda *a: grown.append(a[3]) or grow(*a))
    m = trees.fit(d.where("unit < 200"), d.where("unit >= 200"), ["a", "b"], n_trees=40, depth=2, patience=4)
    assert grown[:2] == [3, 6] and grown == sorted(grown) and len(m.trees) == m.info["best_iteration"] <= grown[-1]
    again = trees.fit(d.where("unit < 200"), d.where("unit >= 200"), ["a", "b"], n_trees=len(m.trees), depth=2)
    assert np.allclose(again.margins(np.ones((1, 2)))[-1], m.margins(np.ones((1, 2)))[-1])


def test_detectors_refuse_what_cannot_be_compared(spark):
    from cairnflow.operators import drift as D

    u = spark.createDataFrame([(1, .5, 1.0, "x"), (2, .5, 1.0, "x")], "batch_id int, p double, a double, s string")
    D.check_inputs(u, ["a"], [1])
    for cols, ref in (([], [1]), (["s"], [1]), (["none"], [1]), (["a"], [3]), (["a"], [1, 2])):
        with pytest.raises(ValueError):
            D.check_inputs(u, cols, ref)


@pytest.mark.parametrize("name", ["tree_contributions", "gbt_scores"])
def test_tree_queries_read_a_written_table(spark, sf_dir, name):
    import __spark_entry__ as entry

    got = entry.queries()[name](spark, sf_dir)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Join")), plan  # else scoring shuffles the rows once more
    assert got.where("l_orderkey is null or l_linenumber is null or l_partkey is null").count() == 0 < got.count()


@pytest.mark.parametrize("held", [1 << 24, 0])  # by the driver, or as a table
def test_trees_are_those_of_spark_ml(spark, monkeypatch, held):
    import pandas as pd

    monkeypatch.setattr(trees, "HELD", held, raising=False)
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rng = np.random.default_rng(0)
    few = pd.DataFrame({"unit": range(2_000), "a": rng.integers(0, 30, 2_000) / 4, "b": rng.integers(0, 5, 2_000) * 1.0})
    d = spark.createDataFrame(few.assign(y=(rng.random(2_000) < .1 + few.a * (few.b > 2) / 16).astype(int)))
    m = trees.fit(d, d, ["a", "b"], n_trees=12)  # more than are walked before margins are written anew
    vec = VectorAssembler(inputCols=["a", "b"], outputCol="x").transform(d.withColumn("w", F.when(F.col("y") == 1, m.info["weight"]).otherwise(1.0)))
    want = GBTClassifier(labelCol="y", featuresCol="x", weightCol="w", maxIter=len(m.trees), maxDepth=3, stepSize=.3).fit(vec).transform(vec).orderBy("unit").select(vector_to_array("probability")[1]).toPandas()
    assert len(m.trees) > 10 and np.allclose(m.transform(d).orderBy("unit").select("p").toPandas(), want, rtol=0, atol=1e-12)


def test_cuts_of_trees_come_from_all_rows(spark):
    import pandas as pd

    rng = np.random.default_rng(0)
    v = rng.permutation(12_800) * 1.0  # more rows than Spark ML draws its cuts from
    many = spark.createDataFrame(pd.DataFrame({"a": v, "y": (rng.random(12_800) < .5).astype(int)}))
    one, other = (trees.fit(many, many, ["a"], n_trees=2, seed=s) for s in (0, 1))
    assert one.to_json() == other.to_json()
    y = many.orderBy("a").select("y").toPandas().y.to_numpy()
    share = np.cumsum(np.where(y == 1, one.info["weight"], 1.0)) / (2 * (y == 0).sum())
    exact = {float(np.searchsorted(share, k / 32 - 1e-12)) for k in range(1, 32)}
    assert {t for tree in one.trees for f, t in zip(tree.feature, tree.threshold) if f >= 0} <= exact
