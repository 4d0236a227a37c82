"""Runs of a configuration: benchmark, drift and the deployed daily score. Only this module knows all the others."""

from __future__ import annotations

import csv
import hashlib
import json
import os
import subprocess
import time
import uuid
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import features as X
from . import report, store
from .config import METRICS, Config, Dataset, Model, Regime, Score, Synthetic, root
from .models import get_model, sage, trees
from .operators import drift as D
from .operators import evaluation as E
from .operators import reporting as R
from .operators import splits as S
from .session import cut
from .sources.graphs import GraphTables, load_graph

NOTE = "No flag is not an all-clear: detectors see scores and features, never labels."


@dataclass
class Fitted:
    pred: DataFrame  # unit, time, y, p, part, threshold
    threshold: float
    seconds: float
    info: dict
    model: object
    columns: list[str]


def stamp() -> str:
    """The commit the code stands at, and whether it was changed since."""
    try:
        git = lambda *a: subprocess.run(["git", *a], capture_output=True, text=True, cwd=Path(__file__).parent, timeout=10).stdout.strip()
        sha = git("rev-parse", "--short", "HEAD")
        return (sha + ("-dirty" if git("status", "--porcelain") else "")) if sha else "unknown"
    except (OSError, subprocess.SubprocessError):
        return "unknown"


def units_of(g: GraphTables, cfg: Config) -> DataFrame:
    """Units with every feature a model of the configuration asks for; graph features are built once."""
    u = g.units
    if cfg.needs_graph_features:
        u = u.join(X.kept_features(g, cfg.features, root("data")), "unit")
    return cut(u)


def split_of(units: DataFrame, r: Regime, g: GraphTables) -> list[DataFrame]:
    """One split, or one per step for rolling; every one is checked for leaks, and against how it was split before.

    Nodes are split in time only if no edge joins train and test; edges are units themselves where the task is theirs.
    """
    if r.regime == "random":
        whole = S.split_random(units, ["unit"], r.seed, r.fractions[0], r.fractions[1]).withColumn("step", F.lit(0).cast("long"))
        steps = [0]
    else:
        spans = [(r.train_end, r.val, r.test)] if r.regime == "temporal" else S.rolling_steps(r.train_end, r.val[1] - r.val[0] + 1, r.test)
        steps = [s[2][0] for s in spans]
        whole = S.split_rolling(units, spans).withColumn("step", F.col("step").cast("long"))
    edges = g.edges.select("src", "dst") if r.timed and g.meta.task == "node" and g.meta.cross_time_edges else None
    S.check_leakage(whole.select("unit", "step", "batch_id", "y", "part"), ["unit"], r.timed, edges, ["step"])
    S.kept_split(whole.select("step", "unit", "part"), {"dataset": g.meta.dataset, "version": g.meta.version, "source": g.meta.source, **r.model_dump(mode="json")}, f"{root('data')}/splits")
    return [whole.where(F.col("step") == s).drop("step") for s in steps]


def fit(split: DataFrame, g: GraphTables, cfg: Config, m: Model, seed: int) -> Fitted:
    """Fits on train, takes the threshold on validation, and scores validation and test."""
    began = time.time()
    cols = X.columns(g, m.features, cfg.features)
    rows = split.select("unit", F.col("batch_id").alias("time"), "y", "part", *cols)
    if m.name == "gbt":
        p = {"n_trees": int(m.params.get("n_estimators", trees.CEILING)), "depth": int(m.params.get("max_depth", 3)), "step": float(m.params.get("learning_rate", 0.3))}
        model = get_model(m.name).fit(rows.where("part = 'train'"), rows.where("part = 'val'"), cols, seed=seed, **p)
        pred = model.transform(rows.where("part <> 'train'"))
        info = model.info
    else:
        if g.meta.task == "node":
            hops = sage.hop_features(split.select(F.col("unit").alias("node"), *cols), g.edges, cols)
            use = [c for c in hops.columns if c != "node"]
            rows = split.select("unit", F.col("batch_id").alias("time"), "y", "part").join(hops.withColumnRenamed("node", "unit"), "unit")
        else:
            use = cols
        model = get_model(m.name).fit(rows.where("part = 'train'"), use, int(m.params.get("epochs", 30)))
        pred, info = sage.score(model, rows.where("part <> 'train'"), use), {}
    pred = cut(pred.select("unit", "time", "y", "p", "part"))
    E.check_labels(pred.where("part = 'val'"))
    thr = E.choose_threshold(pred.where("part = 'val'")).first()["threshold"]
    return Fitted(pred.withColumn("threshold", F.lit(thr)), thr, time.time() - began, info, model, cols)


def metrics_of(pred: DataFrame, names: tuple[str, ...], prefix: str = "") -> dict[str, float]:
    """Metrics over test predictions with their own thresholds, under names that begin with the prefix."""
    c = E.confusion(pred, F.col("threshold")).first().asDict()
    c |= {k: v for k, v in E.rank_metrics(pred).first().asDict().items() if k in names}
    at = {"p_at_r50": 0.5, "p_at_r80": 0.8}
    wanted = [n for n in names if n in at]
    if wanted and c["n_pos"]:
        got = {r["recall"]: r["precision"] for r in E.precision_at_recall(pred, [at[n] for n in wanted]).collect()}
        c |= {n: got[at[n]] for n in wanted}
    return {prefix + k: float(v) for k, v in c.items() if v is not None and (k in names or k in ("precision", "recall", "n", "n_pos"))}


def write_csv(path: Path, rows: list[dict], columns: list[str]) -> Path:
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w", newline="") as f:
        w = csv.DictWriter(f, columns, extrasaction="ignore")
        w.writeheader()
        w.writerows(rows)
    return path


def run_benchmark(spark: SparkSession, cfg: Config, out: Path | None = None) -> dict[str, Path]:
    """Every regime, model and seed; tracked runs, curves, results over seeds."""
    out = out or Path(root("report"))
    g = load_graph(spark, cfg.dataset, f"{root('data')}/graphs")
    units = units_of(g, cfg)
    version = X.feature_version(g, cfg.features)
    splits = {r.regime: split_of(units, r, g) for r in cfg.regimes}  # all before the first fit
    parent, commit = uuid.uuid4().hex, stamp()
    runs = [{"run_id": parent, "experiment": cfg.experiment, "kind": "parent", "started": time.time(), "tags": {"commit": commit}, "params": {"config": cfg.model_dump_json()}, "metrics": {}}]
    curves, history = [], []
    for r in cfg.regimes:
        hashed = S.definition_hash(r.model_dump())
        for m in cfg.models:
            for seed in cfg.seeds:
                began = time.time()
                steps = [fit(s, g, cfg, m, seed) for s in splits[r.regime]]
                test = steps[0].pred.where("part = 'test'")
                for s in steps[1:]:
                    test = test.unionByName(s.pred.where("part = 'test'"))  # each row keeps its step's threshold
                # rolling steps have models of their own, so their scores are not ranked together
                got = metrics_of(test, ("f1",) if r.regime == "temporal_rolling" else cfg.metrics)
                tags = {"dataset": cfg.dataset.name, "regime": r.regime, "model": m.name, "features": m.features, "feature_version": version, "split_hash": hashed, "commit": commit}
                run = uuid.uuid4().hex
                params = {**m.params, **steps[-1].info, "threshold": steps[-1].threshold, "fits": len(steps), "columns": len(steps[-1].columns)}
                runs.append({
                    "run_id": run, "parent_run_id": parent, "experiment": cfg.experiment, "kind": "child", "started": began, "seed": seed, "tags": tags, "params": {k: str(v) for k, v in params.items()},
                    "metrics": got | {"fit_seconds": sum(s.seconds for s in steps)}})
                per = [row.asDict() for row in E.per_timestep(test, F.col("threshold")).orderBy("time").collect()]  # a row a batch
                history += [(run, f"ts_{k}", int(row["time"]), float(row[k])) for row in per for k in ("f1", "pr_auc") if row[k] is not None]
                curves += [{**row, **tags, "seed": seed} for row in per]
                predicted = test if len(steps) > 1 else steps[0].pred  # rolling steps validate on batches that are tested by others
                predicted.write.mode("overwrite").parquet(f"{out}/predictions/{run}")
    store.log(spark, str(out), runs, history)
    return reports(spark, cfg, out, parent, curves)


def reports(spark: SparkSession, cfg: Config, out: Path, parent: str, curves: list[dict]) -> dict[str, Path]:
    """The files of a benchmark: results over seeds, from the runs as they are kept, and curves."""
    tracked = store.measured(store.child_runs(spark, str(out), cfg.experiment, parent), list(cfg.metrics))
    table = cut(R.results_table(tracked))
    rows = [r.asDict() for r in table.orderBy("regime", "model", "features", R.metric_order(F.col("metric"), METRICS)).collect()]
    files = {
        "results": write_csv(out / "results.csv", rows, ["dataset", "regime", "model", "features", "metric", "seed_mean", "ci_low", "ci_high", "ci_kind", "n_seeds", "feature_version", "split_hash", "commit"]),
        "curves": write_csv(out / "curves.csv", curves, ["time", "f1", "pr_auc", "n", "n_pos", "regime", "model", "features", "seed"]),
    }
    wide = R.results_wide(table, ["regime", "model", "features"], list(cfg.metrics)).orderBy("regime", "model", "features").collect()
    (out / "results_wide.md").write_text(report.markdown([r.asDict() for r in wide], ["regime", "model", "features", *cfg.metrics]))
    lines, bands = {}, {}
    seen = spark.createDataFrame([(c["regime"], c["model"], c["features"], int(c["time"]), c["f1"]) for c in curves], "regime string, model string, features string, time long, f1 double")
    for c in R.curve_bands(seen, ["regime", "model", "features"]).orderBy("time").collect():  # a row a batch and configuration
        name = f"{c['regime']} {c['model']}.{c['features']}"
        lines.setdefault(name, []).append((c["time"], c["f1_mean"]))
        if c["low"] is not None:
            bands.setdefault(name, []).append((c["time"], c["low"], c["high"]))
    (out / "curves.svg").write_text(report.line_chart(lines, "F1 per batch, mean over seeds", bands=bands))
    return files | {"wide": out / "results_wide.md", "figure": out / "curves.svg"}


def scored_units(f: Fitted, units: DataFrame, window: tuple[int, int], m: Model) -> DataFrame:
    """All units of a window scored, labelled or not: (unit, batch_id, p, columns)."""
    u = units.where(F.col("batch_id").between(*window)).select("unit", "batch_id", *f.columns)
    return cut(f.model.transform(u) if m.name == "gbt" else sage.score(f.model, u, f.columns))


def flags(units: DataFrame, cols: list[str], ref: list[int], threshold: float, cfg: Config) -> DataFrame:
    """(detector, batch_id, score, threshold, flagged)"""
    d = cfg.drift
    D.check_inputs(units, cols, ref)
    thr = F.lit(threshold)
    scores = D.detector_scores(units, cols, ref, thr, d.bins, d.ks_alpha, d.detectors)
    if d.calibrate:
        level = D.calibrate(units, cols, ref, thr, bins=d.bins, alpha=d.ks_alpha, detectors=d.detectors).withColumnRenamed("level", "threshold")
        scores = scores.join(F.broadcast(level), "detector")  # a row a detector
    else:
        fixed = {"psi": d.psi, "ks": d.ks, "conf": d.conf, "alert": d.alert}
        scores = scores.withColumn("threshold", F.create_map(*[F.lit(x) for kv in fixed.items() for x in kv])[F.col("detector")])
    return scores.withColumn("flagged", F.col("score") > F.col("threshold"))


def run_drift(spark: SparkSession, cfg: Config, out: Path | None = None) -> dict[str, Path]:
    """Detectors over every batch after validation, and how early they warn of a falling F1."""
    out = out or Path(root("report"))
    g = load_graph(spark, cfg.dataset, f"{root('data')}/graphs")
    units, r = units_of(g, cfg), cfg.regimes[0]
    split = split_of(units, r, g)[0]
    scores, leads, events = [], [], []
    probes: dict[str, dict[str, float | None]] = {}  # by features: the models of one selection see the same windows
    for m in cfg.models:
        for seed in cfg.seeds:
            f = fit(split, g, cfg, m, seed)
            tag = {"model": m.name, "features": m.features, "seed": seed}
            u = scored_units(f, units, (r.val[0], r.test[1]), m)
            s = cut(flags(u, f.columns, list(range(r.val[0], r.val[1] + 1)), f.threshold, cfg))
            curve = cut(E.per_timestep(f.pred, F.col("threshold")))
            ref = curve.where(F.col("time") <= r.val[1]).agg(F.avg("f1")).first()[0]
            lead = D.lead_time(curve.where(F.col("time") >= r.test[0]), s, ref, cfg.drift.f1_drop, cfg.drift.drop_run)
            scores += [x.asDict() | tag for x in s.orderBy("batch_id", "detector").collect()]
            leads += [x.asDict() | tag for x in lead.orderBy("detector").collect()]
            if cfg.drift.event is not None:
                if cfg.drift.probe and m.features not in probes:
                    probes[m.features] = probe_windows(split.where("part = 'test'"), f.columns, cfg.drift.event)
                events += [x.asDict() | tag | {"probe_roc_auc": probes.get(m.features, {}).get(x["window"])} for x in E.event_windows(f.pred.where("part = 'test'"), cfg.drift.event, F.col("threshold")).collect()]
    lines: dict[str, list] = {}
    for x in scores:
        lines.setdefault(f"{x['detector']} {x['model']} #{x['seed']}", []).append((x["batch_id"], x["score"]))
    out.mkdir(parents=True, exist_ok=True)
    (out / "drift.svg").write_text(report.line_chart(lines, "Detector scores per batch"))
    files = {
        "scores": write_csv(out / "drift_scores.csv", scores, ["detector", "batch_id", "score", "flagged", "threshold", "model", "features", "seed"]),
        "lead_time": write_csv(out / "drift_lead_time.csv", leads, ["detector", "first_flag", "first_drop", "lead", "drop_level", "ref_f1", "model", "features", "seed"]),
    }
    if events:
        files["event"] = write_csv(out / "drift_event.csv", events, ["window", "n", "n_pos", "roc_auc", "recall", "pos_median", "probe_roc_auc", "model", "features", "seed"])
    return files


def probe_windows(rows: DataFrame, cols: list[str], event: int) -> dict[str, float | None]:
    """How well a model fitted inside each window tells the classes there; none where a class has too few."""
    out: dict[str, float | None] = {}
    for window, where in (("before", F.col("batch_id") < event), ("after", F.col("batch_id") >= event)):
        part = cut(rows.where(where).select("unit", "y", *cols))
        try:
            out[window] = trees.probe_auc(part, ["unit"], cols)
        except ValueError:
            out[window] = None
    return out


def run_score(spark: SparkSession, cfg: Config, out: Path | None = None) -> tuple[dict[str, Path], list[str]]:
    """One batch scored with the deployed model: alerts, their reasons, and a health check. Returns files and flags."""
    out = out or Path(root("report"))
    g = load_graph(spark, cfg.dataset, f"{root('data')}/graphs")
    units, r, m = units_of(g, cfg), cfg.regimes[0], cfg.models[0]
    define = hashlib.sha256(json.dumps([cfg.dataset.model_dump(), X.feature_version(g, cfg.features), r.model_dump(), m.model_dump()], sort_keys=True, default=str).encode()).hexdigest()[:16]
    where = f"{root('data')}/deployed/{define}"
    known = store.get(spark, where)
    if known is None:
        f = fit(split_of(units, r, g)[0], g, cfg, m, cfg.seeds[0])
        known = {"threshold": f.threshold, "definition": define, "trees": f.model.to_json()}
        store.put(spark, where, known)
    model, threshold = trees.BoostedTrees.from_json(known["trees"]), known["threshold"]
    batch = cfg.score.batch
    ref = cfg.score.reference or r.val
    cols = X.columns(g, m.features, cfg.features)
    u = units.where(F.col("batch_id").between(*ref) | (F.col("batch_id") == batch)).select("unit", "batch_id", *cols)
    scored = cut(model.transform(u))
    today = scored.where(F.col("batch_id") == batch)
    if today.isEmpty():
        raise ValueError(f"batch {batch} holds no units")
    health = [x.asDict() for x in flags(scored, cols, list(range(ref[0], ref[1] + 1)), threshold, cfg).where(F.col("batch_id") == batch).orderBy("detector").collect()] if cfg.drift else []
    queue = model.explain(R.alert_queue(today.select("unit", "p", *cols), F.lit(threshold), ["unit"]))
    ends = g.edges.select(F.col("edge").alias("unit"), F.col("src").alias("src_account"), F.col("dst").alias("dst_account")) if g.meta.task == "edge" else None
    alerts = (queue.join(ends, "unit") if ends is not None else queue).select("rank", "unit", F.col("p").alias("score"), *(["src_account", "dst_account"] if ends is not None else []), "top_features").orderBy("rank")
    rows = [x.asDict() for x in alerts.collect()]  # the queue people work through
    files = {"alerts": write_csv(out / f"alerts_batch{batch}.csv", rows, alerts.columns)}
    flagged = [h["detector"] for h in health if h["flagged"]]
    body = {"batch": batch, "alerts": len(rows), "threshold": threshold, "reference": list(ref), "detectors": health, "flagged": flagged, "note": NOTE, "commit": stamp()}
    files["health"] = out / f"health_batch{batch}.json"
    files["health"].write_text(json.dumps(body, indent=2, sort_keys=True))
    files["page"] = out / f"report_batch{batch}.html"
    came_from = [{"what": k, "value": v} for k, v in {"dataset": f"{cfg.dataset.name} {cfg.dataset.version}", "features": X.feature_version(g, cfg.features), "model": m.key, "definition": define, "threshold": threshold, "reference": f"{ref[0]} to {ref[1]}", "commit": body["commit"]}.items()]
    files["page"].write_text(report.page(f"Batch {batch}", NOTE, [
        "<h2>Detectors</h2>", report.table(health, ["detector", "score", "threshold", "flagged"]), report.bar_chart([(h["detector"], h["score"], h["threshold"]) for h in health], "Scores and the levels that flag"),
        f"<h2>First {cfg.score.top} of {len(rows)} alerts</h2>", report.table(rows[: cfg.score.top], [c for c in alerts.columns if c != "unit"]),
        "<h2>Where this comes from</h2>", report.table(came_from, ["what", "value"])]))
    return files, flagged


def smoke_config() -> Config:
    return Config(
        dataset=Dataset(name="synthetic", version="smoke", synthetic=Synthetic(n_nodes=1200, n_timesteps=12, illicit_rate=0.2)),
        regimes=(Regime(regime="temporal", train_end=6, val=(7, 8), test=(9, 12)),),
        models=(Model(name="gbt", features="base_gfp", params={"n_estimators": 5}),), metrics=("f1", "pr_auc", "roc_auc"),
        drift={"event": 11, "detectors": ("psi", "conf", "alert")}, score=Score(batch=9))


def run_smoke(spark: SparkSession, out: Path) -> dict[str, Path]:
    """A benchmark and one scored batch on a small synthetic graph; what they keep stays in the folder, and the setting is put back."""
    cfg, name = smoke_config(), "CAIRNFLOW_DATA_DIR"
    before = os.environ.get(name)
    os.environ[name] = f"{out}/data"
    try:
        files = run_benchmark(spark, cfg, out)
        return files | run_score(spark, cfg, out)[0]
    finally:
        if before is None:
            del os.environ[name]
        else:
            os.environ[name] = before
