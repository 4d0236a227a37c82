"""Boosted trees over binned rows: growing, weighting, choice of the number of trees by validation AP, and exact tree contributions.

Training rows are written once as blocks of bins, a byte a value (few rows are held by the driver instead), and each level of a
tree adds up one pass over them. Nothing is cached by executors or drawn at random; the driver holds the sums of a level, a
histogram a task.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.evaluation import rank_metrics
from ..operators.running import running_sums
from ..session import forget, written

#: The most trees of a model, how long the validation AP may stand still before growing stops, and how many are grown at first.
CEILING, PATIENCE, FIRST = 1_000, 50, 64

#: Into how many bins a feature is cut, after how many trees the rows' margins are written anew, and up to how many bytes blocks
#: are held by the driver, where a pass needs no job.
BINS, REBASE, HELD = 32, 10, 1 << 24


@dataclass
class Tree:
    """One tree as arrays; feature -1 marks a leaf."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> np.ndarray:
        f, t, l, r, v = (np.array(a) for a in (self.feature, self.threshold, self.left, self.right, self.value))
        at = np.zeros(len(x), dtype=np.int64)
        while (inner := f[at] >= 0).any():
            i = at[inner]
            at[inner] = np.where(x[inner, f[i]] <= t[i], l[i], r[i])
        return v[at]


@dataclass
class BoostedTrees:
    """Trees with their weights, kept up to the best number by validation AP; a model small enough to travel with tasks."""

    features: list[str]
    trees: list[Tree]
    weights: list[float]
    info: dict

    def margins(self, x: np.ndarray) -> np.ndarray:
        """(trees, rows): the margin after each tree."""
        return np.cumsum([w * t.predict(x) for w, t in zip(self.weights, self.trees)], axis=0)

    def _matrix(self, pdf: pd.DataFrame) -> np.ndarray:
        return np.nan_to_num(pdf[self.features].to_numpy(dtype=np.float64))

    def transform(self, df: DataFrame, out: str = "p") -> DataFrame:
        """df with the probability 1 / (1 + exp(-2 margin))."""
        names = df.columns
        schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", {out} double"

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                m = self.margins(self._matrix(b))[-1] if len(b) else np.zeros(0)
                yield b[names].assign(**{out: 1 / (1 + np.exp(-2 * m))})

        return df.mapInPandas(run, schema)

    def explain(self, df: DataFrame, top: int = 3) -> DataFrame:
        """df with base, logit, contributions (in feature order) and the top signed contributions as text."""
        names = df.columns
        schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", base double, logit double, contributions array<double>, top_features string"

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                x = self._matrix(b)
                phi, base = contributions(self, x)
                order = np.argsort(-phi, axis=1, kind="stable")[:, :top] if len(b) else np.zeros((0, top), dtype=int)
                text = ["; ".join(f"{self.features[j]} {phi[i, j]:+.2f}" for j in row) for i, row in enumerate(order)]
                yield b[names].assign(base=base, logit=2 * self.margins(x)[-1] if len(b) else np.zeros(0), contributions=list(phi), top_features=text)

        return df.mapInPandas(run, schema)

    def to_json(self) -> str:
        return json.dumps({"features": self.features, "trees": [t.__dict__ for t in self.trees], "weights": self.weights, "info": self.info})

    @staticmethod
    def from_json(text: str) -> BoostedTrees:
        d = json.loads(text)
        return BoostedTrees(d["features"], [Tree(**t) for t in d["trees"]], d["weights"], d["info"])


def contributions(model: BoostedTrees, x: np.ndarray) -> tuple[np.ndarray, float]:
    """Exact Shapley contributions to the log odds, by paths: (rows, features) and the constant they add to.

    A leaf is reached over the distinct features of its path. For a set of known features the leaf's weight is the product
    of 0 or 1 (the row goes this way) over the known and of the cover share over the others; sets of one size are added up
    together, as the coefficients of a polynomial, so the work is a power of the path's length and not of two.
    """
    phi = np.zeros((len(x), len(model.features)))
    base = 0.0
    for tree, w in zip(model.trees, model.weights):
        stack: list[tuple[int, dict]] = [(0, {})]
        while stack:
            i, path = stack.pop()
            if tree.feature[i] >= 0:
                f, t = tree.feature[i], tree.threshold[i]
                for child, low in ((tree.left[i], True), (tree.right[i], False)):
                    share, lo, hi = path.get(f, (1.0, -math.inf, math.inf))
                    share *= tree.cover[child] / tree.cover[i] if tree.cover[i] else 0.0
                    stack.append((child, path | {f: (share, lo, min(hi, t)) if low else (share, max(lo, t), hi)}))
                continue
            v = 2 * w * tree.value[i]
            fs = list(path)
            z = [path[f][0] for f in fs]
            base += v * math.prod(z)
            o = [((x[:, f] > path[f][1]) & (x[:, f] <= path[f][2])).astype(np.float64) for f in fs]
            d = len(fs)
            for k, f in enumerate(fs):
                sets = np.zeros((d, len(x)))  # by how many of the others are known: the sum, over all such sets, of their products
                sets[0] = 1.0
                for j in range(d):
                    if j != k:
                        sets[1:] = sets[1:] * z[j] + sets[:-1] * o[j]
                        sets[0] = sets[0] * z[j]
                phi[:, f] += v * (o[k] - z[k]) * sum(math.factorial(n) * math.factorial(d - n - 1) / math.factorial(d) * sets[n] for n in range(d))
    return phi, base


def _number(f: str) -> Column:
    """The feature as training has it: 0 for null, and finite as in scoring."""
    most = float(np.finfo(np.float64).max)
    return F.greatest(F.least(F.coalesce(F.col(f).cast("double"), F.lit(0.0)), F.lit(most)), F.lit(-most))


def cut_points(rows: DataFrame, features: list[str], weight: float) -> list[np.ndarray]:
    """For each feature, in order, the values it may be split at (up to the value goes left), from all rows.

    Every value but the largest where there are at most BINS, else the values at which the share of the weighted rows passes
    another BINS-th.
    """
    each = rows.select((F.col("y") == 1).cast("long").alias("p"), F.inline(F.array(*(F.struct(F.lit(i).alias("k"), _number(f).alias("v")) for i, f in enumerate(features)))))
    by = written(each.groupBy("k", "v").agg(F.count("*").alias("n"), F.sum("p").alias("p")))
    size = lambda n, p: (n - p) + F.lit(float(weight)) * p
    run = running_sums(by, ["k"], "v", ["n", "p"]).join(F.broadcast(by.groupBy("k").agg(F.count("*").alias("_values"))), "k")
    until, before, every = size(F.col("n_run"), F.col("p_run")), size(F.col("n_run") - F.col("n"), F.col("p_run") - F.col("p")), size(F.col("n_all"), F.col("p_all"))
    passes = (F.col("_values") <= BINS) | (F.floor(BINS * until / every) > F.floor(BINS * before / every))
    got = run.where(passes & (F.col("n_run") < F.col("n_all"))).select("k", "v").collect()  # fewer than BINS a feature
    forget(by)
    return [np.array(sorted(r["v"] for r in got if r["k"] == i), dtype=np.float64) for i in range(len(features))]


def _by_bins(tree: Tree, cuts: list[np.ndarray], x: np.ndarray, at_leaf: np.ndarray, node: int = 0):
    """For rows as bins, features by rows, what at_leaf holds for the node each ends at."""
    f = tree.feature[node]
    if f < 0:
        return at_leaf[node]
    return np.where(x[f] <= np.searchsorted(cuts[f], tree.threshold[node]), _by_bins(tree, cuts, x, at_leaf, tree.left[node]), _by_bins(tree, cuts, x, at_leaf, tree.right[node]))


@dataclass
class _Growing:
    """Training rows as blocks (y, x: bins, features by rows, f: margins after the first `done` trees), and the trees so far.

    The blocks are a written table, or held by the driver if they are few.
    """

    table: DataFrame | list[pa.RecordBatch]
    cuts: list[np.ndarray]
    weight: float
    step: float
    trees: list[Tree] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    done: int = 0

    @staticmethod
    def start(rows: DataFrame, n: int, features: list[str], weight: float, step: float) -> _Growing:
        cuts = cut_points(rows, features, weight)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
                if any(np.isnan(c).any() for c in cols[1:]):
                    raise ValueError("a feature of a training row is not a number")
                x = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, cols[1:])]).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([a], pa.binary()) for a in (cols[0].astype(np.int8).tobytes(), x.tobytes(), np.zeros(b.num_rows).tobytes())], ["y", "x", "f"])

        blocks = rows.select(F.col("y").cast("double").alias("y"), *(_number(f).alias(f"x{i}") for i, f in enumerate(features))).mapInArrow(run, "y binary, x binary, f binary")
        return _Growing(blocks.toArrow().to_batches() if n * (len(features) + 9) <= HELD else written(blocks), cuts, weight, step)

    def _reader(self):
        """For batches of the table: (label, bins, margin after all trees), a block at a time."""
        cuts, since, k = self.cuts, list(zip(self.trees, self.weights))[self.done :], len(self.cuts)

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for b in batches:
                for y, x, f in zip(*(c.to_pylist() for c in b.columns)):
                    x, f = np.frombuffer(x, np.uint8).reshape(k, -1), np.frombuffer(f)
                    for tree, w in since:
                        f = f + _by_bins(tree, cuts, x, w * np.array(tree.value))
                    yield np.frombuffer(y, np.int8), x, f

        return read

    def _sums(self, tree: Tree, nodes: list[int]) -> np.ndarray:
        """(nodes, features, BINS, 2): weight, and weight times what the tree is to learn, of the rows at each node by bin."""
        cuts, k, m, weight, first, read = self.cuts, len(self.cuts), len(nodes), self.weight, not self.trees, self._reader()
        slot = np.full(len(tree.feature), m)
        slot[nodes] = np.arange(m)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = np.zeros((2, k, (m + 1) * BINS))
            for y, x, f in read(batches):
                sign = np.where(y == 1, 1.0, -1.0)
                w = np.where(y == 1, weight, 1.0)
                with np.errstate(over="ignore"):
                    r = w * (sign if first else 4 * sign / (1 + np.exp(2 * sign * f)))
                at = np.broadcast_to(_by_bins(tree, cuts, x, slot * BINS), len(y))
                for j in range(k):
                    i = at + x[j]
                    got[0, j] += np.bincount(i, w, (m + 1) * BINS)
                    got[1, j] += np.bincount(i, r, (m + 1) * BINS)
            yield pa.RecordBatch.from_arrays([pa.array([got.tobytes()], pa.binary())], ["s"])

        total = np.zeros((2, k, (m + 1) * BINS))
        parts = [b["s"][0].as_py() for b in run(iter(self.table))] if isinstance(self.table, list) else [r["s"] for r in self.table.mapInArrow(run, "s binary").collect()]  # one a task
        for part in parts:
            total += np.frombuffer(part).reshape(total.shape)
        return total.reshape(2, k, m + 1, BINS)[:, :, :m].transpose(2, 1, 3, 0)

    def _split(self, sums: np.ndarray) -> tuple[int, int] | None:
        """Feature and number of the cut that leave least variance at a node; of equals the first."""
        left = np.cumsum(sums, axis=1)[:, :-1]
        right = np.cumsum(sums[:, ::-1], axis=1)[:, -2::-1]
        cut = (np.arange(BINS - 1) < np.array([len(c) for c in self.cuts])[:, None]) & (left[..., 0] > 0) & (right[..., 0] > 0)
        part = np.where(cut, left[..., 1] ** 2 / np.where(cut, left[..., 0], 1) + right[..., 1] ** 2 / np.where(cut, right[..., 0], 1), -1.0)
        whole, best = sums[0].sum(axis=0), part.max(initial=-1.0)
        if best <= 0 or best - whole[1] ** 2 / whole[0] <= 1e-12 * best:
            return None
        f, c = np.unravel_index(np.argmax(part >= best * (1 - 1e-12)), part.shape)
        return int(f), int(c)

    def add(self, depth: int) -> None:
        """Grows one more tree of at most `depth` splits in a row, a pass over the rows for each."""
        if len(self.trees) - self.done >= REBASE:
            self._rebase()
        tree = Tree()

        def node(weight: float, total: float) -> int:
            for a, v in ((tree.feature, -1), (tree.threshold, 0.0), (tree.left, -1), (tree.right, -1), (tree.value, total / weight), (tree.cover, weight)):
                a.append(float(v) if a is tree.value or a is tree.cover else v)
            return len(tree.feature) - 1

        node(1.0, 0.0)
        level = [0]
        for d in range(max(depth, 1)):
            below = []
            for i, s in zip(level, self._sums(tree, level)):
                whole = s[0].sum(axis=0)
                tree.cover[i], tree.value[i] = float(whole[0]), float(whole[1] / whole[0])
                if depth and (at := self._split(s)):
                    f, c = at
                    tree.feature[i], tree.threshold[i] = f, float(self.cuts[f][c])
                    tree.left[i], tree.right[i] = node(*s[f, : c + 1].sum(axis=0)), node(*s[f, c + 1 :].sum(axis=0))
                    below += [tree.left[i], tree.right[i]]
            level = below
            if not level:
                break
        self.trees.append(tree)
        self.weights.append(self.step if self.weights else 1.0)

    def _rebase(self) -> None:
        """Writes the table anew with the margins after all trees so far, so that a pass walks few trees."""
        read = self._reader()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for y, x, f in read(batches):
                yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in (y, x, f)], ["y", "x", "f"])

        old = self.table
        self.table = list(run(iter(old))) if isinstance(old, list) else written(old.mapInArrow(run, "y binary, x binary, f binary"))
        self.done = len(self.trees)
        if not isinstance(old, list):
            forget(old)


def fit(train: DataFrame, val: DataFrame, features: list[str], n_trees: int = CEILING, depth: int = 3, step: float = 0.3, seed: int = 0, patience: int = PATIENCE) -> BoostedTrees:
    """Fits on labelled train rows (y, features), weighting positives by n_neg / n_pos of train, and keeps the trees up to
    the best validation AP. Every stage is scored in one pass over the validation rows.

    Trees learn the gradient of the logistic loss, the first one the labels -1 and 1. Growing stops once `patience` trees have
    not raised the AP, or at n_trees; the AP is looked at when the number of trees has doubled. Nothing depends on the seed, as
    nothing is sampled.
    """
    counts = train.agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"), F.count_if(~F.col("y").isin(0, 1)).alias("bad")).first()
    if counts["bad"] or not counts["pos"] or not counts["neg"]:
        raise ValueError(f"training rows must be labelled 0 and 1: {counts}")
    weight = counts["neg"] / counts["pos"]
    state = _Growing.start(train, counts["pos"] + counts["neg"], features, weight, step)
    grown = min(n_trees, FIRST)
    try:
        while True:
            got, stopped = _grow(state, val, features, grown, depth, patience, weight)
            if stopped or grown >= n_trees:
                return got
            grown = min(n_trees, 2 * grown)
    finally:
        if not isinstance(state.table, list):
            forget(state.table)


def _grow(state: _Growing, val: DataFrame, features: list[str], n_trees: int, depth: int, patience: int, weight: float) -> tuple[BoostedTrees, bool]:
    """Grows the state to n_trees; a model cut back to the best by validation, and whether its AP stood still for long enough."""
    while len(state.trees) < n_trees:
        state.add(depth)
    trees = list(state.trees)
    got = BoostedTrees(features, trees, list(state.weights), {"weight": weight, "n_trees": len(trees)})

    def stages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                m = np.round(got.margins(got._matrix(b)), 9)
                k = np.repeat(np.arange(1, len(m) + 1), m.shape[1])
                yield pd.DataFrame({"k": k, "y": np.tile(b["y"].to_numpy(), len(m)), "p": m.ravel()})

    ap = rank_metrics(val.select("y", *features).mapInPandas(stages, "k int, y int, p double"), ["k"]).select("k", "pr_auc").orderBy("k").collect()  # a row a tree
    best, since = (-1.0, len(trees)), 0
    for r in ap:
        if r["pr_auc"] is not None and r["pr_auc"] > best[0] + 1e-12:
            best, since = (r["pr_auc"], r["k"]), 0
        else:
            since += 1
            if since >= patience:
                break
    return BoostedTrees(features, trees[: best[1]], got.weights[: best[1]], got.info | {"best_iteration": best[1], "val_pr_auc": best[0]}), since >= patience


def folds(df: DataFrame, key: list[str], k: int = 5) -> DataFrame:
    """df with `fold`: hashed by key, so the same every time; labels spread evenly as the hash does not know them."""
    return df.withColumn("fold", F.conv(F.substring(F.md5(F.concat_ws(":", *(F.col(c).cast("string") for c in key))), 1, 8), 16, 10).cast("long") % k)


def probe_auc(df: DataFrame, key: list[str], features: list[str], k: int = 5, n_trees: int = 20, **params) -> float:
    """Mean ROC AUC of k-fold cross-validation inside df, with models of few trees."""
    c = df.agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n")).first()
    if min(c) < k:
        raise ValueError(f"a probe needs at least {k} of each class")
    f = folds(df, key, k)
    out = []
    for i in range(k):
        m = fit(f.where(F.col("fold") != i), f.where(F.col("fold") == i), features, n_trees=n_trees, **params)
        out.append(rank_metrics(m.transform(f.where(F.col("fold") == i).select("y", *features)).select("y", "p")).first()["roc_auc"])
    return float(np.mean(out))
