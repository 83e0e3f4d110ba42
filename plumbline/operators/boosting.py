"""Multiclass gradient boosting by second-order histograms, one model a validation fold, all folds in the same passes.

A round grows one tree a class on the gradients and Hessians of the softmax
loss. Features are binned at quantiles of the training rows of a fold. For each
level of the trees a pass over the rows adds up gradients and Hessians by
(fold, class, node, feature, bin) in every task; those sums are reduced once,
and the best split of each node follows from running sums over its bins. Only
the chosen splits reach the driver. Every REFRESH rounds the rows' margins are
written with them, so a pass evaluates a bounded number of trees.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.validation import fold_rows
from plumbline.storage import written

#: Rounds after which margins are stored beside the rows.
REFRESH = 10
#: Most cells (folds x classes x nodes of a level x features x bins) of the histograms of one task, 24 bytes each.
MAX_CELLS = 4_000_000


@dataclass
class Tree:
    """Nodes of one tree as lists: feature (-1: leaf), cut (left: value <= cut), children, value of a leaf, weight of the training rows."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    cover: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: float, sides: tuple[tuple[float, float], tuple[float, float]]) -> None:
        """Make a leaf an inner node; sides: value and cover of its children."""
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, len(self.cut), len(self.cut) + 1
        for value, cover in sides:
            for name, v in (("feature", -1), ("cut", 0.0), ("left", -1), ("right", -1), ("value", value), ("cover", cover)):
                getattr(self, name).append(v)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row of x falls into."""
        feature, cut, left, right = (np.array(v) for v in (self.feature, self.cut, self.left, self.right))
        at = np.zeros(len(x), np.int64)
        while (inner := feature[at] >= 0).any():
            rows = np.flatnonzero(inner)
            node = at[rows]
            at[rows] = np.where(x[rows, feature[node]] <= cut[node], left[node], right[node])
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaf_of(x)]


@dataclass(frozen=True)
class Boosted:
    """The models of all folds: rounds[fold] is a list of rounds, each a list of one tree a class. Margins start at 0."""

    features: list[str]
    labels: list[str]
    rounds: dict[int, list[list[Tree]]]

    def margins(self, fold: int, x: np.ndarray, since: int = 0) -> np.ndarray:
        """Rows by classes, from the rounds since the given one."""
        out = np.zeros((len(x), len(self.labels)))
        for trees in self.rounds[fold][since:]:
            for c, tree in enumerate(trees):
                out[:, c] += tree.predict(x)
        return out


def softmax(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _cuts(data: DataFrame, folds: list[int], features: list[str], bins: int) -> dict[int, list[np.ndarray]]:
    """Cut points of each feature for each fold's model: quantiles of its training rows, from one pass."""
    probs = [i / bins for i in range(1, bins)]
    row = data.agg(*[F.percentile_approx(F.when(F.col("fold") != f, F.col(c)), probs, 10_000) for f, c in itertools.product(folds, features)]).first()
    each = iter(row)
    return {f: [np.unique(np.array(next(each) or [], float)) for _ in features] for f in folds}


HIST_DDL = "fold int, class int, node int, feature int, bin int, g double, h double, n bigint"


def _histograms(rows: DataFrame, model: Boosted, since: int, trees: dict, frontier: dict, cuts: dict, weights: dict) -> DataFrame:
    """Sums of gradients, Hessians and rows of every (fold, class, node, feature, bin) at the frontier, one row a task and cell."""
    folds, features, k = sorted(cuts), model.features, len(model.labels)
    shared = rows.sparkSession.sparkContext.broadcast((model, trees, frontier, cuts, weights))
    width = max((len(c) for own in cuts.values() for c in own), default=0) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, trees, frontier, cuts, weights = shared.value
        sums = {key: np.zeros((3, len(nodes), len(features), width)) for key, nodes in frontier.items()}
        for b in batches:
            fold, y = b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int64)
            all_x = np.stack([b.column(3 + j).to_numpy(zero_copy_only=False) for j in range(len(features))], axis=1)
            held = b.column(2)
            base = np.frombuffer(b"".join(held.to_pylist()), float).reshape(len(y), len(folds), k) if len(y) and held[0].is_valid else None
            for at, f in enumerate(folds):
                some = np.flatnonzero(fold != f)
                if not len(some) or not any(key[0] == f for key in frontier):
                    continue
                x, own = all_x[some], y[some]
                p = softmax(model.margins(f, x, since) + (base[some, at] if base is not None else 0.0))
                w = weights[f][own]
                bins = [np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts[f])]
                for c in range(k):
                    nodes = frontier.get((f, c))
                    if not nodes:
                        continue
                    place = np.full(len(trees[f, c].cut), -1)
                    place[nodes] = np.arange(len(nodes))
                    node = place[trees[f, c].leaf_of(x)]
                    live = node >= 0
                    g, h = w * (p[:, c] - (own == c)), w * np.maximum(p[:, c] * (1 - p[:, c]), 1e-16)
                    for j in range(len(features)):
                        cell = node[live] * width + bins[j][live]
                        for s, v in enumerate((g[live], h[live], None)):
                            sums[f, c][s, :, j, :] += np.bincount(cell, v, len(nodes) * width).reshape(len(nodes), width)
        for (f, c), t in sums.items():
            node, j, bin_ = np.nonzero(t[2])
            names = np.array(frontier[f, c], np.int32)
            ints = [np.full(len(node), f, np.int32), np.full(len(node), c, np.int32), names[node] if len(node) else np.zeros(0, np.int32), j.astype(np.int32), bin_.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, ints), pa.array(t[0][node, j, bin_]), pa.array(t[1][node, j, bin_]), pa.array(t[2][node, j, bin_].astype(np.int64))], [x.split()[0] for x in HIST_DDL.split(", ")])

    return rows.select("fold", "_y", "_m", *features).mapInArrow(run, HIST_DDL)


def _best_splits(hist: DataFrame, reg: float, least: float, gamma: float) -> DataFrame:
    """The best split of each (fold, class, node): feature, bin (left: bins up to it), sums of the left side and of the node.

    Gains that are equal to nine digits go to the first feature, then the first bin.
    """
    cell = ["fold", "class", "node", "feature"]
    total = hist.groupBy(*cell, "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
    whole = Window.partitionBy(*cell)
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    t = total.select(*cell, "bin", *[F.sum(c).over(upto).alias(f"{c}l") for c in "ghn"], *[F.sum(c).over(whole).alias(f"{c}t") for c in "ghn"])
    score = lambda g, h: g * g / (h + F.lit(reg))
    gl, hl, gt, ht = (F.col(c) for c in ("gl", "hl", "gt", "ht"))
    gain = 0.5 * (score(gl, hl) + score(gt - gl, ht - hl) - score(gt, ht)) - F.lit(gamma)
    ok = (hl >= least) & (ht - hl >= least) & (F.col("nl") < F.col("nt")) & (gain > 1e-9)
    rank = F.struct(F.round(gain, 9).alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"))
    return t.groupBy("fold", "class", "node").agg(F.max(F.when(ok, F.struct(rank.alias("rank"), gl, hl))).alias("s"), F.first("gt").alias("gt"), F.first("ht").alias("ht"))


def _refreshed(rows: DataFrame, model: Boosted, folds: list[int], since: int) -> DataFrame:
    """rows with the margins of all folds' models so far, written."""
    shared, names = rows.sparkSession.sparkContext.broadcast(model), rows.columns
    at = names.index("_m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            x = np.stack([b.column(names.index(c)).to_numpy(zero_copy_only=False) for c in model.features], axis=1)
            m = np.stack([model.margins(f, x, since) for f in folds], axis=1)
            old = b.column(at)
            if len(x) and old[0].is_valid:
                m += np.frombuffer(b"".join(old.to_pylist()), float).reshape(m.shape)
            yield b.set_column(at, "_m", pa.array([r.tobytes() for r in m], pa.binary()))

    return written(rows.mapInArrow(run, rows.schema), "margins")


def boosted_models(data: DataFrame, folds: list[int], labels: list[str], features: list[str], rounds: int = 8, depth: int = 3, rate: float = 0.3, reg: float = 1.0, least: float = 1.0, gamma: float = 0.0, bins: int = 32, balanced: bool = False) -> Boosted:
    """A model for each fold, grown on the rows of all other folds: data has row_id, fold, _y (class number) and the features.

    reg, least and gamma: regularisation of a leaf, least Hessian of a side and
    least gain of a split. balanced: a row weighs in inverse proportion to its
    class among the fold's training rows. A fold without training rows gets no
    trees.
    """
    if len(folds) * len(labels) * 2 ** (depth - 1) * len(features) * bins > MAX_CELLS:
        raise ValueError("too many histogram cells; use fewer folds, bins or levels")
    if not folds:
        return Boosted(features, labels, {})
    k = len(labels)
    cuts = _cuts(data, folds, features, bins)
    count = {f: np.zeros(k) for f in folds}
    for r in data.groupBy("fold", "_y").count().collect():  # a row a fold and class
        for f in folds:
            if r["fold"] != f:
                count[f][int(r["_y"])] += r["count"]
    has = lambda f: count[f].sum() > 0
    even = lambda n: np.divide(n.sum(), n * max(1, (n > 0).sum()), out=np.zeros(k), where=n > 0)
    weights = {f: even(count[f]) if balanced else np.ones(k) for f in folds}
    model = Boosted(features, labels, {f: [] for f in folds})
    rows, since = data.select("row_id", "fold", "_y", F.lit(None).cast("binary").alias("_m"), *features), 0
    for done in range(rounds):
        trees = {(f, c): Tree() for f in folds if has(f) for c in range(k)}
        frontier = {key: [0] for key in trees}
        for level in range(depth):
            hist = _histograms(rows, model, since, trees, frontier, cuts, weights)
            ahead: dict[tuple[int, int], list[int]] = {}
            for r in _best_splits(hist, reg, least, gamma).collect():  # a row a node
                tree, key = trees[r["fold"], r["class"]], (r["fold"], r["class"])
                if level == 0:
                    tree.value[0], tree.cover[0] = -rate * r["gt"] / (r["ht"] + reg), r["ht"]
                if r["s"] is None:
                    continue
                j, bin_, gl, hl = -r["s"]["rank"]["f"], -r["s"]["rank"]["b"], r["s"]["gl"], r["s"]["hl"]
                gr, hr = r["gt"] - gl, r["ht"] - hl
                ahead.setdefault(key, []).extend((len(tree.cut), len(tree.cut) + 1))
                tree.split(r["node"], j, float(cuts[r["fold"]][j][bin_]), ((-rate * gl / (hl + reg), hl), (-rate * gr / (hr + reg), hr)))
            frontier = ahead
            if not frontier:
                break
        for f in folds:
            if has(f):
                model.rounds[f].append([trees[f, c] for c in range(k)])
        if (done + 1) % REFRESH == 0 and done + 1 < rounds:
            rows, since = _refreshed(rows, model, folds, since), done + 1
    return model


def boosted_predictions(data: DataFrame, model: Boosted) -> DataFrame:
    """row_id, fold, label and prediction of each row of data by the model of its own fold; equal margins: the label that sorts first; no trees: null."""
    shared = data.sparkSession.sparkContext.broadcast(model)
    kind = data.schema["row_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            fold = b.column(1).to_numpy()
            x = np.stack([b.column(3 + j).to_numpy(zero_copy_only=False) for j in range(len(model.features))], axis=1)
            said = np.full(len(fold), None, object)
            for f in np.unique(fold):
                at = np.flatnonzero(fold == f)
                if model.rounds[int(f)]:
                    said[at] = np.array(model.labels, object)[model.margins(int(f), x[at]).argmax(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(said.tolist(), pa.string())], ["row_id", "fold", "label", "prediction"])

    return data.select("row_id", "fold", "label", *model.features).mapInArrow(run, f"row_id {kind}, fold int, label string, prediction string")


def boosted_grouped_cv(df: DataFrame, features: list[str], label_col: str, group_col: str, k: int = 5, **options) -> DataFrame:
    """Out-of-fold predictions (row_id, fold, label, prediction) of boosted trees; a fold's model never sees its groups.

    Rows with a missing label, group or feature are left out; every other row
    comes back, with a null prediction where no other fold has rows. Options
    are those of `boosted_models`.
    """
    data, folds, labels = fold_rows(df, features, label_col, group_col, k)
    return boosted_predictions(data, boosted_models(data, folds, labels, features, **options))
