"""Shapley attributions. They describe a model's associations, not causes."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.boosting import Tree, boosted_models
from plumbline.operators.validation import by_fold, fold_rows, grow_forest
from plumbline.storage import new_path

#: Rows that are explained at a time.
ROWS = 2048


def linear_shapley(df: DataFrame, id_col: str, x_col: str, y_col: str) -> DataFrame:
    """Exact Shapley value of the single feature of a least-squares line: slope * (x - mean x).

    prediction = base + phi in every row. A constant feature has slope 0; the
    statistics are one aggregated row, broadcast by construction.
    """
    rows = df.where(F.col(x_col).isNotNull() & F.col(y_col).isNotNull())
    x = F.col(x_col).cast("double")
    s = rows.agg(
        F.avg(x).alias("mx"), F.avg(y_col).alias("my"),
        F.coalesce(F.when(F.max(x) > F.min(x), F.regr_slope(F.col(y_col), x)), F.lit(0.0)).alias("b"))
    return rows.join(F.broadcast(s), F.lit(True)).select(
        id_col, F.round(F.col("b") * (x - F.col("mx")), 4).alias("phi"), F.round("my", 4).alias("base"),
        F.round(F.col("my") + F.col("b") * (x - F.col("mx")), 4).alias("prediction"))


@dataclass(frozen=True)
class Nodes:
    """One tree as arrays: feature (-1: leaf), cut (left: value <= cut), children, weight of the training rows, and a value for each class."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    cover: np.ndarray
    value: np.ndarray

    def base(self) -> np.ndarray:
        """Mean of the leaves, weighted by cover."""
        leaf = self.feature < 0
        return (self.cover[leaf, None] * self.value[leaf]).sum(0) / max(self.cover[leaf].sum(), 1e-300)


def _extended(w: list[np.ndarray], zero: float, one: np.ndarray) -> list[np.ndarray]:
    """Weights of the subset sizes of a path, with one more feature on it: `zero` of the cover goes on without it, `one` of each row with it."""
    n = len(w)
    out = [*w, np.ones_like(one) if n == 0 else np.zeros_like(one)]
    for i in range(n - 1, -1, -1):
        out[i + 1] = out[i + 1] + one * out[i] * ((i + 1) / (n + 1))
        out[i] = zero * out[i] * ((n - i) / (n + 1))
    return out


def _unwound(w: list[np.ndarray], zero: float, one: np.ndarray) -> list[np.ndarray]:
    """The weights without a feature that was put on the path with these fractions."""
    n = len(w)
    out, tail, with_it = list(w), w[-1], one > 0
    safe = np.where(with_it, one, 1.0)
    for j in range(n - 2, -1, -1):
        hot = tail * (n / (j + 1)) / safe
        cold = out[j] * (n / (max(zero, 1e-300) * (n - 1 - j)))
        tail = np.where(with_it, out[j] - hot * (zero * (n - 1 - j) / n), tail)
        out[j] = np.where(with_it, hot, cold)
    return out[:-1]


def path_shapley(tree: Nodes, x: np.ndarray) -> np.ndarray:
    """(rows, features, classes): Shapley values of a tree whose unknown features follow the cover of its nodes.

    The path recurrence: while a tree is walked, the weights of all subsets of
    the features on the path are kept by subset size, so the cost is leaves
    times depth squared, whatever the number of features; all rows at once.
    """
    phi = np.zeros((len(x), x.shape[1], tree.value.shape[1]))

    def walk(i: int, path: dict[int, tuple[float, np.ndarray]], w: list[np.ndarray]) -> None:
        f = int(tree.feature[i])
        if f < 0:
            for g, (zero, one) in path.items():
                weight = np.sum(_unwound(w, zero, one), axis=0) * (one - zero)
                phi[:, g, :] += weight[:, None] * tree.value[i]
            return
        zero, one = path.get(f, (1.0, np.ones(len(x))))
        rest = {g: v for g, v in path.items() if g != f}
        if f in path:
            w = _unwound(w, zero, one)
        goes_left = x[:, f] <= tree.cut[i]
        for child, goes in ((int(tree.left[i]), goes_left), (int(tree.right[i]), ~goes_left)):
            share = tree.cover[child] / max(tree.cover[i], 1e-300)
            if share > 0:
                step = (zero * share, one * goes)
                walk(child, rest | {f: step}, _extended(w, *step))

    walk(0, {}, _extended([], 1.0, np.ones(len(x))))
    return phi


def interventional_shapley(tree: Nodes, x: np.ndarray, background: np.ndarray) -> np.ndarray:
    """(rows, features, classes): Shapley values where unknown features are taken from the background rows, averaged over these.

    For a row and a background row a leaf counts where every feature on its
    path is met by one of the two; with p features met by the row alone and q
    by the background alone, its value is shared by (p - 1)! q! / (p + q)!
    among the former and taken from the latter by p! (q - 1)! / (p + q)!.
    """
    phi = np.zeros((len(x), x.shape[1], tree.value.shape[1]))
    stack = [(0, {})]
    while stack:
        i, path = stack.pop()
        f = int(tree.feature[i])
        if f >= 0:
            ours, theirs = path.get(f, (np.ones(len(x), bool), np.ones(len(background), bool)))
            a, b = x[:, f] <= tree.cut[i], background[:, f] <= tree.cut[i]
            stack.append((int(tree.left[i]), path | {f: (ours & a, theirs & b)}))
            stack.append((int(tree.right[i]), path | {f: (ours & ~a, theirs & ~b)}))
            continue
        p, q = (np.zeros((len(x), len(background)), np.int64) for _ in range(2))
        live = np.ones((len(x), len(background)), bool)
        for ours, theirs in path.values():
            p += ours[:, None] & ~theirs[None, :]
            q += ~ours[:, None] & theirs[None, :]
            live &= ours[:, None] | theirs[None, :]
        d = len(path) + 1
        fact = [math.factorial(k) for k in range(2 * d)]
        gain = np.array([[fact[m - 1] * fact[k] / fact[m + k] if m else 0.0 for k in range(d)] for m in range(d)])[p, q] * live
        loss = np.array([[fact[m] * fact[k - 1] / fact[m + k] if k else 0.0 for k in range(d)] for m in range(d)])[p, q] * live
        for g, (ours, theirs) in path.items():
            share = (gain * (ours[:, None] & ~theirs[None, :]) - loss * (~ours[:, None] & theirs[None, :])).mean(1)
            phi[:, g, :] += share[:, None] * tree.value[i]
    return phi


def forest_trees(session: SparkSession, model) -> list[Nodes]:
    """Trees of an MLlib forest through its public save format; a leaf's value is its share of each class, over the number of trees."""
    path = new_path(session, "forest")
    model.write().overwrite().save(path)
    rows = session.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()  # as many as the model has nodes
    trees = []
    for _, own in itertools.groupby(rows, lambda r: r.treeID):
        own = list(own)
        stats = np.array([r.impurityStats for r in own], float)
        inner = [r.leftChild >= 0 for r in own]
        trees.append(Nodes(
            np.array([r.split.featureIndex if i else -1 for r, i in zip(own, inner)]), np.array([r.split.leftCategoriesOrThreshold[0] if i else 0.0 for r, i in zip(own, inner)]),
            np.array([r.leftChild for r in own]), np.array([r.rightChild for r in own]), stats.sum(1), stats / np.maximum(stats.sum(1, keepdims=True), 1e-300)))
    return [replace(t, value=t.value / len(trees)) for t in trees]


def boosted_trees(rounds: list[list[Tree]], classes: int) -> list[Nodes]:
    """Trees of a boosted model: each adds to the margin of its own class."""
    out = []
    for tree, c in ((t, c) for trees in rounds for c, t in enumerate(trees)):
        value = np.zeros((len(tree.value), classes))
        value[:, c] = tree.value
        out.append(Nodes(*(np.array(v) for v in (tree.feature, tree.cut, tree.left, tree.right, tree.cover)), value))
    return out


def tree_shapley(df: DataFrame, id_col: str, features: list[str], trees: list[Nodes], labels: list[str], background: np.ndarray | None = None) -> DataFrame:
    """Exact Shapley values of a sum of trees, long form (row_id, class, feature, phi, base, prediction); base + phi = prediction.

    trees: see `forest_trees` and `boosted_trees`; no limit on their features.
    Without background the unknown features follow the trees' covers
    (`path_shapley`); with it (rows by features, bounded by the caller) they
    are taken from its rows (`interventional_shapley`). Rows with a missing
    feature are left out. Explain rows that the trees were not grown on.
    """
    shared = df.sparkSession.sparkContext.broadcast((trees, background))  # bounded by the model and the background

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees, background = shared.value
        n, k = len(features), len(labels)
        for pdf in batches:
            for i in range(0, len(pdf), ROWS):
                part = pdf.iloc[i : i + ROWS]
                x = part[features].to_numpy(float)
                phi, base = np.zeros((len(x), n, k)), np.zeros(k)
                for tree in trees:
                    phi += path_shapley(tree, x) if background is None else interventional_shapley(tree, x, background)
                    base = base + (tree.base() if background is None else _values(tree, background).mean(0))
                pred = base + phi.sum(1)
                yield pd.DataFrame({"row_id": np.repeat(part[id_col].to_numpy(), n * k), "class": np.tile(np.repeat(labels, n), len(part)), "feature": np.tile(features, len(part) * k),
                                    "phi": phi.transpose(0, 2, 1).ravel(), "base": np.tile(np.repeat(base, n), len(part)), "prediction": np.repeat(pred.ravel(), n)})

    schema = f"row_id {df.schema[id_col].dataType.simpleString()}, class string, feature string, phi double, base double, prediction double"
    return df.dropna(subset=features).select(id_col, *features).mapInPandas(run, schema)


def _values(tree: Nodes, x: np.ndarray) -> np.ndarray:
    """The tree's value for each row."""
    at = np.zeros(len(x), np.int64)
    while (inner := tree.feature[at] >= 0).any():
        rows = np.flatnonzero(inner)
        at[rows] = np.where(x[rows, tree.feature[at[rows]]] <= tree.cut[at[rows]], tree.left[at[rows]], tree.right[at[rows]])
    return tree.value[at]


def background_rows(train: DataFrame, features: list[str], n: int = 64) -> np.ndarray:
    """At most n rows of the training data as background, by a hash of their ids: a documented sample that repeats."""
    rows = train.dropna(subset=features).orderBy(F.xxhash64("row_id"), "row_id").select(*features).limit(n).collect()
    return np.array([list(r) for r in rows], float).reshape(-1, len(features))


def forest_shapley_by_fold(df: DataFrame, features: list[str], label_col: str, group_col: str, k: int = 5, trees: int = 5, depth: int = 3, seed: int = 7) -> DataFrame:
    """`tree_shapley` of each row by a forest grown on the other folds, so no model explains its own training rows.

    Rows of a fold beside which there is none have no model and no values.
    """
    data, folds, labels = fold_rows(df, features, label_col, group_col, k)

    def work(f: int, train: DataFrame, test: DataFrame) -> DataFrame:
        own = test.limit(0) if train.isEmpty() else test
        grown = [] if train.isEmpty() else forest_trees(train.sparkSession, grow_forest(train, trees, depth, seed, False))
        return tree_shapley(own, "row_id", features, grown, labels)

    return by_fold(data, folds, work) if folds else tree_shapley(data, "row_id", features, [], labels)


def boosted_shapley_by_fold(df: DataFrame, features: list[str], label_col: str, group_col: str, k: int = 5, background: int = 64, **options) -> DataFrame:
    """`tree_shapley` of the class margins of boosted trees grown on the other folds, against at most `background` rows of those.

    Rows of a fold beside which there is none have no model and no values.
    """
    data, folds, labels = fold_rows(df, features, label_col, group_col, k)
    model = boosted_models(data, folds, labels, features, **options)

    def work(f: int, train: DataFrame, test: DataFrame) -> DataFrame:
        rows = background_rows(train, features, background)
        return tree_shapley(test if len(rows) else test.limit(0), "row_id", features, boosted_trees(model.rounds[f], len(labels)), labels, rows)

    return by_fold(data, folds, work) if folds else tree_shapley(data, "row_id", features, [], labels)
