"""Quality classifier: a regularised quadratic discriminant over document statistics.

Statistics of every text are counted with numpy over Arrow batches and
transformed towards normality (logarithms and logits). Each class gets a mean
and a covariance, shrunk towards the pooled covariance and its diagonal; both
come from sums over all labelled training rows, so fitting is one aggregation
with a result whose size the number of statistics fixes. How far to shrink is
chosen by the log loss on training rows held back. A document's score is
the logistic of the scaled log-density difference of two Mahalanobis
distances, solved with cached Cholesky factors, plus the log prior odds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import prefix, slices, spans_hash, stored, text_arrays, texts, words_of

NAMES = (
    "log_bytes", "log_words", "log_mean_word", "log_dev_word", "upper", "digit", "punctuation", "odd_symbols", "white",
    "distinct_words", "same_as_before", "top_word", "distinct_lines", "log_mean_line", "short_words", "ends_odd", "shouted", "bars", "letters_only", "top_pair",
)
#: What is tried for the shares of the pooled covariance and of its diagonal in a class's covariance, and for the scale of the
#: log-density difference (statistics are not independent, so densities are too sure of themselves). `choose` takes the
#: combination with the least log loss on training rows held back; ties go to the first.
POOLED, DIAGONAL, SCALE = (0.02, 0.1, 0.3), (0.01, 0.05, 0.2), (0.025, 0.05, 0.1, 0.2, 0.4, 0.7, 1.0)
#: Parts of the training rows that are held back in turn, dealt by a hash of the statistics (so copies stay together).
FOLDS = 4


def _class_table() -> np.ndarray:
    t = np.zeros(256, np.int64)
    t[[9, 10, 11, 12, 13, 32]] = 1
    t[48:58] = 2
    t[65:91] = 3
    t[97:123] = 4
    t[128:] = 5
    t[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]] = 6
    return t


KIND = _class_table()  # 0: other symbols


def _sum(x: np.ndarray, cut: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0.0], np.cumsum(x, dtype=float)])[cut])


def _logit(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.log((part + 0.5) / (np.maximum(whole - part, 0) + 0.5))


def _by_value(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, and the count of the commonest, per document."""
    order = np.lexsort((h, doc))
    h, d = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    first = np.flatnonzero(new)
    top = np.zeros(n)
    np.maximum.at(top, d[first], np.diff(np.append(first, len(h))))
    return np.bincount(d[first], minlength=n).astype(float), top


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Transformed statistics (rows: documents, columns: NAMES); an empty text has the values of no words."""
    n = len(off) - 1
    size = np.diff(off).astype(float)
    kind = KIND[data]
    share = {k: _sum(kind == k, off) for k in range(7)}
    start, end, cut = words_of(data, off)
    words = np.diff(cut).astype(float)
    doc = np.repeat(np.arange(n), np.diff(cut))
    length = (end - start).astype(float)
    safe = np.maximum(words, 1)
    mean = _sum(length, cut) / safe
    dev = np.sqrt(np.maximum(_sum(length * length, cut) / safe - mean * mean, 0))
    pre = prefix(data)
    h = spans_hash(pre, start, end)
    distinct, top = _by_value(h, doc, n)
    before = np.zeros(len(h), bool)
    before[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    pair = h.copy()
    pair[1:] = h[1:] * np.uint64(3) ^ h[:-1]
    follows = np.ones(len(h), bool)
    follows[cut[:-1][words > 0]] = False
    _, top_pair = _by_value(pair[follows], doc[follows], n)
    brk = np.flatnonzero((data == 10))
    edges = np.unique(np.concatenate([off, brk + 1])) if len(data) else np.zeros(1, np.int64)
    a, b = edges[:-1], edges[1:]
    ldoc = np.searchsorted(off, a, "right") - 1
    full = (b - a) > 1
    ldoc, lh = ldoc[full], spans_hash(pre, a[full], b[full] - (data[b[full] - 1] == 10))
    lines = np.bincount(ldoc, minlength=n).astype(float)
    distinct_lines, _ = _by_value(lh, ldoc, n)
    letters = np.concatenate([[0], np.cumsum((kind == 3) | (kind == 4) | (kind == 5))])
    upper = np.concatenate([[0], np.cumsum(kind == 3)])
    lower = np.concatenate([[0], np.cumsum(kind == 4)])
    n_up, n_low, n_let = upper[end] - upper[start], lower[end] - lower[start], letters[end] - letters[start]
    last = kind[end - 1] if len(end) else np.zeros(0, np.int64)
    f = lambda m: _logit(_sum(m, cut), words)
    return np.stack([
        np.log1p(size), np.log1p(words), np.log1p(mean), np.log1p(dev), _logit(share[3], size), _logit(share[2], size), _logit(share[6], size), _logit(share[0], size), _logit(share[1], size),
        _logit(distinct, words), _logit(_sum(before, cut), words), _logit(top, words), _logit(distinct_lines, lines), np.log1p(words / np.maximum(lines, 1)),
        f(length <= 3), f(last == 0), f((n_up > 1) & (n_low == 0)), f((n_let == 0) & (length == 1)), f(n_let == length), _logit(top_pair, words),
    ], axis=1)


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x) with the statistics of each text; null counts as empty."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            data, off = text_arrays(b.column(1))
            for i, j in slices(off, 1 << 20):
                x = statistics(data[off[i] : off[j]], off[i : j + 1] - off[i])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "x"])

    return texts(docs).mapInArrow(run, "doc_id bigint, x array<double>")


class Discriminant:
    """Two Gaussian classes; `score` gives the probability-like value of class 1."""

    def __init__(self, sums: dict[int, tuple[int, np.ndarray, np.ndarray]], pooled: float = POOLED[1], diagonal: float = DIAGONAL[1], scale: float = SCALE[3]):
        d = len(NAMES)
        self.scale, self.prior, self.parts = scale, 0.0, []
        total = sum(s[0] for s in sums.values())
        if set(sums) != {0, 1} or min(s[0] for s in sums.values()) < 2:
            self.constant = (sums[1][0] + 1) / (total + 2) if 1 in sums else 1 / (total + 2)
            return
        self.constant = None
        means = {k: s[1] / s[0] for k, s in sums.items()}
        scatter = {k: s[2] - s[0] * np.outer(means[k], means[k]) for k, s in sums.items()}
        common = sum(scatter.values()) / max(total - 2, 1)
        floor = np.diag(np.maximum(np.diag(common), 0) + 1e-3)
        for k in (0, 1):
            own = scatter[k] / max(sums[k][0] - 1, 1)
            w = d / (d + sums[k][0])  # few rows: lean more on the common covariance
            a = min(1.0, pooled + w)
            cov = (1 - diagonal) * ((1 - a) * own + a * common) + diagonal * floor
            chol = np.linalg.cholesky(cov + 1e-6 * np.eye(d))
            self.parts.append((means[k], chol, 2 * np.log(np.diag(chol)).sum()))
        self.prior = float(np.log(sums[1][0] / sums[0][0]))

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Difference of the log densities of class 1 and class 0."""
        dens = []
        for mean, chol, logdet in self.parts:
            z = np.linalg.solve(chol, (x - mean).T)
            dens.append(-0.5 * ((z * z).sum(0) + logdet))
        return dens[1] - dens[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.scale * self.log_odds(x) + self.prior, -500, 500)))


Sums = dict[int, tuple[int, np.ndarray, np.ndarray]]


def _sums(flat: np.ndarray) -> Sums:
    """Count, sum and sum of squares of each class that has rows, from flat rows (class; 1, x, x x')."""
    d = len(NAMES)
    return {k: (int(flat[k, 0]), flat[k, 1 : 1 + d], flat[k, 1 + d :].reshape(d, d)) for k in (0, 1) if flat[k, 0] > 0}


def _added(rows: DataFrame, size: int, add) -> np.ndarray:  # noqa: ANN001
    """The sum over all rows (x, y, fold) of what add(x, y, fold) gives for a batch, an array of `size`; a cell a task is reduced."""
    d = len(NAMES)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in it:
            if b.num_rows:
                total += add(np.asarray(b.column(0).flatten()).reshape(-1, d), b.column(1).to_numpy(), b.column(2).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["k", "v"])

    out = np.zeros(size)
    for r in rows.select("x", "y", "fold").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():  # `size` rows
        out[r.k] = r.v
    return out


def choose(rows: DataFrame, folds: np.ndarray) -> tuple[float, float, float]:
    """The shares and the scale with the least log loss over rows (x, y, fold), each judged by a model of the other folds.

    folds: sums of each fold, class and term. Folds without two rows of either
    class beside them are passed over; if all are, the middle of each list is taken.
    """
    tried = [(p, q) for p in POOLED for q in DIAGONAL]
    models = [[Discriminant(_sums(folds.sum(0) - folds[f]), p, q, 1.0) for p, q in tried] for f in range(FOLDS)]

    def loss(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
        out = np.zeros((len(tried), len(SCALE)))
        for f in np.unique(fold):
            own, sign = fold == f, np.where(y[fold == f] == 1, 1.0, -1.0)
            for t, m in enumerate(models[f]):
                if m.constant is None:
                    odds = m.log_odds(x[own])
                    out[t] += [np.logaddexp(0.0, -sign * (s * odds + m.prior)).sum() for s in SCALE]
        return out.ravel()

    total = _added(rows, len(tried) * len(SCALE), loss)
    if not total.any():
        return POOLED[1], DIAGONAL[1], SCALE[3]
    t, s = divmod(int(np.round(total, 6).argmin()), len(SCALE))
    return (*tried[t], SCALE[s])


def fit(feats: DataFrame, labels: DataFrame, label: str) -> Discriminant:
    """Sums of 1, x and x x' per class and fold over every labelled row, and a model with the shares and scale of `choose`; a label row that repeats counts again."""
    d = len(NAMES)
    known = labels.where(F.col(label).isin(0, 1)).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("y"))
    rows = stored(feats.join(known, "doc_id").select("x", "y", F.pmod(F.xxhash64("x"), F.lit(FOLDS)).cast("int").alias("fold")), "labelled")
    width = 1 + d + d * d

    def add(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
        total = np.zeros((FOLDS, 2, width))
        for f in range(FOLDS):
            for k in (0, 1):
                m = x[(y == k) & (fold == f)]
                total[f, k] += np.concatenate([[len(m)], m.sum(0), (m.T @ m).ravel()])
        return total.ravel()

    folds = _added(rows, FOLDS * 2 * width, add).reshape(FOLDS, 2, width)
    return Discriminant(_sums(folds.sum(0)), *choose(rows, folds))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", train: Column | None = None, threshold: float = 0.7) -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier) and predicted (1 from `threshold` on) of each row of docs.

    Takes doc_id and text of docs, doc_id and `label` (0 or 1; other values
    are left out) of labels; `train` is a condition on doc_id for the rows to
    learn from. Labels and ids are no inputs of a score. Null texts score as
    empty ones; rows that repeat keep a row each. With fewer than two rows of
    a class every score is the smoothed share of label 1.
    """
    feats = stored(features(docs), "statistics")
    model = fit(feats.where(train) if train is not None else feats, labels, label)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x = np.asarray(b.column(1).flatten()).reshape(-1, len(NAMES))
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return feats.mapInArrow(run, "doc_id bigint, score double, predicted int")
