"""A random forest whose trees are grown whole, each in a task over all samples, and kept in one file of which a reader holds a tree at a time."""

from __future__ import annotations

import json
import os
import pickle
import shutil
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialise, scratch_file

#: Values of a feature are told apart by at most so many cuts, at its quantiles.
CUTS = 255
#: Samples times features that a task may hold, a byte each.
MOST = 1 << 25


class Forest:
    """classes_, feature_importances_ and predict_proba(rows), from a file of trees."""

    heavy = True  # worth a shuffle of the pixels, so that all tasks get some

    def __init__(self, path: str, classes: list[float], cuts: list[list[float]], importances: list[float]) -> None:
        self.path, self.classes_, self.cuts, self.feature_importances_ = path, classes, cuts, importances

    def predict_proba(self, rows: np.ndarray) -> np.ndarray:
        """The mean over all trees of the shares of the classes in a row's leaf."""
        x, p, trees = binned(np.asarray(rows, float), self.cuts), np.zeros((len(rows), len(self.classes_))), 0
        every = np.arange(len(x))
        for feature, cut, left, shares in self.trees():
            at, going = np.zeros(len(x), np.int64), every
            while len(going):
                here = at[going]
                f = feature[here]
                going, here, f = going[f >= 0], here[f >= 0], f[f >= 0]
                at[going] = left[here] + (x[going, f] > cut[here])
            kind, leaf = feature[at], left[at]
            pure = kind == -1
            p[every[pure], leaf[pure]] += 1
            p[~pure] += shares[leaf[~pure]]
            trees += 1
        return p / trees

    def predict(self, rows: np.ndarray) -> np.ndarray:
        return np.asarray(self.classes_)[self.predict_proba(rows).argmax(1)]

    def trees(self) -> Iterator[tuple]:
        with open(self.path, "rb") as file:
            while True:
                try:
                    yield pickle.load(file)  # noqa: S301
                except EOFError:
                    return

    def save(self, folder: str) -> None:
        os.makedirs(folder, exist_ok=True)
        shutil.copyfile(self.path, os.path.join(folder, "trees.bin"))
        with open(os.path.join(folder, "forest.json"), "w", encoding="utf-8") as out:
            json.dump({"classes": self.classes_, "cuts": self.cuts, "importances": self.feature_importances_}, out)

    @classmethod
    def load(cls, folder: str) -> Forest:
        with open(os.path.join(folder, "forest.json"), encoding="utf-8") as text:
            own = json.load(text)
        return cls(os.path.join(folder, "trees.bin"), own["classes"], own["cuts"], own["importances"])


def cuts_of(x: np.ndarray) -> list[list[float]]:
    """Between neighbouring values of each feature, or, of many, between those at its quantiles."""
    out = []
    for column in x.T:
        v = np.unique(column[~np.isnan(column)])
        if len(v) > CUTS + 1:
            v = np.unique(np.quantile(column[~np.isnan(column)], np.linspace(0, 1, CUTS + 1), method="nearest"))
        out.append((v[:-1] + (v[1:] - v[:-1]) / 2).tolist())
    return out


def binned(x: np.ndarray, cuts: list[list[float]]) -> np.ndarray:
    """How many of a feature's cuts lie below each value; NaN lies above all."""
    return np.stack([np.searchsorted(np.asarray(c), v, "left").astype(np.uint8) for c, v in zip(cuts, x.T, strict=True)], axis=1)


def _best(x: np.ndarray, y: np.ndarray, w: np.ndarray, node: np.ndarray, total: np.ndarray, drawn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each node the best of its drawn features and cuts by Gini impurity: score (-inf: none), feature, cut. Rows are ordered by node."""
    m, f = drawn.shape
    score, feature, cut = np.full(m, -np.inf), np.zeros(m, np.int16), np.zeros(m, np.uint8)
    begin = np.searchsorted(node, np.arange(m + 1))
    low = 0
    while low < m:  # so many nodes at once that a pair of node and feature has 16 bits, which sorts fast, and arrays stay small
        high = max(low + 1, min(low + 65_000 // f, int(np.searchsorted(begin, begin[low] + (1 << 20) // f, "right")) - 1, m))
        at = slice(begin[low], begin[high])
        score[low:high], feature[low:high], cut[low:high] = _best_of(x[at], y[at], w[at], node[at] - low, total[low:high], drawn[low:high])
        low = high
    return score, feature, cut


def _best_of(x: np.ndarray, y: np.ndarray, w: np.ndarray, node: np.ndarray, total: np.ndarray, drawn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows stand once for each drawn feature, sorted by node, feature and bin. Sums of squares of the classes' weights left and right of
    a cut are running sums of what each row adds; weights are whole, so all sums are exact."""
    m, f = drawn.shape
    score, feature, cut = np.full(m, -np.inf), np.zeros(m, np.int16), np.zeros(m, np.uint8)
    bins = x[np.arange(len(y))[:, None], drawn[node]].ravel()
    group = (node[:, None] * f + np.arange(f)).astype(np.uint16 if m * f < 1 << 16 else np.int64).ravel()
    order = np.argsort(bins, kind="stable")
    order = order[np.argsort(group[order], kind="stable")]
    bins, group, row = bins[order], group[order], order // f
    y, w, own = y[row], w[row], node[row]
    by = np.argsort(y, kind="stable")  # runs of one class in one group
    own_y, own_g, own_w = y[by], group[by], w[by]
    before = np.cumsum(own_w) - own_w
    run = np.flatnonzero(np.concatenate([[True], (own_y[1:] != own_y[:-1]) | (own_g[1:] != own_g[:-1])]))
    had = np.empty(len(y))
    had[by] = before - np.repeat(before[run], np.diff(run, append=len(y)))  # of the row's class, left of it
    squares, cross, weight = np.cumsum(w * (2 * had + w)), np.cumsum(w * total[own, y]), np.cumsum(w)
    same = group[1:] == group[:-1]
    ends = np.flatnonzero(same & (bins[1:] != bins[:-1]))  # the last rows left of a cut
    if not len(ends):
        return score, feature, cut
    start = np.concatenate([[0], np.flatnonzero(~same) + 1])
    start = start[np.searchsorted(start, ends, "right") - 1]
    less = lambda v: v[ends] - np.where(start, v[start - 1], 0)
    low, both, left = less(squares), less(cross), less(weight)
    own = own[ends]
    told = low / left + ((total * total).sum(1)[own] - 2 * both + low) / (total.sum(1)[own] - left)
    first = np.flatnonzero(np.diff(own, prepend=-1))
    most = np.maximum.reduceat(told, first)
    best = np.flatnonzero(told == np.repeat(most, np.diff(first, append=len(own))))
    nodes, place = np.unique(own[best], return_index=True)  # of equals the first
    at = ends[best[place]]
    score[nodes], feature[nodes], cut[nodes] = most, drawn[nodes, group[at].astype(np.int64) - nodes * f], bins[at]
    return score, feature, cut


def grow(x: np.ndarray, y: np.ndarray, k: int, features: int, depth: int | None, rng: np.random.Generator) -> tuple[tuple, np.ndarray]:
    """A tree over a bootstrap of the binned rows, grown until its leaves are pure or can't be cut: its nodes, and what each feature gave.

    A node has a feature, a cut and its left child, with the right one after it; a pure leaf is -1 and its class, another is -2 and its place among shares.
    """
    row, w = np.unique(rng.integers(0, len(y), len(y)), return_counts=True)
    x, y, w, node = x[row], y[row].astype(np.uint8 if k <= 256 else np.int64), w.astype(float), np.zeros(len(row), np.int64)
    all_f, all_c, all_l, shares, gain = [], [], [], [], np.zeros(x.shape[1])
    n_nodes, n_shares, level = 1, 0, 0
    whole = w.sum()
    while len(y):
        m = int(node[-1]) + 1
        total = np.bincount(node * k + y, w, m * k).reshape(m, k)
        pure = (total > 0).sum(1) == 1
        feature, cut, left = np.where(pure, -1, -2).astype(np.int16), np.zeros(m, np.uint8), np.where(pure, total.argmax(1), 0).astype(np.int32)
        if depth is None or level < depth:
            drawn = np.argpartition(rng.random((m, x.shape[1])), features - 1, axis=1)[:, :features] if features < x.shape[1] else np.tile(np.arange(x.shape[1]), (m, 1))
            open_ = ~pure
            for again in (False, True):  # a node that the drawn features can't cut may be cut by any
                if not open_.any():
                    break
                take, number = open_[node], np.cumsum(open_) - 1
                each = np.flatnonzero(open_)
                s, f, c = _best(x[take], y[take], w[take], number[node[take]], total[each], np.tile(np.arange(x.shape[1]), (len(each), 1)) if again else drawn[each])
                good = np.isfinite(s)
                feature[each[good]], cut[each[good]] = f[good], c[good]
                t = total[each[good]]
                np.add.at(gain, f[good], (s[good] - (t * t).sum(1) / t.sum(1)) / whole)
                open_[each[good]] = False
        split, rough = feature >= 0, feature == -2
        left[split] = n_nodes + 2 * np.arange(split.sum())
        left[rough] = n_shares + np.arange(rough.sum())
        shares.append(total[rough] / total[rough].sum(1, keepdims=True))
        n_nodes, n_shares, level = n_nodes + 2 * int(split.sum()), n_shares + int(rough.sum()), level + 1
        all_f.append(feature)
        all_c.append(cut)
        all_l.append(left)
        stay = split[node]
        x, y, w, node = x[stay], y[stay], w[stay], node[stay]
        number = np.cumsum(split) - 1
        node = 2 * number[node] + (x[np.arange(len(y)), feature[node]] > cut[node])
        order = np.argsort(node, kind="stable")
        x, y, w, node = x[order], y[order], w[order], node[order]
    return (np.concatenate(all_f), np.concatenate(all_c), np.concatenate(all_l), np.concatenate(shares)), gain / (gain.sum() or 1)


def fit(samples: DataFrame, trees: int, depth: int | None, seed: int) -> Forest:
    """A forest of samples (label, features); the square root of the features at each node. The driver and each task hold all samples, binned."""
    spark = samples.sparkSession
    held = samples.select("label", F.transform("features", lambda v: v.cast("double")).alias("features")).orderBy("label", "features").toArrow()
    labels = held.column("label").to_pylist()
    names = sorted(set(labels), key=str)
    code = {v: i for i, v in enumerate(names)}
    y = np.array([code[v] for v in labels])
    flat = held.column("features").combine_chunks()
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(y), -1)
    cuts = cuts_of(x)
    shared = spark.sparkContext.broadcast((binned(x, cuts), y))
    k, features = len(names), max(1, int(x.shape[1] ** 0.5 + 0.999999))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, own = shared.value
        for batch in batches:
            for t in batch.column("id").to_pylist():
                tree, gain = grow(rows, own, k, features, depth, np.random.default_rng([seed, t]))
                yield pa.RecordBatch.from_arrays([pa.array([t]), pa.array([pickle.dumps(tree)], pa.binary()), pa.array([gain.tolist()])], ["id", "tree", "gain"])

    grown = materialise(spark.range(0, trees, 1, min(trees, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(each, "id long, tree binary, gain array<double>"), "trees")
    path, total = scratch_file(spark, "trees.bin"), np.zeros(x.shape[1])
    with open(path, "wb") as out:
        for r in grown.orderBy("id").toLocalIterator():
            out.write(r["tree"])
            total += r["gain"]
    discard(grown)
    shared.unpersist()
    return Forest(path, [float(v) for v in names], cuts, (total / trees).tolist())
