"""Boosted trees from histograms: one Spark job per level of a tree, whatever the number of rows.

Features are cut once at quantiles of the training rows, and the rows are written once as blocks of bin numbers (a byte per
feature). A level is one pass: every task walks its rows down the tree as grown so far and returns, per node, feature and
bin, the summed gradients and curvatures of the log loss. Only the lighter child of each split is counted, its sibling is
the parent less it. The sums are added up on the executors where there are many tasks; what reaches the driver is nodes x
features x bins, which does not grow with the rows. The driver picks the splits.

Blocks carry the margin of their rows up to some tree; every ``REFRESH`` trees they are written again with new margins, so a
pass applies a bounded number of trees and a lost executor reads the blocks back. Rows and columns are sampled per tree
by hash and by seed, never by ``rand()``: a recomputed task returns the same sums.

Null and NaN count as 0 and infinities as +-1e6 (``scaling.finite``), in fitting and in scoring. A row goes left where its
value is below the cut.
"""
from __future__ import annotations

from math import factorial
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mailwarden.operators.components import Tables
from mailwarden.operators.scaling import finite
from mailwarden.operators.stacked import SUMS, total

#: Bins of a feature (a bin number is a byte), and trees between two rewrites of the margins.
BINS, REFRESH = 256, 10
_BLOCK = "keys binary, label binary, margin binary, bins binary"


class Tree(NamedTuple):
    """Nodes in heap order: the children of i are 2i + 1 and 2i + 2. ``feature`` is -1 at a leaf and below it, ``bin`` the last
    bin that goes left, ``cut`` the same as a value, ``cover`` the summed curvature of the rows that reached the node."""

    feature: np.ndarray
    bin: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    cover: np.ndarray


class Forest(NamedTuple):
    features: list[str]
    base: float
    depth: int
    trees: list[Tree]


def cut_points(train: DataFrame, features: list[str], bins: int = BINS, accuracy: int = 100000) -> list[np.ndarray]:
    """At most ``bins`` - 1 rising cuts per feature, from one mergeable quantile sketch per feature."""
    rows = finite(train.select(*features), features).unpivot([], features, "feature", "value")
    shares = [(i + 1) / bins for i in range(bins - 1)]
    found = rows.groupBy("feature").agg(F.percentile_approx("value", shares, accuracy).alias("q"), F.min("value").alias("low"))
    cuts = {r["feature"]: np.unique([x for x in r["q"] if x > r["low"]]) for r in found.collect()}      # one row per feature
    return [cuts.get(f, np.array([])) for f in features]


def _matrix(batch: pa.RecordBatch, start: int) -> np.ndarray:
    return np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(start, batch.num_columns)])


def binned_blocks(train: DataFrame, features: list[str], cuts: list[np.ndarray], label: str, key: str) -> DataFrame:
    """One row per Arrow batch of training rows: hashed keys, labels, margins (0) and bin numbers."""
    rows = finite(train, features).select(F.xxhash64(F.col(key).cast("string")), F.col(label).cast("double"), *features)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch, 2)
                bins = np.column_stack([np.searchsorted(c, x[:, i], "right") for i, c in enumerate(cuts)]).astype(np.uint8)
                label = batch.column(1).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in (
                    batch.column(0).to_numpy(), label.astype(np.float64), np.zeros(len(label)), bins)], names=["keys", "label", "margin", "bins"])
    return rows.mapInArrow(run, _BLOCK)


def _walk(bins: np.ndarray, tree: Tree, depth: int) -> np.ndarray:
    """The node that each row reaches after ``depth`` steps (a leaf on the way is kept)."""
    node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    for _ in range(depth):
        feature = tree.feature[node]
        child = 2 * node + 1 + (bins[rows, feature] > tree.bin[node])
        node = np.where(feature < 0, node, child)
    return node


def _sampled(keys: np.ndarray, seed: int, tree: int, share: float) -> np.ndarray:
    """Whether a row takes part in a tree: a mix of its key and the tree's number."""
    if share >= 1:
        return np.ones(len(keys), bool)
    with np.errstate(over="ignore"):
        z = keys.view(np.uint64) + np.uint64((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))) / 2.0 ** 64 < share


def _opened(batches):
    for batch in batches:
        for keys, label, margin, bins in zip(*[c.to_pylist() for c in batch.columns]):
            label = np.frombuffer(label, np.float64)
            yield (np.frombuffer(keys, np.int64), label, np.frombuffer(margin, np.float64),
                   np.frombuffer(bins, np.uint8).reshape(len(label), -1))


def _margins(margin, bins, trees, depth):
    for t in trees:
        margin = margin + t.value[_walk(bins, t, depth)]
    return margin


def _histograms(blocks: DataFrame, tasks: int, forest: Forest, since: int, growing: Tree, level: int, nodes: list[int],
                columns: np.ndarray, bins: int, number: int, share: float, seed: int) -> np.ndarray:
    """nodes x features x bins x (gradient, curvature) of the sampled rows, in one pass. A feature is a block of the sums."""
    sent = blocks.sparkSession.sparkContext.broadcast((forest.trees[since:], growing, forest.base))
    depth = forest.depth
    place = np.full(len(growing.feature), -1)
    place[nodes] = np.arange(len(nodes))

    def run(batches):
        trees, tree, base = sent.value
        out = np.zeros((len(columns), 2, len(nodes) * bins))
        for keys, label, margin, own in _opened(batches):
            at = place[_walk(own, tree, level)]
            rows = np.flatnonzero((at >= 0) & _sampled(keys, seed, number, share))
            own, at = own[rows], at[rows] * bins
            p = 1.0 / (1.0 + np.exp(-(base + _margins(margin[rows], own, trees, depth))))
            for i, c in enumerate(columns):
                cell = at + own[:, c]
                out[i, 0] += np.bincount(cell, p - label[rows], out.shape[2])
                out[i, 1] += np.bincount(cell, p * (1 - p), out.shape[2])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(columns)), pa.int32()), pa.array([o.tobytes() for o in out], pa.binary())],
                                         names=["block", "sums"])

    sums = total(blocks.mapInArrow(run, SUMS), tasks, 2 * len(nodes) * bins, len(columns), 2 * len(nodes) * bins * len(columns))
    sent.unpersist()
    return sums.reshape(len(columns), 2, len(nodes), bins).transpose(2, 0, 3, 1)


def best_split(hist: np.ndarray, penalty: float, least: float) -> tuple[float, int, int] | None:
    """(gain, feature, last bin on the left) of a node's features x bins x 2 sums; the first of equal ones. Both sides need a
    curvature of ``least``."""
    left = hist.cumsum(axis=1)[:, :-1]
    whole = hist.sum(axis=1, keepdims=True)
    right = whole - left
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + penalty)
    gain = np.where((left[..., 1] >= least) & (right[..., 1] >= least), score(left) + score(right) - score(whole), 0.0)
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return (float(gain[f, b]), int(f), int(b)) if gain[f, b] > 1e-9 else None


def fit(train: DataFrame, features: list[str], label: str = "label", key: str = "sample_id", n_trees: int = 300, depth: int = 6,
        rate: float = 0.1, subsample: float = 0.8, column_share: float = 0.8, penalty: float = 1.0, least: float = 1.0,
        bins: int = BINS, seed: int = 42) -> Forest:
    """Boost ``n_trees`` trees on the rows of ``train`` (labels 0 and 1). No rows give a forest without trees and a margin of 0."""
    spark = train.sparkSession
    cuts = cut_points(train, features, bins)
    tables = Tables(spark)
    tasks = spark.sparkContext.defaultParallelism
    blocks = tables.write(binned_blocks(train, features, cuts, label, key))
    share = train.agg(F.avg(F.col(label).cast("double"))).first()[0]
    if share is None:
        tables.remove()
        return Forest(features, 0.0, depth, [])
    share = min(max(share, 1e-6), 1 - 1e-6)
    forest = Forest(features, float(np.log(share / (1 - share))), depth, [])
    since = 0
    for number in range(n_trees):
        if number - since == REFRESH:
            blocks, since = _refreshed(blocks, forest, since, tables), number
        tree = Tree(np.full(2 ** (depth + 1) - 1, -1), *(np.zeros(2 ** (depth + 1) - 1, t) for t in (int, float, float, float)))
        rng = np.random.default_rng([seed, number])
        columns = np.sort(rng.choice(len(features), max(1, round(column_share * len(features))), replace=False))
        wanted, known = {0: None}, {}       # node to count -> (parent, sibling)
        for level in range(depth):
            if not wanted:
                break
            counted = _histograms(blocks, tasks, forest, since, tree, level, list(wanted), columns, bins, number, subsample, seed)
            parents, known = known, {}
            for hist, (node, kin) in zip(counted, wanted.items()):
                known[node] = hist
                if kin:
                    known[kin[1]] = parents[kin[0]] - hist
            wanted = {}
            for node, hist in known.items():
                g, h = hist[0].sum(axis=0)
                tree.cover[node], tree.value[node] = h, -rate * g / (h + penalty)
                found = best_split(hist, penalty, least)
                if found:
                    _, f, b = found
                    tree.feature[node], tree.bin[node], tree.cut[node] = columns[f], b, cuts[columns[f]][b]
                    left = hist[f, :b + 1].sum(axis=0)
                    for child, (cg, ch) in ((2 * node + 1, left), (2 * node + 2, (g - left[0], h - left[1]))):
                        tree.cover[child], tree.value[child] = ch, -rate * cg / (ch + penalty)
                    light = 2 * node + 1 if left[1] <= h - left[1] else 2 * node + 2
                    wanted[light] = (node, 4 * node + 3 - light)
        forest.trees.append(tree)
    tables.remove()
    return forest


def _refreshed(blocks: DataFrame, forest: Forest, since: int, tables: Tables) -> DataFrame:
    sent = blocks.sparkSession.sparkContext.broadcast(forest.trees[since:])
    depth = forest.depth

    def run(batches):
        for keys, label, margin, bins in _opened(batches):
            new = _margins(margin, bins, sent.value, depth)
            yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in (keys, label, new, bins)],
                                             names=["keys", "label", "margin", "bins"])
    out = tables.write(blocks.mapInArrow(run, _BLOCK))
    tables.keep_last()
    sent.unpersist()
    return out


def _added(df: DataFrame, forest: Forest, name: str, kind: str, work) -> DataFrame:
    """``df`` with a column that ``work`` makes of each batch's matrix of feature values."""
    values = F.array(*[F.col(f) for f in forest.features])
    tidy = finite(df.select(F.struct("*").alias("_row"), *forest.features), forest.features).select("_row", values.alias("_x"))

    @F.pandas_udf(kind)
    def made(x: pd.Series) -> pd.Series:
        return work(np.stack(x.to_list()) if len(x) else np.zeros((0, len(forest.features))))
    return tidy.withColumn(name, made("_x")).select("_row.*", name)


def score(df: DataFrame, forest: Forest) -> DataFrame:
    """Add ``margin``, ``prob`` and ``pred``; the forest travels with the function, its size is that of the model."""

    def work(x):
        out, rows = np.full(len(x), forest.base), np.arange(len(x))
        for t in forest.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(forest.depth):
                feature = t.feature[node]
                node = np.where(feature < 0, node, 2 * node + 1 + ~(x[rows, feature] < t.cut[node]))
            out += t.value[node]
        return pd.Series(out)
    prob = 1.0 / (1.0 + F.exp(-F.col("margin")))
    return (_added(df, forest, "margin", "double", work).withColumn("prob", prob)
            .withColumn("pred", (F.col("prob") >= 0.5).cast("int")))


class Leaf(NamedTuple):
    """A leaf's path, its conditions merged per feature: low <= x < high. ``table`` maps the set of conditions that a row meets
    (a bit each) to the share of each feature."""

    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    table: np.ndarray


def leaves(forest: Forest) -> list[Leaf]:
    """The leaf-path table of the forest with path-weighted Shapley values.

    A condition that is not known holds with the share of the cover that went its way. With m features on a path there are
    2^m outcomes (m is at most the depth); the exact values of each are worked out here, once per leaf.
    """
    out = []
    for t in forest.trees:
        todo = [(0, {})]
        while todo:
            node, path = todo.pop()
            f = int(t.feature[node])
            if f >= 0:
                low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
                for child, bounds in ((2 * node + 1, (low, min(high, t.cut[node]))), (2 * node + 2, (max(low, t.cut[node]), high))):
                    todo.append((child, {**path, f: (*bounds, share * t.cover[child] / t.cover[node])}))
            elif path:
                low, high, share = (np.array(v) for v in zip(*path.values()))
                out.append(Leaf(np.array(list(path)), low, high, t.value[node] * _shares(share)))
    return out


def _shares(unknown: np.ndarray) -> np.ndarray:
    """2^m x m: Shapley values of a leaf of value one, for each set of met conditions (bit j: condition j)."""
    m = len(unknown)
    met = (np.arange(2 ** m)[:, None] >> np.arange(m)) & 1
    out = np.zeros((2 ** m, m))
    for i in range(m):
        rest = [j for j in range(m) if j != i]
        # polynomial in the number of known features, one factor (unknown + met * z) per other feature
        poly = np.zeros((2 ** m, m))
        poly[:, 0] = 1.0
        for j in rest:
            poly[:, 1:] = poly[:, 1:] * unknown[j] + poly[:, :-1] * met[:, [j]]
            poly[:, 0] *= unknown[j]
        weight = np.array([factorial(s) * factorial(m - s - 1) / factorial(m) for s in range(m)])
        out[:, i] = (poly @ weight) * (met[:, i] - unknown[i])
    return out


def expected(forest: Forest) -> float:
    """The margin of a row of which nothing is known: leaf values weighted by cover."""
    def mean(t, node):
        if t.feature[node] < 0:
            return t.value[node]
        return sum(t.cover[c] * mean(t, c) for c in (2 * node + 1, 2 * node + 2)) / t.cover[node]
    return forest.base + sum(mean(t, 0) for t in forest.trees)


def shapley(df: DataFrame, forest: Forest) -> DataFrame:
    """Add ``contributions``: per feature, in the forest's order, its share of the margin beyond ``expected``. Rows are
    independent, so this is a projection."""
    paths = leaves(forest)

    def work(x):
        out, columns = np.zeros(x.shape), np.ascontiguousarray(x.T)
        for leaf in paths:
            met = np.zeros(len(x), np.int64)
            for j, f in enumerate(leaf.features):
                met |= ((columns[f] >= leaf.low[j]) & (columns[f] < leaf.high[j])).astype(np.int64) << j
            out[:, leaf.features] += leaf.table[met]
        return pd.Series(list(out))
    return _added(df, forest, "contributions", "array<double>", work)


def long_contributions(explained: DataFrame, forest: Forest, keep: list[str] | None = None) -> DataFrame:
    """(``keep``, feature, contribution): the contributions of ``shapley``, one row per mail and feature."""
    pairs = F.zip_with(F.lit(forest.features).cast("array<string>"), "contributions",
                       lambda f, c: F.struct(f.alias("feature"), c.alias("contribution")))
    return explained.select(*(keep or []), F.inline(pairs))
