"""Histogram boosting and tree attribution against brute force on small tables."""
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailwarden.operators import boosting

NAMES = ["a", "b", "c", "d"]


def table(spark, n=240, seed=0, noise=0.3):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, size=(n, len(NAMES))).astype(float)
    y = (x[:, 0] + 2 * (x[:, 1] > 5) * x[:, 2] + noise * rng.normal(size=n) * 10 > 12).astype(int)
    rows = [(f"s{i}", int(y[i]), *x[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "sample_id string, label int, " + ", ".join(f"{c} double" for c in NAMES)).repartition(3), x, y


def grow(x, g, h, depth, rate):
    """A tree by trying every value of every feature on the rows of a node."""
    leaf = -rate * g.sum() / (h.sum() + 1)
    best = (1e-9, None, None)
    for f in range(x.shape[1]) if depth else ():
        for cut in np.unique(x[:, f])[1:]:
            left = x[:, f] < cut
            if min(h[left].sum(), h[~left].sum()) >= 1:
                gain = sum(g[m].sum() ** 2 / (h[m].sum() + 1) for m in (left, ~left)) - g.sum() ** 2 / (h.sum() + 1)
                if gain > best[0] + 1e-12:
                    best = (gain, f, cut)
    if best[1] is None:
        return lambda row: leaf
    _, f, cut = best
    left = x[:, f] < cut
    below, above = (grow(x[m], g[m], h[m], depth - 1, rate) for m in (left, ~left))
    return lambda row: below(row) if row[f] < cut else above(row)


def test_fit_equals_brute_force(spark):
    df, x, y = table(spark)
    n_trees = boosting.REFRESH + 3                    # margins are written again on the way
    forest = boosting.fit(df, NAMES, n_trees=n_trees, depth=3, rate=0.3, subsample=1.0, column_share=1.0)
    z = np.full(len(y), math.log(y.mean() / (1 - y.mean())))
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-z))
        tree = grow(x, p - y, p * (1 - p), 3, 0.3)
        z = z + np.array([tree(row) for row in x])
    got = {r["sample_id"]: r["margin"] for r in boosting.score(df, forest).collect()}
    assert max(abs(got[f"s{i}"] - z[i]) for i in range(len(y))) < 1e-8


def test_samples_are_the_same_for_any_layout(spark):
    df, x, y = table(spark, 400, 3)
    one, two = (boosting.fit(d, NAMES, n_trees=4, depth=3) for d in (df, df.repartition(7)))
    for a, b in zip(one.trees, two.trees):
        assert (a.feature == b.feature).all() and (a.bin == b.bin).all() and np.allclose(a.value, b.value)
    keys = np.arange(20000)
    for t in range(3):
        assert abs(boosting._sampled(keys, 42, t, 0.8).mean() - 0.8) < 0.02
    assert (boosting._sampled(keys, 42, 0, 0.8) != boosting._sampled(keys, 42, 1, 0.8)).any()
    acc = boosting.score(df, boosting.fit(df, NAMES, n_trees=40, depth=4)).agg(F.avg((F.col("pred") == F.col("label")).cast("int"))).first()[0]
    assert acc > 0.9


def known_margin(tree, row, known, node=0):
    f = tree.feature[node]
    if f < 0:
        return tree.value[node]
    left, right = 2 * node + 1, 2 * node + 2
    if f in known:
        return known_margin(tree, row, known, left if row[f] < tree.cut[node] else right)
    return sum(tree.cover[c] * known_margin(tree, row, known, c) for c in (left, right)) / tree.cover[node]


def test_contributions_equal_all_subsets(spark):
    df, x, _ = table(spark, 120, 5)
    forest = boosting.fit(df, NAMES, n_trees=5, depth=4, rate=0.5)
    rows = boosting.shapley(boosting.score(df, forest), forest)
    long = {(r["sample_id"], r["feature"]): r["contribution"] for r in boosting.long_contributions(rows, forest, ["sample_id"]).collect()}
    d = len(NAMES)
    for r in rows.collect():
        row = [r[c] for c in NAMES]
        assert r["margin"] == pytest.approx(boosting.expected(forest) + sum(r["contributions"]), abs=1e-9)
        if int(r["sample_id"][1:]) % 10:
            continue
        worth = {s: sum(known_margin(t, row, s) for t in forest.trees)
                 for k in range(d + 1) for s in itertools.combinations(range(d), k)}
        for i in range(d):
            value = sum(math.factorial(len(s)) * math.factorial(d - len(s) - 1) / math.factorial(d)
                        * (worth[tuple(sorted((*s, i)))] - worth[s]) for s in worth if i not in s)
            assert r["contributions"][i] == pytest.approx(value, abs=1e-9)
            assert long[(r["sample_id"], NAMES[i])] == r["contributions"][i]


def test_nulls_one_label_constant_features_and_no_rows(spark):
    df, _, _ = table(spark, 60, 7)
    odd = (df.withColumn("a", F.when(F.col("a") > 6, F.col("a"))).withColumn("b", F.when(F.col("b") > 9, F.lit(float("inf"))).otherwise(F.col("b")))
           .withColumn("d", F.lit(3.0)).withColumn("_x", F.lit(1)))
    forest = boosting.fit(odd, NAMES, n_trees=3, depth=2, column_share=1.0)
    scored = boosting.score(odd, forest)
    assert scored.columns[:7] == ["sample_id", "label", *NAMES, "_x"] and scored.filter("margin is null or isnan(margin)").count() == 0
    assert all((t.feature != 3).all() for t in forest.trees)
    single = boosting.fit(df.withColumn("label", F.lit(1)), NAMES, n_trees=2, depth=2)
    assert boosting.score(df, single).filter("prob < 0.99").count() == 0
    none = boosting.fit(df.filter("false"), NAMES, n_trees=2, depth=2)
    assert none.trees == [] and boosting.score(df, none).filter("margin <> 0").count() == 0
    assert boosting.shapley(df.filter("false"), forest).count() == 0
