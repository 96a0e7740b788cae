"""Trees of counts against trees of rows, fold by fold and deal by deal."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ophelion.operators import cube

ROWS = "k long, a double, b double, c string, y int"
HOW = {"numeric": ["a", "b"], "categorical": {"c": ("u", "v")}}


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(3)
    rows = []
    for k in range(260):
        a, b, c = rng.gauss(0, 1), float(rng.randrange(4)), rng.choice(["u", "v", "w", None])
        y = int(a + (c == "u") + rng.gauss(0, 0.7) > 0.3)
        rows.append((k, None if k % 19 == 0 else a, None if k % 23 == 0 else b, c, None if k % 41 == 0 else y))
    return spark.createDataFrame(rows, ROWS).repartition(3)


def placed(df, folds):
    cell, _ = cube.binned(df, HOW["numeric"], HOW["categorical"])
    return [(list(r["cell"]), r["y"], *r[2:]) for r in df.select(cell.alias("cell"), "y", *folds).where("y is not null").collect()]


def gini(ys):
    return 2 * sum(ys) * (len(ys) - sum(ys)) / len(ys) if ys else 0.0


def tree_of_rows(rows, depth):
    """rows: (cell, y). A function from a cell to a label."""
    ys = [y for _, y in rows]
    label = int(2 * sum(ys) >= len(ys))
    if depth == 0 or len(set(ys)) < 2:
        return lambda x: label
    best, least = None, gini(ys) - 1e-9
    for c in range(len(rows[0][0])):
        for last in range(max(x[c] for x, _ in rows)):
            left, right = [y for x, y in rows if x[c] <= last], [y for x, y in rows if x[c] > last]
            if left and right and gini(left) + gini(right) < least:
                best, least = (c, last), gini(left) + gini(right) - 1e-9
    if best is None:
        return lambda x: label
    c, last = best
    low, high = (tree_of_rows([r for r in rows if (r[0][c] <= last) == side], depth - 1) for side in (True, False))
    return lambda x: low(x) if x[c] <= last else high(x)


def judged(tree, rows):
    n = {(p, y): 0 for p in (0, 1) for y in (0, 1)}
    for x, y in rows:
        n[tree(x), y] += 1
    each = [n[k, k] / (n[0, k] + n[1, k]) for k in (0, 1) if n[0, k] + n[1, k]]
    return (n[0, 0], n[1, 0], n[0, 1], n[1, 1]), sum(each) / len(each) if each else 0.0


def test_nested_cv(data):
    found = {(r["repeat"], r["fold"]): r for r in cube.nested_cv(data, "y", "k", depths=(1, 3), outer=3, repeats=2, inner=3, **HOW).collect()}
    assert len(found) == 6
    for repeat in range(2):
        rows = placed(data, [cube._fold("k", 3, F.lit(repeat), F.lit(42)), cube._fold("k", 3, F.lit(repeat), F.lit(42), F.lit("inner"))])
        for o in range(3):
            rest = [r for r in rows if r[2] != o]
            means = []
            for depth in (1, 3):
                trees = [tree_of_rows([r[:2] for r in rest if r[3] != i], depth) for i in range(3)]
                means.append(sum(judged(tree, [r[:2] for r in rest if r[3] == i])[1] for i, tree in enumerate(trees)))
            winner = (1, 3)[int(means[1] > means[0] + 1e-12)]
            counts, balanced = judged(tree_of_rows([r[:2] for r in rest], winner), [r[:2] for r in rows if r[2] == o])
            r = found[repeat, o]
            assert (r["winner"], r["tn"], r["fp"], r["fn"], r["tp"]) == (winner, *counts)
            assert r["balanced_accuracy"] == pytest.approx(balanced)


def test_sizes_of_the_full_job(data):
    out = cube.nested_cv(data, "y", "k", **HOW).collect()
    assert len(out) == 100 and {r["repeat"] for r in out} == set(range(20))
    assert all(sum(r["tn"] + r["fp"] + r["fn"] + r["tp"] for r in out if r["repeat"] == k) == 253 for k in range(20))
    assert cube.nested_cv(data.where("false"), "y", "k", **HOW).count() == 0
    with pytest.raises(ValueError, match="fewer bins"):
        cube.nested_cv(data, "y", "k", ["a"] * 8, bins=16)


def test_permutation_test(data):
    got = cube.permutation_test(data, "y", "k", depth=2, folds=3, replicates=40, **HOW).first()
    rows = sorted(placed(data, [cube._fold("k", 3, F.lit(42))]), key=lambda r: (r[2], r[0]))

    def score(rows):
        folds = sorted({r[2] for r in rows})
        return sum(judged(tree_of_rows([r[:2] for r in rows if r[2] != k], 2), [r[:2] for r in rows if r[2] == k])[1] for k in folds) / len(folds)

    cells = sorted({(r[2], tuple(r[0])) for r in rows})
    totals = np.array([sum((r[2], tuple(r[0])) == c for r in rows) for c in cells])
    hits = 0
    for k in range(40):  # the same deals, as rows
        ones = cube.deal(k, totals, sum(r[1] for r in rows), 42)
        assert ones.sum() == sum(r[1] for r in rows) and (ones <= totals).all()
        dealt = [(list(cell), int(j < n), fold) for (fold, cell), total, n in zip(cells, totals, ones) for j in range(total)]
        hits += score(dealt) >= got["observed"] - 1e-12
    assert got["observed"] == pytest.approx(score(rows))
    assert (got["replicates"], got["at_least"]) == (40, hits) and got["p_value"] == pytest.approx((hits + 1) / 41)
    assert got["p_value"] < 0.1
    noise = data.withColumn("y", F.pmod(F.xxhash64("k"), F.lit(2)).cast("int"))
    assert cube.permutation_test(noise, "y", "k", depth=2, replicates=60, **HOW).first()["p_value"] > 0.05
    assert cube.permutation_test(data.where("false"), "y", "k", **HOW).first()["observed"] is None
