"""Nested cross-validation and permutation tests of decision trees from counts.

Numbers are cut at quantiles into a few bins and texts into 0/1 columns of given labels,
so that all a tree can see of a row is its cell, and all that fitting and judging need is
how many rows of each class a cell has in each fold. Rows are read once and summed up to
that cube, whose size is bounded by bins, labels and folds and is checked. Every fit of
every fold then works on cells; the repeats of a validation, and the replicates of a
test, are rows of one Spark job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .classify import rates
from .quantiles import quantiles

BINS, MAX_CELLS = 8, 1 << 22


def binned(df: DataFrame, numeric: Sequence[str], categorical: Mapping[str, Sequence[str]] | None = None, bins: int = BINS) -> tuple[Column, int]:
    """(the cell of a row as an array of bins, the number of possible cells). A missing
    number is the median; the bins don't know the labels of rows. A text that is missing
    or not among its labels is 0 in each of their columns."""
    parts, cells = [], 1
    for c in numeric:
        edges = quantiles(df, c, {f"q{i}": i / bins for i in range(1, bins)} | {"median": 0.5}).first()
        known = [e for i in range(1, bins) if edges and (e := edges[f"q{i}"]) is not None]
        value = F.coalesce(F.col(c).cast("double"), F.lit(edges["median"] if edges else None).cast("double"))
        over = [F.coalesce((value > F.lit(float(e))).cast("int"), F.lit(0)) for e in sorted(set(known))]
        parts.append(sum(over[1:], over[0]) if over else F.lit(0))
        cells *= len(over) + 1
    for c, labels in (categorical or {}).items():
        parts += [F.coalesce((F.col(c) == F.lit(x)).cast("int"), F.lit(0)) for x in labels]
        cells *= len(labels) + 1
    return F.array(*parts).cast("array<int>"), cells


def _fold(key: str, folds: int, *salt: Column) -> Column:
    return F.pmod(F.xxhash64(F.col(key), *salt), F.lit(folds)).cast("int")


def _check(cells: int, folds: int) -> None:
    if cells * folds > MAX_CELLS:
        raise ValueError(f"{cells} cells in {folds} folds: take fewer bins, columns or labels")


def _counted(rows: DataFrame, label: str, *by: str) -> DataFrame:
    known = rows.where(F.col(label).isNotNull())
    return known.groupBy(*by, "cell").agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))


# ------------------------------------------------------------------- trees


def grow(x: np.ndarray, pos: np.ndarray, neg: np.ndarray, depth: int) -> tuple:
    """(label, column, last bin on the left, left, right): the split of least Gini
    impurity, the first of equal ones; without one the last four are None. The label is
    the commoner class, 1 on a tie."""
    p, n = pos.sum(), neg.sum()
    leaf = (int(p >= n), None, None, None, None)
    if depth == 0 or p == 0 or n == 0:
        return leaf
    best, least = None, 2 * p * n / (p + n) - 1e-9
    for c in range(x.shape[1]):
        size = int(x[:, c].max()) + 1
        left_p, left_n = (np.cumsum(np.bincount(x[:, c], w, size))[:-1] for w in (pos, neg))
        left, right = left_p + left_n, p + n - left_p - left_n
        ok = (left > 0) & (right > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            impurity = np.where(ok, 2 * left_p * left_n / left + 2 * (p - left_p) * (n - left_n) / right, np.inf)
        if len(impurity) and impurity.min() < least:
            best, least = (c, int(impurity.argmin())), impurity.min() - 1e-9
    if best is None:
        return leaf
    goes = x[:, best[0]] <= best[1]
    return leaf[0], *best, grow(x[goes], pos[goes], neg[goes], depth - 1), grow(x[~goes], pos[~goes], neg[~goes], depth - 1)


def predict(tree: tuple, x: np.ndarray, depth: int) -> np.ndarray:
    """Labels by the tree cut off at a depth, which is the tree grown to it."""
    label, column, last, left, right = tree
    out = np.full(len(x), label)
    if column is not None and depth > 0:
        goes = x[:, column] <= last
        out[goes], out[~goes] = predict(left, x[goes], depth - 1), predict(right, x[~goes], depth - 1)
    return out


def _confusion(predicted: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> tuple[int, int, int, int]:
    one = predicted == 1
    return int(neg[~one].sum()), int(neg[one].sum()), int(pos[~one].sum()), int(pos[one].sum())


def _balanced(tn: float, fp: float, fn: float, tp: float) -> float:
    each = [a / (a + b) for a, b in ((tp, fn), (tn, fp)) if a + b]
    return sum(each) / len(each) if each else 0.0


def nested_cv(df: DataFrame, label: str, key: str, numeric: Sequence[str], categorical: Mapping[str, Sequence[str]] | None = None, depths: Sequence[int] = (2, 4), outer: int = 5, repeats: int = 20, inner: int = 5, seed: int = 42, bins: int = BINS) -> DataFrame:
    """(repeat, fold, winner, and the rates of ``binary_metrics``): in each outer fold the
    depth of best mean balanced accuracy over the inner folds, the least of equal ones,
    is fitted on the rest and judged on the fold. Folds are hashes of key and repeat.
    Rows without a label are left out; a fold without rows has zeros."""
    cell, cells = binned(df, numeric, categorical, bins)
    _check(cells, outer * inner)
    rows = df.select(key, label, cell.alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    folds = rows.withColumns({"outer": _fold(key, outer, F.col("repeat"), F.lit(seed)), "inner": _fold(key, inner, F.col("repeat"), F.lit(seed), F.lit("inner"))})
    deepest = max(depths)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, pos, neg = np.stack(pdf["cell"].to_numpy()), pdf["pos"].to_numpy(np.float64), pdf["neg"].to_numpy(np.float64)
        out_of, in_of = pdf["outer"].to_numpy(), pdf["inner"].to_numpy()
        fit = lambda rows: grow(x[rows], pos[rows], neg[rows], deepest)
        judged = lambda tree, depth, rows: _confusion(predict(tree, x[rows], depth), pos[rows], neg[rows])
        found = []
        for o in range(outer):
            rest, scores = out_of != o, np.zeros(len(depths))
            for i in range(inner) if len(depths) > 1 else ():
                tree = fit(rest & (in_of != i))
                scores += [_balanced(*judged(tree, d, rest & (in_of == i))) for d in depths]
            winner = depths[int(scores.argmax())]
            found.append((int(pdf["repeat"].iloc[0]), o, winner, *judged(fit(rest), winner, out_of == o)))
        return pd.DataFrame(found, columns=["repeat", "fold", "winner", "tn", "fp", "fn", "tp"])

    counted = _counted(folds, label, "repeat", "outer", "inner")
    return rates(counted.groupBy("repeat").applyInPandas(run, "repeat int, fold int, winner int, tn long, fp long, fn long, tp long"))


def cv_score(x: np.ndarray, fold: np.ndarray, pos: np.ndarray, neg: np.ndarray, depth: int) -> float:
    """The mean balanced accuracy over the folds that have rows."""
    scores = []
    for k in np.unique(fold):
        rest = fold != k
        tree = grow(x[rest], pos[rest], neg[rest], depth) if rest.any() else (1, None, None, None, None)
        scores.append(_balanced(*_confusion(predict(tree, x[~rest], depth), pos[~rest], neg[~rest])))
    return sum(scores) / len(scores) if scores else 0.0


def deal(replicate: int, totals: np.ndarray, ones: int, seed: int) -> np.ndarray:
    """How many rows of class 1 each cell has once labels are dealt anew: what a shuffle of
    all rows' labels leaves in cells of these sizes is multivariate hypergeometric."""
    return np.random.default_rng([seed, replicate]).multivariate_hypergeometric(totals, ones, method="marginals")


def permutation_test(df: DataFrame, label: str, key: str, numeric: Sequence[str], categorical: Mapping[str, Sequence[str]] | None = None, depth: int = 4, folds: int = 5, replicates: int = 1000, seed: int = 42, bins: int = BINS) -> DataFrame:
    """(observed, replicates, at_least, p_value): how often the cross-validated balanced
    accuracy of a tree is at least as high with labels dealt to other rows. The p-value
    counts the observed order as one of the deals. Without rows nothing is observed."""
    cell, cells = binned(df, numeric, categorical, bins)
    _check(cells, folds)
    counts = _counted(df.select(key, label, cell.alias("cell"), _fold(key, folds, F.lit(seed)).alias("fold")), label, "fold").orderBy("fold", "cell").toPandas()  # cells * folds at most
    spark = df.sparkSession
    kind = "observed double, replicates int, at_least long, p_value double"
    if counts.empty:
        return spark.createDataFrame([(None, replicates, None, None)], kind)
    x, fold = np.stack(counts["cell"].to_numpy()), counts["fold"].to_numpy()
    pos, neg = counts["pos"].to_numpy(np.int64), counts["neg"].to_numpy(np.int64)
    observed, shared = cv_score(x, fold, pos, neg, depth), spark.sparkContext.broadcast((x, fold, pos + neg, int(pos.sum())))

    def run(batches):
        where, of, totals, ones = shared.value
        for batch in batches:
            scores = []
            for r in batch["id"]:
                dealt = deal(int(r), totals, ones, seed)
                scores.append(cv_score(where, of, dealt, totals - dealt, depth))
            yield pd.DataFrame({"replicate": batch["id"], "score": scores})

    drawn = spark.range(0, replicates, 1, max(1, replicates // 25)).mapInPandas(run, "replicate long, score double")
    hits = drawn.agg(F.count_if(F.col("score") >= observed).alias("at_least"))
    return hits.select(F.lit(observed).alias("observed"), F.lit(replicates).alias("replicates"), "at_least", ((F.col("at_least") + 1) / (replicates + 1)).alias("p_value"))
