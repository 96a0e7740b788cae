"""Preparation, evaluation and nested cross-validation of classifiers.

Folds, splits and metrics are windows and aggregates; fitting is pyspark.ml. Any
estimator with features/label columns and a probability or raw prediction fits in.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import join_groups, quantiles


def patient_aggregate(df: DataFrame, key: str, numeric: Sequence[str], other: Sequence[str], order: str) -> DataFrame:
    """Per patient the mean of numeric columns (text is cast) and the first non-null
    value of the others."""
    return df.groupBy(key).agg(*[F.avg(F.col(c).cast("string").try_cast("double")).alias(c) for c in numeric], *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in other])


def class_balance(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(label, positive, negative, missing, positive_pct) of boolean columns."""
    row = df.agg(F.array(*[F.struct(F.lit(c).alias("label"), F.count_if(F.col(c)).alias("positive"), F.count_if(~F.col(c)).alias("negative"), F.count_if(F.col(c).isNull()).alias("missing")) for c in labels]).alias("x"))
    return row.select(F.explode("x").alias("x")).select("x.*").withColumn("positive_pct", F.round(F.try_divide(100.0 * F.col("positive"), F.col("positive") + F.col("negative")), 2))


def stratified_split(df: DataFrame, label: str, key: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds is_test: of each class the rows of smallest hash. The cut is a quantile of
    the hash per class, found from counts in 4096 ranges and exact inside one of them."""
    h = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 40))
    placed = df.withColumns({"_h": h, "_r": F.shiftright(h, 28).cast("int")})
    counts = placed.groupBy(label, "_r").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(label)
    upto = F.sum("_c").over(w.orderBy("_r").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    wanted = F.round(F.sum("_c").over(w) * F.lit(test)).cast("long")
    starts = counts.select(F.col(label).alias("_label"), F.col("_r").alias("_range"), (upto - F.col("_c")).alias("_before"), wanted.alias("_wanted"))
    inside = F.row_number().over(Window.partitionBy(label, "_r").orderBy("_h", key))
    joined = placed.withColumn("_n", inside).join(starts, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_r") == F.col("_range")))
    return joined.withColumn("is_test", F.col("_before") + F.col("_n") <= F.col("_wanted")).select(*df.columns, "is_test")


def stratified_folds(df: DataFrame, label: str, key: str, folds: int, seed: int) -> DataFrame:
    """Adds fold 0..folds-1, dealt in turn within each class in a hashed order."""
    n = F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key))
    return df.withColumn("fold", (n - 1) % folds)


def confusion(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    return df.groupBy(*by).agg(F.count_if(~t & ~p).alias("tn"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(t & p).alias("tp"))


def rates(counts: DataFrame) -> DataFrame:
    """Adds the rates of confusion counts; 0 where a denominator is 0."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    sens, spec, prec = div(tp, tp + fn), div(tn, tn + fp), div(tp, tp + fp)
    # balanced accuracy averages the classes that occur
    classes = (tp + fn > 0).cast("int") + (tn + fp > 0).cast("int")
    return counts.withColumns(
        {
            "accuracy": div(tp + tn, tp + tn + fp + fn),
            "balanced_accuracy": div(sens + spec, classes.cast("double")),
            "sensitivity": sens,
            "specificity": spec,
            "precision": prec,
            "f1": div(2 * tp, 2 * tp + fp + fn),
            "mcc": div(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
        }
    )


def binary_metrics(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """All rates from one confusion count."""
    return rates(confusion(df, truth, predicted, by))


def _by_score(df: DataFrame, truth: str, score: str) -> DataFrame:
    """(score, p, n): positives and negatives of each distinct score."""
    t = (F.col(truth) == 1).cast("int")
    return df.groupBy(F.col(score).alias("score")).agg(F.sum(t).alias("p"), F.sum(1 - t).alias("n"))


def _running(counts: DataFrame, buckets: int = 1024) -> DataFrame:
    """Adds P and N, positives and negatives at or above each score. Scores are cut
    into ranges; the running sums are over the ranges and inside each."""
    ends = counts.agg(F.min("score").alias("_a"), F.max("score").alias("_b"))
    at = F.coalesce(F.floor(F.try_divide(F.col("score") - F.col("_a"), F.col("_b") - F.col("_a")) * buckets), F.lit(0)).cast("int")
    placed = counts.join(F.broadcast(ends)).withColumn("_k", at)
    sums = placed.groupBy("_k").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    above = Window.orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, -1)  # buckets, not rows
    starts = sums.select("_k", F.coalesce(F.sum("_p").over(above), F.lit(0)).alias("_P"), F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_N"))
    inside = Window.partitionBy("_k").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = placed.withColumns({"P": F.sum("p").over(inside), "N": F.sum("n").over(inside)}).join(F.broadcast(starts), "_k")
    return run.select("score", "p", "n", (F.col("P") + F.col("_P")).alias("cum_p"), (F.col("N") + F.col("_N")).alias("cum_n"))


def roc_auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Area under the ROC curve, ties halved; null with one class only."""
    run = _running(_by_score(df, truth, score))
    # negatives below a score plus half of those at it, for each positive
    row = run.agg(F.sum(F.col("p") * (F.col("cum_n") - F.col("n") / 2.0)).alias("above"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return row.select((1 - F.try_divide(F.col("above"), (F.col("p") * F.col("n")).cast("double"))).alias("roc_auc"), F.col("p").alias("positives"), F.col("n").alias("negatives"))


def average_precision(df: DataFrame, truth: str, score: str) -> DataFrame:
    run = _running(_by_score(df, truth, score))
    row = run.agg(F.sum(F.col("p") * F.try_divide(F.col("cum_p").cast("double"), F.col("cum_p") + F.col("cum_n"))).alias("s"), F.sum("p").alias("p"))
    return row.select(F.try_divide(F.col("s"), F.col("p")).alias("average_precision"))


def class_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(label, support, precision, recall, f1) of each class that occurs as truth or as
    prediction; 0 where a denominator is 0. Rows without a truth don't count."""
    known = df.where(F.col(truth).isNotNull())
    n = known.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = n.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.lit(True).alias("real")), F.struct(F.col("p").alias("label"), F.lit(False).alias("real")))).alias("x"), "n", (F.col("t") == F.col("p")).alias("hit"))
    sums = sides.where("x.label is not null").groupBy("x.label").agg(F.sum(F.when(F.col("x.real"), F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(~F.col("x.real"), F.col("n")).otherwise(0)).alias("given"), F.sum(F.when(F.col("x.real") & F.col("hit"), F.col("n")).otherwise(0)).alias("hits"))
    div = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    s, g, h = F.col("support"), F.col("given"), F.col("hits")
    return sums.select("label", "support", div(h, g).alias("precision"), div(h, s).alias("recall"), div(2 * h, s + g).alias("f1"))


def multiclass_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: rows judged, accuracy, balanced accuracy (mean recall of the classes that
    occur) and macro F1 (over all classes seen)."""
    per = class_metrics(df, truth, predicted)
    n = F.sum("support")
    return per.agg(n.alias("n"), F.try_divide(F.sum(F.col("recall") * F.col("support")), n).alias("accuracy"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"), F.avg("f1").alias("f1_macro"))


def metric_summary(df: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(metric, mean, std, median, q025, q975); the two outer quantiles are the nearest
    value, a half rounding up."""
    long = df.unpivot(list(by), list(metrics), "metric", "value").where("value is not null")
    keys = [*by, "metric"]
    row = long.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    row = join_groups(row, quantiles(long, "value", {"median": 0.5}, keys), keys)
    return join_groups(row, quantiles(long, "value", {"q025": 0.025, "q975": 0.975}, keys, nearest=True), keys)


def preprocessing(numeric: Sequence[str], categorical: Sequence[str]):
    """Median imputation and scaling by the population sd of numbers, one-hot of texts
    with unknown labels kept out."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler

    stages, parts = [], []
    if numeric:
        stages += [Imputer(strategy="median", inputCols=list(numeric), outputCols=[f"{c}_imp" for c in numeric]), VectorAssembler(inputCols=[f"{c}_imp" for c in numeric], outputCol="numeric"), StandardScaler(withMean=True, inputCol="numeric", outputCol="scaled")]
        parts.append("scaled")
    if categorical:
        stages += [StringIndexer(inputCols=list(categorical), outputCols=[f"{c}_ix" for c in categorical], handleInvalid="keep"), OneHotEncoder(inputCols=[f"{c}_ix" for c in categorical], outputCols=[f"{c}_hot" for c in categorical], dropLast=True)]
        parts += [f"{c}_hot" for c in categorical]
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=parts, outputCol="features")])


def nested_cv(df: DataFrame, estimators: dict, label: str, key: str, numeric: Sequence[str], categorical: Sequence[str] = (), outer: int = 5, repeats: int = 1, inner: int = 3, seed: int = 42, multiclass: bool = False) -> DataFrame:
    """(repeat, fold, winner, metrics): in each outer fold the estimator with the best
    balanced accuracy over inner folds is fitted on the rest and judged on the fold.
    ``estimators`` maps a name to an unfitted estimator; ties go to the first name.
    With ``multiclass`` the label has any number of classes and the metrics are those of
    ``multiclass_metrics``."""
    judge = multiclass_metrics if multiclass else binary_metrics

    def judged(train: DataFrame, test: DataFrame, estimator) -> DataFrame:
        ready = preprocessing(numeric, categorical).fit(train)
        model = estimator.copy({estimator.getParam("labelCol"): label, estimator.getParam("featuresCol"): "features"}).fit(ready.transform(train))
        return judge(model.transform(ready.transform(test)), label, "prediction")

    rows = []
    for r in range(repeats):
        folded = stratified_folds(df, label, key, outer, seed + r).withColumnRenamed("fold", "outer_fold").persist()
        for k in range(outer):
            train, test = folded.where(F.col("outer_fold") != k), folded.where(F.col("outer_fold") == k)
            parts = stratified_folds(train, label, key, inner, seed + 1000 * (r + 1) + k).persist()
            means = {}
            for name in sorted(estimators):
                got = [judged(parts.where(F.col("fold") != j), parts.where(F.col("fold") == j), estimators[name]).first()["balanced_accuracy"] for j in range(inner)] if len(estimators) > 1 else [0.0]
                means[name] = sum(got) / len(got)
            parts.unpersist()
            winner = max(sorted(means), key=lambda n: means[n])
            rows.append(judged(train, test, estimators[winner]).select(F.lit(r).alias("repeat"), F.lit(k).alias("fold"), F.lit(winner).alias("winner"), "*").first())
        folded.unpersist()
    return df.sparkSession.createDataFrame(rows)


def nested_cv_multilabel(df: DataFrame, estimators: dict, labels: Sequence[str], key: str, numeric: Sequence[str], categorical: Sequence[str] = (), **how) -> DataFrame:
    """(label, repeat, fold, winner, metrics): one binary run for each label, over the
    rows where it is known."""
    runs = [nested_cv(df.where(F.col(x).isNotNull()).withColumn(x, F.col(x).cast("double")), estimators, x, key, numeric, categorical, **how).select(F.lit(x).alias("label"), "*") for x in labels]
    return reduce(DataFrame.unionByName, runs)


def most_frequent_winner(results: DataFrame) -> DataFrame:
    n = results.groupBy("winner").agg(F.count(F.lit(1)).alias("wins"))
    return n.orderBy(F.desc("wins"), "winner").limit(1)


def places(df: DataFrame, key: str, seed: int, ranges: int, by: Sequence[str] = ()) -> DataFrame:
    """Adds _place, from 0: a row's place in a hashed order of all rows, or of all that are
    alike in ``by``. Rows are put in order inside so many ranges of the hash."""
    h = F.pmod(F.xxhash64(key, *by, F.lit(seed)), F.lit(1 << 40))
    ranged = df.withColumn("_h", h).withColumn("_r", F.shiftright(F.col("_h") * ranges, 40))
    counts = ranged.groupBy(*by, "_r").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(*by).orderBy("_r")) - F.col("_c")  # ranges, not rows
    inside = F.row_number().over(Window.partitionBy(*by, "_r").orderBy("_h", key)) - 1
    placed = ranged.withColumn("_n", inside).join(counts.select(*by, "_r", before.alias("_before")), [*by, "_r"])
    return placed.withColumn("_place", F.col("_before") + F.col("_n")).drop("_h", "_r", "_n", "_before")


def dealt(df: DataFrame, column: str, key: str, seed: int, group_rows: int = 100_000) -> DataFrame:
    """The rows with the column's values dealt over all rows: two hashed orders are paired
    by place, put in order in ranges of about ``group_rows`` rows."""
    ranges = df.count() // group_rows + 1
    right = places(df, key, seed + 2, ranges).select("_place", column)
    return places(df, key, seed + 1, ranges).drop(column).join(right, "_place").drop("_place")


def deals(df: DataFrame, columns: Sequence[str], key: str, repeats: int, seed: int, group_rows: int = 100_000) -> DataFrame:
    """(_feature, _repeat, columns of df): for each of the columns, ``repeats`` times, all
    rows with its values dealt over all rows, in one job."""
    ranges = df.count() // group_rows + 1
    orders = F.explode(F.array(*[F.struct(F.lit(c).alias("_feature"), F.lit(r).alias("_repeat")) for c in columns for r in range(repeats)]))
    sent = df.select(key, F.struct(*columns).alias("_given"), orders.alias("_o")).select(key, "_given", "_o.*")
    given = places(sent, key, seed + 1, ranges, ("_feature", "_repeat")).select("_feature", "_repeat", "_given", "_place")
    new = lambda c: F.when(F.col("_feature") == c, F.col("_given")[c]).otherwise(F.col(c)).alias(c)
    return places(df, key, seed, ranges).join(given, "_place").select("_feature", "_repeat", *[new(c) if c in columns else c for c in df.columns])


def permutation_importance(model, df: DataFrame, columns: Sequence[str], label: str, key: str, seed: int = 42, repeats: int = 10, metric: str = "accuracy") -> DataFrame:
    """(feature, importance, importance_std), the greatest first: the mean fall of a rate of
    ``binary_metrics`` when a column's values are dealt over all rows, and its population
    sd, over ``repeats`` deals. ``df`` are rows that the model was not fitted on."""
    base = binary_metrics(model.transform(df), label, "prediction").first()[metric]
    scored = binary_metrics(model.transform(deals(df, columns, key, repeats, seed)), label, "prediction", ["_feature", "_repeat"])
    fall = F.lit(base) - F.col(metric)
    return scored.groupBy(F.col("_feature").alias("feature")).agg(F.avg(fall).alias("importance"), F.stddev_pop(fall).alias("importance_std")).orderBy(F.desc("importance"), "feature")


def mdi_importance(spark, model, names: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(feature, importance): a tree model's decrease in impurity by input, summed over
    the inputs made from a column. ``names`` are the inputs in the vector's order; an
    input belongs to the longest column name that it starts with, else to itself."""
    weights = model.featureImportances.toArray().tolist()
    if len(weights) != len(names):
        raise ValueError(f"{len(names)} names for {len(weights)} inputs")
    sums = dict.fromkeys(columns, 0.0)
    for name, w in zip(names, weights, strict=True):
        owner = max((c for c in columns if name.startswith(c)), key=len, default=name)
        sums[owner] = sums.get(owner, 0.0) + w
    return spark.createDataFrame(list(sums.items()), "feature string, importance double")


def permutation_test(df: DataFrame, score, label: str, key: str, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """(observed, replicates, at_least, p_value): how often ``score(rows)``, which fits and
    judges a model, is at least as high with labels dealt to other rows. The p-value
    counts the observed order as one of the deals."""
    observed = float(score(df))
    hits = sum(float(score(dealt(df, label, key, seed + 2 * r))) >= observed for r in range(replicates))
    return df.sparkSession.createDataFrame([(observed, replicates, hits, (hits + 1) / (replicates + 1))], "observed double, replicates int, at_least int, p_value double")


def bootstrap_balanced_accuracy(df: DataFrame, truth: str, predicted: str, replicates: int = 5000, seed: int = 42) -> DataFrame:
    """(balanced_accuracy, low, high, n): the 95 % interval of rows drawn with
    replacement. A replicate depends on its four confusion counts alone, which are
    multinomial in the counts of all rows, so rows are read once. Nulls without rows."""
    import numpy as np

    counts = confusion(df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull()), truth, predicted).first()
    cells = np.array([counts[c] for c in ("tn", "fp", "fn", "tp")], np.float64)
    n = int(cells.sum())
    kind = "balanced_accuracy double, low double, high double, n long"
    if n == 0:
        return df.sparkSession.createDataFrame([(None, None, None, 0)], kind)

    def balanced(x: np.ndarray) -> np.ndarray:
        tn, fp, fn, tp = x.T.astype(np.float64)
        pos, neg = tp + fn, tn + fp
        sums = np.divide(tp, pos, out=np.zeros_like(tp), where=pos > 0) + np.divide(tn, neg, out=np.zeros_like(tn), where=neg > 0)
        return sums / ((pos > 0).astype(int) + (neg > 0).astype(int))

    draws = balanced(np.random.default_rng(seed).multinomial(n, cells / n, replicates))
    low, high = np.quantile(draws, [0.025, 0.975])
    return df.sparkSession.createDataFrame([(float(balanced(cells[None, :])[0]), float(low), float(high), n)], kind)


def nearest_rows(df: DataFrame, key: str, features: str, k: int, block_rows: int = 1000) -> DataFrame:
    """(key, near): the keys of the k nearest other rows by Euclidean distance, ties by
    key. Rows are cut into hashed blocks and every pair of blocks is compared by a task of
    its own, which returns the k best of each row; those are merged. Keys are unique."""
    import numpy as np
    import pandas as pd

    blocks = df.count() // block_rows + 1
    rows = df.select(F.col(key).cast("long").alias("_k"), F.col(features).cast("array<double>").alias("_x"), F.pmod(F.xxhash64(F.col(key)), F.lit(blocks)).alias("_b"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    sent = rows.select("_k", "_x", F.col("_b").alias("_i"), every.alias("_j"), F.lit(True).alias("_asks")).unionByName(rows.select("_k", "_x", every.alias("_i"), F.col("_b").alias("_j"), F.lit(False).alias("_asks")))

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        asks, held = pdf[pdf["_asks"]].sort_values("_k"), pdf[~pdf["_asks"]].sort_values("_k")
        if asks.empty or held.empty:
            return pd.DataFrame({"_k": [], "_d": [], "_o": []}).astype({"_k": "int64", "_o": "int64"})
        x, y = (np.stack(s["_x"].to_numpy()).astype(np.float64) for s in (asks, held))
        kx, ky = asks["_k"].to_numpy(), held["_k"].to_numpy()
        out = []
        for a, row in zip(kx, x, strict=True):
            d = ((y - row) ** 2).sum(axis=1)
            d[ky == a] = np.inf
            for o in np.argsort(d, kind="stable")[:k]:
                if np.isfinite(d[o]):
                    out.append((a, d[o], ky[o]))
        return pd.DataFrame(out, columns=["_k", "_d", "_o"]).astype({"_k": "int64", "_d": "float64", "_o": "int64"})

    found = sent.groupBy("_i", "_j").applyInPandas(best, "_k long, _d double, _o long")
    merged = found.groupBy("_k").agg(F.slice(F.array_sort(F.collect_list(F.struct("_d", "_o"))), 1, k).alias("l"))  # k for each block
    return merged.select(F.col("_k").alias(key), F.transform("l", lambda x: x["_o"]).alias("near"))


def smote(df: DataFrame, label: str, key: str, features: str, k: int = 5, threshold: float = 0.3, seed: int = 42) -> DataFrame:
    """Adds synthetic rows of the smallest class up to the largest one's size where its
    share is under the threshold: each lies between a row of it and one of the row's k
    nearest in the whole class. Rows take turns in a hashed order. The key is a unique
    integer; a class of one row is left as it is."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    vector = F.col(features).cast("array<double>")
    given = df.select(label, vector.alias(features), F.lit(False).alias("synthetic"))
    if len(counts) < 2:
        return given
    small, large = min(counts, key=counts.get), max(counts.values())
    if counts[small] / sum(counts.values()) >= threshold or counts[small] < 2:
        return given
    n, total = counts[small], large - counts[small]
    minority = df.where(F.col(label) == small).select(F.col(key).cast("long").alias("_k"), vector.alias("_x"))
    # a row's turn: its place in its hashed group after the rows of the groups before
    groups = n // 10_000 + 1
    turns = minority.withColumn("_g", F.pmod(F.xxhash64("_k", F.lit(seed)), F.lit(groups)))
    sizes = turns.groupBy("_g").agg(F.count(F.lit(1)).alias("_c"))
    before = sizes.select("_g", (F.sum("_c").over(Window.orderBy("_g")) - F.col("_c")).alias("_before"))  # groups, not rows
    turns = turns.withColumn("_n", F.row_number().over(Window.partitionBy("_g").orderBy(F.xxhash64("_k", F.lit(seed + 1)), "_k")) - 1).join(before, "_g")
    copies = F.lit(total // n) + (F.col("_before") + F.col("_n") < total % n).cast("int")
    made = turns.select("_k", "_x", copies.alias("_copies")).where("_copies > 0").select("_k", "_x", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy"))
    near = nearest_rows(minority, "_k", "_x", k)
    draw = lambda s: F.xxhash64("_k", "_copy", F.lit(seed + s))
    picked = made.join(near, "_k").select("_x", F.get("near", F.pmod(draw(2), F.size("near")).cast("int")).alias("_o"), (F.pmod(draw(3), F.lit(1 << 30)) / float(1 << 30)).alias("_u"))
    paired = picked.join(minority.select(F.col("_k").alias("_o"), F.col("_x").alias("_y")), "_o")
    between = F.transform(F.arrays_zip("_x", "_y"), lambda p: p["_x"] + F.col("_u") * (p["_y"] - p["_x"]))
    return given.unionByName(paired.select(F.lit(small).cast(df.schema[label].dataType).alias(label), between.alias(features), F.lit(True).alias("synthetic")))


def any_of(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c), F.lit(False)) for c in columns])
