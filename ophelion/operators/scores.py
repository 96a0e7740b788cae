"""Questionnaire scores, reliability, correlation, contingency and rank tests.

Frames: ``options`` (question_id, option_id, sort_order, weight, text, is_correct),
``answers`` (submission_id, question_id, selected_options array<long>, text_response,
score, ...). Everything is aggregation; wide statistics over items are one pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special
from .quantiles import join_groups, quantiles

#: The scale's items by subscale, and the texts of its four answers.
SUBSCALES = {
    "Brightness": ("Q3", "Q7", "Q9", "Q14", "Q19"),
    "Pattern": ("Q1", "Q5", "Q12", "Q15", "Q20"),
    "Strobing": ("Q2", "Q6", "Q10", "Q16", "Q18"),
    "Intense Visual Environments": ("Q4", "Q8", "Q11", "Q13", "Q17"),
}
ITEMS = tuple(f"Q{i}" for i in range(1, 21))
LIKERT = ("Quase Nunca", "Ocasionalmente", "Frequentemente", "Quase Sempre")


def option_points(options: DataFrame) -> DataFrame:
    """(question_id, option_id, points): the weight, or where it is 0 or missing the
    position among the question's options by sort order and id, from 0."""
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.coalesce("sort_order", F.lit(0)), "option_id")) - 1
    weight = F.coalesce("weight", F.lit(0.0))
    return options.select("question_id", "option_id", F.when(weight != 0, weight).otherwise(place.cast("double")).alias("points"))


def selected(answers: DataFrame) -> DataFrame:
    """One row per selected option with its place in the selection."""
    return answers.select("submission_id", "question_id", F.posexplode("selected_options").alias("place", "option_id"))


def _option_totals(answers: DataFrame, options: DataFrame) -> DataFrame:
    """(submission_id, question_id, n, all, first) of each answered question: how many
    answers it has, the points of all selected known options, and those of the first. One
    aggregation, without a join of the answers with their own totals."""
    each = answers.select("submission_id", "question_id", F.posexplode_outer("selected_options").alias("place", "option_id"))
    rated = each.join(option_points(options), ["question_id", "option_id"], "left")
    once = F.when(F.coalesce("place", F.lit(0)) == 0, 1)
    return rated.groupBy("submission_id", "question_id").agg(F.count(once).alias("n"), F.sum("points").alias("all"), F.min_by("points", F.when(F.col("points").isNotNull(), F.col("place"))).alias("first"))


def score_by_sum(answers: DataFrame, options: DataFrame) -> DataFrame:
    """(submission_id, question_id, points): all selected known options summed."""
    named = F.when(F.col("submission_id").isNotNull(), F.col("all"))
    return _option_totals(answers, options).select("submission_id", "question_id", F.coalesce(named, F.lit(0.0)).alias("points"))


def score_by_type(answers: DataFrame, options: DataFrame, questions: DataFrame) -> DataFrame:
    """As stored on submission: of a single choice the first known option counts, of a
    multiple choice all; free text scores 0. A row for each answer."""
    out = _option_totals(answers, options).join(questions.select("question_id", "question_type"), "question_id")
    points = F.when(F.col("question_type") == "single", F.col("first")).when(F.col("question_type") == "multiple", F.col("all"))
    named = F.when(F.col("submission_id").isNotNull(), points)
    return out.select("submission_id", "question_id", F.explode(F.array_repeat(F.coalesce(named, F.lit(0.0)), F.col("n").cast("int"))).alias("score"))


def scale_scores(scores: DataFrame, items: Sequence[str], subscales: dict[str, Sequence[str]], item: str = "caption", points: str = "points", key: str = "submission_id") -> DataFrame:
    """One row per submission: a column per item (0 where unanswered), a column per
    subscale and global_score. The last answer of an item wins where it occurs twice
    only in so far as the caller has removed the others; here the greatest counts."""
    wide = scores.groupBy(key).agg(*[F.coalesce(F.max(F.when(F.col(item) == i, F.col(points))), F.lit(0)).cast("double").alias(i) for i in items])
    add = lambda names: reduce(lambda a, b: a + b, [F.col(i) for i in names])
    return wide.withColumns({**{n: add(s) for n, s in subscales.items()}, "global_score": add(items)})


def descriptive_stats(df: DataFrame, value: str, by: Sequence[str] = (), digits: int = 2) -> DataFrame:
    """mean, sd (n - 1; 0 for one value), mode (smallest on a tie), median, iqr
    (linear), min, max, n; zeros where there is no value."""
    v = F.col(value).cast("double")
    stats = {
        "mean": F.avg(v),
        "sd": F.stddev_samp(v),
        "min": F.min(v),
        "max": F.max(v),
    }
    row = df.groupBy(*by).agg(*[s.alias(n) for n, s in stats.items()], F.count(v).alias("n"))
    # the mode from counts of distinct values: the most frequent, of those the smallest
    counts = df.select(*by, v.alias("_v")).where("_v is not null").groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c"))
    row = join_groups(row, counts.groupBy(*by).agg(F.max_by("_v", F.struct("_c", -F.col("_v"))).alias("mode")), by, "left")
    row = join_groups(row, quantiles(df, value, {"_q1": 0.25, "median": 0.5, "_q3": 0.75}, by), by, "left")
    row = row.withColumn("iqr", F.col("_q3") - F.col("_q1"))
    return row.select(*by, *[F.round(F.coalesce(F.col(c), F.lit(0.0)), digits).alias(c) for c in ("mean", "sd", "mode", "median", "iqr", "min", "max")], "n")


def cronbach_alpha(wide: DataFrame, items: Sequence[str], digits: int = 4) -> DataFrame:
    """One row with alpha; 0 under two items or rows or where the total is constant."""
    k = len(items)
    total = reduce(lambda a, b: a + b, [F.col(i) for i in items])
    parts = reduce(lambda a, b: a + b, [F.var_samp(i) for i in items])
    alpha = F.lit(0.0) if k < 2 else F.coalesce(F.lit(k / (k - 1)) * (1 - F.try_divide(parts, F.var_samp(total))), F.lit(0.0))
    return wide.agg(F.round(alpha, digits).alias("alpha"), F.count(F.lit(1)).alias("n"))


def interpret_alpha(alpha: Column) -> Column:
    return F.when(alpha >= 0.9, "excellent").when(alpha >= 0.8, "good").when(alpha >= 0.7, "acceptable").when(alpha >= 0.6, "questionable").otherwise("poor")


def average_ranks(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """(by, value, rank): average ranks of tied values. Counts per distinct value are
    summed first, so the window sees distinct values and not rows."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return counts.select(*by, value, (upto - (F.col("_n") - 1) / 2.0).alias("rank"), F.col("_n").alias("tied"))


def spearman(wide: DataFrame, items: Sequence[str], key: str = "submission_id", digits: int = 4, p_values: bool = True) -> DataFrame:
    """(item_a, item_b, rho, n[, p_value]) for each pair of items; null where an item is
    constant."""
    long = wide.unpivot([key], list(items), "item", "value")
    ranked = long.join(average_ranks(long, "value", ["item"]).select("item", "value", "rank"), ["item", "value"])
    ranks = ranked.groupBy(key).agg(*[F.max(F.when(F.col("item") == i, F.col("rank"))).alias(i) for i in items])
    pairs = list(combinations(items, 2))
    row = ranks.agg(F.array(*[F.struct(F.lit(a).alias("item_a"), F.lit(b).alias("item_b"), F.corr(a, b).alias("rho")) for a, b in pairs]).alias("pairs"), F.count(F.lit(1)).alias("n"))
    out = row.select(F.explode("pairs").alias("x"), "n").select("x.item_a", "x.item_b", F.when(~F.isnan("x.rho"), F.col("x.rho")).alias("rho"), "n")
    if p_values:
        out = out.withColumn("p_value", F.round(special.correlation_p("rho", "n"), digits))
    return out.withColumn("rho", F.round("rho", digits))


def crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    """(row, column, n, row_pct) over all pairs of labels, zeros included; nulls don't
    count. Labels are text."""
    pairs = df.select(F.col(row).cast("string").alias("row"), F.col(column).cast("string").alias("column")).where("row is not null and column is not null")
    n = pairs.groupBy("row", "column").agg(F.count(F.lit(1)).alias("n"))
    grid = n.select("row").distinct().crossJoin(n.select("column").distinct())  # labels, not rows
    full = grid.join(n, ["row", "column"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return full.withColumn("row_pct", F.round(F.try_divide(100.0 * F.col("n"), F.sum("n").over(Window.partitionBy("row"))), 1))


def chi_square(table: DataFrame, p_value: bool = True) -> DataFrame:
    """chi_square, degrees_of_freedom and p_value of a crosstab; with Yates' correction
    for 2 x 2 tables; nulls under two rows or columns."""
    everything = Window.partitionBy()
    expected = F.sum("n").over(Window.partitionBy("row")) * F.sum("n").over(Window.partitionBy("column")) / F.sum("n").over(everything)
    sized = table.select("row", "column", "n", expected.cast("double").alias("e"))
    shape = sized.agg(F.countDistinct("row").alias("r"), F.countDistinct("column").alias("c"))
    gap = F.abs(F.col("n") - F.col("e"))
    gap = F.when((F.col("r") == 2) & (F.col("c") == 2), gap - F.least(gap, F.lit(0.5))).otherwise(gap)
    out = sized.join(F.broadcast(shape)).agg(F.sum(F.try_divide(gap * gap, F.col("e"))).alias("x"), F.first("r").alias("r"), F.first("c").alias("c"))
    ok = (F.col("r") >= 2) & (F.col("c") >= 2)
    out = out.select(F.when(ok, F.round("x", 4)).alias("chi_square"), F.when(ok, (F.col("r") - 1) * (F.col("c") - 1)).alias("degrees_of_freedom"), F.when(ok, F.col("x")).alias("_x"))
    if p_value:
        out = out.withColumn("p_value", F.round(special.chi2_p(F.col("_x"), F.col("degrees_of_freedom").cast("double")), 6))
    return out.drop("_x")


def complete_blocks(df: DataFrame, block: str, treatment: str) -> DataFrame:
    """The rows of blocks that hold every treatment once."""
    k_row = df.agg(F.countDistinct(treatment).alias("k"))
    per = df.groupBy(block).agg(F.count(F.lit(1)).alias("_c"), F.countDistinct(treatment).alias("_d"))
    whole = per.join(F.broadcast(k_row)).where("_c = k and _d = k").select(block)
    return df.join(whole, block, "left_semi")


def friedman(df: DataFrame, block: str, treatment: str, value: str, p_value: bool = True) -> DataFrame:
    """Friedman's statistic over blocks that hold every treatment once, with the
    correction for ties; null where it is not defined."""
    full = complete_blocks(df, block, treatment)
    ranks = average_ranks(full, value, [block])
    ranked = full.join(ranks, [block, value])
    ties = ranks.agg(F.sum(F.col("tied") * (F.col("tied") * F.col("tied") - 1)).alias("ties"))
    sums = ranked.groupBy(treatment).agg(F.sum("rank").alias("r"), F.count(F.lit(1)).alias("n"))
    row = sums.agg(F.sum(F.col("r") * F.col("r")).alias("ss"), F.max("n").alias("n"), F.count(F.lit(1)).alias("k")).join(ties)
    k, n = F.col("k"), F.col("n")
    correction = 1 - F.try_divide(F.col("ties"), n * k * (k * k - 1))
    statistic = F.try_divide(F.try_divide(F.lit(12.0) * F.col("ss"), n * k * (k + 1)) - 3 * n * (k + 1), correction)
    out = row.select(statistic.alias("statistic"), n.alias("blocks"), k.alias("treatments"))
    if p_value:
        out = out.withColumn("p_value", special.chi2_p(F.col("statistic"), (F.col("treatments") - 1).cast("double")))
    return out


def nemenyi(df: DataFrame, block: str, treatment: str, value: str) -> DataFrame:
    """(treatment_a, treatment_b, mean_rank_gap, p_value) for each pair, over blocks that
    hold every treatment once."""
    full = complete_blocks(df, block, treatment)
    ranked = full.join(average_ranks(full, value, [block]), [block, value])
    means = ranked.groupBy(treatment).agg(F.avg("rank").alias("m"), F.count(F.lit(1)).alias("n"))
    a = means.select(F.col(treatment).alias("treatment_a"), F.col("m").alias("ma"), "n")
    b = means.select(F.col(treatment).alias("treatment_b"), F.col("m").alias("mb"))
    k = means.agg(F.count(F.lit(1)).alias("k"))
    gap = F.abs(F.col("ma") - F.col("mb"))
    pairs = a.join(b, F.col("treatment_a") < F.col("treatment_b")).join(F.broadcast(k))
    q = gap / F.sqrt(F.col("k") * (F.col("k") + 1) / (6.0 * F.col("n"))) * F.sqrt(F.lit(2.0))
    return pairs.select("treatment_a", "treatment_b", gap.alias("mean_rank_gap"), special.range_p(q, F.col("k").cast("double")).alias("p_value"))


def bootstrap_mean(df: DataFrame, value: str, by: Sequence[str], replicates: int = 1000, seed: int = 42, key: Sequence[str] = ()) -> DataFrame:
    """mean, low and high (2.5 % and 97.5 %) of bootstrapped means. Each row enters each
    replicate a Poisson(1) number of times, so nothing is collected; draws depend on
    the seed, the replicate and the row's ``key`` alone. Without a key all columns are
    it, and equal rows then get equal draws: give one where rows repeat."""
    draws = df.select(*by, F.col(value).cast("double").alias("v"), F.xxhash64(*(key or df.columns), F.lit(seed)).alias("h"), F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep"))
    u = (F.pmod(F.xxhash64("h", "rep"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    # inverse of the Poisson(1) distribution function, to the last step that a double shows
    steps, total, term = [], 0.0, 0.36787944117144233
    for j in range(17):
        total += term
        steps.append(total)
        term /= j + 1
    times = reduce(lambda a, b: a + b, [(u > s).cast("int") for s in steps])
    means = draws.withColumn("w", times).groupBy(*by, "rep").agg(F.try_divide(F.sum(F.col("v") * F.col("w")), F.sum("w")).alias("m"))
    out = means.groupBy(*by).agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    return out.join(df.groupBy(*by).agg(F.avg(F.col(value).cast("double")).alias("mean")), list(by))


def statistics_report(df: DataFrame, block: str, treatment: str, metrics: Sequence[str], replicates: int = 1000) -> DataFrame:
    """(metric, test, treatment_a, treatment_b, statistic, p_value, low, high): for each
    metric Friedman's test, Nemenyi's test of each pair (the statistic is the gap of mean
    ranks) and the mean of each treatment with its bootstrap interval. Metrics that the
    table lacks are left out."""
    names = ("metric", "test", "treatment_a", "treatment_b", "statistic", "p_value", "low", "high")
    kinds = ("string", "string", "string", "string", "double", "double", "double", "double")

    def shaped(rows: DataFrame, metric: str, test: str, **values: str) -> DataFrame:
        given = {"metric": F.lit(metric), "test": F.lit(test)} | {k: F.col(v) for k, v in values.items()}
        return rows.select(*(given.get(n, F.lit(None)).cast(k).alias(n) for n, k in zip(names, kinds, strict=True)))

    parts = []
    for m in (m for m in metrics if m in df.columns):
        rows = df.select(block, treatment, F.col(m).cast("double").alias("value")).where("value is not null")
        parts.append(shaped(friedman(rows, block, treatment, "value"), m, "friedman", statistic="statistic", p_value="p_value"))
        parts.append(shaped(nemenyi(rows, block, treatment, "value"), m, "nemenyi", treatment_a="treatment_a", treatment_b="treatment_b", statistic="mean_rank_gap", p_value="p_value"))
        parts.append(shaped(bootstrap_mean(rows, "value", [treatment], replicates, key=[block, treatment]), m, "bootstrap_mean", treatment_a=treatment, statistic="mean", low="low", high="high"))
    if not parts:
        raise ValueError("none of the metrics is a column")
    return reduce(DataFrame.unionByName, parts)
