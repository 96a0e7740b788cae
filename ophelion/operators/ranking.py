"""Normalisation and ranking of models by metrics.

Minima and maxima are one global aggregate joined back as one row, not a window over
the whole table in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged
from .clean import available, is_numeric
from .quantiles import join_groups

#: Metrics by direction, looked up as parts of a column's name.
BETTER_HIGHER = ("flesch_reading_ease", "gulpease_index", "bertscore", "comet", "score", "accuracy", "precision", "recall", "f1")
BETTER_LOWER = ("flesch_kincaid_grade_level", "gunning_fog_index", "automated_readability_index", "coleman_liau_index", "final_readability_score", "error", "loss", "perplexity")


def direction(column: str, strict: bool = False) -> str:
    """'higher' or 'lower'. The higher list is looked at first, so
    final_readability_score counts as higher through its part 'score'; ``strict``
    takes whole names first."""
    name = column.lower()
    if strict and name in BETTER_LOWER:
        return "lower"
    if any(m in name for m in BETTER_HIGHER):
        return "higher"
    return "lower" if any(m in name for m in BETTER_LOWER) else "higher"


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if is_numeric(df, c)]


def normalise(df: DataFrame, columns: Sequence[str], strict: bool = False) -> DataFrame:
    """Adds <column>_norm in 0..1, best 1; 0.5 where the column is constant."""
    ends = df.agg(*[f(c).alias(f"_{f.__name__}_{c}") for c in columns for f in (F.min, F.max)])
    out = df.join(F.broadcast(ends))  # one row
    for c in columns:
        low, high = F.col(f"_min_{c}"), F.col(f"_max_{c}")
        share = F.try_divide(F.col(c) - low, high - low)
        value = share if direction(c, strict) == "higher" else 1 - share
        out = out.withColumn(f"{c}_norm", F.when(high == low, F.lit(0.5)).otherwise(value))
    return out.drop(*ends.columns)


def row_mean(columns: Sequence[str]):
    """Mean over the non-null columns of a row."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in columns), F.lit(0.0))
    n = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    return F.try_divide(total, n)


def rank_by_average(df: DataFrame, strict: bool = False) -> DataFrame:
    """All numeric columns normalised, their mean as final_score, best first."""
    columns = numeric_columns(df)
    out = normalise(df, columns, strict)
    return out.withColumn("final_score", row_mean([f"{c}_norm" for c in columns])).orderBy(F.desc("final_score"))


def rank_each(df: DataFrame, columns: Sequence[str], model: str = "model_id", top: int = 5, strict: bool = False) -> DataFrame:
    """(metric, rank, model, value): the best ``top`` models of each metric."""
    found = available(df, columns)
    if not found:
        raise ValueError("none of the metrics exists")
    long = df.unpivot([model], [F.col(c).cast("double").alias(c) for c in found], "metric", "value").where("value is not null")
    up = F.when(F.col("metric").isin(*[c for c in found if direction(c, strict) == "lower"]), F.col("value")).otherwise(-F.col("value"))
    rank = F.row_number().over(Window.partitionBy("metric").orderBy(up, model))
    return long.withColumn("rank", rank).where(F.col("rank") <= top).select("metric", "rank", model, "value")


def rank_by_selected(df: DataFrame, columns: Sequence[str], strict: bool = False) -> DataFrame:
    """final_score is the mean of the raw selected columns, best first; normalised
    columns are added for information. A missing column is an error."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}")
    return normalise(df, columns, strict).withColumn("final_score", row_mean(columns)).orderBy(F.desc("final_score"))


def page(df: DataFrame, order: Sequence, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of a sorted table."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_count(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence, n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def every_kth(df: DataFrame, keys: Sequence[str], order: Sequence, step: int) -> DataFrame:
    """The first row of each key and every ``step``-th after it."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where((F.col("_n") - 1) % step == 0).drop("_n")


def places(df: DataFrame, keys: Sequence[str], order: Sequence[str], to: str = "place") -> DataFrame:
    """``df`` with the place of each row in its group, from 1, as ``row_number`` gives it,
    but a group may hold any share of the rows: they are sorted by ranges of keys and
    order, numbered in each range, and moved on by the counts of the ranges before.
    ``order`` names columns, ascending, nulls first; rows equal in all of them come in any
    order. Null keys are one group, an empty table stays empty."""
    ranges = df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    ranges = staged(ranges, "ranges")  # ranges stay as they are, whoever reads them again
    here = [*keys, "_range"]
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.groupBy(*here).agg(F.count(F.lit(1)).alias("_c")).withColumn("_start", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    numbered = ranges.withColumn("_n", F.row_number().over(Window.partitionBy(*here).orderBy(*order)))
    return join_groups(numbered, starts.drop("_c"), here).withColumn(to, F.col("_start") + F.col("_n")).drop("_range", "_start", "_n")


def shuffled(df: DataFrame, seed: int, key: str) -> DataFrame:
    """A random order that a seed fixes."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)))


def first_ids(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The first ``n`` distinct ids in file order."""
    return df.groupBy(key).agg(F.min(order).alias("_at")).orderBy("_at").limit(n).select(key)
