"""Exact quantiles of large groups, without a sort or a buffer of whole groups.

A mergeable sketch brackets each wanted place by two values; what lies below the bracket
is counted and only the distinct values inside it (some 0.04 % of the rows) are put in
order. The sketch's rank error is at most 1 / ACCURACY, so the place is always inside.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000


def join_groups(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """``left`` with the row of its group, null groups included."""
    if not by:
        return left.crossJoin(F.broadcast(right))  # one row
    named = right.withColumnsRenamed({c: f"_by_{c}" for c in by})
    on = [left[c].eqNullSafe(named[f"_by_{c}"]) for c in by]
    return left.join(named, on, how).drop(*(f"_by_{c}" for c in by))


def values_at(df: DataFrame, value: str, places: dict[str, tuple[float, Column]], by: Sequence[str] = ()) -> DataFrame:
    """(by, a column per place) with the value that stands at each place of the sorted
    non-null values of a group. A place is its share of the group (0 to 1) and its
    position from 0 as an expression over ``_n``, the group's size, which may differ from
    the share by one or two rows. Values are doubles. Groups without a value are absent
    (without ``by``: a row of nulls)."""
    by = list(by)
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null")
    step = 2 / ACCURACY
    ends = [(max(0.0, q - step), min(1.0, q + step)) for q, _ in places.values()]
    cuts = F.percentile_approx("_v", [x for pair in ends for x in pair], ACCURACY)
    # in groups under ACCURACY rows the sketch holds every value and may be a few ranks off
    least, most = F.min("_v"), F.max("_v")
    small = F.count(F.lit(1)) < ACCURACY
    bracket = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"),
        *(F.when(small, least).otherwise(cuts[2 * i]).alias(f"_lo{i}") for i in range(len(places))),
        *(F.when(small, most).otherwise(cuts[2 * i + 1]).alias(f"_hi{i}") for i in range(len(places))),
    )
    joined = join_groups(rows, bracket, by)
    below = joined.groupBy(*by).agg(F.first("_n").alias("_n"), *(F.count_if(F.col("_v") < F.col(f"_lo{i}")).alias(f"_below{i}") for i in range(len(places))))
    inside = F.array_compact(F.array(*(F.when(F.col("_v").between(F.col(f"_lo{i}"), F.col(f"_hi{i}")), F.lit(i)) for i in range(len(places)))))
    counts = joined.select(*by, "_v", F.explode(inside).alias("_i")).groupBy(*by, "_i", "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*by, "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = join_groups(counts.withColumn("_u", upto), below, by)
    found = [F.min(F.when((F.col("_i") == i) & (F.col(f"_below{i}") + F.col("_u") > at), F.col("_v"))).alias(name) for i, (name, (_, at)) in enumerate(places.items())]
    return ranked.groupBy(*by).agg(*found)


def quantiles(df: DataFrame, value: str, shares: dict[str, float], by: Sequence[str] = (), nearest: bool = False) -> DataFrame:
    """(by, a column per share): interpolated between neighbours, or the nearest value
    (a half rounds up)."""
    places = {}
    for name, q in shares.items():
        at = F.lit(q) * (F.col("_n") - 1)
        if nearest:
            places[name] = (q, F.round(at))
        else:
            places |= {f"{name}_lower": (q, F.floor(at)), f"{name}_upper": (q, F.ceil(at))}
    if nearest:
        return values_at(df, value, places, by)
    rows = df.where(F.col(value).cast("double").isNotNull())
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
    found = join_groups(values_at(df, value, places, by), sizes, list(by))
    out = []
    for name, q in shares.items():
        at = F.lit(q) * (F.col("_size") - 1)
        low, high = F.col(f"{name}_lower"), F.col(f"{name}_upper")
        out.append((low + (high - low) * (at - F.floor(at))).alias(name))
    return found.select(*by, *out)
