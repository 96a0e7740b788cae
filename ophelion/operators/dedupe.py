"""Ordered deduplication, audits and set comparisons.

Order is always a column given by the caller; a table has no order of its own. Each
function is one hash aggregation or one window over its key, both spread by key;
``first_rows`` uses an aggregation, which combines a hot key before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import blank_to_null


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key. ``order`` must be a total order within a key."""
    row = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in df.columns if c not in order])
    return df.groupBy(*keys).agg(F.min(row).alias("_row")).select(*[F.col(f"_row.{c}").alias(c) for c in df.columns])


def last_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    row = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in df.columns if c not in order])
    return df.groupBy(*keys).agg(F.max(row).alias("_row")).select(*[F.col(f"_row.{c}").alias(c) for c in df.columns])


def removed_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows after the first of their key, for the log of a deduplication."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where("_n > 1").drop("_n")


def best_rows(df: DataFrame, key: str, order: Sequence[Column], row_id: str) -> DataFrame:
    """The best row of each non-blank key; rows with a blank key all stay."""
    own = F.coalesce(blank_to_null(F.col(key)), F.concat(F.lit("\x00"), F.col(row_id).cast("string")))
    n = F.row_number().over(Window.partitionBy(own).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def first_non_blank(df: DataFrame, keys: Sequence[str], columns: Sequence[str], order: str) -> DataFrame:
    """For each key the first non-blank value of every column."""
    return df.groupBy(*keys).agg(*[F.min_by(blank_to_null(F.col(c)), F.when(blank_to_null(F.col(c)).isNotNull(), F.col(order))).alias(c) for c in columns])


def occurrence_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences"))


def with_occurrences(ids: DataFrame, df: DataFrame, key: str, to: str) -> DataFrame:
    """Adds how often each id occurs in another table, 0 where it doesn't."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias(to))
    return ids.join(counts, key, "left").withColumn(to, F.coalesce(to, F.lit(0).cast("long")))


def id_set(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).where(F.col(key).isNotNull()).distinct()


def presence(left: DataFrame, right: DataFrame, key: str, names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """(key, in_<left>, in_<right>, presence) over the distinct ids of both tables."""
    a = id_set(left, key).withColumn("_a", F.lit(True))
    b = id_set(right, key).withColumn("_b", F.lit(True))
    both = a.join(b, key, "full_outer")
    in_a, in_b = F.coalesce("_a", F.lit(False)), F.coalesce("_b", F.lit(False))
    kind = F.when(in_a & in_b, "both").when(in_a, f"only_{names[0]}").otherwise(f"only_{names[1]}")
    return both.select(key, in_a.alias(f"in_{names[0]}"), in_b.alias(f"in_{names[1]}"), kind.alias("presence"))


def presence_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("presence").agg(F.count(F.lit(1)).alias("ids"))


def before_after(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Row and distinct-id counts of both tables and whether the ids are preserved."""
    count = lambda df, n: df.agg(F.count(F.lit(1)).alias(f"rows_{n}"), F.countDistinct(key).alias(f"ids_{n}"))
    return count(before, "before").join(count(after, "after")).withColumn("ids_preserved", F.col("ids_before") == F.col("ids_after"))


def changed_ids(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Ids that were removed or added."""
    return presence(before, after, key, ("before", "after")).where("presence <> 'both'").select(key, F.when(F.col("presence") == "only_before", "removed").otherwise("added").alias("change"))


def coverage(bases: dict[str, DataFrame], key: str) -> DataFrame:
    """For every id of any base a flag per base and the number of bases that hold it."""
    flagged = [id_set(df, key).select(key, F.lit(n).alias("_base")) for n, df in bases.items()]
    union = reduce(DataFrame.unionByName, flagged)
    flags = [F.max(F.when(F.col("_base") == n, True).otherwise(False)).alias(f"in_{n}") for n in bases]
    return union.groupBy(key).agg(*flags, F.count(F.lit(1)).alias("bases"))


def purge_orphans(df: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Rows whose id is allowed or null: a null id is no orphan."""
    orphans = df.select(key).where(F.col(key).isNotNull()).join(allowed.select(key), key, "left_anti").distinct()
    return df.join(orphans, key, "left_anti")


def purge_log(df: DataFrame, allowed: DataFrame, key: str, context: Sequence[str], order: str) -> DataFrame:
    """One row per purged id: rows removed and the context of its first row. Not cut
    off at any number of ids, so it never undercounts."""
    orphans = df.where(F.col(key).isNotNull()).join(allowed.select(key), key, "left_anti")
    return orphans.groupBy(key).agg(F.count(F.lit(1)).alias("rows_removed"), *[F.min_by(c, order).alias(c) for c in context])


def union_relaxed(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns missing in one frame are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def common_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return id_set(a, key).intersect(id_set(b, key))


def sorted_distinct(df: DataFrame, column: str) -> DataFrame:
    return id_set(df, column).orderBy(column)


def unknown_sex_audit(df: DataFrame, key: str, sex: str = "sexo") -> tuple[DataFrame, DataFrame]:
    """(frame with unknown sexes as null, the ids that had one)."""
    known = F.lower(F.trim(F.col(sex))).isin("masculino", "m", "male", "feminino", "f", "female")
    unknown = ~F.coalesce(known, F.lit(False))
    return df.withColumn(sex, F.when(known, F.col(sex))), df.where(unknown).select(key, sex)


def ambiguous_dims(df: DataFrame, keys: Sequence[str], dims: Sequence[str]) -> DataFrame:
    """Keys with more than one value in a dimension. Run before any deduplication."""
    counts = df.groupBy(*keys).agg(*[F.countDistinct(d).alias(d) for d in dims])
    return counts.where(reduce(lambda a, b: a | b, [F.col(d) > 1 for d in dims]))
