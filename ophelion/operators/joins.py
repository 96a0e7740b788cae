"""Joins with the reference's fallbacks, and the pseudonym tables.

Lookup sides are plain joins: adaptive execution broadcasts them where they are
small. Theta joins are blocked into equi-joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import blank_to_null, canonical_id


def left_prefer(df: DataFrame, other: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Left join where a blank value of ours gives way to theirs."""
    theirs = other.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    own = {c: F.coalesce(blank_to_null(F.col(c)) if c in df.columns else F.lit(None), F.col(f"_{c}")) for c in columns}
    return df.join(theirs, key, "left").withColumns(own).drop(*[f"_{c}" for c in columns])


def left_fill(df: DataFrame, other: DataFrame, key: str, column: str, fill: str = "Unknown") -> DataFrame:
    return df.join(other.select(key, column), key, "left").withColumn(column, F.coalesce(column, F.lit(fill)))


def join_label(df: DataFrame, labels: DataFrame, key: str, label: str, order: str) -> DataFrame:
    """Left join of one label per key, the first by ``order``."""
    one = labels.groupBy(key).agg(F.min_by(label, order).alias(label))
    return df.join(one, key, "left")


def map_ids(df: DataFrame, mapping: DataFrame, key: str, hashed: str, keep_raw: bool = False) -> DataFrame:
    """Replaces ids by their pseudonyms. An id without one becomes null, so that no raw
    id leaves; ``keep_raw`` leaves it as it is."""
    table = mapping.select(F.col(key).alias("_key"), F.col(hashed).alias("_hashed"))
    out = df.join(table, F.col(key) == F.col("_key"), "left")
    return out.withColumn(key, F.coalesce("_hashed", key) if keep_raw else F.col("_hashed")).drop("_key", "_hashed")


def missing_ids(df: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    return df.select(key).where(F.col(key).isNotNull()).distinct().join(mapping.select(key), key, "left_anti")


def hash_id(value: Column, salt: str) -> Column:
    """Salted sha-256 of an id; blank ids stay blank."""
    text = blank_to_null(value)
    return F.when(text.isNull(), F.lit("")).otherwise(F.sha2(F.concat(F.lit(salt), text).cast("binary"), 256))


def hash_mapping(df: DataFrame, key: str, salt: str, canonical: bool = False) -> DataFrame:
    """(key, key_hashed), one row per non-blank id."""
    own = canonical_id(F.col(key)) if canonical else blank_to_null(F.col(key))
    ids = df.select(own.alias(key)).where(blank_to_null(F.col(key)).isNotNull()).distinct()
    return ids.withColumn(f"{key}_hashed", hash_id(F.col(key), salt))


def anonymise(df: DataFrame, mapping: DataFrame, key: str, identity: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with a pseudonym and without identity columns, one row of audit counts)."""
    mapped = map_ids(df, mapping, key, f"{key}_hashed")
    kept = mapped.where(F.col(key).isNotNull()).drop(*identity)
    audit = mapped.agg(F.count(F.lit(1)).alias("rows_in"), F.count(key).alias("rows_out"), F.countDistinct(key).alias("ids_out"))
    return kept, audit.withColumn("rows_dropped", F.col("rows_in") - F.col("rows_out"))


def enrich(mapping: DataFrame, annotations: DataFrame, key: str, text: Sequence[str], other: Sequence[str] = ()) -> DataFrame:
    """Left join of annotations; missing text becomes ''."""
    out = mapping.join(annotations.select(key, *text, *other), key, "left")
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in text})


def year_range_join(people: DataFrame, ranges: DataFrame, year: str, low: str, high: str) -> DataFrame:
    """Rows with low <= year <= high. The short range becomes one row per year, so
    this is an equi-join."""
    years = ranges.withColumn(year, F.explode(F.sequence(low, high)))
    return people.join(years, year)


def prefix_join(queries: DataFrame, names: DataFrame, query: str, name: str, order: str, block: int = 2) -> DataFrame:
    """For each query the first name (by ``order``) of which one is a prefix of the
    other, an exact match first; blocked on the first ``block`` letters. Names shorter
    than that are joined on their own prefix block."""
    q = queries.where(F.length(query) > 0)
    sizes = F.array(*[F.lit(k) for k in range(1, block + 1)])
    # a text stands under its first `block` letters; a shorter one under all of its own
    tagged = lambda df, c: df.withColumn("_block", F.explode(F.array_distinct(F.transform(sizes, lambda k: F.substring(F.col(c), F.lit(1), k)))))
    n = names.where(F.length(name) > 0).select(name, order)
    short = lambda c: F.least(F.length(c), F.lit(block))
    hit = tagged(q, query).join(tagged(n, name), "_block").where(F.length("_block") == F.least(short(query), short(name)))
    hit = hit.where(F.startswith(F.col(query), F.col(name)) | F.startswith(F.col(name), F.col(query)))
    exact = F.col(query) == F.col(name)
    best = hit.groupBy(query).agg(F.min_by(F.struct(F.col(name), F.when(exact, "name_exact").otherwise("name_prefix").alias("method")), F.struct((~exact).cast("int"), F.col(order))).alias("_m"))
    return queries.join(best.select(query, F.col(f"_m.{name}").alias("matched"), F.col("_m.method")), query, "left").withColumn("method", F.coalesce("method", F.lit("not_found")))


def cascade_match(df: DataFrame, steps: Sequence[tuple[str, DataFrame, Column, str, str]], row_id: str) -> DataFrame:
    """Tries lookups in order. A step is (method, table, our key, their key, value);
    the first that finds a value gives ``matched`` and ``match_method``."""
    out = df
    value, method = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (name, table, ours, theirs, got) in enumerate(steps):
        one = table.where(F.col(theirs).isNotNull()).groupBy(F.col(theirs).alias(f"_k{k}")).agg(F.min(got).alias(f"_v{k}"))
        out = out.withColumn(f"_o{k}", ours).join(one, F.col(f"_o{k}") == F.col(f"_k{k}"), "left")
        found = F.col(f"_v{k}").cast("string")
        method = F.coalesce(method, F.when(found.isNotNull(), name))
        value = F.coalesce(value, found)
    made = out.withColumns({"matched": value, "match_method": F.coalesce(method, F.lit("not_found"))})
    return made.select(*df.columns, "matched", "match_method")


def soft_filter(df: DataFrame, keys: Sequence[str], condition: Column) -> DataFrame:
    """Keeps the rows of a key that satisfy the condition, or all if none does."""
    ok = F.coalesce(condition, F.lit(False))
    any_ok = F.max(ok).over(Window.partitionBy(*keys))
    return df.withColumns({"_ok": ok, "_any": any_ok}).where("_ok or not _any").drop("_ok", "_any")


def dims_once(df: DataFrame, keys: Sequence[str], dims: Sequence[str], order: str) -> DataFrame:
    """One row of dimensions per non-null key, keys as text, the first by ``order``."""
    out = df.dropna(subset=list(keys)).groupBy(*[F.col(k).cast("string").alias(k) for k in keys])
    return out.agg(*[F.min_by(d, order).alias(d) for d in dims])
