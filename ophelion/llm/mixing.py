"""Mixing sources to target weights, with DataFrame operations only.

Every document gets a hash-random key. Within its source the documents are ranged by
that key: the first three hex digits of the key are 4096 ranges of equal width, so a
source of any size is spread over them evenly, and a hot source is no hot task. The
prefix sum of sizes is the sum of the ranges before (a small table) plus a running
sum inside the range. Each source is then cut at its exact budget; a budget over the
source's size repeats whole epochs first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._base import staged, word_count

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    The k-th source by code point, null last, weighs ``weights[k % len]``. All
    targets add up to all sizes; none exceeds ``max_epochs`` times its source, the
    excess going to the others by weight. This is one level: target =
    min(weight * level, cap). With sources sorted by cap / weight, the level is
    found where the first source is not full at it. The windows run over the table
    of sources only.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.select(
        "source",
        "source_size",
        F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).alias("w"),
        (F.col("source_size") * max_epochs).alias("cap"),
    )
    full_first = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = full_first.rowsBetween(Window.unboundedPreceding, -1)
    after = full_first.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    levels = ranked.select(
        "*",
        (
            (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
            / F.sum("w").over(after)
        ).alias("level"),
    )
    # the first source that is not filled by the level holds for all from there on
    chosen = levels.select("*", F.min(F.when(F.col("cap") >= F.col("w") * F.col("level"), F.struct((F.col("cap") / F.col("w")).alias("r"), F.col("level").alias("level")))).over(everything)["level"].alias("at"))
    return chosen.select(
        "source",
        "source_size",
        F.when(F.col("at").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("w") * F.col("at"), F.col("cap").cast("double"))).alias("target"),
    )


def mix_sources(docs: DataFrame, seed: str = "mix", weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, taken, and a
    struct ``kept`` with the ``keep`` columns of the same row where any are asked for.

    size counts words of the text (null: 0). Documents are taken whole in the order
    of their keys up to the source's budget, the last one in part, so that the taken
    words of a source are floor(target). Reruns agree: keys depend on doc_id, text and
    ``seed`` alone, so rows without an id or with the same one are spread over the
    ranges by their texts, each with its own size and taken words; equal rows are
    interchangeable. Null sources are one source, null doc_ids and texts count as ''.
    A source without words gets target 0, an empty table no rows. Extra columns are
    ignored.
    """
    text = docs["text"].cast("string")
    name = F.concat_ws("/", F.coalesce(docs["doc_id"].cast("long").cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary")), F.lit(seed))
    sized = staged(
        docs.select(
            docs["doc_id"].cast("long").alias("doc_id"),
            docs["source"].cast("string").alias("source"),
            # never null: one expression partitions the windows and the join below
            F.coalesce(F.concat(F.lit("="), docs["source"].cast("string")), F.lit("")).alias("src"),
            word_count(text).alias("size"),
            F.md5(name.cast("binary")).alias("key"),
            *([F.struct(*(docs[c] for c in keep)).alias("kept")] if keep else []),
        ),
        "sized",
    )
    kept = ["d.kept"] if keep else []
    keyed = sized.withColumn("range", F.substring("key", 1, 3))
    ranges = staged(keyed.groupBy("source", "src", "range").agg(F.sum("size").alias("range_size")), "ranges")
    targets = source_targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, max_epochs)
    before = Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # 4096 rows a source at most
    starts = (
        ranges.select("source", "src", "range", F.coalesce(F.sum("range_size").over(before), F.lit(0)).alias("start"))
        .alias("r")
        .join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
        .select("r.src", "r.range", "r.start", "t.source_size", "t.target")
    )
    inside = Window.partitionBy("src", "range").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        keyed.withColumn("upto", F.sum("size").over(inside))
        .alias("d")
        .join(starts.alias("s"), (F.col("d.src") == F.col("s.src")) & (F.col("d.range") == F.col("s.range")))
        .select("d.doc_id", "d.size", "d.source", "s.source_size", "s.target", (F.col("s.start") + F.col("d.upto") - F.col("d.size")).alias("at"), *kept)
    )
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("CAST(floor(target) AS BIGINT) DIV source_size")).otherwise(F.lit(0).cast("long"))
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("at")))
    return placed.select("doc_id", "size", "source", "source_size", "target", taken.cast("long").alias("taken"), *(["kept"] if keep else []))


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


def mix_sql(documents: str = "documents") -> str:
    """The same rows as op5_mixing in DuckDB SQL, with source added for later stages."""
    return f"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/' || md5(coalesce(text, '')) || '/mix') AS key
  FROM {documents}),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT source, source_size, 3 * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN CAST(5 AS DOUBLE) WHEN 1 THEN CAST(2 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS w
  FROM sources),
levels AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked),
lowest AS (SELECT level AS at_level FROM levels WHERE cap >= w * level ORDER BY cap / w, level LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN at_level IS NULL THEN CAST(cap AS DOUBLE) ELSE least(w * at_level, CAST(cap AS DOUBLE)) END AS target
  FROM levels LEFT JOIN lowest ON true),
placed AS (
  SELECT s.doc_id, s.size, s.source, t.source_size, t.target,
         CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size AS BIGINT) AS before_it,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target) AS BIGINT) // t.source_size ELSE 0 END AS epochs
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source, source_size, target,
       CAST(epochs * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * source_size - before_it)) AS BIGINT) AS taken
FROM placed
"""


OP5_SQL = f"SELECT doc_id, size, source_size, target, taken FROM ({mix_sql()})"
