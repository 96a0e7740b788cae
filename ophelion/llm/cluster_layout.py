"""Multidimensional clustered layout: rows in Z-order of four ranked values, files of a
fixed number of rows with their bounds, and how many files a box query opens.

Ranks come from value counts, put in order by ranges with prefix sums. At most 16
values a dimension start a coordinate; those bounds (64 rows) become literals, so that
coordinates are a projection and no hot value is a join key. Positions are a range
sort with prefix sums over its partitions.

A file is an interval of positions and a cell (four coordinates) is one too, so either a
file lies in one cell or a cell ends in it: there are at most 2 * 16**4 different boxes,
and the files of a cell are an interval. Files are therefore counted as boxes with
numbers and as intervals; a hot cell is one row of either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._base import staged

ROWS_PER_FILE, BITS, REACH, DAYS = 500, 4, 2, 365
#: Dimensions by the order of file_bounds, and by their turns in z.
DIMENSIONS, TURNS = ("source", "lang", "length", "date"), ("length", "source", "date", "lang")


def _text(value: Column) -> Column:
    """A string that orders as the value does by UTF-8 bytes, null smallest."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def values_of(docs: DataFrame) -> dict[str, Column]:
    """The four values of a document; none is null."""
    name = F.coalesce(docs["doc_id"].cast("long").cast("string"), F.lit(""))
    return {
        "source": _text(docs["source"]),
        "lang": _text(docs["lang"]),
        "length": F.coalesce(F.octet_length(docs["text"].cast("string")), F.lit(-1)).cast("long"),
        "date": (F.crc32(name.cast("binary")) % DAYS).cast("long"),
    }


def _before(parts: DataFrame, size: str) -> DataFrame:
    """(part, before): what the partitions before each hold; as many rows as partitions."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("part", F.coalesce(F.sum(size).over(before), F.lit(0)).alias("before"))


def first_values(rows: DataFrame, side: int) -> dict[str, list[tuple[int, object]]]:
    """For each dimension (coordinate, its smallest value), at most ``side`` entries; the
    coordinate of a value is floor(side * smaller rows / rows)."""
    texts = {"source", "lang"}
    each = [F.struct(F.lit(k).alias("kind"), (F.col(d) if d in texts else F.lit("")).alias("name"), (F.lit(0).cast("long") if d in texts else F.col(d)).alias("number")) for k, d in enumerate(DIMENSIONS)]
    order = ("kind", "name", "number")
    counts = rows.select(F.explode(F.array(*each)).alias("v")).groupBy(*(F.col(f"v.{c}").alias(c) for c in order)).agg(F.count(F.lit(1)).alias("n"))
    ranged = staged(counts.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "values")
    parts = ranged.groupBy("part").agg(F.sum("n").alias("n"))
    here = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    total = parts.agg((F.sum("n") / len(DIMENSIONS)).cast("long")).first()[0] or 1
    # every dimension has all rows, so the ones before it hold kind * total
    smaller = F.col("before") + F.coalesce(F.sum("n").over(here), F.lit(0)) - F.col("kind") * F.lit(total)
    ranked = ranged.join(F.broadcast(_before(parts, "n")), "part").select(*order, (smaller * side).alias("scaled"))
    firsts = ranked.groupBy("kind", F.expr(f"scaled div {total}").alias("coordinate")).agg(F.min("name").alias("name"), F.min("number").alias("number"))
    out: dict[str, list[tuple[int, object]]] = {d: [] for d in DIMENSIONS}
    for r in firsts.collect():  # at most len(DIMENSIONS) * side rows
        d = DIMENSIONS[r["kind"]]
        out[d].append((r["coordinate"], r["name"] if d in texts else r["number"]))
    return {d: sorted(v) for d, v in out.items()}


def coordinate(value: Column, firsts: list[tuple[int, object]]) -> Column:
    found = F.lit(0)
    for k, first in firsts:
        found = F.when(value >= F.lit(first), F.lit(k)).otherwise(found)
    return found.cast("int")


def interleave(coordinates: dict[str, Column], bits: int) -> Column:
    z = F.lit(0).cast("long")
    for b in reversed(range(bits)):
        for d in TURNS:
            z = z * 2 + F.shiftright(coordinates[d], b).bitwiseAND(F.lit(1))
    return z


def place(docs: DataFrame, rows_per_file: int = ROWS_PER_FILE, bits: int = BITS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, z, the four coordinates, position, file, and a
    struct ``kept`` with the ``keep`` columns where any are asked for.

    Rows that share z and doc_id (repeated rows, null ids, which come first) have the
    same coordinates; their positions among each other are arbitrary, and a random salt
    lets the range sort split them. The written ranks and places are what later steps
    read, so a rerun of a task changes nothing.
    """
    values = values_of(docs)
    kept = [F.struct(*(docs[c] for c in keep)).alias("kept")] if keep else []
    narrow = staged(docs.select(docs["doc_id"].cast("long").alias("doc_id"), *(v.alias(d) for d, v in values.items()), F.rand(13).alias("salt"), *kept), "rows")
    firsts = first_values(narrow, 1 << bits)
    at = {d: coordinate(F.col(d), firsts[d]) for d in DIMENSIONS}
    coded = narrow.select("doc_id", interleave(at, bits).alias("z"), *(c.alias(d) for d, c in at.items()), "salt", *(["kept"] if keep else []))
    order = ("z", "doc_id", "salt")
    # the number of a row in its partition, by Spark's definition of this function
    ranged = coded.repartitionByRange(*order).sortWithinPartitions(*order).drop("salt").withColumn("_id", F.monotonically_increasing_id())
    ranged = staged(ranged.select("*", F.shiftright("_id", 33).cast("int").alias("part"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("at")).drop("_id"), "ranged")
    starts = _before(ranged.groupBy("part").agg((F.max("at") + 1).alias("n")), "n")
    position = F.col("before") + F.col("at")
    # a row for each partition of the range sort, whatever the input
    placed = ranged.join(F.broadcast(starts), "part").withColumn("position", position)
    return placed.withColumn("file", F.expr(f"position div {rows_per_file}")).drop("part", "at", "before")


def cells_of_files(placed: DataFrame) -> DataFrame:
    """(file, z, coordinates) of each file and each cell that it has rows of."""
    return placed.groupBy("file", "z", *DIMENSIONS).agg(F.count(F.lit(1)).alias("rows"))


def file_boxes(pairs: DataFrame) -> DataFrame:
    """(file, rows, <dimension>_min, <dimension>_max) of each file."""
    return pairs.groupBy("file").agg(F.sum("rows").alias("rows"), *(f(d).alias(f"{d}_{n}") for d in DIMENSIONS for n, f in (("min", F.min), ("max", F.max))))


def _within(query: str, low: str, high: str, reach: int) -> Column:
    return F.col(query).between(F.col(low) - reach, F.col(high) + reach)


def files_touched(boxes: DataFrame, queries: DataFrame, reach: int = REACH) -> DataFrame:
    """(z, files_touched) of each query that meets a file: boxes are counted, exploded
    into the (source, lang) pairs that they cover, equi-joined with the queries there,
    and kept where lengths and dates overlap."""
    sides = [f"{d}_{n}" for d in DIMENSIONS for n in ("min", "max")]
    counted = boxes.groupBy(*sides).agg(F.count(F.lit(1)).alias("files"))
    covered = counted.withColumn("source", F.explode(F.sequence("source_min", "source_max"))).withColumn("lang", F.explode(F.sequence("lang_min", "lang_max")))
    met = queries.select("z", *DIMENSIONS).join(covered, ["source", "lang"]).where(_within("length", "length_min", "length_max", reach) & _within("date", "date_min", "date_max", reach))
    return met.groupBy("z").agg(F.sum("files").alias("files_touched"))


def files_matching(pairs: DataFrame, queries: DataFrame, bits: int = BITS, reach: int = REACH) -> DataFrame:
    """(z, files_matching) of each query: it is exploded into its neighbour cells, which
    are equi-joined with the cells that have rows; the intervals of files found there, in
    order, give the number of different files."""
    spans = pairs.groupBy(*DIMENSIONS).agg(F.min("file").alias("low"), F.max("file").alias("high"))
    near = lambda d: F.explode(F.sequence(F.greatest(F.col(d) - reach, F.lit(0)), F.least(F.col(d) + reach, F.lit((1 << bits) - 1))))
    wanted = queries.select("z", "source", "lang", near("length").alias("length"), "date").select("z", "source", "lang", "length", near("date").alias("date"))
    found = wanted.join(spans, list(DIMENSIONS)).groupBy("z").agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("spans"))  # (2 * reach + 1)**2 at most
    fresh = lambda s, x: F.greatest(F.lit(0).cast("long"), x["high"] - F.greatest(x["low"], s["last"] + 1) + 1)
    start = F.struct(F.lit(0).cast("long").alias("files"), F.lit(-1).cast("long").alias("last"))
    union = F.aggregate("spans", start, lambda s, x: F.struct((s["files"] + fresh(s, x)).alias("files"), F.greatest(s["last"], x["high"]).alias("last")), lambda s: s["files"])
    return found.select("z", union.alias("files_matching"))


def lay_out(docs: DataFrame, rows_per_file: int = ROWS_PER_FILE, bits: int = BITS, reach: int = REACH, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, z, position, file, files_touched, files_matching,
    file_bounds, the four coordinates, and ``kept`` where ``keep`` names columns.

    The values are source, lang, length (UTF-8 bytes of text; null: -1) and date (of
    doc_id; a null id counts as ''); nulls are smallest, and equal values share a
    coordinate however many rows have them. Each row asks for its own source and lang
    coordinates and for length and date coordinates at most ``reach`` away; rows of one
    cell ask the same, so a query runs once a cell. Repeated rows each take a position.
    Texts are only measured, so very long ones cost no more than their length. An empty
    table gives no rows; extra columns are ignored.
    """
    placed = place(docs, rows_per_file, bits, keep)
    pairs = staged(cells_of_files(placed), "pairs")
    boxes = file_boxes(pairs)
    queries = pairs.select("z", *DIMENSIONS).distinct()
    bounds = F.concat_ws(",", *(F.col(f"{d}_{n}") for d in DIMENSIONS for n in ("min", "max")))
    # a row for each file and cell: 500 documents at most share one, whatever is hot
    known = pairs.select("file", "z").join(files_touched(boxes, queries, reach), "z").join(files_matching(pairs, queries, bits, reach), "z").join(boxes.select("file", bounds.alias("file_bounds")), "file")
    out = placed.join(known, ["file", "z"])
    return out.select("doc_id", "z", "position", "file", "files_touched", "files_matching", "file_bounds", *DIMENSIONS, *(["kept"] if keep else []))


def write_layout(docs: DataFrame, path: str, rows_per_file: int = 1_000_000, bits: int = BITS) -> DataFrame:
    """Writes the documents with all their columns as Parquet, one folder a file in
    position order, and returns the files' boxes, by which a reader picks files."""
    placed = place(docs, rows_per_file, bits, tuple(docs.columns))
    boxes = staged(file_boxes(cells_of_files(placed)), "boxes")
    rows = placed.select("file", "position", "kept.*") if not {"file", "position"} & set(docs.columns) else placed.select("file", "position", "kept")
    rows.repartition("file").sortWithinPartitions("file", "position").write.partitionBy("file").parquet(path)
    return boxes


def op13_clustered_layout(spark, sf_dir: str) -> DataFrame:
    out = lay_out(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "z", "position", "file", "files_touched", "files_matching", "file_bounds")


def _z_sql() -> str:
    z = "CAST(0 AS BIGINT)"
    for b in reversed(range(BITS)):
        for d in TURNS:
            z = f"({z}) * 2 + ((c_{d} // {1 << b}) % 2)"
    return z


#: crc32 isn't a function there: its table comes from eight shifts, its value from a fold over the digits.
OP13_SQL = f"""
WITH RECURSIVE shifted(b, k, v) AS (
  SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256)
  UNION ALL SELECT b, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, CAST(3988292384 AS BIGINT)) ELSE v // 2 END FROM shifted WHERE k < 8),
crc_table AS (SELECT b, v FROM shifted WHERE k = 8),
names AS (SELECT DISTINCT coalesce(CAST(doc_id AS VARCHAR), '') AS name FROM documents),
folded(name, k, c) AS (
  SELECT name, 0, CAST(4294967295 AS BIGINT) FROM names
  UNION ALL SELECT name, k + 1, xor(c // 256, v) FROM folded JOIN crc_table ON b = xor(c % 256, CAST(ascii(substr(name, k + 1, 1)) AS BIGINT)) WHERE k < length(name)),
days AS (SELECT name, xor(c, CAST(4294967295 AS BIGINT)) % {DAYS} AS day FROM folded WHERE k = length(name)),
sized AS (SELECT doc_id, source, lang, coalesce(strlen(text), -1) AS bytes, day FROM documents JOIN days ON name = coalesce(CAST(doc_id AS VARCHAR), '')),
coded AS (
  SELECT doc_id, {1 << BITS} * (rank() OVER (ORDER BY source NULLS FIRST) - 1) // n AS c_source, {1 << BITS} * (rank() OVER (ORDER BY lang NULLS FIRST) - 1) // n AS c_lang,
         {1 << BITS} * (rank() OVER (ORDER BY bytes) - 1) // n AS c_length, {1 << BITS} * (rank() OVER (ORDER BY day) - 1) // n AS c_date
  FROM sized, (SELECT count(*) AS n FROM documents)),
ordered AS (SELECT *, {_z_sql()} AS z FROM coded),
placed AS (SELECT *, row_number() OVER (ORDER BY z, doc_id NULLS FIRST) - 1 AS position, (row_number() OVER (ORDER BY z, doc_id NULLS FIRST) - 1) // {ROWS_PER_FILE} AS file FROM ordered),
boxes AS (SELECT file, min(c_source) AS s0, max(c_source) AS s1, min(c_lang) AS g0, max(c_lang) AS g1, min(c_length) AS n0, max(c_length) AS n1, min(c_date) AS d0, max(c_date) AS d1 FROM placed GROUP BY file),
asked AS (SELECT DISTINCT z, c_source, c_lang, c_length, c_date FROM placed),
held AS (SELECT DISTINCT file, c_source, c_lang, c_length, c_date FROM placed),
touched AS (SELECT z, count(*) AS files_touched FROM asked JOIN boxes ON c_source BETWEEN s0 AND s1 AND c_lang BETWEEN g0 AND g1 AND n0 <= c_length + {REACH} AND n1 >= c_length - {REACH} AND d0 <= c_date + {REACH} AND d1 >= c_date - {REACH} GROUP BY z),
matching AS (SELECT z, count(DISTINCT file) AS files_matching FROM asked a JOIN held h ON a.c_source = h.c_source AND a.c_lang = h.c_lang AND abs(a.c_length - h.c_length) <= {REACH} AND abs(a.c_date - h.c_date) <= {REACH} GROUP BY z)
SELECT doc_id, CAST(z AS BIGINT) AS z, CAST(position AS BIGINT) AS position, CAST(file AS BIGINT) AS file, CAST(files_touched AS BIGINT) AS files_touched, CAST(files_matching AS BIGINT) AS files_matching,
       concat_ws(',', s0, s1, g0, g1, n0, n1, d0, d1) AS file_bounds
FROM placed JOIN boxes USING (file) JOIN touched USING (z) JOIN matching USING (z)
"""
