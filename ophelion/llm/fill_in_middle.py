"""Fill-in-middle transformation over relational units, with DataFrame functions only.

A text is cut into blocks that end between units, so that no row holds more than a block
or a single unit, whatever the text's length. Window sums over a document's blocks give
the units and characters before each. The cut requests of a document, unit ordinals, join
the blocks that hold them; those blocks' matches are posexploded, a window sums their
lengths, and the unit whose ordinal is asked for gives the offset. The two offsets of a
document are aggregated, and substrings of the whole text are put together.

Texts move once: rows are dealt by a row number, and every window, join and aggregate
works on that partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNIT = r"[A-Za-z]+|[^A-Za-z]"
#: Characters of a block before it ends with the unit that it is in.
BLOCK = 1024
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20  # of 100


def draws(doc_id: Column) -> list[Column]:
    """The first four 8-digit groups of the sha256 of '1:' and the id, as numbers; a null
    id counts as ''."""
    hexed = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(hexed, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def unit_count(text: Column) -> Column:
    """As many units as characters once each run of letters is one; builds no array."""
    return F.length(F.regexp_replace(text, "[A-Za-z]+", "a")).cast("long")


def form_of(text: Column, n: Column, third: Column, fourth: Column) -> Column:
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    return F.when((n == 0) | marked | (third % 100 >= PLAIN_FROM), "plain").when(fourth % 100 < SPM_BELOW, "spm").otherwise("psm")


def requests(rows: DataFrame) -> DataFrame:
    """(row, which, ordinal): the last unit before each of the two cuts; none for a cut
    at the start, and none of a plain text."""
    cuts = F.array(F.struct(F.lit(1).alias("which"), F.col("low").alias("ordinal")), F.struct(F.lit(2).alias("which"), F.col("high").alias("ordinal")))
    return rows.select("row", F.explode(F.when(F.col("form") != "plain", cuts)).alias("c")).select("row", "c.*").where("ordinal > 0")


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """(row, piece, units, units_before, chars_before) of texts that are cut."""
    cut = F.when(F.col("form") != "plain", F.col("text"))
    pieces = F.regexp_extract_all(cut, F.lit(rf"(?s).{{1,{size}}}(?:(?<=[A-Za-z])[A-Za-z]*)?"), F.lit(0))
    counted = rows.select("row", F.posexplode(pieces).alias("block", "piece")).select("*", unit_count(F.col("piece")).alias("units"), F.length("piece").cast("long").alias("chars"))
    before = Window.partitionBy("row").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return counted.select("row", "piece", "units", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("units", "chars")))


def offsets(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """(row, first, second): the characters before each cut of a document, null for a
    cut at the start; rows without a cut elsewhere are missing."""
    hit = blocks(rows, size).join(requests(rows), "row").where("ordinal > units_before and ordinal <= units_before + units")
    units = hit.select("row", "which", "ordinal", "units_before", "chars_before", F.posexplode(F.regexp_extract_all("piece", F.lit(UNIT), F.lit(0))).alias("at", "unit"))
    upto = Window.partitionBy("row", "which").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = units.select("row", "which", "ordinal", (F.col("units_before") + F.col("at") + 1).alias("number"), (F.col("chars_before") + F.sum(F.length("unit")).over(upto)).alias("end"))
    found = ends.where("number = ordinal")
    return found.groupBy("row").agg(*(F.max(F.when(F.col("which") == k, F.col("end"))).alias(n) for k, n in ((1, "first"), (2, "second"))))


def restore(output: Column, form: Column) -> Column:
    """The text from its output. A marker neither starts nor ends as another one does, so
    the first of each kind is the one that was put there."""
    body = F.substring(output, F.lit(len(PREFIX) + 1), F.length(output))
    before = lambda x, mark: F.substring_index(x, mark, 1)
    after = lambda x, mark: F.substring(x, F.length(before(x, mark)) + len(mark) + 1, F.length(x))
    psm = F.concat(before(body, SUFFIX), after(body, MIDDLE), before(after(body, SUFFIX), MIDDLE))
    spm = F.concat(before(after(body, PREFIX), MIDDLE), after(body, MIDDLE), before(body, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n, form, prefix_chars, middle_chars, output.

    A null text is empty, and an empty text is plain with n = 0. Cuts of one document
    may fall together or on an end; its parts are then empty. Repeated rows each give a
    row, equal ones the same; rows without an id share their draws and are cut by their
    own text. Very long texts are cut in blocks; a single unit is never split. An empty
    table gives no rows; extra columns are ignored.

    ``docs`` is read more than once if an executor is lost: its rows need to come in the
    same order again, as those of a table do.
    """
    doc_id, text = docs["doc_id"].cast("long"), F.coalesce(docs["text"].cast("string"), F.lit(""))
    own = docs.select(doc_id.alias("doc_id"), text.alias("text"), unit_count(text).alias("n"), F.monotonically_increasing_id().alias("row"))
    # every branch below reads all columns of ``dealt`` and filters nothing before it
    # explodes, so that they share one exchange
    dealt = own.repartition("row")
    one, two, three, four = draws(F.col("doc_id"))
    first, second = one % (F.col("n") + 1), two % (F.col("n") + 1)
    rows = dealt.select("*", form_of(F.col("text"), F.col("n"), three, four).alias("form"), F.least(first, second).alias("low"), F.greatest(first, second).alias("high"))
    placed = rows.join(offsets(rows, block), "row", "left")
    cut = F.col("form") != "plain"
    at, to = F.coalesce("first", F.lit(0)).cast("int"), F.coalesce("second", F.lit(0)).cast("int")
    prefix, middle, suffix = F.substring("text", F.lit(1), at), F.substring(F.col("text"), at + 1, to - at), F.substring(F.col("text"), to + 1, F.length("text"))
    output = F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)).when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)).otherwise(F.col("text"))
    return placed.select("doc_id", "n", "form", F.when(cut, at.cast("long")).alias("prefix_chars"), F.when(cut, (to - at).cast("long")).alias("middle_chars"), output.alias("output"))


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    out = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


_HEX = "CAST('0x' || substr(sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')), {at}, 8) AS BIGINT)"
#: The text itself is what is restored.
OP11_SQL = f"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '{UNIT}') AS units,
         {_HEX.format(at=1)} AS h1, {_HEX.format(at=9)} AS h2, {_HEX.format(at=17)} AS h3, {_HEX.format(at=25)} AS h4
  FROM documents),
placed AS (
  SELECT *, CAST(len(units) AS BIGINT) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS low, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS high,
         CASE WHEN body = '' OR contains(body, '{PREFIX}') OR contains(body, '{SUFFIX}') OR contains(body, '{MIDDLE}') OR h3 % 100 >= {PLAIN_FROM} THEN 'plain' WHEN h4 % 100 < {SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form
  FROM cut),
parts AS (
  SELECT doc_id, n, form, body, coalesce(array_to_string(list_slice(units, 1, low), ''), '') AS prefix, coalesce(array_to_string(list_slice(units, low + 1, high), ''), '') AS middle, coalesce(array_to_string(list_slice(units, high + 1, n), ''), '') AS suffix
  FROM placed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle WHEN 'spm' THEN '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle ELSE body END) AS output_sha256,
       sha256(body) AS restored_sha256
FROM parts
"""
