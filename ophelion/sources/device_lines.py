"""Device files of any length, read as lines that Spark splits.

``files.device_waveforms`` takes a file as one cell; here a file is read by blocks, its
lines are numbered from the counts of the blocks before, and chunks of ``lines`` lines are
parsed on their own, each told the waveform that the chunks before it end with. Cells
don't hold line ends. Many files are packed as numbered lines in few containers."""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import files
from .staging import staged

LINES = 20_000
#: Bytes that Windows-1252 leaves undefined.
UNDEFINED_1252 = ("81", "8D", "8F", "90", "9D")


def numbered_lines(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """(path, line, raw, is_utf8): the lines of all files below a folder, from 0."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path)
    where = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").cast("binary").alias("raw"), F.is_valid_utf8("value").alias("is_utf8"))
    found = staged(where, "lines")  # ids of one scan
    blocks = found.groupBy("path", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("path", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return found.join(starts, ["path", "block"]).select("path", (F.col("id") + F.col("shift")).alias("line"), "raw", "is_utf8")


def pack_lines(lines: DataFrame, path: str) -> None:
    """Writes the lines (path, line from 0, raw) of many files to few containers, as
    ``files.pack`` does for whole files: no listing, open or commit for each of them."""
    lines.select("path", F.col("line").cast("long").alias("line"), "raw").write.parquet(path)


def packed_lines(spark: SparkSession, path: str) -> DataFrame:
    """What ``numbered_lines`` gives, of files that were packed."""
    return spark.read.schema("path string, line long, raw binary").parquet(path).withColumn("is_utf8", F.is_valid_utf8(F.col("raw").cast("string")))


def _counted(chunked: DataFrame) -> DataFrame:
    """(path, chunk, n, utf8, beyond): lines below the metadata, and what their bytes fit."""
    undefined = ~F.col("is_utf8") & F.hex("raw").rlike(f"^(..)*({'|'.join(UNDEFINED_1252)})")
    return chunked.groupBy("path", "chunk").agg(F.count_if(F.col("line") > files.METADATA_LINES).alias("n"), F.bool_and("is_utf8").alias("utf8"), F.bool_or(undefined).alias("beyond"))


def encodings(counted: DataFrame) -> DataFrame:
    """(path, encoding): the first of UTF-8, Windows-1252 and Latin-1 that fits all lines."""
    fits = counted.groupBy("path").agg(F.bool_and("utf8").alias("utf8"), F.bool_or("beyond").alias("beyond"))
    return fits.select("path", F.when(F.col("utf8"), "utf-8").when(F.col("beyond"), "latin-1").otherwise("windows-1252").alias("encoding"))


def _rows(raw: pd.Series, encoding: pd.Series | str) -> Iterator[list[str]]:
    names = [encoding] * len(raw) if isinstance(encoding, str) else encoding
    for data, name in zip(raw, names, strict=True):
        text = data.decode(name)
        plain = '"' not in text and "\r" not in text and "\n" not in text
        yield text.split(",") if plain else next(csv.reader([text]), [])


def device_waveforms(spark: SparkSession, path: str, pattern: str = "*.csv", lines: int = LINES) -> DataFrame:
    """What ``files.device_waveforms`` gives, of files of any length. A file without a
    test or a waveform gives no row, an empty folder none."""
    return waveforms(staged(numbered_lines(spark, path, pattern), "numbered"), lines)


def waveforms(numbered: DataFrame, lines: int = LINES) -> DataFrame:
    """``device_waveforms`` of numbered lines, a table that is read several times."""
    chunked = numbered.withColumn("chunk", F.expr(f"line DIV {lines}"))
    counted = staged(_counted(chunked), "counted")  # a row a chunk
    known = staged(encodings(counted), "encodings")
    head = chunked.where(F.col("line") < files.METADATA_LINES).join(known, "path").groupBy("path", "encoding").agg(F.array_sort(F.collect_list(F.struct("line", "raw"))).alias("head"))  # 11 lines

    def tests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                rows = list(_rows(pd.Series([x["raw"] for x in r.head]), r.encoding))
                if rows and rows[0]:
                    rows[0][0] = rows[0][0].removeprefix("\ufeff")
                found = files.device_tests(rows)
                out.append([r.path, r.encoding, [n for n, _, _ in found], [k for _, k, _ in found]])
            yield pd.DataFrame(out, columns=["path", "encoding", "tests", "at"])

    def marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            leads = [(files._cell(row, 0), files._cell(row, 1)) for row in _rows(pdf["raw"], pdf["encoding"])]
            out = pdf[["path", "chunk", "line"]].assign(kind=[a for a, _ in leads], about=[b for _, b in leads])
            yield out[[("waveform" in a.lower()) for a, _ in leads]]

    about = head.mapInPandas(tests, "path string, encoding string, tests array<int>, at array<int>")
    body = chunked.where(F.col("line") > files.METADATA_LINES)
    named = body.where(F.contains(F.lower(F.decode("raw", "ISO-8859-1")), F.lit("waveform"))).join(known, "path").select("path", "encoding", "chunk", "line", "raw")
    last = named.mapInPandas(marks, "path string, chunk long, line long, kind string, about string").groupBy("path", "chunk").agg(F.max_by(F.struct("kind", "about"), "line").alias("mark"))
    before = Window.partitionBy("path").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = counted.where("n > 0").select("path", "chunk").join(last, ["path", "chunk"], "left").withColumn("_m", F.last("mark", True).over(before))
    told = chunks.join(about, "path").select("path", "chunk", "encoding", "tests", "at", F.col("_m.kind").alias("kind"), F.col("_m.about").alias("about"))
    told = staged(told, "told")  # a row a chunk

    # a chunk's lines follow a row that tells what is known of it, in one sorted stream: no group a file
    task = ["path", "chunk", "line"]
    stream = body.select(*task, "raw").unionByName(told.withColumn("line", F.lit(-1).cast("long")), allowMissingColumns=True)
    return stream.repartition("path", "chunk").sortWithinPartitions(*task).mapInPandas(_samples, files.WAVEFORMS)


def _samples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in files.WAVEFORMS.split(", ")]
    name = encoding = kind = about = None
    tests: list[tuple[int, int]] = []
    for pdf in batches:
        found, sources = [], []
        told = dict(zip(np.flatnonzero(pdf["line"] < 0), pdf[pdf["line"] < 0].itertuples(), strict=True))
        cuts = [0, *(i for i in told if i), len(pdf)]
        raw = pdf["raw"].to_numpy()
        for start, end in zip(cuts, cuts[1:], strict=False):
            if (own := told.get(start)) is not None:
                name, encoding, kind, about = files.stem(own.path), own.encoding, own.kind, own.about
                tests = list(zip(own.tests, own.at, strict=True))
                start += 1
            rows = [*([[kind, about]] if isinstance(kind, str) else []), *_rows(raw[start:end], encoding)]
            before = len(found)
            found.extend(files.samples_below(rows, tests))
            sources.extend([name] * (len(found) - before))
            # a chunk may go on in the next batch
            ends = next((row for row in reversed(rows) if row and "waveform" in row[0].lower()), None) if end == len(pdf) else None
            if ends is not None:
                kind, about = files._cell(ends, 0), files._cell(ends, 1)
        n, kinds, abouts, times, values = zip(*found, strict=True) if found else [()] * 5
        pupil = np.array(list(map({k: "pupil" in k.lower() for k in set(kinds)}.get, kinds)), bool)
        value = np.array(values, np.float64)
        text = lambda c: pd.Series(list(c), dtype=object)
        yield pd.DataFrame(dict(zip(names, (text(sources), n, text(kinds), text(abouts), times, np.where(pupil, np.nan, value), np.where(pupil, value, np.nan)), strict=True)))
