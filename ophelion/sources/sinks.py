"""Sinks: Parquet and CSV tables, exports, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, partitions: int | None = None, max_records: int = 0) -> None:
    """Overwrites a table; ``partitions`` fewer than there are need no shuffle."""
    if partitions:
        df = df.coalesce(partitions) if partitions <= 64 else df.repartition(partitions)
    df.write.mode("overwrite").option("maxRecordsPerFile", max_records).parquet(path)


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """CSV with a header; ``bom`` puts U+FEFF before the first column's name."""
    if bom and df.columns:
        df = df.withColumnRenamed(df.columns[0], "﻿" + df.columns[0])
    df.write.mode("overwrite").option("header", "true").option("encoding", "UTF-8").csv(path)


def write_both(df: DataFrame, path: str) -> None:
    """The same rows as Parquet and CSV; the CSV is written from the Parquet, so the
    plan runs once."""
    write_parquet(df, f"{path}.parquet")
    write_csv(df.sparkSession.read.parquet(f"{path}.parquet"), f"{path}.csv")


def replace_table(df: DataFrame, path: str) -> None:
    """Rewrites a table that ``df`` may read: written beside it, then swapped."""
    spark = df.sparkSession
    aside, old = f"{path}.new", f"{path}.old"
    df.write.mode("overwrite").parquet(aside)
    at = lambda p: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(at(old)):
        if not fs.exists(at(path)):  # an earlier swap ended half-way: its table is the old one
            raise RuntimeError(f"{old} holds the table of a swap that didn't end")
        fs.delete(at(old), True)
    had = fs.exists(at(path))
    if had and not fs.rename(at(path), at(old)):
        raise RuntimeError(f"can't move {path}")
    if not fs.rename(at(aside), at(path)):
        if had:
            fs.rename(at(old), at(path))
        raise RuntimeError(f"can't move {aside}")
    fs.delete(at(old), True)
    spark.catalog.refreshByPath(path)


def write_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Writes the partitions that ``df`` has rows of and leaves the others: files go to a
    staging folder and replace whole partitions when the job commits, so a run that is
    repeated doubles nothing and one that fails changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append_missing(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", "true").csv(path)


def error_rows(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(all columns, error) for each check that a row fails."""
    errors = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
    return df.withColumn("error", F.explode(errors))


def preview(df: DataFrame, n: int = 20) -> DataFrame:
    return df.limit(n)


def preview_whole(df: DataFrame, key: str, n: int) -> DataFrame:
    """All rows of the ``n`` smallest ids."""
    some = df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key).limit(n)
    return df.join(some, key, "left_semi")


def markdown(df: DataFrame, rows: int = 100) -> str:
    """A table as text; a report's rows, so they come to the driver."""
    found = df.limit(rows).collect()
    line = lambda cells: "| " + " | ".join("" if c is None else f"{c:.6g}" if isinstance(c, float) else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, found)])


def markdown_report(df: DataFrame, numeric: Sequence[str], title: str) -> str:
    stats = df.select(*numeric).summary("count", "mean", "stddev", "min", "25%", "50%", "75%", "max")
    return f"# {title}\n\n{markdown(stats)}\n\n{markdown(df)}\n"


def labelled(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in labels.items() if k in df.columns})


def final_dataset(df: DataFrame, drop: Sequence[str], type_column: str, codes: dict[str, int], path: str) -> None:
    """The published data: without the dropped columns, types as codes, and the codes
    as a dimension table beside it."""
    from ..operators.clean import encode_codes

    coded = encode_codes(df.drop(*drop), type_column, codes, f"{type_column}_id").drop(type_column)
    write_parquet(coded, f"{path}/data")
    dims = df.sparkSession.createDataFrame([(v, k) for k, v in codes.items()], f"{type_column}_id int, {type_column} string")
    write_parquet(dims, f"{path}/{type_column}s")


def save_run(path: str, model, frames: dict[str, DataFrame]) -> None:
    """A fitted pipeline and its tables under one folder."""
    model.write().overwrite().save(f"{path}/model")
    for name, df in frames.items():
        write_parquet(df, f"{path}/{name}")
