"""File sources. Whole small files are read as binary and parsed in the executors, one
row per record; listing and decoding never pass through the driver."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterable, Iterator, Sequence
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, values

ENCODINGS = ("utf-8-sig", "utf-8", "windows-1252", "latin-1")
METADATA_LINES = 11
METADATA = "source_file string, test_id int, field map<string,string>"
WAVEFORMS = "source_file string, test_id int, waveform_type string, waveform_description string, time_ms double, voltage_uV double, pupil_mm double"
LFS_MARK = b"version https://git-lfs.github.com/spec/v1"


def decode(data: bytes) -> str:
    """Text in the first encoding that fits; Latin-1 always does."""
    for name in ENCODINGS:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    raise ValueError("no encoding fits")


def is_lfs_pointer(data: bytes) -> bool:
    return data.startswith(LFS_MARK)


def binary_files(spark: SparkSession, path: str | Sequence[str], pattern: str = "*.csv") -> DataFrame:
    """path, modificationTime, length, content of all files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)


def pack(files: DataFrame, path: str) -> None:
    """Writes many small files, rows (path, content), to few containers: a listing, an open
    and a commit for each of a million files take hours, those of the containers don't."""
    files.select("path", F.current_timestamp().alias("modificationTime"), F.length("content").cast("long").alias("length"), "content").write.parquet(path)


def packed_files(spark: SparkSession, path: str) -> DataFrame:
    """What ``binary_files`` gives, of files that were packed."""
    return spark.read.schema("path string, modificationTime timestamp, length long, content binary").parquet(path)


def newest(files: DataFrame, by: str = "modificationTime") -> DataFrame:
    """The newest file, by time or (by = 'path') by name."""
    return files.orderBy(F.desc(by), F.desc("path")).limit(1)


def stem(path: str) -> str:
    name = path.replace("\\", "/").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[0] if "." in name else name


def _cell(row: list[str], k: int) -> str:
    return row[k].strip() if k < len(row) else ""


def device_tests(rows: list[list[str]]) -> list[tuple[int, int, dict[str, str]]]:
    """(test number, column, fields): one test for each filled cell of the first line
    from the third column on."""
    head = rows[:METADATA_LINES]
    columns = [k for k in range(2, len(head[0]) if head else 0) if _cell(head[0], k)]
    out = []
    for n, k in enumerate(columns, 1):
        fields = {}
        for line in head:
            if name := _cell(line, 0):
                fields[name] = _cell(line, k)
                if about := _cell(line, 1):
                    fields[f"{name}_description"] = about
        out.append((n, k, fields))
    return out


def samples_below(rows: Iterable[list[str]], columns: list[tuple[int, int]]) -> Iterator[tuple]:
    """(test, waveform, description, time, value) of lines below the metadata, after each
    that names a waveform; ``columns`` are (test, column), time stands in the test's column
    and the value in the next."""
    kind = about = None
    for row in rows:
        lead = row[0].strip() if row else ""
        if lead and "waveform" in lead.lower():
            kind, about = lead, _cell(row, 1)
        elif kind is not None:
            for n, k in columns:
                try:
                    time, value = float(row[k]), float(row[k + 1])
                except (ValueError, IndexError):
                    continue
                yield n, kind, about, time, value


#: Parsed rows that a task hands on at a time.
ROWS = 10_000


def _parsed(batches: Iterator[pd.DataFrame], emit, columns: list[str]) -> Iterator[pd.DataFrame]:
    """``emit`` reads the lines of a file one by one; rows go on in parts of bounded size,
    those of small files together."""

    def every(pdf: pd.DataFrame) -> Iterator[tuple]:
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            yield from emit(stem(path), csv.reader(io.StringIO(decode(content), newline="")))

    for pdf in batches:
        out = every(pdf)
        while part := list(islice(out, ROWS)):
            yield pd.DataFrame(part, columns=columns)


def device_metadata(files: DataFrame) -> DataFrame:
    def emit(name, rows):
        for n, _, fields in device_tests(list(islice(rows, METADATA_LINES))):
            yield name, n, fields

    return files.select("path", "content").mapInPandas(lambda b: _parsed(b, emit, ["source_file", "test_id", "field"]), METADATA)


def device_waveforms(files: DataFrame) -> DataFrame:
    """Long samples; a pupil's go to pupil_mm, all others to voltage_uV."""

    def emit(name, rows):
        tests = [(n, k) for n, k, _ in device_tests(list(islice(rows, METADATA_LINES + 1)))]
        for n, kind, about, time, value in samples_below(rows, tests):
            pupil = "pupil" in kind.lower()
            yield name, n, kind, about, time, None if pupil else value, value if pupil else None

    names = [c.split()[0] for c in WAVEFORMS.split(", ")]
    return files.select("path", "content").mapInPandas(lambda b: _parsed(b, emit, names), WAVEFORMS)


def with_identity(metadata: DataFrame) -> DataFrame:
    """Adds the patient's id and its parts: from the file's name where that is clear,
    else from the first filled field of the file's tests."""
    field = lambda n: F.element_at("field", n)
    first = lambda c: F.min_by(ids.blank_to_null(c), F.when(ids.blank_to_null(c).isNotNull(), F.col("test_id")))
    record, name = ids.record_and_name(field("PatientID"))
    told = metadata.groupBy("source_file").agg(first(record).alias("_r"), first(name).alias("_n"), first(values.birth_text(field("PatientBirthdate"))).alias("_b"), first(values.test_text(field("TestingDate"))).alias("_t"))
    joined = metadata.join(told, "source_file").withColumn("_f", ids.identity_from_file_name(F.col("source_file")))
    part = {k: ids.prefer(F.col("_f.confident"), F.col(f"_f.{k}"), F.col(c)) for k, c in (("record", "_r"), ("name", "_n"), ("birth", "_b"), ("test", "_t"))}
    gone = lambda c: F.coalesce(c, F.lit(""))
    return joined.select(
        "source_file",
        "test_id",
        ids.build_id(gone(part["record"]), gone(part["name"]), gone(part["birth"]), gone(part["test"])).alias("patient_unique_id"),
        F.coalesce(part["record"], F.lit("N/A")).alias("record"),
        gone(part["name"]).alias("name"),
        values.birth_slashed(part["birth"]).alias("birth_date"),
        values.test_slashed(part["test"]).alias("test_time"),
        "field",
    )


#: Parts of header names that show a header line.
_HEADER_WORDS = ("patientid", "id entered", "birth", "testing", "when test")


def exam_rows(rows: list[list[str]]) -> Iterator[dict[str, str]]:
    """Records of an exam file: the header is among the first three lines, or there is
    none; short rows are padded, long ones cut, blank ones skipped."""
    if not rows:
        return
    at = next((k for k in range(min(3, len(rows))) if any(w in c.lower() for c in rows[k] for w in _HEADER_WORDS)), None)
    header = [f"col_{k}" for k in range(len(rows[0]))] if at is None else [c.strip() or f"col_{k}" for k, c in enumerate(rows[at])]
    for row in rows if at is None else rows[at + 1 :]:
        cells = [c.strip() for c in row]
        if any(cells):
            yield dict(zip(header, cells + [""] * len(header), strict=False))


def column_roles(names: Sequence[str]) -> dict[str, str | None]:
    """Which columns hold the patient's id, the birth date and the test time."""
    low = {n: n.strip().lower() for n in names}
    find = lambda test: next((n for n in names if test(low[n])), None)
    person = find(lambda x: "patientid" in x or "id entered" in x)
    born = find(lambda x: "birth" in x and "date" in x) or find(lambda x: "birth" in x)
    tested = find(lambda x: "when test" in x or "testing" in x) or find(lambda x: "test" in x or "when" in x)
    return {"PatientID": person or (names[0] if names else None), "PatientBirthdate": born, "TestingDate": tested}


def exam_records(files: DataFrame) -> DataFrame:
    """source_file, PatientID, PatientBirthdate, TestingDate, field (all cells by name)."""

    def emit(name, rows):
        for fields in exam_rows(list(rows)):
            roles = column_roles(list(fields))
            yield name, *(fields.get(c, "") if c else "" for c in roles.values()), fields

    names = ["source_file", "PatientID", "PatientBirthdate", "TestingDate", "field"]
    return files.select("path", "content").mapInPandas(lambda b: _parsed(b, emit, names), "source_file string, PatientID string, PatientBirthdate string, TestingDate string, field map<string,string>")


def patients(records: DataFrame) -> DataFrame:
    """Dates in one form and the patient's id added to exam records."""
    kept = lambda formatted, raw: F.when(formatted != "", formatted).otherwise(ids.text_or_empty(raw))
    record, name = ids.record_and_name(F.col("PatientID"))
    gone = lambda c: F.coalesce(c, F.lit(""))
    return records.withColumns(
        {
            "record": gone(record),
            "name": ids.normalize_name(gone(name)),
            "patient_unique_id": ids.build_id(gone(record), gone(name), values.birth_text(F.col("PatientBirthdate")), values.test_text(F.col("TestingDate"))),
            "birth_date": kept(values.birth_slashed(F.col("PatientBirthdate")), F.col("PatientBirthdate")),
            "test_time": kept(values.test_slashed(F.col("TestingDate")), F.col("TestingDate")),
        }
    )


def id_mapping(found: DataFrame) -> DataFrame:
    return found.select("record", "name", "birth_date", "test_time", "patient_unique_id").dropDuplicates(["patient_unique_id"])


def text_corpus(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """model, date, content, filename of texts named <prefix>-<model>-<yy-mm-dd>.txt;
    Unknown where a name has another form."""
    files = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    pattern = rf"{prefix}-(.*?)-(\d{{2}}-\d{{2}}-\d{{2}})\.txt"
    part = lambda k: F.when(name.rlike(pattern), F.regexp_extract(name, pattern, k)).otherwise("Unknown")
    model = F.when(F.contains(name, F.lit("Human")), "Human").otherwise(part(1))
    return files.select(model.alias("model"), part(2).alias("date"), F.col("value").alias("content"), name.alias("filename"))


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8", schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", "true").option("encoding", encoding)
    return (reader.schema(schema) if schema else reader.option("inferSchema", "true")).csv(path)


def analysis_csv(spark: SparkSession, path: str) -> DataFrame:
    """A results table; an error where it has no rows."""
    out = read_csv(spark, path)
    if out.isEmpty():
        raise ValueError(f"{path}: no rows")
    return out


def blank(column: Column) -> Column:
    return ids.blank_to_null(column).isNull()
