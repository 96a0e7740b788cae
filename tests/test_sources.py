"""File sources and sinks on invented files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from ophelion.plans import catalogue, exchange, jobs
from ophelion.sources import files, questionnaire, sinks

DEVICE = """PatientID,,12345 Ana Luz,,12345 Ana Luz
PatientBirthdate,born,02/01/1990,,02/01/1990
TestingDate,,2020-03-04 05:06:07,,2020-03-04 05:06:07
TestType,kind,flash,,flicker
a,,1,,2
b,,1,,2
c,,1,,2
d,,1,,2
e,,1,,2
f,,1,,2
g,,1,,2
skipped
Pupil Waveform,size
,,0,3.1,0,3.2
Raw Waveform,volts
,,0,1.5,0,x
,,2,1.6,2,2.5
,,bad,1.7
"""


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "device").mkdir()
    (tmp_path / "device" / "12345-Ana Luz_900102_200304050607.csv").write_text(DEVICE, "utf-8")
    (tmp_path / "device" / "empty.csv").write_text("", "utf-8")
    (tmp_path / "exam").mkdir()
    (tmp_path / "exam" / "e.csv").write_bytes("report\nPatientID,Birth date,When tested,note\n777 José,02/01/1990,2020-03-04 05:06:07,ok,extra\n\n888,x\n".encode("latin-1"))
    return tmp_path


def test_device_files(spark, folder):
    found = files.binary_files(spark, str(folder / "device"))
    meta = files.with_identity(files.device_metadata(found)).orderBy("test_id").collect()
    assert [(r["test_id"], r["patient_unique_id"], r["birth_date"], r["test_time"]) for r in meta] == [(k, "12345-analuz_900102_200304050607", "90/01/02", "20/03/04 05:06:07") for k in (1, 2)]
    assert meta[1]["field"]["TestType"] == "flicker" and meta[0]["field"]["TestType_description"] == "kind"
    waves = {(r["test_id"], r["waveform_type"], r["time_ms"]): (r["voltage_uV"], r["pupil_mm"]) for r in files.device_waveforms(found).collect()}
    assert waves == {(1, "Pupil Waveform", 0): (None, 3.1), (2, "Pupil Waveform", 0): (None, 3.2), (1, "Raw Waveform", 0): (1.5, None), (1, "Raw Waveform", 2): (1.6, None), (2, "Raw Waveform", 2): (2.5, None)}


def test_exam_files_and_consolidation(spark, folder):
    people = files.patients(files.exam_records(files.binary_files(spark, str(folder / "exam")))).orderBy("record").collect()
    assert [(r["record"], r["name"], r["patient_unique_id"], r["birth_date"]) for r in people] == [("777", "jose", "777-jose_900201_200304050607", "90/02/01"), ("888", "", "888", "x")]
    tables = jobs.consolidate(spark, str(folder / "device"), str(folder / "exam"), str(folder / "out"))
    assert tables["waveforms"].count() == 5 and tables["mapping"].count() == 2
    audit = jobs.audit_cross(tables["patients"], tables["metadata"])
    assert {r["presence"]: r["ids"] for r in audit["summary"].collect()} == {"only_patients": 2, "only_metadata": 1}


def test_decode_and_pointers():
    assert files.decode("é".encode()) == "é" and files.decode(b"\xe9") == "é"
    assert files.is_lfs_pointer(files.LFS_MARK + b"\noid") and not files.is_lfs_pointer(b"PAR1")
    assert files.column_roles(["id", "Date of birth", "When"]) == {"PatientID": "id", "PatientBirthdate": "Date of birth", "TestingDate": "When"}


def test_questionnaires(spark, tmp_path):
    answer = lambda caption, text=None, options=None: {"caption": caption, "text_response": text, "selected_option_texts": options or [], "selected_option_ids": [], "score": 1.0}
    nested = {"success": True, "data": {"questionnaire": {"id": 5, "title": "T"}, "submissions": [{"submission_id": 1, "total_score": 2.0, "submitted_at": "x", "answers": [answer("QS1", " Ana "), answer("Q1", None, ["a", "b "]), answer(None, "lost")]}, {"submission_id": 2, "total_score": 1.0, "answers": []}]}}
    (tmp_path / "n.json").write_text(json.dumps(nested))
    (tmp_path / "l.json").write_text(json.dumps([{"ID da Submissão": 9, "QS1: Nome": "Rui", "other": 1}]))
    rows = {r["submission_id"]: r for r in questionnaire.read_questionnaire(spark, str(tmp_path / "n.json")).collect()}
    assert (rows[1]["QS1"], rows[1]["Q1"], rows[1]["identity_name"], rows[1]["identity_sex"]) == ("Ana", "a; b", "Ana", "") and rows[2]["Q1"] == ""
    old = questionnaire.read_questionnaire(spark, str(tmp_path / "l.json")).first()
    assert (old["submission_id"], old["QS1"], old["identity_name"]) == (9, "Rui", "Rui")


def test_corpus(spark, tmp_path):
    for name in ("SET-gpt-x-25-01-02.txt", "SET-Human-25-01-03.txt", "odd.txt"):
        (tmp_path / name).write_text("Um dia.\nOutro.")
    rows = {r["filename"]: (r["model"], r["date"]) for r in files.text_corpus(spark, str(tmp_path), "SET").collect()}
    assert rows == {"SET-gpt-x-25-01-02.txt": ("gpt-x", "25-01-02"), "SET-Human-25-01-03.txt": ("Human", "25-01-03"), "odd.txt": ("Unknown", "Unknown")}
    assert jobs.translation_metrics(files.text_corpus(spark, str(tmp_path), "SET")).first()["sentences"] == 2


def test_sinks(spark, tmp_path):
    df = spark.range(5).withColumn("x", F.col("id") * 1.5)
    sinks.write_both(df, str(tmp_path / "t"))
    table = str(tmp_path / "t.parquet")
    sinks.replace_table(spark.read.parquet(table).where("id > 1"), table)
    assert spark.read.parquet(table).count() == 3 and files.analysis_csv(spark, str(tmp_path / "t.csv")).count() == 5
    assert sinks.preview_whole(df.unionAll(df), "id", 2).count() == 4
    assert sinks.error_rows(df, {"small": F.col("id") < 3, "even": F.col("id") % 2 == 0}).count() == 2 + 2
    assert sinks.markdown(df.limit(1)).splitlines()[1] == "| --- | --- |"
    with pytest.raises(Exception, match="no code"):
        sinks.final_dataset(spark.createDataFrame([("zzz",)], "kind string"), [], "kind", {"a": 1}, str(tmp_path / "f"))


def test_purge_and_anonymise_jobs(spark):
    df = spark.createDataFrame([("1", "n"), ("2", "m")], "id string, name string")
    kept, log = jobs.purge(spark, {"t": df}, df.where("id = '1'"), "id")["t"]
    assert kept.count() == 1 and log.count() == 1
    out, audit = jobs.anonymise({"t": df}, df.where("id = '1'"), "id", "s")["t"]
    assert out.columns == ["id"] and out.count() == 1 and audit.first()["rows_dropped"] == 1


def test_annotation_job(spark):
    people = spark.createDataFrame([(1, "10", "Ana", ""), (2, "", "Rui Silva", "M"), (3, "", "Marina T", "F"), (4, "", "None Such", "")], "k long, record string, name string, sex string")
    records = spark.createDataFrame([(100, "10", "Someone", "F", "sim"), (101, "", "Rui Silva", "F", "não"), (102, None, "Marina Teresa", "F", "")], "record_id long, record string, name string, sex string, has_erg string")
    out, open_ = jobs.annotate(people, records, "k")
    got = {r["k"]: (r["match_method"], r["sex"], r["has_erg"], r["sex_differs"]) for r in out.collect()}
    assert got == {1: ("record", "F", True, False), 2: ("name_exact", "F", False, True), 3: ("name_prefix", "F", None, False), 4: ("not_found", None, None, False)}
    assert [r["k"] for r in open_.collect()] == [4]


@pytest.mark.parametrize("name", ["source_questionnaire_nested", "source_device_metadata", "source_device_waveforms"])
def test_no_file_for_each_row(spark, monkeypatch, name):
    """Documents and small files go to few files, whatever their number."""
    paths, real = [], exchange.scratch
    monkeypatch.setattr(exchange, "scratch", lambda t: paths.append(real(t)) or paths[-1])
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "0")
    assert exchange.Tables(spark, "/root/testdata/sf0.001").supplier.count() > 1
    assert catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    (path,) = paths
    assert spark.read.format("binaryFile").load(path).where("path not like '%/_SUCCESS'").count() <= 4


def test_packed_files_come_back(spark, tmp_path):
    """Names, lengths and bytes of empty and binary files; long files are parsed in parts."""
    rows = [("a.csv", b""), ("b.csv", bytes(range(256))), ("c.csv", "PatientID,,7\n".encode() + b"\n" * 11 + b"Raw Waveform,volts\n" + b"".join(b",,%d,1\n" % k for k in range(25_000)))]
    files.pack(spark.createDataFrame(rows, "path string, content binary"), str(tmp_path / "p"))
    back = files.packed_files(spark, str(tmp_path / "p"))
    assert sorted((r["path"], bytes(r["content"]), r["length"]) for r in back.collect()) == [(a, b, len(b)) for a, b in rows]
    long = files.device_waveforms(back.where("path = 'c.csv'")).agg(F.count("*"), F.sum("time_ms"), F.min("waveform_type"))
    assert tuple(long.head()) == (25_000, 25_000 * 24_999 / 2, "Raw Waveform")
