"""Commands over small files, and the checks of their arguments."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ophelion.__main__ import main, parser
from ophelion.operators import reports, signal


@pytest.fixture
def people(spark, tmp_path):
    path = str(tmp_path / "people")
    spark.createDataFrame([("a", 1, 2.0), ("b", 2, 4.0), ("b", 3, 6.0), (None, 4, 8.0)], "patient_unique_id string, time_ms long, x double").write.parquet(path)
    return path


@pytest.mark.parametrize(
    "argv",
    [
        [],
        ["audit", "--out", "o"],
        ["audit", "cross", "--patients", "p", "--out", "o"],
        ["audit", "before-after", "--before", "p", "--out", "o"],
        ["rank", "--input", "i", "--method", "4", "--out", "o"],
        ["rank", "--input", "i", "--method", "2", "--out", "o"],
        ["histogram", "--input", "i", "--out", "o"],
        ["preview", "--input", "i"],
    ],
)
def test_missing_arguments_end_before_spark(argv):
    with pytest.raises(SystemExit):
        main(argv)


def test_audit_and_purge(spark, people, tmp_path):
    allowed, out = str(tmp_path / "allowed"), str(tmp_path / "out")
    spark.createDataFrame([("b",), ("c",)], "patient_unique_id string").write.parquet(allowed)
    assert set(main(["audit", "cross", "--patients", people, "--metadata", allowed, "--out", out], spark)) == {"presence", "summary", "both", "only_one"}
    assert {(r["patient_unique_id"], r["presence"]) for r in spark.read.parquet(f"{out}/presence").collect()} == {("a", "only_patients"), ("b", "both"), ("c", "only_metadata")}
    assert main(["audit", "before-after", "--before", people, "--after", allowed, "--out", out], spark) == ["counts", "changes"]
    main(["purge", "--table", f"t={people}", "--allowed", allowed, "--out", out], spark)
    assert sorted(str(r["patient_unique_id"]) for r in spark.read.parquet(f"{out}/t").collect()) == ["None", "b", "b"]
    with pytest.raises(SystemExit):
        main(["purge", "--table", people, "--allowed", allowed, "--out", out], spark)


def test_hash_needs_a_salt(spark, people, tmp_path, monkeypatch):
    argv = ["hash", "--ids", people, "--out", str(tmp_path / "out"), "--salt-env", "A_SALT"]
    monkeypatch.delenv("A_SALT", raising=False)
    with pytest.raises(SystemExit):
        main(argv, spark)
    monkeypatch.setenv("A_SALT", "pepper")
    assert main(argv, spark) == ["mapping"]
    assert spark.read.parquet(str(tmp_path / "out" / "mapping")).count() == 2


def test_reports(spark, people, tmp_path):
    out = str(tmp_path / "out")
    main(["histogram", "--input", people, "--column", "x", "--bins", "2", "--out", out], spark)
    assert sorted((r["bin"], r["n"]) for r in spark.read.parquet(f"{out}/histogram").collect()) == [(0, 2), (1, 2)]
    main(["preview", "--input", people, "--rows", "1", "--key", "patient_unique_id", "--out", out], spark)
    assert [r["x"] for r in spark.read.parquet(f"{out}/preview").collect()] == [2.0]
    assert parser().parse_args(["curves", "--input", "i", "--out", "o"]).points == 2000


def test_curves(spark):
    rows = [(p, k, t) for p in ("a", "b", "c") for t, k in enumerate("xxxxxxxyyy")] + [(None, "x", -1)]
    df = spark.createDataFrame([(p, k, t + 100 * "abc".index(p) if p else t) for p, k, t in rows], "p string, kind string, t long")
    found = signal.curves(df, "p", ["kind"], "t", patients=2, rows=9, points=3).withColumn("t", F.col("t") % 100)
    got = sorted((r["p"], r["label"], r["t"]) for r in found.collect())
    want = [(t, "kind=x") for t in (0, 2, 4, 6)] + [(t, "kind=y") for t in (7, 8)]
    assert got == sorted((p, k, t) for p in "ab" for t, k in want)
    assert found.columns == ["p", "kind", "t", "label"]


def test_questionnaire_list(spark):
    df = spark.createDataFrame([(1, 5, "2024-01-02T03:04"), (2, 5, None), (3, 6, "2024-01-02"), (4, 5, "2025-01-01")], "id int, creator_id int, created_at string")
    ids = lambda **k: sorted(r["id"] for r in reports.questionnaire_list(df, 5, ["id", "other"], **k).collect())
    assert ids() == [1, 2, 4] and ids(last="2024-01-02") == [1, 2] and ids(first="2024-01-02", last="2024-12-31") == [1]
