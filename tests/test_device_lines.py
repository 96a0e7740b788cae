"""Device files by lines give what whole files give, wherever blocks and chunks end."""

from __future__ import annotations

import pytest

from ophelion.sources import device_lines, files


def content(name: str, samples: int, unit: str) -> str:
    head = [f"PatientID,,{name},,{name},", "TestType,kind,flash,,,", *(f"f{k},,{k},,{k}," for k in range(3, 12)), "skipped waveform"]
    body = ["7,8,9,10,11,12"]
    for kind in ("Raw Waveform", "Pupil waveform", '"Last, quoted Waveform"'):
        body += [f"{kind},{unit}", *(f",,{k},{k / 4},{k + 0.5 if k % 5 else ''},{k * 2 if k % 3 else 'x'}" for k in range(samples)), ""]
    return "\n".join([*head, *body]) + "\n"


@pytest.mark.parametrize("lines", [7, 20_000])
def test_lines_equal_whole_files(spark, tmp_path, lines):
    deep = tmp_path / "deep"
    deep.mkdir()
    (tmp_path / "a.csv").write_bytes(content("a", 300, "µV").encode("utf-8"))
    (deep / "b.csv").write_bytes(content("b", 40, "µV").encode("windows-1252"))
    (deep / "c.csv").write_bytes(content("c", 3, "é").encode("latin-1") + b"odd waveform,\x81\n,,1,2,3,4\n")
    (deep / "bom.csv").write_bytes(b"\xef\xbb\xbf" + content("d", 9, "volts").replace("\n", "\r\n").encode())
    (deep / "empty.csv").write_bytes(b"")
    (deep / "short.csv").write_bytes(b"PatientID,,x\nonly,two\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = sorted(map(repr, device_lines.device_waveforms(spark, str(tmp_path), lines=lines).collect()))
        numbered = device_lines.numbered_lines(spark, str(tmp_path)).where("path like '%/a.csv'").orderBy("line").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = sorted(map(repr, files.device_waveforms(files.binary_files(spark, str(tmp_path))).collect()))
    assert got == want and len(got) > 1_000
    assert [r["line"] for r in numbered] == list(range(len(numbered)))
    assert [bytes(r["raw"]).decode() for r in numbered] == content("a", 300, "µV").splitlines()


@pytest.mark.parametrize("lines", [7, 20_000])
def test_packed_lines(spark, tmp_path, lines):
    """Packed files give what whole files give; many are few containers."""
    for k in range(40):
        (tmp_path / f"f{k}.csv").write_bytes(content(f"p{k}", k, "µV").encode(("utf-8", "windows-1252")[k % 2]))
    whole = files.binary_files(spark, str(tmp_path))
    want = sorted(map(repr, files.device_waveforms(whole).collect()))
    device_lines.pack_lines(device_lines.numbered_lines(spark, str(tmp_path)).coalesce(2), str(tmp_path / "packed"))
    assert len(list((tmp_path / "packed").glob("*.parquet"))) <= 2
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")  # batches end inside chunks
    try:
        got = sorted(map(repr, device_lines.waveforms(device_lines.packed_lines(spark, str(tmp_path / "packed")), lines).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == want and len(got) > 500
