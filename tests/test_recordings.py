"""Features of cut recordings equal those of the whole series."""

from __future__ import annotations

import math

import numpy as np
import pytest

from ophelion.operators import recordings, signal

NAMES = [c.split()[0] for c in signal.FEATURES.split(", ")]


def wave(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    t = np.cumsum(rng.choice([1.0, 2.0, 2.5], n))
    return t, np.sin(t / 7) * 3 + np.sin(t / 2.2) + rng.normal(size=n) + 5


@pytest.mark.parametrize("n", [1024, 1025, 4097, 5000, 8191, 12801])
def test_blocks_of_a_series_add_up(n):
    x, block, total = wave(n, n)[1], 1024, 0
    for begin in range(0, n, block):
        end = min(begin + block, n)
        lo = max(begin - recordings.BEFORE, 0)
        total = total + recordings.block_sums(x[lo : min(end + recordings.AFTER, n)], lo, n, begin, end)
    np.testing.assert_allclose(signal.band_features(total[recordings.BANDS :]), signal.wavelet_features(x), rtol=1e-9)
    density = total[: recordings.DENSITIES] / total[recordings.DENSITIES]
    np.testing.assert_allclose(density, signal.welch(x, 1.0)[1], rtol=1e-9)


def rows_of(name: str, n: int, seed: int, missing: bool = True) -> list[tuple]:
    t, v = wave(n, seed)
    rows = [(name, float(a), float(b)) for a, b in zip(t, v, strict=True)]
    if missing:  # both ends, a run longer than a piece of 100 rows, a NaN
        gone = {0, 1, n - 1, 700, *range(300, 620)}
        rows = [(s, a, None if i in gone else b) for i, (s, a, b) in enumerate(rows)]
        rows[800] = (name, rows[800][1], math.nan)
    return rows


def test_long_series_equal_whole_ones(spark):
    rows = rows_of("odd", 2_311, 1) + rows_of("even", 4_096, 2) + rows_of("prime", 5_003, 3, False) + rows_of("short", 900, 4) + rows_of("tiny", 20, 5, False)
    rows += [("untimed", math.inf if i == 9 else float(i), 1.0) for i in range(1_500)]
    rows += [("unvalued", float(i), None) for i in range(1_500)] + [("standing", 7.0, float(i % 11)) for i in range(1_500)]
    np.random.default_rng(0).shuffle(rows)
    df = spark.createDataFrame([(*r, "x") for r in rows], "s string, time_ms double, value double, n string").withColumnRenamed("s", "series")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {r["series"]: r for r in recordings.spectral_features(df, ["series"], longest=1_024, cell=512).collect()}
        want = {r["series"]: r for r in signal.spectral_features(df, ["series"]).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert set(got) == set(want) == {"odd", "even", "prime", "short", "standing"}
    for name, row in want.items():
        for c in NAMES:
            if row[c] is None:
                assert got[name][c] is None, (name, c)
            elif name != "standing" or c == "signal_length":  # its order is open: one time for all
                assert got[name][c] == pytest.approx(row[c], rel=1e-7), (name, c)


def test_several_keys_and_empty_table(spark):
    rows = [(1, s, a, b) for s, a, b in rows_of("a", 1_500, 6)] + [(2, s, a, b) for s, a, b in rows_of("a", 1_100, 7)]
    df = spark.createDataFrame(rows, "k int, name string, time_ms double, value double")
    got = recordings.spectral_features(df, ["k", "name"], longest=1_024)
    assert got.columns == signal.spectral_features(df, ["k", "name"]).columns
    assert {(r["k"], r["name"], r["signal_length"]) for r in got.collect()} == {(1, "a", 1_500), (2, "a", 1_100)}
    assert recordings.spectral_features(df.where("k > 9"), ["k", "name"]).count() == 0
    with pytest.raises(ValueError):
        recordings.spectral_features(df, ["k"], longest=100)
