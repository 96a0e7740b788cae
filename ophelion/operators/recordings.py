"""Spectral features of recordings of any length.

A series of up to ``longest`` samples is one group (``signal.spectral_features``). A longer
one is cut, and what the cuts give is merged, so no task holds a series:

* positions, missing values and steps come from pieces of a sort by series and time, and
  from one small row a piece;
* Welch's segments and the wavelet's bands come from blocks with a margin on both sides:
  each block owns the segments and coefficients that begin in it, and their sums add up;
* the Fourier transform of any length n is a circular convolution with a chirp over a
  power of two m >= 2n - 1 (Bluestein), whose transforms go by columns, then by rows of a
  matrix of m values, both in groups of ``cell`` values.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged
from . import signal
from .quantiles import quantiles

LONGEST, CELL = 1 << 16, 1 << 18
#: Samples that a block sees before and after its own: five levels of the wavelet reach
#: 186 back, a segment that begins in the block ends at most 128 behind it.
BEFORE, AFTER = 256, 128
SEGMENT = 256
#: Bins of a block's sums: densities, number of segments, bands.
DENSITIES = SEGMENT // 2 + 1
BANDS = DENSITIES + 1


def _floats(cell: bytes, kind=np.float64) -> np.ndarray:
    return np.frombuffer(cell, kind)


def _pieces(rows: DataFrame) -> DataFrame:
    """(s, t, v) in order of time, in pieces of at most an Arrow batch. Equal times go by
    value."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq = TaskContext.get().partitionId(), 0
        for pdf in batches:
            names, t, v = pdf["s"].to_numpy(), pdf["t"].to_numpy(np.float64), pdf["v"].to_numpy(np.float64)
            ends = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1), len(names)]
            out = []
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                if a == b:
                    continue
                good = a + np.flatnonzero(~np.isnan(v[a:b]))
                known = [good[0] - a, v[good[0]], good[-1] - a, v[good[-1]]] if len(good) else [None] * 4
                out.append([names[a], part, seq, b - a, t[b - 1], *known, t[a:b].tobytes(), v[a:b].tobytes()])
                seq += 1
            yield pd.DataFrame(out, columns=["s", "part", "seq", "n", "last_time", "first_at", "first_v", "last_at", "last_v", "t", "v"])

    ordered = rows.repartitionByRange("s", "t", "v").sortWithinPartitions("s", "t", "v")
    return ordered.mapInPandas(cut, "s string, part int, seq int, n long, last_time double, first_at double, first_v double, last_at double, last_v double, t binary, v binary")


def _filled(pieces: DataFrame) -> DataFrame:
    """Pieces with their position, missing values on the line between their neighbours,
    and the positive steps of time, those to the piece before included."""
    w = Window.partitionBy("s").orderBy("part", "seq")
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    known = lambda side: F.when(F.col("first_at").isNotNull(), F.struct((F.col("start") + F.col(f"{side}_at")).alias("at"), F.col(f"{side}_v").alias("v")))
    at = pieces.drop("t", "v").withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    at = at.withColumns({"_l": F.last(known("last"), True).over(before), "_r": F.first(known("first"), True).over(after), "earlier": F.lag("last_time").over(w)})
    at = at.select("s", "part", "seq", "start", "earlier", F.col("_l.at").alias("left_at"), F.col("_l.v").alias("left_v"), F.col("_r.at").alias("right_at"), F.col("_r.v").alias("right_v"))

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                v, t = _floats(r.v), _floats(r.t)
                x = r.start + np.arange(len(v), dtype=np.float64)
                good = ~np.isnan(v)
                ends = [(a, y) for a, y in ((r.left_at, r.left_v), (r.right_at, r.right_v)) if not pd.isna(a)]
                xs = np.concatenate([[a for a, _ in ends if a < r.start], x[good], [a for a, _ in ends if a > r.start]])
                ys = np.concatenate([[y for a, y in ends if a < r.start], v[good], [y for a, y in ends if a > r.start]])
                v = np.interp(x, xs, ys)
                steps = np.diff(t, prepend=r.earlier if not pd.isna(r.earlier) else t[0])
                out.append([r.s, r.start, len(v), v.sum(), v.tobytes(), steps[np.isfinite(steps) & (steps > 0)]])
            yield pd.DataFrame(out, columns=["s", "start", "size", "total", "v", "steps"])

    joined = pieces.select("s", "part", "seq", "t", "v").join(at, ["s", "part", "seq"])
    return joined.mapInPandas(fill, "s string, start long, size long, total double, v binary, steps array<double>")


# ----------------------------------------------------- blocks: Welch, wavelet


def dwt_part(x: np.ndarray, lo: int, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """What positions lo to lo + len(x) of n values tell of one level of the wavelet
    transform: (approximation, detail, place of their first)."""
    edge, hi = len(signal.DB4_LOW) - 1, lo + len(x)
    left = x[:edge][::-1] if lo == 0 else x[:0]
    right = x[-edge:][::-1] if hi == n else x[:0]
    first = 0 if lo == 0 else (lo + edge) // 2
    count = ((n + edge) // 2 if hi == n else hi // 2) - first
    skip = 2 * first + 1 - edge - lo + len(left)
    long = np.concatenate([left, x, right])
    return *(np.convolve(long, c, "valid")[skip::2][:count] for c in (signal.DB4_LOW, signal.DB4_HIGH)), first


def block_sums(x: np.ndarray, lo: int, n: int, begin: int, end: int) -> np.ndarray:
    """Sums over the segments and coefficients that begin in [begin, end) of a series of n
    values, of which ``x`` holds those from ``lo`` on. ``begin`` is a multiple of 128;
    ``end`` is one too, or n."""
    out = np.zeros(BANDS + signal.LEVELS + 1)
    starts = np.arange(begin, min(end, n - SEGMENT + 1), SEGMENT // 2)
    if len(starts):
        parts = np.lib.stride_tricks.sliding_window_view(x, SEGMENT)[starts - lo]
        out[:DENSITIES], out[DENSITIES] = signal.densities(parts, 1.0).sum(axis=0), len(starts)
    is_last = end == n
    for level in range(1, signal.LEVELS + 1):
        x, detail, lo = dwt_part(x, lo, n)
        n = (n + len(signal.DB4_LOW) - 1) // 2
        own = slice((begin >> level) - lo, (n if is_last else end >> level) - lo)
        out[BANDS + 1 + signal.LEVELS - level] = (detail[own] ** 2).sum()
    out[BANDS] = (x[own] ** 2).sum()
    return out


def _block_sums(filled: DataFrame, block: int) -> DataFrame:
    """(s, sums): densities, their number and the energy of the bands, of a whole series."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                v, end = _floats(r.v), r.start + r.size
                for j in range(max((r.start - AFTER) // block, 0), min((end - 1 + BEFORE) // block, (r.n - 1) // block) + 1):
                    a, b = max(r.start, j * block - BEFORE), min(end, (j + 1) * block + AFTER)
                    if a < b:
                        out.append([r.s, r.n, j, a, v[a - r.start : b - r.start].tobytes()])
            yield pd.DataFrame(out, columns=["s", "n", "j", "a", "v"])

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("a")
        n, j = int(pdf["n"].iloc[0]), int(pdf["j"].iloc[0])
        x = np.concatenate([_floats(v) for v in pdf["v"]])
        out = block_sums(x, int(pdf["a"].iloc[0]), n, j * block, min((j + 1) * block, n))
        return pd.DataFrame({"s": pdf["s"].iloc[0], "k": np.arange(len(out)), "value": out})

    parts = filled.select("s", "n", "start", "size", "v").mapInPandas(cut, "s string, n long, j long, a long, v binary")
    each = parts.groupBy("s", "j").applyInPandas(sums, "s string, k int, value double")
    total = each.groupBy("s", "k").agg(F.sum("value").alias("value"))
    return total.groupBy("s").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda x: x["value"]).alias("sums"))  # 135 values


# ------------------------------------------------------- Fourier transform


def grid(n: int, cell: int) -> tuple[int, int, int, int]:
    """Rows and columns of the matrix of a series of n values, and how many columns and
    how many rows a group holds; all are powers of two."""
    bits = max(2 * n - 2, 1).bit_length()
    rows = 1 << (bits // 2)
    columns = (1 << bits) // rows
    return rows, columns, min(max(cell // rows, 1), columns), min(max(cell // columns, 1), rows)


def chirp(i: np.ndarray, n: int) -> np.ndarray:
    """exp(-pi sqrt(-1) i**2 / n), the square taken modulo 2 n in integers."""
    return np.exp(-1j * np.pi / n * (i * i % (2 * n)))


def _turn(a: np.ndarray, b: np.ndarray, m: int) -> np.ndarray:
    return np.exp(-2j * np.pi / m * (np.multiply.outer(a, b) % m))


def _magnitudes(filled: DataFrame, cell: int) -> DataFrame:
    """(s, energy, size_sum, top_at) over the n // 2 + 1 frequencies of a series without
    its mean. Values go to columns (place modulo the number of columns), are transformed
    along them, go to rows and back to columns; a group is a set of columns or rows."""

    def to_columns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                _, columns, wide, _ = grid(r.n, cell)
                i = np.arange(r.start, r.start + r.size, dtype=np.int64)
                v = (_floats(r.v) - r.mean) * chirp(i, r.n)
                for part, at in zip(np.split(v, np.flatnonzero(i[1:] % wide == 0) + 1), np.concatenate([i[:1], i[1:][i[1:] % wide == 0]]), strict=True):
                    out.append([r.s, r.n, at % columns // wide, at, part.tobytes()])
            yield pd.DataFrame(out, columns=["s", "n", "g", "at", "v"])

    def along_columns(pdf: pd.DataFrame) -> pd.DataFrame:
        s, n, g = pdf["s"].iloc[0], int(pdf["n"].iloc[0]), int(pdf["g"].iloc[0])
        rows, columns, wide, high = grid(n, cell)
        m, here = rows * columns, np.arange(g * wide, (g + 1) * wide, dtype=np.int64)
        a = np.zeros((rows, wide), complex)
        for at, v in zip(pdf["at"], pdf["v"], strict=True):
            part = _floats(v, complex)
            a[at // columns, at % columns - g * wide :][: len(part)] = part
        i = np.arange(rows, dtype=np.int64)[:, None] * columns + here
        i = np.minimum(i, m - i)
        b = np.where(i < n, chirp(np.minimum(i, n), n).conj(), 0)
        both = np.fft.fft(np.stack([a, b]), axis=1) * _turn(np.arange(rows), here, m)
        return pd.DataFrame([[s, n, r, g, both[:, r * high : (r + 1) * high].tobytes()] for r in range(rows // high)], columns=["s", "n", "r", "g", "v"])

    def along_rows(pdf: pd.DataFrame) -> pd.DataFrame:
        s, n, r = pdf["s"].iloc[0], int(pdf["n"].iloc[0]), int(pdf["r"].iloc[0])
        rows, columns, wide, high = grid(n, cell)
        both = np.empty((2, high, columns), complex)
        for g, v in zip(pdf["g"], pdf["v"], strict=True):
            both[:, :, g * wide : (g + 1) * wide] = _floats(v, complex).reshape(2, high, wide)
        product = np.prod(np.fft.fft(both, axis=2), axis=0)
        z = np.fft.ifft(product, axis=1) * _turn(np.arange(r * high, (r + 1) * high), np.arange(columns), rows * columns).conj()
        return pd.DataFrame([[s, n, g, r, z[:, g * wide : (g + 1) * wide].tobytes()] for g in range(columns // wide)], columns=["s", "n", "g", "r", "v"])

    def back(pdf: pd.DataFrame) -> pd.DataFrame:
        s, n, g = pdf["s"].iloc[0], int(pdf["n"].iloc[0]), int(pdf["g"].iloc[0])
        rows, columns, wide, high = grid(n, cell)
        z = np.empty((rows, wide), complex)
        for r, v in zip(pdf["r"], pdf["v"], strict=True):
            z[r * high : (r + 1) * high] = _floats(v, complex).reshape(high, wide)
        at = np.arange(rows)[:, None] * columns + np.arange(g * wide, (g + 1) * wide)
        size, at = np.abs(np.fft.ifft(z, axis=0))[at <= n // 2], at[at <= n // 2]
        top = at[size.argmax()] if len(size) else None
        return pd.DataFrame({"s": [s], "energy": (size**2).sum(), "size_sum": size.sum(), "top": size.max() if len(size) else None, "at": [top]})

    parts = filled.select("s", "n", "mean", "start", "size", "v").mapInPandas(to_columns, "s string, n long, g long, at long, v binary")
    turned = parts.groupBy("s", "g").applyInPandas(along_columns, "s string, n long, r long, g long, v binary")
    crossed = turned.groupBy("s", "r").applyInPandas(along_rows, "s string, n long, g long, r long, v binary")
    sizes = crossed.groupBy("s", "g").applyInPandas(back, "s string, energy double, size_sum double, top double, at long")
    return sizes.groupBy("s").agg(F.sum("energy").alias("energy"), F.sum("size_sum").alias("size_sum"), F.max_by("at", F.struct("top", -F.col("at"))).alias("top_at"))


# ------------------------------------------------------------- the features


def _long_features(rows: DataFrame, sizes: DataFrame, block: int, cell: int) -> DataFrame:
    """(s, features) of (s, t, v) rows whose sizes are (s, n)."""
    filled = staged(_filled(staged(_pieces(rows), "pieces")), "filled")
    rate = quantiles(filled.select("s", F.explode("steps").alias("step")), "step", {"step": 0.5}, ["s"]).select("s", (1000.0 / F.col("step")).alias("rate"))
    totals = filled.groupBy("s").agg(F.sum("total").alias("_sum")).join(sizes, "s").select("s", "n", (F.col("_sum") / F.col("n")).alias("mean"))
    placed = filled.drop("steps", "total").join(totals, "s")
    names = [c.split()[0] for c in signal.FEATURES.split(", ")]

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                rate = math.nan if pd.isna(r.rate) else r.rate
                bins, sums = r.n // 2 + 1, np.asarray(r.sums)
                mean = r.size_sum / bins
                fft = [r.energy, mean, math.sqrt(max(r.energy / bins - mean**2, 0.0)), r.top_at * rate / r.n]
                density = sums[:DENSITIES] / sums[DENSITIES]
                welch = signal.density_features(np.fft.rfftfreq(SEGMENT, 1 / rate), density / rate) if math.isfinite(rate) else [math.nan] * 3
                out.append([r.s, r.n, rate, *fft, *welch, *signal.band_features(sums[BANDS:])])
            yield pd.DataFrame(out, columns=["s", *names])

    whole = _magnitudes(placed, cell).join(_block_sums(placed, block), "s").join(sizes, "s").join(rate, "s", "left")
    return whole.mapInPandas(finish, "s string, " + signal.FEATURES)


def spectral_features(df: DataFrame, keys: Sequence[str], time: str = "time_ms", value: str = "value", min_samples: int = signal.MIN_SAMPLES, longest: int = LONGEST, cell: int = CELL) -> DataFrame:
    """``signal.spectral_features`` for series of any length up to 3 * 10**9 samples, whose
    squared places fit a long; a longer one is an error. One row per series; keys must not
    be null. Series with a time that isn't finite, without a value, or shorter than
    ``min_samples`` give no row; extra columns are ignored; an empty table gives none."""
    if longest < 4 * BEFORE or longest % (SEGMENT // 2):
        raise ValueError(f"longest must be a multiple of {SEGMENT // 2}, {4 * BEFORE} at least")
    rows = df.select(*keys, F.col(time).cast("double").alias(time), F.col(value).cast("double").alias(value))
    t, v = F.col(time), F.col(value)
    finite = t.isNotNull() & ~F.isnan(t) & (F.abs(t) != math.inf)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.bool_and(finite).alias("timed"), F.bool_or(v.isNotNull() & ~F.isnan(v)).alias("valued"))
    long = staged(counts.where(F.col("n") > longest).withColumn("s", F.sha2(F.to_json(F.struct(*keys)), 256)), "long")
    most = long.agg(F.max("n")).head()[0]
    if most is None:
        return signal.spectral_features(rows, keys, time, value, min_samples)
    if most > 3_000_000_000:
        raise ValueError(f"a series has {most} samples")
    short = signal.spectral_features(rows.join(long, list(keys), "left_anti"), keys, time, value, min_samples)
    usable = long.where(F.col("timed") & F.col("valued") & (F.col("n") >= min_samples))
    cut = rows.join(usable.select(*keys, "s"), list(keys)).select("s", t.alias("t"), v.alias("v"))
    found = _long_features(cut, usable.select("s", "n"), longest, cell)
    return short.unionByName(usable.select(*keys, "s").join(found, "s").drop("s"))
