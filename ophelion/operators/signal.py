"""Time series: window checks in the JVM, spectral features in numpy per series.

A series is the rows of one key; it is one recording. ``spectral_features`` here takes a
series as one group, so it has to fit a worker; ``recordings`` cuts longer ones. Keys are
spread by the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import first_ids

MIN_SAMPLES, LEVELS = 32, 5
#: The decomposition low-pass filter of the Daubechies wavelet with four
#: vanishing moments.
DB4_LOW = (
    -0.010597401785069032, 0.0328830116668852, 0.030841381835560764, -0.18703481171909309,
    -0.027983769416859854, 0.6308807679298589, 0.7148465705529157, 0.2303778133088965,
)
DB4_HIGH = tuple((-1) ** (k + 1) * c for k, c in enumerate(reversed(DB4_LOW)))
FEATURES = (
    "signal_length int, sampling_rate_hz double, fft_energy_total double, fft_magnitude_mean double, fft_magnitude_std double, fft_dominant_freq_hz double, "
    "welch_peak_freq_hz double, welch_total_energy double, welch_spectral_centroid_hz double, wavelet_total_energy double, "
    + ", ".join(f"wavelet_energy_l{i} double, wavelet_rel_energy_l{i} double" for i in range(1, LEVELS + 1))
    + ", wavelet_entropy double"
)


def _in_time(keys: Sequence[str], time: str):
    return Window.partitionBy(*keys).orderBy(time)


def time_steps(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    return df.withColumn("step", F.col(time) - F.lag(time).over(_in_time(keys, time)))


def sampling_rate(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """1000 over the median positive step in milliseconds; null without one."""
    steps = time_steps(df, keys, time)
    return steps.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), (1000.0 / F.median(F.when(F.col("step") > 0, F.col("step")))).alias("sampling_rate_hz"))


def time_gaps(df: DataFrame, keys: Sequence[str], time: str, factor: float = 3.0) -> DataFrame:
    """Per series the median and the greatest step, and whether there is a gap."""
    steps = time_steps(df, keys, time).where("step is not null")
    out = steps.groupBy(*keys).agg(F.median("step").alias("median_step"), F.max("step").alias("max_step"))
    return out.withColumn("has_gap", F.col("max_step") > factor * F.col("median_step"))


def order_breaks(df: DataFrame, keys: Sequence[str], time: str, row_id: str) -> DataFrame:
    """Per series, how often time goes back in input order."""
    back = F.col(time) < F.lag(time).over(Window.partitionBy(*keys).orderBy(row_id))
    return df.withColumn("_back", back).groupBy(*keys).agg(F.count_if("_back").alias("breaks")).withColumn("in_order", F.col("breaks") == 0)


def interpolate(df: DataFrame, keys: Sequence[str], order: str, value: str, to: str = "filled") -> DataFrame:
    """Missing values on the line between their neighbours by row position, the ends
    with the nearest value; a series without any value stays null."""
    w = Window.partitionBy(*keys).orderBy(order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    good = F.when(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    numbered = df.withColumns({"_n": F.row_number().over(w), "_v": good})
    at = F.when(F.col("_v").isNotNull(), F.struct("_n", "_v"))
    both = numbered.withColumns({"_p": F.last(at, True).over(back), "_q": F.first(at, True).over(ahead)})
    share = F.try_divide(F.col("_n") - F.col("_p._n"), F.col("_q._n") - F.col("_p._n"))
    line = F.col("_p._v") + (F.col("_q._v") - F.col("_p._v")) * F.coalesce(share, F.lit(0.0))
    return both.withColumn(to, F.coalesce("_v", line, F.col("_p._v"), F.col("_q._v"))).drop("_n", "_v", "_p", "_q")


def signal_sizes(df: DataFrame, keys: Sequence[str], small: int = 50) -> DataFrame:
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("signals"), F.min("n").alias("least"), F.percentile("n", 0.5).alias("median"), F.max("n").alias("most"), F.count_if(F.col("n") < small).alias("small"))


def curves(df: DataFrame, patient: str, keys: Sequence[str], order: str, patients: int = 3, rows: int = 20_000, points: int = 2_000) -> DataFrame:
    """What a plot of the first ``patients`` shows: of each the first ``rows`` rows, and
    of each curve (a value of ``keys``, its ``label``) every k-th point, k the whole part
    of its length over ``points``, 1 at least. Null patients have no curve."""
    some = first_ids(df.where(F.col(patient).isNotNull()), patient, order, patients)
    own = Window.partitionBy(patient).orderBy(order, *keys)
    head = df.join(some, patient, "left_semi").withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= rows)
    curve = Window.partitionBy(patient, *keys)
    step = F.greatest(F.floor(F.count(F.lit(1)).over(curve) / points), F.lit(1))
    label = F.concat_ws(" | ", *(F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit(""))) for k in keys))
    placed = head.withColumns({"_step": step, "_k": F.row_number().over(curve.orderBy("_n")) - 1, "label": label})
    return placed.where(F.col("_k") % F.col("_step") == 0).drop("_n", "_k", "_step")


# --------------------------------------------------------------- one series


def fill_line(x: np.ndarray) -> np.ndarray | None:
    good = np.flatnonzero(~np.isnan(x))
    return None if not len(good) else np.interp(np.arange(len(x)), good, x[good])


def rate_of(time_ms: np.ndarray) -> float:
    steps = np.diff(time_ms)
    steps = steps[np.isfinite(steps) & (steps > 0)]
    return 1000.0 / float(np.median(steps)) if len(steps) else math.nan


def fft_features(x: np.ndarray, rate: float) -> list[float]:
    size = np.abs(np.fft.rfft(x - x.mean()))
    top = float(np.fft.rfftfreq(len(x), 1 / rate)[size.argmax()]) if math.isfinite(rate) else math.nan
    return [float((size**2).sum()), float(size.mean()), float(size.std()), top]


def densities(parts: np.ndarray, rate: float) -> np.ndarray:
    """Power density of each row, a segment under a Hann window and without its mean."""
    n = parts.shape[1]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    power = np.abs(np.fft.rfft((parts - parts.mean(axis=1, keepdims=True)) * window)) ** 2 / (rate * (window**2).sum())
    power[:, 1 : None if n % 2 else -1] *= 2
    return power


def welch(x: np.ndarray, rate: float, longest: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Power density by Welch's method: Hann windows of up to 256 samples, half
    overlapping, each without its mean."""
    n = min(longest, len(x))
    parts = np.lib.stride_tricks.sliding_window_view(x, n)[:: n - n // 2]
    return np.fft.rfftfreq(n, 1 / rate), densities(parts, rate).mean(axis=0)


def density_features(f: np.ndarray, p: np.ndarray) -> list[float]:
    """Peak, energy and centroid of densities ``p`` at frequencies ``f``."""
    total = p.sum()
    return [float(f[p.argmax()]), float(np.trapezoid(p, f)), float((f * p).sum() / total) if total > 0 else math.nan]


def welch_features(x: np.ndarray, rate: float) -> list[float]:
    if not math.isfinite(rate) or len(x) < 8:
        return [math.nan] * 3
    return density_features(*welch(x, rate))


def dwt(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level of the wavelet transform with symmetric ends: (approximation, detail)."""
    edge = len(DB4_LOW) - 1
    at = np.arange(-edge, len(x) + edge) % (2 * len(x))
    long = x[np.where(at < len(x), at, 2 * len(x) - 1 - at)]
    return tuple(np.convolve(long, c, "valid")[1::2] for c in (DB4_LOW, DB4_HIGH))


def wavelet_features(x: np.ndarray, most: int = LEVELS) -> list[float]:
    """Total energy, energy and share of the first ``most`` bands, entropy of the
    shares. Bands come approximation first; with all levels the finest band counts in
    the total only."""
    reach = int(math.log2(len(x) / (len(DB4_LOW) - 1))) if len(x) >= len(DB4_LOW) - 1 else 0
    details, rest = [], x
    for _ in range(max(1, min(most, reach))):
        rest, detail = dwt(rest)
        details.append(detail)
    return band_features(np.array([(b**2).sum() for b in (rest, *reversed(details))]), most)


def band_features(energy: np.ndarray, most: int = LEVELS) -> list[float]:
    """What ``wavelet_features`` tells of the energies of the bands."""
    total = energy.sum()
    shown = energy[:most]
    share = shown / total if total > 0 else np.full(len(shown), math.nan)
    out = [float(total)]
    for i in range(most):
        out += [float(shown[i]), float(share[i])] if i < len(shown) else [math.nan, math.nan]
    some = share[np.isfinite(share) & (share > 0)]
    return [*out, float(-(some * np.log2(some)).sum()) if len(some) else math.nan]


def series_features(time_ms: np.ndarray, values: np.ndarray, min_samples: int = MIN_SAMPLES) -> list[float] | None:
    """All features of one series in time order; None where it is rejected."""
    order = np.argsort(time_ms, kind="stable")
    time_ms, values = time_ms[order], values[order]
    if not np.isfinite(time_ms).all():
        return None
    x = fill_line(values)
    if x is None or len(x) < min_samples:
        return None
    rate = rate_of(time_ms)
    return [len(x), rate, *fft_features(x, rate), *welch_features(x, rate), *wavelet_features(x)]


def spectral_features(df: DataFrame, keys: Sequence[str], time: str = "time_ms", value: str = "value", min_samples: int = MIN_SAMPLES) -> DataFrame:
    """One row of features per series; keys must not be null (fill them before)."""
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", " + FEATURES
    names = [c.split()[0] for c in FEATURES.split(", ")]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        row = series_features(pdf[time].to_numpy(np.float64), pdf[value].to_numpy(np.float64), min_samples)
        rows = [] if row is None else [[*key, *row]]
        return pd.DataFrame(rows, columns=[*keys, *names])

    return df.select(*keys, F.col(time).cast("double"), F.col(value).cast("double")).groupBy(*keys).applyInPandas(run, schema)


def fill_dims(df: DataFrame, required: Sequence[str], dims: Sequence[str], unknown: str = "unknown") -> DataFrame:
    """Drops rows with a null key and fills unknown dimensions."""
    return df.dropna(subset=list(required)).withColumns({d: F.coalesce(F.col(d).cast("string"), F.lit(unknown)) for d in dims})
