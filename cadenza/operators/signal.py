"""Envelopes, trimming and lags of signals.

Long signals stay rows (series, idx, v): windows of samples are groups, so a series can
be as long as it likes. Correlation of two envelopes, some thousand values each, is one
vectorised call for each pair in an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rates and windows of the analysis.
SAMPLE_RATE, SIGNATURE_HZ = 11_025, 20
WINDOW, TRIM_WINDOW = 551, 1102
TRIM_FLOOR, TRIM_SHARE, TRIM_QUANTILE = 0.005, 0.15, 0.70


def rms_envelope(samples: DataFrame, window: int) -> DataFrame:
    """(series, win, rms) of whole windows; a part of one counts only where it is all there is."""
    wins = samples.groupBy("series", F.floor(F.col("idx") / window).alias("win")).agg(F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"), F.count(F.lit(1)).alias("n"))
    return wins.where((F.col("n") == window) | (F.col("win") == 0)).select("series", "win", "rms")


def zscore(values: DataFrame, col: str, key: str = "series") -> DataFrame:
    """The column with mean 0 and population deviation 1; zeros where the deviation is below 1e-6."""
    stats = values.groupBy(key).agg(F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"))
    z = F.when(F.col("std") < 1e-6, 0.0).otherwise((F.col(col) - F.col("mean")) / F.col("std"))
    return values.join(stats, key).withColumn(col, z).drop("mean", "std")


def trim_bounds(samples: DataFrame, window: int = TRIM_WINDOW) -> DataFrame:
    """(series, first, last): the range of idx, last excluded, between the first and last loud window, one more on either side."""
    envelope = rms_envelope(samples, window)
    limit = envelope.groupBy("series").agg(F.greatest(F.lit(TRIM_FLOOR), F.percentile("rms", F.lit(TRIM_QUANTILE)) * TRIM_SHARE).alias("limit"))
    active = envelope.join(limit, "series").groupBy("series").agg(F.min(F.when(F.col("rms") >= F.col("limit"), F.col("win"))).alias("lo"), F.max(F.when(F.col("rms") >= F.col("limit"), F.col("win"))).alias("hi"))
    size = samples.groupBy("series").agg((F.max("idx") + 1).alias("size"))
    return size.join(active, "series", "left").select(
        "series", F.coalesce(F.greatest(F.lit(0), (F.col("lo") - 1) * window), F.lit(0)).alias("first"), F.coalesce(F.least("size", (F.col("hi") + 2) * window), F.col("size")).alias("last")
    )


def signature(samples: DataFrame, window: int = WINDOW, trim: bool = True, trim_window: int = TRIM_WINDOW) -> DataFrame:
    """(series, win, v): the z-scored logarithmic envelope, of the trimmed samples or of all."""
    if trim:
        bounds = trim_bounds(samples, trim_window)
        samples = samples.join(bounds, "series").where((F.col("idx") >= F.col("first")) & (F.col("idx") < F.col("last"))).select("series", (F.col("idx") - F.col("first")).alias("idx"), "v")
    envelope = rms_envelope(samples, window).select("series", "win", F.log1p(20 * F.col("rms")).alias("v"))
    return zscore(envelope, "v")


def envelope_array(samples: np.ndarray, window: int) -> np.ndarray:
    """rms_envelope's values of one series held as an array."""
    whole = len(samples) // window * window
    rows = samples[:whole].reshape(-1, window) if whole else samples[None, :]
    return np.sqrt(np.mean(np.square(rows, dtype=float), axis=1)) if len(samples) else np.zeros(0)


def trimmed_array(samples: np.ndarray, window: int = TRIM_WINDOW) -> np.ndarray:
    """The samples between trim_bounds."""
    envelope = envelope_array(samples, window)
    if not len(envelope):
        return samples
    loud = np.flatnonzero(envelope >= max(TRIM_FLOOR, float(np.quantile(envelope, TRIM_QUANTILE)) * TRIM_SHARE))
    return samples[max(0, (loud[0] - 1) * window) : (loud[-1] + 2) * window] if len(loud) else samples


def signature_array(samples: np.ndarray, trim: bool = True, window: int = WINDOW) -> np.ndarray:
    """signature's values of one series held as an array."""
    v = np.log1p(20 * envelope_array(trimmed_array(samples) if trim else samples, window))
    std = float(v.std()) if len(v) else 0.0
    return np.zeros(len(v)) if std < 1e-6 else (v - v.mean()) / std


#: Products of lengths above which a sliding product goes by FFT, and the least block of it.
DIRECT, BLOCK = 1 << 20, 1 << 14


def sliding_products(long: np.ndarray, short: np.ndarray) -> np.ndarray:
    """The product of short with each stretch of long that is as long, in order.

    Small ones are summed directly; others by overlap-save: blocks of long, each with as
    much of the next one as short is long, are transformed once, multiplied, and give the
    products that lie whole in the block. Memory is that of a block and the result.
    """
    n, m = len(long), len(short)
    if n * m <= DIRECT or m < 64:
        return np.correlate(long, short, "valid")
    size = max(BLOCK, 1 << (4 * m - 1).bit_length())
    size = min(size, 1 << (n - 1).bit_length())
    spectrum = np.conj(np.fft.rfft(short, size))
    step = size - m + 1
    out = np.empty(n - m + 1)
    for at in range(0, n - m + 1, step):
        block = np.fft.irfft(np.fft.rfft(long[at : at + size], size) * spectrum, size)
        take = min(step, n - m + 1 - at)
        out[at : at + take] = block[:take]
    return out


def sliding_similarity(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """(score, seconds): the best normalised product of the shorter series with a stretch of the longer; the seconds have no sign.

    Energies of stretches are differences of one prefix sum. Scores that rounding alone
    tells apart count as equal, and the first of them stands.
    """
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    norm = float(np.sqrt(np.dot(short, short))) if len(short) else 0.0
    if norm < 1e-6:
        return 0.0, 0.0
    products = sliding_products(long, short)
    squares = np.concatenate(([0.0], np.cumsum(long * long)))
    norms = np.sqrt(np.maximum(squares[len(short) :] - squares[: -len(short)], 1e-12))
    scores = np.where(norms > 1e-6, products / (norm * norms), 0.0)
    at = int(np.argmax(scores >= scores.max() - 1e-12))
    return float(np.clip(scores[at], 0, 1)), at / SIGNATURE_HZ


def sync_lag(master: np.ndarray, other: np.ndarray, frame_rate: float) -> tuple[int, float, float, int]:
    """(lag, confidence, seconds, frames): by how much other begins later than master (signed), from a full correlation by FFT."""
    n = len(master) + len(other) - 1
    norm = float(np.sqrt(np.dot(master, master) * np.dot(other, other))) if n > 0 else 0.0
    if norm < 1e-6:
        return 0, 0.0, 0.0, 0
    size = 1 << (n - 1).bit_length()
    full = np.fft.irfft(np.fft.rfft(master, size) * np.conj(np.fft.rfft(other, size)), size)
    lags = np.arange(-(len(other) - 1), len(master))
    values = full[lags]
    at = int(np.flatnonzero(values >= values.max() - 1e-9 * norm)[0])
    seconds = int(lags[at]) / SIGNATURE_HZ
    return int(lags[at]), float(values[at] / norm), seconds, int(np.rint(seconds * frame_rate))


def pair_similarity(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """The pairs with waveform_score and estimated_offset_seconds of two array columns; null counts as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        empty = np.zeros(0)
        for df in batches:
            found = [sliding_similarity(*(empty if x is None else np.asarray(x, float) for x in p)) for p in zip(df[left], df[right], strict=True)]
            df["waveform_score"], df["estimated_offset_seconds"] = [s for s, _ in found], [o for _, o in found]
            yield df.drop(columns=[left, right])

    rest = [f for f in pairs.schema.fields if f.name not in (left, right)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "waveform_score double", "estimated_offset_seconds double"])
    return pairs.select(*(f.name for f in rest), left, right).mapInPandas(run, schema)


def sync_offsets(pairs: DataFrame, master: str, other: str, frame_rate: float) -> DataFrame:
    """The pairs with lag, sync_confidence, offset_seconds and offset_frames of two array columns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            found = [sync_lag(np.asarray(m, float), np.asarray(o, float), frame_rate) for m, o in zip(df[master], df[other], strict=True)]
            for i, c in enumerate(("lag", "sync_confidence", "offset_seconds", "offset_frames")):
                df[c] = [x[i] for x in found]
            yield df.drop(columns=[master, other])

    rest = [f for f in pairs.schema.fields if f.name not in (master, other)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "lag long, sync_confidence double, offset_seconds double, offset_frames long"])
    return pairs.select(*(f.name for f in rest), master, other).mapInPandas(run, schema)


def as_arrays(series: DataFrame, index: str = "win", value: str = "v", key: str = "series") -> DataFrame:
    """(series, values): an envelope as one array for each series."""
    rows = series.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(index, value))).alias("x"))
    return rows.select(key, F.transform("x", lambda r: r[value]).alias("values"))


def running(col: Column | str, *keys: str, order: str) -> Column:
    """The sum over all rows before this one, 0 at first."""
    return F.coalesce(F.sum(col).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
