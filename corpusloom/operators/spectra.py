"""Spectra of clips: sums by bin over all clips, band reports, band shares. The transform runs in Arrow batches, everything
after it is relational."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def power_bins(clips: DataFrame, key: str, samples: str, window: int, hop: int) -> DataFrame:
    """(key, bin, power, frames): power summed over the frames of a clip, with a Hann window."""
    shape = np.hanning(window + 1)[:-1]

    def run(batches):
        for pdf in batches:
            out = []
            for k, x in zip(pdf[key], pdf[samples], strict=True):
                x = np.asarray(x, float)
                if len(x) < window:
                    x = np.pad(x, (0, window - len(x)))
                frames = np.lib.stride_tricks.sliding_window_view(x, window)[::hop] * shape
                power = (np.abs(np.fft.rfft(frames, axis=1)) ** 2).sum(0)
                out.append(pd.DataFrame({key: k, "bin": np.arange(len(power)), "power": power, "frames": len(frames)}))
            if out:
                yield pd.concat(out)

    kind = dict(clips.dtypes)[key]
    return clips.select(key, samples).mapInPandas(run, f"`{key}` {kind}, bin int, power double, frames long")


def average_spectrum(bins: DataFrame) -> DataFrame:
    """The corpus average in dB by bin."""
    return bins.groupBy("bin").agg((10 * F.log10(F.sum("power") / F.sum("frames") + 1e-12)).alias("db"))


def band_report(spectrum: DataFrame, bands: DataFrame) -> DataFrame:
    """Mean level and largest excess over the mean in each band (name, lo, hi of bins); bands are a short list."""
    both = spectrum.join(F.broadcast(bands), (F.col("bin") >= F.col("lo")) & (F.col("bin") < F.col("hi")))
    return both.groupBy("name").agg(F.round(F.avg("db"), 4).alias("mean_db"), F.round(F.max("db") - F.avg("db"), 4).alias("largest_excess"))


def band_shares(bins: DataFrame, key: str, bands: DataFrame) -> DataFrame:
    """The share of each band in a clip's power, in dB."""
    both = bins.join(F.broadcast(bands), (F.col("bin") >= F.col("lo")) & (F.col("bin") < F.col("hi")))
    by = both.groupBy(key, "name").agg(F.sum("power").alias("p"))
    whole = bins.groupBy(key).agg(F.sum("power").alias("total"))
    return by.join(whole, key).select(key, "name", F.round(10 * F.log10(F.col("p") / F.col("total") + 1e-12), 4).alias("share_db"))


def line_level(db: str, bin_: str, narrow: tuple[int, int], wide: tuple[int, int]) -> Column:
    """The maximum of a narrow band over the median of a wider one."""
    inside = lambda lo, hi: F.when((F.col(bin_) >= lo) & (F.col(bin_) < hi), F.col(db))
    return F.round(F.max(inside(*narrow)) - F.percentile(inside(*wide), F.lit(0.5)), 4)
