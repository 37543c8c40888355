"""Color features of pictures: histograms of hue, saturation and value, and moments of the three channels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of hue, saturation and value over 0..256.
BINS = (36, 16, 16)


def hsv(rgb: np.ndarray) -> np.ndarray:
    """Hue, saturation and value of (n, 3) pixels, each over 0..255 as whole numbers."""
    x = rgb.astype(np.float64)
    top, low = x.max(axis=1), x.min(axis=1)
    span = top - low
    safe = np.where(span > 0, span, 1)
    r, g, b = ((top[:, None] - x) / safe[:, None]).T
    hue = np.where(x[:, 0] == top, b - g, np.where(x[:, 1] == top, 2 + r - b, 4 + g - r)) / 6 % 1
    hue = np.where(span > 0, hue, 0)
    sat = np.where(top > 0, span / np.where(top > 0, top, 1), 0)
    return np.stack([np.floor(hue * 255), np.floor(sat * 255), top], axis=1)


def color_vector(rgb: np.ndarray) -> np.ndarray:
    """77 numbers: histograms that each sum to 1; mean / 256, deviation / 128 and skew / 5 of each channel."""
    parts = []
    for channel, bins in zip(hsv(rgb).T, BINS, strict=True):
        h = np.histogram(channel, bins=bins, range=(0, 256))[0].astype(np.float64)
        parts.append(h / max(h.sum(), 1))
    for channel in rgb.astype(np.float64).T:
        mean, std = channel.mean(), channel.std()
        skew = (((channel - mean) / max(std, 1.0)) ** 3).mean()
        parts.append(np.array([mean / 256, std / 128, skew / 5]))
    return np.concatenate(parts)


def features(pictures: DataFrame) -> DataFrame:
    """(hash, vec) of (hash, pixels), pixels being r, g, b, r, g, b, ..."""

    @F.pandas_udf("array<double>")
    def vector(pixels: pd.Series) -> pd.Series:
        return pixels.map(lambda p: color_vector(np.asarray(p).reshape(-1, 3)).tolist())

    return pictures.select("hash", vector("pixels").alias("vec"))
