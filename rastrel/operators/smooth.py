"""Majority smoothing of class maps along a roof's main axis, one chip a group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def main_angle(mask: np.ndarray) -> float:
    """Degrees of the axis along which the mask's pixels spread most; 0 for fewer than 50 pixels."""
    r, c = np.nonzero(mask)
    if len(r) < 50:
        return 0.0
    vectors = np.linalg.eigh(np.cov(c.astype(float), r.astype(float)))[1]
    return float(np.degrees(np.arctan2(vectors[1, -1], vectors[0, -1])))


def turned(values: np.ndarray, degrees: float, outside: int) -> np.ndarray:
    """values turned counter-clockwise on screen about the middle of the frame, each pixel from the nearest one it comes from."""
    height, width = values.shape
    r, c = np.mgrid[:height, :width]
    y, x = r - height / 2, c - width / 2
    cos, sin = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    from_c = np.rint(cos * x - sin * y + width / 2).astype(int)
    from_r = np.rint(sin * x + cos * y + height / 2).astype(int)
    inside = (from_r >= 0) & (from_r < height) & (from_c >= 0) & (from_c < width)
    return np.where(inside, values[from_r.clip(0, height - 1), from_c.clip(0, width - 1)], outside)


def box_sums(values: np.ndarray, short: int, long: int) -> np.ndarray:
    """Sums over boxes of short rows and long columns around each pixel, zero beyond the frame."""
    height, width = values.shape
    padded = np.zeros((height + short, width + long), np.int64)
    padded[short // 2 + 1 : short // 2 + 1 + height, long // 2 + 1 : long // 2 + 1 + width] = values
    total = padded.cumsum(0).cumsum(1)
    return total[short:, long:] - total[:-short, long:] - total[short:, :-long] + total[:-short, :-long]


def smoothed(classes: np.ndarray, mask: np.ndarray, long: int = 45, short: int = 5) -> np.ndarray:
    """Each masked pixel's most frequent class in a box along the mask's main axis, the lowest of equals; -1 outside and where turning leaves the frame."""
    angle = main_angle(mask)
    level, level_mask = turned(classes, angle, -1), turned(mask.astype(int), angle, 0)
    if not (level >= 0).any():
        return classes
    counts = np.stack([box_sums(level == k, short, long) for k in range(level.max() + 1)])
    best = np.where(level_mask > 0, counts.argmax(axis=0), -1)
    return np.where(mask > 0, turned(best, -angle, -1), -1)


def smooth_classes(pixels: DataFrame, long: int = 45, short: int = 5) -> DataFrame:
    """(chip, r, c, k) of pixels(chip, r, c, k, m), m 1 on the roof: classes smoothed along each roof's axis, -1 off the roof.

    A chip is one group, bounded by the size of a building's image; pixels a chip lacks count as off the roof.
    """

    def one(chip: pd.DataFrame) -> pd.DataFrame:
        r, c = (chip["r"] - chip["r"].min()).to_numpy(), (chip["c"] - chip["c"].min()).to_numpy()
        classes, mask = np.full((r.max() + 1, c.max() + 1), -1), np.zeros((r.max() + 1, c.max() + 1), int)
        classes[r, c], mask[r, c] = chip["k"].fillna(-1).astype(int), chip["m"].fillna(0).astype(int)
        return chip[["chip", "r", "c"]].assign(k=smoothed(classes, mask, long, short)[r, c])

    kinds = dict(pixels.dtypes)
    return pixels.select("chip", "r", "c", "k", "m").groupBy("chip").applyInPandas(one, f"chip {kinds['chip']}, r {kinds['r']}, c {kinds['c']}, k int")
