"""Ability-to-pay features from peaks and valleys of an account's running net.

The series of one account is one group; a group's size is the account's days.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Prominence and amount due of the three settings.
SETTINGS = ((500.0, 200.0), (250.0, 100.0), (100.0, 40.0))
DISTANCE, LEAST_DAYS = 7, 3


def find_peaks(x: np.ndarray, distance: int, prominence: float) -> tuple[np.ndarray, np.ndarray]:
    """Places and prominences of local maxima: plateaus by their middle, highest first within ``distance``, then by prominence."""
    if len(x) < 3:
        return np.zeros(0, int), np.zeros(0)
    change = np.flatnonzero(np.diff(x))
    begin, end = np.concatenate(([0], change + 1)), np.concatenate((change, [len(x) - 1]))
    inner = np.arange(1, len(begin) - 1)
    top = inner[(x[begin[inner]] > x[begin[inner] - 1]) & (x[end[inner]] > x[end[inner] + 1])]
    peaks = (begin[top] + end[top]) // 2
    keep = np.ones(len(peaks), dtype=bool)
    for k in np.argsort(x[peaks], kind="stable")[::-1]:
        if keep[k]:
            near = np.abs(peaks - peaks[k]) < distance
            near[k] = False
            keep[near] = False
    peaks = peaks[keep]
    heights = np.empty(len(peaks))
    for k, p in enumerate(peaks):
        left = np.flatnonzero(x[:p] > x[p])
        right = np.flatnonzero(x[p + 1 :] > x[p])
        low_left = x[(left[-1] if len(left) else 0) : p + 1].min()
        low_right = x[p : (p + 1 + right[0] if len(right) else len(x))].min()
        heights[k] = x[p] - max(low_left, low_right)
    good = heights >= prominence
    return peaks[good], heights[good]


def good_days(x: np.ndarray, prominence: float, due: float, valleys: bool = False) -> np.ndarray:
    """Days on which enough of the last peak's prominence is left for what is due, in stretches of at least three
    days; on the negated series of valleys the flag is turned round."""
    series = -x if valleys else x
    peaks, heights = find_peaks(series, DISTANCE, prominence)
    out = np.zeros(len(x), dtype=bool)
    for k, (p, h) in enumerate(zip(peaks, heights)):
        stop = peaks[k + 1] if k + 1 < len(peaks) else len(x)
        out[p:stop] = h - (series[p] - series[p:stop]) > due
    edges = np.flatnonzero(np.diff(np.concatenate(([0], out.view(np.int8), [0]))))
    for a, b in zip(edges[::2], edges[1::2]):
        if b - a < LEAST_DAYS:
            out[a:b] = False
    return ~out if valleys else out


def peak_features(series: DataFrame) -> DataFrame:
    """Per account, kind (peak or valley) and setting: number, mean and largest prominence, mean gap in days, share
    of good days, number of good stretches and their mean length."""

    def of(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("date")
        x = group["running"].to_numpy(dtype=float)
        rows = []
        for kind in ("peak", "valley"):
            for prominence, due in SETTINGS:
                peaks, heights = find_peaks(-x if kind == "valley" else x, DISTANCE, prominence)
                good = good_days(x, prominence, due, kind == "valley")
                edges = np.flatnonzero(np.diff(np.concatenate(([0], good.view(np.int8), [0]))))
                lengths = edges[1::2] - edges[::2]
                rows.append((group["account"].iloc[0], kind, prominence, len(peaks), float(heights.mean()) if len(heights) else 0.0, float(heights.max()) if len(heights) else 0.0, float(np.diff(peaks).mean()) if len(peaks) > 1 else 0.0, float(good.mean()), len(lengths), float(lengths.mean()) if len(lengths) else 0.0))
        return pd.DataFrame(rows, columns=["account", "kind", "prominence", "n", "mean_prominence", "max_prominence", "mean_gap", "good_share", "stretches", "mean_stretch"])

    columns = "account string, kind string, prominence double, n int, mean_prominence double, max_prominence double, mean_gap double, good_share double, stretches int, mean_stretch double"
    return series.select("account", "date", F.col("running").cast("double")).groupBy("account").applyInPandas(of, columns)
