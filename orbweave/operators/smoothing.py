"""Spatial smoothing of class probabilities: iterated conditional modes on a Potts field, and empirical Bayes.

Both run on blocks with a halo wide enough that no border shows: as many cells as there are rounds, or half a window. With an overlap of one's own,
blocks see no more than that, and results depend on the blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .raster import by_block

BLOCK = (128, 128)


def offsets(neighborhood: int) -> list[tuple[int, int]]:
    """The 4 or 8 neighbours of a cell."""
    if neighborhood not in (4, 8):
        raise ValueError("neighborhood must be 4 or 8.")
    around = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if (r, c) != (0, 0)]
    return [o for o in around if neighborhood == 8 or 0 in o]


def icm(energy: np.ndarray, valid: np.ndarray, beta: float, neighborhood: int, rounds: int) -> np.ndarray:
    """Labels after so many rounds (one at least), all cells at once: the class with the most log-probability plus beta for each valid
    neighbour of its label, the first of equals. Cells that aren't valid are -1."""
    h, w, k = energy.shape
    safe = np.where(valid[..., None], energy, 0)
    label = np.where(valid, safe.argmax(axis=2), -1)
    for _ in range(max(1, rounds)):
        framed = np.full((h + 2, w + 2), -1)
        framed[1:-1, 1:-1] = label
        votes = np.zeros((h, w, k))
        for dr, dc in offsets(neighborhood):
            votes += framed[1 + dr : 1 + dr + h, 1 + dc : 1 + dc + w, None] == np.arange(k)
        label = np.where(valid, (safe + beta * votes).argmax(axis=2), -1)
    return label


def bayes(p: np.ndarray, valid: np.ndarray, window: int, fraction: float, smoothness: Sequence[float]) -> np.ndarray:
    """Each class's logit is drawn towards the mean of the largest `fraction` of those in the window, the more so the less these vary."""
    s = np.asarray(smoothness, float)
    if not s.any():
        return p
    q = np.clip(p, 1e-6, 1 - 1e-6)
    logit = np.log(q) - np.log1p(-q)
    h, w, k = p.shape
    pad = window // 2
    there = np.where(valid[..., None] & ~np.isnan(p), logit, -np.inf)
    framed = np.pad(there, ((pad, pad), (pad, pad), (0, 0)), constant_values=-np.inf)
    out = np.full(p.shape, np.nan)
    for r in range(h):  # a row of windows at a time
        near = np.lib.stride_tricks.sliding_window_view(framed[r : r + window], (window, window), axis=(0, 1))[0]
        near = -np.sort(-near.reshape(w, k, -1), axis=2)
        n = np.isfinite(near).sum(axis=2)
        keep = np.maximum(1, np.ceil(fraction * n - 1e-12)).astype(int)
        use = (np.arange(window * window) < keep[..., None]) & np.isfinite(near)
        count = use.sum(axis=2)
        mean = np.where(use, near, 0).sum(axis=2) / np.maximum(1, count)
        var = np.where(use, (np.where(use, near, 0) - mean[..., None]) ** 2, 0).sum(axis=2) / np.maximum(1, count - 1)
        var = np.where(count > 1, var, 0)
        total = var + s
        with np.errstate(divide="ignore", invalid="ignore"):
            drawn = np.where(total > 0, var / total * logit[r] + s / total * mean, logit[r])
        out[r] = np.where((count > 0), drawn, logit[r])
    return np.where(valid[..., None], 1 / (1 + np.exp(-out)), np.nan)


def icm_smooth(pixels: DataFrame, width: int, height: int, beta: float = 1.0, neighborhood: int = 4, rounds: int = 3, epsilon: float = 1e-9, clip: bool = False, shape: tuple[int, int] = BLOCK, overlap: int | None = None) -> DataFrame:
    """r, c, label (a class's place from 0, or -1). pixels: r, c, p, valid. Log-probabilities are log(p + epsilon), or with clip
    log of p held within epsilon and 1."""

    def kernel(p: np.ndarray, valid: np.ndarray) -> np.ndarray:
        q = np.where(valid[..., None], p, 1)
        return icm(np.log(np.clip(q, epsilon, 1) if clip else q + epsilon), valid, beta, neighborhood, rounds)

    return by_block(pixels, width, height, shape, max(1, rounds) if overlap is None else overlap, kernel, "label", "int")


def bayes_smooth(pixels: DataFrame, width: int, height: int, classes: int, window: int = 7, fraction: float = 0.5, smoothness: float | Sequence[float] = 20.0, shape: tuple[int, int] = BLOCK, overlap: int | None = None) -> DataFrame:
    """r, c, p: smoothed probabilities. pixels: r, c, p, valid."""
    if window < 3 or window % 2 == 0:
        raise ValueError("bayes_window_size must be an odd integer >= 3.")
    if not 0 < fraction <= 1:
        raise ValueError("bayes_neigh_fraction must be in (0, 1].")
    s = [float(x) for x in smoothness] if isinstance(smoothness, Sequence) else [float(smoothness)] * classes
    if len(s) != classes:
        raise ValueError("bayes_smoothness must match number of classes.")
    if min(s) < 0:
        raise ValueError("bayes_smoothness must be non-negative.")
    if not any(s):
        return pixels.select("r", "c", F.col("p").cast("array<double>").alias("p"))
    return by_block(pixels, width, height, shape, window // 2 if overlap is None else overlap, lambda p, valid: bayes(p, valid, window, fraction, s), "p", "array<double>")
