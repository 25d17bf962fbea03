"""Synthetic frames with known lattices, keyed by (seed, frame): the same in any task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from stillframe.kernels.indexing import scramble

SHOT = "frame_id long, peak_id int, qx double, qy double, qz double, h int, k int, l int, is_spurious boolean"
TRUTH = "frame_id long, m array<double>"


def rotation(rng: np.random.Generator) -> np.ndarray:
    """Uniform random rotation from a random unit quaternion."""
    w, x, y, z = (q := rng.normal(size=4)) / np.linalg.norm(q)
    return np.array([
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ])


def shot(frame: int, cell: np.ndarray, wavelength: float = 1.3, dmin: float = 4.0, n_peaks: int = 60, jitter: float = 3e-4, spurious: float = 0.15, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(q, hkl, is spurious, basis): the lattice points nearest to the sphere of
    reflection, jittered, with random vectors among them."""
    rng = np.random.default_rng([seed, frame])
    m = rotation(rng) @ cell
    top = np.ceil(np.linalg.norm(cell, axis=0) / dmin).astype(int)
    grid = np.array(np.meshgrid(*(range(-t, t + 1) for t in top), indexing="ij")).reshape(3, -1).T
    grid = grid[np.abs(grid).sum(axis=1) > 0]
    q = grid @ np.linalg.inv(m)
    n = np.linalg.norm(q, axis=1)
    q, grid = q[n <= 1 / dmin], grid[n <= 1 / dmin]
    miss = np.abs(q[:, 2] + wavelength / 2 * (q * q).sum(axis=1))
    near = np.argsort(miss, kind="stable")[:n_peaks]
    q, grid = q[near] + rng.normal(scale=jitter, size=(len(near), 3)), grid[near]
    extra = int(spurious * len(q))
    v = rng.normal(size=(extra, 3))
    v *= (rng.uniform(0.05, 1 / dmin, extra) / np.linalg.norm(v, axis=1))[:, None]
    return np.r_[q, v], np.r_[grid, np.zeros((extra, 3), dtype=int)], np.r_[np.zeros(len(q), dtype=bool), np.ones(extra, dtype=bool)], m


def shots(spark: SparkSession, frames: int, cell: np.ndarray, scrambled: bool = False, parts: int = 8, **options) -> DataFrame:
    """Peaks of ``frames`` synthetic frames; scrambled ones have no lattice left."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for frame in b["id"]:
                q, hkl, bad, _ = shot(int(frame), cell, **options)
                if scrambled:
                    q = scramble(q, np.random.default_rng([99, int(frame)]))
                yield pd.DataFrame({"frame_id": frame, "peak_id": range(len(q)), "qx": q[:, 0], "qy": q[:, 1], "qz": q[:, 2], "h": hkl[:, 0], "k": hkl[:, 1], "l": hkl[:, 2], "is_spurious": bad})

    return spark.range(0, frames, 1, parts).mapInPandas(run, SHOT)


def truths(spark: SparkSession, frames: int, cell: np.ndarray, **options) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"frame_id": b["id"], "m": [shot(int(f), cell, **options)[3].ravel().tolist() for f in b["id"]]})

    return spark.range(0, frames, 1, 8).mapInPandas(run, TRUTH)
