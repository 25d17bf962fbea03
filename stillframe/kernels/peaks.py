"""Peak finding in one image: local ring background, threshold, connected components."""

from __future__ import annotations

import numpy as np


def window_sums(x: np.ndarray, r: int) -> np.ndarray:
    """Sums over (2 r + 1)^2 boxes, zeros outside the image."""
    p = np.pad(x, r + 1)
    s = p.cumsum(axis=0).cumsum(axis=1)
    n = 2 * r + 1
    h, w = x.shape
    return s[n : n + h, n : n + w] - s[:h, n : n + w] - s[n : n + h, :w] + s[:h, :w]


def ring_statistics(image: np.ndarray, ok: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of the usable pixels on the ring at distance r of each pixel."""
    x = np.where(ok, image, 0.0)
    ring = lambda a: window_sums(a, r) - window_sums(a, r - 1)
    n = np.maximum(ring(ok.astype(float)), 1)
    mean = ring(x) / n
    return mean, np.sqrt(np.maximum(ring(x * x) / n - mean * mean, 0))


def components(mask: np.ndarray) -> np.ndarray:
    """Labels 1, 2, ... of 8-connected pixels (0: none), by spreading the least index."""
    h, w = mask.shape
    label = np.where(mask, np.arange(1, h * w + 1).reshape(h, w), 0)
    big = h * w + 1
    while True:
        p = np.pad(np.where(mask, label, big), 1, constant_values=big)
        low = np.min([p[i : i + h, j : j + w] for i in range(3) for j in range(3)], axis=0)
        new = np.where(mask, np.minimum(label, low), 0)
        # pointer jumping: a pixel takes the label of the pixel that its label names
        flat = np.r_[0, new.ravel()]
        new = flat[flat[new]] if mask.any() else new
        new = np.where(mask, new, 0)
        if (new == label).all():
            break
        label = new
    _, out = np.unique(label, return_inverse=True)
    out = out.reshape(h, w)
    return out if not mask.all() else out + 1


def find(image: np.ndarray, ok: np.ndarray | None = None, r: int = 4, grow_snr: float = 3.0, seed_snr: float = 6.0, sizes: tuple[int, int] = (1, 200), least: float = 8.0) -> list[tuple[float, float, float, float, int]]:
    """(fs, ss, mass, signal over noise, pixels) of each peak, by label."""
    image = np.asarray(image, dtype=float)
    ok = np.isfinite(image) if ok is None else ok & np.isfinite(image)
    mean, sd = ring_statistics(np.where(ok, image, 0.0), ok, r)
    sd = np.maximum(sd, np.sqrt(np.maximum(mean, 1.0)))
    over = image - mean
    mask = ok & (over > grow_snr * sd)
    label = components(mask)
    n = int(label.max())
    at = label.ravel()
    take = lambda v: np.bincount(at, weights=v.ravel(), minlength=n + 1)[1:]
    ss, fs = np.indices(image.shape)
    size, mass, noise = take(mask.astype(float)), take(np.where(mask, over, 0)), take(np.where(mask, sd * sd, 0))
    seeded = take((mask & (over > seed_snr * sd)).astype(float)) > 0
    son = mass / np.sqrt(np.maximum(noise, 1e-12))
    good = seeded & (size >= sizes[0]) & (size <= sizes[1]) & (son > least)
    cx, cy = (take(np.where(mask, over * c, 0)) / np.maximum(mass, 1e-12) for c in (fs, ss))
    return [(float(cx[i]), float(cy[i]), float(mass[i]), float(son[i]), int(size[i])) for i in np.flatnonzero(good)]
