"""Indexing of powder lines: cells whose calculated lines explain the observed 1 / d^2."""

from __future__ import annotations

from itertools import permutations

import numpy as np

#: Terms of 1 / d^2 in h, k, l by system: one column a free metric parameter.
SYSTEMS = {
    "cubic": lambda h, k, l: np.c_[h * h + k * k + l * l],
    "tetragonal": lambda h, k, l: np.c_[h * h + k * k, l * l],
    "hexagonal": lambda h, k, l: np.c_[h * h + h * k + k * k, l * l],
    "orthorhombic": lambda h, k, l: np.c_[h * h, k * k, l * l],
}


def indices(top: int) -> np.ndarray:
    g = np.array(np.meshgrid(*[range(top + 1)] * 3, indexing="ij")).reshape(3, -1).T
    return g[g.sum(axis=1) > 0]


def cell(system: str, p: np.ndarray) -> tuple[float, ...]:
    """Lengths from metric parameters."""
    if system == "hexagonal":
        a = (4 / (3 * p[0])) ** 0.5
        return (a, a, p[1] ** -0.5)
    x = p**-0.5
    return {1: (x[0],) * 3, 2: (x[0], x[0], x[-1]), 3: tuple(x)}[len(p)]


def figure(observed: np.ndarray, calculated: np.ndarray) -> float:
    """M over the observed lines."""
    top = observed[-1]
    calc = np.unique(np.round(calculated[calculated <= 1.05 * top], 8))
    if not len(calc):
        return 0.0
    at = np.clip(np.searchsorted(calc, observed), 1, max(1, len(calc) - 1)) if len(calc) > 1 else np.zeros(len(observed), dtype=int)
    near = np.minimum(np.abs(observed - calc[at - 1]), np.abs(observed - calc[at])) if len(calc) > 1 else np.abs(observed - calc[0])
    return float(top / (2 * max(near.mean(), 1e-4 * top) * max(1, (calc <= top).sum())))


def index_lines(q: np.ndarray, lines: int = 20, top: int = 3, reach: int = 8, tol: float = 2e-3) -> list[tuple[float, str, tuple[float, ...]]]:
    """(M, system, lengths) of the best cell of each system, best first.

    The first lines are given low indices in every way; each way solves the metric, and
    is kept if all lines used are explained; the best are refitted to all lines.
    """
    q = np.sort(np.asarray(q, dtype=float))[:lines]
    low, wide = indices(top), indices(reach)
    out = []
    for system, terms in SYSTEMS.items():
        a, b = terms(*low.T).astype(float), terms(*wide.T).astype(float)
        n = a.shape[1]
        a = np.unique(a, axis=0)
        best = (0.0, None)
        picks = [np.array(c) for c in permutations(range(min(n + 2, len(q))), n) if list(c) == sorted(c)]
        combos = np.array(np.meshgrid(*[range(len(a))] * n, indexing="ij")).reshape(n, -1).T if len(a) ** n <= 60_000 else np.random.default_rng(0).integers(0, len(a), (60_000, n))
        for rows in picks:
            m = a[combos]
            ok = np.abs(np.linalg.det(m)) > 0.5
            p = np.linalg.solve(m[ok], np.broadcast_to(q[rows], (int(ok.sum()), n))[..., None])[..., 0]
            p = p[(p > 1e-6).all(axis=1) & (p <= 1.5 * q[n]).all(axis=1)]
            for x in np.unique(np.round(p, 7), axis=0):
                calc = np.sort(b @ x)
                at = np.clip(np.searchsorted(calc, q), 1, len(calc) - 1)
                miss = np.minimum(np.abs(q - calc[at - 1]), np.abs(q - calc[at]))
                if (miss > tol * q).sum() > 1:
                    continue
                for _ in range(3):
                    near = np.abs(q[:, None] - (b @ x)[None, :]).argmin(axis=1)
                    x = np.linalg.lstsq(b[near], q, rcond=None)[0]
                if (x > 0).all() and (s := figure(q, b @ x)) > best[0]:
                    best = (s, x)
        if best[1] is not None:
            out.append((best[0], system, tuple(float(v) for v in cell(system, best[1]))))
    return sorted(out, key=lambda t: -t[0])


def profile_peaks(x: np.ndarray, y: np.ndarray, share: float = 0.05) -> np.ndarray:
    """Positions of local maxima whose prominence is a share of the range."""
    y = np.asarray(y, dtype=float)
    out = []
    for i in range(1, len(y) - 1):
        if y[i] > y[i - 1] and y[i] >= y[i + 1]:
            left, right = i, i
            while left > 0 and y[left - 1] <= y[i]:
                left -= 1
            while right < len(y) - 1 and y[right + 1] <= y[i]:
                right += 1
            base = max(y[left : i + 1].min(), y[i : right + 1].min())
            if y[i] - base >= share * (y.max() - y.min()):
                out.append(x[i])
    return np.array(out)
