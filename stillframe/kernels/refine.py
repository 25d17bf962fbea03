"""Refinement of a basis under the shape of its crystal system."""

from __future__ import annotations

import numpy as np

from stillframe.functions.lattice import HKL_TOL

#: Free parameters (a, b, c, alpha, beta, gamma) by system: where each cell value comes from,
#: or a fixed angle.
SHAPES = {
    "triclinic": (0, 1, 2, 3, 4, 5), "monoclinic": (0, 1, 2, 90.0, 3, 90.0), "orthorhombic": (0, 1, 2, 90.0, 90.0, 90.0),
    "tetragonal": (0, 0, 1, 90.0, 90.0, 90.0), "hexagonal": (0, 0, 1, 90.0, 90.0, 120.0), "rhombohedral": (0, 0, 0, 1, 1, 1), "cubic": (0, 0, 0, 90.0, 90.0, 90.0),
}


def cell_values(system: str, p: np.ndarray) -> np.ndarray:
    return np.array([p[s] if isinstance(s, int) else s for s in SHAPES[system]])


def basis(c: np.ndarray) -> np.ndarray:
    a, b, l = c[:3]
    ca, cb, cg = np.cos(np.radians(c[3:]))
    sg = np.sin(np.radians(c[5]))
    room = max(1 - ca * ca - cb * cb - cg * cg + 2 * ca * cb * cg, 1e-12)
    return np.array([[a, b * cg, l * cb], [0, b * sg, l * (ca - cb * cg) / sg], [0, 0, l * np.sqrt(room) / sg]])


def cell_of(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=0)
    ang = [np.degrees(np.arccos(np.clip(m[:, i] @ m[:, j] / (n[i] * n[j]), -1, 1))) for i, j in ((1, 2), (0, 2), (0, 1))]
    return np.array([*n, *ang])


def rotation_of(w: np.ndarray) -> np.ndarray:
    """Rotation by the vector w (axis times angle)."""
    t = np.linalg.norm(w)
    if t < 1e-12:
        return np.eye(3)
    x, y, z = w / t
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + np.sin(t) * k + (1 - np.cos(t)) * k @ k


def nearest_rotation(m: np.ndarray) -> np.ndarray:
    u, _, vt = np.linalg.svd(m)
    return u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt))]) @ vt


def project(system: str, m: np.ndarray) -> np.ndarray:
    """Free parameters nearest to a basis: means over the values that share one."""
    c = cell_of(m)
    n = 1 + max(s for s in SHAPES[system] if isinstance(s, int))
    return np.array([np.mean([c[i] for i, s in enumerate(SHAPES[system]) if s == k and isinstance(s, int)]) for k in range(n)])


def deviation(system: str, m: np.ndarray) -> tuple[float, float]:
    """Largest relative length and absolute angle difference from the system's shape."""
    c, s = cell_of(m), cell_values(system, project(system, m))
    return float(np.abs(c[:3] / s[:3] - 1).max()), float(np.abs(c[3:] - s[3:]).max())


def refine(m: np.ndarray, q: np.ndarray, system: str, rounds: int = 12) -> np.ndarray:
    """Levenberg-Marquardt over a rotation and the system's free parameters; the indices
    are those of the starting basis' inliers."""
    h = np.rint(q @ m)
    ok = np.abs(q @ m - h).max(axis=1) < HKL_TOL
    q, h = q[ok], h[ok]
    p = project(system, m)
    r = nearest_rotation(m @ np.linalg.inv(basis(cell_values(system, p))))
    scale = np.r_[np.ones(3), np.maximum(np.abs(p), 1.0)]

    def miss(x: np.ndarray) -> np.ndarray:
        b = rotation_of(x[:3]) @ r @ basis(cell_values(system, x[3:]))
        return (h @ np.linalg.inv(b) - q).ravel()

    x, lam = np.r_[np.zeros(3), p], 1e-3
    now = miss(x)
    for _ in range(rounds):
        j = np.array([(miss(x + 1e-6 * s * e) - now) / (1e-6 * s) for e, s in zip(np.eye(len(x)), scale)]).T
        a = j.T @ j
        step = np.linalg.solve(a + lam * np.diag(np.diag(a) + 1e-15), -j.T @ now)
        new = miss(x + step)
        if new @ new < now @ now:
            x, now, lam = x + step, new, lam / 3
        else:
            lam *= 5
    return rotation_of(x[:3]) @ r @ basis(cell_values(system, x[3:]))
