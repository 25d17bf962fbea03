"""Orientations of a known cell from pairs of peaks: a table of the pairs of its lattice points."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from stillframe.functions.lattice import HKL_TOL
from stillframe.kernels.indexing import _miss, clean, indices, matched, passes
from stillframe.kernels.orient import keep_cell_many

#: Bytes that a table may have: frames get it by a broadcast.
MOST_BYTES = 64 << 20


@dataclass(frozen=True)
class PairTable:
    """Ordered pairs of lattice points within ``reach``, sorted by their hashed (length, length, cosine)."""

    cell: np.ndarray
    reach: float
    step: float
    turn: float
    keys: np.ndarray
    a: np.ndarray
    b: np.ndarray
    nodes: np.ndarray

    @property
    def bytes(self) -> int:
        return self.keys.nbytes + self.a.nbytes + self.b.nbytes + self.nodes.nbytes


def _key(la: np.ndarray, lb: np.ndarray, cos: np.ndarray) -> np.ndarray:
    return (la.astype(np.int64) << 40) + (lb.astype(np.int64) << 20) + (cos.astype(np.int64) + (1 << 19))


def pair_table(cell: np.ndarray, reach: float = 0.045, step: float = 1.0e-3, turn: float = 0.04, most: int = MOST_BYTES) -> PairTable:
    """The table of a cell; one that would be larger than ``most`` bytes is refused, as its number of pairs
    grows with the square of the volume."""
    inverse = np.linalg.inv(cell)
    n = np.ceil(reach * np.linalg.norm(cell, axis=0)).astype(int)
    g = np.array(np.meshgrid(*(np.arange(-k, k + 1) for k in n), indexing="ij")).reshape(3, -1).T
    nodes = g[(g != 0).any(axis=1)] @ inverse
    size = np.linalg.norm(nodes, axis=1)
    nodes, size = nodes[size <= reach], size[size <= reach]
    if 12 * len(nodes) ** 2 > most:
        raise ValueError(f"a table of {len(nodes)} lattice points is too large to broadcast: take a smaller reach")
    cos = (nodes @ nodes.T) / np.outer(size, size)
    i, j = np.nonzero(np.abs(cos) < 0.95)
    keys = _key(size[i] // step, size[j] // step, np.floor(cos[i, j] / turn))
    order = np.argsort(keys, kind="stable")
    return PairTable(cell, reach, step, turn, keys[order], i[order].astype(np.int16), j[order].astype(np.int16), nodes)


def _frames(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Orthonormal frames (n, 3, 3) whose first axis is u and whose plane holds v; columns are the axes."""
    x, z = _unit(u), _unit(_cross(u, v))
    return np.stack([x, _cross(z, x), z], axis=2)


def _unit(u: np.ndarray) -> np.ndarray:
    return u / np.sqrt((u * u).sum(axis=1, keepdims=True))


def _cross(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    (a, b, c), (d, e, f) = u.T, v.T
    return np.stack([b * f - c * e, c * d - a * f, a * e - b * d], axis=1)


def orientations(q: np.ndarray, table: PairTable, peaks: int) -> np.ndarray:
    """Rotations that take some pair of lattice points to some pair of the frame's ``peaks`` lowest
    peaks, within a bin of the table to either side."""
    size = np.linalg.norm(q, axis=1)
    low = q[np.argsort(size, kind="stable")]
    low = low[np.linalg.norm(low, axis=1) <= table.reach][:peaks]
    i, j = np.triu_indices(len(low), 1)
    u, v = low[i], low[j]
    nu, nv = np.linalg.norm(u, axis=1), np.linalg.norm(v, axis=1)
    cos = (u * v).sum(axis=1) / (nu * nv)
    ok = np.abs(cos) < 0.95
    u, v, nu, nv, cos = u[ok], v[ok], nu[ok], nv[ok], cos[ok]
    shift = np.array(list(np.ndindex(3, 3, 3)))[:, :, None] - 1
    keys = _key(nu // table.step + shift[:, 0], nv // table.step + shift[:, 1], np.floor(cos / table.turn) + shift[:, 2]).ravel()
    first, last = np.searchsorted(table.keys, keys), np.searchsorted(table.keys, keys, side="right")
    n = last - first
    who = np.repeat(np.tile(np.arange(len(u)), len(shift)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    nodes, back = np.unique(table.a[at].astype(np.int64) * len(table.nodes) + table.b[at], return_inverse=True)
    own = _frames(table.nodes[nodes // len(table.nodes)], table.nodes[nodes % len(table.nodes)])[back.ravel()]
    return _frames(u, v)[who] @ own.transpose(0, 2, 1)


def best_of(q: np.ndarray, table: PairTable, rotations: np.ndarray, look: int = 80, keep: int = 8) -> np.ndarray | None:
    """The basis of the rotation that matches most peaks, after a refit with the cell fixed; the ``look``
    lowest peaks choose whom to refit."""
    if not len(rotations):
        return None
    low = q[np.argsort((q * q).sum(axis=1), kind="stable")[:look]]
    n, size = np.empty(len(rotations), dtype=int), max(1, 60_000 // (3 * len(low)))
    for at in range(0, len(rotations), size):
        h = indices(rotations[at : at + size] @ table.cell, low)
        n[at : at + size] = (_miss(h, np.rint(h)) < HKL_TOL).sum(axis=1)
    fits = keep_cell_many(q, table.cell, rotations[np.argsort(-n, kind="stable")[:keep]]) @ table.cell
    return max(fits, key=lambda m: matched(m, q))


#: The peaks whose pairs each tier looks up.
TIERS = (10, 24)


def cascade(q: np.ndarray, table: PairTable, known) -> tuple[np.ndarray | None, int]:
    """(basis, tier): pairs of few peaks, pairs of more, the search over directions (``known(q)``); the
    first that passes the gate, else the last one's with tier 0."""
    q = clean(q)
    for tier, peaks in enumerate(TIERS, 1):
        m = best_of(q, table, orientations(q, table, peaks)) if len(q) >= 6 else None
        if m is not None and passes(m, q):
            return m, tier
    m = known(q)
    return m, len(TIERS) + 1 if passes(m, q) else 0
