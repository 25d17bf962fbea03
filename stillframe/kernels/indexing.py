"""Lattice search of one frame: blind, with a known cell, and with a chance control."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from itertools import combinations

import numpy as np

from stillframe.functions.lattice import GATE_FRACTION, GATE_LEAST, HKL_TOL, Q_FLOOR
from stillframe.kernels import reduction as R


@dataclass(frozen=True)
class Search:
    """Effort of the searches; the defaults suit tests, larger counts find more."""

    directions: int = 700
    lengths: tuple[float, ...] = tuple(range(30, 124, 3))
    steps: int = 8
    band: float = 0.18
    shortest: float = 20.0
    voxel: float = 2.0
    keep: int = 44
    candidates: int = 30
    nbest: int = 3
    known_directions: int = 2400
    anchors: int = 24
    azimuths: int = 180
    finalists: int = 24


def clean(q: np.ndarray) -> np.ndarray:
    q = np.asarray(q, dtype=float).reshape(-1, 3)
    n = (q * q).sum(axis=1)
    return q[np.isfinite(n) & (n > Q_FLOOR**2)]


def matched(m: np.ndarray | None, q: np.ndarray, tol: float = HKL_TOL) -> int:
    if m is None:
        return 0
    h = m.T @ q.T
    return int((_miss(h, np.rint(h)) < tol).sum())


def passes(m: np.ndarray | None, q: np.ndarray) -> bool:
    n = matched(m, q)
    return n >= GATE_LEAST and n >= GATE_FRACTION * len(q)


def half_sphere(n: int) -> np.ndarray:
    """Evenly spread directions with z >= 0 (golden-angle spiral)."""
    i = np.arange(n) + 0.5
    z, phi = i / n, i * np.pi * (3 - 5**0.5)
    r = np.sqrt(1 - z * z)
    return np.c_[r * np.cos(phi), r * np.sin(phi), z]


@lru_cache
def _series(band: float) -> tuple[list[np.float32], list[np.float32]]:
    """Coefficients in t = d^2, for |d| within the band, of sin(2 pi d) / d and of cos^2(pi d), to 1e-6 of
    the largest: a few products where a sine costs ten."""
    t = band**2 * (1 + np.polynomial.chebyshev.chebpts1(64)) / 2
    d, out = np.sqrt(t), []
    for y in (np.sin(2 * np.pi * d) / d, np.cos(np.pi * d) ** 2):
        for n in range(1, 12):
            p = np.polynomial.Polynomial.fit(t, y, n, domain=[0, band**2]).convert()
            if np.abs(p(t) - y).max() < 1e-6 * np.abs(y).max():
                break
        out.append([np.float32(c) for c in p.coef])
    return out[0], out[1]


def _sum(series: list[np.float32], t: np.ndarray, out: np.ndarray) -> np.ndarray:
    np.multiply(t, series[-1], out=out)
    for c in series[-2:0:-1]:
        out += c
        out *= t
    out += series[0]
    return out


def ascend(v: np.ndarray, q: np.ndarray, c: Search, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Vectors climbing the sum of cos^2(pi v.q) over peaks within the band of a node:
    normalised steps with momentum, shrinking; and that sum at the end.  ``weight``: of each
    peak.  Vectors climb in blocks whose numbers stay in the cache, in single precision: what is
    found is refitted afterwards."""
    qmax = np.sqrt((q * q).sum(axis=1).max())
    size = min(max(1, 60_000 // max(1, len(q))), max(1, len(v)))
    q = q.astype(np.float32)
    back, pull = np.ascontiguousarray(q.T), q if weight is None else q * np.asarray(weight, dtype=np.float32)[:, None]
    slope, height = _series(c.band)
    edge, least, half = np.float32(c.band**2), np.float32(1e-12), np.float32(0.5)
    v, f = v.astype(np.float32), np.zeros(len(v))
    room, mask = np.empty((3, size, len(q)), dtype=np.float32), np.empty((size, len(q)), dtype=bool)
    for i in range(0, len(v), size):
        x = v[i : i + size]
        drift, (d, t, wave), near = np.zeros_like(x), room[:, : len(x)], mask[: len(x)]
        for s in range(c.steps + 1):
            np.matmul(x, back, out=d)
            d -= np.rint(d, out=t)
            np.multiply(d, d, out=t)
            np.less(t, edge, out=near)
            if s == c.steps:
                break
            _sum(slope, t, wave)
            wave *= d
            wave *= near
            g = wave @ pull
            drift = half * drift - g / np.maximum(np.sqrt((g * g).sum(axis=1, keepdims=True)), least)
            x += np.float32(0.25 / qmax * (1 - 0.7 * s / c.steps)) * drift
        _sum(height, t, wave)
        wave *= near
        if weight is not None:
            wave *= np.asarray(weight, dtype=np.float32)
        f[i : i + size] = wave.sum(axis=1, dtype=float)
    return v.astype(float), f


def distinct(v: np.ndarray, f: np.ndarray, c: Search) -> np.ndarray:
    """The best vector of each voxel, signs made canonical, best first."""
    v = np.where(v[:, :1] < 0, -v, v)
    ok = np.linalg.norm(v, axis=1) >= c.shortest
    v, f = v[ok], f[ok]
    some = min(len(v), 40 * c.keep)
    while True:  # the best voxels are those of the best vectors: mostly a few are enough
        best = np.flatnonzero(f >= np.partition(f, len(f) - some)[len(f) - some]) if some < len(f) else np.arange(len(f))
        order = best[np.lexsort((v[best, 2], v[best, 1], v[best, 0], -f[best]))]
        _, first = np.unique(np.rint(v[order] / c.voxel).astype(int), axis=0, return_index=True)
        if len(first) >= c.keep or some == len(v):
            return v[order][np.sort(first)[: c.keep]][: c.candidates]
        some = min(len(v), 4 * some)


def candidates(v: np.ndarray, f: np.ndarray, c: Search) -> np.ndarray:
    """``distinct`` vectors without those that stand across a voxel's border, or with the other sign, near a
    better one."""
    out: list[np.ndarray] = []
    for x in distinct(v, f, replace(c, candidates=c.keep)):
        if all(min(np.abs(x - y).max(), np.abs(x + y).max()) >= c.voxel for y in out):
            out.append(x)
    return np.array(out[: c.candidates]).reshape(-1, 3)


def indices(ms: np.ndarray, q: np.ndarray) -> np.ndarray:
    """(bases, 3, peaks): fractional indices of all peaks in all bases, as one product of matrices."""
    return (ms.transpose(0, 2, 1).reshape(-1, 3) @ q.T).reshape(len(ms), 3, len(q))


def inverse(a: np.ndarray) -> np.ndarray:
    """Of many 3x3 matrices, by their cofactors."""
    (a, b, c), (d, e, f), (g, h, i) = (tuple(a[..., r, k] for k in range(3)) for r in range(3))
    rows = [e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d]
    with np.errstate(divide="ignore", invalid="ignore"):
        return (np.stack(rows, axis=-1) / (a * rows[0] + b * rows[3] + c * rows[6])[..., None]).reshape(*a.shape, 3, 3)


#: Bases times peaks that are looked at together.
AT_ONCE = 60_000


def _miss(h: np.ndarray, near: np.ndarray) -> np.ndarray:
    """The largest of the three differences of ``h`` (..., 3, peaks), which is overwritten."""
    h -= near
    np.abs(h, out=h)
    return np.maximum(np.maximum(h[..., 0, :], h[..., 1, :]), h[..., 2, :])


def anneal(ms: np.ndarray, q: np.ndarray, start: float, shrink: float, rounds: int, least: float) -> np.ndarray:
    """Least-squares refits of bases to their inliers under a closing tolerance."""
    products = (q[:, :, None] * q[:, None, :]).reshape(-1, 9)
    size, out = max(1, AT_ONCE // max(1, len(q))), []
    for at in range(0, len(ms), size):
        m, tol = ms[at : at + size], start
        for _ in range(rounds):
            h = indices(m, q)
            near = np.rint(h)
            w = (_miss(h, near) < tol).astype(float)
            a = (w @ products).reshape(-1, 3, 3) + 1e-9 * np.eye(3)
            near *= w[:, None]
            new = inverse(a) @ (near.reshape(-1, len(q)) @ q).reshape(-1, 3, 3).transpose(0, 2, 1)
            m = np.where(((w.sum(axis=1) >= 6) & np.isfinite(new).all(axis=(1, 2)))[:, None, None], new, m)
            tol = max(shrink * tol, least)
        out.append(m)
    return np.concatenate(out) if out else ms


def rank(ms: np.ndarray, q: np.ndarray, tol: float = 0.25, least: float = 0.02) -> np.ndarray:
    """Enough inliers first, then the evidence of all peaks; hopeless and flat bases last.

    An inlier tells as much as its defect is improbable by chance, a peak outside the tolerance nothing; so half a
    cell, which explains half the peaks a little better, and a multiple of one, which explains them a
    little worse, are behind the cell itself."""
    n, told, size = np.zeros(len(ms)), np.zeros(len(ms)), max(1, AT_ONCE // max(1, len(q)))
    for at in range(0, len(ms), size):
        h = indices(ms[at : at + size], q)
        d = _miss(h, np.rint(h))
        n[at : at + size] = (d < tol).sum(axis=1)
        told[at : at + size] = -np.log(np.clip(d, least, tol) / tol).sum(axis=1)
    score = 1000.0 * (n >= 0.30 * len(q)) + told / max(1, len(q))
    det = np.abs(np.linalg.det(ms))
    flat = det < 0.1 * np.prod(np.linalg.norm(ms, axis=1), axis=1)
    return np.where((n < 8) | flat | (det < 1), -1e9, score)


#: (2 or 3, sum of axes): of a cell of two or three times the volume that part of the sum is a lattice vector;
#: single axes first, and the last axis of a sum stands in it once.
PARTS = [(p, np.array(c)) for p in (2, 3) for n in (1, 2, 3) for c in np.ndindex(p, p, p) if np.count_nonzero(c) == n and c[np.flatnonzero(c)[-1]] == 1]


def primitive(m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Takes half or a third of an axis, or of a sum of axes (a centring), as an axis where nearly all indices of
    the peaks along it are even, or multiples of three, as long as the peaks stay explained.

    Parity is read from peaks within half the tolerance, and it is those that must stay explained: of peaks that a cell meets by chance, which are odd as
    often as even, an eighth is left there."""
    for _ in range(3):
        h = np.rint(q @ m)
        miss = np.abs(q @ m - h).max(axis=1)
        ok = miss < HKL_TOL / 2
        changed = False
        for p, c in PARTS:
            x = h[ok] @ c
            if (x != 0).sum() >= 5 and (x % p == 0).mean() >= 0.9:
                part = m.copy()
                part[:, np.flatnonzero(c)[-1]] = m @ c / p
                part = anneal(part[None], q, 0.25, 0.85, 3, 0.05)[0]
                if matched(part, q[ok]) >= 0.9 * ok.sum():
                    m, changed = part, True
                    break
        if not changed:
            break
    return m


def _uneven(ms: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of many bases, those that ``primitive`` leaves as they are: no axis or sum of axes has even indices,
    or multiples of three, nearly everywhere."""
    h = indices(ms, q)
    near = np.rint(h)
    ok = _miss(h, near) < HKL_TOL / 2
    n, near = ok.sum(axis=1), near.astype(np.int16)
    some = np.zeros(len(ms), dtype=bool)
    for p, c in PARTS:
        x = sum(c[k].astype(np.int16) * near[:, k] for k in np.flatnonzero(c))
        some |= (((x != 0) & ok).sum(axis=1) >= 5) & ((((x & 1 if p == 2 else x % 3) == 0) & ok).sum(axis=1) / np.maximum(n, 1) >= 0.9)
    return ~some


def _reduced(ms: np.ndarray, q: np.ndarray, at_once: int = 40) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(reduced primitive basis, its fingerprint) of each basis in turn, some bases at once; nan for flat ones."""
    for at in range(0, len(ms), at_once):
        some = ms[at : at + at_once].copy()
        for i in np.flatnonzero(~_uneven(some, q)):
            some[i] = primitive(some[i], q)
        some = R.reduce_many(some)
        yield from zip(some, R.fingerprints(some))


def blind(q: np.ndarray, c: Search = Search(), starts: np.ndarray | None = None, weight=None, score=None) -> list[tuple[np.ndarray, float]]:
    """Distinct reduced cells of a frame, best first (at most ``nbest``).

    ``starts``: vectors to climb from instead of the grid; ``weight(q)``: of each peak in the
    climb; ``score(ms, q)``: of refitted bases, larger is better (None: ``rank``).
    """
    q = clean(q)
    if len(q) < 8:
        return []
    if starts is None:
        starts = (half_sphere(c.directions)[:, None, :] * np.array(c.lengths)[None, :, None]).reshape(-1, 3)
    v = candidates(*ascend(starts, q, c, None if weight is None else weight(q)), c)
    if len(v) < 3:
        return []
    triples = np.array(list(combinations(range(len(v)), 3)))
    ms = v[triples].transpose(0, 2, 1)
    ok = np.abs(np.linalg.det(ms)) >= 0.1 * np.prod(np.linalg.norm(ms, axis=1), axis=1)
    ms = anneal(ms[ok], q, 0.30, 0.85, 3, 0.02)
    if not len(ms):
        return []
    score = (score or rank)(ms, q)
    out: list[tuple[np.ndarray, float]] = []
    seen: list[np.ndarray] = []
    first = np.argsort(-score, kind="stable")[:200]
    first = first[score[first] > -1e8]
    for i, (m, f) in zip(first, _reduced(ms[first], q)):
        if np.isnan(f[0]) or any(R.same(f, s[None])[0] for s in seen):
            continue
        seen.append(f)
        out.append((m, float(score[i])))
        if len(out) == c.nbest:
            break
    return out


def known(q: np.ndarray, cell: np.ndarray, c: Search = Search()) -> np.ndarray | None:
    """The best orientation of a known cell: its shortest axis over directions, the second
    over azimuths, the third from the metric (both hands), then closing refits."""
    from stillframe.kernels.batched import known_many  # it builds on this module

    return known_many([clean(q)], cell, c)[0]


def scramble(q: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Each peak turned about z by its own random angle: keeps |q| and q_z."""
    phi = rng.uniform(0, 2 * np.pi, len(q))
    c, s = np.cos(phi), np.sin(phi)
    return np.c_[c * q[:, 0] - s * q[:, 1], s * q[:, 0] + c * q[:, 1], q[:, 2]]


def escalate(q: np.ndarray, cell: np.ndarray, frame: int, copies: int = 32, per_round: int = 8, seed: int = 20260926, c: Search = Search()) -> tuple[np.ndarray | None, int]:
    """A deep fit that is accepted only if it passes the gate and beats every scrambled
    copy of the frame (p = 1 / (copies + 1)); copies go in rounds and stop at the first
    that is as good.  Also returns the copies that were tried."""
    q = clean(q)
    m = known(q, cell, c)
    if m is None or not passes(m, q):
        return None, 0
    real, tried = matched(m, q), 0
    while tried < copies:
        for k in range(tried, min(tried + per_round, copies)):
            fake = scramble(q, np.random.default_rng([seed, frame, k]))
            tried += 1
            if matched(known(fake, cell, c), fake) >= real:
                return None, tried
    return m, tried


#: Offsets between the nodes, in indices: what lies there is there by chance.
BETWEEN = np.array([(g, g * a, g * b) for g in (1, -1) for a in (1, -1) for b in (1, -1)]) / 3


def tightness(m: np.ndarray, q: np.ndarray, tol: float = 2 / 3 * HKL_TOL) -> float:
    """Coverage times the occupied share of the lattice nodes in the peaks' sphere, both without the part
    that nodes take by chance, which is read from places between them."""
    h = q @ m
    near = np.rint(h)
    ok = np.abs(h - near).max(axis=1) < tol
    if not ok.any():
        return 0.0
    by_chance = np.mean([(np.abs(x - np.rint(x)).max(axis=1) < tol).mean() for x in (h + s for s in BETWEEN)])
    real = max(1 - by_chance / ok.mean(), 0.0)
    qmax = np.sqrt((q * q).sum(axis=1).max())
    nodes = 4 / 3 * np.pi * qmax**3 * abs(np.linalg.det(m)) - 1
    return float(real * ok.mean() * real * len(np.unique(near[ok], axis=0)) / max(nodes, 1.0))


def best_derivative(m: np.ndarray, q: np.ndarray, most: int = 3, margin: float = 1.1) -> int:
    """0 if none of the cell's sub- and superlattices is tighter by more than ``margin``, else which of them
    is the tightest."""
    all_ = [tightness(x, q) for x in (m, *R.derivatives(m, most))]
    best = int(np.argmax(all_))
    return best if all_[best] > margin * all_[0] else 0


def misorientation(m1: np.ndarray, m2: np.ndarray) -> float:
    """Least rotation in degrees between two bases of one lattice over their settings."""
    r1, r2 = R.reduce_basis(m1), R.reduce_basis(m2)
    best = 180.0
    for perm in ((0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)):
        for sign in np.array(np.meshgrid([1, -1], [1, -1], [1, -1])).reshape(3, -1).T:
            b = r2[:, perm] * sign
            x = b @ np.linalg.inv(r1)
            u, s, vt = np.linalg.svd(x)
            if abs(s - 1).max() > 0.06 or np.linalg.det(x) < 0:
                continue
            rot = u @ vt
            best = min(best, float(np.degrees(np.arccos(np.clip((np.trace(rot) - 1) / 2, -1, 1)))))
    return best
