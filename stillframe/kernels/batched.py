"""The known-cell search for many frames at once, in padded arrays (frames, peaks, 3)."""

from __future__ import annotations

import numpy as np

from stillframe.functions.lattice import HKL_TOL
from stillframe.kernels import reduction as R
from stillframe.kernels.indexing import Search, _miss, half_sphere, indices, inverse

#: Numbers of a scan that are looked at together; they stay in the cache.
BLOCK = 400_000
#: Numbers of a fit in double precision, the same.
FIT = 60_000


def pad(frames: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(q, mask): frames of unequal length as one array; rows beyond a frame's peaks are zero."""
    most = max(map(len, frames), default=0)
    q, mask = np.zeros((len(frames), most, 3)), np.zeros((len(frames), most), dtype=bool)
    for i, f in enumerate(frames):
        q[i, : len(f)], mask[i, : len(f)] = f, True
    return q, mask


def known_many(frames: list[np.ndarray], cell: np.ndarray, c: Search = Search()) -> list[np.ndarray | None]:
    """``known`` of each frame: the orientation that matches the most peaks, or None.

    The steps are those of the search of one frame.  Scans over directions and azimuths are sums of
    cosines in single precision; refits are in double.  A padded row has no weight anywhere:
    it adds the same cosine to every direction and is masked in counts and fits.
    """
    if not frames:
        return []
    q, mask = pad(frames)
    thin = q.astype(np.float32)
    order = np.argsort(np.linalg.norm(cell, axis=0), kind="stable")
    a, b, d = (cell[:, k] for k in order)
    la, lb = np.linalg.norm(a), np.linalg.norm(b)
    cab, cad = a @ b / (la * lb), a @ d / la
    kept, have = _anchors(thin, la, c)
    ms = _bases(thin, kept, have, order, (la, lb, cab, cad, a, b, d), c)
    ms = _finalists(q, mask, ms, c.finalists)
    ms = anneal_many(ms, q, mask, 0.30, 0.82, 20, 0.05)
    n = counts(ms, q, mask, HKL_TOL)
    order, want = np.argsort(-n, axis=1, kind="stable"), np.array(R.fingerprint(cell))
    out: list[np.ndarray | None] = [None] * len(frames)
    open_ = np.flatnonzero(mask.sum(axis=1) >= 6)
    for k in range(ms.shape[1]):  # the best that is the cell; nearly always the first
        at = order[open_, k]
        ok = R.same(want, R.fingerprints(ms[open_, at])) if len(open_) else np.zeros(0, dtype=bool)
        for i, j in zip(open_[ok], at[ok]):
            out[i] = ms[i, j]
        open_ = open_[~ok]
    return out


def _blocks(n: int, each: int, fit: int = BLOCK) -> list[slice]:
    size = max(1, fit // max(1, each))
    return [slice(i, i + size) for i in range(0, n, size)]


def _anchors(q: np.ndarray, length: float, c: Search) -> tuple[np.ndarray, np.ndarray]:
    """(directions (frames, anchors, 3), which are there) of an axis of a length: the best of the sphere,
    climbed, without those close to a better one."""
    u = half_sphere(c.known_directions).astype(np.float32)
    turn = np.float32(2 * np.pi * length)
    take = min(4 * c.anchors, len(u))
    top = np.empty((len(q), take, 3), dtype=np.float32)
    for s in _blocks(len(q), q.shape[1] * len(u)):
        score = np.cos(turn * (q[s] @ u.T)).sum(axis=1)
        top[s] = u[np.argsort(-score, axis=1, kind="stable")[:, :take]]
    qt = np.ascontiguousarray(q.transpose(0, 2, 1))
    for _ in range(20):
        g = -np.sin(turn * (top @ qt)) @ q
        g -= (g * top).sum(axis=2, keepdims=True) * top
        top = top + np.float32(0.004) * g / np.maximum(np.linalg.norm(g, axis=2, keepdims=True), np.float32(1e-12))
        top /= np.linalg.norm(top, axis=2, keepdims=True)
    f = np.cos(turn * (top @ qt)).sum(axis=2)
    top = np.take_along_axis(top, np.argsort(-f, axis=1, kind="stable")[:, :, None], axis=1).astype(float)
    close = np.abs(top @ top.transpose(0, 2, 1)) >= 0.9995
    keep = np.zeros(top.shape[:2], dtype=bool)
    for i in range(take):
        keep[:, i] = ~(close[:, i, :i] & keep[:, :i]).any(axis=1) & (keep[:, :i].sum(axis=1) < c.anchors)
    first = np.argsort(~keep, axis=1, kind="stable")[:, : c.anchors]
    return np.take_along_axis(top, first[:, :, None], axis=1), np.take_along_axis(keep, first, axis=1)


def _bases(q: np.ndarray, kept: np.ndarray, have: np.ndarray, order: np.ndarray, metric: tuple, c: Search) -> np.ndarray:
    """Eight bases an anchor: the second axis at its best azimuths, the third from the metric."""
    la, lb, cab, cad, a, b, d = metric
    e1 = a / la
    e2 = b - (b @ e1) * e1
    e2 /= np.linalg.norm(e2)
    e3 = np.cross(e1, e2)
    d1, d2, d3 = cad, d @ e2, d @ e3
    phi = np.linspace(0, 2 * np.pi, c.azimuths, endpoint=False)
    side = np.cross(kept, np.where(np.abs(kept[..., :1]) < 0.9, [1.0, 0, 0], [0, 1.0, 0]))
    side /= np.linalg.norm(side, axis=2, keepdims=True)
    up = np.cross(kept, side)
    away = np.sqrt(max(0.0, 1 - cab * cab))
    qt = q.transpose(0, 2, 1)
    along, across, above = ((np.float32(2 * np.pi * lb * f) * (v.astype(np.float32) @ qt)) for v, f in ((kept, cab), (side, away), (up, away)))
    # a peak's phase at an azimuth is ``along`` more than a wave that half a turn only changes the sign of
    half = c.azimuths // 2 if c.azimuths % 2 == 0 else c.azimuths
    circle = np.stack([np.cos(phi), np.sin(phi)], axis=1)[:half].astype(np.float32)
    score = np.empty((kept.shape[1], c.azimuths), dtype=np.float32)
    best = np.empty((*kept.shape[:2], 8), dtype=int)
    for i in range(len(q)):
        for k in range(kept.shape[1]):
            x = circle @ np.stack([across[i, k], above[i, k]])
            if along[i, k].any():
                even, odd = np.cos(x) @ np.cos(along[i, k]), np.sin(x) @ np.sin(along[i, k])
            else:
                even, odd = np.cos(x, out=x).sum(axis=1), np.float32(0)
            score[k, :half] = even - odd
            if half < c.azimuths:
                score[k, half:] = even + odd
        best[i] = np.argsort(-score, axis=1, kind="stable")[:, :8]
    f2 = np.cos(phi)[best][..., None] * side[:, :, None] + np.sin(phi)[best][..., None] * up[:, :, None]
    k = kept[:, :, None]
    ms = np.empty((*best.shape, 3, 3))
    for slot, v in zip(order, (la * k + 0 * f2, lb * (cab * k + away * f2), d1 * k + d2 * f2 + d3 * np.cross(k, f2))):
        ms[..., slot] = v
    ms[~have] = 0.0
    return ms.reshape(len(q), -1, 3, 3)


def _indices(ms: np.ndarray, q: np.ndarray) -> np.ndarray:
    """(frames, bases, 3, peaks): fractional indices."""
    f, n = ms.shape[:2]
    return (ms.transpose(0, 1, 3, 2).reshape(f, 3 * n, 3) @ q.transpose(0, 2, 1)).reshape(f, n, 3, q.shape[1])


def counts(ms: np.ndarray, q: np.ndarray, mask: np.ndarray, tol: float) -> np.ndarray:
    h = _indices(ms, q)
    return ((_miss(h, np.rint(h)) < tol) & mask[:, None]).sum(axis=2)


def _finalists(q: np.ndarray, mask: np.ndarray, ms: np.ndarray, n: int) -> np.ndarray:
    first = np.concatenate([counts(ms[s], q[s], mask[s], 0.3) for s in _blocks(len(q), ms.shape[1] * 3 * q.shape[1], FIT)])
    first[(ms == 0).all(axis=(2, 3))] = -1
    return np.take_along_axis(ms, np.argsort(-first, axis=1, kind="stable")[:, :n, None, None], axis=1)


def anneal_many(ms: np.ndarray, q: np.ndarray, mask: np.ndarray, start: float, shrink: float, rounds: int, least: float) -> np.ndarray:
    """Least-squares refits of the bases (frames, bases, 3, 3) to their own frame's inliers under a
    closing tolerance."""
    f, n = ms.shape[:2]
    out = ms.copy()
    for s in _blocks(f, n * 3 * q.shape[1], FIT):
        if len(q[s]) == 1:
            out[s] = _anneal_frame(out[s][0], q[s][0][mask[s][0]], start, shrink, rounds, least)
            continue
        m, x, own, tol, before = out[s], q[s], mask[s][:, None], start, None
        products = (x[:, :, :, None] * x[:, :, None, :]).reshape(len(x), -1, 9)
        for _ in range(rounds):
            h = _indices(m, x)
            near = np.rint(h)
            w = (_miss(h, near) < tol) & own
            if before is not None and tol == least and np.array_equal(w, before):
                break  # the same fit again
            weight = w.astype(float)
            a = (weight @ products).reshape(*m.shape) + 1e-9 * np.eye(3)
            near *= weight[:, :, None]
            b = (near.reshape(len(m), 3 * n, -1) @ x).reshape(*m.shape).transpose(0, 1, 3, 2)
            new = inverse(a) @ b
            good = (w.sum(axis=2) >= 6) & np.isfinite(new).all(axis=(2, 3))
            m = np.where(good[..., None, None], new, m)
            before, tol = (w if tol == least else None), max(shrink * tol, least)
        out[s] = m
    return out


def _anneal_frame(ms: np.ndarray, q: np.ndarray, start: float, shrink: float, rounds: int, least: float) -> np.ndarray:
    """The same for the bases (bases, 3, 3) of one frame, where a basis whose fit would come again is left."""
    products = (q[:, :, None] * q[:, None, :]).reshape(-1, 9)
    ms, going, m, tol, before = ms.copy(), np.arange(len(ms)), ms, start, None
    for _ in range(rounds):
        h = indices(m, q)
        near = np.rint(h)
        w = _miss(h, near) < tol
        if before is not None:
            moved = (w != before).any(axis=1)
            if not moved.all():
                ms[going[~moved]] = m[~moved]
                going, m, near, w = going[moved], m[moved], near[moved], w[moved]
        if not len(going):
            break
        weight = w.astype(float)
        a = (weight @ products).reshape(-1, 3, 3) + 1e-9 * np.eye(3)
        near *= weight[:, None]
        new = inverse(a) @ (near.reshape(-1, len(q)) @ q).reshape(-1, 3, 3).transpose(0, 2, 1)
        good = (w.sum(axis=1) >= 6) & np.isfinite(new).all(axis=(1, 2))
        m = np.where(good[:, None, None], new, m)
        before, tol = (w if tol == least else None), max(shrink * tol, least)
    ms[going] = m
    return ms
