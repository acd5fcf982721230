"""Singular values and right singular vectors of a small matrix: Householder bidiagonalisation, dqds,
twisted factorisations.

The differential quotient-difference iteration with shifts only adds, multiplies and divides positive numbers,
so every singular value of the bidiagonal matrix comes out with a small relative error. A vector is the
solution of a twisted factorisation of B'B - s I at the place where its twist is least; vectors of values too
close to be told apart that way are made orthogonal to each other.
"""

from __future__ import annotations

import numpy as np

_EPS = float(np.finfo(float).eps)
_TINY = float(np.finfo(float).tiny)


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(d, f, v): diagonal and superdiagonal of an upper bidiagonal B with R = U B v'."""
    a = np.array(r, dtype=float)
    n = a.shape[1]
    v = np.eye(n)

    def reflector(x):
        w = x.copy()
        norm = np.linalg.norm(x)
        w[0] += np.copysign(norm, x[0])
        size = np.linalg.norm(w)
        return w / size if size else w

    for k in range(n):
        w = reflector(a[k:, k])
        a[k:, k:] -= 2 * np.outer(w, w @ a[k:, k:])
        if k < n - 2:
            w = reflector(a[k, k + 1:])
            a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ w, w)
            v[:, k + 1:] -= 2 * np.outer(v[:, k + 1:] @ w, w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _dqds_step(q: np.ndarray, e: np.ndarray, shift: float):
    """One differential qd transform with a shift; None where the shift was too large."""
    n = len(q)
    new_q, new_e = np.empty(n), np.empty(n - 1)
    d = q[0] - shift
    for i in range(n - 1):
        if d < 0:
            return None
        new_q[i] = d + e[i]
        if new_q[i] == 0.0:
            t = 0.0 if e[i] == 0.0 else np.inf
            new_e[i] = 0.0
            d = q[i + 1] - shift if t == 0.0 else d
            continue
        t = q[i + 1] / new_q[i]
        new_e[i] = e[i] * t
        d = d * t - shift
    if d < 0:
        return None
    new_q[n - 1] = d
    return new_q, new_e


def _sure_shift(q: np.ndarray, e: np.ndarray) -> float:
    """A shift that can't pass the least eigenvalue: one over the trace of the inverse (a Newton step from
    below). The inverse's diagonal has a recurrence of positive terms."""
    x = total = 0.0
    for i in range(len(q) - 1, -1, -1):
        if q[i] == 0.0:
            return 0.0
        x = (1.0 + (e[i] * x if i < len(e) else 0.0)) / q[i]
        total += x
    return (1.0 - 8 * len(q) * _EPS) / total if np.isfinite(total) else 0.0


def _bold_shift(q: np.ndarray, e: np.ndarray) -> float:
    """The lesser eigenvalue of the last two rows: near the least one when the iteration has gone on a while."""
    a, b, c = q[-2], e[-1], q[-1]
    total = a + b + c
    return 0.0 if total == 0.0 else 2 * (a * c) / (total + np.sqrt(max(0.0, total * total - 4 * a * c)))


def singular_values(d: np.ndarray, f: np.ndarray) -> np.ndarray:
    """All singular values of the bidiagonal matrix, falling, by dqds with deflation."""
    scale = float(max(np.abs(d).max(initial=0.0), np.abs(f).max(initial=0.0)))
    if scale == 0.0:
        return np.zeros(len(d))
    out: list[float] = []
    todo = [((d / scale) ** 2, (f / scale) ** 2, 0.0)]
    while todo:
        q, e, moved = todo.pop()
        tries = 0
        while True:
            n = len(q)
            if n == 0:
                break
            if n == 1:
                out.append(q[0] + moved)
                break
            cut = np.flatnonzero(e <= (4 * _EPS) ** 2 * (moved + np.minimum(q[1:], q[:-1])))
            if len(cut):  # an off-diagonal that is nothing to its neighbours: two matrices
                k = int(cut[-1])
                todo.append((q[:k + 1], e[:k], moved))
                q, e, tries = q[k + 1:], e[k + 1:], 0
                continue
            if tries == 0 and q[0] < q[-1]:  # the other way up: small values should come last
                q, e = q[::-1].copy(), e[::-1].copy()
            step = _dqds_step(q, e, shift := _bold_shift(q, e) * (1 - 1e-2 / (1 + tries))) if tries else None
            if step is None:
                step = _dqds_step(q, e, shift := _sure_shift(q, e)) or _dqds_step(q, e, shift := 0.0)
            q, e = step
            moved += shift
            tries += 1
            if tries > 400:
                raise ArithmeticError("dqds did not settle")
    return scale * np.sqrt(np.sort(np.maximum(np.array(out), 0.0))[::-1])


def twisted_vector(d: np.ndarray, f: np.ndarray, value: float, start: int = 0) -> np.ndarray:
    """A unit vector z with B'B z close to value^2 z: the ``start``-th best twist."""
    n = len(d)
    lam = value * value
    if n == 1:
        return np.ones(1)
    q, e = d * d, f * f
    off = d[:-1] * f  # off-diagonal of T = B'B
    diag = q.copy()
    diag[1:] += e
    small = _EPS * max(lam, float(diag.max()), _TINY) * 1e-3
    # from above: T - lam = L D L', by the stationary transform; from below: U P U', by the progressive one
    down, up = np.empty(n), np.empty(n)
    s = -lam
    for i in range(n):
        down[i] = s + q[i]
        if abs(down[i]) < small:
            down[i] = -small
        if i < n - 1:
            s = s * e[i] / down[i] - lam if q[i] == 0 else (e[i] / down[i]) * s - lam
    p = q[n - 1] - lam
    for i in range(n - 1, -1, -1):
        if i == n - 1:
            under = p
            up[i] = p + e[i - 1]
        else:
            if abs(up[i + 1]) < small:
                up[i + 1] = -small
            under = (q[i] / up[i + 1]) * under - lam
            up[i] = under + (e[i - 1] if i else 0.0)
    up = np.where(np.abs(up) < small, -small, up)
    # gamma: both factorisations meet at the twist
    gamma = down.copy()
    gamma[:-1] = down[:-1] - off * off / up[1:]
    k = int(np.argsort(np.abs(gamma), kind="stable")[min(start, n - 1)])
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -off[i] / down[i] * z[i + 1]
    for i in range(k + 1, n):
        z[i] = -off[i - 1] / up[i] * z[i - 1]
    return z / np.linalg.norm(z)


def _without(z: np.ndarray, earlier: list[np.ndarray]) -> np.ndarray:
    """``z`` without what it has of ``earlier``."""
    for _ in range(2):
        for w in earlier:
            z = z - (w @ z) * w
    return z


def _tridiagonal(d: np.ndarray, f: np.ndarray) -> np.ndarray:
    diag, off = d * d, d[:-1] * f
    diag[1:] += f * f
    return np.diag(diag) + np.diag(off, 1) + np.diag(off, -1)


def _residual(d: np.ndarray, f: np.ndarray, value: float, z: np.ndarray) -> float:
    return float(np.abs(_tridiagonal(d, f) @ z - value * value * z).max())


def right_vectors(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns): the ``most`` largest singular values of a square matrix and their right
    singular vectors, fewer where the matrix has a lower rank (to double precision)."""
    d, f, v = bidiagonalise(r)
    values = singular_values(d, f)
    n = len(values)
    top = values[0] if n else 0.0
    # where the superdiagonal is nothing, B falls into blocks with distinct values each
    ends = [0, *(np.flatnonzero(np.abs(f) <= 8 * _EPS * top) + 1), n]
    of = sorted(((s, lo, hi) for lo, hi in zip(ends[:-1], ends[1:]) if lo < hi
                 for s in singular_values(d[lo:hi], f[lo:hi - 1])), key=lambda t: -t[0])
    found: list[tuple[float, int, np.ndarray]] = []
    for value, lo, hi in of[:most]:
        if value <= n * _EPS * top:
            break
        close = [z for s, at, z in found if at == lo and s - value <= 1e-3 * s]
        z = _block_vector(d[lo:hi], f[lo:hi - 1], value, close, top)
        found.append((value, lo, z))
    vectors = np.zeros((n, len(found)))
    for k, (_, lo, z) in enumerate(found):
        vectors[lo:lo + len(z), k] = z
    return values, v @ vectors


def _block_vector(d: np.ndarray, f: np.ndarray, value: float, close: list[np.ndarray], top: float) -> np.ndarray:
    """The block's vector for this value, orthogonal to those of values close to it."""
    for start in range(len(d)):  # beside close values another twist gives another direction
        z = _without(twisted_vector(d, f, value, start), close)
        size = float(np.linalg.norm(z))
        if size > 0.1:
            break
    z = z / (size or 1.0)
    if close or _residual(d, f, value, z) > 64 * _EPS * top ** 2:
        for _ in range(3):  # inverse iteration mends what the twist could not tell apart
            z = _solve(d, f, value, z)
            z = _without(z / np.linalg.norm(z), close)
            z = z / np.linalg.norm(z)
    return z


def _solve(d: np.ndarray, f: np.ndarray, value: float, right: np.ndarray) -> np.ndarray:
    """(B'B - s I)^-1 right, with s a little off the value, by elimination with row exchanges."""
    lam = value * value
    return np.linalg.solve(_tridiagonal(d, f) - np.eye(len(d)) * (lam + 4 * _EPS * lam + _TINY), right)
