"""Singular values and right vectors of a small triangle by a bidiagonal qd solver.

Householder reflections make the triangle bidiagonal; differential qd steps with
shifts find the squared singular values to high relative accuracy; and every
vector comes from the twisted factorisation with the smallest pivot, which is
one forward and one backward qd sweep. Vectors whose values lie close together
are made orthogonal to each other by inverse iteration.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
# Values nearer than this, relative to the larger, count as a cluster.
CLUSTER = 1e-3
SWEEPS = 60  # of qd steps for each value, far more than it takes


def bidiagonalize(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and ``v`` with ``u.T @ r @ v`` upper bidiagonal for some orthogonal ``u``."""
    a, d = np.array(r, float), len(r)
    v = np.eye(d)

    def mirror(x: np.ndarray) -> tuple[np.ndarray, float]:
        scale = np.abs(x).max(initial=0)
        if scale == 0:
            return x, 0.0
        w = x / scale
        w[0] += np.copysign(np.sqrt(w @ w), w[0])
        return w, 2 / (w @ w)

    for k in range(d):
        w, t = mirror(a[k:, k].copy())
        a[k:, k:] -= t * np.outer(w, w @ a[k:, k:])
        if k + 2 < d:
            w, t = mirror(a[k, k + 1:].copy())
            a[k:, k + 1:] -= t * np.outer(a[k:, k + 1:] @ w, w)
            v[:, k + 1:] -= t * np.outer(v[:, k + 1:] @ w, w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """A differential qd step with a shift; None if the shift is above the smallest value."""
    out_q, out_e = [], []
    d = q[0] - shift
    for k in range(len(e)):
        if d < 0:
            return None
        top = d + e[k]
        if top == 0:
            return None
        ratio = q[k + 1] / top
        out_q.append(top)
        out_e.append(e[k] * ratio)
        d = d * ratio - shift
    if d < 0:
        return None
    out_q.append(d)
    return out_q, out_e


def _shifts(q: list[float], e: list[float]) -> list[float]:
    """Shifts to try in turn: the smallest value of the last two rows, a bound that is surely below, and none."""
    last, before, link = q[-1], q[-2] + (e[-2] if len(e) > 1 else 0.0), e[-1]
    half = (before + link + last) / 2
    root = np.sqrt(max(0.0, half * half - before * last))
    low = before * last / (half + root) if half + root > 0 else 0.0
    total = back = 1 / q[0] if q[0] > 0 else np.inf
    for k in range(len(e)):
        back = (1 + e[k] * back) / q[k + 1] if q[k + 1] > 0 else np.inf
        total += back
    sure = 1 / total if np.isfinite(total) else 0.0
    return [low * (1 - 4 * EPS), sure * (1 - 1e-6), 0.0]


def squared_values(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Eigenvalues of ``B.T @ B`` in falling order, for squared diagonal ``q`` > 0 and squared superdiagonal ``e``."""
    parts, found = [(list(map(float, q)), list(map(float, e)), 0.0)], []
    while parts:
        q, e, base = parts.pop()
        sweeps = 0
        while len(q) > 1:
            if e[-1] <= EPS * EPS * (base + q[-1]):
                found.append(base + q.pop())
                e.pop()
                sweeps = 0
                continue
            cut = next((k for k in range(len(e) - 2, -1, -1) if e[k] <= EPS * EPS * (base + min(q[k], q[k + 1]))), None)
            if cut is not None:
                parts.append((q[:cut + 1], e[:cut], base))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            if 1.5 * q[0] < q[-1]:
                q, e = q[::-1], e[::-1]
            sweeps += 1
            if sweeps > SWEEPS * len(q):
                raise ArithmeticError("qd steps do not converge")
            for shift in _shifts(q, e):
                made = _step(q, e, shift)
                if made is not None:
                    q, e = made
                    base += shift
                    break
            else:
                # A zero among the values: it comes out at the end by a step without shift.
                q = [max(x, np.finfo(float).tiny) for x in q]
        found.append(base + q[0])
    return np.sort(np.array(found))[::-1]


def _twisted(q: np.ndarray, low: np.ndarray, value: float, start: np.ndarray | None = None) -> np.ndarray:
    """A vector of ``L D L.T - value`` (``D`` is q, ``L`` has ``low`` below its diagonal) for a value of it.

    The forward sweep gives ``L+ D+ L+.T``, the backward sweep ``U- D- U-.T``;
    they meet where the pivot is smallest. With ``start`` it is one step of
    inverse iteration by elimination instead.
    """
    n = len(q)
    floor = np.finfo(float).tiny ** 0.5
    s, p, forward, backward = np.empty(n), np.empty(n), np.empty(n - 1), np.empty(n - 1)
    s[0] = -value
    for k in range(n - 1):
        pivot = s[k] + q[k]
        pivot = pivot if abs(pivot) > floor else np.copysign(floor, pivot)
        forward[k] = q[k] * low[k] / pivot
        s[k + 1] = forward[k] * low[k] * s[k] - value
    p[-1] = q[-1] - value
    for k in range(n - 2, -1, -1):
        pivot = q[k] * low[k] ** 2 + p[k + 1]
        pivot = pivot if abs(pivot) > floor else np.copysign(floor, pivot)
        backward[k] = low[k] * q[k] / pivot
        p[k] = p[k + 1] * q[k] / pivot - value
    gamma = s + p + value
    r = int(np.argmin(np.where(np.isfinite(gamma), np.abs(gamma), np.inf)))
    z = np.zeros(n)
    if start is None:
        z[r] = 1.0
    else:
        # N D N.T z = start, with N from the forward part above r and the backward part below.
        y = start.astype(float).copy()
        for k in range(r):
            y[k + 1] -= forward[k] * y[k]
        for k in range(n - 2, r - 1, -1):
            y[k] -= backward[k] * y[k + 1]
        pivots = np.concatenate((s[:r] + q[:r], [gamma[r]], (q[:-1] * low ** 2 + p[1:])[r:]))
        pivots = np.where(np.abs(pivots) > floor, pivots, floor)
        z = y / pivots
        peak = np.abs(z).max()
        z = z / peak if peak > 0 and np.isfinite(peak) else z
    for k in range(r - 1, -1, -1):
        z[k] -= forward[k] * z[k + 1]
    for k in range(r, n - 1):
        z[k + 1] -= backward[k] * z[k]
    return z / np.sqrt(z @ z)


def _times(q: np.ndarray, low: np.ndarray, z: np.ndarray) -> np.ndarray:
    y = z.copy()
    y[:-1] += low * z[1:]
    y *= q
    y[1:] += low * y[:-1]
    return y


def _block_vectors(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors, as columns, of ``B.T @ B`` of an unreduced block for the first values of it."""
    if len(a) == 1:
        return np.ones((1, len(values)))
    q, low = a * a, b / a[:-1]
    out = np.empty((len(a), len(values)))
    draw = np.random.default_rng(11)
    clear = lambda z, near: z - near @ (near.T @ z)
    first = 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * values[k - 1]:
            first = k
        z, near, best = _twisted(q, low, value), out[:, first:k], None
        for _ in range(8):
            rest = clear(z, near)
            size = np.sqrt(rest @ rest)
            if size > 0:
                rest = clear(rest / size, near)
                rest /= np.sqrt(rest @ rest)
                off = np.abs(_times(q, low, rest) - value * rest).max()
                if best is None or off < best[0]:
                    best = off, rest
                if size > 0.5:
                    break
            start = clear(draw.normal(size=len(a)), near)
            z = _twisted(q, low, value, start / np.sqrt(start @ start))
        z = best[1] if best is not None else start / np.sqrt(start @ start)
        out[:, k] = z
    return out


def right_vectors(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All squared singular values of a square ``r``, falling, and the first ``most`` of them with their right vectors.

    The vectors are columns and orthonormal. Values that are zero up to rounding
    are left out of the second and third result.
    """
    scale = np.abs(r).max(initial=0)
    if scale == 0:
        return np.zeros(len(r)), np.empty(0), np.empty((len(r), 0))
    a, b, v = bidiagonalize(r / scale)
    size = max(np.abs(a).max(), np.abs(b).max(initial=0))
    # Changes below the rounding of the largest value: no zero on the diagonal, and no link that counts for nothing.
    a = np.copysign(np.maximum(np.abs(a), EPS * EPS * size), a)
    b = np.where(np.abs(b) <= 8 * EPS * size, 0.0, b)
    edges = [0, *(np.flatnonzero(b == 0) + 1).tolist(), len(a)]
    values, owners = [], []
    for n, (i, j) in enumerate(zip(edges, edges[1:])):
        found = squared_values(a[i:j] ** 2, b[i:j - 1] ** 2)
        values.append(found)
        owners.append(np.full(len(found), n))
    every, owner = np.concatenate(values), np.concatenate(owners)
    order = np.argsort(-every, kind="stable")
    floor = (len(r) * EPS) ** 2 * every.max()
    chosen = np.array([k for k in order[:most] if every[k] > floor], int)
    z = np.zeros((len(a), len(chosen)))
    for n, (i, j) in enumerate(zip(edges, edges[1:])):
        own = np.flatnonzero(owner[chosen] == n)
        z[i:j, own] = _block_vectors(a[i:j], b[i:j - 1], every[chosen[own]])
    return every[order] * scale * scale, every[chosen] * scale * scale, v @ z
