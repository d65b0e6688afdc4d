"""Singular values and right singular vectors of a small square matrix: Householder bidiagonals, dqds, twisted factorisations.

Everything here works on one d x d matrix, d being the dimension of the vectors.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and superdiagonal of B, and W, for r = U B W^T with Householder reflections from both sides."""
    a = r.astype(float).copy()
    n = len(a)
    w = np.eye(n)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        norm = np.linalg.norm(x)
        if norm == 0 or not np.any(x[1:]):
            return None
        v = x.copy()
        v[0] += norm if x[0] >= 0 else -norm
        return v / np.linalg.norm(v)

    for k in range(n):
        v = reflector(a[k:, k])
        if v is not None:
            a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k + 2 < n:
            v = reflector(a[k, k + 1:])
            if v is not None:
                a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ v, v)
                w[:, k + 1:] -= 2 * np.outer(w[:, k + 1:] @ v, v)
    return np.diagonal(a).copy(), np.diagonal(a, 1).copy(), w


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float, bool]:
    """One differential quotient-difference step with a shift: the new q and e, the least d, and whether all stayed
    positive. Without a shift nothing is subtracted, so every result has high relative accuracy."""
    n = len(q)
    new_q, new_e = [0.0] * n, [0.0] * (n - 1)
    d = q[0] - shift
    least = d
    if d < 0:
        return q, e, d, False
    for i in range(n - 1):
        new_q[i] = d + e[i]
        if new_q[i] == 0.0:
            return q, e, 0.0, False
        ratio = q[i + 1] / new_q[i]
        new_e[i] = e[i] * ratio
        d = d * ratio - shift
        least = min(least, d)
        if not d >= 0:
            return q, e, d, False
    new_q[n - 1] = d
    return new_q, new_e, least, True


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """All singular values of the upper bidiagonal matrix, falling, by the differential qd algorithm with shifts.

    Shifts are subtracted from squared values and summed up; one that drives a d below zero is taken back and made
    smaller, the last resort being none, which always succeeds.
    """
    n = len(diagonal)
    if not n:
        return np.zeros(0)
    scale = max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0))
    if scale == 0:
        return np.zeros(n)
    q = ((np.asarray(diagonal) / scale) ** 2).tolist()
    e = ((np.asarray(above) / scale) ** 2).tolist()
    found: list[float] = []
    work = [(q, e, 0.0, 0.0)]            # q, e, sum of the shifts, least d of the last step
    while work:
        q, e, taken, least = work.pop()
        steps = 0
        while True:
            n = len(q)
            if n == 1:
                found.append(q[0] + taken)
                break
            # An e that is nothing beside both neighbours splits the matrix.
            cut = next((i for i in range(n - 2, -1, -1)
                        if e[i] <= EPS * EPS * min(q[i] + taken, q[i + 1] + taken) or e[i] < 1e-300), None)
            if cut is not None:
                work.append((q[:cut + 1], e[:cut], taken, 0.0))
                q, e, least = q[cut + 1:], e[cut + 1:], 0.0
                continue
            if 1.5 * q[0] < q[-1]:       # the small values belong at the end
                q, e = q[::-1], e[::-1]
                least = 0.0
            steps += 1
            shift = 0.0
            if least > 0 and steps > 2:
                shift = least * (0.98 if e[-1] < 0.01 * q[-1] else 0.5)
            done = False
            while shift > EPS * (taken + least):
                new_q, new_e, d, done = _sweep(q, e, shift)
                if done:
                    break
                shift /= 8
            if not done:
                shift = 0.0
                new_q, new_e, d, done = _sweep(q, e, 0.0)
                if not done:             # a zero q in front of a zero e
                    new_q, new_e, d = [x + 1e-300 for x in q], e, 0.0
            q, e, least, taken = new_q, new_e, d, taken + shift
    return scale * np.sqrt(np.sort(np.array(found))[::-1])


def _twisted(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Eigenvectors of B^T B for the given squared values, one to a column, from its twisted factorisations.

    B^T B = L D L^T with D = a^2 and L = b / a. L D L^T - x = L+ D+ L+^T from the top and = U- D- U-^T from the bottom are
    joined where the twist element is least, and the vector follows from the two unit triangles by products alone.
    """
    n, m = len(a), len(values)
    tiny = np.finfo(float).tiny ** 0.5
    d, l = a * a, b / a[:-1]
    down, up = np.empty((n, m)), np.empty((n, m))      # D+ and D-
    left, right = np.empty((n - 1, m)), np.empty((n - 1, m))
    s = np.empty((n, m))
    p = np.empty((n, m))
    s[0] = -values
    for i in range(n - 1):
        down[i] = s[i] + d[i]
        down[i] = np.where(np.abs(down[i]) < tiny, tiny, down[i])
        left[i] = d[i] * l[i] / down[i]
        s[i + 1] = left[i] * l[i] * s[i] - values
    p[n - 1] = d[n - 1] - values
    for i in range(n - 2, -1, -1):
        up[i + 1] = d[i] * l[i] * l[i] + p[i + 1]
        up[i + 1] = np.where(np.abs(up[i + 1]) < tiny, tiny, up[i + 1])
        right[i] = d[i] * l[i] / up[i + 1]
        p[i] = p[i + 1] * d[i] / up[i + 1] - values
    twist = np.abs(s + p + values).argmin(axis=0)
    z = np.zeros((n, m))
    z[twist, np.arange(m)] = 1.0
    for i in range(n - 2, -1, -1):
        z[i] = np.where(i < twist, -left[i] * z[i + 1], z[i])
    for i in range(n - 1):
        z[i + 1] = np.where(i >= twist, -right[i] * z[i], z[i + 1])
    return z / np.linalg.norm(z, axis=0)


def _refined(a: np.ndarray, b: np.ndarray, values: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Vectors of values that lie close together: made orthogonal, and found by inverse iteration where they coincide."""
    n = len(a)
    t = np.diag(a * a + np.concatenate([[0.0], b * b])) + np.diag(a[:-1] * b, 1) + np.diag(a[:-1] * b, -1)
    scale = max(float(np.abs(t).max()), 1e-300)
    start = 0
    for stop in range(1, len(values) + 1):
        if stop < len(values) and values[stop - 1] - values[stop] <= 1e-3 * values[stop - 1]:
            continue
        if stop - start > 1:
            x = z[:, start:stop]
            q, r = np.linalg.qr(x)
            if np.abs(np.diagonal(r)).min() < 0.1:
                shift = values[start:stop].mean() + 4 * EPS * scale
                q = np.linalg.qr(np.random.default_rng(n).normal(size=x.shape))[0]
                for _ in range(4):
                    q = np.linalg.qr(np.linalg.solve(t - shift * np.eye(n), q))[0]
            inner, turn = np.linalg.eigh(q.T @ t @ q)
            z[:, start:stop] = q @ turn[:, ::-1]
        start = stop
    return z


def right_vectors(r: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest ``count`` singular values of r, falling, and their right singular vectors as columns.

    Values that are nothing beside the largest one (d times the machine precision) have no direction and are left out.
    """
    d = len(r)
    if not d:
        return np.zeros(0), np.zeros((0, 0))
    a, b, w = bidiagonalise(r)
    sigma = dqds(a, b)
    keep = int((sigma > d * EPS * sigma[0]).sum()) if sigma[0] > 0 else 0
    keep = min(keep, count)
    scale = sigma[0] if keep else 1.0
    a, b = a / scale, b / scale
    # Each unreduced part of B has its own vectors.
    edges = [0, *[i + 1 for i in range(d - 1) if abs(b[i]) <= EPS * (abs(a[i]) + abs(a[i + 1]))], d]
    pairs: list[tuple[float, int, np.ndarray]] = []
    for lo, hi in zip(edges, edges[1:]):
        part_a, part_b = a[lo:hi], b[lo:hi - 1]
        part_a = np.where(np.abs(part_a) < EPS * EPS, EPS * EPS, part_a)
        values = dqds(part_a, part_b)
        values = values[:min(len(values), keep)]
        z = _refined(part_a, part_b, values ** 2, _twisted(part_a, part_b, values ** 2)) if hi - lo > 1 else np.ones((1, len(values)))
        for k, value in enumerate(values):
            full = np.zeros(d)
            full[lo:hi] = z[:, k]
            pairs.append((float(value), lo, full))
    pairs.sort(key=lambda x: (-x[0], x[1]))
    vectors = np.array([v for _, _, v in pairs[:keep]]).reshape(keep, d).T
    return sigma[:keep], w @ vectors
