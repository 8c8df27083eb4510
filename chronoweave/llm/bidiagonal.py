"""Singular values and right singular vectors of a small square matrix, to high relative accuracy.

Householder reflections from both sides leave an upper bidiagonal matrix; dqds transforms (differential quotient-difference
steps with shifts) find the squares of its singular values without a subtraction of unlike size; and twisted factorisations
(one elimination from the top and one from the bottom that meet where the remainder is least) give a vector for each of them.
All of it works on one matrix of the dimension of the vectors, whatever the number of rows it stands for.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps
#: Values closer than this, relative to their size, get vectors that are made orthogonal to each other.
CLUSTER = 1e-3
#: Of the largest value: below it a value cannot be told from zero.
NOISE = 64 * EPS


def bidiagonalised(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, P) with matrix = Q B P^T for some orthogonal Q."""
    a = np.array(matrix, np.float64)
    n = a.shape[1]
    p = np.eye(n)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        size = np.linalg.norm(x[1:])
        if size == 0:
            return None
        v = x.copy()
        v[0] += np.copysign(np.hypot(x[0], size), x[0])
        return v / np.linalg.norm(v)

    for k in range(n):
        if k < n - 1 and (v := reflector(a[k:, k])) is not None:
            a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k < n - 2 and (v := reflector(a[k, k + 1:])) is not None:
            a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ v, v)
            p[:, k + 1:] -= 2 * np.outer(p[:, k + 1:] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), p


def _dqds(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float]:
    """One transform; the least of the intermediate values is negative if the shift was too large."""
    n = len(q)
    new_q, new_e = np.empty(n), np.empty(n - 1)
    d = least = q[0] - shift
    for i in range(n - 1):
        new_q[i] = d + e[i]
        if new_q[i] <= 0:
            return q, e, -1.0
        ratio = q[i + 1] / new_q[i]
        new_e[i] = e[i] * ratio
        d = d * ratio - shift
        least = min(least, d)
    new_q[-1] = d
    return new_q, new_e, least


def squared_singular_values(diagonal: np.ndarray, superdiagonal: np.ndarray) -> np.ndarray:
    """Squares of the singular values of an upper bidiagonal matrix, falling."""
    scale = max(np.abs(diagonal).max(initial=0), np.abs(superdiagonal).max(initial=0))
    if scale == 0:
        return np.zeros(len(diagonal))
    tiny = (EPS * EPS) ** 2
    blocks = [(np.maximum((diagonal / scale) ** 2, tiny), (superdiagonal / scale) ** 2, 0.0, 0.0)]
    found = []
    while blocks:
        q, e, shifted, low = blocks.pop()
        while len(q):
            if len(q) == 1:
                found.append(q[0] + low + shifted)
                break
            # a negligible off-diagonal splits the block
            split = np.flatnonzero(e <= EPS * EPS * (shifted + np.minimum(q[:-1], q[1:])))
            if len(split):
                at = int(split[-1]) + 1
                blocks.append((q[:at], e[:at - 1], shifted, low))
                q, e = q[at:], e[at:]
                continue
            if q[0] * 1.5 < q[-1]:
                q, e = q[::-1].copy(), e[::-1].copy()
            # the trailing two by two part bounds the least value from above; a failed shift is cut until none is left
            a, b, c = q[-2] + (e[-3] if len(e) > 2 else 0), e[-1], q[-1]
            total, product = q[-2] + b + c, q[-2] * c
            root = np.sqrt(max(total * total - 4 * product, 0))
            guess = 2 * product / (total + root) if total + root else 0.0
            shift = guess * (1 - 2 * np.sqrt(b / (a + b + c))) if b < 0.05 * (a + c) else 0.5 * guess
            shift = max(shift, 0.0)
            for attempt in range(5):
                new_q, new_e, least = _dqds(q, e, shift if attempt < 4 else 0.0)
                if least >= 0:
                    break
                shift *= 0.25
            else:
                new_q, new_e = np.maximum(new_q, tiny), np.maximum(new_e, 0)
            if attempt == 4:
                shift = 0.0
            q, e = np.maximum(new_q, 0), new_e
            total = shifted + shift
            back = total - shifted
            low, shifted = low + (shift - back), total
    return np.sort(np.array(found))[::-1] * scale * scale


class Twisted:
    """Both eliminations of B^T B - value, from the top and from the bottom, and the place where they meet best."""

    def __init__(self, diagonal: np.ndarray, superdiagonal: np.ndarray, value: float):
        d, l = diagonal * diagonal, superdiagonal / diagonal[:-1]
        n, tiny = len(d), EPS * EPS * (d.max() + value)
        safe = lambda x: x if abs(x) > tiny else tiny
        down, up = np.empty(n), np.empty(n)
        self.lower, self.upper = np.empty(n - 1), np.empty(n - 1)
        s, p = np.empty(n), np.empty(n)
        s[0] = -value
        for i in range(n - 1):
            down[i] = safe(d[i] + s[i])
            self.lower[i] = d[i] * l[i] / down[i]
            s[i + 1] = self.lower[i] * l[i] * s[i] - value
        down[-1] = safe(d[-1] + s[-1])
        p[-1] = d[-1] - value
        for i in range(n - 2, -1, -1):
            up[i + 1] = safe(d[i] * l[i] * l[i] + p[i + 1])
            ratio = d[i] / up[i + 1]
            self.upper[i] = l[i] * ratio
            p[i] = p[i + 1] * ratio - value
        up[0] = safe(p[0])
        self.meet = s + p + value
        self.at = int(np.argmin(np.abs(self.meet)))
        self.down, self.up, self.safe = down, up, safe

    def vector(self) -> np.ndarray:
        """The vector that both eliminations leave at their meeting place, of length one."""
        z = np.zeros(len(self.down))
        z[self.at] = 1
        for i in range(self.at - 1, -1, -1):
            z[i] = -self.lower[i] * z[i + 1]
        for i in range(self.at, len(z) - 1):
            z[i + 1] = -self.upper[i] * z[i]
        return z / np.linalg.norm(z)

    def solved(self, right: np.ndarray) -> np.ndarray:
        """(B^T B - value)^-1 right, by the same factorisation; of length one."""
        y, r, n = right.copy(), self.at, len(right)
        for i in range(r):
            y[i + 1] -= self.lower[i] * y[i]
        for i in range(n - 1, r, -1):
            y[i - 1] -= self.upper[i - 1] * y[i]
        x = np.empty(n)
        x[r] = y[r] / self.safe(self.meet[r])
        for i in range(r - 1, -1, -1):
            x[i] = y[i] / self.down[i] - self.lower[i] * x[i + 1]
        for i in range(r + 1, n):
            x[i] = y[i] / self.up[i] - self.upper[i - 1] * x[i - 1]
        return x / np.linalg.norm(x)


def _vectors(diagonal: np.ndarray, superdiagonal: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Columns: right singular vectors of an unsplit bidiagonal block for its squared values, falling."""
    n = len(diagonal)
    if n == 1:
        return np.ones((1, 1))
    size = max(np.abs(diagonal).max(), np.abs(superdiagonal).max())
    diagonal = np.where(np.abs(diagonal) < EPS * EPS * size, EPS * EPS * size, diagonal)
    out, first = np.empty((n, n)), 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * values[k - 1]:
            first = k
        twisted = Twisted(diagonal, superdiagonal, value)
        z = twisted.vector()
        near = out[:, first:k]
        for attempt in range(1, 5 if k > first else 1):  # equal values: any basis of their space will do
            z = z - near @ (near.T @ z)
            z = z - near @ (near.T @ z)
            if np.linalg.norm(z) < 1e-6:
                z = np.random.default_rng(attempt).standard_normal(n)
                z -= near @ (near.T @ z)
            z = twisted.solved(z / np.linalg.norm(z))
        if k > first:
            for _ in range(2):
                z -= near @ (near.T @ z)
                z /= np.linalg.norm(z)
        out[:, k] = z
    return out


def right_singular(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared singular values, falling; right singular vectors as columns)."""
    diagonal, above, p = bidiagonalised(matrix)
    n = len(diagonal)
    size = max(np.abs(diagonal).max(initial=0), np.abs(above).max(initial=0))
    cuts = [0, *(np.flatnonzero(np.abs(above) <= EPS * EPS * size) + 1).tolist(), n]
    values, vectors = [], np.zeros((n, n))
    for a, b in zip(cuts, cuts[1:]):
        found = squared_singular_values(diagonal[a:b], above[a:b - 1])
        vectors[a:b, a:b] = _vectors(diagonal[a:b], above[a:b - 1], found)
        values.extend(found)
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], p @ vectors[:, order]
