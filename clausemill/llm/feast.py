"""Largest eigenpairs of a small symmetric matrix by contour integration (FEAST).

For an interval (a, b) the spectral projector is the integral of the resolvent along
a circle through a and b.  A quadrature of complex shifted solves applies a good
approximation of it to a block of vectors; Rayleigh-Ritz on the result extracts
eigenpairs; the two steps are repeated until the residuals vanish (Polizzi,
"Density-matrix-based algorithm for solving eigenvalue problems", 2009).  By
Sylvester's law of inertia the negative pivots of a shifted LDL' factorisation count
the eigenvalues below the shift, which tells where the intervals have to be cut and
proves that none in them was missed.

The matrix has one row a dimension, so its size does not depend on the table.
"""

from __future__ import annotations

import numpy as np

#: Quadrature points on the half circle, most eigenvalues that an interval should have, and rounds of refinement.
POINTS, MOST, ROUNDS = 8, 6, 40
#: Residuals below this share of the matrix norm count as none.
TOLERANCE = 1e-13
_ALPHA = (1 + 17**0.5) / 8


def below(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues under ``shift``: negative pivots of a factorisation with complete (Bunch-Parlett) pivoting."""
    a = matrix - shift * np.eye(len(matrix))
    negative = 0
    while len(a):
        sizes = np.abs(a)
        diagonal = np.diag(sizes)
        p = int(np.argmax(diagonal))
        r, s = np.unravel_index(int(np.argmax(sizes - np.diag(diagonal))), a.shape)
        if diagonal[p] == 0 and sizes[r, s] == 0:
            break  # what is left is zero: eigenvalues at the shift
        pivots = [p] if diagonal[p] >= _ALPHA * sizes[r, s] else [int(r), int(s)]
        rest = np.delete(np.arange(len(a)), pivots)
        block = a[np.ix_(pivots, pivots)]
        negative += int(block[0, 0] < 0) if len(pivots) == 1 else 1  # an indefinite 2 by 2 block has one of each sign
        side = a[np.ix_(rest, pivots)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(block, side.T)
        a = (a + a.T) / 2
    return negative


def project(matrix: np.ndarray, a: float, b: float, block: np.ndarray, points: int = POINTS) -> np.ndarray:
    """The quadrature of the contour integral around (a, b), applied to a block of vectors."""
    nodes, weights = np.polynomial.legendre.leggauss(points)
    middle, radius = (a + b) / 2, (b - a) / 2
    out = np.zeros_like(block)
    for x, w in zip(nodes, weights, strict=True):
        turn = radius * np.exp(1j * np.pi / 2 * (1 + x))
        out += w / 2 * np.real(turn * np.linalg.solve((middle + turn) * np.eye(len(matrix)) - matrix, block.astype(complex)))
    return out


def ritz(matrix: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rayleigh-Ritz pairs on the span of a block, by rising value."""
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    u = u[:, s > s[0] * 1e-14] if s[0] else u[:, :0]
    values, vectors = np.linalg.eigh(u.T @ matrix @ u)
    return values, u @ vectors


def inside(matrix: np.ndarray, a: float, b: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs of (a, b), as its inertia says."""
    d, norm = len(matrix), np.abs(matrix).sum(axis=0).max()
    size = min(d, max(2 * count, count + 6))
    while True:
        block = np.random.Generator(np.random.PCG64(size)).standard_normal((d, size))
        best = None
        for _ in range(ROUNDS):
            values, vectors = ritz(matrix, project(matrix, a, b, block))
            here = np.flatnonzero((values > a) & (values < b))
            rest = np.linalg.norm(matrix @ vectors[:, here] - vectors[:, here] * values[here], axis=0)
            if len(here) == count and (best is None or rest.max() < best[0]):
                best = (rest.max(), values[here], vectors[:, here])
                if best[0] <= TOLERANCE * norm:
                    return best[1:]
            elif best is not None and best[0] <= 100 * TOLERANCE * norm:
                return best[1:]  # at the limit of the arithmetic
            block = vectors if vectors.shape[1] else block
        if best is not None and best[0] <= 1e-9 * norm:
            return best[1:]
        if size == d:
            raise ArithmeticError(f"{count} eigenvalues lie between {a} and {b}, but they were not all found")
        size = min(d, 2 * size)


def slices(matrix: np.ndarray, low: float, high: float, most: int = MOST) -> list[tuple[float, float, int]]:
    """(a, b, eigenvalues) of intervals that cover (low, high), each with few eigenvalues or no room for a cut."""
    found, stack = [], [(low, high, below(matrix, low), below(matrix, high))]
    while stack:
        a, b, first, last = stack.pop()
        if last == first:
            continue
        cut = a + (b - a) / 2
        if last - first <= most or b - a <= 1e-7 * max(abs(low), abs(high)) or not a < cut < b:
            found.append((a, b, last - first))
            continue
        k = below(matrix, cut)
        stack += [(a, cut, first, k), (cut, b, k, last)]
    return found


def largest(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and unit vectors (columns) of the ``count`` largest eigenvalues by falling value; fewer if the rank is less.

    Each vector's largest entry is positive.  Eigenvalues within rounding of zero
    count as zero.
    """
    d = len(matrix)
    norm = float(np.abs(matrix).sum(axis=0).max()) if d else 0.0  # no eigenvalue is larger
    if not norm:
        return np.zeros(0), np.zeros((d, 0))
    scaled = matrix / norm
    floor, high = 4 * d * np.finfo(float).eps, 1 + 1e-9
    count = min(count, d - below(scaled, floor))
    if not count:
        return np.zeros(0), np.zeros((d, 0))
    # the lower edge: at least ``count`` eigenvalues above it and, where no tie forbids it, no more
    low, over = floor, high
    while d - below(scaled, low) > count and over - low > 1e-12 * over:
        cut = (low * over) ** 0.5 if over > 4 * low else (low + over) / 2
        low, over = (cut, over) if d - below(scaled, cut) >= count else (low, cut)
    blocks = [inside(scaled, a, b, n)[1] for a, b, n in slices(scaled, low, high)]
    values, vectors = ritz(scaled, np.column_stack(blocks))  # once more for all, which makes them orthogonal across the cuts
    values, vectors = values[::-1][:count] * norm, vectors[:, ::-1][:, :count]
    signs = np.sign(vectors[np.argmax(np.abs(vectors), axis=0), np.arange(vectors.shape[1])])
    return values, vectors * signs
