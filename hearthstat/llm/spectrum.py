"""Leading eigenpairs of a small symmetric matrix by spectrum slicing.

By Sylvester's law of inertia, an LDLᵀ factorisation of `a - s` has as many positive
pivots as `a` has eigenvalues above `s`. Bisection on these counts shuts each leading
eigenvalue up alone in an interval; Rayleigh quotient iteration, which converges
cubically, finds it there; counts on both sides of what it found certify its number.
"""

from __future__ import annotations

import numpy as np

ALPHA = (1 + 17**0.5) / 8
#: Eigenvalues nearer than this share of the matrix's norm are one to double precision.
TIE = 64 * np.finfo(float).eps
#: What is left of the norm below this share is rounding, not variance.
NOTHING = 1e-12


def above(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of `a` lie above the shift: positive pivots of LDLᵀ with symmetric pivoting."""
    a = a - shift * np.eye(len(a))
    n, k, positive = len(a), 0, 0
    while k < n:
        below = np.abs(a[k + 1 :, k])
        most = below.max() if len(below) else 0.0
        two = False
        if abs(a[k, k]) < ALPHA * most:
            r = k + 1 + int(below.argmax())
            row = np.abs(a[r, k:])
            row[r - k] = 0.0
            if abs(a[k, k]) * row.max() < ALPHA * most * most:
                two = abs(a[r, r]) < ALPHA * row.max()
                swap = [k + two, r]
                a[swap] = a[swap[::-1]]
                a[:, swap] = a[:, swap[::-1]]
        if two:
            # Such a block is indefinite: one eigenvalue on each side.
            rest = a[k + 2 :, k : k + 2]
            a[k + 2 :, k + 2 :] -= rest @ np.linalg.solve(a[k : k + 2, k : k + 2], rest.T)
            positive += 1
            k += 2
        else:
            if a[k, k]:
                rest = a[k + 1 :, k]
                a[k + 1 :, k + 1 :] -= np.outer(rest, rest / a[k, k])
            positive += bool(a[k, k] > 0)
            k += 1
    return positive


def _apart(x: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    """The unit vector along what of x is orthogonal to those found; projected twice, for rounding."""
    for _ in range(2):
        for q in found:
            x = x - (q @ x) * q
    return x / np.linalg.norm(x)


def _nearest(a: np.ndarray, shift: float, found: list[np.ndarray], norm: float, follow: bool) -> tuple[float, np.ndarray]:
    """An eigenpair near the shift: Rayleigh quotients if `follow`, else inverse iteration with the shift kept."""
    n = len(a)
    x = _apart(np.cos(np.arange(n) * (1.0 + len(found))) + 0.5, found)
    best, least = (x @ a @ x, x), np.inf
    for turn in range(40):
        at = best[0] if follow and turn > 2 else shift
        try:
            y = np.linalg.solve(a - at * np.eye(n), x)
        except np.linalg.LinAlgError:
            y = np.linalg.solve(a - (at + norm * np.finfo(float).eps) * np.eye(n), x)
        x = _apart(y / np.abs(y).max(), found)
        value = float(x @ a @ x)
        left = float(np.linalg.norm(a @ x - value * x))
        if left >= least and least <= TIE * norm:
            break
        if left < least or turn < 4:
            best, least = (value, x), left
    return best


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest k eigenvalues of a positive semidefinite matrix, falling, and their unit vectors as columns.

    Fewer where the rest are zero to rounding. Of equal eigenvalues, the vectors are any
    orthonormal ones. An ArithmeticError says that counts do not certify a number.
    """
    n = len(a)
    norm = float(np.abs(a).sum(1).max()) if n else 0.0
    if not norm:
        return np.zeros(0), np.zeros((n, 0))
    slack = TIE * norm
    counts: dict[float, int] = {-norm - slack: n, norm + slack: 0}

    def count(s: float) -> int:
        if s not in counts:
            counts[s] = above(a, s)
        return counts[s]

    values: list[float] = []
    vectors: list[np.ndarray] = []
    for number in range(1, min(k, n) + 1):
        while True:
            low = max(s for s, c in counts.items() if c >= number)
            high = min(s for s, c in counts.items() if c < number)
            alone = counts[low] == number and counts[high] == number - 1
            if high - low > 2 * slack and not alone:
                count((low + high) / 2)
                continue
            value, x = _nearest(a, (low + high) / 2, vectors, norm, follow=alone)
            if low - slack <= value <= high + slack:
                break
            if high - low <= 2 * slack:
                raise ArithmeticError(f"eigenvalue {number} was not found in its interval")
            count((low + high) / 2)
        if value <= NOTHING * norm:
            break
        if not count(value - 2 * slack) >= number > count(value + 2 * slack):
            raise ArithmeticError(f"counts do not certify eigenvalue {number}")
        values.append(value)
        vectors.append(x)
    return np.array(values), np.array(vectors).reshape(len(values), n).T
