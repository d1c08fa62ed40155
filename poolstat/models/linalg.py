"""Small dense algebra for fits on the driver; matrices have as many rows as a model has coefficients."""

from __future__ import annotations

import numpy as np

from poolstat.errors import check

SINGULAR, CLAMP = 1e-12, 1e-8


def inverse(m: np.ndarray) -> np.ndarray:
    """Inverse that refuses what partial pivoting would call singular."""
    m = np.asarray(m, dtype=float)
    check(m.ndim == 2 and m.shape[0] == m.shape[1] and m.size > 0, "a square, non-empty matrix is needed")
    work, n = m.copy(), len(m)
    for c in range(n):
        top = c + int(np.abs(work[c:, c]).argmax())
        check(abs(work[top, c]) >= SINGULAR, "matrix is singular")
        work[[c, top]] = work[[top, c]]
        work[c + 1 :] -= np.outer(work[c + 1 :, c] / work[c, c], work[c])
    return np.linalg.inv(m)


def eigen(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors (columns) of a symmetric matrix."""
    return np.linalg.eigh((np.asarray(m, dtype=float) + np.asarray(m, dtype=float).T) / 2)


def inverse_root(m: np.ndarray) -> np.ndarray:
    """m ** -1/2 of a symmetric matrix, eigenvalues raised to CLAMP."""
    value, vector = eigen(m)
    return (vector / np.sqrt(np.maximum(value, CLAMP))) @ vector.T
