"""Batched Hermitian linear algebra on NumPy arrays: the kernels that Arrow functions call.

Matrices stand on the last two axes; every leading axis is a batch.
"""

from __future__ import annotations

import numpy as np


def ct(a: np.ndarray) -> np.ndarray:
    """Conjugate transpose."""
    return np.conj(np.swapaxes(a, -1, -2))


def herm(a: np.ndarray) -> np.ndarray:
    """Hermitian part."""
    return (a + ct(a)) / 2


def trace(a: np.ndarray) -> np.ndarray:
    return np.trace(a, axis1=-2, axis2=-1)


def diag_embed(x: np.ndarray) -> np.ndarray:
    return x[..., None] * np.eye(x.shape[-1], dtype=x.dtype)


def spectral(a: np.ndarray, *functions, symmetrise: bool = True) -> tuple[np.ndarray, ...]:
    """f(a) for each function of the eigenvalues, from one decomposition."""
    d, q = np.linalg.eigh(herm(a) if symmetrise else a)
    return tuple((q * f(d)[..., None, :]) @ ct(q) for f in functions)


def _root(d):
    return np.sqrt(np.abs(d))


def _invroot(d):
    return 1 / np.sqrt(np.abs(d))


def sqrtm(a: np.ndarray) -> np.ndarray:
    """Root of |eigenvalues|: a negative eigenvalue is not rejected."""
    return spectral(a, _root)[0]


def invsqrtm(a: np.ndarray) -> np.ndarray:
    return spectral(a, _invroot, symmetrise=False)[0]


def logm(a: np.ndarray) -> np.ndarray:
    return spectral(a, lambda d: np.log(np.abs(d)))[0]


def expm(a: np.ndarray) -> np.ndarray:
    return spectral(a, np.exp)[0]


def sqrtm_invsqrtm(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return spectral(a, _root, _invroot)


def inv_sqrtm_invsqrtm(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return spectral(a, lambda d: 1 / d, _root, _invroot)


def logdet(a: np.ndarray) -> np.ndarray:
    return np.linalg.slogdet(a)[1]


def quadratic(x: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Re x^H inverse x for samples on the axis before last: (..., N, p), (..., p, p) -> (..., N)."""
    return np.einsum("...i,...i->...", np.conj(x), x @ np.swapaxes(inverse, -1, -2)).real


def normalise(s: np.ndarray, mode: str | None) -> np.ndarray:
    """A matrix scaled so that its first entry (diag), mean eigenvalue (trace) or determinant (det) is 1."""
    p = s.shape[-1]
    if mode in (None, "none"):
        return s
    if mode == "diag":
        scale = s[..., 0, 0]
    elif mode == "trace":
        scale = trace(s) / p
    elif mode == "det":
        scale = np.exp(logdet(s) / p)
    else:
        raise ValueError(f"unknown normalisation: {mode}")
    return s / scale[..., None, None]
