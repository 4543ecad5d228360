"""Riemannian geometry of Hermitian positive definite matrices, positive vectors and their products.

Points and tangent vectors are arrays with batch axes in front; on a product they are lists of arrays.
Every method works row by row, so that an Arrow batch is one call.
"""

from __future__ import annotations

import numpy as np

from covaria.functions.linalg import ct, expm, herm, logdet, logm, spectral, sqrtm_invsqrtm, trace


class Manifold:
    def norm(self, x, u):
        return np.sqrt(self.inner(x, u, u))

    def retr(self, x, u):
        return self.exp(x, u)

    def zerovec(self, x):
        return np.zeros_like(x)


class HermitianPositiveDefinite(Manifold):
    """The cone of p x p matrices with the affine-invariant metric."""

    def __init__(self, p: int, seed: int | None = None):
        self.p, self.rng = p, np.random.default_rng(seed)

    def inner(self, x, u, v):
        a, b = np.linalg.solve(x, u), np.linalg.solve(x, v)
        return np.einsum("...ij,...ji->...", a, b).real

    def norm(self, x, u):
        low = np.linalg.inv(np.linalg.cholesky(x))
        return np.linalg.norm(low @ u @ ct(low), axis=(-2, -1))

    def proj(self, x, u):
        return herm(u)

    def egrad2rgrad(self, x, g):
        return x @ herm(g) @ x

    def exp(self, x, u):
        root, inverse = sqrtm_invsqrtm(x)
        return herm(root @ expm(inverse @ u @ inverse) @ root)

    def log(self, x, y):
        root, inverse = sqrtm_invsqrtm(x)
        return root @ logm(inverse @ y @ inverse) @ root

    def dist(self, x, y):
        low = np.linalg.inv(np.linalg.cholesky(x))
        return np.linalg.norm(logm(low @ y @ ct(low)), axis=(-2, -1))

    def rand(self, batch: tuple = ()):
        q = np.linalg.qr(self.rng.standard_normal((*batch, self.p, self.p)))[0]
        return (q * self.rng.uniform(1, 2, (*batch, 1, self.p))) @ ct(q)

    def randvec(self, x):
        u = herm(self.rng.standard_normal(x.shape) + 1j * self.rng.standard_normal(x.shape) if np.iscomplexobj(x) else self.rng.standard_normal(x.shape))
        u = self.proj(x, u)
        return u / self.norm(x, u)[..., None, None]

    def retr(self, x, u):
        return herm(x + u + u @ np.linalg.solve(x, u) / 2)

    def transp(self, x, y, d):
        return self.proj(y, d)


class SpecialHermitianPositiveDefinite(HermitianPositiveDefinite):
    """Matrices of determinant one."""

    def proj(self, x, u):
        h = herm(u)
        return h - (trace(np.linalg.solve(x, h)).real / self.p)[..., None, None] * x

    def _unit(self, x):
        return x / np.exp(logdet(x) / self.p)[..., None, None]

    def egrad2rgrad(self, x, g):
        return self.proj(x, super().egrad2rgrad(x, g))

    def exp(self, x, u):
        return self._unit(super().exp(x, u))

    def rand(self, batch: tuple = ()):
        return self._unit(super().rand(batch))

    def retr(self, x, u):
        return self._unit(super().retr(x, u))


class StrictlyPositiveVectors(Manifold):
    """Vectors with positive entries; the metric of logarithms."""

    def __init__(self, n: int, seed: int | None = None):
        self.n, self.rng = n, np.random.default_rng(seed)

    def inner(self, x, u, v):
        return (u * v / x**2).sum(-1)

    def proj(self, x, u):
        return u

    def egrad2rgrad(self, x, g):
        return g * x**2

    def exp(self, x, u):
        return x * np.exp(u / x)

    def log(self, x, y):
        return x * np.log(y / x)

    def dist(self, x, y):
        return np.linalg.norm(np.log(y / x), axis=-1)

    def rand(self, batch: tuple = ()):
        return np.exp(self.rng.standard_normal((*batch, self.n)))

    def randvec(self, x):
        u = self.rng.standard_normal(x.shape)
        return u / self.norm(x, u)[..., None]

    def transp(self, x, y, d):
        return d


class WeightedProduct(Manifold):
    """A product with inner product sum_k w_k <.,.>_k; with weights None a plain product.

    The norm stays the unweighted root of squares, as users of the product rely on it.
    """

    def __init__(self, parts: list[Manifold], weights: list[float] | None = None):
        self.parts, self.weights = parts, [1.0] * len(parts) if weights is None else list(weights)

    def _each(self, name, *points):
        return [getattr(m, name)(*p) for m, *p in zip(self.parts, *points, strict=True)]

    def inner(self, x, u, v):
        return sum(w * a for w, a in zip(self.weights, self._each("inner", x, u, v), strict=True))

    def norm(self, x, u):
        return np.sqrt(sum(a**2 for a in self._each("norm", x, u)))

    def dist(self, x, y):
        return np.sqrt(sum(w * a**2 for w, a in zip(self.weights, self._each("dist", x, y), strict=True)))

    def egrad2rgrad(self, x, g):
        return [a / w for w, a in zip(self.weights, self._each("egrad2rgrad", x, g), strict=True)]

    def proj(self, x, u):
        return self._each("proj", x, u)

    def exp(self, x, u):
        return self._each("exp", x, u)

    def retr(self, x, u):
        return self._each("retr", x, u)

    def log(self, x, y):
        return self._each("log", x, y)

    def transp(self, x, y, d):
        return self._each("transp", x, y, d)

    def rand(self, batch: tuple = ()):
        return [m.rand(batch) for m in self.parts]

    def randvec(self, x):
        return self._each("randvec", x)

    def zerovec(self, x):
        return self._each("zerovec", x)


class Product(WeightedProduct):
    def __init__(self, parts: list[Manifold]):
        super().__init__(parts)


class ScaledGaussianFIM(WeightedProduct):
    """Shape of determinant one and n textures, with the Fisher metric's weights."""

    def __init__(self, p: int, n: int, seed: int | None = None):
        super().__init__([SpecialHermitianPositiveDefinite(p, seed), StrictlyPositiveVectors(n, seed)], [1 / p, 1 / n])


class KroneckerElliptical(WeightedProduct):
    def __init__(self, a: int, b: int, alpha: float = 1.0, seed: int | None = None):
        super().__init__([SpecialHermitianPositiveDefinite(a, seed), HermitianPositiveDefinite(b, seed)], [alpha * b, alpha * a])


class KroneckerScaledGaussian(WeightedProduct):
    def __init__(self, a: int, b: int, n: int, seed: int | None = None):
        parts = [SpecialHermitianPositiveDefinite(a, seed), SpecialHermitianPositiveDefinite(b, seed), StrictlyPositiveVectors(n, seed)]
        super().__init__(parts, [b / (a * b), a / (a * b), 1 / n])


def geodesic_mean(a: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The midpoint of a and m: a^1/2 (a^-1/2 m a^-1/2)^1/2 a^1/2."""
    root, inverse = sqrtm_invsqrtm(a)
    return herm(root @ spectral(inverse @ m @ inverse, lambda d: np.sqrt(np.abs(d)))[0] @ root)
