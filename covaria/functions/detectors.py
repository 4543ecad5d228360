"""Change and target detection statistics as batched kernels: samples to one number a group."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from covaria.functions import estimators as est
from covaria.functions.linalg import ct, logdet, quadratic, trace


def gaussian_glrt(x: np.ndarray) -> np.ndarray:
    """T log det mean_t S_t - sum_t log det S_t of (..., T, N, p), or of a list of dates (..., N_t, p) of unequal sizes."""
    s = np.stack([est.scm(y) for y in x], -3) if isinstance(x, list) else est.scm(x)
    return s.shape[-3] * logdet(s.mean(-3)) - logdet(s).sum(-1)


def two_step_glrt(x: np.ndarray, estimate) -> np.ndarray:
    """The same with another estimator, once for all dates' samples and once a date."""
    if isinstance(x, list):  # dates of unequal sizes
        return len(x) * logdet(estimate(np.concatenate(x, -2))) - sum(logdet(estimate(y)) for y in x)
    t, n, p = x.shape[-3:]
    return t * logdet(estimate(x.reshape(*x.shape[:-3], t * n, p))) - logdet(estimate(x)).sum(-1)


def student_glrt(x, df=3, tol=1e-4, iter_max=5):
    return two_step_glrt(x, lambda y: est.student_t(y, df, None, tol, iter_max))


def tyler_glrt(x, tol=1e-4, iter_max=50):
    return two_step_glrt(x, lambda y: est.tyler(y, "trace", tol, iter_max))


def compound_glrt(x: np.ndarray, tol: float = 1e-4, iter_max: int = 50, convention: str = "consistent") -> np.ndarray:
    """Deterministic compound Gaussian: shape and one texture a sample, equal over dates or not.

    x may be a list of dates (..., N_t, p) of unequal sizes.
    """
    if isinstance(x, list):
        whole, dates = est.padded(x)
        p = whole.shape[-1]
        s0, s1 = est.matrix_and_texture(whole, tol, iter_max, convention, dates), [est.tyler(y, "trace", tol, iter_max) for y in x]
        q0 = quadratic(whole, np.linalg.inv(s0)[..., None, :, :]).sum(-2) / dates
        own = sum(y.shape[-2] * logdet(s) + p * np.log(quadratic(y, np.linalg.inv(s))).sum(-1) for y, s in zip(x, s1, strict=True))
        return dates.sum() * logdet(s0) + p * (dates * np.log(q0)).sum(-1) - own
    t, n, p = x.shape[-3:]
    s0, s1 = est.matrix_and_texture(x, tol, iter_max, convention), est.tyler(x, "trace", tol, iter_max)
    q0 = quadratic(x, np.linalg.inv(s0)[..., None, :, :]).mean(-2)
    q1 = quadratic(x, np.linalg.inv(s1))
    return t * n * logdet(s0) - n * logdet(s1).sum(-1) + t * p * np.log(q0).sum(-1) - p * np.log(q1).sum((-2, -1))


def kronecker_glrt(x: np.ndarray, a: int, b: int, tol: float = 1e-4, iter_max: int = 30) -> np.ndarray:
    """Compound Gaussian with a Kronecker-structured shape; log det (A x B) = b log det A + a log det B.

    x may be a list of dates (..., N_t, p) of unequal sizes.
    """
    if isinstance(x, list):
        p = a * b
        a0, b0, t0, dates = est.kronecker_mm_shared(x, a, b, tol, iter_max)
        own = 0
        for y in x:
            a1, b1, t1 = est.kronecker_mm(y, a, b, tol, iter_max)
            own = own + y.shape[-2] * (b * logdet(a1) + a * logdet(b1)) + p * np.log(t1).sum(-1)
        return dates.sum() * (b * logdet(a0) + a * logdet(b0)) + p * (dates * np.log(t0)).sum(-1) - own
    t, n, p = x.shape[-3:]
    a0, b0, t0 = est.kronecker_mm(x, a, b, tol, iter_max, shared=True)
    a1, b1, t1 = est.kronecker_mm(x, a, b, tol, iter_max)
    return t * n * (b * logdet(a0) + a * logdet(b0)) - n * (b * logdet(a1) + a * logdet(b1)).sum(-1) + t * p * np.log(t0).sum(-1) - p * np.log(t1).sum((-2, -1))


# Online detectors: state is a plain tuple of arrays, a step a pure function of (state, date), so that a
# replayed micro-batch gives the same state.


def gaussian_step(state: tuple | None, x: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Running Gaussian statistic, equal to gaussian_glrt of all dates so far; state: (sum of S_t, statistic, dates)."""
    s = est.scm(x)
    if state is None:
        return np.zeros(x.shape[:-2]), (s, np.zeros(x.shape[:-2]), 1)
    total, stat, t = state
    new = total + s
    stat = stat + (t + 1) * logdet(new / (t + 1)) - t * logdet(total / t) - logdet(s)
    return stat, (new, stat, t + 1)


def compound_cost(x, s, tau):
    """Half the negative log likelihood of a scaled Gaussian, with the shape's trace set to p."""
    p = x.shape[-1]
    scale = p * np.log(p) - p * np.log(trace(s).real)
    return 0.5 * (p * np.log(tau) + scale[..., None] + quadratic(x, np.linalg.inv(s)) / tau).sum(-1)


def compound_step(state, x, alpha_0=0.1, backtracks=5, iter_max=200, tol=1e-8):
    """Running compound Gaussian statistic; state: (shape, textures, cost under H0, cost under H1, dates).

    Dates may differ in their numbers of samples: a sample that no date had before begins with its own
    texture; the texture of one that a date lacks stays as it is.
    """
    own = est.natural_gradient(x, tol, iter_max)
    n = x.shape[-2]
    if state is None:
        running, absent = own, own[1][..., n:]
    else:
        known = np.concatenate([state[1][..., :n], own[1][..., state[1].shape[-1] :]], -1)
        running, absent = est.natural_gradient_step(x, (state[0], known), alpha_0, armijo_max_backtracks=backtracks), state[1][..., n:]
    h0, h1, t = (0.0, 0.0, 0) if state is None else state[2:]
    h0, h1 = h0 + compound_cost(x, *running), h1 + compound_cost(x, *own)
    return 2 * (h0 - h1), (running[0], np.concatenate([running[1], absent], -1), h0, h1, t + 1)


def kronecker_cost(x, a_mat, b_mat, tau):
    a, b = a_mat.shape[-1], b_mat.shape[-1]
    q = est.kronecker_forms(est.as_matrices(x, a, b), np.linalg.inv(a_mat), np.linalg.inv(b_mat))
    return 0.5 * (a * b * np.log(tau) + (b * logdet(a_mat) + a * logdet(b_mat))[..., None] + q / tau).sum(-1)


def kronecker_step(state, x, a, b, alpha_0=0.1, backtracks=5, iter_max=30, tol=1e-4):
    """Running Kronecker statistic; state: (A, B, textures, cost under H0, cost under H1, dates).

    Dates may differ in their numbers of samples, as in `compound_step`.
    """
    own = est.kronecker_mm(x, a, b, tol, iter_max)
    t, n = 0 if state is None else state[5], x.shape[-2]
    if state is None:
        running = own
    else:
        known = np.concatenate([state[2], own[2][..., state[2].shape[-1] :]], -1)
        running = est.kronecker_online_step(x, (*state[:2], known), t + 1, alpha_0, armijo_max_backtracks=backtracks)
    h0, h1 = (0.0, 0.0) if state is None else state[3:5]
    h0, h1 = h0 + kronecker_cost(x, *running[:2], running[2][..., :n]), h1 + kronecker_cost(x, *own)
    return 2 * (h0 - h1), (*running, h0, h1, t + 1)


def fold(x: np.ndarray, step) -> np.ndarray:
    """The running statistic of (..., T, N, p), or of a list of dates (..., N_t, p), after every date: (..., T)."""
    state, out = None, []
    for y in x if isinstance(x, list) else np.moveaxis(x, -3, 0):
        stat, state = step(state, y)
        out.append(stat)
    return np.stack(out, -1)


# Sonar: two arrays of m sensors, x of 2m, steering P = blkdiag(p1, p2).


def _dot(u, a, v):
    return np.einsum("...i,...ij,...j->...", np.conj(u), a, v, optimize=True)


@dataclass(frozen=True)
class Sonar:
    """Statistics of x (..., 2m) under a covariance M (2m, 2m) or (..., 2m, 2m)."""

    m: int
    steering: np.ndarray

    def _powers(self, x, inverse):
        m = self.m
        a, b = x[..., :m], x[..., m:]
        return tuple(_dot(u, inverse[..., i, j], v).real / m for u, i, j, v in ((a, slice(0, m), slice(0, m), a), (b, slice(m, None), slice(m, None), b), (a, slice(0, m), slice(m, None), b)))

    def _scale_product(self, x, inverse):
        a1, a2, a12 = self._powers(x, inverse)
        return np.sqrt(np.abs(a1) * np.abs(a2)) + a12

    def residual_inverse(self, inverse):
        """M^-1 less its projection on the steering vectors."""
        left = inverse @ self.steering
        return inverse - left @ np.linalg.inv(ct(self.steering) @ left) @ ct(left)

    def glrt(self, x, cov):
        inverse = np.linalg.inv(cov)
        return self._scale_product(x, inverse) / (self._scale_product(x, self.residual_inverse(inverse)) + 1e-60)

    def matched(self, x, cov):
        inverse = np.linalg.inv(cov)
        left = inverse @ self.steering
        return _dot(x, left @ np.linalg.inv(ct(self.steering) @ left) @ ct(left), x).real

    def rao(self, x, cov):
        inverse = np.linalg.inv(cov)
        a1, a2, a12 = self._powers(x, inverse)
        s1 = np.sqrt(np.abs(a1 + np.sqrt(a1 / (a2 + est.FLOOR)) * a12)) + 1e-60
        s2 = np.sqrt(np.abs(a2 + np.sqrt(a2 / (a1 + est.FLOOR)) * a12)) + 1e-60
        scaled = np.concatenate([x[..., : self.m] / s1[..., None], x[..., self.m :] / s2[..., None]], -1)
        return 2 * self.matched(scaled, cov)

    def _single(self, x, inverse, k):
        m = self.m
        part = slice(0, m) if k == 0 else slice(m, 2 * m)
        y, p = x[..., part], self.steering[part, k]
        return np.abs(_dot(p, inverse, y)) ** 2 / (_dot(p, inverse, p).real * _dot(y, inverse, y).real + 1e-60)

    def _block_inverses(self, cov, adaptive):
        m = self.m
        if adaptive:  # blocks of the inverse, as the adaptive form has them
            inverse = np.linalg.inv(cov)
            return inverse[..., :m, :m], inverse[..., m:, m:]
        return np.linalg.inv(cov[..., :m, :m]), np.linalg.inv(cov[..., m:, m:])

    def independent(self, x, cov, adaptive: bool = False):
        return -self.m * sum(np.log(1 - np.abs(self._single(x, b, k)) + 1e-15) for k, b in enumerate(self._block_inverses(cov, adaptive)))

    def single(self, x, cov, array: int = 0, adaptive: bool = False):
        if array not in (0, 1):
            raise ValueError("array must be 0 or 1")
        return self._single(x, self._block_inverses(cov, adaptive)[array], array)

    def array1(self, x, cov):
        return self.single(x, cov, 0)

    def array2(self, x, cov):
        return self.single(x, cov, 1)

    def all(self, x, cov, adaptive: bool = False) -> dict[str, np.ndarray]:
        return {
            "glrt": self.glrt(x, cov), "rao": self.rao(x, cov), "independent": self.independent(x, cov, adaptive),
            "array1": self.single(x, cov, 0, adaptive), "array2": self.single(x, cov, 1, adaptive), "matched": self.matched(x, cov),
        }
