"""Covariance and scatter estimators as batched kernels: samples (..., N, p) to matrices (..., p, p).

Data are taken as centred. Two conjugations occur: `row` sums conj(x) x^T, `col` sums x x^H; quadratic forms
are always x^H S^-1 x. The consistent choice for those is `col`; estimators whose published form mixes the
two take convention="mixed" for that form, and "consistent" (the default) for one that is self-consistent.
All loops freeze a matrix when it has converged, so that a result does not depend on its batch.
"""

from __future__ import annotations

import numpy as np

from covaria.functions.linalg import ct, herm, normalise, quadratic, trace
from covaria.functions.manifolds import KroneckerScaledGaussian, ScaledGaussianFIM, geodesic_mean


def scm(x: np.ndarray, centre: bool = False) -> np.ndarray:
    """Sample covariance conj(x) x^T / N."""
    if centre:
        x = x - x.mean(-2, keepdims=True)
    return np.swapaxes(np.conj(x), -1, -2) @ x / x.shape[-2]


def tyler_weight(q: np.ndarray, p: int) -> np.ndarray:
    return p / q


def student_weight(q: np.ndarray, p: int, df: float = 3) -> np.ndarray:
    return (p + df / 2) / (q + df / 2)


def huber_weight(q: np.ndarray, p: int, limit: float = np.inf, beta: float = 1.0) -> np.ndarray:
    if limit <= 0 or beta <= 0:
        raise AssertionError("limit and beta must be positive")
    with np.errstate(divide="ignore"):
        return np.minimum(1.0, limit / q) / beta


def m_step(x: np.ndarray, s: np.ndarray, weight) -> tuple[np.ndarray, np.ndarray]:
    """One reweighting of the samples, and how far the matrix moved (relative Frobenius norm)."""
    q = quadratic(x, np.linalg.inv(s))
    new = np.swapaxes(x * weight(q, x.shape[-1])[..., None], -1, -2) @ np.conj(x) / x.shape[-2]
    return new, np.linalg.norm(new - s, axis=(-2, -1)) / np.linalg.norm(s, axis=(-2, -1))


def fixed_point(x: np.ndarray, weight=tyler_weight, tol: float = 1e-4, iter_max: int = 10, normalization: str | None = None, init: np.ndarray | None = None, most: int | None = None) -> np.ndarray:
    """Iterates m_step on the matrices that still move by more than tol; `most` bounds how many at a time."""
    batch, (n, p) = x.shape[:-2], x.shape[-2:]
    flat = x.reshape(-1, n, p)
    start = np.eye(p, dtype=x.dtype) if init is None else init
    s = np.broadcast_to(start, (*batch, p, p)).reshape(-1, p, p).copy()
    live = np.arange(len(flat))
    for _ in range(iter_max):
        if not len(live):
            break
        moved = np.empty(len(live))
        for k in range(0, len(live), most or len(live)):
            rows = live[k : k + (most or len(live))]
            s[rows], moved[k : k + len(rows)] = m_step(flat[rows], s[rows], weight)
        s = normalise(s, normalization)
        live = live[moved > tol]  # a NaN counts as converged
    return s.reshape(*batch, p, p)


def tyler(x, normalization="trace", tol=1e-4, iter_max=50, **more):
    """Tyler's estimate. It weighs by 1 / q: a sample that is all zero has no weight and makes its group's result NaN; leave such samples out."""
    return fixed_point(x, tyler_weight, tol, iter_max, normalization, **more)


def student_t(x, df=3, normalization=None, tol=1e-4, iter_max=50, **more):
    return fixed_point(x, lambda q, p: student_weight(q, p, df), tol, iter_max, normalization, **more)


def huber(x, limit=np.inf, beta=1.0, normalization=None, tol=1e-4, iter_max=50, **more):
    return fixed_point(x, lambda q, p: huber_weight(q, p, limit, beta), tol, iter_max, normalization, **more)


def matrix_and_texture(x: np.ndarray, tol: float = 1e-4, iter_max: int = 50, convention: str = "consistent", weight=1) -> np.ndarray:
    """Tyler's estimate over dates (..., T, N, p) whose samples share a texture over time; trace p.

    weight: of each sample, the number of dates that have it where they differ (`padded`).
    """
    p, n = x.shape[-1], x.shape[-2]
    s = np.broadcast_to(np.eye(p, dtype=x.dtype), (*x.shape[:-3], p, p)).copy()
    live = np.ones(s.shape[:-2], bool)
    y = np.conj(x) if convention == "mixed" else x
    for _ in range(iter_max):
        texture = quadratic(x, np.linalg.inv(s)[..., None, :, :]).sum(-2)
        new = normalise(p / n * np.einsum("...tni,...n,...tnj->...ij", y, weight / texture, np.conj(y), optimize=True), "trace")
        moved = np.linalg.norm(new - s, axis=(-2, -1)) / np.linalg.norm(s, axis=(-2, -1))
        s = np.where(live[..., None, None], new, s)
        live = live & (moved > tol)
        if not live.any():
            break
    return s


def padded(dates: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Dates (..., N_t, p) as one array (..., T, N, p), zero where a date lacks a sample, and how many dates have each."""
    n = max(x.shape[-2] for x in dates)
    fill = [np.concatenate([x, np.zeros((*x.shape[:-2], n - x.shape[-2], x.shape[-1]), x.dtype)], -2) for x in dates]
    return np.stack(fill, -3), sum((np.arange(n) < x.shape[-2]).astype(int) for x in dates)


#: Fixed value: what is added to powers that are divided by.
FLOOR = 1e-30


def two_array_tyler(x: np.ndarray, m: int, tol: float = 1e-6, iter_max: int = 500, history: list | None = None) -> np.ndarray:
    """Tyler's estimate for two arrays of m sensors, each with a texture of its own; trace 2m."""
    k, batch = x.shape[-2], x.shape[:-2]
    x = x.reshape(-1, k, 2 * m)
    s = np.broadcast_to(np.eye(2 * m, dtype=x.dtype), (len(x), 2 * m, 2 * m)).copy()
    live, y = np.arange(len(x)), x  # what has converged is not computed again
    for _ in range(iter_max):
        t1, t2 = (t + FLOOR for t in textures(y, np.linalg.inv(s[live]), m))
        scaled = np.concatenate([y[..., :m] / np.sqrt(t1)[..., None], y[..., m:] / np.sqrt(t2)[..., None]], -1)
        new = normalise(np.swapaxes(np.conj(scaled), -1, -2) @ scaled / k, "trace")
        moved = np.linalg.norm(new - s[live], axis=(-2, -1)) / np.linalg.norm(s[live], axis=(-2, -1))
        s[live] = new
        if history is not None:
            step = np.zeros(len(x))
            step[live] = moved
            history.append(step.reshape(batch))
        on = moved > tol
        if not on.all():
            live, y = live[on], y[on]
        if not len(live):
            break
    if history is not None:  # a trial that has stopped moves no more
        history.extend(np.zeros(batch) for _ in range(iter_max - len(history)))
    return s.reshape(*batch, 2 * m, 2 * m)


def textures(x: np.ndarray, inverse: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The two arrays' powers of each sample under an inverse covariance (..., 2m, 2m); a silent array is floored, so that all stay finite."""
    a, b, by = x[..., :m], x[..., m:], np.swapaxes(inverse, -1, -2)
    form = lambda u, v, part: np.einsum("...i,...i->...", np.conj(u), v @ part).real / m
    t1, t2, t12 = form(a, a, by[..., :m, :m]), form(b, b, by[..., m:, m:]), form(a, b, by[..., m:, :m])
    return np.abs(t1 + np.sqrt(t1 / (t2 + FLOOR)) * t12), np.abs(t2 + np.sqrt(t2 / (t1 + FLOOR)) * t12)


# Natural gradient of the scaled Gaussian: a shape of determinant one and one texture a sample.


def scaled_gaussian_loss(x, s, tau):
    """(1/Np) sum_n [p log tau_n + q_n / tau_n]."""
    n, p = x.shape[-2:]
    return (p * np.log(tau) + quadratic(x, np.linalg.inv(s)) / tau).sum(-1) / (n * p)


def scaled_gaussian_gradient(x, s, tau):
    n, p = x.shape[-2:]
    moment = np.swapaxes(x / tau[..., None], -1, -2) @ np.conj(x) / n
    return -ScaledGaussianFIM(p, n).parts[0].proj(s, moment), tau - quadratic(x, np.linalg.inv(s)) / p


def _descend(loss, manifold, point, gradient, alpha, c, rho, backtracks):
    """An Armijo step along minus the gradient for each row; rows without an accepted step stay. Gives point, moved.

    The slope is the gradient's square in the weighted metric: losses are means over samples, and so are the
    weights, whatever the number of samples.
    """
    f, size = loss(*point), np.abs(manifold.inner(point, gradient, gradient))
    accepted = np.zeros(np.shape(f), bool)
    step, best = np.full(np.shape(f), float(alpha)), list(point)
    for _ in range(backtracks):
        scaled = [-(step.reshape(step.shape + (1,) * (g.ndim - step.ndim))) * g for g in gradient]
        with np.errstate(all="ignore"):
            new = manifold.retr(list(point), scaled)
            now = loss(*new)
            good = np.where(np.isfinite(size), now <= f - c * step * size, now < f) & np.isfinite(now) & ~accepted
        best = [np.where(good.reshape(good.shape + (1,) * (b.ndim - good.ndim)), v, b) for v, b in zip(new, best, strict=True)]
        accepted |= good
        if accepted.all():
            break
        step = np.where(accepted, step, step * rho)
    return best, accepted


def natural_gradient(x, tol=1e-8, iter_max=200, alpha_0=1.0, armijo_c=1e-4, armijo_rho=0.5, armijo_max_backtracks=30, init=None):
    """Shape (..., p, p) and textures (..., N) by Riemannian gradient descent; rows stop for themselves."""
    n, p = x.shape[-2:]
    batch = x.shape[:-2]
    manifold = ScaledGaussianFIM(p, n)
    s, tau = (np.broadcast_to(np.eye(p, dtype=x.dtype), (*batch, p, p)).copy(), np.ones((*batch, n))) if init is None else init
    live = np.ones(batch, bool)
    loss = lambda a, b: scaled_gaussian_loss(x, a, b)
    for _ in range(iter_max):
        gradient = scaled_gaussian_gradient(x, s, tau)
        (new_s, new_tau), moved = _descend(loss, manifold, [s, tau], list(gradient), alpha_0, armijo_c, armijo_rho, armijo_max_backtracks)
        gap = np.linalg.norm(new_s - s, axis=(-2, -1)) / np.linalg.norm(s, axis=(-2, -1)) + np.linalg.norm(new_tau - tau, axis=-1) / np.linalg.norm(tau, axis=-1)
        s, tau = np.where(live[..., None, None], new_s, s), np.where(live[..., None], new_tau, tau)
        live = live & moved & (gap > tol)
        if not live.any():
            break
    return s, tau


def natural_gradient_step(x, state, alpha_0=0.1, armijo_c=1e-4, armijo_rho=0.5, armijo_max_backtracks=5):
    """One online update from a new date: a single Armijo step from the running estimate.

    Textures of samples beyond the date's own stay as they are.
    """
    n, p = x.shape[-2:]
    s, tau, absent = state[0], state[1][..., :n], state[1][..., n:]
    gradient = scaled_gaussian_gradient(x, s, tau)
    best, _ = _descend(lambda a, b: scaled_gaussian_loss(x, a, b), ScaledGaussianFIM(p, n), [s, tau], list(gradient), alpha_0, armijo_c, armijo_rho, armijo_max_backtracks)
    return best[0], np.concatenate([best[1], absent], -1)


# Kronecker-structured scatter: x = vec(M) by columns, M of b rows and a columns.


def as_matrices(x: np.ndarray, a: int, b: int) -> np.ndarray:
    if a * b != x.shape[-1]:
        raise ValueError("a * b must be the number of features")
    return np.swapaxes(x.reshape(*x.shape[:-1], a, b), -1, -2)


def kronecker_forms(m: np.ndarray, inv_a: np.ndarray, inv_b: np.ndarray) -> np.ndarray:
    """Re tr(A^-1 M^H B^-1 M), without the large product."""
    return np.einsum("...ij,...nkj,...kl,...nli->...n", inv_a, np.conj(m), inv_b, m, optimize=True).real


def kronecker_mm_step(m, a_mat, b_mat, samples=None):
    """One majorisation-minimisation step of both factors: geodesic midpoints with the weighted moments."""
    a, b = a_mat.shape[-1], b_mat.shape[-1]
    n = samples or m.shape[-3]
    inv_a, inv_b = np.linalg.inv(a_mat), np.linalg.inv(b_mat)
    w = 1 / kronecker_forms(m, inv_a, inv_b)
    moment_a = a / n * np.einsum("...n,...nki,...kl,...nlj->...ij", w, np.conj(m), inv_b, m, optimize=True)
    moment_b = b / n * np.einsum("...n,...nik,...kl,...njl->...ij", w, m, inv_a, np.conj(m), optimize=True)
    return geodesic_mean(a_mat, moment_a), geodesic_mean(b_mat, moment_b)


def kronecker_mm(x: np.ndarray, a: int, b: int, tol: float = 1e-4, iter_max: int = 30, shared: bool = False):
    """A, B and textures of (..., N, p); shared: of (..., T, N, p) with one texture a sample over all dates."""
    m = as_matrices(x, a, b)
    if shared:
        dates, n = m.shape[-4], m.shape[-3]
        pooled = m.reshape(*m.shape[:-4], dates * n, b, a)
    else:
        pooled = m
    batch = pooled.shape[:-3]
    a_mat = np.broadcast_to(np.eye(a, dtype=x.dtype), (*batch, a, a)).copy()
    b_mat = np.broadcast_to(np.eye(b, dtype=x.dtype), (*batch, b, b)).copy()
    live = np.ones(batch, bool)
    gap = lambda u, v: np.linalg.norm(u - v, axis=(-2, -1)) / np.linalg.norm(v, axis=(-2, -1))
    for _ in range(iter_max):
        new_a, new_b = kronecker_mm_step(pooled, a_mat, b_mat)
        live = live & (gap(new_a, a_mat) + gap(new_b, b_mat) > tol)  # the step that meets tol is not taken
        a_mat, b_mat = np.where(live[..., None, None], new_a, a_mat), np.where(live[..., None, None], new_b, b_mat)
        if not live.any():
            break
    q = kronecker_forms(pooled, np.linalg.inv(a_mat), np.linalg.inv(b_mat)) / (a * b)
    return a_mat, b_mat, q.reshape(*batch, dates, n).mean(-2) if shared else q


def kronecker_mm_shared(dates: list[np.ndarray], a: int, b: int, tol: float = 1e-4, iter_max: int = 30):
    """A, B, textures shared over dates (..., N_t, p) of any sizes, and how many dates have each sample."""
    a_mat, b_mat, q = kronecker_mm(np.concatenate(dates, -2), a, b, tol, iter_max)
    whole, count = padded([v[..., None] for v in np.split(q, np.cumsum([x.shape[-2] for x in dates])[:-1], -1)])
    return a_mat, b_mat, whole[..., 0].sum(-2) / count, count


def kronecker_loss(x, a_mat, b_mat, tau):
    a, b = a_mat.shape[-1], b_mat.shape[-1]
    q = kronecker_forms(as_matrices(x, a, b), np.linalg.inv(a_mat), np.linalg.inv(b_mat))
    return (a * b * np.log(tau) + q / tau).sum(-1) / (x.shape[-2] * a * b)


def kronecker_gradient(x, a_mat, b_mat, tau, convention: str = "consistent"):
    a, b, n = a_mat.shape[-1], b_mat.shape[-1], x.shape[-2]
    m = as_matrices(x, a, b)
    inv_a, inv_b = np.linalg.inv(a_mat), np.linalg.inv(b_mat)
    left = np.einsum("...n,...nki,...kl,...nlj->...ij", 1 / tau, np.conj(m), inv_b, m, optimize=True) / (n * b)
    mid = np.conj(inv_a) if convention == "mixed" else inv_a
    right = np.einsum("...n,...nik,...kl,...njl->...ij", 1 / tau, m, mid, np.conj(m), optimize=True) / (n * a)
    manifold = KroneckerScaledGaussian(a, b, n)
    left = np.conj(left) if convention == "mixed" else left
    return -manifold.parts[0].proj(a_mat, left), -manifold.parts[1].proj(b_mat, right), tau - kronecker_forms(m, inv_a, inv_b) / (a * b)


def kronecker_online_step(x, state, t, alpha_0=0.1, armijo_c=1e-4, armijo_rho=0.5, armijo_max_backtracks=5, max_exp_tau=3.0):
    """One online update: an Armijo step of alpha_0 / t; a row's texture step is bounded by its own exponent.

    Textures of samples beyond the date's own stay as they are.
    """
    a, b, n = state[0].shape[-1], state[1].shape[-1], x.shape[-2]
    a_mat, b_mat, tau, absent = state[0], state[1], state[2][..., :n], state[2][..., n:]
    r_a, r_b, r_tau = kronecker_gradient(x, a_mat, b_mat, tau)
    alpha = alpha_0 / t
    most = np.abs(r_tau / tau).max(-1, keepdims=True) * alpha
    r_tau = np.where(most > max_exp_tau, r_tau * max_exp_tau / np.maximum(most, 1e-300), r_tau)
    best, _ = _descend(lambda u, v, w: kronecker_loss(x, u, v, w), KroneckerScaledGaussian(a, b, n), [a_mat, b_mat, tau], [r_a, r_b, r_tau], alpha, armijo_c, armijo_rho, armijo_max_backtracks)
    return best[0], best[1], np.concatenate([best[2], absent], -1)


def shrink(s: np.ndarray, alpha: float = 0.1) -> np.ndarray:
    """(1 - alpha) S + alpha I."""
    return (1 - alpha) * s + alpha * np.eye(s.shape[-1])


def condition(s: np.ndarray) -> np.ndarray:
    d = np.abs(np.linalg.eigvalsh(herm(s)))
    return d[..., -1:].max(-1) / np.maximum(d.min(-1), 1e-300)

