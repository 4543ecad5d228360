"""Kernels against independent formulas and invariants."""

import numpy as np
import pytest

from covaria.functions import detectors as det
from covaria.functions import estimators as est
from covaria.functions import linalg, signal
from covaria.functions import manifolds as man
from covaria.sources import generate as gen


@pytest.fixture
def x():
    r = np.random.default_rng(42)
    return (r.standard_normal((3, 4, 20, 4)) + 1j * r.standard_normal((3, 4, 20, 4))) / np.sqrt(2)


def test_scm_and_normalisation(x):
    y = x[0, 0]
    assert np.allclose(est.scm(y), sum(np.outer(np.conj(v), v) for v in y) / len(y))
    s = est.scm(x)
    assert np.allclose(linalg.trace(linalg.normalise(s, "trace")).real, 4)
    assert np.allclose(linalg.logdet(linalg.normalise(s, "det")), 0)
    assert np.allclose(linalg.normalise(s, "diag")[..., 0, 0], 1)
    with pytest.raises(ValueError):
        linalg.normalise(s, "other")


def test_matrix_functions(x):
    s = est.scm(x)
    r, i = linalg.sqrtm_invsqrtm(s)
    inv, r2, i2 = linalg.inv_sqrtm_invsqrtm(s)
    assert np.allclose(r @ r, s) and np.allclose(r @ i, np.eye(4)) and np.allclose(inv @ s, np.eye(4)) and np.allclose(r, r2) and np.allclose(i, i2)
    assert np.allclose(linalg.expm(linalg.logm(s)), s) and np.allclose(linalg.invsqrtm(s), i)


@pytest.mark.parametrize("cls", [man.HermitianPositiveDefinite, man.SpecialHermitianPositiveDefinite])
def test_matrix_manifolds(x, cls):
    m = cls(4, 0)
    a, b = linalg.normalise(est.scm(x[:, 0]), "det"), linalg.normalise(est.scm(x[:, 1]), "det")
    assert np.allclose(m.exp(a, m.log(a, b)), b)
    assert np.allclose(m.dist(a, b), m.norm(a, m.log(a, b)))
    assert np.allclose(m.dist(a, b), m.dist(b, a))
    c = np.random.default_rng(0).standard_normal((4, 4))
    assert np.allclose(m.dist(c @ a @ c.T, c @ b @ c.T), m.dist(a, b))
    u = m.randvec(a)
    assert np.allclose(m.norm(a, u), 1) and np.allclose(m.inner(a, u, u), 1)
    if cls is man.SpecialHermitianPositiveDefinite:
        assert np.allclose(linalg.logdet(m.retr(a, u)), 0) and np.allclose(linalg.trace(np.linalg.solve(a, u)), 0)


def test_vectors_and_products():
    m = man.StrictlyPositiveVectors(5, 1)
    a, b = m.rand((3,)), m.rand((3,))
    assert np.allclose(m.exp(a, m.log(a, b)), b) and np.allclose(m.dist(a, b), m.norm(a, m.log(a, b)))
    p = man.KroneckerScaledGaussian(2, 3, 5, 0)
    x, y = p.rand((4,)), p.rand((4,))
    assert np.allclose(p.dist(x, y) ** 2, sum(w * q.dist(u, v) ** 2 for w, q, u, v in zip(p.weights, p.parts, x, y, strict=True)))
    assert all(np.allclose(u, v) for u, v in zip(p.exp(x, p.log(x, y)), y, strict=True))


def test_m_estimators(x):
    y = x.reshape(3, 80, 4)
    s = est.tyler(y, tol=1e-12, iter_max=500)
    assert np.allclose(est.m_step(y, s, est.tyler_weight)[0], s, atol=1e-8)
    scale = np.random.default_rng(1).uniform(0.1, 9, (3, 80, 1))
    assert np.allclose(est.tyler(y * scale, tol=1e-12, iter_max=500), s, atol=1e-6)
    assert np.allclose(est.huber(y), np.conj(est.scm(y)))
    assert np.allclose(est.student_t(y, 1e9), np.conj(est.scm(y)), atol=1e-6)
    assert np.allclose(est.tyler(y, most=1), est.tyler(y))
    assert all(np.allclose(est.tyler(y)[k], est.tyler(y[k])) for k in range(3))
    with pytest.raises(AssertionError):
        est.huber(y, -1)


def test_natural_gradient_is_tyler(x):
    y = x.reshape(3, 80, 4)
    s, tau = est.natural_gradient(y)
    assert np.allclose(s, linalg.normalise(est.tyler(y, "det", 1e-12, 500), "det"), atol=1e-5)
    assert np.allclose(tau, linalg.quadratic(y, np.linalg.inv(s)) / 4, rtol=1e-4)


def test_natural_gradient_of_many_samples(x):
    """Copies of a group's samples change neither its shape nor a step of it, however many there are."""
    y = x.reshape(3, 80, 4)
    many, n = np.tile(y, (1, 200, 1)), 200 * 80
    assert np.allclose(est.natural_gradient(many)[0], est.natural_gradient(y)[0], atol=1e-5)
    start = np.broadcast_to(np.eye(4, dtype=complex), (3, 4, 4))
    few, much = est.natural_gradient_step(y, (start, np.ones((3, 80)))), est.natural_gradient_step(many, (start, np.ones((3, n))))
    assert np.allclose(few[0], much[0]) and not np.allclose(much[0], start)
    half = np.broadcast_to(np.eye(2, dtype=complex), (3, 2, 2))
    few, much = est.kronecker_online_step(y, (half, half, np.ones((3, 80))), 1), est.kronecker_online_step(many, (half, half, np.ones((3, n))), 1)
    assert all(np.allclose(u, v) and not np.allclose(v, half) for u, v in zip(few[:2], much[:2], strict=True))


def numerical(loss, manifold, point, gradient, k):
    e = 1e-6
    step = [np.zeros_like(v) for v in point]
    step[k] = e * gradient[k]
    return (loss(*manifold.retr(point, step)) - loss(*point)) / e


def test_gradients(x):
    y, r = x[:, 0], np.random.default_rng(5)
    f = man.ScaledGaussianFIM(4, 20, 0)
    point = [f.parts[0].rand((3,)) + 0j, np.exp(r.standard_normal((3, 20)))]
    g = est.scaled_gaussian_gradient(y, *point)
    for k in range(2):
        assert np.allclose(numerical(lambda *p: est.scaled_gaussian_loss(y, *p), f, point, g, k), f.weights[k] * f.parts[k].inner(point[k], g[k], g[k]), rtol=1e-3)
    q = man.KroneckerScaledGaussian(2, 2, 20, 0)
    point = [q.parts[0].rand((3,)) + 0j, q.parts[1].rand((3,)) + 0j, np.exp(r.standard_normal((3, 20)))]
    g = est.kronecker_gradient(y, *point)
    for k in range(3):
        assert np.allclose(numerical(lambda *p: est.kronecker_loss(y, *p), q, point, g, k), q.weights[k] * q.parts[k].inner(point[k], g[k], g[k]), rtol=1e-3)


def test_kronecker(x):
    y = x[:, 0]
    a, b, tau = est.kronecker_mm(y, 2, 2, 1e-13, 500)
    assert max(np.abs(g).max() for g in est.kronecker_gradient(y, a, b, tau)) < 1e-8
    m = est.as_matrices(y, 2, 2)
    full = np.stack([np.kron(np.conj(u), v) for u, v in zip(a, b, strict=True)])
    assert np.allclose(est.kronecker_forms(m, np.linalg.inv(a), np.linalg.inv(b)), linalg.quadratic(y, np.linalg.inv(full)))
    with pytest.raises(ValueError):
        est.as_matrices(y, 2, 3)


def test_two_array_tyler_converges_to_the_truth():
    """Up to one scale an array, which the textures absorb."""
    m = 8
    cov = linalg.normalise(gen.sonar_covariance(m), "trace")
    s = est.two_array_tyler(gen.trial(7, 0, "gaussian", 1, 5000, cov), m, iter_max=100)[0]
    assert np.isclose(np.trace(s).real, 2 * m)
    scale = np.repeat([np.trace(s[:m, :m]).real / m, np.trace(s[m:, m:]).real / m], m) ** -0.5
    assert np.linalg.norm(s * np.outer(scale, scale) - cov) / np.linalg.norm(cov) < 0.15


def test_change_statistics(x):
    assert np.allclose(det.gaussian_glrt(x[:, :1]), 0)
    same = np.repeat(x[:, :1], 3, 1)
    assert np.allclose(det.gaussian_glrt(same), 0) and np.allclose(det.student_glrt(same, iter_max=1), 0, atol=1e-8)
    c = np.random.default_rng(0).standard_normal((4, 4))
    assert np.allclose(det.gaussian_glrt(x @ c.T), det.gaussian_glrt(x))
    assert np.allclose(det.compound_glrt(x[:, :1], 1e-12, 500), 0, atol=1e-5)
    assert np.allclose(det.kronecker_glrt(x[:, :1], 2, 2), 0, atol=1e-8)
    assert not np.allclose(det.compound_glrt(x[:, :1], 1e-12, 500, "mixed"), 0, atol=0.5)
    assert (det.compound_glrt(x, 1e-10, 300) > 0).all() and (det.kronecker_glrt(x, 2, 2, 1e-10, 300) > 0).all()


def test_online_equals_offline_for_gaussian(x):
    run = det.fold(x, det.gaussian_step)
    for t in range(2, 5):
        assert np.allclose(run[:, t - 1], det.gaussian_glrt(x[:, :t]))


def test_online_steps_are_pure_and_batch_free(x):
    for step in (det.compound_step, lambda s, y: det.kronecker_step(s, y, 2, 2)):
        run = det.fold(x, step)
        assert np.allclose(run[1], det.fold(x[1], step), atol=1e-6)
        assert np.allclose(run[:, 0], 0, atol=1e-6)


def test_detection_has_power():
    law = {"seed": 1, "law": "gaussian", "dates": 6, "n": 9, "before": gen.covariance(4, 0, "det")}
    h0 = np.array([det.gaussian_glrt(gen.trial(k=k, **law)) for k in range(60)])
    h1 = np.array([det.gaussian_glrt(gen.trial(k=k, after=gen.covariance(4, 1, "det") * 3, change=3, **law)) for k in range(60)])
    assert (h1 > np.quantile(h0, 0.9)).mean() > 0.8


def test_sonar():
    m = 4
    cov, p = gen.sonar_covariance(m), gen.steering(m, 30, 45)
    assert (np.linalg.eigvalsh(cov) > 0).all() and np.allclose(cov, cov.T)
    s = det.Sonar(m, p)
    r = np.random.default_rng(1)
    h0 = (r.standard_normal((2000, 2 * m)) + 1j * r.standard_normal((2000, 2 * m))) / np.sqrt(2) @ linalg.ct(np.linalg.cholesky(cov))
    db, alpha = gen.snr_sweep(m, cov, p, 0, 10, 2)
    h1 = h0 + p @ np.full(2, alpha[1])
    for name, stat in s.all(h0, cov).items():
        assert s.all(h1, cov)[name].mean() > stat.mean()
    residual = s.residual_inverse(np.linalg.inv(cov))
    assert np.allclose(residual @ p, 0, atol=1e-6 * np.abs(residual).max())
    with pytest.raises(ValueError):
        s.single(h0, cov, 2)


def test_wavelet_bands():
    image = np.random.default_rng(0).standard_normal((2, 12, 16)) + 0j
    bank = signal.filter_bank(*signal.wave_grid(12, 16, 1e9, 0.15, 0.5, 1e10), 2, 3, 10, 10)
    assert bank.shape == (6, 12, 16)
    bands = signal.decompose(image, bank)
    assert bands.shape == (2, 12, 16, 6) and np.allclose(bands, signal.decompose(image, bank, "consistent"))
    assert np.allclose(signal.decompose(image, np.ones((1, 12, 16)))[..., 0], image)


def test_generators_do_not_depend_on_order():
    law = {"seed": 3, "law": "kronecker", "dates": 4, "n": 5, "before": gen.factors(2, 3)}
    assert np.array_equal(gen.trial(k=4, **law), gen.trial(k=4, **law)) and not np.array_equal(gen.trial(k=4, **law), gen.trial(k=5, **law))
    assert gen.dates_grid(5, 200, 20)[0] == 5
    big = gen.trial(0, 0, "gaussian", 1, 40_000, gen.covariance(3, 0))[0]
    assert np.linalg.norm(est.scm(big) - gen.covariance(3, 0)) < 0.1
