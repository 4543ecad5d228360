"""Queries of the manifolds and the covariance estimators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from covaria.functions import estimators as est
from covaria.functions import expr, linalg
from covaria.functions import manifolds as man
from covaria.operators import moments as mom
from covaria.operators.groups import by_group, estimate, flat
from covaria.plans.matrices import _cells, _long
from covaria.plans.registry import SPREAD, observations, query, r6, samples, samples_sql, spread

_X2 = samples_sql(2)


def cells(df, p: int, keys=("g",)):
    """keys, i, j, re, im of the estimates."""
    rows = df.select(*keys, F.posexplode(F.arrays_zip("sigma_re", "sigma_im")).alias("k", "v"))
    return rows.select(*keys, F.floor(F.col("k") / p).cast("int").alias("i"), (F.col("k") % p).cast("int").alias("j"), r6(F.col("v.sigma_re"), "re"), r6(F.col("v.sigma_im"), "im"))


def real_cells(df, p: int, keys=("g",)):
    return _cells(df, F.col("sigma_re"), p, keys)


# Matrix functions and manifolds on complex matrices, by kernel.

_MATRIX = {
    "a16_batched_eigh": lambda s: {"v": np.linalg.eigvalsh(s)},
    "a33_eigh_psd": lambda s: {"v": np.linalg.eigh(linalg.herm(s))[0]},
    "a34_sqrtm_psd": lambda s: {"v": linalg.sqrtm(s).real.reshape(len(s), -1)},
    "a35_invsqrtm_psd": lambda s: {"v": linalg.invsqrtm(s).real.reshape(len(s), -1)},
    "a36_logm_psd": lambda s: {"v": linalg.logm(s).real.reshape(len(s), -1)},
    "a37_sqrtm_invsqrtm_psd": lambda s: {"v": np.concatenate([m.real.reshape(len(s), -1) for m in linalg.sqrtm_invsqrtm(s)], 1)},
    "a38_inv_sqrtm_invsqrtm_psd": lambda s: {"v": np.concatenate([m.real.reshape(len(s), -1) for m in linalg.inv_sqrtm_invsqrtm(s)], 1)},
}


def _of_matrix(f, p=4):
    """f of the complex sample covariance of each label, as an array."""
    return lambda spark, d: by_group(observations(spark, d, p, True), ["g"], lambda x: f(est.scm(x[:, 0])), "v array<double>").select("g", F.posexplode("v").alias("k", "v")).select("g", "k", r6("v"))


for _name, _f in _MATRIX.items():
    query(_name)(_of_matrix(_f))


def _geometry(cls, method):
    """A manifold's method at each label's covariance x, with tangents u, v and second point y made from x."""

    def kernel(s):
        s = linalg.normalise(s, "det")
        p = s.shape[-1]
        m = cls(p, 0)
        y = linalg.herm(linalg.normalise(linalg.sqrtm(s) + 0.1 * np.eye(p), "det"))
        u, v = m.proj(s, 0.1 * linalg.herm(s @ s)), m.proj(s, 0.1 * linalg.herm(s @ np.diag(np.arange(1.0, p + 1)) @ s))
        got = {
            "inner": lambda: m.inner(s, u, v), "norm": lambda: m.norm(s, u), "proj": lambda: m.proj(s, s @ s), "egrad2rgrad": lambda: m.egrad2rgrad(s, u),
            "exp": lambda: m.exp(s, u), "log": lambda: m.log(s, y), "dist": lambda: m.dist(s, y), "rand": lambda: m.rand((len(s),)), "zerovec": lambda: m.zerovec(s),
            "randvec": lambda: m.randvec(s), "retr": lambda: m.retr(s, u), "transp": lambda: m.transp(s, y, u),
        }[method]()
        return {"v": np.asarray(got).real.reshape(len(s), -1)}

    return _of_matrix(kernel, 3)


_METHODS = ("inner", "norm", "proj", "egrad2rgrad", "exp", "log", "dist", "rand", "zerovec", "randvec", "retr", "transp")
for _k, _method in enumerate(_METHODS):
    query(f"b{3 + _k:02d}_hpd_{_method}")(_geometry(man.HermitianPositiveDefinite, _method))
    query(f"b{15 + _k:02d}_shpd_{_method}")(_geometry(man.SpecialHermitianPositiveDefinite, _method))


@query("b34_spv_rand")
def _(spark, d):
    return spark.range(100).select("id", *(F.exp(F.randn(k)).alias(f"x{k}") for k in range(3)))


@query("b35_spv_zerovec", "SELECT vec_id AS n, 0.0 AS v0, 0.0 AS v1, 0.0 AS v2 FROM embeddings")
def _(spark, d):
    return samples(spark, d, 3).select("n", *(F.lit(0.0).alias(f"v{k}") for k in range(3)))


@query("b36_spv_randvec")
def _(spark, d):
    u = spark.range(100).select("id", F.array(F.randn(1), F.randn(2), F.randn(3)).alias("u"), F.array(*(F.exp(F.randn(k)) for k in (4, 5, 6))).alias("x"))
    norm = F.sqrt(expr.spv_inner(F.col("x"), F.col("u"), F.col("u")))
    return u.select("id", norm.alias("n"), "u", "x").select("id", F.transform("u", lambda v: v / F.col("n")).alias("v"))


def _product(make):
    """dist, inner and norm on a product whose last factor, if any, holds textures."""

    def kernel(x):
        s = linalg.normalise(est.scm(x[:, 0]), "det")
        m = make(s.shape[-1])
        point, other = [], []
        for part in m.parts:
            if isinstance(part, man.StrictlyPositiveVectors):
                point.append(np.full((len(s), part.n), 2.0))
                other.append(np.full((len(s), part.n), 3.0))
            else:
                a = s[:, : part.p, : part.p]
                a = linalg.normalise(a, "det") if isinstance(part, man.SpecialHermitianPositiveDefinite) else a
                point.append(a)
                other.append(linalg.normalise(linalg.sqrtm(a), "det") if isinstance(part, man.SpecialHermitianPositiveDefinite) else linalg.sqrtm(a))
        u = m.log(point, other)
        return {"dist": m.dist(point, other), "inner": m.inner(point, u, u), "norm": m.norm(point, u)}

    return lambda spark, d: by_group(observations(spark, d, 4, True), ["g"], kernel, "dist double, inner double, norm double").select("g", r6("dist"), r6("inner"), r6("norm"))


query("b38_product_manifold")(_product(lambda p: man.Product([man.SpecialHermitianPositiveDefinite(p), man.StrictlyPositiveVectors(5)])))
query("b39_weighted_product_manifold")(_product(lambda p: man.WeightedProduct([man.SpecialHermitianPositiveDefinite(p), man.StrictlyPositiveVectors(5)], [0.5, 2.0])))
query("b40_scaled_gaussian_fim")(_product(lambda p: man.ScaledGaussianFIM(p, 5)))
query("b41_kronecker_elliptical")(_product(lambda p: man.KroneckerElliptical(2, 2)))
query("b42_kronecker_scaled_gaussian")(_product(lambda p: man.KroneckerScaledGaussian(2, 2, 5)))

# Estimators. The SQL of an iteration chains one common table a step.

_WEIGHTS = {"tyler": "2.0 / q", "student": "3.5 / (q + 1.5)", "huber": "least(1.0, 1.5 / q) / 0.9", "one": "1.0"}
_SCALES = {"none": "1.0", "trace": "((a + c) / 2)", "diag": "a", "det": "sqrt(a * c - b * b)"}


def steps_sql(steps: int, kind: str, normalisation: str) -> str:
    parts = [f"s0 AS (SELECT g, 1.0 AS a, 0.0 AS b, 1.0 AS c FROM {_X2} x GROUP BY g)"]
    for k in range(steps):
        q = f"(SELECT x.g, x0, x1, (s.c * x0 * x0 - 2 * s.b * x0 * x1 + s.a * x1 * x1) / (s.a * s.c - s.b * s.b) AS q FROM {_X2} x JOIN s{k} s ON x.g = s.g) y"
        parts.append(f"m{k} AS (SELECT g, avg(w * x0 * x0) AS a, avg(w * x0 * x1) AS b, avg(w * x1 * x1) AS c FROM (SELECT *, {_WEIGHTS[kind]} AS w FROM {q}) z GROUP BY g)")
        parts.append(f"s{k + 1} AS (SELECT g, a / {_SCALES[normalisation]} AS a, b / {_SCALES[normalisation]} AS b, c / {_SCALES[normalisation]} AS c FROM m{k})")
    return "WITH " + ", ".join(parts) + " " + _long({(0, 0): "a", (0, 1): "b", (1, 0): "b", (1, 1): "c"}, f"SELECT * FROM s{steps}")


def _scm_sql(p: int, centre: bool) -> str:
    cell = lambda i, j: f"avg(x{i} * x{j})" + (f" - avg(x{i}) * avg(x{j})" if centre else "")
    return " UNION ALL ".join(f"SELECT g, {i} AS i, {j} AS j, round({cell(min(i, j), max(i, j))}, 6) + 0.0 AS v FROM {samples_sql(p)} s GROUP BY g" for i in range(p) for j in range(p))


for _centre in (False, True):

    def _scm(spark, d, centre=_centre):
        return mom.long_form(mom.moments(samples(spark, d, 8), ["g"], [f"x{i}" for i in range(8)], centre), ["g"], 8).select("g", "i", "j", r6("v"))

    query("c02_scm" + "_centred" * _centre, _scm_sql(8, _centre))(_scm)


@query("c02_scm_complex", " UNION ALL ".join(
    f"SELECT label AS g, {i} AS i, {j} AS j, round(avg(embedding[{i + 1}]::DOUBLE * embedding[{j + 1}] + embedding[{i + 33}]::DOUBLE * embedding[{j + 33}]), 6) + 0.0 AS re, "
    f"round(avg(embedding[{i + 1}]::DOUBLE * embedding[{j + 33}] - embedding[{i + 33}]::DOUBLE * embedding[{j + 1}]), 6) + 0.0 AS im FROM embeddings GROUP BY label"
    for i in range(3) for j in range(3)))
def _(spark, d):
    return cells(estimate(observations(spark, d, 3, True), ["g"], est.scm), 3)


for _id, _kind in (("c03_student_weight", "student"), ("c04_huber_weight", "huber"), ("c05_tyler_weight", "tyler")):

    def _weights(spark, d, kind=_kind):
        q = F.col("x0") * F.col("x0") + F.col("x1") * F.col("x1")
        return samples(spark, d, 2).select("n", r6(expr.weight(q, kind, 2, limit=1.5 if kind == "huber" else float("inf"), beta=0.9 if kind == "huber" else 1.0), "w"))

    query(_id, f"SELECT n, round({_WEIGHTS[_kind]}, 6) + 0.0 AS w FROM (SELECT n, x0 * x0 + x1 * x1 AS q FROM {_X2} x) y")(_weights)


def _native(steps, kind, normalisation):
    extra = {"limit": 1.5, "beta": 0.9} if kind == "huber" else {}

    def run(spark, d):
        s = mom.reweighted(samples(spark, d, 2), ["g"], steps, kind, normalisation, **extra)
        return mom.long_form(s, ["g"], 2).select("g", "i", "j", r6("v"))

    return run


query("c06_covariance_update", steps_sql(1, "student", "none"))(_native(1, "student", "none"))
query("c07_fixed_point_native", steps_sql(3, "tyler", "trace"))(_native(3, "tyler", "trace"))

_KERNELS = {
    "c08_tyler": (lambda x: est.tyler(x, "trace", 0.0, 6), "tyler", "trace"),
    "c09_student_t": (lambda x: est.student_t(x, 3, None, 0.0, 6), "student", "none"),
    "c10_huber": (lambda x: est.huber(x, 1.5, 0.9, None, 0.0, 6), "huber", "none"),
    "c07_fixed_point_det": (lambda x: est.fixed_point(x, est.tyler_weight, 0.0, 6, "det", most=3), "tyler", "det"),
    "c07_fixed_point_diag": (lambda x: est.fixed_point(x, est.tyler_weight, 0.0, 6, "diag"), "tyler", "diag"),
}
for _id, (_f, _kind, _norm) in _KERNELS.items():
    query(_id, steps_sql(6, _kind, _norm))(lambda spark, d, f=_f: real_cells(estimate(observations(spark, d, 2), ["g"], f), 2))

query("c10_huber_without_limit", steps_sql(1, "one", "none"))(lambda spark, d: real_cells(estimate(observations(spark, d, 2), ["g"], est.huber), 2))
query("c08_tyler_complex")(lambda spark, d: cells(estimate(observations(spark, d, 8, True), ["g"], est.tyler), 8))
query("c09_student_t_complex")(lambda spark, d: cells(estimate(observations(spark, d, 8, True), ["g"], est.student_t), 8))
query("c10_huber_complex")(lambda spark, d: cells(estimate(observations(spark, d, 8, True), ["g"], lambda x: est.huber(x, 4.0)), 8))


@query("c11_scaled_gaussian_loss", f"SELECT g, round(sum(2 * ln(1 + abs(x0)) + (x0 * x0 + x1 * x1) / (1 + abs(x0))) / (2 * count(*)), 6) + 0.0 AS v FROM {_X2} x GROUP BY g")
def _(spark, d):
    """At the identity, with textures 1 + |x0|."""
    kernel = lambda x: {"v": est.scaled_gaussian_loss(x[:, 0], np.broadcast_to(np.eye(2), (len(x), 2, 2)), 1 + np.abs(x[:, 0, :, 0]))}
    return by_group(observations(spark, d, 2), ["g"], kernel, "v double").select("g", r6("v"))


def _scaled(f, p=4, out="v array<double>"):
    return lambda spark, d: by_group(observations(spark, d, p, True), ["g"], lambda x: f(x[:, 0]), out)


def _start(x):
    return np.broadcast_to(np.eye(x.shape[-1], dtype=complex), (len(x), x.shape[-1], x.shape[-1])), np.ones(x.shape[:-1])


query("c12_scaled_gaussian_gradient")(_scaled(lambda x: {"v": est.scaled_gaussian_gradient(x, *_start(x))[0].real}))
query("c13_armijo_step")(_scaled(lambda x: {"v": est.natural_gradient_step(x, _start(x), 1.0, armijo_max_backtracks=30)[0].real}))
query("c14_natural_gradient")(_scaled(lambda x: dict(zip(("v", "tau"), (lambda r: (r[0].real, r[1]))(est.natural_gradient(x)), strict=True)), out="v array<double>, tau array<double>"))
query("c15_scaled_gaussian_estimator")(lambda spark, d: cells(estimate(observations(spark, d, 4, True), ["g"], lambda x: est.natural_gradient(x)[0]), 4))

def _joint_sql(steps: int) -> str:
    parts = [f"x AS (SELECT * FROM {SPREAD} x)", "s0 AS (SELECT g, 1.0 AS a, 0.0 AS b, 1.0 AS c FROM x GROUP BY g)"]
    for k in range(steps):
        parts.append(f"q{k} AS (SELECT x.g, x.n, x0, x1, sum((s.c * x0 * x0 - 2 * s.b * x0 * x1 + s.a * x1 * x1) / (s.a * s.c - s.b * s.b)) OVER (PARTITION BY x.g, x.n) / count(*) OVER (PARTITION BY x.g, x.n) AS tau FROM x JOIN s{k} s ON x.g = s.g)")
        parts.append(f"m{k} AS (SELECT g, sum(x0 * x0 / tau) AS a, sum(x0 * x1 / tau) AS b, sum(x1 * x1 / tau) AS c FROM q{k} GROUP BY g)")
        parts.append(f"s{k + 1} AS (SELECT g, a / ((a + c) / 2) AS a, b / ((a + c) / 2) AS b, c / ((a + c) / 2) AS c FROM m{k})")
    return "WITH " + ", ".join(parts) + " " + _long({(0, 0): "a", (0, 1): "b", (1, 0): "b", (1, 1): "c"}, f"SELECT * FROM s{steps}")


def _shared(x):
    """Five steps over dates of equal or unequal sizes."""
    whole, dates = est.padded(x) if isinstance(x, list) else (x, 1)
    return est.matrix_and_texture(whole, 0.0, 5, weight=dates)


query("c16_matrix_and_texture", _joint_sql(5))(lambda spark, d: real_cells(by_group(spread(spark, d, False, 2), ["g"], lambda x: flat(_shared(x)), "sigma_re array<double>, sigma_im array<double>", uneven=True), 2))


def _two_sql(steps: int) -> str:
    parts = [f"s0 AS (SELECT g, 1.0 AS a, 0.0 AS b, 1.0 AS c FROM {_X2} x GROUP BY g)"]
    for k in range(steps):
        inv = f"(SELECT x.g, x0, x1, s.c / (s.a * s.c - s.b * s.b) * x0 * x0 AS t1, s.a / (s.a * s.c - s.b * s.b) * x1 * x1 AS t2, -s.b / (s.a * s.c - s.b * s.b) * x0 * x1 AS t3 FROM {_X2} x JOIN s{k} s ON x.g = s.g) y"
        parts.append(f"m{k} AS (SELECT g, avg(x0 * x0 / u) AS a, avg(x0 * x1 / sqrt(u * v)) AS b, avg(x1 * x1 / v) AS c FROM (SELECT g, x0, x1, abs(t1 + sqrt(t1 / t2) * t3) AS u, abs(t2 + sqrt(t2 / t1) * t3) AS v FROM {inv}) z GROUP BY g)")
        parts.append(f"s{k + 1} AS (SELECT g, a / ((a + c) / 2) AS a, b / ((a + c) / 2) AS b, c / ((a + c) / 2) AS c FROM m{k})")
    return "WITH " + ", ".join(parts) + " " + _long({(0, 0): "a", (0, 1): "b", (1, 0): "b", (1, 1): "c"}, f"SELECT * FROM s{steps}")


query("c24_two_array_tyler", _two_sql(4))(lambda spark, d: real_cells(estimate(observations(spark, d, 2), ["g"], lambda x: est.two_array_tyler(x, 1, 0.0, 4)), 2))
query("c25_two_array_tyler_complex")(lambda spark, d: cells(estimate(observations(spark, d, 4, True), ["g"], lambda x: est.two_array_tyler(x, 2)), 4))


def _kron(f, out):
    """All samples of a label at one date."""
    return lambda spark, d: by_group(observations(spark, d, 4, True), ["g"], f, out)


def _dates(f, out):
    """All samples of a label over five dates, as a list of dates."""
    return lambda spark, d: by_group(spread(spark, d), ["g"], lambda x: f(x if isinstance(x, list) else list(np.moveaxis(x, 1, 0))), out, uneven=True)


def _each(dates):
    """A and B of every date, then its textures, date by date."""
    parts = [est.kronecker_mm(x, 2, 2) for x in dates]
    return _both(np.stack([p[0] for p in parts], 1), np.stack([p[1] for p in parts], 1), np.concatenate([p[2] for p in parts], -1))


def _both(a, b, tau):
    n = len(a)
    return {"a": a.real.reshape(n, -1), "b": b.real.reshape(n, -1), "tau": tau.reshape(n, -1)}


def _online(dates):
    """The estimate of the first date, carried on through all others."""
    state = est.kronecker_mm(dates[0], 2, 2)
    for t, x in enumerate(dates[1:], 2):
        state = est.kronecker_online_step(x, state, t)
    return _both(*state)


_ABT = "a array<double>, b array<double>, tau array<double>"
query("c17_kronecker_forms")(_kron(lambda x: {"v": est.kronecker_forms(est.as_matrices(x[:, 0], 2, 2), np.eye(2)[None].repeat(len(x), 0), np.eye(2)[None].repeat(len(x), 0))}, "v array<double>"))
query("c18_kronecker_mm_step")(_kron(lambda x: dict(zip("ab", (m.real.reshape(len(x), -1) for m in est.kronecker_mm_step(est.as_matrices(x[:, 0], 2, 2), *[np.eye(2)[None].repeat(len(x), 0) + 0j] * 2)), strict=True)), "a array<double>, b array<double>"))
query("c19_kronecker_mm_h1")(_dates(_each, _ABT))
query("c20_kronecker_mm_h0")(_dates(lambda x: _both(*est.kronecker_mm_shared(x, 2, 2)[:3]), _ABT))
query("c21_kronecker_loss")(_kron(lambda x: {"v": est.kronecker_loss(x[:, 0], *est.kronecker_mm(x[:, 0], 2, 2))}, "v double"))
query("c22_kronecker_gradient")(_kron(lambda x: _both(*est.kronecker_gradient(x[:, 0], *[np.eye(2)[None].repeat(len(x), 0) + 0j] * 2, np.ones(x[:, 0].shape[:-1]))), _ABT))
query("c23_kronecker_armijo_step")(_dates(_online, _ABT))
