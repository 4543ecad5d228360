"""More SQL twins: products of manifolds, converged estimators, adaptive detection and maps at two real features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from covaria.functions import detectors as det
from covaria.functions import estimators as est
from covaria.functions import linalg
from covaria.functions import manifolds as man
from covaria.operators.adaptive import adaptive, split
from covaria.operators.groups import by_group, detect, estimate
from covaria.plans.closed import chain, compound_sql
from covaria.plans.layout import _SCENE, scene, windowed
from covaria.plans.registry import SPREAD, observations, query, r6, samples_sql, spread

_X2 = samples_sql(2)
_SCM = f"(SELECT g, avg(x0 * x0) AS a, avg(x0 * x1) AS b, avg(x1 * x1) AS c FROM {_X2} t GROUP BY g) s"
_ROOT, _SUM = "sqrt(a * c - b * b)", "sqrt(a + c + 2 * sqrt(a * c - b * b))"
_SQRT = [f"(a + {_ROOT}) / {_SUM}", f"b / {_SUM}", f"(c + {_ROOT}) / {_SUM}"]
_INV = ["c / (a * c - b * b)", "-b / (a * c - b * b)", "a / (a * c - b * b)"]
#: the root's determinant is the root of the determinant
_INVSQRT = [f"(c + {_ROOT}) / {_SUM} / {_ROOT}", f"-b / {_SUM} / {_ROOT}", f"(a + {_ROOT}) / {_SUM} / {_ROOT}"]


def _list(columns: list[str]) -> str:
    return "SELECT g, " + ", ".join(f"round({c}, 6) + 0.0 AS v{k}" for k, c in enumerate(columns)) + f" FROM {_SCM}"


def _upper(m):
    return m.reshape(len(m), 4)[:, [0, 1, 3]]


for _name, _columns, _f in (
    ("a33_eigh_psd_real", [f"(a + c) / 2 {s} sqrt((a - c) * (a - c) / 4 + b * b)" for s in "-+"], lambda s: np.linalg.eigh(linalg.herm(s))[0]),
    ("a37_sqrtm_invsqrtm_real", _SQRT + _INVSQRT, lambda s: np.concatenate([_upper(m) for m in linalg.sqrtm_invsqrtm(s)], 1)),
    ("a38_inv_sqrtm_invsqrtm_real", _INV + _SQRT + _INVSQRT, lambda s: np.concatenate([_upper(m) for m in linalg.inv_sqrtm_invsqrtm(s)], 1)),
):

    def _run(spark, d, f=_f, n=len(_columns)):
        rows = by_group(observations(spark, d, 2), ["g"], lambda x: {"v": f(est.scm(x[:, 0]))}, "v array<double>")
        return rows.select("g", *(r6(F.get("v", F.lit(k)), f"v{k}") for k in range(n)))

    query(_name, _list(_columns))(_run)

# Products. The second point is the root of the first in each factor, and 3 for a texture of 2, so that the
# squared distance of a factor is (ln l)^2 / 2 for eigenvalues l, 1 / l, and n (ln 1.5)^2 for n textures.

_LOG = f"(pow(ln(((a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b)) / {_ROOT}), 2) / 2)"
_TEX = "(5 * pow(ln(1.5), 2))"


def _product(make):
    def kernel(x):
        s = linalg.normalise(est.scm(x[:, 0]), "det")
        m = make()
        point, other = [], []
        for part in m.parts:
            if isinstance(part, man.StrictlyPositiveVectors):
                point.append(np.full((len(s), part.n), 2.0))
                other.append(np.full((len(s), part.n), 3.0))
            else:
                point.append(s if part.p == 2 else np.ones((len(s), 1, 1)))
                other.append(linalg.sqrtm(point[-1]))
        u = m.log(point, other)
        return {"dist": m.dist(point, other), "inner": m.inner(point, u, u), "norm": m.norm(point, u)}

    return lambda spark, d: by_group(observations(spark, d, 2), ["g"], kernel, "dist double, inner double, norm double").select("g", r6("dist"), r6("inner"), r6("norm"))


for _name, _make, _weights in (
    ("b38_product_manifold_real", lambda: man.Product([man.SpecialHermitianPositiveDefinite(2), man.StrictlyPositiveVectors(5)]), (1, 1)),
    ("b39_weighted_product_real", lambda: man.WeightedProduct([man.SpecialHermitianPositiveDefinite(2), man.StrictlyPositiveVectors(5)], [0.5, 2.0]), (0.5, 2)),
    ("b40_scaled_gaussian_fim_real", lambda: man.ScaledGaussianFIM(2, 5), (1 / 2, 1 / 5)),
    ("b41_kronecker_elliptical_real", lambda: man.KroneckerElliptical(1, 2, 3.0), (3.0, 0)),
    ("b42_kronecker_scaled_gaussian_real", lambda: man.KroneckerScaledGaussian(1, 2, 5), (1 / 2, 1 / 5)),
):
    _w = f"({_weights[0]!r} * {_LOG} + {_weights[1]!r} * {_TEX})"
    _plain = f"({_LOG} + {_TEX})" if _weights[1] else _LOG
    query(_name, f"SELECT g, round(sqrt({_w}), 6) + 0.0 AS dist, round({_w}, 6) + 0.0 AS inner, round(sqrt({_plain}), 6) + 0.0 AS norm FROM {_SCM}".replace("AS inner,", 'AS "inner",'))(_product(_make))

# Converged estimators: the natural gradient's shape, and a Kronecker factor beside a factor of one, are Tyler's.

_TYLER = "WITH " + ", ".join([f"x AS (SELECT * FROM {_X2} x)", *chain("e", "g", 30, "tyler", True)]) + " SELECT g, round(a / {0}, 3) + 0.0 AS v0, round(b / {0}, 3) + 0.0 AS v1, round(c / {0}, 3) + 0.0 AS v2 FROM e30"


def _shape(f, mode):
    def run(spark, d):
        rows = estimate(observations(spark, d, 2), ["g"], lambda x: linalg.normalise(f(x), mode))
        return rows.select("g", *((F.round(F.get("sigma_re", F.lit(i)), 3) + 0.0).alias(f"v{k}") for k, i in enumerate((0, 1, 3))))

    return run


query("c14_natural_gradient_real", _TYLER.format(_ROOT))(_shape(lambda x: est.natural_gradient(x)[0], "det"))
query("c15_scaled_gaussian_estimator_real", _TYLER.format("((a + c) / 2)"))(_shape(lambda x: est.natural_gradient(x)[0], "trace"))
query("c19_kronecker_mm_h1_real", _TYLER.format("((a + c) / 2)"))(_shape(lambda x: est.kronecker_mm(x, 1, 2, 1e-12, 200)[1], "trace"))

# Deviations of the two-array estimator with one sensor an array.


def _deviations(steps: int) -> str:
    parts = [f"s0 AS (SELECT g, 1.0 AS a, 0.0 AS b, 1.0 AS c FROM {_X2} x GROUP BY g)"]
    for k in range(steps):
        inv = f"(SELECT x.g, x0, x1, s.c / (s.a * s.c - s.b * s.b) * x0 * x0 AS t1, s.a / (s.a * s.c - s.b * s.b) * x1 * x1 AS t2, -s.b / (s.a * s.c - s.b * s.b) * x0 * x1 AS t3 FROM {_X2} x JOIN s{k} s ON x.g = s.g) y"
        parts.append(f"m{k} AS (SELECT g, avg(x0 * x0 / u) AS a, avg(x0 * x1 / sqrt(u * v)) AS b, avg(x1 * x1 / v) AS c FROM (SELECT g, x0, x1, abs(t1 + sqrt(t1 / t2) * t3) AS u, abs(t2 + sqrt(t2 / t1) * t3) AS v FROM {inv}) z GROUP BY g)")
        parts.append(f"s{k + 1} AS (SELECT g, a / ((a + c) / 2) AS a, b / ((a + c) / 2) AS b, c / ((a + c) / 2) AS c FROM m{k})")
    norm = lambda p, q: "sqrt(" + " + ".join(f"{w} * pow({p}.{n}" + (f" - {q}.{n}" if q else "") + ", 2)" for n, w in (("a", 1), ("b", 2), ("c", 1))) + ")"
    each = [f"SELECT {k} AS it, round(avg({norm('y', 'x')} / {norm('x', '')}), 6) + 0.0 AS deviation FROM s{k} x JOIN s{k + 1} y ON x.g = y.g" for k in range(steps)]
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(each)


@query("f07_relative_deviations_real", _deviations(4))
def _(spark, d):
    def kernel(x):
        history: list = []
        est.two_array_tyler(x[:, 0], 1, 0.0, 4, history)
        return {"v": np.stack(history, 1)}

    rows = by_group(observations(spark, d, 2), ["g"], kernel, "v array<double>").select("g", F.posexplode("v").alias("it", "v"))
    return rows.groupBy("it").agg(F.avg("v").alias("deviation")).select("it", r6("deviation"))


# Adaptive detection with one sensor an array: the matched filter is the quadratic form.

_TRIAL = f"(SELECT *, row_number() OVER (PARTITION BY g ORDER BY n) AS k FROM {_X2} t)"


@query("d17_adaptive_matched_real", f"SELECT p.g::BIGINT AS trial, round((s.c * x0 * x0 - 2 * s.b * x0 * x1 + s.a * x1 * x1) / (s.a * s.c - s.b * s.b), 6) + 0.0 AS matched FROM {_TRIAL} p JOIN (SELECT g, avg(x0 * x0) AS a, avg(x0 * x1) AS b, avg(x1 * x1) AS c FROM {_TRIAL} q WHERE k > 1 GROUP BY g) s ON p.g = s.g WHERE p.k = 1")
def _(spark, d):
    o = observations(spark, d, 2).withColumn("trial", F.col("g").cast("long")).withColumn("im", F.array(F.lit(0.0), F.lit(0.0)))
    got = adaptive(*split(o), det.Sonar(1, np.eye(2, dtype=complex)), est.scm, ("matched",))
    return got.select("trial", r6("matched"))


# Compound statistics of any keys, dates and samples: as a map, and with a factor of one as the Kronecker statistic.


_WINDOWS = f"(SELECT * FROM (SELECT wrow::INT AS wrow, wcol::INT AS wcol, t, (row - wrow) * 3 + col - wcol AS n, a AS x0, b AS x1, count(*) OVER (PARTITION BY wrow, wcol) AS whole FROM {_SCENE} p, (SELECT unnest(range(0, 10)) AS wrow) y, (SELECT unnest(range(0, 10)) AS wcol) z WHERE row BETWEEN wrow AND wrow + 2 AND col BETWEEN wcol AND wcol + 2) v WHERE whole = 63)"


@query("i02_offline_compound_map_steps", compound_sql(_WINDOWS, "wrow, wcol", 2, 3))
def _(spark, d):
    """Windows that lack a pixel on some date have no result."""
    got = detect(windowed(scene(spark, d, fill=False)), ["wrow", "wcol"], lambda x: det.compound_glrt(x, 0.0, 2)).where("stat is not null")
    return got.select("wrow", "wcol", (F.round("stat", 3) + 0.0).alias("stat"))


query("d06_kronecker_glrt_real", compound_sql(SPREAD, "g", 30, 2, pooled=True))(
    lambda spark, d: detect(spread(spark, d, False, 2), ["g"], lambda x: det.kronecker_glrt(x, 1, 2, 1e-12, 300), uneven=True).select("g", (F.round("stat", 2) + 0.0).alias("stat"))
)
