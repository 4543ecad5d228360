"""Kernels at two real features, where closed forms or a fixed number of steps make a SQL twin possible.

The log and exp maps of 2 x 2 matrices need no square roots: with M = x^-1 y of eigenvalues l < h,
x f(M) = (f(l) - k l) x + k y where k = (f(h) - f(l)) / (h - l).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from covaria.functions import detectors as det
from covaria.functions import estimators as est
from covaria.functions import linalg
from covaria.functions import manifolds as man
from covaria.operators.groups import by_group, detect
from covaria.plans.registry import SPREAD, observations, query, r6, samples_sql, spread

_X2 = samples_sql(2)


def _levels(source: str, *levels: dict[str, str]) -> str:
    """Nested selects, each adding columns made from those below."""
    for k, level in enumerate(levels):
        source = f"SELECT *, {', '.join(f'{v} AS {n}' for n, v in level.items())} FROM ({source}) l{k}"
    return source


def _over(x: str, y: str) -> dict[str, str]:
    """trace and determinant of x^-1 y, eigenvalues; x and y are letters with entries 0, 1, 2."""
    return {"tr": f"({x}2 * {y}0 - 2 * {x}1 * {y}1 + {x}0 * {y}2) / ({x}0 * {x}2 - {x}1 * {x}1)", "dt": f"({y}0 * {y}2 - {y}1 * {y}1) / ({x}0 * {x}2 - {x}1 * {x}1)"}


_EIG = {"lo": "tr / 2 - sqrt(greatest(tr * tr / 4 - dt, 0.0))", "hi": "tr / 2 + sqrt(greatest(tr * tr / 4 - dt, 0.0))"}
_POINTS = _levels(
    f"SELECT g, avg(x0 * x0) AS s0, avg(x0 * x1) AS s1, avg(x1 * x1) AS s2 FROM {_X2} t GROUP BY g",
    {"sd": "sqrt(s0 * s2 - s1 * s1)"},
    {"x0": "s0 / sd", "x1": "s1 / sd", "x2": "s2 / sd"},
    # u = 0.1 x^2, v = 0.1 x diag(1, 2) x, y = x + 0.1 I of determinant one
    {"u0": "0.1 * (x0 * x0 + x1 * x1)", "u1": "0.1 * x1 * (x0 + x2)", "u2": "0.1 * (x1 * x1 + x2 * x2)", "v0": "0.1 * (x0 * x0 + 2 * x1 * x1)", "v1": "0.1 * (x0 * x1 + 2 * x1 * x2)", "v2": "0.1 * (x1 * x1 + 2 * x2 * x2)", "yd": "sqrt((x0 + 0.1) * (x2 + 0.1) - x1 * x1)"},
    {"y0": "(x0 + 0.1) / yd", "y1": "x1 / yd", "y2": "(x2 + 0.1) / yd"},
)


def _flattened(u: str) -> dict[str, str]:
    """u less its part along x, as the manifold of determinant one projects."""
    return {f"p{k}": f"{u}{k} - (x2 * {u}0 - 2 * x1 * {u}1 + x0 * {u}2) / 2 * x{k}" for k in range(3)}


def _named(source: str, letter: str, to: str) -> str:
    return _levels(source, {f"{to}{k}": f"{letter}{k}" for k in range(3)})


#: tr(x^-1 a x^-1 b) for det x = 1, where x^-1 = [[x2, -x1], [-x1, x0]]
def _inner(a: str, b: str) -> str:
    def m(k):  # entries of x^-1 k
        return f"(x2 * {k}0 - x1 * {k}1)", f"(x2 * {k}1 - x1 * {k}2)", f"(x0 * {k}1 - x1 * {k}0)", f"(x0 * {k}2 - x1 * {k}1)"

    p, q = m(a), m(b)
    return f"{p[0]} * {q[0]} + {p[1]} * {q[2]} + {p[2]} * {q[1]} + {p[3]} * {q[3]}"


def _mapped(source: str, y: str, f: str, after: dict | None = None) -> str:
    """x f(x^-1 y) as m0, m1, m2; f has {} for its argument."""
    levels = [_over("x", y), _EIG, {"k": f"({f.format('hi')} - {f.format('lo')}) / (hi - lo)"}, {f"m{i}": f"({f.format('lo')} - k * lo) * x{i} + k * {y}{i}" for i in range(3)}]
    return _levels(source, *levels, *([after] if after else []))


def _out(source: str, columns: list[str]) -> str:
    return "SELECT g, " + ", ".join(f"round({c}, 6) + 0.0 AS v{k}" for k, c in enumerate(columns)) + f" FROM ({source}) r"


_FLAT_UV = _levels(_levels(_POINTS, _flattened("u")), {f"q{k}": f"v{k} - (x2 * v0 - 2 * x1 * v1 + x0 * v2) / 2 * x{k}" for k in range(3)})
_THREE = ["m0", "m1", "m2"]


def _retr(u: str) -> dict[str, str]:
    """x + u + u x^-1 u / 2 for det x = 1."""
    w = (f"(x2 * {u}0 - x1 * {u}1)", f"(x2 * {u}1 - x1 * {u}2)", f"(x0 * {u}1 - x1 * {u}0)", f"(x0 * {u}2 - x1 * {u}1)")
    return {"m0": f"x0 + {u}0 + ({u}0 * {w[0]} + {u}1 * {w[2]}) / 2", "m1": f"x1 + {u}1 + ({u}0 * {w[1]} + {u}1 * {w[3]}) / 2", "m2": f"x2 + {u}2 + ({u}1 * {w[1]} + {u}2 * {w[3]}) / 2"}


_XUX = {f"m{k}": v for k, v in enumerate(("x0 * (u0 * x0 + u1 * x1) + x1 * (u1 * x0 + u2 * x1)", "x0 * (u0 * x1 + u1 * x2) + x1 * (u1 * x1 + u2 * x2)", "x1 * (u0 * x1 + u1 * x2) + x2 * (u1 * x1 + u2 * x2)"))}
_UNIT = {f"n{k}": f"m{k} / sqrt(m0 * m2 - m1 * m1)" for k in range(3)}
_PXUX = {f"n{k}": f"m{k} - (x2 * m0 - 2 * x1 * m1 + x0 * m2) / 2 * x{k}" for k in range(3)}
_TRANSP = {f"n{k}": f"p{k} - (y2 * p0 - 2 * y1 * p1 + y0 * p2) / 2 * y{k}" for k in range(3)}
_N = ["n0", "n1", "n2"]
_SQL = {
    "hpd": {
        "inner": _out(_POINTS, [_inner("u", "v")]), "norm": _out(_POINTS, [f"sqrt({_inner('u', 'u')})"]), "proj": _out(_POINTS, ["u0", "u1", "u2"]), "egrad2rgrad": _out(_levels(_POINTS, _XUX), _THREE),
        "exp": _out(_mapped(_POINTS, "u", "exp({})"), _THREE), "log": _out(_mapped(_POINTS, "y", "ln({})"), _THREE), "dist": _out(_levels(_POINTS, _over("x", "y"), _EIG), ["sqrt(pow(ln(lo), 2) + pow(ln(hi), 2))"]),
        "retr": _out(_levels(_POINTS, _retr("u")), _THREE), "transp": _out(_POINTS, ["u0", "u1", "u2"]), "zerovec": _out(_POINTS, ["0.0", "0.0", "0.0"]),
    },
    "shpd": {
        "inner": _out(_FLAT_UV, [_inner("p", "q")]), "norm": _out(_FLAT_UV, [f"sqrt({_inner('p', 'p')})"]), "proj": _out(_FLAT_UV, ["p0", "p1", "p2"]), "egrad2rgrad": _out(_levels(_POINTS, _XUX, _PXUX), _N),
        "exp": _out(_mapped(_FLAT_UV, "p", "exp({})", _UNIT), _N), "log": _out(_mapped(_POINTS, "y", "ln({})"), _THREE), "dist": _out(_levels(_POINTS, _over("x", "y"), _EIG), ["sqrt(pow(ln(lo), 2) + pow(ln(hi), 2))"]),
        "retr": _out(_levels(_FLAT_UV, _retr("p"), _UNIT), _N), "transp": _out(_levels(_FLAT_UV, _TRANSP), _N), "zerovec": _out(_POINTS, ["0.0", "0.0", "0.0"]),
    },
}


def _kernel(cls, method):
    def kernel(data):
        x = linalg.normalise(est.scm(data[:, 0]), "det")
        m = cls(2)
        y = linalg.normalise(x + 0.1 * np.eye(2), "det")
        raw, raw_v = 0.1 * x @ x, 0.1 * x @ np.diag([1.0, 2.0]) @ x
        u, v = m.proj(x, raw), m.proj(x, raw_v)
        got = {
            "inner": lambda: m.inner(x, u, v), "norm": lambda: m.norm(x, u), "proj": lambda: u, "egrad2rgrad": lambda: m.egrad2rgrad(x, raw), "exp": lambda: m.exp(x, u), "log": lambda: m.log(x, y),
            "dist": lambda: m.dist(x, y), "retr": lambda: m.retr(x, u), "transp": lambda: m.transp(x, y, u), "zerovec": lambda: m.zerovec(x),
        }[method]()
        return {"v": got if got.ndim == 1 else got.reshape(len(got), 4)[:, [0, 1, 3]]} if got.ndim > 1 else {"v": got[:, None]}

    return kernel


for _k, _name, _cls in ((3, "hpd", man.HermitianPositiveDefinite), (15, "shpd", man.SpecialHermitianPositiveDefinite)):
    for _j, _method in enumerate(("inner", "norm", "proj", "egrad2rgrad", "exp", "log", "dist", "rand", "zerovec", "randvec", "retr", "transp")):
        if _method in _SQL[_name]:

            def _run(spark, d, cls=_cls, method=_method):
                n = 1 if method in ("inner", "norm", "dist") else 3
                rows = by_group(observations(spark, d, 2), ["g"], _kernel(cls, method), "v array<double>")
                return rows.select("g", *(r6(F.get("v", F.lit(k)), f"v{k}") for k in range(n)))

            query(f"b{_k + _j:02d}_{_name}_{_method}_real", _SQL[_name][_method])(_run)


# Estimation pieces at the identity.


@query("c12_gradient_at_identity", f"SELECT g, round(-(a - c) / 2, 6) + 0.0 AS v0, round(-b, 6) + 0.0 AS v1, round((a - c) / 2, 6) + 0.0 AS v2 FROM (SELECT g, avg(x0 * x0) AS a, avg(x0 * x1) AS b, avg(x1 * x1) AS c FROM {_X2} t GROUP BY g) s")
def _(spark, d):
    kernel = lambda x: {"v": est.scaled_gaussian_gradient(x[:, 0], np.broadcast_to(np.eye(2), (len(x), 2, 2)), np.ones(x.shape[:1] + x.shape[2:3]))[0].reshape(len(x), 4)[:, [0, 1, 3]]}
    rows = by_group(observations(spark, d, 2), ["g"], kernel, "v array<double>")
    return rows.select("g", *(r6(F.get("v", F.lit(k)), f"v{k}") for k in range(3)))


_C4 = "(SELECT label AS g, " + " + ".join(f"pow(embedding[{k}]::DOUBLE, 2) + pow(embedding[{k + 32}]::DOUBLE, 2)" for k in range(1, 5)) + " AS q FROM embeddings) t"


def _identity(x):
    return np.broadcast_to(np.eye(2, dtype=complex), (len(x), 2, 2))


@query("c17_forms_at_identity", f"SELECT g, round(sum(q), 4) + 0.0 AS v FROM {_C4} GROUP BY g")
def _(spark, d):
    kernel = lambda x: {"v": est.kronecker_forms(est.as_matrices(x[:, 0], 2, 2), _identity(x), _identity(x)).sum(-1)}
    return by_group(observations(spark, d, 4, True), ["g"], kernel, "v double").select("g", (F.round("v", 4) + 0.0).alias("v"))


@query("c21_loss_at_identity", f"SELECT g, round(sum(4 * ln(2.0) + q / 2) / (4 * count(*)), 6) + 0.0 AS v FROM {_C4} GROUP BY g")
def _(spark, d):
    kernel = lambda x: {"v": est.kronecker_loss(x[:, 0], _identity(x), _identity(x), np.full(x.shape[:1] + x.shape[2:3], 2.0))}
    return by_group(observations(spark, d, 4, True), ["g"], kernel, "v double").select("g", r6("v"))


# Two-step and compound statistics with a fixed number of steps.

_WEIGHT = {"tyler": "2.0 / q", "student": "3.5 / (q + 1.5)"}


def chain(name: str, keys: str, steps: int, kind: str, trace: bool) -> list[str]:
    """Common tables name0 .. name{steps} of reweighted matrices of x, one for each value of the keys."""
    on = " AND ".join(f"x.{k} = s.{k}" for k in keys.split(", "))
    parts = [f"{name}0 AS (SELECT {keys}, 1.0 AS a, 0.0 AS b, 1.0 AS c FROM x GROUP BY {keys})"]
    scale = "((a + c) / 2)" if trace else "1.0"
    own = ", ".join(f"x.{k}" for k in keys.split(", "))
    for k in range(steps):
        weighed = f"SELECT {keys}, x0, x1, {_WEIGHT[kind]} AS w FROM (SELECT {own}, x0, x1, (s.c * x0 * x0 - 2 * s.b * x0 * x1 + s.a * x1 * x1) / (s.a * s.c - s.b * s.b) AS q FROM x JOIN {name}{k} s ON {on}) y"
        parts.append(f"{name}m{k} AS (SELECT {keys}, avg(w * x0 * x0) AS a, avg(w * x0 * x1) AS b, avg(w * x1 * x1) AS c FROM ({weighed}) z GROUP BY {keys})")
        parts.append(f"{name}{k + 1} AS (SELECT {keys}, a / {scale} AS a, b / {scale} AS b, c / {scale} AS c FROM {name}m{k})")
    return parts


def _two_step(kind: str, trace: bool, steps: int = 3) -> str:
    parts = [f"x AS (SELECT * FROM {SPREAD} x)", *chain("e", "g, t", steps, kind, trace), *chain("p", "g", steps, kind, trace)]
    return "WITH " + ", ".join(parts) + f" SELECT p.g AS g, round(5 * ln(p.a * p.c - p.b * p.b) - e.l, 6) + 0.0 AS stat FROM p{steps} p JOIN (SELECT g, sum(ln(a * c - b * b)) AS l FROM e{steps} GROUP BY g) e ON p.g = e.g"


query("d03_two_step_student_real", _two_step("student", False))(lambda spark, d: detect(spread(spark, d, False, 2), ["g"], lambda x: det.student_glrt(x, 3, 0.0, 3), uneven=True).select("g", r6("stat")))
query("d04_two_step_tyler_real", _two_step("tyler", True))(lambda spark, d: detect(spread(spark, d, False, 2), ["g"], lambda x: det.tyler_glrt(x, 0.0, 3), uneven=True).select("g", r6("stat")))


def compound_sql(source: str, keys: str, steps: int, digits: int, pooled: bool = False) -> str:
    """source has keys, t, n, x0, x1, dates of any sizes; pooled: the common shape is that of all dates' samples, each with its own texture."""
    on = lambda p, q: " AND ".join(f"{p}.{k} = {q}.{k}" for k in keys.split(", "))
    own = lambda p: ", ".join(f"{p}.{k}" for k in keys.split(", "))
    form = "(s.c * x0 * x0 - 2 * s.b * x0 * x1 + s.a * x1 * x1) / (s.a * s.c - s.b * s.b)"
    parts = [f"x AS (SELECT * FROM {source} x)", *chain("e", f"{keys}, t", steps, "tyler", True)]
    if pooled:
        parts += chain("j", keys, steps, "tyler", True)
    else:
        parts.append(f"j0 AS (SELECT {keys}, 1.0 AS a, 0.0 AS b, 1.0 AS c FROM x GROUP BY {keys})")
        for k in range(steps):
            over = f"OVER (PARTITION BY {own('x')}, x.n)"
            parts.append(f"jq{k} AS (SELECT {own('x')}, x.n, x0, x1, sum({form}) {over} / count(*) {over} AS tau FROM x JOIN j{k} s ON {on('x', 's')})")
            parts.append(f"jm{k} AS (SELECT {keys}, sum(x0 * x0 / tau) AS a, sum(x0 * x1 / tau) AS b, sum(x1 * x1 / tau) AS c FROM jq{k} GROUP BY {keys})")
            parts.append(f"j{k + 1} AS (SELECT {keys}, a / ((a + c) / 2) AS a, b / ((a + c) / 2) AS b, c / ((a + c) / 2) AS c FROM jm{k})")
    parts += [
        f"q0 AS (SELECT {keys}, sum(dates * ln(q)) AS l FROM (SELECT {own('x')}, x.n, count(*) AS dates, avg({form}) AS q FROM x JOIN j{steps} s ON {on('x', 's')} GROUP BY {own('x')}, x.n) y GROUP BY {keys})",
        f"q1 AS (SELECT {own('x')}, count(*) AS n, sum(ln({form})) AS q, sum(ln(s.a * s.c - s.b * s.b)) AS l FROM x JOIN e{steps} s ON {on('x', 's')} AND x.t = s.t GROUP BY {own('x')})",
    ]
    joins = " ".join(f"JOIN {t} ON {on('s', t)}" for t in ("q0", "q1"))
    return "WITH " + ", ".join(parts) + f" SELECT {own('s')}, round(q1.n * ln(s.a * s.c - s.b * s.b) - q1.l + 2 * q0.l - 2 * q1.q, {digits}) + 0.0 AS stat FROM j{steps} s {joins}"


query("d05_compound_glrt_real", compound_sql(SPREAD, "g", 3, 5))(lambda spark, d: detect(spread(spark, d, False, 2), ["g"], lambda x: det.compound_glrt(x, 0.0, 3), uneven=True).select("g", (F.round("stat", 5) + 0.0).alias("stat")))
