"""Sonar statistics as column expressions: constants of a known covariance meet rows of re and im arrays.

Everything is a quadratic form of the row, unrolled into sums with literal coefficients, so the statistics
stay inside Spark's generated code and need no join.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from covaria.functions.detectors import Sonar
from covaria.functions.estimators import FLOOR
from covaria.functions.linalg import ct


def _sum(terms: list[Column]) -> Column:
    return sum(terms[1:], terms[0]) if terms else F.lit(0.0)


def form(re: Column, im: Column | None, a: np.ndarray, rows: slice, cols: slice) -> Column:
    """Re x[rows]^H a x[cols]; im None means real data."""
    r = lambda k: F.get(re, F.lit(k))
    i = lambda k: F.get(im, F.lit(k))
    terms = []
    for k, s in enumerate(range(rows.start, rows.stop)):
        for l, t in enumerate(range(cols.start, cols.stop)):
            u, v = float(a[k, l].real), float(np.imag(a[k, l]))
            if u:
                terms.append(F.lit(u) * (r(s) * r(t) if im is None else r(s) * r(t) + i(s) * i(t)))
            if v and im is not None:
                terms.append(F.lit(v) * (i(s) * r(t) - r(s) * i(t)))
    return _sum(terms)


def _scales(a1: Column, a2: Column, a12: Column) -> tuple[Column, Column]:
    """Scales of the two arrays; a silent array is floored, so that both stay finite."""
    return F.sqrt(F.abs(a1 + F.sqrt(a1 / (a2 + FLOOR)) * a12)), F.sqrt(F.abs(a2 + F.sqrt(a2 / (a1 + FLOOR)) * a12))


def statistics(re: Column, im: Column | None, sonar: Sonar, cov: np.ndarray) -> dict[str, Column]:
    """The six statistics of Sonar.all under a known covariance, and the two arrays' scales s1 and s2 without a target."""
    m, p = sonar.m, sonar.steering
    one, two, all_ = slice(0, m), slice(m, 2 * m), slice(0, 2 * m)
    inverse = np.linalg.inv(cov)

    def powers(a):
        return form(re, im, a[one, one], one, one) / m, form(re, im, a[two, two], two, two) / m, form(re, im, a[one, two], one, two) / m

    def product(a):
        a1, a2, a12 = powers(a)
        return F.sqrt(F.abs(a1) * F.abs(a2)) + a12

    def single(k, part):
        block, v = np.linalg.inv(cov[part, part]), p[part, k]
        w = block @ v
        top = form(re, im, np.outer(w, np.conj(w)), part, part)
        return top / (float((np.conj(v) @ w).real) * form(re, im, block, part, part) + 1e-60)

    left = inverse @ p
    core = left @ np.linalg.inv(ct(p) @ left) @ ct(left)
    a1, a2, a12 = powers(inverse)
    s1, s2 = _scales(a1, a2, a12)
    u1, u2 = s1 + 1e-60, s2 + 1e-60
    cross = form(re, im, core[one, two], one, two)
    nmf = single(0, one), single(1, two)
    return {
        "glrt": product(inverse) / (product(sonar.residual_inverse(inverse)) + 1e-60),
        "rao": 2 * (form(re, im, core[one, one], one, one) / (u1 * u1) + form(re, im, core[two, two], two, two) / (u2 * u2) + 2 * cross / (u1 * u2)),
        "independent": -m * (F.log(1 - F.abs(nmf[0]) + 1e-15) + F.log(1 - F.abs(nmf[1]) + 1e-15)),
        "array1": nmf[0],
        "array2": nmf[1],
        "matched": form(re, im, core, all_, all_),
        "s1": s1,
        "s2": s2,
    }
