"""Column expressions: matrices as row-major array<double>, evaluated by Spark alone.

p is a Python number, so that small determinants and traces unroll into plain arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(m: Column, i: int, j: int, p: int) -> Column:
    return F.get(m, F.lit(i * p + j))


def transpose(m: Column, p: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(p * p - 1)), lambda k: F.get(m, (k % p) * p + F.floor(k / p).cast("int")))


def hermitian(m: Column, p: int) -> Column:
    """(m + m^T) / 2 of a real matrix."""
    return F.zip_with(m, transpose(m, p), lambda u, v: (u + v) / 2)


def trace(m: Column, p: int) -> Column:
    return sum((at(m, i, i, p) for i in range(1, p)), at(m, 0, 0, p))


def det_of(v: list[list[Column]]) -> Column:
    """By cofactors; meant for up to four rows."""
    if len(v) == 1:
        return v[0][0]
    if len(v) == 2:
        return v[0][0] * v[1][1] - v[0][1] * v[1][0]
    parts = [(-1) ** j * v[0][j] * det_of([row[:j] + row[j + 1 :] for row in v[1:]]) for j in range(len(v))]
    return sum(parts[1:], parts[0])


def entries(m: Column, p: int) -> list[list[Column]]:
    return [[at(m, i, j, p) for j in range(p)] for i in range(p)]


def det(m: Column, p: int) -> Column:
    return det_of(entries(m, p))


def diag_embed(x: Column) -> Column:
    n = F.size(x)
    return F.transform(F.sequence(F.lit(0), n * n - 1), lambda k: F.when(k % n == F.floor(k / n), F.get(x, k % n)).otherwise(F.lit(0.0)))


def normalise(m: Column, p: int, mode: str) -> Column:
    if mode == "none":
        return m
    scales = {"diag": lambda: at(m, 0, 0, p), "trace": lambda: trace(m, p) / p, "det": lambda: F.pow(det(m, p), F.lit(1.0 / p))}
    if mode not in scales:
        raise ValueError(f"unknown normalisation: {mode}")
    scale = scales[mode]()
    return F.transform(m, lambda v: v / scale)


def sqrtm2(a, b, c) -> tuple[Column, Column, Column]:
    """The root of [[a, b], [b, c]]: (A + sqrt(det) I) / sqrt(trace + 2 sqrt(det))."""
    s = F.sqrt(a * c - b * b)
    t = F.sqrt(a + c + 2 * s)
    return (a + s) / t, b / t, (c + s) / t


def inv2(a, b, c) -> tuple[Column, Column, Column]:
    d = a * c - b * b
    return c / d, -b / d, a / d


def eigh2(a, b, c) -> tuple[Column, Column]:
    """Eigenvalues of [[a, b], [b, c]], the smaller first."""
    mid, half = (a + c) / 2, F.sqrt((a - c) * (a - c) / 4 + b * b)
    return mid - half, mid + half


def dist2(x: tuple, y: tuple) -> Column:
    """Affine-invariant distance of two 2 x 2 matrices, from the eigenvalues of x^-1 y."""
    i = inv2(*x)
    a, c = i[0] * y[0] + i[1] * y[1], i[1] * y[1] + i[2] * y[2]
    d = (y[0] * y[2] - y[1] * y[1]) / (x[0] * x[2] - x[1] * x[1])
    mid = (a + c) / 2
    half = F.sqrt(F.greatest(mid * mid - d, F.lit(0.0)))
    return F.sqrt(F.pow(F.log(mid - half), 2) + F.pow(F.log(mid + half), 2))


def quad2(x0, x1, a, b, c) -> Column:
    """x^T inverse([[a, b], [b, c]]) x."""
    return (c * x0 * x0 - 2 * b * x0 * x1 + a * x1 * x1) / (a * c - b * b)


def weight(q: Column, kind: str, p: int, df: float = 3.0, limit: float = float("inf"), beta: float = 1.0) -> Column:
    if kind == "tyler":
        return F.lit(float(p)) / q
    if kind == "student":
        return F.lit(p + df / 2) / (q + df / 2)
    if limit <= 0 or beta <= 0:
        raise AssertionError("limit and beta must be positive")
    return F.least(F.lit(1.0), F.lit(limit) / q) / beta


# Positive vectors, as array<double>.


def spv_inner(x, u, v) -> Column:
    return F.aggregate(F.zip_with(F.zip_with(u, v, lambda a, b: a * b), x, lambda a, b: a / (b * b)), F.lit(0.0), lambda s, a: s + a)


def spv_exp(x, u) -> Column:
    return F.zip_with(x, u, lambda a, b: a * F.exp(b / a))


def spv_log(x, y) -> Column:
    return F.zip_with(x, y, lambda a, b: a * F.log(b / a))


def spv_rgrad(x, g) -> Column:
    return F.zip_with(x, g, lambda a, b: b * a * a)


def spv_dist(x, y) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda a, b: F.pow(F.log(b / a), 2)), F.lit(0.0), lambda s, a: s + a))


def bell(x, a, b, c) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.pow(F.abs((x - c) / a), 2 * b))


def pauli(hh: tuple, hv: tuple, vv: tuple) -> tuple[Column, Column, Column]:
    """|HH - VV|, |HV|, |HH + VV| from (re, im) pairs."""
    size = lambda re, im: F.sqrt(re * re + im * im)
    return size(hh[0] - vv[0], hh[1] - vv[1]), size(*hv), size(hh[0] + vv[0], hh[1] + vv[1])


def hex_to_rgba(colour: Column, alpha: Column) -> Column:
    part = lambda k: F.conv(F.substring(colour, k, 2), 16, 10)
    return F.concat(F.lit("rgba("), part(2), F.lit(","), part(4), F.lit(","), part(6), F.lit(","), alpha.cast("string"), F.lit(")"))
