"""Queries of the scalar and linear-algebra functions and of the positive-vector manifold."""

from __future__ import annotations

from pyspark.sql import functions as F

from covaria.functions import expr
from covaria.operators import moments as mom
from covaria.plans.registry import query, r6, samples, samples_sql, table

_S2 = "SELECT g, count(*) AS n, avg(x0 * x0) AS s00, avg(x0 * x1) AS s01, avg(x1 * x1) AS s11 FROM " + samples_sql(2) + " GROUP BY g"
_S3 = "SELECT g, avg(x0 * x0) AS s00, avg(x0 * x1) AS s01, avg(x0 * x2) AS s02, avg(x1 * x1) AS s11, avg(x1 * x2) AS s12, avg(x2 * x2) AS s22 FROM " + samples_sql(3) + " GROUP BY g"
_D3 = "(s00 * (s11 * s22 - s12 * s12) - s01 * (s01 * s22 - s12 * s02) + s02 * (s01 * s12 - s11 * s02))"


def scm(spark, d, p):
    return mom.moments(samples(spark, d, p), ["g"], [f"x{i}" for i in range(p)])


def _cells(df, m, p, keys=("g",)):
    """Long form of a row-major array column."""
    return df.select(*keys, F.posexplode(m).alias("k", "v")).select(*keys, F.floor(F.col("k") / p).cast("int").alias("i"), (F.col("k") % p).cast("int").alias("j"), r6("v"))


def _long(sql_cells: dict[tuple[int, int], str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT g, {i} AS i, {j} AS j, round({v}, 6) + 0.0 AS v FROM ({source}) s" for (i, j), v in sql_cells.items())


_FULL3 = {(i, j): f"s{min(i, j)}{max(i, j)}" for i in range(3) for j in range(3)}
_FULL2 = {(i, j): f"s{min(i, j)}{max(i, j)}" for i in range(2) for j in range(2)}


@query("a09_standard_normal")
def _(spark, d):
    """A seeded normal sample, generated by Spark."""
    return spark.range(1000).select("id", F.randn(42).alias("x"))


@query("a10_uniform")
def _(spark, d):
    return spark.range(1000).select("id", (F.rand(42) * 2.0 - 1.0).alias("x"))


@query("a13_masked_set", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS v FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") < 0, F.lit(0.0)).otherwise(F.col("c_acctbal")).alias("v"))


@query("a14_permute", _long({(j, i): f"x{i} * {j + 1}" for i in range(2) for j in range(3)}, "SELECT n AS g, x0, x1 FROM " + samples_sql(2)))
def _(spark, d):
    """Axes of a 2 x 3 array exchanged."""
    x = samples(spark, d, 2).select(F.col("n").alias("g"), F.array(*(F.col(f"x{i}") * (j + 1) for i in range(2) for j in range(3))).alias("m"))
    turned = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.get("m", (k % 2) * 3 + F.floor(k / 2).cast("int")))
    return _cells(x, turned, 2)


@query("a15_concatenate", "SELECT n AS g, k, round(v, 6) + 0.0 AS v FROM (" + " UNION ALL ".join(f"SELECT n, {k} AS k, x{k % 2} AS v FROM {samples_sql(2)}" for k in range(4)) + ") q")
def _(spark, d):
    x = samples(spark, d, 2).select(F.col("n").alias("g"), F.array("x0", "x1").alias("m"))
    return x.select("g", F.posexplode(F.concat("m", "m")).alias("k", "v")).select("g", "k", r6("v"))


@query("a16_eigh_2x2", f"SELECT g, round((s00 + s11) / 2 - sqrt((s00 - s11) * (s00 - s11) / 4 + s01 * s01), 6) + 0.0 AS low, round((s00 + s11) / 2 + sqrt((s00 - s11) * (s00 - s11) / 4 + s01 * s01), 6) + 0.0 AS high FROM ({_S2}) s")
def _(spark, d):
    low, high = expr.eigh2(F.col("s00"), F.col("s01"), F.col("s11"))
    return scm(spark, d, 2).select("g", r6(low, "low"), r6(high, "high"))


@query("a17_diag_embed", _long({(i, j): f"x{i}" if i == j else "0.0" for i in range(3) for j in range(3)}, "SELECT n AS g, x0, x1, x2 FROM " + samples_sql(3)))
def _(spark, d):
    x = samples(spark, d, 3).select(F.col("n").alias("g"), F.array("x0", "x1", "x2").alias("v"))
    return _cells(x, expr.diag_embed(F.col("v")), 3)


@query("a18_trace", f"SELECT g, round(s00 + s11 + s22, 6) + 0.0 AS v FROM ({_S3}) s")
def _(spark, d):
    return scm(spark, d, 3).select("g", r6(expr.trace(mom.flat(3), 3), "v"))


@query("a19_det", f"SELECT g, round({_D3}, 6) + 0.0 AS v FROM ({_S3}) s")
def _(spark, d):
    return scm(spark, d, 3).select("g", r6(expr.det_of(mom.matrix(3)), "v"))


@query("a22_cast_like", "SELECT n, x0::FLOAT::DOUBLE AS v FROM " + samples_sql(1))
def _(spark, d):
    return samples(spark, d, 1).select("n", F.col("x0").cast("float").cast("double").alias("v"))


@query("a23_to_complex", "SELECT n, x0 AS re, 0.0 AS im FROM " + samples_sql(1))
def _(spark, d):
    x = samples(spark, d, 1).select("n", F.array("x0").alias("re")).withColumn("im", F.transform("re", lambda v: F.lit(0.0)))
    return x.select("n", F.get("re", F.lit(0)).alias("re"), F.get("im", F.lit(0)).alias("im"))


@query("a24_to_dtype", "SELECT o_orderkey, o_totalprice::FLOAT::DOUBLE AS v FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("float").cast("double").alias("v"))


for _mode, _scale in (("none", "1.0"), ("diag", "s00"), ("trace", "((s00 + s11 + s22) / 3)"), ("det", f"pow({_D3}, 1.0 / 3)")):

    def _normalised(spark, d, mode=_mode):
        return _cells(scm(spark, d, 3), expr.normalise(mom.flat(3), 3, mode), 3)

    query(f"a27_normalize_{_mode}", _long({k: f"{v} / {_scale}" for k, v in _FULL3.items()}, _S3))(_normalised)


@query("a32_multiherm", _long({(i, j): f"(x{i} * {j + 1} + x{j} * {i + 1}) / 2" for i in range(3) for j in range(3)}, "SELECT n AS g, x0, x1, x2 FROM " + samples_sql(3)))
def _(spark, d):
    x = samples(spark, d, 3).select(F.col("n").alias("g"), F.array(*(F.col(f"x{i}") * (j + 1) for i in range(3) for j in range(3))).alias("m"))
    return _cells(x, expr.hermitian(F.col("m"), 3), 3)


_ROOT = "sqrt(s00 * s11 - s01 * s01)"
_T = f"sqrt(s00 + s11 + 2 * {_ROOT})"


@query("a34_sqrtm_2x2", f"SELECT g, round((s00 + {_ROOT}) / {_T}, 6) + 0.0 AS a, round(s01 / {_T}, 6) + 0.0 AS b, round((s11 + {_ROOT}) / {_T}, 6) + 0.0 AS c FROM ({_S2}) s")
def _(spark, d):
    return scm(spark, d, 2).select("g", *(r6(v, n) for n, v in zip("abc", expr.sqrtm2(F.col("s00"), F.col("s01"), F.col("s11")), strict=True)))


_DR = f"(((s00 + {_ROOT}) * (s11 + {_ROOT}) - s01 * s01) / ({_T} * {_T}))"


@query("a35_invsqrtm_2x2", f"SELECT g, round((s11 + {_ROOT}) / {_T} / {_DR}, 6) + 0.0 AS a, round(-s01 / {_T} / {_DR}, 6) + 0.0 AS b, round((s00 + {_ROOT}) / {_T} / {_DR}, 6) + 0.0 AS c FROM ({_S2}) s")
def _(spark, d):
    return scm(spark, d, 2).select("g", *(r6(v, n) for n, v in zip("abc", expr.inv2(*expr.sqrtm2(F.col("s00"), F.col("s01"), F.col("s11"))), strict=True)))


_LO, _HI = (f"((s00 + s11) / 2 {s} sqrt((s00 - s11) * (s00 - s11) / 4 + s01 * s01))" for s in "-+")
#: log of a 2 x 2 matrix with eigenvalues lo < hi: a I + b M
_LB = f"((ln({_HI}) - ln({_LO})) / ({_HI} - {_LO}))"


@query("a36_logm_2x2", f"SELECT g, round(ln({_LO}) - {_LB} * {_LO} + {_LB} * s00, 6) + 0.0 AS a, round({_LB} * s01, 6) + 0.0 AS b, round(ln({_LO}) - {_LB} * {_LO} + {_LB} * s11, 6) + 0.0 AS c FROM ({_S2}) s")
def _(spark, d):
    low, high = expr.eigh2(F.col("s00"), F.col("s01"), F.col("s11"))
    b = (F.log(high) - F.log(low)) / (high - low)
    a = F.log(low) - b * low
    return scm(spark, d, 2).select("g", r6(a + b * F.col("s00"), "a"), r6(b * F.col("s01"), "b"), r6(a + b * F.col("s11"), "c"))


# Positive vectors: x and y are e^(first and next three dimensions), u and g the dimensions themselves.

_V = "(SELECT n, " + ", ".join(f"exp(x{i}) AS p{i}, exp(x{i + 3}) AS q{i}, x{i} AS u{i}, x{i + 3} AS v{i}" for i in range(3)) + " FROM " + samples_sql(6) + ") s"


def _vectors(spark, d):
    s = samples(spark, d, 6)
    pick = lambda k, f: F.array(*(f(F.col(f"x{i + k}")) for i in range(3)))
    return s.select("n", pick(0, F.exp).alias("x"), pick(3, F.exp).alias("y"), pick(0, lambda c: c).alias("u"), pick(3, lambda c: c).alias("v"))


def _three(name, column, terms):
    sql = "SELECT n, " + ", ".join(f"round({t}, 6) + 0.0 AS v{i}" for i, t in enumerate(terms)) + f" FROM {_V}"
    query(name, sql)(lambda spark, d: _vectors(spark, d).select("n", column().alias("o")).select("n", *(r6(F.get("o", F.lit(i)), f"v{i}") for i in range(3))))


def _one(name, column, term):
    query(name, f"SELECT n, round({term}, 6) + 0.0 AS v FROM {_V}")(lambda spark, d: _vectors(spark, d).select("n", r6(column(), "v")))


_one("b27_spv_inner", lambda: expr.spv_inner(F.col("x"), F.col("u"), F.col("v")), " + ".join(f"u{i} * v{i} / (p{i} * p{i})" for i in range(3)))
_one("b28_spv_norm", lambda: F.sqrt(expr.spv_inner(F.col("x"), F.col("u"), F.col("u"))), "sqrt(" + " + ".join(f"u{i} * u{i} / (p{i} * p{i})" for i in range(3)) + ")")
_three("b29_spv_proj", lambda: F.col("u"), [f"u{i}" for i in range(3)])
_three("b30_spv_egrad2rgrad", lambda: expr.spv_rgrad(F.col("x"), F.col("u")), [f"u{i} * p{i} * p{i}" for i in range(3)])
_three("b31_spv_exp", lambda: expr.spv_exp(F.col("x"), F.col("u")), [f"p{i} * exp(u{i} / p{i})" for i in range(3)])
_three("b32_spv_log", lambda: expr.spv_log(F.col("x"), F.col("y")), [f"p{i} * ln(q{i} / p{i})" for i in range(3)])
_one("b33_spv_dist", lambda: expr.spv_dist(F.col("x"), F.col("y")), "sqrt(" + " + ".join(f"pow(ln(q{i} / p{i}), 2)" for i in range(3)) + ")")
_three("b37_spv_retr", lambda: expr.spv_exp(F.col("x"), F.col("v")), [f"p{i} * exp(v{i} / p{i})" for i in range(3)])

_PAIRS = f"(SELECT a.g AS g, b.g AS h, a.s00 AS a0, a.s01 AS a1, a.s11 AS a2, b.s00 AS b0, b.s01 AS b1, b.s11 AS b2 FROM ({_S2}) a, ({_S2}) b WHERE a.g < b.g)"
_TR = "((a2 * b0 - a1 * b1 + a0 * b2 - a1 * b1) / (a0 * a2 - a1 * a1))"
_DT = "((b0 * b2 - b1 * b1) / (a0 * a2 - a1 * a1))"


def _matrix_pairs(spark, d):
    s = scm(spark, d, 2)
    a = s.select("g", *(F.col(c).alias(f"a{k}") for k, c in enumerate(("s00", "s01", "s11"))))
    b = s.select(F.col("g").alias("h"), *(F.col(c).alias(f"b{k}") for k, c in enumerate(("s00", "s01", "s11"))))
    return a.join(b, F.col("g") < F.col("h"))


@query("b09_hpd_dist_2x2", f"SELECT g, h, round(sqrt(pow(ln({_TR} / 2 - sqrt(greatest({_TR} * {_TR} / 4 - {_DT}, 0.0))), 2) + pow(ln({_TR} / 2 + sqrt(greatest({_TR} * {_TR} / 4 - {_DT}, 0.0))), 2)), 6) + 0.0 AS v FROM {_PAIRS} q")
def _(spark, d):
    return _matrix_pairs(spark, d).select("g", "h", r6(expr.dist2(tuple(F.col(f"a{k}") for k in range(3)), tuple(F.col(f"b{k}") for k in range(3))), "v"))


@query("b17_shpd_proj_2x2", f"SELECT g, h, round(b0 - {_TR} / 2 * a0, 6) + 0.0 AS v0, round(b1 - {_TR} / 2 * a1, 6) + 0.0 AS v1, round(b2 - {_TR} / 2 * a2, 6) + 0.0 AS v2 FROM {_PAIRS} q")
def _(spark, d):
    a, b = ([F.col(f"{n}{k}") for k in range(3)] for n in "ab")
    i = expr.inv2(*a)
    t = i[0] * b[0] + 2 * i[1] * b[1] + i[2] * b[2]
    return _matrix_pairs(spark, d).select("g", "h", *(r6(b[k] - t / 2 * a[k], f"v{k}") for k in range(3)))


@query("h34_hex_to_rgba", "SELECT c_custkey, 'rgba(' || ((c_custkey * 7) % 256) || ',' || ((c_custkey * 13) % 256) || ',' || ((c_custkey * 29) % 256) || ',0.5)' AS v FROM customer")
def _(spark, d):
    c = table(spark, d, "customer")
    part = lambda k: F.lpad(F.hex((F.col("c_custkey") * k) % 256), 2, "0")
    return c.select("c_custkey", expr.hex_to_rgba(F.concat(F.lit("#"), part(7), part(13), part(29)), F.lit(0.5)).alias("v"))
