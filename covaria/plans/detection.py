"""Queries of change detection, online detection, decisions and sonar detection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from covaria.functions import detectors as det
from covaria.functions import sonar_expr
from covaria.operators import decide
from covaria.operators import moments as mom
from covaria.operators.adaptive import adaptive, split, unpivoted
from covaria.operators.groups import detect, running
from covaria.plans.registry import SERIES, SPREAD, observations, query, r6, series, spread, table
from covaria.sources import generate as gen


def _per(p: int) -> str:
    cols = [(i, j) for i in range(p) for j in range(i, p)]
    det_ = {2: "s00 * s11 - s01 * s01", 3: "s00 * (s11 * s22 - s12 * s12) - s01 * (s01 * s22 - s12 * s02) + s02 * (s01 * s12 - s11 * s02)"}[p]
    inner = f"SELECT g, t, count(*) AS n, {', '.join(f'avg(x{i} * x{j}) AS s{i}{j}' for i, j in cols)} FROM {SERIES} x GROUP BY g, t HAVING count(*) > {p}"
    return f"(SELECT *, ln({det_}) AS ld FROM ({inner}) y)", det_, cols


def glrt_sql(p: int) -> str:
    per, det_, cols = _per(p)
    return f"SELECT g, n_dates, round(n_dates * ln({det_}) - l, 6) + 0.0 AS stat FROM (SELECT g, count(*) AS n_dates, sum(ld) AS l, {', '.join(f'avg(s{i}{j}) AS s{i}{j}' for i, j in cols)} FROM {per} z GROUP BY g) w"


def running_sql(p: int) -> str:
    per, det_, cols = _per(p)
    over = "OVER (PARTITION BY g ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"SELECT g, t, n_dates, round(n_dates * ln({det_}) - l, 6) + 0.0 AS stat FROM (SELECT g, t, count(*) {over} AS n_dates, sum(ld) {over} AS l, {', '.join(f'avg(s{i}{j}) {over} AS s{i}{j}' for i, j in cols)} FROM {per} z) w"


for _p in (2, 3):
    query(f"d02_gaussian_glrt_p{_p}", glrt_sql(_p))(lambda spark, d, p=_p: mom.glrt(series(spark, d), ["g"], "t", [f"x{i}" for i in range(p)]).select("g", "n_dates", r6("stat")))
    query(f"e05_online_gaussian_p{_p}", running_sql(_p))(lambda spark, d, p=_p: mom.glrt_running(series(spark, d), ["g"], "t", [f"x{i}" for i in range(p)]).select("g", "t", "n_dates", r6("stat")))


@query("e04_online_initialise", f"SELECT * FROM ({running_sql(2)}) q WHERE n_dates = 2")
def _(spark, d):
    return mom.glrt_running(series(spark, d), ["g"], "t", ["x0", "x1"]).where("n_dates = 2").select("g", "t", "n_dates", r6("stat"))


@query("e13_online_single_pass", f"SELECT * FROM ({running_sql(2)}) q WHERE n_dates IN (2, 3, 5)")
def _(spark, d):
    """The running statistic at chosen numbers of dates."""
    return mom.glrt_running(series(spark, d), ["g"], "t", ["x0", "x1"]).where(F.col("n_dates").isin(2, 3, 5)).select("g", "t", "n_dates", r6("stat"))


@query("e14_online_run", f"SELECT g, max(n_dates) AS n_dates, arg_max(stat, n_dates) AS stat FROM ({running_sql(2)}) q GROUP BY g")
def _(spark, d):
    rows = mom.glrt_running(series(spark, d), ["g"], "t", ["x0", "x1"])
    return rows.groupBy("g").agg(F.max("n_dates").alias("n_dates"), F.max_by("stat", "n_dates").alias("stat")).select("g", "n_dates", r6("stat"))


# The kernels on five dates a label.

_DK = f"(SELECT g, t, ln(avg(x0 * x0) * avg(x1 * x1) - avg(x0 * x1) * avg(x0 * x1)) AS ld, avg(x0 * x0) AS a, avg(x0 * x1) AS b, avg(x1 * x1) AS c FROM {SPREAD} x GROUP BY g, t) y"
query("d02_gaussian_glrt_kernel", f"SELECT g, round(count(*) * ln(avg(a) * avg(c) - avg(b) * avg(b)) - sum(ld), 6) + 0.0 AS stat FROM {_DK} GROUP BY g")(lambda spark, d: detect(spread(spark, d, False, 2), ["g"], det.gaussian_glrt, uneven=True).select("g", r6("stat")))


def _statistic(f):
    return lambda spark, d: detect(spread(spark, d), ["g"], f, uneven=True).select("g", r6("stat"))


query("d03_two_step_student")(_statistic(det.student_glrt))
query("d04_two_step_tyler")(_statistic(det.tyler_glrt))
query("d05_compound_glrt")(_statistic(det.compound_glrt))
query("d05_compound_glrt_mixed")(_statistic(lambda x: det.compound_glrt(x, convention="mixed")))
query("d06_kronecker_glrt")(_statistic(lambda x: det.kronecker_glrt(x, 2, 2)))


def _running(step):
    def run(spark, d):
        rows = running(spread(spark, d), ["g"], step, uneven=True)
        return rows.select("g", F.posexplode("stats").alias("t", "stat")).select("g", "t", r6("stat"))

    return run


query("e03_online_gaussian_kernel")(_running(det.gaussian_step))
query("e10_online_compound")(_running(det.compound_step))
query("e12_online_kronecker")(_running(lambda s, x: det.kronecker_step(s, x, 2, 2)))


def _online_estimate(first, step):
    """The running estimate's trace-normalised first row after all dates."""

    def kernel(x):
        dates = x if isinstance(x, list) else np.moveaxis(x, 1, 0)
        state = first(dates[0])
        for t in range(1, len(dates)):
            state = step(dates[t], state, t + 1)
        s = state[0]
        return {"v": (s / np.trace(s, axis1=-2, axis2=-1)[..., None, None]).real.reshape(len(s), -1)}

    from covaria.operators.groups import by_group

    return lambda spark, d: by_group(spread(spark, d), ["g"], kernel, "v array<double>", uneven=True).select("g", F.posexplode("v").alias("k", "v")).select("g", "k", r6("v"))


query("e06_online_natural_gradient")(_online_estimate(det.est.natural_gradient, lambda x, s, t: det.est.natural_gradient_step(x, s)))
query("e07_online_scaled_gaussian_estimator")(_online_estimate(lambda x: det.est.natural_gradient(x, iter_max=50), lambda x, s, t: det.est.natural_gradient_step(x, s, 0.05)))
query("e08_online_kronecker_estimator")(_online_estimate(lambda x: det.est.kronecker_mm(x, 2, 2), lambda x, s, t: det.est.kronecker_online_step(x, s, t)))

# Decisions, on order totals: H0 are orders with status F, H1 the others.

_H0, _H1 = "(SELECT o_totalprice / 1000 AS stat FROM orders WHERE o_orderstatus = 'F')", "(SELECT o_totalprice / 1000 AS stat, o_orderpriority AS snr FROM orders WHERE o_orderstatus <> 'F')"


def _h0(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'F'").select((F.col("o_totalprice") / 1000).alias("stat"))


def _h1(spark, d):
    return table(spark, d, "orders").where("o_orderstatus <> 'F'").select((F.col("o_totalprice") / 1000).alias("stat"), F.col("o_orderpriority").alias("snr"))


@query("f01_empirical_pfa", f"SELECT threshold, round(avg((stat > threshold)::INT), 6) + 0.0 AS pfa FROM {_H0} h, (SELECT unnest([50.0, 100.0, 200.0, 400.0]) AS threshold) t GROUP BY threshold")
def _(spark, d):
    grid = spark.createDataFrame([(50.0,), (100.0,), (200.0,), (400.0,)], "threshold double")
    return decide.exceeding(_h0(spark, d), grid, [], "pfa").select("threshold", r6("pfa"))


@query("f02_threshold_at_pfa", f"SELECT pfa, round(quantile_cont(stat, 1 - pfa), 6) + 0.0 AS threshold FROM {_H0} h, (SELECT unnest([0.01, 0.05, 0.1]) AS pfa) t GROUP BY pfa".replace("quantile_cont(stat, 1 - pfa)", "CASE pfa WHEN 0.01 THEN quantile_cont(stat, 0.99) WHEN 0.05 THEN quantile_cont(stat, 0.95) ELSE quantile_cont(stat, 0.9) END"))
def _(spark, d):
    h0, out = _h0(spark, d), None
    for pfa in (0.01, 0.05, 0.1):
        one = decide.threshold_at_pfa(h0, pfa).select(F.lit(pfa).alias("pfa"), r6("threshold"))
        out = one if out is None else out.unionByName(one)
    return out


@query("f03_empirical_pd", f"SELECT round(avg((stat > 200.0)::INT), 6) + 0.0 AS pd FROM {_H1} h")
def _(spark, d):
    return _h1(spark, d).agg(F.avg((F.col("stat") > 200.0).cast("double")).alias("pd")).select(r6("pd"))


@query("f04_pd_snr", f"SELECT snr, round(q, 6) + 0.0 AS threshold, round(avg((stat > q)::INT), 6) + 0.0 AS pd FROM {_H1} h, (SELECT quantile_cont(stat, 0.95) AS q FROM {_H0} h) t GROUP BY snr, q")
def _(spark, d):
    return decide.pd_by(_h0(spark, d), _h1(spark, d), 0.05, ["snr"]).select("snr", r6("threshold"), r6("pd"))


@query("f05_pfa_threshold_curve", f"SELECT round(threshold, 4) + 0.0 AS threshold, round(avg((stat > threshold)::INT), 6) + 0.0 AS pfa FROM {_H0} h, (SELECT lo + k * (hi - lo) / 99 AS threshold FROM (SELECT min(stat) AS lo, max(stat) AS hi FROM {_H0} h) e, (SELECT unnest(range(0, 100)) AS k) g) t GROUP BY threshold")
def _(spark, d):
    return decide.pfa_curve(_h0(spark, d), 100).select((F.round("threshold", 4) + 0.0).alias("threshold"), r6("pfa"))


_SON = gen.sonar_covariance(2, 1.0).real
_P2 = gen.steering(2, 0.0, 0.0)
_SONAR = det.Sonar(2, _P2)
_ROW = "(SELECT vec_id AS n, embedding[1]::DOUBLE AS x0, embedding[2]::DOUBLE AS x1, embedding[3]::DOUBLE AS x2, embedding[4]::DOUBLE AS x3 FROM embeddings) x"


def _sql_form(a, rows, cols) -> str:
    return "(" + " + ".join(f"({float(a[k, l].real)!r}) * x{s} * x{t}" for k, s in enumerate(rows) for l, t in enumerate(cols)) + ")"


def _sonar_sql() -> dict[str, str]:
    inverse, p = np.linalg.inv(_SON), _P2.real
    one, two = (0, 1), (2, 3)
    left = inverse @ p
    core = left @ np.linalg.inv(p.T @ left) @ left.T

    def powers(a):
        return f"({_sql_form(a[:2, :2], one, one)} / 2)", f"({_sql_form(a[2:, 2:], two, two)} / 2)", f"({_sql_form(a[:2, 2:], one, two)} / 2)"

    def product(a):
        a1, a2, a12 = powers(a)
        return f"(sqrt(abs({a1}) * abs({a2})) + {a12})"

    def single(k):
        part = slice(2 * k, 2 * k + 2)
        block, v = np.linalg.inv(_SON[part, part]), p[part, k]
        w = block @ v
        return f"({_sql_form(np.outer(w, w), (one, two)[k], (one, two)[k])} / ({float(v @ w)!r} * {_sql_form(block, (one, two)[k], (one, two)[k])} + 1e-60))"

    a1, a2, a12 = powers(inverse)
    s1, s2 = f"sqrt(abs({a1} + sqrt({a1} / ({a2} + 1e-30)) * {a12}))", f"sqrt(abs({a2} + sqrt({a2} / ({a1} + 1e-30)) * {a12}))"
    u1, u2 = f"({s1} + 1e-60)", f"({s2} + 1e-60)"
    return {
        "glrt": f"{product(inverse)} / ({product(inverse - core)} + 1e-60)",
        "rao": f"2 * ({_sql_form(core[:2, :2], one, one)} / ({u1} * {u1}) + {_sql_form(core[2:, 2:], two, two)} / ({u2} * {u2}) + 2 * {_sql_form(core[:2, 2:], one, two)} / ({u1} * {u2}))",
        "independent": f"-2 * (ln(1 - abs({single(0)}) + 1e-15) + ln(1 - abs({single(1)}) + 1e-15))",
        "s1": s1, "s2": s2, "array1": single(0), "array2": single(1), "matched": _sql_form(core, (0, 1, 2, 3), (0, 1, 2, 3)),
    }


_SQL = _sonar_sql()


def _sonar(name):
    def run(spark, d):
        x = table(spark, d, "embeddings").select(F.col("vec_id").alias("n"), F.transform(F.slice("embedding", 1, 4), lambda v: v.cast("double")).alias("re"))
        return x.select("n", (F.round(sonar_expr.statistics(F.col("re"), None, _SONAR, _SON)[name], 4) + 0.0).alias("stat"))

    return run


for _id, _name in (("d12_mnmf_glrt", "glrt"), ("d13_mnmf_rao", "rao"), ("d14_mnmf_independent", "independent"), ("d15_nmf_array1", "array1"), ("d15_nmf_array2", "array2"), ("d16_mimo_matched_filter", "matched")):
    query(_id, f"SELECT n, round({_SQL[_name]}, 4) + 0.0 AS stat FROM {_ROW}")(_sonar(_name))


@query("d07_quadratic_form", f"SELECT n, round({_sql_form(_SON, (0, 1, 2, 3), (0, 1, 2, 3))}, 6) + 0.0 AS v FROM {_ROW}")
def _(spark, d):
    x = table(spark, d, "embeddings").select(F.col("vec_id").alias("n"), F.transform(F.slice("embedding", 1, 4), lambda v: v.cast("double")).alias("re"))
    return x.select("n", r6(sonar_expr.form(F.col("re"), None, _SON, slice(0, 4), slice(0, 4)), "v"))


@query("d08_scale_product", f"SELECT n, round(sqrt(abs({_sql_form(_SON[:2, :2], (0, 1), (0, 1))} / 2) * abs({_sql_form(_SON[2:, 2:], (2, 3), (2, 3))} / 2)) + {_sql_form(_SON[:2, 2:], (0, 1), (2, 3))} / 2, 6) + 0.0 AS v FROM {_ROW}")
def _(spark, d):
    x = table(spark, d, "embeddings").select(F.col("vec_id").alias("n"), F.transform(F.slice("embedding", 1, 4), lambda v: v.cast("double")).alias("re"))
    f = lambda a, s, t: sonar_expr.form(F.col("re"), None, a, s, t) / 2
    one, two = slice(0, 2), slice(2, 4)
    return x.select("n", r6(F.sqrt(F.abs(f(_SON[one, one], one, one)) * F.abs(f(_SON[two, two], two, two))) + f(_SON[one, two], one, two), "v"))


@query("d09_h0_sigmas", f"SELECT n, round({_SQL['s1']}, 6) + 0.0 AS s1, round({_SQL['s2']}, 6) + 0.0 AS s2 FROM {_ROW}")
def _(spark, d):
    x = table(spark, d, "embeddings").select(F.col("vec_id").alias("n"), F.transform(F.slice("embedding", 1, 4), lambda v: v.cast("double")).alias("re"))
    found = sonar_expr.statistics(F.col("re"), None, _SONAR, _SON)
    return x.select("n", r6(found["s1"], "s1"), r6(found["s2"], "s2"))


@query("d10_residual_inverse")
def _(spark, d):
    r = _SONAR.residual_inverse(np.linalg.inv(_SON))
    return spark.createDataFrame([(i, j, float(r[i, j].real)) for i in range(4) for j in range(4)], "i int, j int, v double")


query("d11_mimo_mf_stat", f"SELECT n, round({_SQL['matched']}, 6) + 0.0 AS v FROM {_ROW}")(lambda spark, d: table(spark, d, "embeddings").select(F.col("vec_id").alias("n"), F.transform(F.slice("embedding", 1, 4), lambda v: v.cast("double")).alias("re")).select("n", r6(sonar_expr.statistics(F.col("re"), None, _SONAR, _SON)["matched"], "v")))


def _secondary(spark, d):
    """Labels as trials: the first sample is primary, the others are secondary."""
    return split(observations(spark, d, 4, True).withColumn("trial", F.col("g").cast("long")))


for _id, _estimator in (("d17_adaptive_scm", det.est.scm), ("d17_adaptive_two_array_tyler", lambda x: det.est.two_array_tyler(x, 2))):
    query(_id)(lambda spark, d, e=_estimator: adaptive(*_secondary(spark, d), _SONAR, e))


@query("f06_run_detectors")
def _(spark, d):
    return unpivoted(adaptive(*_secondary(spark, d), _SONAR, det.est.scm), ["trial"], ["glrt", "rao", "independent", "array1", "array2", "matched"])


@query("f07_tyler_relative_deviations")
def _(spark, d):
    from covaria.operators.groups import by_group

    def kernel(x):
        history: list = []
        det.est.two_array_tyler(x[:, 0], 2, 0.0, 20, history)
        return {"v": np.stack(history, 1)}

    rows = by_group(observations(spark, d, 4, True), ["g"], kernel, "v array<double>").select("g", F.posexplode("v").alias("it", "v"))
    return rows.groupBy("it").agg(F.round(F.avg("v"), 9).alias("deviation"))


_ON = f"(SELECT g, n_dates AS T, stat FROM ({running_sql(2)}) q)"
_OFF = f"(SELECT g, n_dates AS T, stat FROM ({running_sql(3)}) q)"


def _mode(spark, d, p):
    return mom.glrt_running(series(spark, d), ["g"], "t", [f"x{i}" for i in range(p)]).select("g", F.col("n_dates").alias("T"), r6("stat"))


@query("f08_aggregate_online_offline", f"SELECT T, round(avg(a), 4) + 0.0 AS online_mean, round(stddev_pop(a), 4) + 0.0 AS online_std, round(avg(b), 4) + 0.0 AS offline_mean, round(stddev_pop(b), 4) + 0.0 AS offline_std, round(avg(abs(a - b)), 4) + 0.0 AS diff_mean, round(stddev_pop(abs(a - b)), 4) + 0.0 AS diff_std FROM (SELECT x.T, x.stat AS a, y.stat AS b FROM {_ON} x JOIN {_OFF} y ON x.g = y.g AND x.T = y.T) z GROUP BY T")
def _(spark, d):
    got = decide.compare(_mode(spark, d, 2), _mode(spark, d, 3), ["g"])
    return got.select("T", *((F.round(c, 4) + 0.0).alias(c) for c in got.columns if c != "T"))


@query("f09_aggregate_power", "SELECT k, round(q, 6) + 0.0 AS threshold, round(avg((stat > q)::INT), 6) + 0.0 AS power FROM (SELECT o_orderkey % 5 AS k, o_totalprice / 1000 AS stat FROM orders WHERE o_orderstatus <> 'F') h JOIN (SELECT o_orderkey % 5 AS k2, quantile_cont(o_totalprice / 1000, 0.9) AS q FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) t ON k = k2 GROUP BY k, q")
def _(spark, d):
    o = table(spark, d, "orders").select((F.col("o_orderkey") % 5).alias("k"), (F.col("o_totalprice") / 1000).alias("stat"), "o_orderstatus")
    got = decide.power(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus <> 'F'"), 0.1, ["k"])
    return got.select("k", r6("threshold"), r6("power"))


@query("f12_chunk_trial_ranges", "SELECT unnest(range(0, 1000, 96)) AS start")
def _(spark, d):
    return spark.range(1).select(F.explode(decide.chunk_ranges(1000, 96)).alias("start")).select(F.col("start").cast("long").alias("start"))


@query("f13_t_vec_logspace", "SELECT DISTINCT floor(pow(10, log10(5) + k * (log10(200) - log10(5)) / 19) + 1e-9)::INT AS T FROM (SELECT unnest(range(0, 20)) AS k) q")
def _(spark, d):
    at = F.pow(F.lit(10.0), F.log10(F.lit(5.0)) + F.col("id") * (F.log10(F.lit(200.0)) - F.log10(F.lit(5.0))) / 19)
    return spark.range(20).select(F.floor(at + 1e-9).cast("int").alias("T")).distinct()
