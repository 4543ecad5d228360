"""Queries of the generators, the Monte-Carlo pipelines and the context experiments.

Sizes are arguments; those of the queries fit one machine.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covaria.functions import detectors as det
from covaria.functions import estimators as est
from covaria.operators import decide
from covaria.operators.groups import by_group
from covaria.operators.trials import simulate, sonar_kernel, sonar_trials
from covaria.plans.registry import query, r6
from covaria.sources import generate as gen

DATES = 12


@dataclass(frozen=True)
class Sizes:
    """Of a run over dates; the defaults are those of a full run, at least 10 / pfa trials are needed for a threshold."""

    trials: int = 10_000
    least: int = 5
    most: int = 1_000
    points: int = 30
    pfa: float = 1e-3
    fraction: float = 0.5

    @property
    def dates(self) -> list[int]:
        return gen.dates_grid(self.least, self.most, self.points)


def over_dates(spark, law: dict, offline, step, sizes: Sizes, changes: bool = False) -> DataFrame:
    """mode, trial, T, stat: the running and the offline statistic over T dates, for each trial and T of the grid.

    Without changes one series a trial serves every T: one fold, and offline statistics of its prefixes. With
    them each T has series of its own, whose law changes at the share `fraction` of T, at the third date at least.
    """
    grid = sizes.dates
    length = max(grid)
    n, p = law["n"], 6 if law["law"] == "kronecker" else len(law["before"])

    def kernel(cases, trials):
        out = {name: [None] * len(trials) for name in ("T", "online", "offline")}
        for c in np.unique(cases):
            rows = np.flatnonzero(cases == c)
            ts = [grid[c]] if changes else grid
            at = max(2, int(ts[-1] * sizes.fraction)) if changes else None
            x = np.stack([gen.trial(k=int(k), **(law | {"dates": ts[-1], "change": at})) for k in trials[rows]])
            run = det.fold(x, step)[:, [t - 1 for t in ts]].tolist()
            whole = np.stack([offline(x[:, :t]) for t in ts], 1).tolist()
            for r, a, b in zip(rows, run, whole, strict=True):
                out["T"][r], out["online"][r], out["offline"][r] = ts, a, b
        return out

    rows = simulate(spark, len(grid) if changes else 1, sizes.trials, kernel, "T array<int>, online array<double>, offline array<double>", length * n * p * 16)
    long = rows.select("trial", F.explode(F.arrays_zip("T", "online", "offline")).alias("x")).select("trial", "x.T", "x.online", "x.offline")
    return long.unpivot(["trial", "T"], ["online", "offline"], "mode", "stat")


def _laws(kind: str, dates: int = DATES):
    """(law under H0, law under H1) for a kind."""
    if kind == "kronecker":
        before, after = gen.factors(2, 3), gen.factors(2, 3, 8, 3)
        common = {"seed": 42, "law": kind, "dates": dates, "n": 7}
    else:
        mode = "trace" if kind == "compound" else "det"
        before, after = gen.covariance(4, 0, mode), gen.covariance(4, 1, mode)
        common = {"seed": 42, "law": kind, "dates": dates, "n": 9}
    return common | {"before": before}, common | {"before": before, "after": after, "change": dates // 2}


_METHODS = {
    "gaussian": (det.gaussian_glrt, det.gaussian_step),
    "compound": (lambda x: det.compound_glrt(x, iter_max=20), lambda s, x: det.compound_step(s, x, iter_max=20, tol=1e-4)),
    "kronecker": (lambda x: det.kronecker_glrt(x, 2, 3, iter_max=20), lambda s, x: det.kronecker_step(s, x, 2, 3, iter_max=20)),
}


def null_moments(spark, kind: str, sizes: Sizes) -> DataFrame:
    """T, and means and deviations over the trials without a change."""
    return decide.compare_modes(over_dates(spark, _laws(kind)[0], *_METHODS[kind], sizes), ["trial"])


def detection_power(spark, kind: str, sizes: Sizes) -> DataFrame:
    """mode, T, threshold, power: thresholds from trials without a change, with the same seed."""
    none, some = _laws(kind)
    h0, h1 = over_dates(spark, none, *_METHODS[kind], sizes), over_dates(spark, some, *_METHODS[kind], sizes, True)
    return decide.power(h0, h1, sizes.pfa, ["mode", "T"])


#: What the queries run; thresholds have 10 / pfa trials.
SIZES = {
    "gaussian": (Sizes(1_000), Sizes(1_000, most=200, pfa=1e-2)),
    "compound": (Sizes(50, most=200), Sizes(100, most=50, points=10, pfa=0.1)),
    "kronecker": (Sizes(50, most=100), Sizes(100, most=50, points=10, pfa=0.1)),
}
for _k, _kind in enumerate(_METHODS):
    query(f"i{9 + 2 * _k:02d}_mc_{_kind}_h0")(lambda spark, d, kind=_kind: null_moments(spark, kind, SIZES[kind][0]))
    query(f"i{10 + 2 * _k:02d}_mc_{_kind}_h1")(lambda spark, d, kind=_kind: detection_power(spark, kind, SIZES[kind][1]))


def _moment(spark, law, trials=20):
    """Mean squared modulus by feature: a generator's signature."""
    x = gen.series(spark, trials, **law).select("t", F.posexplode(F.zip_with("re", "im", lambda a, b: a * a + b * b)).alias("k", "v"))
    return x.groupBy("k").agg(F.round(F.avg("v"), 6).alias("power"), F.count("*").alias("n"))


@query("g01_sigma_true")
def _(spark, d):
    s = gen.covariance(4, 0)
    return spark.createDataFrame([(i, j, float(s[i, j].real), float(s[i, j].imag)) for i in range(4) for j in range(4)], "i int, j int, re double, im double")


@query("g06_kronecker_factors")
def _(spark, d):
    return spark.createDataFrame([(n, i, j, float(m[i, j].real), float(m[i, j].imag)) for n, m in zip("ab", gen.factors(2, 3), strict=True) for i in range(len(m)) for j in range(len(m))], "factor string, i int, j int, re double, im double")


for _id, _kind, _side in (("g02_gaussian", "gaussian", 0), ("g03_compound", "compound", 0), ("g04_gaussian_h1", "gaussian", 1), ("g05_compound_h1", "compound", 1), ("g07_kronecker", "kronecker", 0), ("g08_kronecker_h1", "kronecker", 1)):
    query(_id)(lambda spark, d, k=_kind, s=_side: _moment(spark, _laws(k)[s]))

_M = 4
_COV, _P = gen.sonar_covariance(_M), gen.steering(_M, 30.0, 45.0)
_SONAR = det.Sonar(_M, gen.steering(_M, 45.0, 45.0))


def _tyler(x):
    return est.two_array_tyler(x, x.shape[-1] // 2)


#: The statistic and the estimator of each detector; none where the covariance is known.
DETECTORS = {
    "glrt": ("glrt", None), "rao": ("rao", None), "independent": ("independent", None), "array1": ("array1", None), "array2": ("array2", None), "matched": ("matched", None),
    "glrt_tyler": ("glrt", _tyler), "rao_tyler": ("rao", _tyler), "glrt_scm": ("glrt", est.scm), "rao_scm": ("rao", est.scm),
}


def _of(*names: str) -> dict[str, tuple]:
    return {n: DETECTORS[n] for n in names}


def sonar_stats(spark, trials: int, detectors: dict[str, tuple], cases: int = 1, signal=None, seed: int = 0, **texture) -> DataFrame:
    """case, trial, detector, stat with 4 m secondary samples a trial."""
    kernel = sonar_kernel(_SONAR, _COV, detectors, signal, seed=seed, **texture)
    return sonar_trials(spark, cases, trials, kernel, detectors, _M)


query("g11_sonar_h0")(lambda spark, d: _row_power(gen.sonar_samples(spark, 50, _M, _COV)))
query("g12_sonar_h1")(lambda spark, d: _row_power(gen.sonar_samples(spark, 50, _M, _COV, signal=_P @ np.ones(2) * 0.05, seed=1)))
query("g13_sonar_secondary")(lambda spark, d: _row_power(gen.sonar_samples(spark, 20, _M, _COV, 16, None, 0.5, 2.0, 100)))


def _row_power(x):
    return x.select("trial", F.posexplode(F.zip_with("re", "im", lambda a, b: a * a + b * b)).alias("k", "v")).groupBy("k").agg(F.round(F.avg("v"), 9).alias("power"), F.count("*").alias("n"))


@query("j01_pfa_threshold")
def _(spark, d):
    """Seven detectors, known covariance and adaptive ones, over 500 thresholds each."""
    seven = _of("glrt", "rao", "independent", "matched", "glrt_tyler", "rao_tyler", "glrt_scm")
    return decide.pfa_curve(sonar_stats(spark, 10_000, seven), 500, keys=["detector"])


def detected(spark, detectors: dict[str, tuple], pfa: float, trials_h0: int, trials: int, cases: int, signal) -> DataFrame:
    """case, detector, pd: a threshold for each detector from trials without a signal, rates for each case of a signal."""
    limits = decide.threshold_at_pfa(sonar_stats(spark, trials_h0, detectors), pfa, ["detector"])
    h1 = sonar_stats(spark, trials, detectors, cases, signal, seed=1)
    return h1.join(limits, "detector").groupBy("case", "detector").agg(F.avg((F.col("stat") > F.col("threshold")).cast("double")).alias("pd"))


def _named(rates: DataFrame, **values) -> DataFrame:
    """The cases' numbers as values, which are arrays by case."""
    at = lambda v: F.get(F.array(*(F.lit(float(y)) for y in v)), F.col("case"))
    return rates.select("detector", *(at(v).alias(n) for n, v in values.items()), "pd")


@query("j02_pd_snr")
def _(spark, d):
    """All ten detectors at 150 levels from -25 to 5 dB."""
    db, alphas = gen.snr_sweep(_M, _COV, _SONAR.steering)
    rates = detected(spark, DETECTORS, 1e-2, 1_000, 100, len(db), lambda c: _SONAR.steering @ np.full(2, alphas[c]))
    return _named(rates, snr=db)


@query("j03_pd_angle")
def _(spark, d):
    """Five detectors steer to the nominal angles; signals of -12 dB come from a grid of 51 x 51 others."""
    angles = np.linspace(-75.0, 75.0, 51)
    alpha = gen.snr_sweep(_M, _COV, _SONAR.steering, -12.0, -12.0, 1)[1][0]
    five = _of("glrt", "rao", "independent", "glrt_tyler", "glrt_scm")
    rates = detected(spark, five, 1e-2, 1_000, 10, 51 * 51, lambda c: gen.steering(_M, angles[c // 51], angles[c % 51]) @ np.full(2, alpha))
    cell = lambda k: F.get(F.array(*(F.lit(float(a)) for a in angles)), k.cast("int"))
    return rates.select("detector", cell(F.floor(F.col("case") / 51)).alias("theta1"), cell(F.col("case") % 51).alias("theta2"), "pd")


@query("j04_tyler_convergence")
def _(spark, d):
    def kernel(x):
        history: list = []
        est.two_array_tyler(x[:, 0], _M, 0.0, 25, history)
        return {"v": np.stack(history, 1)}

    rows = by_group(gen.sonar_samples(spark, 20, _M, _COV, 32), ["trial"], kernel, "v array<double>").select("trial", F.posexplode("v").alias("it", "v"))
    return rows.groupBy("it").agg(F.avg("v").alias("deviation"))


def _context(spark, cases: list[tuple[int, int]], f, trials: int = 20) -> DataFrame:
    """One row a case (d, n) and trial from the numbers f returns; a trial's stream depends on d + n + trial."""
    import pandas as pd

    names = list(f(np.ones((2, 3))))

    def run(frames):
        for frame in frames:
            rows = [(d, n, k, *f(1 + np.random.default_rng(d + n + k).standard_normal((d, n))).values()) for d, n, k in frame.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["d", "n", "trial", *names])

    grid = spark.createDataFrame(cases, "d int, n int").crossJoin(spark.range(trials).select(F.col("id").cast("int").alias("trial")))
    got = grid.repartition(8).mapInPandas(run, "d int, n int, trial int, " + ", ".join(f"{n} double" for n in names))
    return got.groupBy("d", "n").agg(*(g(c).alias(f"{c}_{s}") for c in names for g, s in ((F.avg, "mean"), (F.stddev_pop, "std"))))


def _cov(x):
    return np.cov(x)


query("j05_scm_many_samples")(lambda spark, d: _context(spark, [(7, 7**k) for k in range(1, 6)], lambda x: {"mean_error": float(np.linalg.norm(x.mean(1) - 1)), "cov_error": float(np.linalg.norm(_cov(x) - np.eye(len(x))))}))


def _errors(x):
    s = _cov(x)
    return {"mean_error": float(np.linalg.norm(x.mean(1) - 1)), "cov_error": float(np.linalg.norm(s - np.eye(len(x)))), "condition": float(np.linalg.cond(s))}


# The reference's whole grid, from fewer features than samples to 1,000 of them, and its 50 trials.
query("j06_scm_few_samples")(lambda spark, d: _context(spark, [(int(p), 30) for p in np.unique(np.logspace(0.5, 3, 30, dtype=int))], _errors, 50))
query("j07_linear_shrinkage")(lambda spark, d: _context(spark, [(int(p), 30) for p in np.unique(np.logspace(0.5, 3, 30, dtype=int))], lambda x: {"condition": float(np.linalg.cond(est.shrink(_cov(x), 0.1)))}))


@query("j07_shrink", "SELECT n, round(0.9 * x0 * x0 + 0.1, 6) + 0.0 AS a, round(0.9 * x0 * x1, 6) + 0.0 AS b FROM (SELECT vec_id AS n, embedding[1]::DOUBLE AS x0, embedding[2]::DOUBLE AS x1 FROM embeddings) q")
def _(spark, d):
    from covaria.plans.registry import samples

    return samples(spark, d, 2).select("n", r6(0.9 * F.col("x0") * F.col("x0") + 0.1, "a"), r6(0.9 * F.col("x0") * F.col("x1"), "b"))


@query("j08_covariance_examples", "SELECT i, j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END AS eye, round(pow(0.7, abs(i - j)), 6) + 0.0 AS toeplitz FROM (SELECT unnest(range(0, 10)) AS i) a, (SELECT unnest(range(0, 10)) AS j) b")
def _(spark, d):
    c = spark.range(10).withColumnRenamed("id", "i").crossJoin(spark.range(10).withColumnRenamed("id", "j"))
    return c.select("i", "j", F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0).alias("eye"), r6(F.pow(F.lit(0.7), F.abs(F.col("i") - F.col("j"))), "toeplitz"))


@query("j09_spd_cone", "SELECT i, j, s, round(s * sqrt((i / 20.0) * (j / 20.0)), 6) + 0.0 AS gamma FROM (SELECT unnest(range(0, 21)) AS i) a, (SELECT unnest(range(0, 21)) AS j) b, (SELECT unnest([-1, 1]) AS s) c")
def _(spark, d):
    c = spark.range(21).withColumnRenamed("id", "i").crossJoin(spark.range(21).withColumnRenamed("id", "j"))
    return c.select("i", "j", F.explode(F.array(F.lit(-1), F.lit(1))).alias("s")).select("i", "j", "s", r6(F.col("s") * F.sqrt((F.col("i") / 20.0) * (F.col("j") / 20.0)), "gamma"))
