"""Second moments and what follows from them, as Spark's own partial and final aggregation.

Nothing but p (p + 1) / 2 sums a group is shuffled, so groups may be of any size and skew.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covaria.functions import expr


def _name(i: int, j: int) -> str:
    return f"s{min(i, j)}{max(i, j)}"


def moments(df: DataFrame, keys: list[str], features: list[str], centre: bool = False) -> DataFrame:
    """keys, n, and s_ij for i <= j: mean products of real features, less the means' products if centred."""
    pairs = [(i, j) for i in range(len(features)) for j in range(i, len(features))]
    value = lambda i, j: F.avg(F.col(features[i]) * F.col(features[j])) - (F.avg(features[i]) * F.avg(features[j]) if centre else 0)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *(value(i, j).alias(_name(i, j)) for i, j in pairs))


def matrix(p: int) -> list[list[Column]]:
    return [[F.col(_name(i, j)) for j in range(p)] for i in range(p)]


def flat(p: int) -> Column:
    return F.array(*(x for row in matrix(p) for x in row))


def long_form(df: DataFrame, keys: list[str], p: int) -> DataFrame:
    """keys, i, j, v of the moments."""
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(_name(i, j)).alias("v")) for i in range(p) for j in range(p))))
    return df.select(*keys, cells.alias("c")).select(*keys, "c.i", "c.j", "c.v")


def _dates(df: DataFrame, keys: list[str], date: str, features: list[str], short: str) -> DataFrame:
    """Moments of each date and ld, the logarithm of their determinant: null for a date of p samples or fewer, unless such dates are left out."""
    if short not in ("leave out", "null"):
        raise ValueError("short must be 'leave out' or 'null'")
    p = len(features)
    per = moments(df, [*keys, date], features)
    if short == "leave out":
        per = per.where(F.col("n") > p)
    return per.withColumn("ld", F.when(F.col("n") > p, F.log(expr.det_of(matrix(p)))))


def glrt(df: DataFrame, keys: list[str], date: str, features: list[str], short: str = "leave out") -> DataFrame:
    """keys, n_dates, stat: T log det mean_t S_t - sum_t log det S_t.

    A date with fewer samples than p + 1 has a singular moment: short says whether it is left out, or counted
    with a null statistic for its group.
    """
    p = len(features)
    per = _dates(df, keys, date, features, short)
    mean = per.groupBy(*keys).agg(F.count("*").alias("n_dates"), F.when(F.count("ld") == F.count("*"), F.sum("ld")).alias("sum_ld"), *(F.avg(_name(i, j)).alias(_name(i, j)) for i in range(p) for j in range(i, p)))
    return mean.select(*keys, "n_dates", (F.col("n_dates") * F.log(expr.det_of(matrix(p))) - F.col("sum_ld")).alias("stat"))


def glrt_running(df: DataFrame, keys: list[str], date: str, features: list[str], short: str = "leave out") -> DataFrame:
    """keys, date, n_dates, stat: the statistic over all dates up to each one, by one cumulative window; short as in glrt."""
    p = len(features)
    per = _dates(df, keys, date, features, short)
    w = Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    so_far = per.select(*keys, date, F.count("*").over(w).alias("n_dates"), F.when(F.count("ld").over(w) == F.count("*").over(w), F.sum("ld").over(w)).alias("sum_ld"), *(F.avg(_name(i, j)).over(w).alias(_name(i, j)) for i in range(p) for j in range(i, p)))
    return so_far.select(*keys, date, "n_dates", (F.col("n_dates") * F.log(expr.det_of(matrix(p))) - F.col("sum_ld")).alias("stat"))


def reweighted(df: DataFrame, keys: list[str], steps: int, kind: str, normalisation: str = "none", **parameters) -> DataFrame:
    """keys, s00, s01, s11 after `steps` reweightings of features x0, x1 from the identity, without Python.

    A step is one aggregation and one join with a row a group; a null key is a group of its own. For groups
    that no worker could hold. The plan reads df once a step, so few steps are meant.
    """
    now = df.select(*keys).distinct().select(*keys, F.lit(1.0).alias("s00"), F.lit(0.0).alias("s01"), F.lit(1.0).alias("s11"))
    for _ in range(steps):
        q = expr.quad2(F.col("x0"), F.col("x1"), F.col("s00"), F.col("s01"), F.col("s11"))
        held = now.select(*(F.col(k).alias(f"k_{k}") for k in keys), "s00", "s01", "s11")
        same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in keys))
        weighed = df.join(held, same).withColumn("w", expr.weight(q, kind, 2, **parameters))
        new = weighed.groupBy(*keys).agg(*(F.avg(F.col("w") * F.col(f"x{i}") * F.col(f"x{j}")).alias(_name(i, j)) for i, j in ((0, 0), (0, 1), (1, 1))))
        scale = {"none": F.lit(1.0), "trace": (F.col("s00") + F.col("s11")) / 2, "diag": F.col("s00"), "det": F.sqrt(F.col("s00") * F.col("s11") - F.col("s01") * F.col("s01"))}[normalisation]
        now = new.select(*keys, *((F.col(c) / scale).alias(c) for c in ("s00", "s01", "s11")))
    return now
